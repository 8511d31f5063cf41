"""Spatial splits: tiles, or other groups, shuffled into train and test, for a whole grid of experiments at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["train_size", "resolution", "split"]


def arithmetic_order(group: Column, split: Column, seed: int = 42) -> Column:
    """A pseudo-random order that any SQL engine computes alike."""
    return (group * 7919 + split * 104729 + seed * 97) % 1000003


def hash_order(group: Column, split: Column, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), split, group)


def spatial_splits(
    tiles: DataFrame,
    train_tenths: Sequence[int] = (1, 3, 4, 6, 7, 9),
    n_splits: int = 3,
    seed: int = 42,
    group: str = "tile_id",
    order: Callable[[Column, Column, int], Column] = arithmetic_order,
) -> DataFrame:
    """(train_size, resolution, split, pid, role) for every parcel of `tiles` (pid, resolution, tile_id).

    In each experiment the groups are put in a seeded order; the first ceil((1 - train_size) * n) are the test groups.
    Train sizes come in tenths, so that the count is exact. Parcels join their group's role by broadcast or shuffle as
    Spark sees fit; the grid is rows, not a loop.
    """
    groups = tiles.select("resolution", group).distinct()
    grid = groups.withColumn("tenths", F.explode(F.array(*[F.lit(t) for t in train_tenths]))).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    w = Window.partitionBy("tenths", "resolution", "split")
    n_test = F.floor(((10 - F.col("tenths")) * F.count("*").over(w) + 9) / 10)
    rank = F.row_number().over(w.orderBy(order(F.col(group), F.col("split"), seed), group))
    roles = grid.select("tenths", "resolution", "split", group, F.when(rank <= n_test, "test").otherwise("train").alias("role"))
    return tiles.select("resolution", "pid", group).join(roles, ["resolution", group]).select((F.col("tenths") / 10).alias("train_size"), "resolution", "split", "pid", "role")


def group_splits(df: DataFrame, group: str, train_share_percent: int = 75, n_splits: int = 3, seed: int = 42, order: Callable[[Column, Column, int], Column] = hash_order) -> DataFrame:
    """(split, pid, role): splits of ready-made groups; the share counts groups and goes to the train side (rounded down)."""
    grid = df.select(group).distinct().withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    w = Window.partitionBy("split")
    rank = F.row_number().over(w.orderBy(order(F.col(group), F.col("split"), seed), group))
    n_train = F.floor(F.count("*").over(w) * train_share_percent / 100)
    roles = grid.select(group, "split", F.when(rank <= n_train, "train").otherwise("test").alias("role"))
    return df.select("pid", group).join(roles, group).select("split", "pid", "role")


def split_profile(splits: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Train and test counts, their sum, and the realised train share."""
    counts = splits.groupBy(*by).pivot("role", ["train", "test"]).count().fillna(0, subset=["train", "test"])
    return counts.withColumn("total", F.col("train") + F.col("test")).withColumn("share", F.col("train") / F.col("total"))
