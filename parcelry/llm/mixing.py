"""Mixing sources to target weights.

Rows of a source are put in the order of a hash-random key. Blocks of that order (the key's first digits) are summed,
prefix sums over the blocks and within each block give every row its place on the source's axis of words, and the
source is cut at its budget. A budget beyond the source repeats whole epochs first.

Only sums meet in windows: of a thousand blocks (one block per some thousand documents), of a source's thousands of blocks, and
one row per source. A source with a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fenced, hex_digits, random_key

ROWS_PER_BLOCK = 2000


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """_skey, source_size -> target.

    Sources in the order of _skey take the weights in turn. share times the sum of all sizes is dealt by weight; a
    target ends at cap times its source's size, and what is over goes to the others by weight. Sorted by the weight
    level at which a source is full, the level common to all that aren't full is the first that none after it exceeds.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sources.withColumn("_rank", F.row_number().over(Window.orderBy("_skey")) - 1)
        .withColumn("_weight", F.element_at(listed, (F.col("_rank") % len(weights)).cast("int") + 1))
        .withColumn("_full", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_at", F.col("_full") / F.col("_weight"))
    )
    order = Window.orderBy("_at", "_skey")
    before = F.coalesce(F.sum("_full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    levelled = ranked.withColumn("_level", (total - before) / after).withColumn("_order", F.row_number().over(order))
    first = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_order", "_level"))).over(everything)
    common = F.coalesce(first["_level"], F.lit(float("inf")))
    return levelled.select("_skey", "source_size", F.least(F.col("_full"), common * F.col("_weight")).alias("target"))


def mix_sources(
    df: DataFrame,
    size: Column,
    source: str = "source",
    ids: Sequence[Column] = (),
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 11,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """df with size, source_size, target, copies and taken (size times copies).

    ids feed the random key. A document goes in whole or not at all: the one on the cut goes in if more than half of
    it lies before the cut, so that a source's sum is within half a document of its target. Null sources are one
    source, the last; null sizes are 0; rows equal in key, id and size are interchangeable; an empty table gives an
    empty one. Columns of df named as the new ones are replaced; others of any name stay as they are.

    size is evaluated twice, for the sums and for the places: give a column that is read, not worked out, where that is dear.
    """
    ids = list(ids)
    keys = [f"_id{k}" for k in range(len(ids))]
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))
    inner, back = fenced(
        df, ["size", "source_size", "target", "copies", "taken"], size=F.coalesce(size.cast("long"), F.lit(0)), _skey=skey, _key=random_key(seed, *ids), **dict(zip(keys, ids, strict=True))
    )
    digits = max(1, hex_digits(df.count(), rows_per_block, 8))
    base = inner.withColumn("_block", F.substring("_key", 1, digits))
    blocks = base.groupBy("_skey", "_block").agg(F.sum("size").alias("_block_size")).withColumn("_range", F.substring("_block", 1, max(0, digits - 3)))
    ranges = blocks.groupBy("_skey", "_range").agg(F.sum("_block_size").alias("_range_size"))
    sources = ranges.groupBy("_skey").agg(F.sum("_range_size").alias("source_size"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_range_size").over(earlier("_skey").orderBy("_range")), F.lit(0))).drop("_range_size")
    offsets = (
        blocks.withColumn("_offset", F.coalesce(F.sum("_block_size").over(earlier("_skey", "_range").orderBy("_block")), F.lit(0)))
        .join(starts, ["_skey", "_range"])
        .join(source_targets(sources, weights, share, cap), "_skey")
        .drop("_block_size", "_range")
    )
    inside = earlier("_skey", "_block").orderBy("_key", *keys, "size")
    placed = base.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_skey", "_block"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    middle = F.col("_start") + F.col("_offset") + F.col("_inside") + F.col("size") * F.lit(0.5)
    cut_in = placed.withColumn("copies", (epochs + F.when(middle < rest, 1).otherwise(0)).cast("long"))
    return back(cut_in, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_rows(mixed: DataFrame, columns: Sequence[str], copies: str = "copies") -> DataFrame:
    """The mix itself: each row as often as its copies say."""
    return mixed.filter(F.col(copies) > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("_copy")).select(*columns)
