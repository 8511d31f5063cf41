"""Exploratory aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def missing(df: DataFrame, top: int = 20) -> DataFrame:
    """(column, n_missing), most first, counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns])
    return counts.select(F.explode(pairs).alias("x")).select("x.*").orderBy(F.desc("n_missing"), "column").limit(top)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("x.*")
    found = long.groupBy("column").agg(*[f("value").alias(n) for n, f in stats.items()])
    quarters = quantiles(long, F.col("value"), [0.25, 0.5, 0.75], ["column"], "q")
    return found.join(quarters, "column").select("column", *stats, *[F.col("q")[k].alias(n) for k, n in enumerate(("q25", "q50", "q75"))])


def class_rate(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(label).alias("n_positive"), F.avg(label).alias("rate"))


def rate_in(df: DataFrame, bands: dict[str, Column], label: str = "label") -> DataFrame:
    """One row: the label's rate among the rows of each named condition."""
    return df.agg(*[F.avg(F.when(cond, F.col(label))).alias(name) for name, cond in bands.items()])


#: Columns of a block of the product matrix.
BLOCK = 16


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns, over rows where both are present.

    The columns' means are taken off in a pass before, against cancellation. Each task sums the products of blocks of columns over its
    rows, and what is shuffled are these sums, a row for each pair and task.
    """
    means = df.agg(*[F.avg(c).alias(f"_{k}") for k, c in enumerate(cols)]).first()
    centred = df.select(F.array(*[(F.col(c) - F.lit(means[k])).cast("double") for k, c in enumerate(cols)]).alias("v"))
    n = len(cols)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, n, n))
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            there = ~np.isnan(v)
            x, m = np.where(there, v, 0.0), there.astype(float)
            for i in range(0, n, BLOCK):
                for j in range(i, n, BLOCK):
                    one, two = slice(i, i + BLOCK), slice(j, j + BLOCK)
                    for k, (p, q) in enumerate(((m, m), (x, m), (m, x), (x * x, m), (m, x * x), (x, x))):
                        sums[k, one, two] += np.einsum("ri,rj->ij", p[:, one], q[:, two])
        i, j = np.triu_indices(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(s[i, j]) for s in sums]], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = centred.mapInArrow(products, "i bigint, j bigint, n double, sx double, sy double, sxx double, syy double, sxy double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    corr = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(F.greatest(spread, F.lit(0.0))))
    names = F.array(*[F.lit(c) for c in cols])
    return s.select(F.get(names, F.col("i").cast("int")).alias("a"), F.get(names, F.col("j").cast("int")).alias("b"), corr.alias("corr"))


def largest_tile(tiles: DataFrame, by: Sequence[str] = ("resolution",)) -> DataFrame:
    return tiles.groupBy(*by, "tile_id").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("largest"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
