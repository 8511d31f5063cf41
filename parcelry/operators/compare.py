"""Two strategies side by side: who is moved earlier or later, by tile, tract and label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import t_tail
from ..sources.store import held
from .metrics import bucketed
from .prefix import with_running
from .quantiles import quantiles, with_quantiles


def comparison(dug_a: DataFrame, dug_b: DataFrame, location: DataFrame | None = None) -> DataFrame:
    """Per parcel both scores and dig indices; prob_change is B - A, dig_change A - B (positive: earlier under B)."""
    side = lambda d, s: d.select("pid", F.col("prob").alias(f"prob_{s}"), F.col("dig_index").alias(f"dig_{s}"))
    both = dug_a.select("pid", "tile_id", "label").join(side(dug_a, "a"), "pid").join(side(dug_b, "b"), "pid")
    both = both.withColumn("prob_change", F.col("prob_b") - F.col("prob_a")).withColumn("dig_change", F.col("dig_a") - F.col("dig_b"))
    return both.join(location, "pid") if location is not None else both


def within_tile(table: DataFrame) -> DataFrame:
    """table with the parcel's rank in its tile under each strategy, the change, and the tile's size."""
    ranked = table
    for s in ("a", "b"):
        ranked = with_running(ranked, ["tile_id"], [F.col(f"dig_{s}"), F.col("pid")], position="_at").withColumn(f"tile_rank_{s}", F.col("_at") - 1).drop("_at")
    sizes = table.groupBy("tile_id").agg(F.count("*").alias("tile_size"))
    changed = ranked.withColumn("tile_change", F.col("tile_rank_a") - F.col("tile_rank_b")).join(sizes, "tile_id")
    return changed.select(*ranked.columns, "tile_change", "tile_size")


def mean_by(table: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    return table.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def histogram(df: DataFrame, col: str, n_bins: int, by: Sequence[str] = (), kind: str = "share") -> DataFrame:
    """(*by, bin, low, n, value): equal-width bins from the least to the greatest value of each group, the last closed; value is
    the share of rows, the density (share over width) or the count. Nulls are left out."""
    by = list(by)
    rows = df.filter(F.col(col).isNotNull())
    ends = rows.groupBy(*by).agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"), F.count("*").alias("_n"))
    joined = rows.join(ends, by) if by else rows.crossJoin(F.broadcast(ends))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    counts = joined.withColumn("bin", F.when(width == 0, 0).otherwise(bucketed(F.col(col), F.col("_lo"), F.col("_hi"), n_bins))).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n"))
    value = {"share": F.col("n") / F.col("_n"), "density": F.try_divide(F.col("n") / F.col("_n"), width), "count": F.col("n").cast("double")}[kind]
    return counts.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"), "n", value.alias("value"))


def shift_summary(table: DataFrame, by: str = "label", change: str = "dig_change") -> DataFrame:
    medians = quantiles(table, F.col(change), [0.5], [by], "_q").select(by, F.col("_q")[0].alias("median_shift"))
    return with_quantiles(table.groupBy(by).agg(F.avg(change).alias("mean_shift")), medians, [by])


def directions(table: DataFrame, by: str = "label", change: str = "dig_change") -> DataFrame:
    return table.groupBy(by).agg(F.count_if(F.col(change) > 0).alias("earlier"), F.count_if(F.col(change) < 0).alias("later"), F.count_if(F.col(change) == 0).alias("same"))


def tract_buckets(table: DataFrame, by: str = "tract", change: str = "dig_change", limit: int = 250) -> DataFrame:
    """Counts by tract: earlier (> limit), within, later (< -limit), by label; a shift of exactly the limit is in none."""
    c = F.col(change)
    kinds = {"earlier": c > limit, "within": (c > -limit) & (c < limit), "later": c < -limit}
    return table.groupBy(by).agg(*[F.count_if(k & (F.col("label") == y)).alias(f"{n}_{y}") for n, k in kinds.items() for y in (0, 1)])


def tract_report(parcels: DataFrame, table: DataFrame, cols: Sequence[str], by: str = "tract", shares: tuple[str, str] | None = None) -> DataFrame:
    """Means over all parcels of the tract beside the mean shift of its test parcels; shares=(a, b) adds 100 a / (a + b), to one decimal."""
    means = parcels.groupBy(by).agg(F.count("*").alias("n_parcels"), *[F.avg(c).alias(c) for c in cols])
    if shares:
        a, b = (F.col(c) for c in shares)
        means = means.withColumn("percent_share", F.round(F.try_divide(100 * a, a + b), 1))
    return means.join(table.groupBy(by).agg(F.avg("dig_change").alias("mean_shift")), by, "left")


def _mean_ranks(rows: DataFrame, col: str, name: str) -> DataFrame:
    """rows with the mean rank of col within each feature, from running counts of its distinct values."""
    counts = rows.groupBy("feature", col).agg(F.count("*").alias("_c"))
    ranked = with_running(counts, ["feature"], [F.col(col)], ["_c"])
    return rows.join(ranked.select("feature", col, (F.col("cum__c") - (F.col("_c") - 1) / 2).alias(name)), ["feature", col])


def spearman(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, n, rho, t, p): rank correlation of each feature with the target over rows where both are present, its t statistic, and how
    likely one as large is without any relation. All features in one plan; ties share their mean rank."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    rows = df.select(F.explode(pairs).alias("_x"), F.col(target).cast("double").alias("w")).select("_x.*", "w").filter("v IS NOT NULL AND w IS NOT NULL")
    ranked = _mean_ranks(_mean_ranks(held(rows), "v", "_rv"), "w", "_rw")
    out = ranked.groupBy("feature").agg(F.count("*").alias("n"), F.corr("_rv", "_rw").alias("rho"))
    named = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    out = named.join(out, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "rho")
    out = out.withColumn("t", F.col("rho") * F.sqrt(F.try_divide(F.greatest(F.col("n") - 2, F.lit(0)), 1 - F.col("rho") * F.col("rho"))))
    return out.withColumn("p", F.when(F.abs("rho") >= 1, F.lit(0.0)).when(F.col("n") > 2, t_tail(F.col("t"), F.col("n") - 2)))


def worthy_tracts(parcels: DataFrame, by: str = "tract", excluded: Sequence[str] = ()) -> DataFrame:
    return parcels.groupBy(by).agg(F.count("*").alias("n_parcels")).filter((F.col("n_parcels") > 1) & ~F.col(by).isin(list(excluded)))


def max_abs(df: DataFrame, col: str, name: str, floor: float = 0.1) -> DataFrame:
    """|col| over its largest, no less than the floor."""
    top = df.agg(F.max(F.abs(col)).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(name, F.greatest(F.abs(F.col(col)) / F.nullif(F.col("_top"), F.lit(0)), F.lit(floor))).drop("_top")


def band_priority(df: DataFrame, bands: Sequence[tuple[float, float]], tie: Column) -> DataFrame:
    """Per band and tile (tile_id, prob_a, prob_b, label): parcels in the closed band under each model, the tile's priority by that count under each,
    the difference of order, and true minus expected positives under B."""
    lows = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in bands])
    each = df.withColumn("band", F.explode(lows))
    inside = lambda s: F.col(f"prob_{s}").between(F.col("band.lo"), F.col("band.hi"))
    counts = each.groupBy(F.col("band.lo").alias("band_low"), "tile_id").agg(
        F.count_if(inside("a")).alias("n_a"), F.count_if(inside("b")).alias("n_b"), F.coalesce(F.sum(F.when(inside("b"), F.col("label") - F.col("prob_b"))), F.lit(0.0)).alias("true_less_expected")
    )
    order = lambda s: F.row_number().over(Window.partitionBy("band_low").orderBy(F.desc(f"n_{s}"), tie, "tile_id"))
    return counts.withColumn("order_a", order("a")).withColumn("order_b", order("b")).withColumn("order_change", F.col("order_a") - F.col("order_b"))


def tile_moments(tiles: DataFrame, scores: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every tile with mean and deviation of each column over its parcels."""
    found = tiles.join(scores, "pid").groupBy("tile_id").agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), F.stddev(c).alias(f"{c}_std"))])
    return tiles.select("tile_id").distinct().join(found, "tile_id", "left")


def tile_band_counts(df: DataFrame, low: float, high: float) -> DataFrame:
    """Per tile: parcels in the open band under each model, and positives."""
    inside = lambda s: (F.col(f"prob_{s}") > low) & (F.col(f"prob_{s}") < high)
    return df.groupBy("tile_id").agg(F.count_if(inside("a")).alias("n_a"), F.count_if(inside("b")).alias("n_b"), F.sum("label").alias("positives"))


def case_study(near: DataFrame, scores: DataFrame, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Neighbours of one place with their features, scores and labels."""
    return near.join(features.select("pid", *names), "pid").join(scores, "pid", "left")
