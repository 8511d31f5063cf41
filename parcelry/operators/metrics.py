"""Metrics of scores: rates, curves, areas, calibration, confusion. All take grouping columns `by`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import half_even
from .prefix import with_running
from .quantiles import quantiles, with_quantiles


def hit_rate(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Share of positives among rows with prob > threshold; 0 where there are none."""
    over = F.col("prob") > threshold
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.when(over, F.col("label"))) / F.nullif(F.count_if(over), F.lit(0)), F.lit(0.0)).alias("hit_rate"))


def curve_by_threshold(curve: DataFrame, by: Sequence[str] = (), n: int = 500) -> DataFrame:
    """(*by, threshold, pos, hit_rate) for n evenly spaced thresholds from 1 down to 0 without the first: the hit rate at the last
    position with prob > threshold, else at position 0. curve: pos, prob, hit_rate in any order of digging.

    A row counts for all thresholds below its score: it goes to the highest of them, and maxima run down from there.
    """
    keys, step = list(by), F.lit(1.0 / (n - 1))
    near = F.floor(F.col("prob") / step)
    below = lambda k: k * step < F.col("prob")
    top = F.least(F.when(below(near + 1), near + 1).when(below(near), near).otherwise(near - 1), F.lit(n - 2))
    last = curve.withColumn("_k", top).filter("_k >= 0").groupBy(*keys, "_k").agg(F.max(F.struct("pos", "hit_rate")).alias("_last"))
    first = curve.filter("pos = 0").select(*keys, F.struct("pos", "hit_rate").alias("_first"))
    grid = first.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 2))))
    down = Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    found = grid.join(last, [*keys, "_k"], "left").withColumn("_at", F.coalesce(F.max("_last").over(down), F.col("_first")))
    return found.select(*keys, (F.col("_k") * step).alias("threshold"), F.col("_at.pos").alias("pos"), F.col("_at.hit_rate").alias("hit_rate"))


def with_axes(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """curve with the percent of the set dug so far, and the number of positives (the reference line)."""
    totals = curve.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("label").alias("n_positive"))
    joined = curve.join(totals, list(by)) if by else curve.crossJoin(F.broadcast(totals))
    return joined.withColumn("percent", 100 * F.col("pos") / F.col("_n")).drop("_n")


def _distinct_scores(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, "prob").agg(F.sum("label").cast("bigint").alias("_p"), F.count("*").alias("_c"))


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum area under the ROC curve; tied scores share their mean rank; null for a single class."""
    scores = _distinct_scores(df, by)
    ranked = with_running(scores, by, [F.col("prob")], ["_c"])
    mean_rank = F.col("cum__c") - (F.col("_c") - 1) / 2
    sums = ranked.groupBy(*by).agg(F.sum(mean_rank * F.col("_p")).alias("_r"), F.sum("_p").alias("_np"), F.sum(F.col("_c") - F.col("_p")).alias("_nn"))
    area = (F.col("_r") - F.col("_np") * (F.col("_np") + 1) / 2) / F.nullif(F.col("_np") * F.col("_nn"), F.lit(0))
    return sums.select(*by, area.alias("auc"))


def calibration(df: DataFrame, by: Sequence[str] = (), n_bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """(*by, bin, mean_label, mean_prob, n): equal-width bins, or bins between the scores' quantiles; empty bins left out."""
    if strategy == "uniform":
        binned = df.withColumn("bin", F.least(F.floor(F.col("prob") * n_bins), F.lit(n_bins - 1)))
    else:
        joined = with_quantiles(df, quantiles(df, F.col("prob"), [k / n_bins for k in range(1, n_bins)], by, "_cuts"), by)
        binned = joined.withColumn("bin", F.size(F.filter("_cuts", lambda c: c <= F.col("prob"))).cast("bigint"))
    return binned.groupBy(*by, "bin").agg(F.avg("label").alias("mean_label"), F.avg("prob").alias("mean_prob"), F.count("*").alias("n"))


def _ranked_scores(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct scores from the highest, with positives and rows up to each, and all positives; and those alone by group."""
    scores = _distinct_scores(df, by)
    ranked = with_running(scores, by, [F.desc("prob")], ["_p", "_c"])
    totals = ranked.groupBy(*by).agg(F.sum("_p").alias("_all"))
    return (ranked.join(totals, list(by)) if by else ranked.crossJoin(F.broadcast(totals))), totals


def precision_recall(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, threshold, precision, recall) at each distinct score, and the end point (1, 0) with a null threshold."""
    ranked, totals = _ranked_scores(df, by)
    points = ranked.select(*by, F.col("prob").alias("threshold"), (F.col("cum__p") / F.col("cum__c")).alias("precision"), (F.col("cum__p") / F.nullif(F.col("_all"), F.lit(0))).alias("recall"))
    end = totals.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def precision_recall_area(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the precision-recall curve, from the end point (1, 0) on.

    The point before a score's follows from the score's own counts and the sums up to it.
    """
    ranked, _ = _ranked_scores(df, by)
    p0, c0 = F.col("cum__p") - F.col("_p"), F.col("cum__c") - F.col("_c")
    before = F.coalesce(p0 / F.nullif(c0, F.lit(0)), F.lit(1.0))
    step = F.col("_p") / F.nullif(F.col("_all"), F.lit(0)) * (F.col("cum__p") / F.col("cum__c") + before) / 2
    return ranked.groupBy(*by).agg(F.sum(step).alias("area"))


def log_loss(df: DataFrame, by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - eps)), F.lit(eps))
    return df.groupBy(*by).agg(F.avg(-(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))).alias("log_loss"))


def curve_area(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area of hit_rate over positions one apart."""
    ends = F.min_by("hit_rate", "pos") + F.max_by("hit_rate", "pos")
    return curve.groupBy(*by).agg((F.sum("hit_rate") - ends / 2).alias("area"))


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((half_even(F.col("prob")) == F.col("label")).cast("int")).alias("accuracy"))


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    said = half_even(F.col("prob"))
    cell = lambda s, y: F.count_if((said == s) & (F.col("label") == y))
    return df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"))


def right_and_wrong(base: DataFrame, other: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, base_right, n, mean_base, mean_other): rows the base model gets right or wrong, with the other model's score."""
    joined = base.join(other.select(*by, "pid", F.col("prob").alias("_other")), [*by, "pid"])
    flagged = joined.withColumn("base_right", half_even(F.col("prob")) == F.col("label"))
    return flagged.groupBy(*by, "base_right").agg(F.count("*").alias("n"), F.avg("prob").alias("mean_base"), F.avg("_other").alias("mean_other"))


def metric_grid(metric: DataFrame, value: str, resolutions: Sequence[int]) -> DataFrame:
    """Mean over splits: one row per train size, one column res_<resolution>."""
    wide = metric.groupBy("train_size").pivot("resolution", list(resolutions)).avg(value)
    return wide.select("train_size", *[F.col(str(r)).alias(f"res_{r}") for r in resolutions])


def every_model(df: DataFrame, curve, by: Sequence[str] = ("model",), mode: str = "all") -> DataFrame:
    """Curves of several models on one axis; mode 'all' or 'partition' says which curve function is meant."""
    if mode not in ("all", "partition"):
        raise ValueError("mode is 'all' or 'partition'")
    return curve(df, list(by))


def bucketed(col: Column, low: Column, high: Column, n: int) -> Column:
    """Equal-width bin from 0; the last bin is closed."""
    return F.least(F.floor((col - low) / ((high - low) / n)), F.lit(n - 1))
