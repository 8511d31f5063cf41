"""Costs of campaigns: per cumulative hit, savings against a baseline, pooling over splits, smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import held
from .campaign import campaign
from .smooth import lowess

__all__ = ["add_savings", "chosen_predictions", "compute_costs", "cost_curve", "dig_data", "lowess", "pooled", "zoomed"]

EXPERIMENT = ["train_size", "resolution", "split"]
HIT_COST, MISS_COST = 5000.0, 3000.0


def chosen_predictions(predictions: DataFrame, models: Sequence[str], role: str = "test") -> DataFrame:
    return predictions.filter(F.col("model").isin(list(models)) & (F.col("role") == role))


def dig_data(predictions: DataFrame, labels: DataFrame, tiles: DataFrame, by: Sequence[str] = ("model", *EXPERIMENT), threshold_init: float = 0.9) -> DataFrame:
    """The campaign of every model and experiment in one job."""
    on = ["resolution", "pid"] if "resolution" in tiles.columns else ["pid"]
    rows = predictions.join(labels, "pid").join(tiles.select(*on, "tile_id"), on)
    return campaign(rows.select(*by, "pid", "tile_id", "prob", "label"), by, threshold_init=threshold_init)


def cost_curve(dug: DataFrame, by: Sequence[str] = (), hit_cost: float = HIT_COST, miss_cost: float = MISS_COST) -> DataFrame:
    """(*by, lead_digs, digs, prob_thres, cost, cost_avg): for each number of hits the first dig that reaches it and the
    lowest sweep threshold until the next hit. dug has dig_index, dig_threshold and hit_rate, which times the digs counts the hits."""
    hits = F.round(F.col("hit_rate") * (F.col("dig_index") + 1)).cast("bigint")
    per = dug.withColumn("lead_digs", hits).groupBy(*by, "lead_digs").agg((F.min("dig_index") + 1).alias("digs"), F.min("dig_threshold").alias("prob_thres")).filter("lead_digs > 0")
    cost = F.col("lead_digs") * hit_cost + (F.col("digs") - F.col("lead_digs")) * miss_cost
    return per.withColumn("cost", cost).withColumn("cost_avg", F.col("cost") / F.col("lead_digs"))


def add_savings(curves: DataFrame, baseline: str, by: Sequence[str] = EXPERIMENT) -> DataFrame:
    """Curves of the other models with what they save against the baseline at the same number of hits."""
    base = curves.filter(F.col("model") == baseline).select(*by, "lead_digs", F.col("cost").alias("_c"), F.col("cost_avg").alias("_a"))
    joined = curves.filter(F.col("model") != baseline).join(base, [*by, "lead_digs"])
    return joined.withColumn("savings", F.col("_c") - F.col("cost")).withColumn("savings_avg", F.col("_a") - F.col("cost_avg")).drop("_c", "_a")


def pooled(curves: DataFrame, values: Sequence[str], by: Sequence[str] = ("model", "train_size", "resolution")) -> DataFrame:
    """Means over splits at equal hits, up to the hits that every split reaches."""
    most = curves.groupBy(*by, "split").agg(F.max("lead_digs").alias("_m")).groupBy(*by).agg(F.min("_m").alias("_most"))
    return curves.join(most, list(by)).filter("lead_digs <= _most").groupBy(*by, "lead_digs").agg(*[F.avg(v).alias(v) for v in values])


def compute_costs(predictions: DataFrame, labels: DataFrame, tiles: DataFrame, baseline: str, models: Sequence[str]) -> DataFrame:
    """Pooled costs and savings of the models over the whole grid."""
    dug = dig_data(chosen_predictions(predictions, [baseline, *models]), labels, tiles)
    curves = held(cost_curve(dug, ["model", *EXPERIMENT]))
    return pooled(add_savings(curves, baseline), ["cost", "cost_avg", "savings", "savings_avg"])


def zoomed(curve: DataFrame, by: Sequence[str] = (), zoom: float = 0.9, x: str = "lead_digs") -> DataFrame:
    """The first `zoom` of the points, with percent_x = 100 x / n."""
    totals = curve.groupBy(*by).agg(F.count("*").alias("_n"))
    joined = curve.join(totals, list(by)) if by else curve.crossJoin(F.broadcast(totals))
    return joined.filter(F.col(x) <= F.floor(F.lit(zoom) * F.col("_n"))).withColumn("percent_x", 100 * F.col(x) / F.col("_n")).drop("_n")
