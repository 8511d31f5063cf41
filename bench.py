"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions import hash_unit, inverse_weight
from parcelry.operators import costs, diffusion, distance, metrics, splits, tiling
from parcelry.plans import fixtures as fx

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TENTHS, RESOLUTIONS, SPLITS = [1, 3, 4, 6, 7, 9], [5, 10, 22, 47, 99], 3
EX = ["model", "train_size", "resolution", "split"]


def build_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Tiles and splits of the whole grid: 6 train sizes, 5 resolutions, 3 splits, over the large parcel table."""
    return splits.spatial_splits(tiling.hexagons(fx.parcels_big(spark, d), RESOLUTIONS), TENTHS, SPLITS)


def campaign_costs(spark: SparkSession, d: str) -> DataFrame:
    """Campaign order, cost curves and savings of 2 models in 30 experiments of 3 splits."""
    tiles = tiling.hexagons(fx.parcels(spark, d), RESOLUTIONS)
    both = fx.preds(spark, d).select("pid", F.explode(F.create_map(F.lit("a"), F.col("prob_a"), F.lit("b"), F.col("prob_b"))).alias("model", "prob"))
    predictions = splits.spatial_splits(tiles, TENTHS, SPLITS).join(both, "pid")
    return costs.compute_costs(predictions, fx.labels(spark, d), tiles, "a", ["b"])


def big_edges(spark: SparkSession, d: str) -> DataFrame:
    return distance.nearest(distance.radius_join(fx.parcels_big(spark, d), 0.5), 10)


def diffusion_grid(spark: SparkSession, d: str) -> DataFrame:
    """10 steps over the 10 nearest neighbours, 90 experiments packed."""
    parcels = fx.parcels_big(spark, d).select("pid")
    values = parcels.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(89)))).select("e", "pid", hash_unit(1, F.col("pid"), F.col("e")).alias("v"))
    edges = distance.weighted(big_edges(spark, d), inverse_weight).select("src", "dst", "w")
    return diffusion.diffuse(values, edges, ["e"], lam=0.6, n_iter=10, places=fx.parcels_big(spark, d))


def score_metrics(spark: SparkSession, d: str) -> DataFrame:
    """ROC AUC, precision-recall area and calibration of the large score table."""
    rows = fx.scores_big(spark, d)
    one = metrics.roc_auc(rows).select(F.lit("auc").alias("what"), F.col("auc").alias("value"))
    two = metrics.precision_recall_area(rows).select(F.lit("pr"), "area")
    return one.union(two).union(metrics.calibration(rows).select(F.concat(F.lit("bin"), F.col("bin")), "mean_label"))


JOBS = {"build_datasets": build_datasets, "campaign_costs": campaign_costs, "radius_knn": big_edges, "diffusion_grid": diffusion_grid, "score_metrics": score_metrics}


def main() -> None:
    shared = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.local.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = dict(JOBS)
    try:
        from parcelry.llm.queries import QUERIES

        jobs |= QUERIES
    except ImportError:
        pass
    only = os.environ.get("BENCH_ONLY")
    took = {}
    for name, job in jobs.items():
        if only and name not in only.split(","):
            continue
        start = time.time()
        job(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 2)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
