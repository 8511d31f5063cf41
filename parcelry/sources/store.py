"""Sources and sinks: parcel tables, splits, predictions, tilings, edges, results, routing answers."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPERIMENT = ["train_size", "resolution"]
#: Columns as the stores write them, partition columns last, so that a store without rows reads as an empty table.
PREDICTIONS = "split int, role string, pid bigint, prob double, model string, train_size double, resolution int"
EDGES = "src bigint, dst bigint, dist_km double"
PARCEL_TILES = "pid bigint, q bigint, r bigint, tile_id bigint, resolution int"
TILES = "resolution int, tile_id bigint, n_parcels bigint, cx double, cy double, area_km2 double, wkt string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """df written to the shared folder and read back, so that several uses share one computation.

    by: columns of numbers whose values have folders of their own, so that a filter on them reads these alone.
    """
    path = scratch(df.sparkSession, "held")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV with header, JSON lines or ORC; geometry is a WKT column. CSV and JSON need a schema."""
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind in ("csv", "json"):
        raise ValueError(f"{kind} needs a schema")
    return reader.options(header=True).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), mode: str = "errorifexists") -> str:
    writer = df.write.format(kind).mode(mode).options(header=True)
    (writer.partitionBy(*by) if by else writer).save(path)
    return path


def save_splits(splits: DataFrame, path: str) -> str:
    return write_table(splits, path, by=EXPERIMENT)


def load_splits(spark: SparkSession, path: str, train_size: float | None = None, resolution: int | None = None) -> DataFrame:
    """Splits, or one experiment's: a filter on partition columns reads only its folders."""
    schema = "split int, pid bigint, role string, train_size double, resolution int"
    out = spark.read.schema(schema).parquet(path)
    if train_size is not None:
        out = out.filter(F.col("train_size") == train_size)
    if resolution is not None:
        out = out.filter(F.col("resolution") == resolution)
    return out.select("train_size", "resolution", "split", "pid", "role")


def save_predictions(predictions: DataFrame, path: str, by: Sequence[str] = (*EXPERIMENT, "split")) -> str:
    """Predictions in a folder for each model and experiment. A run that is made again replaces its own folders and no others."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", *by).parquet(path)
    return path


def load_predictions(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """All predictions, or one model's folders."""
    out = spark.read.schema(PREDICTIONS).parquet(path)
    return out.filter(F.col("model") == model) if model else out


def save_tiling(tiles: DataFrame, table: DataFrame, params: Mapping, path: str) -> str:
    """parcel_tiles, tiles and the parameters that rebuild them."""
    write_table(tiles, f"{path}/parcel_tiles", by=["resolution"])
    write_table(table, f"{path}/tiles")
    tiles.sparkSession.range(1).select(F.lit(json.dumps(params)).alias("value")).write.text(f"{path}/params")
    return path


def load_tiling(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.schema(PARCEL_TILES).parquet(f"{path}/parcel_tiles"), spark.read.schema(TILES).parquet(f"{path}/tiles"), json.loads(spark.read.text(f"{path}/params").first()["value"])


def save_edges(edges: DataFrame, path: str, limit_km: float) -> str:
    """Edges together by source, with the limit of the radius beside them."""
    edges.repartition("src").sortWithinPartitions("src", "dst").write.parquet(f"{path}/edges")
    edges.sparkSession.range(1).select(F.lit(float(limit_km)).alias("limit_km")).write.parquet(f"{path}/limit")
    return path


def load_edges(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    return spark.read.schema(EDGES).parquet(f"{path}/edges"), spark.read.parquet(f"{path}/limit").first()["limit_km"]


def save_role_edges(edges: DataFrame, splits: DataFrame, path: str) -> str:
    """Edges of each experiment whose ends have one role, by role."""
    ends = splits.select("train_size", "resolution", "split", "role", "pid")
    src, dst = ends.withColumnRenamed("pid", "src"), ends.withColumnRenamed("pid", "dst")
    both = edges.join(src, "src").join(dst, ["train_size", "resolution", "split", "role", "dst"])
    return write_table(both, path, by=[*EXPERIMENT, "role"])


def load_role_edges(spark: SparkSession, path: str, role: str) -> DataFrame:
    """One role's edges: a filter on a partition column."""
    return spark.read.schema(f"{EDGES}, split int, train_size double, resolution int, role string").parquet(path).filter(F.col("role") == role)


def merge_shards(spark: SparkSession, paths: Sequence[str], schema: str = PREDICTIONS) -> DataFrame:
    """Prediction files with equal columns, in any column order, read as one table."""
    return spark.read.schema(schema).parquet(*paths)
