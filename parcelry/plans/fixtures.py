"""Parcel tables derived from the driver's tables, as DataFrames and as the same definitions in SQL for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.distance import radius_join
from ..operators.splits import spatial_splits
from ..operators.tiling import hexagons

RESOLUTIONS, TENTHS, SPLITS = [5, 10], [1, 4], 3

PARCELS = [
    "cast(c_custkey as bigint) AS pid",
    "42.97e0 + ((c_custkey*7919) % 10007) * 0.12e0 / 10007 AS lat",
    "-83.75e0 + ((c_custkey*6101) % 10009) * 0.13e0 / 10009 AS lon",
    "c_nationkey AS precinct",
    "c_mktsegment AS tract",
    "CASE WHEN c_custkey % 97 = 5 THEN NULL ELSE cast(1890 + (c_custkey*37) % 110 as bigint) END AS year_built",
    "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bldg_value",
    "CASE WHEN c_custkey % 50 = 49 THEN NULL WHEN (c_custkey*7) % 100 < 60 - ((c_custkey*37) % 110)*0.5e0 THEN '1' ELSE '0' END AS dangerous",
]
OLD = "(CASE WHEN (pid*37) % 110 < 40 THEN 1 ELSE 0 END)"
PREDS = [
    "pid",
    "cast(dangerous as int) AS label",
    f"0.05e0 + 0.55e0*((pid*7177+1) % 1009)/1009 + 0.25e0*cast(dangerous as int) + 0.1e0*{OLD} AS prob_a",
    f"0.05e0 + 0.45e0*((pid*4099+3) % 1013)/1013 + 0.40e0*cast(dangerous as int) + 0.05e0*{OLD} AS prob_b",
]
BIG = [
    "cast(o_orderkey as bigint) AS pid",
    "42.97e0 + ((o_orderkey*7919) % 100003) * 0.36e0 / 100003 AS lat",
    "-83.75e0 + ((o_orderkey*6101) % 100019) * 0.39e0 / 100019 AS lon",
]
SCORES = [
    "l_orderkey*10 + l_linenumber AS pid",
    "l_partkey",
    "l_suppkey",
    "cast(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END as int) AS label",
    "((l_partkey*31 + l_suppkey) % 9973)/9973e0 AS prob",
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parcels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(*PARCELS)


def preds(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).filter("dangerous IS NOT NULL").selectExpr(*PREDS)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """pid, label, prob of model a."""
    return preds(spark, d).select("pid", "label", F.col("prob_a").alias("prob"))


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return hexagons(parcels(spark, d), RESOLUTIONS)


def tiles10(spark: SparkSession, d: str) -> DataFrame:
    return hexagons(parcels(spark, d), [10])


def splits(spark: SparkSession, d: str) -> DataFrame:
    return spatial_splits(tiles(spark, d), TENTHS, SPLITS)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Both models' scores in every experiment, a little apart between splits."""
    both = preds(spark, d).select("pid", F.explode(F.create_map(F.lit("a"), F.col("prob_a"), F.lit("b"), F.col("prob_b"))).alias("model", "_p"))
    prob = F.col("_p") + F.expr("((pid + 13*split) % 7) * 0.001e0")
    return splits(spark, d).join(both, "pid").select("model", "train_size", "resolution", "split", "role", "pid", prob.alias("prob"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return preds(spark, d).select("pid", "label")


def limit_km(spark: SparkSession, d: str) -> float:
    """The radius of a neighbourhood: 2 km where a city has fewer than 1,000 parcels, else 0.5."""
    return 2.0 if parcels(spark, d).count() < 1000 else 0.5


def edges(spark: SparkSession, d: str) -> DataFrame:
    return radius_join(parcels(spark, d), limit_km(spark, d))


def durations(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).selectExpr("src", "dst", "dist_km/0.0013e0 * (1 + ((src+dst) % 7)/10e0) AS seconds")


def seconds(src, dst, dist_km):
    """The travel time of durations, of arrays."""
    return dist_km / 0.0013 * (1 + ((src + dst) % 7) / 10.0)


def parcels_big(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*BIG)


def scores_big(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*SCORES)


EMBEDDED = 64


def features(spark: SparkSession, d: str, n: int = EMBEDDED) -> DataFrame:
    """pid, label, f0 ... f63 of the embeddings; one row in four is test, one in four calibration."""
    role = F.when(F.col("vec_id") % 4 == 0, "test").when(F.col("vec_id") % 4 == 1, "calibration").otherwise("train")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("pid"), (F.col("label") < 3).cast("int").alias("label"), role.alias("role"), *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(n)]
    )


def _hex_sql(res: list[int], source: str = "parcels") -> str:
    return f"""
  SELECT pid, resolution, q, r, (q + resolution + 2) * (4*resolution + 8) + (r + resolution + 2) AS tile_id FROM (
    SELECT pid, resolution,
      cast(CASE WHEN dq > dr AND dq > dz THEN -r0 - z0 ELSE q0 END as bigint) AS q,
      cast(CASE WHEN NOT (dq > dr AND dq > dz) AND dr > dz THEN -q0 - z0 ELSE r0 END as bigint) AS r FROM (
      SELECT *, abs(q0 - fq) AS dq, abs(r0 - fr) AS dr, abs(z0 - fz) AS dz FROM (
        SELECT *, floor(fq + 0.5e0) AS q0, floor(fr + 0.5e0) AS r0, floor(fz + 0.5e0) AS z0 FROM (
          SELECT pid, resolution, fq, fr, -fq - fr AS fz FROM (
            SELECT pid, resolution, (sqrt(3e0)/3e0 * x - y/3e0) / s AS fq, (2e0/3e0 * y) / s AS fr FROM (
              SELECT pid, resolution, x, y, w / sqrt(3e0) AS s FROM proj_{source} ) ) ) ) ) )"""


def _proj_sql(res: list[int], source: str) -> str:
    values = ", ".join(f"({r}::BIGINT)" for r in res)
    return f"""
  SELECT p.pid, v.resolution, (p.lon - b.min_lon) * b.k AS x, p.lat - b.min_lat AS y, greatest((b.max_lon - b.min_lon) * b.k, b.max_lat - b.min_lat) / v.resolution AS w
  FROM {source} p, (SELECT *, cos(radians((min_lat + max_lat) / 2)) AS k FROM (SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM {source})) b,
       (VALUES {values}) v(resolution)"""


HAVERSINE = "2 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat))/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(b.lon) - radians(a.lon))/2), 2))) * 6371"
#: The same tables as common table expressions, and what each needs.
CTES: dict[str, str] = {
    "parcels": f"SELECT {', '.join(PARCELS)} FROM customer",
    "preds": f"SELECT {', '.join(PREDS)} FROM parcels WHERE dangerous IS NOT NULL",
    "scored": "SELECT pid, label, prob_a AS prob FROM preds",
    "labels": "SELECT pid, label FROM preds",
    "proj_parcels": _proj_sql(RESOLUTIONS, "parcels"),
    "tiles": _hex_sql(RESOLUTIONS),
    "tiles10": "SELECT * FROM tiles WHERE resolution = 10",
    "splits": f"""
  SELECT t.train_size, t.resolution, t.split, p.pid, t.role FROM tiles p JOIN (
    SELECT tenths / 10e0 AS train_size, resolution, split, tile_id,
      CASE WHEN row_number() OVER (PARTITION BY tenths, resolution, split ORDER BY (tile_id*7919 + split*104729 + 42*97) % 1000003, tile_id)
             <= ((10 - tenths) * count(*) OVER (PARTITION BY tenths, resolution, split) + 9) // 10 THEN 'test' ELSE 'train' END AS role
    FROM (SELECT DISTINCT resolution, tile_id FROM tiles), (VALUES {', '.join(f'({t}::BIGINT)' for t in TENTHS)}) a(tenths), (VALUES {', '.join(f'({s}::BIGINT)' for s in range(SPLITS))}) c(split)
  ) t ON t.resolution = p.resolution AND t.tile_id = p.tile_id""",
    "predictions": """
  SELECT m.model, s.train_size, s.resolution, s.split, s.role, s.pid, m.p + ((s.pid + 13*s.split) % 7) * 0.001e0 AS prob
  FROM splits s JOIN (SELECT pid, 'a' AS model, prob_a AS p FROM preds UNION ALL SELECT pid, 'b', prob_b FROM preds) m ON s.pid = m.pid""",
    "radius": "SELECT CASE WHEN count(*) < 1000 THEN 2e0 ELSE 0.5e0 END AS limit_km FROM parcels",
    "edges": f"SELECT src, dst, dist_km FROM (SELECT a.pid AS src, b.pid AS dst, {HAVERSINE} AS dist_km FROM parcels a JOIN parcels b ON a.pid <> b.pid AND abs(a.lat - b.lat) < 0.02e0), radius WHERE dist_km < limit_km",
    "durations": "SELECT src, dst, dist_km/0.0013e0 * (1 + ((src+dst) % 7)/10e0) AS seconds FROM edges",
    "parcels_big": f"SELECT {', '.join(BIG)} FROM orders",
    "scores_big": f"SELECT {', '.join(SCORES)} FROM lineitem",
    "test_a": "SELECT p.*, l.label, t.tile_id FROM predictions p JOIN labels l USING (pid) JOIN tiles t ON t.resolution = p.resolution AND t.pid = p.pid WHERE role = 'test'",
}


def thresholds(init: float = 0.9, step: float = 0.1) -> list[float]:
    out, at = [], init
    while at > 0:
        out.append(at)
        at -= step
    return [*out, at]


def campaign_sql(source: str, by: list[str]) -> str:
    """The campaign with min_digs 1, in SQL: sweep, visit sizes and ranks in plain windows. source: pid, tile_id, prob, label, *by."""
    ts = thresholds()
    sweep = "CASE " + " ".join(f"WHEN prob > {t!r}::DOUBLE THEN {k}" for k, t in enumerate(ts)) + " END"
    named = "CASE sweep " + " ".join(f"WHEN {k} THEN {t!r}::DOUBLE" for k, t in enumerate(ts)) + " END"
    keys = "".join(f"{b}, " for b in by)
    over = f"PARTITION BY {', '.join(by)} " if by else ""
    order = f"({over}ORDER BY sweep, n DESC, tile_id, prob DESC, pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
  SELECT {keys}pid, tile_id, prob, label, dense_rank() OVER ({over}ORDER BY sweep, n DESC, tile_id) - 1 AS dig_batch, {named} AS dig_threshold,
    row_number() OVER {order} - 1 AS dig_index, sum(label) OVER {order} / (row_number() OVER {order})::DOUBLE AS hit_rate
  FROM (SELECT *, count(*) OVER (PARTITION BY {keys}sweep, tile_id) AS n FROM (SELECT {keys}pid, tile_id, prob, label, {sweep} AS sweep FROM ({source})))"""


CTES["campaign_a"] = campaign_sql("SELECT s.pid, t.tile_id, s.prob, s.label FROM scored s JOIN tiles10 t ON s.pid = t.pid", [])
CTES["campaign_b"] = campaign_sql("SELECT s.pid, t.tile_id, s.prob_b AS prob, s.label FROM preds s JOIN tiles10 t ON s.pid = t.pid", [])
CTES["campaigns"] = campaign_sql("SELECT model, train_size, resolution, split, pid, tile_id, prob, label FROM test_a", ["model", "train_size", "resolution", "split"])
CTES["curves"] = """
  SELECT *, cost / lead_digs AS cost_avg FROM (SELECT model, train_size, resolution, split, lead_digs, digs, prob_thres, lead_digs*5000e0 + (digs - lead_digs)*3000e0 AS cost FROM (
    SELECT model, train_size, resolution, split, lead_digs, min(dig_index) + 1 AS digs, min(dig_threshold) AS prob_thres
    FROM (SELECT *, sum(label) OVER (PARTITION BY model, train_size, resolution, split ORDER BY dig_index) AS lead_digs FROM campaigns) GROUP BY ALL) WHERE lead_digs > 0)"""
CTES["savings"] = """
  SELECT s.*, b.cost - s.cost AS savings, b.cost_avg - s.cost_avg AS savings_avg FROM curves s JOIN curves b USING (train_size, resolution, split, lead_digs) WHERE s.model = 'b' AND b.model = 'a'"""
CTES["pooled"] = """
  SELECT model, train_size, resolution, lead_digs, avg(cost) AS cost, avg(cost_avg) AS cost_avg, avg(savings) AS savings, avg(savings_avg) AS savings_avg
  FROM savings JOIN (SELECT model, train_size, resolution, min(m) AS most FROM (SELECT model, train_size, resolution, split, max(lead_digs) AS m FROM savings GROUP BY ALL) GROUP BY ALL) USING (model, train_size, resolution)
  WHERE lead_digs <= most GROUP BY ALL"""
CTES["compared"] = """
  SELECT a.pid, a.tile_id, a.label, a.prob AS prob_a, a.dig_index AS dig_a, b.prob AS prob_b, b.dig_index AS dig_b, b.prob - a.prob AS prob_change, a.dig_index - b.dig_index AS dig_change, p.tract
  FROM campaign_a a JOIN campaign_b b USING (pid) JOIN parcels p USING (pid)"""


def sql(body: str) -> str:
    """body with the tables it names as common table expressions before it."""
    needed: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(CTES[name])
                needed.append(name)

    need(body)
    lead = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), "")
    own, body = ",\n" if lead else "", body.removeprefix(lead)
    ahead = (lead or "WITH ") + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in needed)
    return ahead + (own or "\n") + body if needed else lead + body


Query = Callable[[SparkSession, str], DataFrame]
