"""B: preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic_unit, beta_score
from ..operators import prepare as p
from ..operators.distance import requests_within
from . import fixtures as fx
from .registry import R, query

PARCEL_COLS = f"pid, {R('lat')}, {R('lon')}, precinct, tract, year_built, {R('bldg_value')}, dangerous"


@query(f"SELECT pid, {R('lat', 'Latitude')}, {R('lon', 'Longitude')}, tract, year_built AS \"Year Built\" FROM parcels")
def b1_rename(spark, d):
    named = p.rename(fx.parcels(spark, d), {"lat": "Latitude", "lon": "Longitude", "year_built": "Year Built"})
    return named.select("pid", "Latitude", "Longitude", "tract", "Year Built")


@query(f"SELECT pid, {R('lat')}, {R('lon')}, tract, year_built, {R('bldg_value')}, dangerous FROM parcels")
def b2_drop(spark, d):
    return p.drop(fx.parcels(spark, d), ["precinct", "no_such_column"])


@query(f"SELECT {PARCEL_COLS} FROM parcels WHERE dangerous IS NOT NULL AND lon IS NOT NULL")
def b3_labelled(spark, d):
    return p.labelled_and_located(fx.parcels(spark, d))


@query(f"SELECT pid, tract, year_built, {R('bldg_value')}, dangerous, {R('lon')}, {R('lat')} FROM parcels WHERE dangerous IS NOT NULL AND lon IS NOT NULL")
def b4_vertical_split(spark, d):
    x, y, place = p.vertical_split(fx.parcels(spark, d), ["dangerous"], ["lon", "lat"], ["precinct"])
    return x.join(y, "pid").join(place, "pid")


@query(f"SELECT pid, {R('lat')}, {R('lon')}, precinct, tract, coalesce(year_built, -1) AS year_built, {R('coalesce(bldg_value, -1)', 'bldg_value')}, coalesce(dangerous, '-1') AS dangerous FROM parcels")
def b5_fill_missing(spark, d):
    return p.fill_missing(fx.parcels(spark, d))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT pid, " + ", ".join(f"(coalesce(dangerous, '-1') = '{v}')::INT AS \"dangerous_{v}\"" for v in ("-1", "0", "1")) + ", " + ", ".join(f"(precinct = {v})::INT AS precinct_{v}" for v in range(25)) + " FROM parcels")
def b6_one_hot(spark, d):
    filled = p.fill_missing(fx.parcels(spark, d).select("pid", "dangerous", "precinct"))
    levels = p.categories(filled, ["dangerous"]) | {"precinct": [str(v) for v in range(25)]}
    return p.one_hot(filled, levels)


@query("SELECT pid, cast(dangerous as int) AS label FROM parcels")
def b7_label_cast(spark, d):
    return fx.parcels(spark, d).select("pid", p.label_int().alias("label"))


@query("SELECT o_orderkey AS place, pid, tract FROM orders JOIN parcels ON pid = o_custkey")
def b8_ordered_lookup(spark, d):
    wanted = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("pid"))
    return p.lookup(fx.parcels(spark, d).select("pid", "tract"), wanted, order="place")


@query(f"""SELECT s.pid, model, s.train_size, s.split, role, {R('prob')}, tile_id, q, r, label, {R('lat')}, {R('lon')}, year_built, {R('bldg_value')}
FROM predictions s JOIN tiles t ON s.pid = t.pid AND s.resolution = t.resolution JOIN labels l ON l.pid = s.pid JOIN parcels c ON c.pid = s.pid WHERE s.train_size = 0.4e0 AND s.resolution = 10 AND split = 1""")
def b10_select_data(spark, d):
    parcels = fx.parcels(spark, d)
    x, place = parcels.select("pid", "year_built", "bldg_value"), parcels.select("pid", "lat", "lon")
    return p.select_data(fx.predictions(spark, d), x, fx.labels(spark, d), place, fx.tiles(spark, d), 0.4, 10, 1).drop("resolution")


@query("SELECT c_custkey AS pid, c_name FROM customer WHERE contains(c_name, '77')")
def b11_contains(spark, d):
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), "c_name").filter(p.contains("c_name", "77"))


@query("SELECT pid, tract FROM parcels WHERE pid IN (SELECT o_custkey FROM orders)")
def b12_semi(spark, d):
    return p.semi(fx.parcels(spark, d).select("pid", "tract"), fx.table(spark, d, "orders").select(F.col("o_custkey").alias("pid")))


@query("SELECT pid, tract FROM parcels WHERE pid NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def b13_anti(spark, d):
    urgent = fx.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return p.anti(fx.parcels(spark, d).select("pid", "tract"), urgent.select(F.col("o_custkey").alias("pid")))


@query("SELECT pid, year_built FROM parcels WHERE year_built > 1900 AND year_built < 1930")
def b14_open_band(spark, d):
    return fx.parcels(spark, d).select("pid", "year_built").filter(p.open_band("year_built", 1900, 1930))


@query("SELECT pid, year_built FROM parcels WHERE year_built BETWEEN 1900 AND 1930")
def b15_closed_band(spark, d):
    return fx.parcels(spark, d).select("pid", "year_built").filter(p.closed_band("year_built", 1900, 1930))


@query("""SELECT src, n_dst, '/table/v1/foot/' || own || ';' || far || '?sources=0' AS request FROM (
  SELECT src, count(*) AS n_dst, string_agg(printf('%.6f,%.6f', p.lon, p.lat), ';' ORDER BY dst) AS far FROM edges JOIN parcels p ON p.pid = dst GROUP BY src)
  JOIN (SELECT pid, printf('%.6f,%.6f', lon, lat) AS own FROM parcels) o ON o.pid = src""")
def b16_route_requests(spark, d):
    return requests_within(fx.parcels(spark, d), fx.limit_km(spark, d))


@query(f"SELECT pid, {R('radians(lat)', 'lat_rad')}, {R('radians(lon)', 'lon_rad')} FROM parcels")
def b17_radians(spark, d):
    return fx.parcels(spark, d).select("pid", F.radians("lat").alias("lat_rad"), F.radians("lon").alias("lon_rad"))


@query(f"""SELECT s.train_size, s.resolution, s.split, s.role, s.pid, {R('(lat - m_lat) / s_lat', 'lat')}, {R('(lon - m_lon) / s_lon', 'lon')} FROM splits s JOIN parcels p USING (pid) JOIN (
  SELECT train_size, resolution, split, avg(lat) AS m_lat, stddev_pop(lat) AS s_lat, avg(lon) AS m_lon, stddev_pop(lon) AS s_lon FROM splits JOIN parcels USING (pid) WHERE role = 'train' GROUP BY ALL) USING (train_size, resolution, split)""")
def b18_standardise(spark, d):
    rows = fx.splits(spark, d).join(fx.parcels(spark, d).select("pid", "lat", "lon"), "pid").select("train_size", "resolution", "split", "role", "pid", "lat", "lon")
    return p.standardise(rows, ["lat", "lon"], ["train_size", "resolution", "split"])


@query(f"SELECT pid, {R('1 - prob', 'p0')}, {R('prob', 'p1')} FROM scored")
def b19_class_pair(spark, d):
    pair = fx.scored(spark, d).select("pid", p.class_pair().alias("pair"))
    return pair.select("pid", F.col("pair")[0].alias("p0"), F.col("pair")[1].alias("p1"))


@query(f"SELECT pid, {R('prob', 'positive')} FROM scored")
def b20_positive_class(spark, d):
    return fx.scored(spark, d).select("pid", p.class_pair().alias("pair")).select("pid", p.positive_class("pair").alias("positive"))


@query(f"""SELECT model, train_size, resolution, split, role, pid, {R('prob / top', 'prob')} FROM predictions JOIN (
  SELECT model, train_size, resolution, split, max(prob) AS top FROM predictions WHERE role = 'train' GROUP BY ALL) USING (model, train_size, resolution, split)""")
def b21_over_train_max(spark, d):
    return p.over_train_max(fx.predictions(spark, d), "prob", ["model", "train_size", "resolution", "split"])


@query(f"SELECT src, dst, {R('dist')}, {R('CASE WHEN 1/(1+dist) = 1 THEN 0 ELSE 1/(1+dist) END', 'w')} FROM (SELECT src, dst, CASE WHEN (src+dst) % 11 = 0 THEN 1e5 WHEN (src+dst) % 13 = 0 THEN 0e0 ELSE seconds END AS dist FROM durations) WHERE dist < 1e5")
def b22_recode(spark, d):
    asked = fx.durations(spark, d).selectExpr("src", "dst", "CASE WHEN (src+dst) % 11 = 0 THEN 1e5 WHEN (src+dst) % 13 = 0 THEN 0e0 ELSE seconds END AS dist")
    return p.recode_distances(asked)


@query(f"SELECT pid, {R('prob')}, year_built, {R('bldg_value')} FROM scored JOIN parcels USING (pid)")
def b23_features(spark, d):
    return p.feature_table(fx.scored(spark, d).select("pid", "prob"), fx.parcels(spark, d), ["year_built", "bldg_value"])


@query(f"""SELECT p.pid, coalesce(role, 'none') AS role, {R('prob')}, label FROM parcels p
LEFT JOIN (SELECT * FROM predictions WHERE model = 'a' AND train_size = 0.1e0 AND resolution = 10 AND split = 0) s ON s.pid = p.pid LEFT JOIN labels l ON l.pid = p.pid""")
def b24_node_table(spark, d):
    one = fx.predictions(spark, d).filter("model = 'a' AND train_size = 0.1e0 AND resolution = 10 AND split = 0").select("pid", "role", "prob")
    return p.node_table(fx.parcels(spark, d), one, fx.labels(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey FROM lineitem")
def b25_columns_like(spark, d):
    rows = fx.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", *[c for c in p.columns_like(rows, "_s")])


@query("SELECT count(*) AS n_rows, count(DISTINCT pid) AS n_keys, count(*) = count(DISTINCT pid) AS is_unique FROM scores_big")
def b26_uniqueness(spark, d):
    return p.uniqueness(fx.scores_big(spark, d))


@query("SELECT pid, tract FROM parcels ORDER BY (pid*7919 + 42*97) % 1000003, pid LIMIT 100")
def b27_row_sample(spark, d):
    return p.row_sample(fx.parcels(spark, d).select("pid", "tract"), 100, order=F.expr("(pid*7919 + 42*97) % 1000003"))


def unit_sql(seed: int, key: str = "pid") -> str:
    x = f"(({key}*7919 + {seed}*104729 + 4074) % 1000003)"
    return f"((((({x}*{x}) % 1000003) * (({x}*{x}) % 1000003)) % 1000003) * {x}) % 1000003 / 1000003e0"


@query(f"""SELECT pid, tract, draw FROM (SELECT pid, tract, row_number() OVER (ORDER BY pid) AS place FROM parcels)
JOIN (SELECT k AS draw, floor({unit_sql(5, 'k')} * (SELECT count(*) FROM parcels))::BIGINT + 1 AS place FROM range(500) r(k)) USING (place)""")
def b27_resample(spark, d):
    """500 rows with replacement."""
    return p.resample(fx.parcels(spark, d).select("pid", "tract"), 500, seed=5, unit=arithmetic_unit)


@query(f"SELECT model, train_size, resolution, split, role, pid, {R('prob')} FROM predictions")
def b28_union(spark, d):
    rows = fx.predictions(spark, d)
    return rows.filter("role = 'train'").unionByName(rows.filter("role = 'test'"))


@query(f"""SELECT pid, {R('u', 'flat')}, {R('greatest(least(u, v), least(greatest(u, v), w))', 'middle')}, {R('pow(sin(3.141592653589793e0*u/2), 2)', 'ends')}
FROM (SELECT pid, {unit_sql(3)} AS u, {unit_sql(4)} AS v, {unit_sql(5)} AS w FROM parcels)""")
def b29_random_scores(spark, d):
    rows = fx.parcels(spark, d).select("pid")
    return rows.select("pid", *[beta_score(k, 3, F.col("pid"), unit=arithmetic_unit).alias(k) for k in ("flat", "middle", "ends")])
