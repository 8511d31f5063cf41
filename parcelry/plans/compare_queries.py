"""G: comparison and impact; H: exploration; I: model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaign as c
from ..operators import compare, explore, models
from ..operators.distance import near_one
from . import fixtures as fx
from .campaign_queries import joined
from .registry import R, query


def compared(spark, d):
    place = fx.parcels(spark, d).select("pid", "tract")
    return compare.comparison(c.campaign(joined(spark, d)), c.campaign(joined(spark, d, "b")), place)


TABLE = f"pid, tile_id, label, {R('prob_a')}, dig_a, {R('prob_b')}, dig_b, {R('prob_change')}, dig_change, tract"


@query(f"SELECT {TABLE} FROM compared")
def g1_comparison(spark, d):
    return compared(spark, d)


@query("""SELECT pid, tile_id, a AS tile_rank_a, b AS tile_rank_b, a - b AS tile_change, n AS tile_size FROM (SELECT pid, tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY dig_a) - 1 AS a,
row_number() OVER (PARTITION BY tile_id ORDER BY dig_b) - 1 AS b, count(*) OVER (PARTITION BY tile_id) AS n FROM compared)""")
def g2_within_tile(spark, d):
    return compare.within_tile(compared(spark, d)).select("pid", "tile_id", "tile_rank_a", "tile_rank_b", "tile_change", "tile_size")


@query(f"SELECT label, {R('avg(prob_a)', 'prob_a')}, {R('avg(prob_b)', 'prob_b')}, {R('avg(dig_change)', 'dig_change')} FROM compared GROUP BY label")
def g3_summary(spark, d):
    return compare.mean_by(compared(spark, d), "label", ["prob_a", "prob_b", "dig_change"])


HIST = "(SELECT label, dig_change, lo, hi, n, least(floor((dig_change - lo) / ((hi - lo) / {b}e0)), {b} - 1)::BIGINT AS bin FROM (SELECT *, (min(dig_change) OVER g)::DOUBLE AS lo, (max(dig_change) OVER g)::DOUBLE AS hi, count(*) OVER g AS n FROM compared WINDOW g AS ({g})))"


@query(f"SELECT label, bin, {R('lo + bin*((hi - lo)/20e0)', 'low')}, count(*) AS n, {R('count(*)::DOUBLE / any_value(h.n)', 'value')} FROM {HIST.format(b=20, g='PARTITION BY label')} h GROUP BY label, bin, lo, hi")
def g4_histogram(spark, d):
    return compare.histogram(compared(spark, d), "dig_change", 20, ["label"])


@query(f"SELECT bin, {R('lo + bin*((hi - lo)/500e0)', 'low')}, count(*) AS n, {R('count(*)::DOUBLE / any_value(h.n) / ((hi - lo)/500e0)', 'value')} FROM {HIST.format(b=500, g='')} h GROUP BY bin, lo, hi")
def g4_density(spark, d):
    return compare.histogram(compared(spark, d), "dig_change", 500, kind="density")


@query(f"SELECT label, {R('avg(dig_change)', 'mean_shift')}, {R('quantile_cont(dig_change, 0.5)', 'median_shift')} FROM compared GROUP BY label")
def g5_shift(spark, d):
    return compare.shift_summary(compared(spark, d))


@query("SELECT label, count(*) FILTER (WHERE dig_change > 0) AS earlier, count(*) FILTER (WHERE dig_change < 0) AS later, count(*) FILTER (WHERE dig_change = 0) AS same FROM compared GROUP BY label")
def g6_directions(spark, d):
    return compare.directions(compared(spark, d))


BUCKETS = ", ".join(f"count(*) FILTER (WHERE {cond} AND label = {y}) AS {n}_{y}" for n, cond in (("earlier", "dig_change > 250"), ("within", "dig_change > -250 AND dig_change < 250"), ("later", "dig_change < -250")) for y in (0, 1))


@query(f"SELECT tract, {BUCKETS} FROM compared GROUP BY tract")
def g7_tract_buckets(spark, d):
    return compare.tract_buckets(compared(spark, d))


@query(f"""SELECT tract, n_parcels, {R('yb', 'year_built')}, {R('bv', 'bldg_value')}, (round(100*yb/(yb+bv), 1) + 0e0) AS percent_share, {R('s', 'mean_shift')} FROM (SELECT tract, count(*) AS n_parcels, avg(year_built) AS yb, avg(bldg_value) AS bv FROM parcels GROUP BY tract)
LEFT JOIN (SELECT tract, avg(dig_change) AS s FROM compared GROUP BY tract) USING (tract)""")
def g8_tract_report(spark, d):
    return compare.tract_report(fx.parcels(spark, d), compared(spark, d), ["year_built", "bldg_value"], shares=("year_built", "bldg_value"))


PRECINCT = "(SELECT precinct, avg(year_built) AS year_built, avg(bldg_value) AS bldg_value, avg(dig_change) AS shift FROM parcels LEFT JOIN compared USING (pid) GROUP BY precinct)"


def rho_sql(f: str) -> str:
    rank = lambda col: f"rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1)/2e0"
    return f"SELECT '{f}' AS feature, count(*) AS n, corr(a, b) AS rho FROM (SELECT {rank(f)} AS a, {rank('shift')} AS b FROM {PRECINCT} WHERE {f} IS NOT NULL AND shift IS NOT NULL)"


@query(f"SELECT feature, n, {R('rho')}, {R('rho * sqrt((n - 2) / (1 - rho*rho))', 't')} FROM ({rho_sql('year_built')} UNION ALL {rho_sql('bldg_value')})")
def g9_spearman(spark, d):
    rows = fx.parcels(spark, d).join(compared(spark, d).select("pid", "dig_change"), "pid", "left")
    means = rows.groupBy("precinct").agg(F.avg("year_built").alias("year_built"), F.avg("bldg_value").alias("bldg_value"), F.avg("dig_change").alias("shift"))
    return compare.spearman(means, ["year_built", "bldg_value"], "shift").drop("p")


@query("SELECT precinct::VARCHAR AS precinct, count(*) AS n_parcels FROM parcels WHERE precinct <> 7 GROUP BY precinct HAVING count(*) > 1")
def g10_worthy_tracts(spark, d):
    return compare.worthy_tracts(fx.parcels(spark, d).withColumn("precinct", F.col("precinct").cast("string")), "precinct", ["7"])


@query(f"SELECT pid, dig_change, {R('greatest(abs(dig_change)::DOUBLE / (max(abs(dig_change)) OVER ()), 0.1e0)', 'scaled')} FROM compared")
def g11_max_abs(spark, d):
    return compare.max_abs(compared(spark, d).select("pid", "dig_change"), "dig_change", "scaled")


TIE = "(tile_id*7919 + 42) % 1000003"


@query(f"""SELECT band_low, tile_id, n_a, n_b, {R('tle', 'true_less_expected')}, oa AS order_a, ob AS order_b, oa - ob AS order_change FROM (SELECT *, row_number() OVER (PARTITION BY band_low ORDER BY n_a DESC, {TIE}, tile_id) AS oa, row_number() OVER (PARTITION BY band_low ORDER BY n_b DESC, {TIE}, tile_id) AS ob FROM (
SELECT lo AS band_low, tile_id, count(*) FILTER (WHERE prob_a BETWEEN lo AND hi) AS n_a, count(*) FILTER (WHERE prob_b BETWEEN lo AND hi) AS n_b, coalesce(sum(label - prob_b) FILTER (WHERE prob_b BETWEEN lo AND hi), 0) AS tle
FROM preds JOIN tiles10 USING (pid), (VALUES (0.1e0, 0.2e0), (0.4e0, 0.5e0), (0.8e0, 0.9e0)) v(lo, hi) GROUP BY ALL))""")
def g12_band_priority(spark, d):
    rows = fx.preds(spark, d).join(fx.tiles10(spark, d).select("pid", "tile_id"), "pid")
    return compare.band_priority(rows, [(0.1, 0.2), (0.4, 0.5), (0.8, 0.9)], F.expr(TIE))


@query(f"SELECT tile_id, {R('avg(prob_a)', 'prob_a_mean')}, {R('stddev(prob_a)', 'prob_a_std')}, {R('avg(label)', 'label_mean')}, {R('stddev(label)', 'label_std')} FROM tiles10 LEFT JOIN preds USING (pid) GROUP BY tile_id")
def g13_tile_moments(spark, d):
    return compare.tile_moments(fx.tiles10(spark, d).select("pid", "tile_id"), fx.preds(spark, d), ["prob_a", "label"])


@query("SELECT tile_id, count(*) FILTER (WHERE prob_a > 0.3e0 AND prob_a < 0.7e0) AS n_a, count(*) FILTER (WHERE prob_b > 0.3e0 AND prob_b < 0.7e0) AS n_b, sum(label)::BIGINT AS positives FROM preds JOIN tiles10 USING (pid) GROUP BY tile_id")
def g14_tile_band_counts(spark, d):
    return compare.tile_band_counts(fx.preds(spark, d).join(fx.tiles10(spark, d).select("pid", "tile_id"), "pid"), 0.3, 0.7)


@query(f"SELECT p.pid, {R('dist_km')}, year_built, {R('bldg_value')}, label, {R('prob_a')}, {R('prob_b')} FROM (SELECT a.pid, a.year_built, a.bldg_value, {fx.HAVERSINE} AS dist_km FROM parcels a, (SELECT lat, lon FROM parcels WHERE pid = 77) b) p LEFT JOIN preds USING (pid) WHERE dist_km < 1.5e0")
def g15_case_study(spark, d):
    points = fx.parcels(spark, d)
    near = near_one(points.select("pid", "lat", "lon"), points.filter("pid = 77"), 1.5).select("pid", "dist_km")
    return compare.case_study(near, fx.preds(spark, d), points, ["year_built", "bldg_value"])


@query("SELECT * FROM (VALUES ('pid'), ('lat'), ('lon'), ('precinct'), ('tract'), ('year_built'), ('bldg_value'), ('dangerous')) v(\"column\") JOIN LATERAL (SELECT count(*) FILTER (WHERE CASE \"column\" WHEN 'year_built' THEN year_built IS NULL WHEN 'bldg_value' THEN bldg_value IS NULL WHEN 'dangerous' THEN dangerous IS NULL ELSE false END) AS n_missing FROM parcels) ON true")
def h1_missing(spark, d):
    return explore.missing(fx.parcels(spark, d))


@query("SELECT year_built, count(*) AS n FROM parcels WHERE year_built IS NOT NULL AND tract = 'BUILDING' GROUP BY year_built")
def h2_value_counts(spark, d):
    return explore.value_counts(fx.parcels(spark, d).filter("tract = 'BUILDING'"), "year_built")


def describe_sql(col: str) -> str:
    q = lambda p: f"quantile_cont({col}, {p})"
    return f"SELECT '{col}' AS \"column\", count({col}) AS \"count\", {R(f'avg({col})', 'mean')}, {R(f'stddev({col})', 'std')}, {R(f'min({col})', 'min')}, {R(f'max({col})', 'max')}, {R(q(0.25), 'q25')}, {R(q(0.5), 'q50')}, {R(q(0.75), 'q75')} FROM parcels WHERE year_built > 1930"


@query(f"{describe_sql('lat')} UNION ALL {describe_sql('year_built')} UNION ALL {describe_sql('bldg_value')}")
def h3_describe(spark, d):
    return explore.describe(fx.parcels(spark, d).filter("year_built > 1930"), ["lat", "year_built", "bldg_value"])


@query(f"SELECT sum(label)::BIGINT AS n_positive, {R('avg(label)', 'rate')} FROM scores_big")
def h4_class_rate(spark, d):
    return explore.class_rate(fx.scores_big(spark, d))


@query(f"SELECT {R('avg(label) FILTER (WHERE year_built > 1890 AND year_built < 1930)', 'old')}, {R('avg(label) FILTER (WHERE year_built > 1945 AND year_built < 1960)', 'middle')} FROM parcels JOIN labels USING (pid)")
def h5_rate_in_band(spark, d):
    rows = fx.parcels(spark, d).join(fx.labels(spark, d), "pid")
    y = F.col("year_built")
    return explore.rate_in(rows, {"old": (y > 1890) & (y < 1930), "middle": (y > 1945) & (y < 1960)})


@query(f"SELECT tract, sum(label)::BIGINT AS n_positive, {R('avg(label)', 'rate')} FROM parcels JOIN labels USING (pid) GROUP BY tract")
def h6_rate_by_category(spark, d):
    return explore.class_rate(fx.parcels(spark, d).join(fx.labels(spark, d), "pid"), by=["tract"])


@query(f"SELECT bin, {R('lo + bin*((hi - lo)/20e0)', 'low')}, count(*) AS n, count(*)::DOUBLE AS value FROM (SELECT lo, hi, least(floor((bldg_value - lo)/((hi - lo)/20e0)), 19)::BIGINT AS bin FROM (SELECT bldg_value, min(bldg_value) OVER () AS lo, max(bldg_value) OVER () AS hi FROM parcels WHERE bldg_value IS NOT NULL)) GROUP BY bin, lo, hi")
def h7_histogram(spark, d):
    return compare.histogram(fx.parcels(spark, d), "bldg_value", 20, kind="count")


PAIRS = [("lat", "lon"), ("lat", "year_built"), ("lat", "bldg_value"), ("lon", "year_built"), ("lon", "bldg_value"), ("year_built", "bldg_value")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})', 'corr')} FROM parcels" for a, b in PAIRS))
def h8_correlations(spark, d):
    return explore.correlations(fx.parcels(spark, d), ["lat", "lon", "year_built", "bldg_value"])


@query(f"""WITH v AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT 'f' || a.k AS a, 'f' || b.k AS b, {R('corr(a.x, b.x)', 'corr')} FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY a.k, b.k""")
def h8_all_correlations(spark, d):
    """Every pair of the 64 columns."""
    return explore.correlations(fx.features(spark, d), [f"f{k}" for k in range(fx.EMBEDDED)])


@query(f"SELECT label, {R('avg(lat)', 'lat')}, {R('avg(year_built)', 'year_built')}, {R('avg(bldg_value)', 'bldg_value')} FROM parcels JOIN labels USING (pid) GROUP BY label")
def h9_group_means(spark, d):
    return compare.mean_by(fx.parcels(spark, d).join(fx.labels(spark, d), "pid"), "label", ["lat", "year_built", "bldg_value"])


@query("SELECT resolution, max(n) AS largest FROM (SELECT resolution, tile_id, count(*) AS n FROM tiles GROUP BY ALL) GROUP BY resolution")
def h10_largest_tile(spark, d):
    return explore.largest_tile(fx.tiles(spark, d))


@query("SELECT count(*) AS n_rows, 8 AS n_columns FROM parcels")
def h11_shape(spark, d):
    return explore.shape(fx.parcels(spark, d))


ALL = [f"f{k}" for k in range(fx.EMBEDDED)]
PARCEL_FEATURES = ["year_built", "bldg_value", "lat"]


def parcel_features(spark, d):
    filled = fx.parcels(spark, d).select("pid", F.coalesce("year_built", F.lit(-1)).alias("year_built"), F.coalesce("bldg_value", F.lit(-1.0)).alias("bldg_value"), "lat", "lon")
    return filled.join(fx.labels(spark, d), "pid")


@query()
def i1_boosted_trees(spark, d):
    """One fit for each train size, tile resolution and split; scores of both roles, in the columns of predictions."""
    return models.per_experiment(fx.splits(spark, d), parcel_features(spark, d), PARCEL_FEATURES, models.boosted_trees(), "trees")


@query()
def i2_regularisation(spark, d):
    """Mean over the three splits of one train size and resolution, which are this path's parameters."""
    some = fx.splits(spark, d).filter("train_size = 0.4e0 AND resolution = 10").select("split", "pid", "role")
    return models.regularisation_path(some.join(parcel_features(spark, d), "pid"), PARCEL_FEATURES)


@query()
def i2_regularisation_grid(spark, d):
    """The path of every train size and resolution, all its fits together."""
    rows = fx.splits(spark, d).join(parcel_features(spark, d), "pid")
    return models.regularisation_path(rows, PARCEL_FEATURES, by=models.KEY, cell=["train_size", "resolution"])


@query()
def i3_importance(spark, d):
    model, _ = models.fit_and_score(fx.features(spark, d), ALL, models.boosted_trees())
    return models.importance(model, ALL, spark)


@query("SELECT pid, coalesce((year_built <= 1935)::INT::DOUBLE, 0) AS prob FROM parcels")
def i4_one_rule(spark, d):
    return models.one_rule(fx.parcels(spark, d))


@query()
def i5_logistic(spark, d):
    one = models.logistic_scores(fx.features(spark, d), ["f0"]).withColumn("features_used", F.lit(1))
    return one.unionByName(models.logistic_scores(fx.features(spark, d), ALL, penalty=1.0).withColumn("features_used", F.lit(fx.EMBEDDED)))


@query(f"""WITH RECURSIVE t AS MATERIALIZED (SELECT embedding[1]::DOUBLE AS x, (label < 3)::INT::DOUBLE AS y FROM embeddings WHERE vec_id % 4 >= 2),
fit AS (SELECT 0 AS k, 0e0 AS a, 0e0 AS b UNION ALL
  SELECT k + 1, a + (hxx*g - hx*gx)/(h*hxx - hx*hx), b + (h*gx - hx*g)/(h*hxx - hx*hx) FROM (
    SELECT k, a, b, sum(y - q) AS g, sum((y - q)*x) AS gx, sum(q*(1 - q)) AS h, sum(q*(1 - q)*x) AS hx, sum(q*(1 - q)*x*x) AS hxx
    FROM (SELECT k, a, b, x, y, 1/(1 + exp(-a - b*x)) AS q FROM fit, t WHERE k < 15) GROUP BY k, a, b))
SELECT vec_id AS pid, CASE vec_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'calibration' ELSE 'train' END AS role, (label < 3)::INT AS label, {R('1/(1 + exp(-a - b*embedding[1]::DOUBLE))', 'prob')} FROM embeddings, fit WHERE k = 15""")
def i5_one_feature(spark, d):
    """SQL takes fifteen Newton steps of its own."""
    return models.logistic_scores(fx.features(spark, d).select("pid", "role", "label", "f0"), ["f0"])


@query()
def i6_decision_tree(spark, d):
    return models.fit_and_score(fx.features(spark, d), ["f0"], models.tree())[1]


@query()
def i7_spatial_model(spark, d):
    """Features and place, one fit for each train size, tile resolution and split."""
    return models.per_experiment(fx.splits(spark, d), parcel_features(spark, d), ["year_built", "lat", "lon"], models.boosted_trees(), "spatial")


@query()
def i8_calibration(spark, d):
    return models.calibrated(models.fit_and_score(fx.features(spark, d), ALL, models.boosted_trees())[1])


def _minor(i: int, j: int) -> str:
    """Cofactor of the symmetric matrix h00 .. h22."""
    (a, b), (c, e) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    h = lambda r, q: f"h{min(r, q)}{max(r, q)}"
    return f"{'-' if (i + j) % 2 else ''}({h(a, c)}*{h(b, e)} - {h(a, e)}*{h(b, c)})"


_DET = " + ".join(f"h0{j}*({_minor(0, j)})" for j in range(3))
_STEPS = ", ".join(f"w{i} + ({' + '.join(f'({_minor(i, j)})*g{j}' for j in range(3))})/({_DET}) AS w{i}" for i in range(3))
_GRADIENT = ", ".join(f"sum((y - q)*x{i}){f' - w{i}' if i < 2 else ''} AS g{i}" for i in range(3))
_SECOND = ", ".join(f"sum(q*(1 - q)*x{i}*x{j}){' + 1' if i == j < 2 else ''} AS h{i}{j}" for i in range(3) for j in range(i, 3))


@query(f"""WITH RECURSIVE wide AS MATERIALIZED (SELECT train_size, resolution, split, pid, role, label, max(prob) FILTER (WHERE model = 'a') AS x0, max(prob) FILTER (WHERE model = 'b') AS x1, 1e0 AS x2 FROM predictions JOIN labels USING (pid) GROUP BY ALL),
one AS (SELECT train_size, resolution, split, min(label) AS low, max(label) AS high FROM wide WHERE role = 'train' GROUP BY ALL),
t AS MATERIALIZED (SELECT train_size, resolution, split, label::DOUBLE AS y, x0, x1, x2 FROM wide JOIN one USING (train_size, resolution, split) WHERE role = 'train' AND low < high),
fit AS (SELECT DISTINCT train_size, resolution, split, 0 AS k, 0e0 AS w0, 0e0 AS w1, 0e0 AS w2 FROM t UNION ALL
  SELECT train_size, resolution, split, k + 1, {_STEPS} FROM (
    SELECT train_size, resolution, split, k, w0, w1, w2, {_GRADIENT}, {_SECOND}
    FROM (SELECT t.*, k, w0, w1, w2, 1/(1 + exp(-w0*x0 - w1*x1 - w2)) AS q FROM fit JOIN t USING (train_size, resolution, split) WHERE k < 15) GROUP BY train_size, resolution, split, k, w0, w1, w2))
SELECT train_size, resolution, split, pid, role, label, {R('CASE WHEN low = high THEN low::DOUBLE ELSE 1/(1 + exp(-w0*x0 - w1*x1 - w2)) END', 'prob')}, {R('w0', 'coef_a')}, {R('w1', 'coef_b')}, {R('w2', 'coef_intercept')}
FROM wide JOIN one USING (train_size, resolution, split) LEFT JOIN (SELECT * FROM fit WHERE k = 15) USING (train_size, resolution, split)""")
def i9_stacking(spark, d):
    """Both models' scores stacked in every experiment, with its coefficients beside each score."""
    scores, coefficients = models.stacked(fx.predictions(spark, d), fx.labels(spark, d), ["a", "b"])
    named = coefficients.groupBy(*models.KEY).pivot("term", ["a", "b", "intercept"]).agg(F.first("coefficient")).withColumnsRenamed({"a": "coef_a", "b": "coef_b", "intercept": "coef_intercept"})
    return scores.join(F.broadcast(named), models.KEY, "left")
