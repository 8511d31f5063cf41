"""Invariants and edge cases of the other operators."""

import math

import pytest
from pyspark.sql import functions as F

from parcelry.functions import inverse_weight
from parcelry.operators import compare, costs, diffusion, distance, explore, metrics, models, prepare, splits, tiling
from parcelry.operators.prefix import with_running
from parcelry.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"


def haversine(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    return 2 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2)) * 6371


@pytest.fixture(scope="module")
def points(spark):
    return fx.parcels(spark, DATA)


def test_radius_join_is_brute_force(spark, points):
    at = {r["pid"]: (r["lat"], r["lon"]) for r in points.collect()}
    want = {(a, b) for a in at for b in at if a != b and haversine(at[a], at[b]) < 2}
    got = {(r["src"], r["dst"]) for r in distance.radius_join(points, 2.0).collect()}
    assert got == want and want


def test_nearest_any_finds_k_everywhere(spark, points):
    at = {r["pid"]: (r["lat"], r["lon"]) for r in points.limit(40).collect()}
    few = spark.createDataFrame([(p, *x) for p, x in at.items()] + [(10**6, 44.5, -80.0)], "pid bigint, lat double, lon double")
    at[10**6] = (44.5, -80.0)
    got = {}
    for r in distance.nearest_any(few, 3, start_km=0.5).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for p in at:
        want = sorted((haversine(at[p], at[q]), q) for q in at if q != p)[:3]
        assert [d for _, d in sorted(got[p])] == [q for _, q in want]


def test_colocated_parcels_are_neighbours_unless_dropped(spark):
    edges = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.4), (1, 1, 0.0)], "src bigint, dst bigint, dist_km double")
    assert [r["dst"] for r in distance.nearest(edges, 1).collect()] == [2]
    assert [r["dst"] for r in distance.nearest(edges, 1, drop_zero=True).collect()] == [3]


def values(spark, v):
    return spark.createDataFrame([(0, k, x) for k, x in enumerate(v)], "e int, pid bigint, v double")


def test_diffusion_rules(spark):
    edges = distance.weighted(spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0), (1, 0, 0.0)], "src bigint, dst bigint, dist_km double"), inverse_weight)
    start = values(spark, [0.2, 1.0, 0.5, 0.7])
    run = lambda **o: [r["v"] for r in diffusion.diffuse(start, edges, ["e"], **o).orderBy("pid").collect()]
    assert run(lam=1.0, n_iter=3) == [0.2, 1.0, 0.5, 0.7]
    assert run(lam=0.5) == pytest.approx([0.5 * 0.2 + 0.5 * (1.0 + 0.25) / 1.5, 0.6, 0.5, 0.7])
    assert run(lam=0.5, freeze_certain=True)[1] == 1.0
    assert all(0.2 - 1e-12 <= v <= 1.0 + 1e-12 for v in run(lam=0.3, n_iter=6))
    trace = diffusion.diffuse(start, edges, ["e"], n_iter=2, trace=True)
    assert sorted(r["iter"] for r in trace.select("iter").distinct().collect()) == [0, 1, 2]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_a_step_adds_a_constant_to_the_plan(spark):
    edges = distance.weighted(spark.createDataFrame([(0, 1, 0.1), (1, 2, 1.0), (2, 0, 0.0)], "src bigint, dst bigint, dist_km double"), inverse_weight)
    start = values(spark, [0.2, 1.0, 0.5])
    counts = [exchanges(diffusion.diffuse(start, edges, ["e"], n_iter=n)) for n in (1, 2, 3, 4)]
    assert counts[3] - counts[2] == counts[2] - counts[1] == counts[1] - counts[0] <= 3


def test_diffusion_needs_every_value(spark):
    edges = distance.weighted(spark.createDataFrame([(0, 1, 0.1)], "src bigint, dst bigint, dist_km double"), inverse_weight)
    with pytest.raises(ValueError):
        diffusion.diffuse(spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2), (1, 0, 0.3)], "e int, pid bigint, v double"), edges, ["e"])


def test_best_cells_by_table(spark):
    grid = spark.createDataFrame([("g", 5, 0.5, 0.30, 10.0), ("g", 10, 0.5, 0.3001, 11.0), ("g", 10, 0.9, 0.31, 9.0), ("h", 5, 0.5, 0.50, 1.0)], "graph string, k int, lam double, log_loss double, auhrc double")
    got = {(r["graph"], r["k"], r["lam"]): (r["best_loss"], r["best_area"]) for r in diffusion.best_cells(grid, ["graph"]).collect()}
    assert got == {("g", 5, 0.5): (True, False), ("g", 10, 0.5): (True, True), ("h", 5, 0.5): (True, True)}
    wide = {(r["graph"], r["lam"]): (r["log_loss_5"], r["log_loss_10"]) for r in diffusion.laid_out(grid, ["graph"], [5, 10]).collect()}
    assert wide == {("g", 0.5): (0.30, 0.3001), ("g", 0.9): (None, 0.31), ("h", 0.5): (0.50, None)}


def test_initial_values(spark):
    preds = spark.createDataFrame([(0, 1, "train", 0.9, 1), (0, 2, "test", 0.2, 0), (0, 3, "test", 0.4, 0)], "e int, pid bigint, role string, prob double, label int")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "pid bigint")
    get = lambda i: {r["pid"]: r["v"] for r in diffusion.initial_values(nodes, preds, ["e"], i).collect()}
    assert get("prediction") == pytest.approx({1: 0.9, 2: 0.2, 3: 0.4, 4: 0.3})
    assert get("label")[1] == 1.0


def test_splits_are_disjoint_and_whole(spark, points):
    tiles = tiling.hexagons(points, [5])
    out = splits.spatial_splits(tiles, [3], 2).join(tiles.select("pid", "tile_id"), "pid")
    assert out.groupBy("split", "tile_id").agg(F.countDistinct("role").alias("n")).filter("n > 1").count() == 0
    assert out.count() == 2 * points.count()
    n = tiles.select("tile_id").distinct().count()
    for r in out.filter("role = 'test'").groupBy("split").agg(F.countDistinct("tile_id").alias("n")).collect():
        assert r["n"] == math.ceil(0.7 * n)


def test_running_sums_equal_the_plain_window(spark):
    rows = [(k, (k * 7919 % 97) / 97, k % 2) for k in range(300)]
    got = with_running(spark.createDataFrame(rows, "pid bigint, prob double, label int"), [], [F.desc("prob"), F.col("pid")], ["label"]).collect()
    want, total = {}, 0
    for pos, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += r[2]
        want[r[0]] = (pos, total)
    assert {r["pid"]: (r["pos"], r["cum_label"]) for r in got} == want


def test_running_sums_of_equal_scores_spread_over_tasks(spark):
    """Scores of 0 and 1 alone: ids tell the rows apart, and no range holds all rows of a score."""
    df = spark.range(40_000).selectExpr("id AS pid", "cast(id % 2 AS double) AS prob", "cast(id % 3 = 0 AS int) AS label").repartition(4)
    out = with_running(df, [], [F.desc("prob"), F.col("pid")], ["label"]).cache()
    assert out.selectExpr("count(distinct pos)", "min(pos)", "max(pos)").first()[:] == (40_000, 1, 40_000)
    last = out.filter("pid = 39998").first()
    assert last["pos"] == 40_000 and last["cum_label"] == df.filter("label = 1").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        dealt = df.repartitionByRange(F.desc("prob"), F.col("pid")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in dealt) < 20_000


def scored(spark, rows):
    return spark.createDataFrame([(k, float(p), y) for k, (p, y) in enumerate(rows)], "pid bigint, prob double, label int")


def test_metrics_on_ties_and_single_class(spark):
    tied = scored(spark, [(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 1)])
    assert metrics.roc_auc(tied).first()["auc"] == 0.5
    assert metrics.hit_rate(tied).first()["hit_rate"] == 0.0
    assert metrics.accuracy(tied).first()["accuracy"] == 0.5
    assert metrics.roc_auc(scored(spark, [(0.1, 1), (0.2, 1)])).first()["auc"] is None
    assert metrics.precision_recall_area(scored(spark, [(0.9, 1), (0.1, 0)])).first()["area"] == pytest.approx(1.0)
    assert metrics.log_loss(scored(spark, [(1.0, 1), (0.0, 0)])).first()["log_loss"] == pytest.approx(0, abs=1e-12)


def test_calibration_closes_the_last_bin(spark):
    got = {r["bin"]: r["n"] for r in metrics.calibration(scored(spark, [(0.0, 0), (0.95, 1), (1.0, 1)])).collect()}
    assert got == {0: 1, 9: 2}


def test_mode_is_checked(spark):
    with pytest.raises(ValueError):
        metrics.every_model(None, None, mode="some")


def test_bucket_edges(spark):
    table = spark.createDataFrame([("t", 250, 1), ("t", -250, 0), ("t", 251, 1), ("t", 0, 0)], "tract string, dig_change bigint, label int")
    assert compare.tract_buckets(table).first().asDict() == {"tract": "t", "earlier_0": 0, "earlier_1": 1, "within_0": 1, "within_1": 0, "later_0": 0, "later_1": 0}


def test_missing_category_and_unseen_level(spark):
    df = prepare.fill_missing(spark.createDataFrame([(1, "a"), (2, None)], "pid bigint, c string"))
    hot = prepare.one_hot(df, prepare.categories(df, ["c"]))
    assert hot.columns == ["pid", "c_-1", "c_a"]
    assert prepare.one_hot(spark.createDataFrame([(3, "z")], "pid bigint, c string"), {"c": ["-1", "a"]}).first()[1:] == (0, 0)


def test_random_scores_have_their_shape(spark):
    rows = spark.range(20000).withColumnRenamed("id", "pid")
    for kind, variance in (("flat", 1 / 12), ("middle", 1 / 20), ("ends", 1 / 8)):
        got = prepare.random_scores(rows, kind).agg(F.avg("prob"), F.var_pop("prob")).first()
        assert got[0] == pytest.approx(0.5, abs=0.01) and got[1] == pytest.approx(variance, rel=0.05)


def test_lowess_keeps_a_line(spark):
    line = spark.createDataFrame([(k, 3.0 * k + 1) for k in range(1, 81)], "x bigint, y double")
    assert all(abs(r["y_smooth"] - (3.0 * r["x"] + 1)) < 1e-6 for r in costs.lowess(line, "x", "y", frac=0.1).collect())


def plain_lowess(ys, frac, rounds=3):
    """Written from the published method: local lines, tricube weights, bisquare weights of residuals."""
    n = len(ys)
    k = min(n, max(2, int(frac * n + 1e-10)))
    robust, fit = [1.0] * n, [0.0] * n
    for turn in range(rounds + 1):
        left = 0
        for i in range(n):
            while left + k < n and i > (left + left + k) / 2:
                left += 1
            js = range(left, left + k)
            radius = max(i - left, left + k - 1 - i)
            w = [(1 - (abs(j - i) / radius) ** 3) ** 3 * robust[j] for j in js]
            total = sum(w)
            if total <= 0:
                fit[i] = ys[i]
                continue
            mean = sum(a * j for a, j in zip(w, js)) / total
            spread = sum(a * (j - mean) ** 2 for a, j in zip(w, js)) / total
            tilt = [a / total * (1 + ((i - mean) * (j - mean) / spread if spread > 1e-12 else 0)) for a, j in zip(w, js)]
            fit[i] = sum(a * ys[j] for a, j in zip(tilt, js))
        off = [abs(a - b) for a, b in zip(ys, fit)]
        middle = (sorted(off)[n // 2] + sorted(off)[(n - 1) // 2]) / 2
        robust = [(1 - min(1.0, o / (6 * middle)) ** 2) ** 2 for o in off]
    return fit


def test_lowess_is_the_published_one(spark):
    ys = [math.sin(k / 9) + (5.0 if k in (20, 41) else 0.1 * ((k * 7919 % 13) / 13)) for k in range(70)]
    rows = spark.createDataFrame([(k + 1, y) for k, y in enumerate(ys)], "x bigint, y double")
    got = [r["y_smooth"] for r in costs.lowess(rows, "x", "y", frac=0.15).orderBy("x").collect()]
    assert got == pytest.approx(plain_lowess(ys, 0.15), abs=1e-9)


def test_spearman_of_a_monotone_pair(spark):
    df = spark.createDataFrame([(float(k), float(k**3), None if k == 3 else -float(k)) for k in range(8)], "a double, b double, c double")
    got = {r["feature"]: (r["n"], r["rho"]) for r in compare.spearman(df, ["b", "c"], "a").collect()}
    assert got["b"] == (8, pytest.approx(1.0)) and got["c"] == (7, pytest.approx(-1.0))


def test_sampling_and_columns(spark, points):
    assert prepare.row_sample(points, 20).count() == 20
    assert prepare.resample(points, 50).count() == 50
    assert prepare.columns_like(points, "la") == ["lat"]
    assert explore.shape(points).first()["n_columns"] == 8


def test_feature_table_modes(spark):
    p = spark.createDataFrame([(1, 0.5)], "pid bigint, prob double")
    x = spark.createDataFrame([(1, 2, 3)], "pid bigint, f int, g int")
    assert prepare.feature_table(p, x).columns == ["pid", "prob"]
    assert prepare.feature_table(p, x, "All").columns == ["pid", "prob", "f", "g"]
    assert prepare.feature_table(p, x, ["g"]).columns == ["pid", "prob", "g"]


def test_models_give_probabilities(spark):
    df = fx.features(spark, DATA)
    _, out = models.fit_and_score(df, ["f0", "f1"], models.logistic_estimator())
    assert out.filter("prob < 0 OR prob > 1").count() == 0 and out.count() == df.count()


def test_fits_by_experiment(spark):
    """Two splits: one with both classes, one whose train rows have one class, which is then every score."""
    rows = [(s, k, "train" if k % 2 else "test", int(k % 3 == 0 or s == 1), float(k % 3), k / 40) for s in (0, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "split int, pid bigint, role string, label int, x double, y double")
    out = models.per_experiment(df.select("split", "pid", "role"), df.filter("split = 0").select("pid", "label", "x", "y"), ["x"], models.logistic_estimator(), "m", ["split"])
    assert out.count() == 80 and out.filter("prob < 0 OR prob > 1").count() == 0
    path = models.regularisation_path(df, ["x", "y"], (0, 10), ("l2",)).collect()
    assert {(r["penalty"], r["strength"]) for r in path} == {("l2", 0.0), ("l2", 10.0)} and all(r["log_loss"] >= 0 for r in path)
    scores = df.select("split", "pid", "role", F.explode(F.create_map(F.lit("a"), F.col("x") / 3, F.lit("b"), F.col("y"))).alias("model", "prob"))
    labels = df.filter("split = 0").select("pid", "label")
    stacked, terms = models.stacked(scores, labels, ["a", "b"], ["split"])
    assert stacked.count() == 80 and sorted((r["split"], r["term"]) for r in terms.collect()) == [(s, t) for s in (0, 1) for t in ("a", "b", "intercept")]
    c = {r["term"]: r["coefficient"] for r in terms.filter("split = 0").collect()}
    for r in stacked.filter("split = 0").collect():
        x, y = r["pid"] % 3 / 3, r["pid"] / 40
        assert r["prob"] == pytest.approx(1 / (1 + math.exp(-(c["intercept"] + c["a"] * x + c["b"] * y))), abs=1e-9)


def test_travel_times_by_a_function(spark):
    pairs = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")

    def clock(batches):
        for b in batches:
            yield b.assign(seconds=60.0)

    assert distance.travel_times(pairs, fn=clock).first()["seconds"] == 60.0
