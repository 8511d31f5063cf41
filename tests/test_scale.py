"""Quantiles, smoothing, diffusion and tuning by their distributed forms against plain ones, and what their plans move."""

import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelry.operators import costs, diffusion
from parcelry.operators.quantiles import quantiles


def plain_quantile(values, p):
    return float(np.percentile(values, 100 * p, method="linear"))


@pytest.mark.parametrize("few,bins", [(10_000, 1024), (7, 4), (1, 3)])
def test_quantiles_of_one_large_group_and_many_small(spark, few, bins):
    rng = random.Random(few)
    rows = [("big", rng.lognormvariate(0, 3)) for _ in range(3000)] + [("ties", rng.choice([1.0, 2.0, 2.0, -0.0])) for _ in range(200)]
    rows += [(f"g{k % 40}", rng.gauss(0, 1)) for k in range(120)] + [("none", None), (None, 5.0), (None, 7.0), ("one", 3.0), ("two", -1.0), ("two", 1e300)]
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles(spark.createDataFrame(rows, "g string, v double"), F.col("v"), probs, ["g"], few=few, bins=bins).collect()}
    assert set(got) == {g for g, _ in rows} and got["none"] is None
    for g in set(got) - {"none"}:
        own = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx([plain_quantile(own, p) for p in probs], rel=1e-12)


def test_quantiles_of_everything(spark):
    values = [float(k % 977) for k in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quantiles(df, F.col("v"), [0.25, 0.5], few=50, bins=8).first()[0] == pytest.approx([plain_quantile(values, p) for p in (0.25, 0.5)])
    assert quantiles(df.limit(0), F.col("v"), [0.5]).first()[0] is None


def test_no_value_map_is_left():
    import pathlib

    import parcelry.operators

    for path in pathlib.Path(parcelry.operators.__file__).parent.glob("*.py"):
        assert not re.search(r"F\.(percentile|median)\(", path.read_text())


def test_lowess_of_many_points(spark):
    n = 200_000
    curve = spark.range(n).select(F.col("id").alias("x"), (F.sin(F.col("id") / 20_000) * 100 + F.pmod(F.col("id") * 7919, F.lit(101)) - 50).alias("y"))
    got = np.array([r[1] for r in costs.lowess(curve, "x", "y", frac=0.05, robust=0).orderBy("x").collect()])
    xs = np.arange(n)
    ys = np.sin(xs / 20_000) * 100 + xs * 7919 % 101 - 50
    k = n // 20
    for i in (0, 3, 4999, 5000, 77_777, n - 6000, n - 1):
        s = min(max(i - k // 2, 0), n - k)
        d = xs[s : s + k] - i
        w = (1 - (np.abs(d) / max(i - s, s + k - 1 - i)) ** 3) ** 3
        a, b, c, p, q = w.sum(), (w * d).sum(), (w * d * d).sum(), (w * ys[s : s + k]).sum(), (w * d * ys[s : s + k]).sum()
        assert got[i] == pytest.approx((p * c - q * b) / (a * c - b * b), abs=1e-6)


def test_lowess_where_robust_weights_leave_few_points(spark):
    """A level stretch before a curve, as of mean costs: beside the bend only the outermost points of a window keep weight, and they are level."""
    curve = spark.range(2400).select(F.col("id").alias("x"), F.when(F.col("id") < 1900, 5000.0).otherwise(5000 + 2000 * (1 - 1900 / F.col("id")) + F.pmod(F.col("id") * 7919, F.lit(13)) / 10).alias("y"))
    got = np.array([r[0] for r in costs.lowess(curve, "x", "y").orderBy("x").select("y_smooth").collect()])
    assert np.abs(got[:1900] - 5000).max() < 1e-7


def graph(rng, n, degree=4):
    return [(i, j, rng.random() + 0.1) for i in range(n) for j in rng.sample(range(max(0, i - 9), min(n, i + 9)), degree) if i != j]


def plain_steps(values, edges, lam, n, freeze=False):
    near = {}
    for i, j, w in edges:
        near.setdefault(i, []).append((j, w))
    for _ in range(n):
        step = {}
        for i, v in values.items():
            known = [(j, w) for j, w in near.get(i, []) if j in values]
            keep = not known or (freeze and v in (0.0, 1.0))
            step[i] = v if keep else lam * v + (1 - lam) * sum(w * values[j] for j, w in known) / sum(w for _, w in known)
        values = step
    return values


@pytest.mark.parametrize("load,places,freeze", [(30, True, False), (30, False, True), (50_000, True, False), (2, False, False), (2, True, True)])
def test_diffusion_in_parts_and_by_joins(spark, load, places, freeze):
    """A load of 2 is below a node's edges, so that steps are joins."""
    rng = random.Random(load)
    n = 120
    edges = graph(rng, n - 5)
    starts = {e: {i: rng.choice([0.0, 1.0, rng.random()]) for i in range(n)} for e in range(20)}
    values = spark.createDataFrame([(e, i, v) for e, own in starts.items() for i, v in own.items()], "e int, pid bigint, v double")
    where = spark.createDataFrame([(i, 43.0 + i / 1000, -83.0 - i / 500) for i in range(n)], "pid bigint, lat double, lon double") if places else None
    got = diffusion.diffuse(values, spark.createDataFrame(edges, "src bigint, dst bigint, w double"), ["e"], lam=0.6, n_iter=3, freeze_certain=freeze, places=where, part_load=load).collect()
    assert len(got) == 20 * n
    want = {e: plain_steps(own, edges, 0.6, 3, freeze) for e, own in starts.items()}
    assert all(r["v"] == pytest.approx(want[r["e"]][r["pid"]], abs=1e-12) for r in got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("parcelry_edges")]


def test_a_step_leaves_edges_where_they_are(spark):
    rng = random.Random(1)
    edges = graph(rng, 200)
    now = spark.createDataFrame([(i, [rng.random()] * 3) for i in range(200)], "pid bigint, v array<double>")
    coefs = diffusion.coefficients(spark.createDataFrame(edges, "src bigint, dst bigint, w double"), now.select("pid"), F.lit(0.5))
    parts = now.select("pid", F.floor(F.col("pid") / 20).alias("part"))
    state = diffusion.write_parts(now, coefs, parts, "parcelry_plan_test")
    try:
        assert state.count() < 2 * 200  # most neighbours share a part
        after = diffusion.part_step(diffusion.part_step(state, spark.table("parcelry_plan_test"), False), spark.table("parcelry_plan_test"), False)
        after.collect()
        plan = after._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Bucketed: true") == 2
        # Each step exchanges the values alone: two exchanges, both of the state's columns.
        found = re.findall(r"Exchange hashpartitioning\(part#\d+L?", plan)
        assert len(found) == 2, plan
    finally:
        spark.sql("DROP TABLE parcelry_plan_test")


def test_tuning_by_powers(spark):
    rng = random.Random(4)
    n = 40
    edges = [(g, i, j, rng.random() * 3, r + 1) for g in ("a", "b") for i in range(n - 3) for r, j in enumerate(rng.sample([x for x in range(n) if x != i], 6))]
    starts = {e: {i: rng.random() for i in range(n)} for e in range(18)}
    values = spark.createDataFrame([(e, i, v) for e, own in starts.items() for i, v in own.items()], "split int, pid bigint, v double")
    weights = {"linear": lambda d: 1 / (1 + d), "flat": lambda d: F.lit(1.0) + 0 * d}
    got = diffusion.tuning_grid(values, spark.createDataFrame(edges, "graph string, src bigint, dst bigint, dist double, rank int"), ["a", "b"], weights, [2, 6], [0.5, 0.9], 3).collect()
    assert len(got) == 2 * 2 * 2 * 2 * 18 * n
    kinds = {"linear": lambda d: 1 / (1 + d), "flat": lambda d: 1.0}
    want = {
        (g, w, k, lam, e): plain_steps(starts[e], [(i, j, f(d)) for gg, i, j, d, r in edges if gg == g and r <= k], lam, 3)
        for g in ("a", "b") for w, f in kinds.items() for k in (2, 6) for lam in (0.5, 0.9) for e in (0, 17)
    }
    for r in got:
        if r["split"] in (0, 17):
            assert r["v"] == pytest.approx(want[r["graph"], r["weight"], r["k"], r["lam"], r["split"]][r["pid"]], abs=1e-12)
    assert statistics.fmean(r["v"] for r in got) > 0


def test_p_values(spark):
    """Two-sided tails as tables of the t distribution print them."""
    from parcelry.functions import t_tail

    table = [(12.706205, 1, 0.05), (2.570582, 5, 0.05), (3.169273, 10, 0.01), (2.042272, 30, 0.05), (0.0, 7, 1.0), (1.983972, 100, 0.05), (-2.570582, 5, 0.05), (1.962339, 1000, 0.05), (6.869, 5, 0.001)]
    rows = spark.createDataFrame(table, "t double, df int, p double").withColumn("got", t_tail(F.col("t"), F.col("df"))).collect()
    assert all(r["got"] == pytest.approx(r["p"], rel=2e-4) for r in rows)


def test_correlations_over_present_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 20)) + 1e6
    x[:, 3] = x[:, 2] * 2
    x[:, 7] = 4.0
    rows = [[None if rng.random() < 0.1 else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(20)))
    from parcelry.operators.explore import correlations

    got = {(r["a"], r["b"]): r["corr"] for r in correlations(df, df.columns).collect()}
    assert len(got) == 190
    for (a, b), value in got.items():
        pairs = [(r[int(a[1:])], r[int(b[1:])]) for r in rows if r[int(a[1:])] is not None and r[int(b[1:])] is not None]
        if "c7" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(float(np.corrcoef(np.array(pairs).T)[0, 1]), abs=1e-9)
