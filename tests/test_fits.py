"""Fits of many experiments together or side by side, samples with replacement, neighbours of hubs, stores written again."""

import math
import random
import re

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from parcelry.operators import distance, logistic, models, prepare
from parcelry.sources import store


def made(spark, n_experiments, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for s in range(n_experiments):
        for k in range(n):
            x, y = rng.gauss(50, 10 + s), rng.gauss(0, 0.1)
            rows.append((s, k, "train" if k % 3 else "test", int(rng.random() < 1 / (1 + math.exp(-(x - 50) / 10 - 8 * y + s / 2))), x, y, 3.0))
    return spark.createDataFrame(rows, "split int, pid bigint, role string, label int, x double, y double, same double")


def test_coefficients_are_those_of_spark_ml(spark):
    df, features = made(spark, 3), ["x", "y", "same"]
    penalties = [(0.0, 0.0), (0.0, 10.0), (5.0, 0.0), (3.0, 4.0)]
    got = {(r["split"], r["setting"]): r["coefficients"] for r in logistic.fits(df, features, ["split"], penalties).collect()}
    assert len(got) == 12
    laid = models.assembled(df.filter("role = 'train'"), features)
    for s in range(3):
        for k, (l1, l2) in enumerate(penalties):
            reg = (l1 + l2) / 200
            one = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=l1 / (l1 + l2) if l1 else 0.0, maxIter=500, tol=1e-12).fit(laid.filter(F.col("split") == s))
            assert got[s, k] == pytest.approx([*one.coefficients.toArray(), one.intercept], abs=1e-4)
            assert got[s, k][2] == 0


def test_penalty_on_features_as_they_are_is_at_its_least(spark):
    df = made(spark, 1)
    c = logistic.fits(df, ["x", "y"], ["split"], [(0.0, 1.0)], standard=False).first()["coefficients"]
    rows = [(r["x"], r["y"], r["label"]) for r in df.filter("role = 'train'").collect()]
    off = [(1 / (1 + math.exp(-(c[0] * x + c[1] * y + c[2]))) - t, x, y) for x, y, t in rows]
    assert sum(e * x for e, x, _ in off) + c[0] == pytest.approx(0, abs=1e-6)
    assert sum(e * y for e, _, y in off) + c[1] == pytest.approx(0, abs=1e-6) and sum(e for e, *_ in off) == pytest.approx(0, abs=1e-6)


def test_a_step_is_one_job_for_all_experiments(spark, monkeypatch):
    steps, plain = [], logistic._solved
    monkeypatch.setattr(logistic, "_solved", lambda *a: steps.append(1) or plain(*a))
    logistic.fits(made(spark, 1), ["x", "y"], ["split"])
    alone = len(steps)
    logistic.fits(made(spark, 12), ["x", "y"], ["split"], [(0.0, 0.0), (0.0, 1.0)])
    assert alone < 15 and len(steps) - alone < 15


def test_blocks_nulls_one_class_and_no_rows(spark, monkeypatch):
    df = made(spark, 3).unionByName(made(spark, 1, seed=5).withColumn("split", F.lit(None).cast("int")))
    df = df.withColumn("label", F.when(F.col("split") == 1, 1).otherwise(F.col("label"))).withColumn("x", F.when(F.col("pid") == 7, None).otherwise(F.col("x")))
    whole = logistic.fits(df, ["x", "y"], ["split"])
    monkeypatch.setattr(logistic, "BLOCK", 3)
    found = {r["split"]: r for r in logistic.fits(df, ["x", "y"], ["split"]).collect()}
    assert set(found) == {0, 1, 2, None} and found[1]["single"] == 1.0 and found[1]["coefficients"] is None
    for r in whole.collect():
        assert r["single"] is not None or r["coefficients"] == pytest.approx(found[r["split"]]["coefficients"], abs=1e-9)
    out = logistic.scored(df, ["x", "y"], whole, ["split"], ["split", "pid"])
    assert out.count() == df.count()
    assert out.filter("prob IS NULL").select("split", "pid").distinct().count() == 3  # the row without x, but where the class is the score
    assert logistic.fits(df.limit(0), ["x", "y"], ["split"]).count() == 0 and logistic.fits(df.limit(0), ["x"]).count() == 0


def test_separable_rows_end(spark):
    df = spark.createDataFrame([("train", int(k > 5), float(k)) for k in range(12)], "role string, label int, x double").withColumn("pid", F.lit(1))
    out = logistic.scored(df, ["x"], logistic.fits(df, ["x"], steps=25))
    assert out.filter("(label = 1) = (prob > 0.5)").count() == 12


def test_interrupted_fits_go_on(spark, tmp_path, monkeypatch):
    df, path = made(spark, 4), str(tmp_path / "fits")
    splits, data = df.select("split", "pid", "role"), made(spark, 1).select("pid", "label", "x", "y")
    plain, fitted = models.fit_and_score, []

    def breaks(own, *a):
        if own.first()["split"] == 2:
            raise RuntimeError("lost")
        return plain(own, *a)

    monkeypatch.setattr(models, "fit_and_score", breaks)
    args = (splits, data, ["x", "y"], models.tree(maxDepth=2), "m", ["split"])
    with pytest.raises(RuntimeError):
        models.per_experiment(*args, store=path, side_by_side=2)
    monkeypatch.setattr(models, "fit_and_score", lambda own, *a: fitted.append(own.first()["split"]) or plain(own, *a))
    again = models.per_experiment(*args, store=path, side_by_side=2)
    assert 2 in fitted and len(fitted) < 4
    fresh = models.per_experiment(*args)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fresh.collect())) and again.count() == splits.count()
    done = len(fitted)
    models.per_experiment(*args, store=path)
    assert len(fitted) == done


def test_predictions_written_again_replace_their_own(spark, tmp_path):
    rows = [(m, 0.1, 5, s, "train", k, k / 10) for m in "ab" for s in (0, 1) for k in range(3)]
    df = spark.createDataFrame(rows, "model string, train_size double, resolution int, split int, role string, pid bigint, prob double")
    path = str(tmp_path / "p")
    store.save_predictions(df, path)
    store.save_predictions(df.filter("model = 'a' AND split = 1").withColumn("prob", F.lit(9.0)), path)
    out = store.load_predictions(spark, path)
    assert out.count() == len(rows) and out.filter("prob = 9").select("model", "split").distinct().collect() == [("a", 1)]


def test_resample_is_exact_and_uniform(spark):
    df = spark.range(50).withColumnRenamed("id", "pid")
    out = prepare.resample(df, 20_000, seed=3)
    rows = sorted(map(tuple, out.collect()))
    assert sorted(r[1] for r in rows) == list(range(20_000))
    assert rows == sorted(map(tuple, prepare.resample(df.repartition(7, F.col("pid") % 3), 20_000, seed=3).collect()))
    counts = [r["count"] for r in out.groupBy("pid").count().collect()]
    assert len(counts) == 50 and sum((c - 400) ** 2 / 400 for c in counts) < 85.35  # chi-squared, 49 degrees, one in a thousand
    assert prepare.resample(df.limit(0), 5).count() == 0 and prepare.resample(df, 0).count() == 0


def test_a_hub_is_cut_down_in_parts(spark):
    edges = spark.range(20_000).select(F.lit(0).cast("bigint").alias("src"), (F.col("id") + 1).alias("dst"))
    got = distance.sampled_neighbours(edges, [15], lambda a, b, s: (b * 7919 + s) % 20011)
    want = sorted(range(1, 20_001), key=lambda d: (d * 7919 % 20011, d))[:15]
    assert sorted(r["dst"] for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert len(exchanges) == 2 and "_part" in exchanges[1] and "WindowGroupLimit" in plan.split("hashpartitioning")[1]
