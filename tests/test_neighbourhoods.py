"""Neighbourhoods are met in blocks: partitions follow the pairs, and sums over pairs need no row for each."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelry.functions import rounded
from parcelry.operators import distance, prepare

EVEN = "lat double, lon double, pid bigint"


def city(spark, n=1500, seed=3):
    rng = random.Random(seed)
    rows = [(43 + rng.random() * 0.02, -83.7 + rng.random() * 0.02, k) for k in range(n)]
    rows += [(43.01, -83.69, n + k) for k in range(40)] + [(43.2, -83.2, 90_000)]
    return spark.createDataFrame(rows, EVEN), rows


def plain(rows, limit):
    def dist(p, q):
        a, b = math.radians(p[0]), math.radians(q[0])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * math.asin(math.sqrt(h)) * 6371.0

    return {p[2]: {q[2]: d for q in rows if q[2] != p[2] and (d := dist(p, q)) < limit} for p in rows}


@pytest.mark.parametrize("block", [4_000_000, 20_000])
def test_a_small_file_is_met_in_many_partitions(spark, monkeypatch, block):
    """Partitions follow the pairs: a table of one file and one partition isn't met in one task, and a crowded cell is dealt to several."""
    monkeypatch.setattr(distance, "PARTITION", 50_000)
    monkeypatch.setattr(distance, "BLOCK", block)
    points, rows = city(spark)
    found = distance.radius_join(points.coalesce(1), 0.4)
    assert found.rdd.getNumPartitions() > 8
    want = plain(rows, 0.4)
    got = {(r["src"], r["dst"]): r["dist_km"] for r in found.collect()}
    assert got.keys() == {(a, b) for a in want for b in want[a]}
    assert all(d == pytest.approx(want[a][b], abs=1e-9) for (a, b), d in got.items())


def test_degrees_and_summary(spark):
    points, rows = city(spark)
    want = plain(rows, 0.4)
    assert {r["src"]: r["count"] for r in distance.degrees_within(points, 0.4).collect()} == {a: len(x) for a, x in want.items() if x}
    every = [d for x in want.values() for d in x.values()]
    mean = sum(every) / len(every)
    got = distance.distances_within(points, 0.4).first()
    assert tuple(got) == pytest.approx((max(every), min(every), mean, (sum((d - mean) ** 2 for d in every) / len(every)) ** 0.5), abs=1e-9)
    assert tuple(distance.distances_within(points.filter("pid = 90000"), 0.4).first()) == (None,) * 4


def test_means_shares_and_induced(spark):
    points, rows = city(spark, 300)
    want = plain(rows, 0.4)
    known = {k: float(k % 7) if k % 3 else None for k in want if k % 5}
    features = spark.createDataFrame(list(known.items()), "pid bigint, f double")
    got = {r["pid"]: r["nbr_f"] for r in distance.neighbour_means_within(points, features, ["f"], 0.4).collect()}
    for a in known:
        values = [known[b] for b in want[a] if known.get(b) is not None]
        assert got[a] == (pytest.approx(sum(values) / len(values)) if values else None)
    assert got.keys() == known.keys()
    total = sum(1 / (1 + d) for x in want.values() for d in x.values())
    for r in distance.normalised_within(points, lambda d: 1 / (1 + d), 0.4).collect():
        w = 1 / (1 + want[r["src"]][r["dst"]])
        assert (r["overall"], r["own"]) == pytest.approx((w / total, w / sum(1 / (1 + d) for d in want[r["src"]].values())))
    inner = {(r["src"], r["dst"]) for r in distance.induced_within(points, features, limit_km=0.4).collect()}
    assert inner == {(a, b) for a in known for b in want[a] if b in known}


def test_samples_and_lowest(spark):
    points, _ = city(spark, 400)
    edges = distance.radius_join(points, 0.4)
    order = lambda a, b, s: (a * 31 + b * 7919 + s) % 17
    rows = lambda df: sorted(map(tuple, df.select("root", "hop", "src", "dst").collect()))
    assert rows(distance.sampled_within(points, [3, 2], order, 0.4)) == rows(distance.sampled_neighbours(edges, [3, 2], order))
    made = distance.lowest_within(points, 6, 0.4, {"near": lambda a, b, d: d, "odd": lambda a, b, d: d * (1 + (a + b) % 3)})
    for graph, values in (("near", edges), ("odd", edges.withColumn("dist_km", F.expr("dist_km * (1 + (src + dst) % 3)")))):
        want = {(r["src"], r["dst"], r["rank"]) for r in distance.nearest(values, 6).collect()}
        assert {(r["src"], r["dst"], r["rank"]) for r in made.filter(F.col("graph") == graph).collect()} == want


def test_lists_and_requests(spark):
    points, rows = city(spark, 200)
    want = plain(rows, 0.4)
    got = {r["src"]: (r["dst_pids"], r["v"]) for r in distance.lists_within(points, 0.4, lambda a, b, d: a + 2.0 * b, "v").collect()}
    assert got == {a: (sorted(x), [a + 2.0 * b for b in sorted(x)]) for a, x in want.items() if x}
    plainly = prepare.route_requests(distance.radius_join(points, 0.4), points)
    assert sorted(map(tuple, distance.requests_within(points, 0.4).collect())) == sorted(map(tuple, plainly.collect()))


def test_rounding_by_whole_numbers(spark):
    values = [0.1234564, 0.1234565, -0.1234566, 2.5e-7, -1e-9, 123456789.0123456, 3e18, float("nan"), None, float("-inf")]
    got = [r[0] for r in rounded(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    assert got[:7] == [0.123456, 0.123457, -0.123457, 0.0, 0.0, 123456789.012346, 3e18]
    assert math.isnan(got[7]) and got[8] is None and got[9] == float("-inf")
