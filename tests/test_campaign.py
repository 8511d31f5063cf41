"""Campaigns against a plain sweep-by-sweep simulation, and invariants."""

import random

import pytest
from pyspark.errors import SparkRuntimeException

from parcelry.operators.campaign import campaign, hit_rate_curve, schedule, visit_medians
from parcelry.operators.costs import add_savings, cost_curve, pooled
from parcelry.operators.metrics import curve_by_threshold

SCHEMA = "pid bigint, tile_id bigint, prob double, label int, other double"


def simulate(rows, init=0.9, step=0.1, least=1, fall=1, choose=2):
    """The digging order by walking through sweeps and tiles. rows: (pid, tile, prob, label, other)."""
    left, order, at, visits = list(rows), [], init, 0
    while left:
        limits = [at] if at != 0 else [at, float("-inf")]
        for limit in limits:
            counts = {}
            for r in left:
                counts.setdefault(r[1], 0)
                counts[r[1]] += r[choose] > limit
            for tile, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
                if n < max(least, 1):
                    break
                dug = sorted((r for r in left if r[1] == tile and r[2] > limit), key=lambda r: (-r[2], r[0]))
                order += [(r[0], visits, limit) for r in dug]
                visits += 1
            done = {o[0] for o in order}
            left = [r for r in left if r[0] not in done]
        if at > 0:
            at -= step
        else:
            at, least = init, least - fall
    return order


def made(seed, n=60, tiles=7):
    rng = random.Random(seed)
    grid = lambda: rng.choice([rng.random(), round(rng.random(), 1), 0.0, 1.0])
    return [(k, rng.randrange(tiles), grid(), rng.randrange(2), grid()) for k in range(n)]


@pytest.mark.parametrize("seed,least", [(1, 1), (2, 2), (3, 3), (4, 5)])
def test_campaign_equals_simulation(spark, seed, least):
    rows = made(seed)
    got = campaign(spark.createDataFrame(rows, SCHEMA), min_digs=least).orderBy("dig_index").collect()
    assert [(r["pid"], r["dig_batch"], r["dig_threshold"]) for r in got] == simulate(rows, least=least)
    assert [r["dig_index"] for r in got] == list(range(len(rows)))
    assert got[-1]["hit_rate"] == pytest.approx(sum(r[3] for r in rows) / len(rows))


@pytest.mark.parametrize("seed,least", [(5, 1), (6, 2)])
def test_tiles_chosen_by_other_scores(spark, seed, least):
    rows = made(seed)
    got = campaign(spark.createDataFrame(rows, SCHEMA), min_digs=least, choose="other").orderBy("dig_index").collect()
    assert [(r["pid"], r["dig_batch"]) for r in got] == [x[:2] for x in simulate(rows, least=least, choose=4)]


def test_threshold_of_exactly_zero_ends(spark):
    rows = [(1, 1, 0.0, 1, 0.0), (2, 1, 0.3, 0, 0.0)]
    got = campaign(spark.createDataFrame(rows, SCHEMA), threshold_init=1.0, threshold_increment=0.25).orderBy("dig_index").collect()
    assert [r["pid"] for r in got] == [2, 1]


def test_schedule_is_repeated_subtraction():
    limits = [t for t, _ in schedule()]
    assert len(limits) == 11 and limits[2] == 0.7000000000000001 and limits[-1] == -0.09999999999999987
    with pytest.raises(ValueError):
        schedule(threshold_increment=0)


@pytest.mark.parametrize("row", [(1, None, 0.5, 1, 0.0), (1, 1, None, 1, 0.0), (1, 1, float("nan"), 1, 0.0)])
def test_missing_tile_or_score_raises(spark, row):
    with pytest.raises(SparkRuntimeException):
        campaign(spark.createDataFrame([row], SCHEMA)).collect()


def test_parcel_order_with_fine_thresholds(spark):
    rows = [(k, k % 3, (k * 37 % 101) / 101, k % 2, 0.0) for k in range(1, 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    tiled = [r["pid"] for r in campaign(df, threshold_init=1.0, threshold_increment=0.001).orderBy("dig_index").collect()]
    assert tiled == [r["pid"] for r in hit_rate_curve(df).orderBy("pos").collect()]


def test_empty_table(spark):
    assert campaign(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hit_rate_curve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_curve_by_threshold_takes_the_last_position(spark):
    curve = spark.createDataFrame([(0, 0.4, 1.0), (1, 0.9, 0.5), (2, 0.2, 0.6), (3, 0.5, 0.7)], "pos bigint, prob double, hit_rate double")
    got = {round(r["threshold"], 1): (r["pos"], r["hit_rate"]) for r in curve_by_threshold(curve, n=11).collect()}
    assert got == {0.0: (3, 0.7), 0.1: (3, 0.7), 0.2: (3, 0.7), 0.3: (3, 0.7), 0.4: (3, 0.7), 0.5: (1, 0.5), 0.6: (1, 0.5), 0.7: (1, 0.5), 0.8: (1, 0.5), 0.9: (0, 1.0)}


def test_curve_by_threshold_counts_the_last_down_to_zero(spark):
    """Thresholds k / (n - 1) from n - 2 to 0: a score of exactly one isn't over it, a score of 0 is over none."""
    curve = spark.createDataFrame([(0, 1 / 499, 1.0), (1, 2.5 / 499, 0.5), (2, 0.0, 0.3)], "pos bigint, prob double, hit_rate double")
    got = {round(r["threshold"] * 499): r["pos"] for r in curve_by_threshold(curve).collect()}
    assert len(got) == 499 and got == {k: 1 if k <= 2 else 0 for k in range(499)}


def test_costs_by_hand(spark):
    """Hits at digs 2 and 4; the threshold is the lowest sweep's from a hit to the dig before the next, whatever the scores."""
    dug = spark.createDataFrame([(0, 0.95, 0.9, 0.0), (1, 0.85, 0.8, 0.5), (2, 0.83, 0.7, 1 / 3), (3, 0.72, 0.7, 0.5), (4, 0.71, 0.6, 0.4)], "dig_index bigint, prob double, dig_threshold double, hit_rate double")
    got = {r["lead_digs"]: (r["digs"], r["prob_thres"], r["cost"], r["cost_avg"]) for r in cost_curve(dug).collect()}
    assert got == {1: (2, 0.7, 8000.0, 8000.0), 2: (4, 0.6, 16000.0, 8000.0)}


def test_pooling_stops_at_the_shortest_split(spark):
    rows = [(m, 0.1, 5, s, n, 10.0 * n + s + (m == "b"), 1.0) for m in "ab" for s, most in ((0, 3), (1, 2)) for n in range(1, most + 1)]
    curves = spark.createDataFrame(rows, "model string, train_size double, resolution int, split int, lead_digs bigint, cost double, cost_avg double")
    saved = pooled(add_savings(curves, "a"), ["cost", "savings"]).orderBy("lead_digs").collect()
    assert [(r["lead_digs"], r["cost"], r["savings"]) for r in saved] == [(1, 11.5, -1.0), (2, 21.5, -1.0)]


def test_visit_medians_skip_missing(spark):
    dug = spark.createDataFrame([(0, 0.2), (0, 0.4), (0, None), (1, float("nan"))], "dig_batch bigint, s double")
    got = {r["dig_batch"]: r["median_prob"] for r in visit_medians(dug, "s").collect()}
    assert got[0] == pytest.approx(0.3) and got[1] is None
