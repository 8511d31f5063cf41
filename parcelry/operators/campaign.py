"""Inspection campaigns: the order in which parcels are dug, tile by tile, in descending threshold sweeps.

The sweep in which a parcel is dug depends on its own tile alone, so that no loop over the data is needed: sweeps by a lookup
in the schedule (or, with a minimum of digs, a fold over the schedule within each tile), then ranks over visits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import with_running
from .quantiles import quantiles, with_quantiles


def schedule(threshold_init: float = 0.9, threshold_increment: float = 0.1, min_digs: int = 1, min_digs_increment: int = 1) -> list[tuple[float, int]]:
    """(threshold, minimum of digs) of each sweep. Thresholds fall by repeated subtraction until they are below zero; each
    cycle ends with a sweep that takes every score; then the minimum falls, until it is 1 or less."""
    if threshold_increment <= 0 or (min_digs > 1 and min_digs_increment <= 0):
        raise ValueError("increments must be positive")
    sweeps, least = [], min_digs
    while True:
        at = threshold_init
        while at > 0:
            sweeps.append((at, least))
            at -= threshold_increment
        sweeps.append((at, least))
        if at == 0:
            sweeps.append((float("-inf"), least))
        if least <= 1:
            return sweeps
        least -= min_digs_increment


def checked(df: DataFrame, prob: str) -> DataFrame:
    """df; reading a row without tile or with a score that is null or NaN raises."""
    bad = F.col("tile_id").isNull() | F.col(prob).isNull() | F.isnan(prob)
    return df.withColumn(prob, F.when(bad, F.raise_error(F.lit("a parcel needs a tile and a score"))).otherwise(F.col(prob)))


def cells(df: DataFrame, keys: Sequence[str], falling: list[float], choose: str, prob: str) -> DataFrame:
    """(*keys, a, b, n): parcels by the first of the falling thresholds that each score is over (their number where none is)."""
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(falling)])
    band = lambda c: F.coalesce(F.get(F.filter(places, lambda x: F.col(c) > x["t"]), F.lit(0))["k"], F.lit(len(falling)))
    return df.groupBy(*keys, band(choose).alias("a"), band(prob).alias("b")).agg(F.count("*").alias("n"))


def with_sweep(df: DataFrame, by: Sequence[str], sweeps: list[tuple[float, int]], prob: str = "prob", choose: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """df with _sweep, from 0; and the visits (*by, tile_id, _sweep, _want) that the fold made, or None where each follows from its digs.

    Tiles are chosen by the scores `choose` (default: the same), parcels in them dug by prob. _want: the parcels of the tile, still
    undug, whose choosing score was over the threshold. The fold goes over counts by the thresholds that the two scores are
    over, (sweeps + 1) squared of them at most, however large a tile is.
    """
    limits = [float(t) for t, _ in sweeps]
    if all(m <= 1 for _, m in sweeps) and choose is None:
        first = F.filter(F.sequence(F.lit(0), F.lit(len(limits) - 1)), lambda k: F.get(F.array(*[F.lit(t) for t in limits]), k) < F.col(prob))
        return df.withColumn("_sweep", F.element_at(first, 1)), None
    keys = [*by, "tile_id"]
    falling = sorted(set(limits), reverse=True)
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(falling.index(float(t))).alias("t"), F.lit(m).alias("m")) for k, (t, m) in enumerate(sweeps)])
    tile = cells(df, keys, falling, choose or prob, prob).groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "n")).alias("_ps"))

    def fold(state: Column, s: Column) -> Column:
        want = F.aggregate(F.filter(state["left"], lambda p: p["a"] <= s["t"]), F.lit(0).cast("bigint"), lambda n, p: n + p["n"])
        fires = (want >= s["m"]) & (want > 0)
        return F.struct(
            F.when(fires, F.filter(state["left"], lambda p: p["b"] > s["t"])).otherwise(state["left"]).alias("left"),
            F.when(fires, F.concat(state["fired"], F.array(F.struct(s["k"].alias("k"), want.alias("want"))))).otherwise(state["fired"]).alias("fired"),
        )

    start = F.struct(F.col("_ps").alias("left"), F.array().cast("array<struct<k:int,want:bigint>>").alias("fired"))
    fired = tile.select(*keys, F.aggregate(steps, start, fold)["fired"].alias("_fired"))
    values = F.array(*[F.lit(t) for t in limits])
    mine = F.get(F.filter("_fired", lambda f: F.get(values, f["k"]) < F.col(prob)), F.lit(0))
    visits = fired.select(*keys, F.explode("_fired").alias("f")).select(*keys, F.col("f.k").alias("_sweep"), F.col("f.want").alias("_want"))
    return df.join(fired, keys).withColumn("_sweep", mine["k"]).drop("_fired"), visits


def campaign(
    df: DataFrame,
    by: Sequence[str] = (),
    threshold_init: float = 0.9,
    threshold_increment: float = 0.1,
    min_digs: int = 1,
    min_digs_increment: int = 1,
    tie: str = "id",
    seed: int = 0,
    prob: str = "prob",
    choose: str | None = None,
) -> DataFrame:
    """df (pid, tile_id, prob, label, *by) in digging order: dig_batch, dig_threshold, dig_index and hit_rate.

    Visits of tiles go by sweep, then most digs first, then `tie` ('id' or 'hash'). A tile chosen by another score takes a batch
    number also where nothing in it is over the threshold. Visits are few beside parcels: they are ranked first, and
    parcels numbered inside their visit by ranges, so no task sorts a whole experiment, nor a tile that holds most of one.
    """
    by = list(by)
    sweeps = schedule(threshold_init, threshold_increment, min_digs, min_digs_increment)
    dug, fired = with_sweep(checked(df, prob), by, sweeps, prob, choose)
    tie_key = F.col("tile_id") if tie == "id" else F.xxhash64(F.lit(seed), F.col("_sweep"), F.col("tile_id"))
    visits = dug.groupBy(*by, "_sweep", "tile_id").agg(F.count("*").alias("_digs"), F.sum("label").alias("_hits"))
    if fired is None:
        visits = visits.withColumn("_want", F.col("_digs"))
    else:
        visits = fired.join(visits, [*by, "_sweep", "tile_id"], "left").fillna(0, subset=["_digs", "_hits"])
    order = Window.partitionBy(*by).orderBy("_sweep", F.desc("_want"), tie_key, "tile_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    visits = visits.select(
        *by, "_sweep", "tile_id",
        (F.row_number().over(order) - 1).alias("dig_batch"),
        F.coalesce(F.sum("_digs").over(before), F.lit(0)).alias("_digs0"),
        F.coalesce(F.sum("_hits").over(before), F.lit(0)).alias("_hits0"),
    )
    visit = [*by, "_sweep", "tile_id"]
    numbered = with_running(dug, visit, [F.desc(prob), F.col("pid")], ["label"], position="_n").withColumnRenamed("cum_label", "_h")
    joined = numbered.join(visits, visit)
    thresholds = F.array(*[F.lit(float(t)) for t, _ in sweeps])
    return joined.select(
        *df.columns,
        "dig_batch",
        F.get(thresholds, F.col("_sweep")).alias("dig_threshold"),
        (F.col("_digs0") + F.col("_n") - 1).alias("dig_index"),
        ((F.col("_hits0") + F.col("_h")) / (F.col("_digs0") + F.col("_n"))).alias("hit_rate"),
    )


def hit_rate_curve(df: DataFrame, by: Sequence[str] = (), prob: str = "prob", order: Sequence[Column] | None = None) -> DataFrame:
    """Parcels by falling score: pos (from 0) and hit_rate; ties by pid."""
    running = with_running(df, by, order or [F.desc(prob), F.col("pid")], ["label"])
    return running.select(*df.columns, (F.col("pos") - 1).alias("pos"), (F.col("cum_label") / F.col("pos")).alias("hit_rate"))


def visit_medians(dug: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """dug with median_prob: the median of `score` over the parcel's visit (nulls and NaN left out)."""
    value = F.when(~F.isnan(score), F.col(score))
    visit = [*by, "dig_batch"]
    return with_quantiles(dug, quantiles(dug, value, [0.5], visit, "_q").select(*visit, F.col("_q")[0].alias("median_prob")), visit)
