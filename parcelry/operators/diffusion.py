"""Smoothing of scores over a neighbour graph, for any number of experiments at once.

A step is linear: v' = lam v + (1 - lam) sum(w v_neighbour) / sum(w). Its coefficients are laid out once, a parcel's own as an edge to
itself. Parcels lie in parts along a space-filling curve, so that most neighbours share a part; the edges of a part stay in their bucket, and a
step moves values only, each to the parts that need it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import held
from .prefix import with_running
from .quantiles import quantiles

PACKED = 16
#: Edges of a part, each node counting as an edge more and as one for every eight experiments.
PART_LOAD = 50_000


def initial_values(nodes: DataFrame, predictions: DataFrame, by: Sequence[str], init: str = "prediction") -> DataFrame:
    """(*by, pid, v) for every node and experiment: its score, train or test; elsewhere the median of the test scores.

    init='label' starts train nodes at their label (column label of predictions).
    """
    median = quantiles(predictions, F.when(F.col("role") == "test", F.col("prob")), [0.5], by, "_q").select(*by, F.col("_q")[0].alias("_median"))
    score = F.when(F.col("role") == "train", F.col("label").cast("double")).otherwise(F.col("prob")) if init == "label" else F.col("prob")
    grid = nodes.select("pid").crossJoin(F.broadcast(median))
    return grid.join(predictions.select(*by, "pid", score.alias("_score")), [*by, "pid"], "left").select(*by, "pid", F.coalesce("_score", "_median").alias("v"))


def coefficients(edges: DataFrame, nodes: DataFrame, lam: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, src, dst, coef) of a step; a node's own share is an edge to itself, all of it where the node has no neighbour.

    edges: (*keys, src, dst, w); nodes: (*keys, pid), those that have a value: others are nobody's neighbours. lam may use keys.
    """
    keys = list(keys)
    known = edges.filter(F.col("w").isNotNull()).select(*keys, "src", "dst", "w")
    for end in ("src", "dst"):
        known = known.join(nodes.select(*keys, F.col("pid").alias(end)), [*keys, end], "left_semi")
    known = held(known)  # read twice
    totals = known.groupBy(*keys, "src").agg(F.sum("w").alias("_total")).filter("_total <> 0")
    near = known.join(totals, [*keys, "src"]).select(*keys, "src", "dst", ((1 - lam) * F.col("w") / F.col("_total")).alias("coef"), F.lit(False).alias("own"))
    own = nodes.select(*keys, F.col("pid").alias("src")).join(totals, [*keys, "src"], "left")
    return near.unionByName(own.select(*keys, "src", F.col("src").alias("dst"), F.when(F.col("_total").isNull(), 1.0).otherwise(lam).alias("coef"), F.lit(True).alias("own")))


def one_step(now: DataFrame, coefs: DataFrame, keys: Sequence[str], shared: Sequence[str], freeze_certain: bool = False) -> DataFrame:
    """now (*keys, pid, values) after a step. shared: the keys that coefs has as well."""
    names = [c for c in now.columns if c not in (*keys, "pid")]
    met = now.withColumnRenamed("pid", "dst").join(coefs, [*shared, "dst"])
    sums = [F.sum(F.col("coef") * F.col(v)).alias(v) for v in names]
    if not freeze_certain:
        return met.groupBy(*keys, F.col("src").alias("pid")).agg(*sums)
    before = [F.max(F.when(F.col("own"), F.col(v))).alias(f"_{v}") for v in names]
    both = met.groupBy(*keys, F.col("src").alias("pid")).agg(*sums, *before)
    return both.select(*keys, "pid", *[F.when(F.col(f"_{v}").isin(0.0, 1.0), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in names])


def diffuse(
    values: DataFrame,
    edges: DataFrame,
    by: Sequence[str],
    lam: float = 0.5,
    n_iter: int = 1,
    freeze_certain: bool = False,
    cut_every: int = 5,
    trace: bool = False,
    places: DataFrame | None = None,
    part_load: int = PART_LOAD,
) -> DataFrame:
    """values (*by, pid, v) after n_iter steps of v' = lam v + (1 - lam) sum(w v_neighbour) / sum(w).

    edges: (src, dst, w). A node without neighbours keeps its value. freeze_certain keeps values of exactly 0 and 1.
    trace: the values after each step from 0 on, with `iter`. Every experiment must have a value for each of the nodes.
    places: (pid, lat, lon), by which neighbours come to lie in the same part; without it nodes are dealt in the order of pid.

    Nodes are dealt into parts of about part_load edges. A part's edges are written once, bucketed by part, and stay there. A step sends
    a node's values, all experiments in one row, to its own part and to those with an edge to it; each part works out its nodes. Where a
    node has more edges than a part may have, steps are joins with partial sums instead. Values are written to the shared
    folder every cut_every steps, so that a lost executor costs few steps.
    """
    spark = values.sparkSession
    numbered, n_experiments = numbered_experiments(values, by)
    listed = F.sort_array(F.collect_list(F.struct("_k", "v")))
    packed = values.join(F.broadcast(numbered), list(by)).filter(F.col("v").isNotNull()).groupBy("pid").agg(F.transform(listed, lambda x: x["v"]).alias("v"))
    now = held(packed)
    if not now.filter(F.size("v") != n_experiments).isEmpty():
        raise ValueError("every experiment must have a value for each of the nodes")
    coefs = held(coefficients(edges, now.select("pid"), F.lit(float(lam))))
    degrees = held(coefs.groupBy(F.col("src").alias("pid")).agg(F.count("*").alias("load")))
    if (degrees.agg(F.max("load")).first()[0] or 0) > part_load:
        steps = _steps_by_joins(now, coefs, n_iter, n_experiments, freeze_certain, cut_every, trace)
        return _opened(steps, numbered, by, trace)
    table = f"parcelry_edges_{uuid.uuid4().hex}"
    try:
        parts = held(dealt(degrees.withColumn("load", F.col("load") + n_experiments // 8), places, part_load))
        state = write_parts(now, coefs, parts, table)
        chosen = state.withColumn("iter", F.lit(0))
        for n in range(1, n_iter + 1):
            state = part_step(state, spark.table(table), freeze_certain)
            if trace or n == n_iter or n % cut_every == 0:
                state = held(state)
            if trace:
                chosen = chosen.unionByName(state.withColumn("iter", F.lit(n)))
        done = held((chosen if trace else state).filter("home").drop("part", "home"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return _opened(done, numbered, by, trace)


def _opened(rows: DataFrame, numbered: DataFrame, by: Sequence[str], trace: bool) -> DataFrame:
    extra = ["iter"] if trace else []
    opened = rows.select("pid", *extra, F.posexplode("v").alias("_k", "v"))
    return opened.join(F.broadcast(numbered), "_k").select(*by, *extra, "pid", "v")


def _steps_by_joins(now: DataFrame, coefs: DataFrame, n_iter: int, n_experiments: int, freeze_certain: bool, cut_every: int, trace: bool) -> DataFrame:
    """(pid, v) after the steps, with iter if traced: rows of PACKED experiments, a join and a sum each step."""
    width = min(PACKED, n_experiments) or 1
    slots = [f"v{k}" for k in range(width)]
    wide = now.select("pid", F.posexplode("v").alias("_k", "v")).groupBy(F.floor(F.col("_k") / width).alias("_c"), "pid")
    now = held(wide.agg(*[F.max(F.when(F.col("_k") % width == k, F.col("v"))).alias(s) for k, s in enumerate(slots)]))
    chosen = now.withColumn("iter", F.lit(0))
    for step in range(1, n_iter + 1):
        now = one_step(now, coefs, ["_c"], [], freeze_certain)
        if trace or step % cut_every == 0:
            now = held(now)
        if trace:
            chosen = chosen.unionByName(now.withColumn("iter", F.lit(step)))
    rows, extra = (chosen, ["iter"]) if trace else (now, [])
    lists = rows.groupBy("pid", *extra).agg(F.sort_array(F.collect_list(F.struct("_c", F.array_compact(F.array(*slots)).alias("v")))).alias("_x"))
    return lists.select("pid", *extra, F.flatten(F.transform("_x", lambda x: x["v"])).alias("v"))


def curve_key(lat: Column, lon: Column, low: Column, high: Column) -> Column:
    """Place on a space-filling curve (Morton order, 16 bits a side) within the box from low to high, structs of lat and lon."""

    def spread(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return x

    side = lambda v, n: spread(F.coalesce(F.floor(F.least(F.try_divide(v - low[n], high[n] - low[n]), F.lit(1.0)) * 65535), F.lit(0)).cast("bigint"))
    return side(lat, "lat").bitwiseOR(F.shiftleft(side(lon, "lon"), 1))


def dealt(degrees: DataFrame, places: DataFrame | None, part_load: int) -> DataFrame:
    """(pid, part) from (pid, load): runs of nodes along the curve, or by pid, with about part_load each."""
    order = [F.col("pid")]
    if places is not None:
        box = places.agg(*[F.struct(f("lat").alias("lat"), f("lon").alias("lon")).alias(n) for n, f in (("_low", F.min), ("_high", F.max))])
        keyed = places.select("pid", "lat", "lon").crossJoin(F.broadcast(box))  # one row
        keyed = keyed.select("pid", curve_key(F.col("lat"), F.col("lon"), F.col("_low"), F.col("_high")).alias("_at"))
        degrees = held(degrees.join(keyed, "pid", "left"))
        order = [F.col("_at"), F.col("pid")]
    return with_running(degrees, [], order, ["load"]).select("pid", F.floor((F.col("cum_load") - 1) / part_load).alias("part"))


def write_parts(now: DataFrame, coefs: DataFrame, parts: DataFrame, table: str) -> DataFrame:
    """The edges as a table bucketed by the part of their src, and the first values: a row for each part that needs the node.

    A node's own edge lists the other parts that have an edge to it.
    """
    placed = held(coefs.join(parts.withColumnRenamed("pid", "src"), "src"))
    abroad = placed.filter(~F.col("own")).select("dst", "part").distinct().join(parts.select(F.col("pid").alias("dst"), F.col("part").alias("_home")), "dst")
    wanted = held(abroad.filter("part <> _home").groupBy("dst").agg(F.sort_array(F.collect_list("part")).alias("others")))
    own = placed.filter("own").join(wanted.withColumnRenamed("dst", "src"), "src", "left").select("part", "src", "dst", "coef", "own", F.coalesce("others", F.expr("cast(array() as array<bigint>)")).alias("others"))
    others = placed.filter("NOT own").select("part", "src", "dst", "coef", "own", F.lit(None).cast("array<bigint>").alias("others"))
    buckets = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own.unionByName(others).repartition(buckets, "part").write.bucketBy(buckets, "part").saveAsTable(table)
    first = now.join(parts, "pid").join(wanted.withColumnRenamed("dst", "pid"), "pid", "left")
    to = F.explode(F.concat(F.array("part"), F.coalesce("others", F.expr("cast(array() as array<bigint>)"))))
    return held(first.select("pid", "v", F.col("part").alias("_home"), to.alias("part")).select("part", "pid", "v", (F.col("part") == F.col("_home")).alias("home")))


def part_step(state: DataFrame, edges: DataFrame, freeze_certain: bool) -> DataFrame:
    """state (part, pid, v, home) after a step; the edges stay where they are."""

    def step(key: tuple, values: pa.Table, edges: pa.Table) -> pa.Table:
        pid = values["pid"].to_numpy()
        width = len(values["v"][0]) if values.num_rows else 0
        v = values["v"].combine_chunks().flatten().to_numpy().reshape(-1, width) if values.num_rows else np.zeros((0, 0))
        by_pid = np.argsort(pid, kind="stable")
        edges = edges.sort_by("src")
        src, dst, coef = (edges[c].to_numpy() for c in ("src", "dst", "coef"))
        place = lambda ids: by_pid[np.searchsorted(pid, ids, sorter=by_pid)]
        nodes, first = np.unique(src, return_index=True)
        after = np.add.reduceat(coef[:, None] * v[place(dst)], first, axis=0) if len(src) else v[:0]
        if freeze_certain and len(src):
            before = v[place(nodes)]
            after = np.where((before == 0) | (before == 1), before, after)
        own = edges.filter(edges["own"])  # one for each node, in their order
        lists = own["others"].combine_chunks()
        counts = np.diff(lists.offsets.to_numpy()) if len(nodes) else np.zeros(0, int)
        at = np.concatenate((np.arange(len(nodes)), np.repeat(np.arange(len(nodes)), counts)))
        part = np.concatenate((np.full(len(nodes), key[0].as_py()), lists.flatten().to_numpy().astype(np.int64) if len(nodes) else np.zeros(0, np.int64)))
        flat = after[at]
        offsets = pa.array(np.arange(len(at) + 1) * flat.shape[1], pa.int32())
        made = {"part": part, "pid": pa.array(nodes).cast(values["pid"].type).take(pa.array(at)), "v": pa.ListArray.from_arrays(offsets, pa.array(flat.ravel(), pa.float64())), "home": np.arange(len(at)) < len(nodes)}
        return pa.table(made)

    return state.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(step, state.schema)


def numbered_experiments(values: DataFrame, by: Sequence[str]) -> tuple[DataFrame, int]:
    """(*by, _k): the experiments, not rows, numbered in their order; and how many."""
    keys = values.select(*by).distinct()
    listed = [tuple(r) for r in keys.orderBy(*by).collect()]
    schema = T.StructType([*keys.schema.fields, T.StructField("_k", T.IntegerType())])
    return values.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(listed)], schema), len(listed)


def power_step(now: DataFrame, edges: DataFrame, weights: dict[str, Callable[[Column], Column]], ks: Sequence[int], width: int, before: str, after: str) -> DataFrame:
    """now (graph, _c, pid, arrays) with the array `after`: the weighted mean of the neighbours' `before`, for each weight, k and slot.

    One sweep over the edges serves all weights and all k: an edge counts for those k that its rank is within. `before` holds
    either a value for each slot, or one for each weight, k and slot. A node without neighbours keeps its own.
    """
    cells = [(w, k) for w in weights for k in ks]
    at = lambda source, c, s: source[s] if before == "p0" else source[c * width + s]
    met = edges.join(now.select("graph", "_c", F.col("pid").alias("dst"), F.col(before).alias("_v")), ["graph", "dst"])
    met = met.withColumns({f"_w{n}": f(F.col("dist")) for n, f in enumerate(weights.values())})
    sums = []
    for c, (w, k) in enumerate(cells):
        weight = F.when(F.col("rank") <= k, F.col(f"_w{list(weights).index(w)}"))
        sums += [F.sum(weight).alias(f"_t{c}"), *[F.sum(weight * at(F.col("_v"), c, s)).alias(f"_s{c}_{s}") for s in range(width)]]
    means = met.groupBy("graph", "_c", F.col("src").alias("pid")).agg(*sums)
    value = lambda c, s: F.when(F.col(f"_t{c}") != 0, F.col(f"_s{c}_{s}") / F.col(f"_t{c}")).otherwise(at(F.col(before), c, s))
    made = F.array(*[value(c, s) for c in range(len(cells)) for s in range(width)])
    return now.join(means, ["graph", "_c", "pid"], "left").select(*now.columns, made.alias(after))


def tuning_grid(
    values: DataFrame,
    edges: DataFrame,
    graphs: Sequence[str],
    weights: dict[str, Callable[[Column], Column]],
    ks: Sequence[int],
    lams: Sequence[float],
    n_iter: int = 1,
    by: Sequence[str] = ("split",),
) -> DataFrame:
    """(graph, weight, k, lam, *by, pid, v): the values of every experiment diffused under every combination, in one plan.

    values: (*by, pid, v), every experiment with the same nodes. edges: (graph, src, dst, dist, rank), neighbours ranked by graph
    up to the largest k. A step is v' = lam v + (1 - lam) P v, so n steps are a binomial sum over the powers of P on v: the powers are
    made once for all lam, and one sweep over the edges makes a power for all weights and k. Edge rows moved don't depend on
    how many of these there are. A parcel's values of PACKED experiments are one row.
    """
    spark, by = values.sparkSession, list(by)
    numbered, n_experiments = numbered_experiments(values, by)
    width = min(PACKED, n_experiments) or 1
    place = F.col("_k") % width
    slots = F.array(*[F.max(F.when(place == s, F.col("v"))) for s in range(width)])
    packed = values.join(F.broadcast(numbered), by).groupBy(F.floor(F.col("_k") / width).alias("_c"), "pid").agg(slots.alias("p0"))
    now = held(packed.select(F.explode(F.array(*[F.lit(g) for g in graphs])).alias("graph"), "_c", "pid", "p0"))
    nodes = now.select("graph", "pid").distinct()
    known = edges.filter(F.col("dist").isNotNull() & (F.col("rank") <= max(ks))).select("graph", "src", "dst", "dist", "rank")
    for end in ("src", "dst"):
        known = known.join(nodes.withColumnRenamed("pid", end), ["graph", end], "left_semi")
    known = held(known)
    for n in range(1, n_iter + 1):
        now = held(power_step(now, known, weights, ks, width, f"p{n - 1}", f"p{n}"))

    cells = [(w, int(k)) for w in weights for k in ks]
    share = F.array(*[F.array(*[F.lit(comb(n_iter, n) * lam ** (n_iter - n) * (1 - lam) ** n) for n in range(n_iter + 1)]) for lam in map(float, lams)])
    each = now.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(len(cells) * len(lams) * width - 1))))
    slot, rest = F.col("_cell") % width, F.floor(F.col("_cell") / width).cast("int")
    each = each.withColumn("_slot", slot).withColumn("_lam", (rest % len(lams)).cast("int")).withColumn("_combo", F.floor(rest / len(lams)).cast("int")).withColumn("_share", share[F.col("_lam")])
    terms = [F.col("_share")[0] * F.col("p0")[F.col("_slot")], *[F.col("_share")[n] * F.col(f"p{n}")[F.col("_combo") * width + F.col("_slot")] for n in range(1, n_iter + 1)]]
    opened = each.select("graph", "pid", (F.col("_c") * width + F.col("_slot")).cast("int").alias("_k"), "_combo", "_lam", sum(terms[1:], terms[0]).alias("v")).filter(F.col("v").isNotNull())
    named = spark.createDataFrame([(c, i, w, k, float(lam)) for c, (w, k) in enumerate(cells) for i, lam in enumerate(lams)], "_combo int, _lam int, weight string, k int, lam double")
    return opened.join(F.broadcast(named), ["_combo", "_lam"]).join(F.broadcast(numbered), "_k").select("graph", "weight", "k", "lam", *by, "pid", "v")


def best_cells(grid: DataFrame, table: Sequence[str], loss_within: float = 0.0002, area_within: float = 0.5) -> DataFrame:
    """Cells (.., log_loss, auhrc) whose loss or area is next to the best of their table, with best_loss and best_area."""
    ends = grid.groupBy(*table).agg(F.min("log_loss").alias("_l"), F.max("auhrc").alias("_a"))
    flagged = grid.join(ends, list(table)).withColumn("best_loss", F.col("log_loss") - F.col("_l") <= loss_within).withColumn("best_area", F.col("_a") - F.col("auhrc") <= area_within)
    return flagged.filter("best_loss OR best_area").drop("_l", "_a")


def laid_out(grid: DataFrame, table: Sequence[str], ks: Sequence[int], metrics: Sequence[str] = ("log_loss", "auhrc")) -> DataFrame:
    """Tables of lambda by K: a row for each lambda, columns <metric>_<k>."""
    return grid.groupBy(*table, "lam").agg(*[F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_{k}") for m in metrics for k in ks])
