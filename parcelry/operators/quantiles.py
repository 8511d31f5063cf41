"""Exact quantiles of any number of groups by distributed selection.

Each wanted rank has an interval that holds its value, at first the group's least to greatest. A round counts the rows of all open
intervals in bins of equal width, in one pass, and narrows every interval to the bin that holds its rank, from the bin's own least to its
greatest value. The least and the greatest never share a bin, so a round always parts values, and ties end in an interval
of one value. An interval of few rows is sorted. Partial counts are summed where the rows lie: no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import held

#: Rows of an interval that one task may sort, and bins of a round.
FEW, BINS = 10_000, 1024


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names], F.lit(True))


def _inside(rows: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that lie in an interval of their group, with it; without keys there are no more intervals than wanted ranks."""
    if not keys:
        return rows.join(F.broadcast(spans), F.col("_v").between(F.col("_lo"), F.col("_hi")))
    return rows.join(spans, _same(rows, spans, keys) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*[rows[k] for k in keys], "_v", "_lo", "_hi")


def _narrowed(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    bin_ = F.when(F.col("_v") == F.col("_hi"), bins - 1).when(F.col("_v") == F.col("_lo"), 0).otherwise(F.least(F.floor(F.nanvl(share, F.lit(0.5)) * bins), F.lit(bins - 2)))
    met = _inside(rows, wanted.select(*keys, "_lo", "_hi").distinct(), keys)
    counts = met.groupBy(*keys, "_lo", "_hi", bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    before = F.sum("_c").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin")) - F.col("_c")
    counts = counts.withColumn("_before", before)
    at = wanted["_rank"] - wanted["_under"]
    found = wanted.join(counts, _same(wanted, counts, [*keys, "_lo", "_hi"]) & (at >= counts["_before"]) & (at < counts["_before"] + counts["_c"]))
    return found.select(*[wanted[k] for k in keys], "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_under") + F.col("_before")).alias("_under"), F.col("_c").alias("_in"))


def quantiles(df: DataFrame, value: Column, probs: Sequence[float], by: Sequence[str] = (), name: str = "quantiles", few: int = FEW, bins: int = BINS) -> DataFrame:
    """(*by, name): for each group an array with the quantile of each probability, interpolated between the two ranks it lies between.

    Nulls don't count; a group without values has null. NaN is greater than any number.
    """
    keys = [f"_k{j}" for j in range(len(by))]
    rows = held(df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], (value.cast("double") + 0.0).alias("_v")))
    groups = held(rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    places = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(p).cast("bigint") for p in places for f in (F.floor, F.ceil)]))
    state = groups.filter("_n > 0").select(*keys, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_under"), F.col("_n").alias("_in"))
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_in") > few)
    state = held(state)
    while not state.filter(wide).isEmpty():
        state = held(state.filter(~wide).unionByName(_narrowed(rows, state.filter(wide), keys, bins)))
    one = state.filter(F.col("_lo") == F.col("_hi")).select(*keys, "_rank", F.col("_lo").alias("_x"))
    some = state.filter(F.col("_lo") < F.col("_hi"))
    sorted_ = _inside(rows, some.select(*keys, "_lo", "_hi").distinct(), keys).withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v")))
    picked = some.join(sorted_, _same(some, sorted_, [*keys, "_lo", "_hi"]) & (sorted_["_at"] == some["_rank"] - some["_under"] + 1))
    values = one.unionByName(picked.select(*[some[k] for k in keys], "_rank", F.col("_v").alias("_x")))
    values = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_m"))
    met = groups.join(values, _same(groups, values, keys), "left") if keys else groups.join(F.broadcast(values), F.lit(True), "left")  # without keys one row each
    out = []
    for place in places:
        low, high = (F.element_at("_m", f(place).cast("bigint")) for f in (F.floor, F.ceil))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))))
    return met.select(*[groups[k].alias(b) for b, k in zip(by, keys, strict=True)], F.when(F.col("_n") > 0, F.array(*out)).alias(name))


def with_quantiles(df: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """df beside the quantiles of its group, nulls of `by` being a group."""
    if not by:
        return df.crossJoin(F.broadcast(found))  # one row
    named = found.withColumnsRenamed({b: f"_q_{b}" for b in by})
    on = reduce(lambda a, b: a & b, [df[b].eqNullSafe(named[f"_q_{b}"]) for b in by])
    return df.join(named, on, "left").drop(*[f"_q_{b}" for b in by])
