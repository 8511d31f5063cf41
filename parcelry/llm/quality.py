"""Quality rules whose thresholds keep the risk of rejecting a good document under control.

Each rule compares one figure of a text with a cutoff. A setting is a cutoff for every rule; the settings from loose to strict, fixed
before any label is seen, form one ladder. For every stratum the ladder is tested on labelled holdout documents: with x of n
good ones rejected by a setting, the exact binomial probability of x or fewer at the allowed rate must be at most the error
level. Testing stops at the first setting that fails, so that rules and settings cost no correction; the level is divided
among the strata (Bonferroni). Within the strictest setting passed each rule is loosened, or left out, as far as nearly as many bad
documents are still rejected: what is rejected then is a part of what was certified.

Strata with fewer than LEAST_GOOD good labels, which could hardly certify anything, are one stratum together.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fenced, fenced_name, named, slices

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
#: Of each rule its figure and its cutoffs from loose to strict, one for each setting of the ladder: fixed before any label is seen.
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.2, 0.1]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
}
STEPS = 10
LEAST_GOOD = 100
#: More strata than this aren't broadcast.
MOST_STRATA = 10_000


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    codes = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pairs = codes[:-1] * len(ids) + codes[1:]
    if len(ids) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), capitals


def add_counts(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with COUNTS, without the text unless keep_text.

    Null and empty texts count 0 everywhere; repeated rows count alike; an empty table gives an empty one. Columns of docs
    named as the new ones are replaced, others of any name stay.
    """
    inner, back = fenced(docs, COUNTS) if keep_text else fenced(docs, [*COUNTS, text], _text=named(text))
    read = fenced_name(docs, text) if keep_text else "_text"
    fields = [f for f in inner.schema.fields if f.name != "_text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, read):
            found = np.array([text_counts(t.as_py()) for t in batch.column(read)], np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column(f.name) for f in fields] + [pa.array(found[:, k]) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + COUNTS)

    return back(inner.mapInArrow(count, T.StructType(fields + [T.StructField(c, T.LongType()) for c in COUNTS])), *COUNTS)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(x: int, n: int, rate: float) -> float:
    """P(X <= x) for X ~ Binomial(n, rate), exact to double precision: terms fall off downward from x or upward."""
    if x >= n:
        return 1.0
    if x < 0:
        return 0.0
    log_term = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    below = x <= n * rate
    k = x if below else x + 1
    total, term = 0.0, math.exp(log_term(k))
    while term > 1e-300 and (not total or term > 1e-17 * total):
        total += term
        if below:
            if k == 0:
                break
            term *= k * (1 - rate) / ((n - k + 1) * rate)
            k -= 1
        else:
            if k == n:
                break
            term *= (n - k) * rate / ((k + 1) * (1 - rate))
            k += 1
    return min(1.0, total if below else 1 - total)


def certified(good: Sequence[int], allowed: float, level: float) -> int:
    """How many settings of the ladder pass. good[k]: good documents whose first rejecting setting is k; the last, those that none rejects."""
    n, rejected = sum(good), 0
    for k, first in enumerate(good[:-1]):
        rejected += first
        if not n or binomial_tail(rejected, n, allowed) > level:
            return k
    return len(good) - 1


def loosened(cells: Sequence[tuple[tuple[int, ...], int]], passed: int, enough: float) -> list[int | None]:
    """Of each rule the loosest setting (None: the rule isn't needed) such that `enough` of the bad documents rejected at the last setting
    passed still are. cells: (by rule the first setting that rejects, documents); rules are loosened from the last to the first."""
    chosen: list[int | None] = [passed - 1] * (len(cells[0][0]) if cells else 0)
    caught = lambda at: sum(n for firsts, n in cells if any(k is not None and f <= k for f, k in zip(firsts, at, strict=True)))
    best = caught(chosen) if passed else 0
    if not best:
        return [None] * len(chosen)
    for r in reversed(range(len(chosen))):
        for k in [None, *range(passed)]:
            if caught([*chosen[:r], k, *chosen[r + 1 :]]) >= enough * best:
                chosen[r] = k
                break
    return chosen


def stratum_key(stratum: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("null"))


def fit_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str = "lang", allowed: float = 0.05, error: float = 0.05, enough: float = 0.99, id_col: str = "doc_id", least_good: int = LEAST_GOOD) -> DataFrame:
    """(_stratum, n_good, n_certified, symbols, repeats, ...): of each stratum the good labels it was tested on, the settings certified, and the
    cutoff of each rule, null where it has none. The row `rest` is of the small strata together, and of those without labels.

    Holdout: labelled documents that the base rules keep. A document labelled twice counts by its lowest label; null
    ids and labels count for nothing; null is a stratum. With too few labels nothing is certified and nothing rejected.
    What is gathered of a stratum are counts by the rules' first rejecting settings, (STEPS + 1) to the number of rules at most.
    """
    label = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg((F.min("quality") == 1).alias("_good"))
    first = lambda v, cs: F.coalesce(F.array_min(F.transform(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(cs)]), lambda x: v > x["c"]), lambda x: x["k"])), F.lit(STEPS))
    held_out = counts.filter(~base_failed()).select(F.col(id_col), stratum_key(stratum).alias("_own"), *[first(F.expr(v), cs).alias(r) for r, (v, cs) in RULES.items()])
    rules = list(RULES)
    cells = cut(held_out.join(label, id_col).groupBy("_own", "_good", *rules).agg(F.count("*").alias("_n")))
    large = cells.groupBy("_own").agg(F.sum(F.when(F.col("_good"), F.col("_n")).otherwise(0)).alias("_size")).filter(F.col("_size") >= least_good)
    strata = large.count() + 1
    pooled = cells.join(large.select("_own", F.col("_own").alias("_stratum")), "_own", "left").withColumn("_stratum", F.coalesce("_stratum", F.lit("rest")))
    pooled = pooled.groupBy("_stratum", "_good", *rules).agg(F.sum("_n").alias("_n"))  # however many small strata there are

    def certify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = rows[rows["_good"]], rows[~rows["_good"]]
        firsts = [0] * (STEPS + 1)
        for k, n in zip(good[rules].min(axis=1), good["_n"], strict=True):
            firsts[int(k)] += int(n)
        passed = certified(firsts, allowed, error / strata)
        table = bad.groupby(rules)["_n"].sum()
        at = loosened([(tuple(map(int, k)), int(n)) for k, n in table.items()], passed, enough) or [None] * len(rules)
        out = {"_stratum": [key[0]], "n_good": [sum(firsts)], "n_certified": [passed]}
        out |= {r: [None if k is None else RULES[r][1][k]] for r, k in zip(rules, at, strict=True)}
        return pd.DataFrame(out).astype({r: "float64" for r in rules})

    schema = "_stratum string, n_good bigint, n_certified bigint, " + ", ".join(f"{r} double" for r in rules)
    return cut(pooled.groupBy("_stratum").applyInPandas(certify, schema))


def judge(counts: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """counts with base_failed, failed_rules (names) and kept. Without cutoffs at all the base rules judge alone.

    A null stratum is one; a stratum that was not certified by itself is judged as `rest`. Repeated rows are judged alike; an
    empty table gives an empty one. Columns named as the new ones are replaced, others of any name stay as they are.
    """
    few = cutoffs.count() <= MOST_STRATA
    own = cutoffs.filter("_stratum <> 'rest'").select("_stratum", F.lit(True).alias("_known"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    rest = cutoffs.filter("_stratum = 'rest'").agg(*[F.max(r).alias(r) for r in RULES]).first()
    figures = {f"_figure_{r}": F.expr(v) for r, (v, _) in RULES.items()}
    inner, back = fenced(counts, ["base_failed", "failed_rules", "kept"], _stratum=stratum_key(stratum), _base=base_failed(), **figures)
    met = inner.join(F.broadcast(own) if few else own, "_stratum", "left")
    limit = lambda r: F.when(F.col("_known"), F.col(f"_cut_{r}")).otherwise(F.lit(rest[r]).cast("double"))
    broken = F.array_compact(F.array(*[F.when(F.col(f"_figure_{r}") > limit(r), F.lit(r)) for r in RULES]))
    judged = met.withColumn("_broken", broken)
    return back(judged, F.col("_base").alias("base_failed"), F.col("_broken").alias("failed_rules"), (~F.col("_base") & (F.size("_broken") == 0)).alias("kept"))
