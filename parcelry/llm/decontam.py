"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton's letters are words. A document's words stream through it; at each word it gives the length of the
longest run, ending here, that some item holds. A run of `window` words or more covers windows; an item shorter than a
window counts when it occurs whole. Covered words are hit; spans of hit words over the limits are removed.

Items are dealt into blocks of about BLOCK_WORDS words, an item longer than that in overlapping pieces. Each block's automaton is built
once, in a task, and kept in the shared folder; one block at a time is broadcast, which bounds what the driver and a worker
hold. A benchmark of one block takes one pass over the documents; of more, a pass for each, which keeps the hits alone, and
one that joins them to the documents by the text's hash.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fenced, held, lower_ascii, slices
from .linededup import hash128

#: ASCII letters and digits and everything beyond ASCII make words; A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
BLOCK_WORDS = 200_000
SPAN = "array<struct<first: bigint, last: bigint>>"
NEW = f"n_words bigint, n_hit bigint, hit_items array<string>, spans {SPAN}, clean_text string, coverage double"


def plain(text: str | None) -> bytes:
    """The text as bytes, lower-cased, separators turned to spaces; every byte keeps its place."""
    return text.encode().translate(TABLE) if text else b""


class ItemAutomaton:
    """Suffix automaton of many word sequences, with the items that hold each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window, self.words = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        self.shortest = min((min(len(words), window) for _, words in self.items), default=window)
        ends = []
        for _, words in self.items:
            last = 0
            for w in words:
                last = self._extend(last, w)
            ends.append(last)
        self._name_windows(ends)

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, w)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][w]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._clone(at, to, w)
        return new

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, at: int, to: int, w: int) -> int:
        twin = self._state(dict(self.next[to]), self.length[at] + 1, self.link[to])
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = twin
            at = self.link[at]
        self.link[to] = twin
        return twin

    def _name_windows(self, ends: list[int]) -> None:
        """owners: of the state of each window the items; whole: of the state of each short item its length and items."""
        self.owners: dict[int, set[int]] = {}
        self.whole: dict[int, tuple[int, set[int]]] = {}
        for k, (_, words) in enumerate(self.items):
            if len(words) < self.window:
                self.whole.setdefault(ends[k], (len(words), set()))[1].add(k)
                continue
            for _, state in self._stream(words):
                if state is not None:
                    self.owners.setdefault(state, set()).add(k)
        self.short = [False] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.short[state] = state in self.whole or self.short[max(self.link[state], 0)]

    def _stream(self, words: Iterable[int]) -> Iterator[tuple[int, int | None]]:
        """After each word the longest match, and the state of the last `window` words if it is that long."""
        state = matched = 0
        for w in words:
            state, matched = self._step(state, matched, w)
            yield matched, self._window_state(state, matched)

    def _step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        following = self.next
        to = following[state].get(w)
        while to is None:
            if state == 0:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]
            to = following[state].get(w)
        return to, matched + 1

    def _window_state(self, state: int, matched: int) -> int | None:
        if matched < self.window:
            return None
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches (first word, word after the last), which may overlap, and the names of the items hit."""
        ids = np.fromiter(map(self.words.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        hits, found = [], set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = matched = 0
            for at, w in enumerate(ids[a:b].tolist(), a + 1):
                state, matched = self._step(state, matched, w)
                if matched >= self.window:
                    hits.append((at - matched, at))
                    found |= self.owners[self._window_state(state, matched)]
                if self.short[state]:
                    inner = state
                    while inner > 0:
                        if inner in self.whole and self.whole[inner][0] <= matched:
                            hits.append((at - self.whole[inner][0], at))
                            found |= self.whole[inner][1]
                        inner = self.link[inner]
        return hits, {self.items[k][0] for k in found}


def merged(stretches: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans of hit words, in order; stretches that touch are one span."""
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(TABLE))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def item_pieces(items: DataFrame, id_col: str, text: str, window: int, block_words: int) -> DataFrame:
    """(id, t, n): items that have a word; one of more than block_words words in pieces that share window - 1 words with the next."""
    words = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"({WORD})"))
    split = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), words.alias("w")).filter(F.size("w") > 0)
    most = max(block_words, window)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1), F.lit(most - window + 1))
    pieces = split.withColumn("at", F.explode(F.when(F.size("w") > most, starts).otherwise(F.array(F.lit(1)))))
    part = F.when(F.size("w") > most, F.slice("w", F.col("at"), F.lit(most))).otherwise(F.col("w"))
    return pieces.select("id", F.array_join(part, " ").alias("t"), F.size(part).cast("long").alias("n"))


def build_automata(items: DataFrame, id_col: str, text: str, window: int, block_words: int) -> tuple[DataFrame, int]:
    """(block, automaton) in the shared folder, and how many: each built once, from items dealt by hash."""
    pieces = item_pieces(items, id_col, text, window, block_words)
    blocks = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        own = ItemAutomaton([(i, plain(t).split()) for i, t in sorted(zip(rows["id"].to_pylist(), rows["t"].to_pylist(), strict=True))], window)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([pickle.dumps(own, protocol=5)], pa.binary())})

    placed = pieces.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(max(blocks, 1))))
    built = cut(placed.groupBy("block").applyInArrow(build, "block bigint, automaton binary"))
    return built, built.count()


def found_in(automaton: ItemAutomaton, text: str | None) -> tuple[list[tuple[int, int]], set[str]]:
    words = plain(text).split()
    return automaton.scan(words) if len(words) >= automaton.shortest else ([], set())


def columns_of(text: str | None, stretches: Iterable[tuple[int, int]], names: Iterable[str], span_limit: int, coverage_limit: float) -> tuple:
    """The values of NEW."""
    n_words, spans = len(plain(text).split()), merged(stretches)
    n_hit = sum(b - a for a, b in spans)
    cover = n_hit / n_words if n_words else 0.0
    gone = [x for x in spans if x[1] - x[0] >= span_limit or cover > coverage_limit]
    return n_words, n_hit, sorted(names), [{"first": a, "last": b - 1} for a, b in spans], without(text, gone) if gone else text, cover


def scan_benchmark(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    span_limit: int = 10,
    coverage_limit: float = 0.5,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs with n_words, n_hit, hit_items (sorted ids as strings), spans (first and last word), clean_text, coverage.

    clean_text lacks the spans of span_limit words or more; beyond coverage_limit of all words it lacks every span. A null text
    has no words and a null clean_text; an item without words, or null, matches nothing; items with one id are one
    item, a null id is the id ''; no item at all leaves documents as they are; repeated rows are scanned alike, an empty table gives
    an empty one. Columns of docs named as the new ones are replaced, others of any name stay as they are.
    """
    spark = docs.sparkSession
    automata, blocks = build_automata(items, item_id, item_text, window, block_words)
    inner, back = fenced(docs, [f.name for f in T.StructType.fromDDL(NEW).fields], _text=F.col(text))
    schema = T.StructType([*inner.schema.fields[:-1], *T.StructType.fromDDL(NEW).fields])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string(), pa.float64()]
    names = schema.names

    def finished(batch: pa.RecordBatch, held_columns: int, hits: Iterable[tuple]) -> pa.RecordBatch:
        rows = [columns_of(t, *h, span_limit, coverage_limit) for t, h in zip(batch.column("_text").to_pylist(), hits, strict=True)]
        made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns[:held_columns], *made], names=names)

    def shared(block: int):
        return spark.sparkContext.broadcast(automata.orderBy("block").offset(block).first()["automaton"])

    if blocks <= 1:
        only = shared(0) if blocks else None

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = pickle.loads(only.value) if only else ItemAutomaton([], window)
            for batch in slices(batches, "_text"):
                yield finished(batch, len(batch.columns) - 1, (found_in(automaton, t.as_py()) for t in batch.column("_text")))

        return back(inner.mapInArrow(scan, schema), *[f.name for f in T.StructType.fromDDL(NEW).fields])

    keyed = docs.select(F.col(text).alias("_text"), *[h.alias(n) for h, n in zip(hash128(F.col(text)), ("_t1", "_t2"), strict=True)])
    hit_schema = "_t1 bigint, _t2 bigint, _hits array<struct<a: bigint, b: bigint>>, _names array<string>"
    passes = None
    for block in range(blocks):
        one = shared(block)

        def hits_of(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            automaton = pickle.loads(one.value)
            for batch in slices(batches, "_text"):
                found = [found_in(automaton, t.as_py()) for t in batch.column("_text")]
                at = [k for k, (hits, _) in enumerate(found) if hits]
                some = batch.take(pa.array(at, pa.int64()))
                hits = pa.array([[{"a": a, "b": b} for a, b in found[k][0]] for k in at], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                yield pa.RecordBatch.from_arrays([some.column("_t1"), some.column("_t2"), hits, pa.array([sorted(found[k][1]) for k in at], pa.list_(pa.string()))], names=["_t1", "_t2", "_hits", "_names"])

        kept = held(keyed.mapInArrow(hits_of, hit_schema).groupBy("_t1", "_t2").agg(F.any_value(F.struct("_hits", "_names")).alias("_x")))
        one.destroy()
        passes = kept if passes is None else passes.unionByName(kept)
    together = passes.groupBy("_t1", "_t2").agg(F.flatten(F.collect_list("_x._hits")).alias("_hits"), F.array_distinct(F.flatten(F.collect_list("_x._names"))).alias("_names"))
    met = inner.withColumns(dict(zip(("_t1", "_t2"), hash128(F.col("_text")), strict=True))).join(together, ["_t1", "_t2"], "left")
    wide = met.select(*inner.columns[:-1], "_text", "_hits", "_names")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            hits = zip(batch.column("_hits").to_pylist(), batch.column("_names").to_pylist(), strict=True)
            yield finished(batch, len(batch.columns) - 3, (([(x["a"], x["b"]) for x in h or ()], n or ()) for h, n in hits))

    return back(wide.mapInArrow(finish, schema), *[f.name for f in T.StructType.fromDDL(NEW).fields])


def items_digest(hit_items: Column) -> Column:
    """SHA-256, in lower-case hex, of the ids joined by commas."""
    return F.sha2(F.array_join(hit_items, ","), 256)


def digest_of(ids: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def runs(mask: Iterable[bool]) -> list[tuple[int, int]]:
    """Stretches of True as (first, after the last)."""
    out, at = [], 0
    for value, group in groupby(mask):
        n = len(list(group))
        if value:
            out.append((at, at + n))
        at += n
    return out
