"""Packing documents into sequences of a fixed length.

A document is its token ids and an end id. Its whole sequences are pieces of their own; what is left of it, shorter than a sequence, is
one piece more. The histogram of piece lengths (at most `length` numbers, whatever the corpus) is a cutting-stock problem:
patterns of lengths that fill a sequence, each used so often that all pieces are placed at least padding. Column generation
solves its linear program: a knapsack over the dual prices finds the patterns worth adding. The counts are rounded down, the few pieces that
are left get patterns one after the other by exact subset sums, and pieces that no pattern takes are cut into powers of two, which
need no padding: a sequence whose length is a power of two is not padded.

Pieces of one length are ranked over the whole table, and ranks are dealt to patterns by arithmetic: a piece finds its sequence and its
place there from its length and rank alone. Texts are never shuffled.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import with_running
from .common import fenced, held, named, random_key, slices

LENGTH = 2048
#: Tokens of padding that are worth as much as cutting a piece of nearly a sequence's length; a shorter one costs less, by its square.
CUT_PRICE = 16.0
#: The linear program ends when no solution can be better by more than this share.
GAP = 1e-3
#: It ends, too, when so many rounds have gained less than a tenth of that; the plan is whole all the same, and what the program leaves is placed after it.
PATIENCE = 20
#: Bounds of a worker's memory: words remembered, their length, and characters that are split at a time.
REMEMBERED, REMEMBERED_CHARS, STRETCH = 400_000, 48, 1 << 20
#: A tokenizer's file is broadcast.
MOST_FILE_BYTES = 256 << 20

#: White space as Unicode has it (fixed values).
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ODD_SPACE = re.compile(f"^ | $| [{WHITE}]")
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: The split of byte-level BPE (fixed value).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary: printable bytes are their own, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Encoder:
    """Ids of texts under a tokenizer file of byte-level BPE, as little-endian 32-bit integers.

    A space before a word always begins a token, so that words can be remembered. New words go through merge ranks where the
    file's merges stand in the order of its ids; files of any other kind, and texts with an added token, go through the tokenizer.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        spec = json.loads(file)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.ranked = self.by_rank(spec)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def by_rank(spec: Mapping):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocabulary, added = model["vocab"], {t["content"] for t in spec.get("added_tokens") or ()}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [vocabulary[m] for m in merges]
        bytes_of = byte_of()
        own = {w: k for w, k in vocabulary.items() if w not in added}
        if ids != sorted(set(ids)) or len(own) != len(ids) + 256 or max(own[c] for c in bytes_of) > min(ids, default=1 << 60):
            return None
        import tiktoken

        ranks = {bytes(bytes_of[c] for c in w): k for w, k in own.items()}
        return tiktoken.Encoding("ranks", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})

    def fresh(self, text: str) -> bytes:
        ids = self.ranked.encode_ordinary(text) if self.ranked else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = self.fresh(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def stretch(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            words = CHUNK.findall(text)
            found = list(map(self.known.get, words))
        else:
            first, *rest = text.split(" ")
            words = [first, *[" " + w for w in rest]]
            found = list(map(self.known.get, words))
        if None in found:
            found = [self.word(w) if f is None else f for w, f in zip(words, found, strict=True)]
        return b"".join(found)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.ranked or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out, at = [], 0
        while at < len(text):
            end = at + STRETCH
            while end < len(text) and not (text[end] == " " and re.match(f"[^{WHITE}]", text[end + 1 : end + 2])):
                end += 1
            out.append(self.stretch(text[at:end]))
            at = end
        return b"".join(out)


# ---- the plan, from the histogram of lengths


def padded(filled: int, length: int) -> int:
    """What a sequence of so many tokens takes."""
    return filled if filled & (filled - 1) == 0 else length


def binary_parts(n: int) -> list[int]:
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def knapsack(lengths: np.ndarray, prices: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fill the highest sum of prices of lengths that add up to it exactly, and the last length taken (an index)."""
    best, last = np.full(length + 1, -np.inf), np.full(length + 1, -1)
    best[0] = 0.0
    price, index = np.full(length + 1, -np.inf), np.full(length + 1, -1)
    price[lengths], index[lengths] = prices, np.arange(len(lengths))
    for fill in range(1, length + 1):
        worth = best[fill - 1 :: -1] + price[1 : fill + 1] if fill > 1 else best[:1] + price[1:2]
        at = int(worth.argmax())
        best[fill], last[fill] = worth[at], index[at + 1]
    return best, last


def taken(fill: int, lengths: np.ndarray, last: np.ndarray) -> Counter:
    out: Counter = Counter()
    while fill:
        out[int(last[fill])] += 1
        fill -= int(lengths[last[fill]])
    return out


def solve(lengths: np.ndarray, demand: np.ndarray, length: int, cut_price: float = CUT_PRICE, gap: float = GAP) -> tuple[list[tuple[Counter, float]], float, float]:
    """The linear program by column generation: patterns (index of length -> pieces) with their counts, its cost, a lower bound of it.

    A pattern costs its padded length; a piece may instead be cut into powers of two, at its length and the price of the cut: these columns
    are the first basis, and as long pieces are the dearest to cut, they are the first to find company. No solution costs less than its tokens. A round prices every fill by one knapsack; the best pattern through each length then enters in turn while it still pays.
    """
    m = len(lengths)
    cost = lengths + np.where(lengths & (lengths - 1), cut_price * (lengths / length) ** 2, 0.0)
    basis: list[Counter | None] = [None] * m
    inverse, x, y = np.eye(m), demand.astype(float), cost.astype(float).copy()
    sizes = np.array([padded(s, length) for s in range(length + 1)], dtype=float)
    bound = total = float(lengths @ demand)
    costs: list[float] = []
    while len(costs) <= PATIENCE or costs[-PATIENCE - 1] - min(costs[-PATIENCE:]) > gap / 10 * bound:
        best, last = knapsack(lengths, y, length)
        total, ratio = float(y @ demand), float((best[1:] / sizes[1:]).max())
        bound = max(bound, total / max(1.0, ratio))
        if costs and not total <= costs[-1] * (1 + gap / 100):  # rounding errors have grown: what stands is good enough
            break
        costs.append(total)
        if total <= bound * (1 + gap) or ratio <= 1 + 1e-9:
            break
        powers = 1 << np.arange(length.bit_length())
        fills = np.where(lengths[:, None] <= powers, best[np.maximum(powers - lengths[:, None], 0)] + y[:, None] - powers, -np.inf)
        offers = [(float(fills[k].max()), int(powers[fills[k].argmax()] - lengths[k]), k) for k in range(m)]
        worst = int((best[1:] - sizes[1:]).argmax()) + 1
        offers.append((float(best[worst] - sizes[worst]), worst, -1))
        entered = 0
        for gain, fill, k in sorted(offers, reverse=True):
            if gain <= 1e-7:
                break
            pattern = taken(fill, lengths, last)
            if k >= 0:
                pattern[k] += 1
            rows, many = np.array(list(pattern)), np.array(list(pattern.values()), dtype=float)
            price = padded(int(lengths[rows] @ many), length)
            reduced = price - float(y[rows] @ many)
            if reduced >= -1e-7:
                continue
            d = (inverse[:, rows] * many).sum(axis=1)
            can = d > 1e-7
            steps = np.where(can, x / np.where(can, d, 1.0), np.inf)
            out = int(np.where(steps <= steps.min() + 1e-9, d, -np.inf).argmax())
            row = inverse[out] / d[out]
            touched = np.flatnonzero(np.abs(d) > 1e-12)
            inverse[touched] -= d[touched, None] * row
            inverse[out] = row
            step = steps[out]
            x -= step * d
            np.maximum(x, 0, out=x)
            x[out] = step
            y += reduced * row
            basis[out] = pattern
            entered += 1
        if not entered:
            break
    return [(b, float(v)) for b, v in zip(basis, x, strict=True) if b is not None], total, bound


def completion(first: int, left: Mapping[int, int], length: int) -> Counter | None:
    """Lengths that fill a sequence together with `first`, longest first, of those left; None if there are none."""
    goal, reach, steps = length - first, 1, []
    for n in sorted(left, reverse=True):
        many = min(left[n] - (n == first), goal // n)
        take = 1
        while many > 0:
            take = min(take, many)
            steps.append((n, take, reach))
            reach |= (reach << n * take) & ((1 << goal + 1) - 1)
            many, take = many - take, 2 * take
        if reach >> goal & 1:
            break
    if not reach >> goal & 1:
        return None
    out = Counter({first: 1})
    for n, take, before in reversed(steps):
        if not before >> goal & 1:
            out[n] += take
            goal -= n * take
    return out


class Plan:
    """How the pieces of each length are dealt.

    whole: (length, lo, hi, each, first, offset): ranks lo to hi - 1 go `each` to a sequence, from sequence `first` on, at `offset` there.
    cuts: length -> (lo, bases): ranks from lo on are cut into powers of two; the part of 2 ** b is number bases[b] + rank - lo of its size.
    """

    def __init__(self, histogram: Mapping[int, int], length: int = LENGTH, cut_price: float = CUT_PRICE, gap: float = GAP):
        if length < 2 or length & (length - 1):
            raise ValueError("length must be a power of two")
        self.length, self.whole, self.cuts = length, [], {}
        self.at, self.sequences = dict.fromkeys(histogram, 0), 0
        left = Counter({n: c for n, c in histogram.items() if c > 0})
        if left[length]:
            self.use({length: 1}, left[length], left)
        lengths = np.array(sorted(n for n in left if n < length and left[n]), dtype=np.int64)
        self.cost = self.bound = 0.0
        if len(lengths):
            patterns, self.cost, self.bound = solve(lengths, np.array([left[int(n)] for n in lengths], dtype=np.int64), length, cut_price, gap)
            for pattern, count in patterns:
                by_length = {int(lengths[k]): n for k, n in pattern.items()}
                self.use(by_length, min(int(count + 1e-6), *(left[n] // a for n, a in by_length.items())), left)
        for n in sorted(lengths.tolist(), reverse=True):
            while left[n]:
                pattern = completion(n, left, length)
                if pattern is None:
                    break
                self.use(pattern, min(left[k] // a for k, a in pattern.items()), left)
        seen: Counter = Counter()
        for n in sorted((n for n in left if left[n]), reverse=True):
            parts = binary_parts(n)
            self.cuts[n] = (self.at[n], [seen[p] for p in parts])
            seen.update({p: left[n] for p in parts})
        self.starts, total = {}, 0
        for p in sorted(seen, reverse=True):
            self.starts[p] = total
            total += p * seen[p]
        self.cut_total = total

    def use(self, pattern: Mapping[int, int], times: int, left: Counter) -> None:
        if times <= 0:
            return
        offset = 0
        for n in sorted(pattern, reverse=True):
            each = pattern[n]
            self.whole.append((n, self.at[n], self.at[n] + each * times, each, self.sequences, offset))
            self.at[n] += each * times
            left[n] -= each * times
            offset += n * each
        self.sequences += times


def place_of_cut(plan: Plan, position: Column) -> tuple[Column, Column]:
    """Sequence and offset of a place in the line of powers of two: whole sequences first, then the rest's own powers of two."""
    full, rest = divmod(plan.cut_total, plan.length)
    sequence, offset = F.lit(plan.sequences) + F.floor(position / plan.length), F.pmod(position, F.lit(plan.length))
    if rest:
        inside, start = position - full * plan.length, 0
        last_sequence, last_offset = F.lit(None).cast("long"), F.lit(None).cast("long")
        for k, part in enumerate(binary_parts(rest)):
            here = inside >= start
            last_sequence = F.when(here, F.lit(plan.sequences + full + k)).otherwise(last_sequence)
            last_offset = F.when(here, inside - start).otherwise(last_offset)
            start += part
        sequence, offset = F.when(inside >= 0, last_sequence).otherwise(sequence), F.when(inside >= 0, last_offset).otherwise(offset)
    return sequence.cast("long"), offset.cast("long")


# ---- pieces and their places

PIECES = "doc_tokens bigint, start bigint, length bigint, ids_crc32 bigint, part_crcs array<bigint>"


def document_pieces(ids: bytes, length: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(start, length, CRC-32, CRC-32 of each power of two of it if it is shorter than a sequence) of the pieces of a document."""
    view, n = memoryview(ids), len(ids) // 4
    for start in range(0, n, length):
        size = min(length, n - start)
        crcs, at = [], start
        for part in binary_parts(size) if size < length else ():
            crcs.append(zlib.crc32(view[4 * at : 4 * (at + part)]))
            at += part
        yield start, size, zlib.crc32(view[4 * start : 4 * (start + size)]), crcs


def pieces_of(docs: DataFrame, file: str, end_id: int, length: int, text: str) -> DataFrame:
    """docs without text, a row for each piece, with the columns of PIECES."""
    if len(file) > MOST_FILE_BYTES:
        raise ValueError(f"a tokenizer's file of more than {MOST_FILE_BYTES} bytes isn't broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(file)
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*rest, *T.StructType.fromDDL(PIECES).fields])
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [f.name for f in schema.fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in slices(batches, text):
            rows: list[tuple] = []
            for k, t in enumerate(batch.column(text)):
                ids = encoder.ids(t.as_py()) + end
                rows += [(k, len(ids) // 4, *piece) for piece in document_pieces(ids, length)]
            of = pa.array([r[0] for r in rows], pa.int64())
            made = [pa.array([r[c] for r in rows], pa.list_(pa.int64()) if c == 5 else pa.int64()) for c in range(1, 6)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(of) for f in rest], *made], names=names)

    return docs.mapInArrow(cut, schema)


def small(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A table of the plan: longs, and lists of them."""
    kinds = [pa.list_(pa.int64()) if n == "_bases" else pa.int64() for n in names]
    return spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))}))


def pack(
    docs: DataFrame, tokenizer: str, ids: Sequence[Column] = (), end_id: int = 1, length: int = LENGTH, text: str = "text", seed: int = 31, cut_price: float = CUT_PRICE, gap: float = GAP
) -> DataFrame:
    """A row for each piece: docs's columns but text, and start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer is the content of a tokenizer file; strings of its added tokens in a text are those tokens. A null text is empty; an empty
    text has the end id alone; a text of any length is cut into whole sequences and a rest. ids tell documents apart in the ranking: rows equal in
    all of them and in a piece are interchangeable. An empty table gives an empty one. Columns of docs named as the new ones are
    replaced, others of any name stay. sequence_id is unique, not gapless.
    """
    spark, new = docs.sparkSession, ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    keys = [f"_id{k}" for k in range(len(ids))]
    inner, back = fenced(docs, [*new, text], _text=named(text), **dict(zip(keys, ids, strict=True)))
    outer = [c for c in inner.columns if c.startswith("_u")]
    pieces = held(pieces_of(inner, tokenizer, end_id, length, "_text"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, length, cut_price, gap)

    ranked = with_running(pieces, ["length"], [random_key(seed, *[F.col(k) for k in keys], F.col("start"), F.col("ids_crc32")), *[F.col(k) for k in keys], F.col("start")], position="_pos")
    ranked = ranked.withColumn("_rank", F.col("_pos") - 1)
    # At most `length` lengths, each in as many patterns as there are lengths and some more: the plan grows with `length`, not with the corpus.
    whole = small(spark, ["length", "_lo", "_hi", "_each", "_first", "_off"], plan.whole)
    cuts = small(spark, ["length", "_lo", "_bases"], [(n, lo, bases) for n, (lo, bases) in plan.cuts.items()])
    met = ranked.join(F.broadcast(whole.withColumnRenamed("length", "_l")), (F.col("length") == F.col("_l")) & F.col("_rank").between(F.col("_lo"), F.col("_hi") - 1))
    turn = F.col("_rank") - F.col("_lo")
    placed = met.select(
        *outer, "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.floor(turn / F.col("_each"))).alias("sequence_id"), (F.col("_off") + F.pmod(turn, F.col("_each")) * F.col("length")).alias("offset")
    )
    powers = [1 << b for b in reversed(range(length.bit_length() - 1))]
    parts = F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: F.expr("length").bitwiseAND(p) != 0)
    lost = ranked.join(F.broadcast(cuts.withColumnRenamed("length", "_l")), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_lo"))).withColumn("_parts", parts)
    one = lost.select("*", F.posexplode(F.arrays_zip("_parts", "_bases", "part_crcs")).alias("_k", "_x"))
    before = F.aggregate(F.slice("_parts", F.lit(1), F.col("_k")), F.lit(0).cast("long"), lambda a, p: a + p)
    starts = F.coalesce(*[F.when(F.col("_x._parts") == p, F.lit(s)) for p, s in plan.starts.items()], F.lit(0)).cast("long")
    sequence, offset = place_of_cut(plan, starts + (F.col("_x._bases") + F.col("_rank") - F.col("_lo")) * F.col("_x._parts"))
    split = one.select(*outer, (F.col("start") + before).alias("start"), F.col("_x._parts").alias("length"), F.col("_x.part_crcs").alias("ids_crc32"), "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"))
    return back(placed.unionByName(split), *new)

