"""Multilingual mixture inference.

Training counts byte n-grams of labelled documents by language, hashed into BUCKETS. A document's words are drawn from
a mixture of languages: a word's likelihood under each comes from its n-grams, and expectation-maximisation estimates the
document's proportions. The language set grows from the best single language, in the order of the proportions, while the
log-likelihood gains more than a penalty; the prediction is the largest proportion within the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fenced, named, slices

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Bytes of ASCII letters lower-cased, other ASCII as a space, the rest as it is.
TABLE = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: The model learns from about so many distinct texts of each language, chosen by hash; fewer if there are fewer.
SAMPLE_DOCS = 2000
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 3.0
#: Bytes of text worked on at once; longer texts are taken in pieces that end between words.
PIECE = 1 << 20
PAD = b"    "


def grams(buffer: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of n-grams (of the letter after each start) and, by order, their buckets. n-grams begin at a space or letter before a letter."""
    wide = buffer.astype(np.uint32)
    last = len(buffer) - max(ORDERS) + 1
    places = np.flatnonzero(buffer[1:last] != 0x20)
    codes = wide[places]
    out = []
    for n in range(1, max(ORDERS)):
        codes = codes * np.uint32(0x9E3779B1) + wide[places + n]
        if n + 1 in ORDERS:
            mixed = codes ^ (codes >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B)
            out.append(((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64))
    return places + 1, out


def letters(text: str | None) -> bytes:
    """The text's words of letters, one space between, padded so that no n-gram meets a neighbouring text."""
    words = text.encode().translate(TABLE).split() if text else []
    return PAD + b" ".join(words) + PAD


def pieces(plain: bytes) -> Iterator[bytes]:
    at = 0
    while len(plain) - at > PIECE:
        end = plain.rfind(b" ", at + 1, at + PIECE)
        end = plain.find(b" ", at + PIECE) if end <= at else end
        if end < 0:
            break
        yield PAD + plain[at:end].strip() + PAD
        at = end
    yield PAD + plain[at:].strip() + PAD


@dataclass
class Model:
    """Languages, and by order and bucket the log-probabilities."""

    langs: list[str]
    logs: np.ndarray

    @classmethod
    def of(cls, langs: list[str], counts: np.ndarray) -> Model:
        """counts: languages x orders x buckets."""
        smooth = counts + SMOOTHING
        return cls(langs, np.ascontiguousarray(np.log(smooth / smooth.sum(axis=2, keepdims=True)).transpose(1, 2, 0), np.float32))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (words x languages) and the text of each word."""
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        places, buckets = grams(buffer)
        if not len(places):
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        total = self.logs[0][buckets[0]]
        for table, b in zip(self.logs[1:], buckets[1:], strict=True):
            total = total + table[b]
        first = np.flatnonzero(buffer[places - 1] == 0x20)
        ends = np.cumsum([len(t) for t in texts])
        return np.add.reduceat(total, first, axis=0) / np.float32(len(ORDERS)), np.searchsorted(ends, places[first], side="right")


def proportions(like: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for each document (its words from starts on): mixing proportions over its allowed languages, and log-likelihood.

    like: words x languages, scaled so that each word's largest is 1.
    """
    mix = allowed / allowed.sum(axis=1, keepdims=True)
    owner = np.repeat(np.arange(len(starts)), sizes)
    total = np.zeros(len(starts))
    for k in range(ROUNDS):
        joint = like * mix[owner].astype(np.float32)
        each = joint.sum(axis=1)
        total = np.add.reduceat(np.log(np.maximum(each, 1e-30, dtype=np.float64)), starts)
        joint /= np.maximum(each, np.float32(1e-30))[:, None]
        new = np.add.reduceat(joint, starts, axis=0).astype(np.float64) / sizes[:, None]
        moved = np.abs(new - mix).max()
        mix = new
        if moved < 1e-3 and k:
            break
    return mix, total


def infer(model: Model, texts: list[bytes]) -> list[tuple[int, float, np.ndarray]]:
    """Of each text its main language (-1 without words), score and proportions."""
    size = len(model.langs)
    none = (-1, 0.0, np.zeros(size))
    if not size:
        return [none] * len(texts)
    found: list[np.ndarray] = [np.zeros((0, size), np.float32)] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            like, owner = model.words([texts[k] for k in group])
            bounds = np.searchsorted(owner, np.arange(len(group) + 1))
            for j, k in enumerate(group):
                found[k] = like[bounds[j] : bounds[j + 1]]
        group, held = [], 0

    for k, t in enumerate(texts):
        if len(t) > PIECE:
            found[k] = np.concatenate([model.words([p])[0] for p in pieces(t)])
            continue
        group.append(k)
        held += len(t)
        if held > PIECE:
            flush()
    flush()
    out: list[tuple[int, float, np.ndarray]] = [none] * len(texts)
    batch: list[int] = []
    count = 0
    for k in [*range(len(texts)), None]:
        if k is not None and len(found[k]):
            batch.append(k)
            count += len(found[k])
        if batch and (k is None or count > 200_000):
            for j, r in zip(batch, mixtures(np.concatenate([found[j] for j in batch]), np.array([len(found[j]) for j in batch])), strict=True):
                out[j] = r
            batch, count = [], 0
    return out


def mixtures(logs: np.ndarray, sizes: np.ndarray) -> list[tuple[int, float, np.ndarray]]:
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rows = np.arange(len(sizes))
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - top)
    alone = np.add.reduceat((logs - top).astype(np.float64), starts, axis=0)
    full, _ = proportions(like, starts, sizes, np.ones((len(sizes), logs.shape[1])))
    full[rows, alone.argmax(axis=1)] += 2.0  # the best single language comes first
    order = np.argsort(-full, axis=1, kind="stable")
    best = order[:, 0]
    mix = np.zeros_like(full)
    mix[rows, best] = 1.0
    reached = alone[rows, best]
    growing = rows
    for k in range(1, logs.shape[1]):
        growing = growing[full[growing, order[growing, k]] > 0.02]
        if not len(growing):
            break
        allowed = np.zeros((len(growing), logs.shape[1]))
        np.put_along_axis(allowed, order[growing, : k + 1], 1.0, axis=1)
        chosen = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in growing])
        some = sizes[growing]
        new, total = proportions(like[chosen], np.concatenate(([0], np.cumsum(some)[:-1])), some, allowed)
        better = total - reached[growing] > PENALTY + 0.5 * np.log(some)
        growing, new, total = growing[better], new[better], total[better]
        mix[growing], reached[growing] = new, total
    second = np.partition(alone, -2, axis=1)[:, -2] if logs.shape[1] > 1 else np.full(len(sizes), -np.inf)
    sure = 1 / (1 + np.exp(np.clip(second - alone.max(axis=1), -50, 0)))
    main = mix.argmax(axis=1)
    return [(int(m), float(min(1.0, mix[r, m] * sure[r])), mix[r]) for r, m in enumerate(main)]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text", lang: str = "lang") -> Model:
    """Model of the labelled rows (null labels and texts left out). Each language's share of texts is chosen by their hash, so
    that about sample_docs remain; the driver gets n-gram counts, languages times orders times BUCKETS at most.

    Repeated texts count once, so that copies neither weigh more nor push others out; an empty table gives a model of no language.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    langs = sorted(sizes)
    counts = np.zeros((len(langs), len(ORDERS), BUCKETS))
    if not langs:
        return Model([], counts)
    share = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(min(1.0, sample_docs / max(1, sizes[name]))))])
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).dropDuplicates(["lang", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(name, np.zeros((len(ORDERS), BUCKETS), np.int64))
                for p in pieces(letters(t)):
                    for k, b in enumerate(grams(np.frombuffer(p, np.uint8))[1]):
                        own[k] += np.bincount(b, minlength=BUCKETS)
        for name, own in held.items():
            order, bucket = np.nonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(order)), pa.array(order.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(own[order, bucket])], names=["lang", "size", "bucket", "n"]
            )

    summed = some.mapInArrow(count, "lang string, size int, bucket int, n bigint").groupBy("lang", "size", "bucket").agg(F.sum("n").alias("n")).toArrow()
    at = {name: k for k, name in enumerate(langs)}
    counts[[at[x] for x in summed["lang"].to_pylist()], summed["size"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return Model.of(langs, counts)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, without the text, with lang_pred, score and mixture (language to proportion, of the chosen set).

    Texts that are null or have no letter, and all texts if nothing was learned, are `und` with score 0. Repeated rows
    are predicted alike, of equal languages the first by name; an empty table gives an empty one. Columns of docs named as
    the new ones are replaced, others of any name stay.
    """
    new = ["lang_pred", "score", "mixture"]
    inner, back = fenced(docs, [*new, text], _text=named(text), _letters=has_letter(named(text)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = inner.schema.fields[:-2]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "_text"):
            worded = batch.column("_letters").to_pylist()
            found = infer(model, [letters(t) if w else PAD for t, w in zip(batch.column("_text").to_pylist(), worded, strict=True)])
            single = model.langs[0] if model.langs else "und"
            names = [model.langs[m] if m >= 0 else single if w else "und" for (m, _, _), w in zip(found, worded, strict=True)]
            mixture = [[(model.langs[k], float(p)) for k, p in enumerate(mix) if p > 0] for _, _, mix in found]
            columns = [batch.column(f.name) for f in fields]
            columns += [pa.array(names, pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array(mixture, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + new)

    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    return back(inner.mapInArrow(predict, out), *new)
