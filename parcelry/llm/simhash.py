"""SimHash near-dedup.

Fingerprints: a bit is 1 if more than half of the document's 3-word shingle hashes have it. Two fingerprints that
differ in at most `bits` bits share at least 8 - bits of their 8 positional bytes.

Search: an inverted index of positional bytes with count filtering. Lists of a single byte would be 2048 whatever the size of the
corpus, and their pairs its square; a posting is therefore a set of positions with their bytes, and all sets of one
size are posted. Each pair that meets is tallied over all lists: m equal positional bytes meet in C(m, size) of them, so pairs
below the count that the guaranteed minimum of equal bytes gives are dropped, and the rest is verified bit by bit. Sets are
as large as leaves the tally something to tell: one byte short of the guaranteed minimum.

Documents fold into distinct fingerprints first, so a group of copies, however large, is one entry. Links between
fingerprints are joined into components by large-star and small-star rounds of joins, each cut by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fenced, slices

BYTES = 8
#: Shingles whose bits are in memory at once.
CHUNK = 50_000


def text_fingerprint(text: bytes, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    width = min(width, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - width + 1]
    ends = ends[width - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        some = [digest(plain[a:b], 42) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """docs, without the text, with _fp, the fingerprint as a signed long; a text without words, or null, has 0."""
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("_fp", text)] + [T.StructField("_fp", T.LongType())])
    held = [f.name for f in schema.fields[:-1]]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [text_fingerprint(t.encode() if t else b"", width) for t in (x.as_py() for x in batch.column(text))]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in held] + [fps], names=[*held, "_fp"])

    return docs.select(*held, text).mapInArrow(prints, schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def mask_of(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def links(fingerprints: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct _fp that differ in 1 to `bits` bits, once each."""
    if not 0 <= bits < BYTES:
        raise ValueError("bytes guarantee nothing for so many bits")
    equal = BYTES - bits
    size = max(1, equal - 1)
    masks = [mask_of(s) for s in combinations(range(BYTES), size)]
    posted = fingerprints.select("_fp", F.posexplode(F.array(*[F.col("_fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("_set", "_bytes"))
    left, right = posted.withColumnRenamed("_fp", "a"), posted.withColumnRenamed("_fp", "b")
    met = left.join(right, ["_set", "_bytes"]).filter("a < b")
    tallied = met.groupBy("a", "b").agg(F.count("*").alias("_met")).filter(F.col("_met") >= comb(equal, size))
    return tallied.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Large-star: each node's larger neighbours are tied to its smallest one. Small-star: each node and its smaller
    neighbours are tied to the smallest of them. At the fixed point every component is a star on its smallest node.
    Each round aggregates minima and joins them back; no neighbour list is ever gathered.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        after = cut(small.filter("u <> v").distinct())
        same = now.join(after, ["u", "v"], "left_semi").count()
        done = same == now.count() == after.count()
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v", "v").distinct().toDF("node", "root"))


def near_duplicates(docs: DataFrame, bits: int = 2, width: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, without the text, with fingerprint (16 hex digits) and component_id (the smallest id reachable over links, itself included).

    Null and empty texts have fingerprint zero and link like any other; null ids count for nothing in a component's
    smallest id (a component of null ids alone has a null one); repeated rows share everything; an empty table gives an
    empty one. Columns of docs named as the new ones are replaced, others of any name stay as they are.
    """
    inner, back = fenced(docs, ["fingerprint", "component_id", text], _id=F.col(id_col), _text=F.col(text))
    slim = cut(add_fingerprints(inner, "_text", width))
    distinct = cut(slim.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = components(links(distinct.select("_fp"), bits))
    grouped = distinct.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("_root", F.coalesce("root", "_fp"))
    least = grouped.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = grouped.join(least, "_root").select("_fp", "component_id")
    return back(slim.join(named, "_fp"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
