"""Ranked lexical search: the best documents for each item, by exact sparse inner products in ball trees.

A document's vector holds, for each term of the items, the term's weight times its integer saturation in the document; a query is 0 or 1 for
each term, and a score their inner product. Documents are dealt by ranges of their heaviest term, so that those that share a rare
term lie together; every few hundred of them make a ball tree: nodes with a centroid and the radius that holds their documents. No
document below a node scores more than query times centroid plus the query's length times the radius (rounded up by more than the doubles can
be wrong). The first pass builds the trees and follows each query to the most promising leaf of each, which gives every query a
score that ten documents reach; the second walks the trees best node first, leaves out whole subtrees that stay below
it, and scores what is left in 64-bit integers.

Items are taken in blocks of about BLOCK_TERMS terms, which bounds what is broadcast and what the driver holds; every document is met in every
block. Document frequencies and lengths are counted over all documents.
"""

from __future__ import annotations

import heapq
import math
import pickle
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import held, lower_ascii, named, slices
from .decontam import plain

#: ASCII letters and digits and everything beyond ASCII make terms; A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS = 200_000
SUBTREE_DOCS, SUBTREE_ENTRIES, LEAF_DOCS = 256, 1 << 19, 32
STRETCH = 4 << 20


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    flat, at = plain(text), 0
    while at < len(flat):
        end = flat.find(b" ", at + STRETCH) if at + STRETCH < len(flat) else -1
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The integers of all ranges start to start + len - 1, one range after the other."""
    total = int(lens.sum())
    return np.arange(total) + np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) if total else np.zeros(0, np.int64)


class Queries:
    """The items of a block: for each term the queries that hold it."""

    def __init__(self, names: Sequence, terms: Sequence[Sequence[str]]):
        self.names = list(names)
        self.words: dict[bytes, int] = {}
        held_terms = [[self.words.setdefault(t.encode(), len(self.words)) for t in own] for own in terms]
        pairs = np.array([(t, q) for q, own in enumerate(held_terms) for t in own], dtype=np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.count = np.bincount(pairs[:, 0], minlength=len(self.words))
        self.start = np.concatenate(([0], np.cumsum(self.count)))
        self.of = pairs[:, 1]
        self.norm = np.sqrt(np.array([len(own) for own in held_terms], dtype=float))

    def __len__(self) -> int:
        return len(self.names)

    def spread(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every query of every term: the place of the term, and the query."""
        lens = self.count[terms]
        return np.repeat(np.arange(len(terms)), lens), self.of[ranges(self.start[terms], lens)]

    def times(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Inner products of all queries with one sparse vector."""
        at, q = self.spread(terms)
        return np.bincount(q, weights=values[at], minlength=len(self))


class BallTree:
    """Ball tree over sparse integer vectors, given as entries (terms, values) from start to start of each document.

    Columns are numbered within the tree, and a centre is a mean rounded to single precision, since a tree is written and read: radii are those
    around the rounded centre.
    """

    def __init__(self, ids: Sequence, start: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int = LEAF_DOCS):
        self.ids, self.start = list(ids), start
        self.columns, local = np.unique(terms, return_inverse=True)
        self.local = local.astype(np.uint16 if len(self.columns) <= 1 << 16 else np.uint32)
        self.values = values
        self.order = np.arange(len(self.ids))
        #: (first, last, left child, right child, columns of the centre, its values, radius); leaves have no children.
        self.nodes: list[tuple] = []
        lens = np.diff(start)
        self._real = values.astype(float)
        self._squares = np.bincount(np.repeat(np.arange(len(lens)), lens), weights=self._real**2, minlength=len(lens))
        if self.ids:
            self._grow(0, len(self.ids), leaf)
        del self._real, self._squares

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.start[rows + 1] - self.start[rows]
        return np.repeat(np.arange(len(rows)), lens), ranges(self.start[rows], lens)

    def _distances(self, rows: np.ndarray, at: np.ndarray, e: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, float]:
        """Squares of the distances to a point, and more than they can be wrong by."""
        size = float((point * point).sum())
        inner = np.bincount(at, weights=self._real[e] * point[self.local[e]], minlength=len(rows))
        return self._squares[rows] - 2 * inner + size, 1e-11 * (size + float(self._squares[rows].max()))

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(len(self.columns))
        own = slice(self.start[row], self.start[row + 1])
        out[self.local[own]] = self._real[own]
        return out

    def _grow(self, first: int, last: int, leaf: int) -> int:
        rows = self.order[first:last]
        at, e = self.entries(rows)
        centroid = (np.bincount(self.local[e], weights=self._real[e], minlength=len(self.columns)) / len(rows)).astype(np.float32)
        far, slack = self._distances(rows, at, e, centroid.astype(float))
        some = np.flatnonzero(centroid).astype(self.local.dtype)
        number = len(self.nodes)
        self.nodes.append(())
        radius = math.sqrt(max(float(far.max()), 0.0) + slack)
        left = right = -1
        if len(rows) > leaf:
            one, _ = self._distances(rows, at, e, self._dense(rows[int(far.argmax())]))
            two, _ = self._distances(rows, at, e, self._dense(rows[int(one.argmax())]))
            nearer = np.argsort(one - two, kind="stable")
            middle = int((one < two).sum())
            middle = middle if leaf // 4 <= middle <= len(rows) - leaf // 4 else len(rows) // 2
            self.order[first:last] = rows[nearer]
            left = self._grow(first, first + middle, leaf)
            right = self._grow(first + middle, last, leaf)
        self.nodes[number] = (first, last, left, right, some, centroid[some], radius)
        return number

    def bounds(self, number: int, queries: Queries) -> np.ndarray:
        """For each query more than any document below the node scores."""
        *_, columns, values, radius = self.nodes[number]
        return (queries.times(self.columns[columns], values.astype(float)) + queries.norm * radius) * (1 + 1e-9) + 1

    def scores(self, number: int, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a leaf, and their exact scores for each query."""
        rows = self.order[self.nodes[number][0] : self.nodes[number][1]]
        at, e = self.entries(rows)
        place, q = queries.spread(self.columns[self.local[e]])
        out = np.zeros(len(rows) * len(queries), np.int64)
        np.add.at(out, at[place] * len(queries) + q, self.values[e][place])
        return rows, out.reshape(len(rows), len(queries))


class Best:
    """The k best documents of each query so far; floor: scores that k documents are known to reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.top = k, [[] for _ in range(queries)]
        self.floor = np.ones(queries, np.int64) if floor is None else np.maximum(floor, 1)

    def meet(self, ids: Sequence, rows: np.ndarray, scores: np.ndarray, active: np.ndarray) -> None:
        for row, q in zip(*np.nonzero((scores >= self.floor) & active), strict=True):
            own, name, score = self.top[q], ids[rows[row]], int(scores[row, q])
            insort(own, (-score, name is None, name if name is not None else 0))
            if len(own) > self.k:
                own.pop()
            if len(own) == self.k:
                self.floor[q] = max(self.floor[q], -own[-1][0])

    def dive(self, tree: BallTree, queries: Queries) -> None:
        """Each query's most promising leaf: at every node on to the child of the higher bound."""
        stack = [(0, np.ones(len(queries), bool))]
        while stack:
            number, active = stack.pop()
            left, right = tree.nodes[number][2:4]
            if left < 0:
                self.meet(tree.ids, *tree.scores(number, queries), active)
                continue
            here = tree.bounds(left, queries) >= tree.bounds(right, queries)
            stack += [(n, a) for n, a in ((left, active & here), (right, active & ~here)) if a.any()]

    def search(self, tree: BallTree, queries: Queries) -> int:
        """All documents that may be among the best, nodes of the highest bound over its query's floor first; how many leaves were scored."""
        heap, leaves = [(0.0, 0, tree.bounds(0, queries))], 0
        while heap:
            _, number, bounds = heapq.heappop(heap)
            active = bounds >= self.floor
            if not active.any():
                continue
            left, right = tree.nodes[number][2:4]
            if left < 0:
                leaves += 1
                self.meet(tree.ids, *tree.scores(number, queries), active)
                continue
            for child in (left, right):
                low = np.where(active, np.minimum(tree.bounds(child, queries), bounds), -1.0)
                if (low >= self.floor).any():
                    heapq.heappush(heap, (-float((low / self.floor).max()), child, low))
        return leaves


def item_blocks(items: DataFrame, item_id: str, text: str, block_terms: int) -> tuple[DataFrame, int]:
    """(id, terms, block): each item's terms, once each; rows equal in id and text are one item."""
    split = items.select(named(item_id).alias("id"), named(text).alias("t")).dropDuplicates()
    terms = held(split.select("id", F.xxhash64("id", "t").alias("h"), F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("t")), F.lit(f"({TERM})"))).alias("terms")).filter(F.size("terms") > 0))
    blocks = max(1, -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    return terms.withColumn("block", F.pmod("h", F.lit(blocks))), blocks


def vectors(docs: DataFrame, shared, kind: T.DataType) -> DataFrame:
    """(id, n, terms, tfs): a document's terms of the queries with their counts, and n, its terms in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.words.get
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text"):
                n, found = 0, []
                for words in words_of(text.as_py()):
                    n += len(words)
                    found += [v for v in map(get, words) if v is not None]
                terms, tfs = np.unique(np.array(found, dtype="<u4"), return_counts=True)
                rows.append((n, terms.tobytes(), tfs.astype("<u4").tobytes()))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("n bigint, terms binary, tfs binary").fields]))


def frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term: at most BLOCK_TERMS numbers or one item's."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype="<u4"), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in found.select("terms").mapInArrow(add, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def valued(batch: pa.RecordBatch, weights: np.ndarray, docs: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each document, terms, values) of a batch of vectors: weight times saturation, those of 0 left out."""
    parts = batch.column("terms").to_pylist()
    lens = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    terms = np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int64)
    tfs = np.frombuffer(b"".join(batch.column("tfs").to_pylist()), dtype="<u4").astype(np.int64)
    m = np.repeat(np.array([10 + 90 * n * docs // length for n in batch.column("n").to_pylist()], dtype=np.int64), lens)
    values = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))
    keep = values > 0
    row = np.repeat(np.arange(len(lens)), lens)[keep]
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(lens))))), terms[keep], values[keep]


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, subtree_docs: int = SUBTREE_DOCS, leaf_docs: int = LEAF_DOCS
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending doc_id, null last.

    A null or empty text has no terms; such items have no row, such documents count nowhere; repeated rows of docs are
    documents of their own, rows of items equal in id and text one item; empty tables give an empty one. Texts may be of any length; other
    columns don't matter.
    """
    if doc_id == item_id:
        raise ValueError("doc_id and item_id need different names")
    spark = docs.sparkSession
    parts, blocks = item_blocks(items, item_id, item_text, block_terms)
    inner = docs.select(named(doc_id).alias("id"), named(text).alias("text"))
    kind, item_kind = inner.schema["id"].dataType, parts.schema["id"].dataType
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("item", item_kind), T.StructField("id", kind), T.StructField("score", T.LongType())])
    tree_schema = T.StructType([*schema.fields, T.StructField("tree", T.BinaryType())])
    best_first = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    arrow = [pa.int64(), to_arrow_type(item_kind), to_arrow_type(kind), pa.int64()]

    def rows_of(best: Best, names: Sequence) -> pa.RecordBatch:
        flat = [(q, names[q], None if null else name, -score) for q, own in enumerate(best.top) for score, null, name in own]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate(arrow)], names=schema.names)

    out = None
    for block in range(blocks):
        own = parts.filter(F.col("block") == block).select("id", "terms").collect()
        queries = Queries([r["id"] for r in own], [r["terms"] for r in own])
        shared = spark.sparkContext.broadcast(queries)
        found = held(vectors(inner, shared, kind))
        counts = found.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        n_docs, length = counts["docs"], counts["length"] or 1
        df = frequencies(found, len(queries.words))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)

        def key(batches: Iterator[pa.RecordBatch], weights=weights, n_docs=n_docs, length=length) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                start, terms, values = valued(batch, weights, n_docs, length)
                row = np.repeat(np.arange(len(start) - 1), np.diff(start))
                last = np.lexsort((values, row))[start[1:][np.diff(start) > 0] - 1]
                kept = batch.take(pa.array(row[last], pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(terms[last], pa.int64())], names=[*batch.schema.names, "heavy"])

        def build(batches: Iterator[pa.RecordBatch], weights=weights, n_docs=n_docs, length=length, shared=shared) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            best = Best(len(queries), k)
            for batch in slices(batches, "terms", 4 * SUBTREE_ENTRIES):
                for at in range(0, batch.num_rows, subtree_docs):
                    piece = batch.slice(at, subtree_docs)
                    tree = BallTree(piece.column("id").to_pylist(), *valued(piece, weights, n_docs, length), leaf_docs)
                    best.dive(tree, queries)
                    empty = [pa.nulls(1, t) for t in arrow]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array([pickle.dumps(tree, protocol=5)], pa.binary())], names=tree_schema.names)
            hits = rows_of(best, queries.names)
            yield pa.RecordBatch.from_arrays([*hits.columns, pa.nulls(hits.num_rows, pa.binary())], names=tree_schema.names)

        keyed = found.filter(F.octet_length("terms") > 0).mapInArrow(key, T.StructType([*found.schema.fields, T.StructField("heavy", T.LongType())]))
        dealt = keyed.repartitionByRange("heavy", F.xxhash64("id", "terms")).sortWithinPartitions("heavy").drop("heavy")
        trees = held(dealt.mapInArrow(build, tree_schema))
        seeds = trees.filter("tree IS NULL").select(*schema.names)
        floor = np.zeros(len(queries), np.int64)
        reached = seeds.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") == k)
        for r in reached.select("q", "score").toLocalIterator():
            floor[r["q"]] = r["score"]

        def search(batches: Iterator[pa.RecordBatch], shared=shared, floor=floor) -> Iterator[pa.RecordBatch]:
            best = Best(len(shared.value), k, floor)
            for batch in batches:
                for blob in batch.column("tree"):
                    best.search(pickle.loads(blob.as_py()), shared.value)
            yield rows_of(best, shared.value.names)

        hits = held(trees.filter("tree IS NOT NULL").select("tree").mapInArrow(search, schema))
        ranked = hits.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
        result = ranked.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
        out = result if out is None else out.unionByName(result)
    return out

