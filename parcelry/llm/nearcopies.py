"""Near copies by the Jaccard similarity of word shingles.

The search is operator 7's, with a print wide enough for similarity 0.8: SimHash, an inverted index of positional bytes, a tally of each pair
over all lists, a minimum, verification, components.

Print: BYTES * 8 bits, each 1 if more than half of the shingles' hashes have it. Two texts of similarity 0.8 (a cosine of 0.89) differ in
15 % of the bits and agree in 27 % of the bytes; MOST_APART is 5 deviations above.

Index: a list is of three positions with their bytes. LISTS sets of nine positions are drawn once; a text is posted under the first byte of each, with
the other eight beside it, and their 28 pairs make the lists of that bucket. A bucket hands on the pairs of texts that meet in LEAST_MET of its
lists (four equal bytes), with their number; these are tallied over all buckets. At exactly 0.8 a pair gets there nowhere with probability
7 in a million (0.9^LISTS, for independent bytes), and what meets by chance shrinks with 32 bits, not with 24. What is left is verified
by the bits, then by the shingle sets themselves. Sets of up to SMALL shingles, for whose prints the 15 % don't hold, are also
joined exactly: similar ones of different size differ by one shingle.

Texts fold by their words first, so exact copies are one entry. A large group of near copies would still meet in pairs. So the lists of the first
CROWD_LISTS buckets are looked through before: where more than SHORT texts meet, each of them is compared with a pivot alone, the one with
most company (an original is closer to its copies than they are to each other). Of the texts so compared, the crowd, all lists then make the pairs
that may still link: not those linked already, nor those that exact bounds rule out. A shingle that no other text of the crowd has is
shared with none; and two texts share at most what both share with one pivot and what each has beside it. Pairs with texts outside the crowd
are all made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices
from .simhash import components

BYTES = 256
LISTS = 112
CROWD_LISTS = 16
LEAST_MET = 3
MOST_APART = 391
SHORT = 8
SMALL = 8
#: Pairs that a task looks at, or adds up, at once.
PAIRS = 1 << 22
#: Postings that a task looks through at once; a bucket (texts with the same byte at the same place) is never parted.
CHUNK = 200_000
#: At most so many texts' keys are broadcast to fetch what belongs to them; beyond it, a shuffled join.
BROADCAST_TEXTS = 200_000
_DRAW = np.random.Generator(np.random.PCG64(7))
_SALTS, _FACTORS, _LAST = _DRAW.integers(0, 1 << 63, (3, BYTES // 8), np.uint64) * np.uint64(2) + np.uint64(1)
#: A word's hash is multiplied by its place in the shingle; the last mixes the sum.
_PLACE = _DRAW.integers(0, 1 << 63, 65, np.uint64) * np.uint64(2) + np.uint64(1)
_POSITIONS = np.array([_DRAW.choice(BYTES, 9, replace=False) for _ in range(LISTS)])


def folded(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; a shorter text is one shingle."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    each, n = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), len(words) - width + 1
    mixed = sum(each[k : k + n] * _PLACE[k] for k in range(width))
    return np.unique((mixed ^ mixed >> np.uint64(32)) * _PLACE[-1])



def wide_print(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of BYTES * 8 bits, as longs. A shingle's bits are its hash, mixed anew for every 64 of them."""
    ones = np.zeros(BYTES * 8, np.int64)
    for at in range(0, len(shingles), 255):
        mixed = (shingles[at : at + 255, None] ^ _SALTS) * _FACTORS
        mixed ^= mixed >> np.uint64(29)
        mixed *= _LAST
        mixed ^= mixed >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)


def small_sums(shingles: np.ndarray) -> list[int]:
    """Of a set of up to SMALL shingles its sum (exclusive or), then the sums without one of them."""
    if not 0 < len(shingles) <= SMALL:
        return []
    whole = np.bitwise_xor.reduce(shingles)
    return np.append(whole, whole ^ shingles).view(np.int64).tolist()


def add_nodes(docs: DataFrame, text: str, width: int, kind: str) -> DataFrame:
    """docs without the text, with _node, the hash of its words (0 where there are none), and by kind _size, _print and _sums, or _set."""
    import xxhash

    held = [c for c in docs.columns if c != text]
    made = ["_print", "_sums"] if kind == "print" else ["_set"]
    fields = [T.StructField("_node", T.LongType()), T.StructField("_size", T.IntegerType())] + [T.StructField(c, T.ArrayType(T.LongType())) for c in made]
    schema = T.StructType([docs.schema[c] for c in held] + fields)
    names, longs = schema.names, pa.list_(pa.int64())

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            ids, sizes, one, two = [], [], [], []
            for t in batch.column(text):
                words = folded(t.as_py())
                ids.append(xxhash.xxh64_intdigest(b" ".join(words), 9) if words else 0)
                found = shingle_set(words, width)
                sizes.append(len(found))
                if kind == "set":
                    one.append(found.view(np.int64).tolist())
                else:
                    one.append(wide_print(found).tolist() if words else [])
                    two.append(small_sums(found))
            new = [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(one, longs)] + ([pa.array(two, longs)] if kind == "print" else [])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in held] + new, names=names)

    return docs.select(*held, text).mapInArrow(nodes, schema)


def postings(once: DataFrame, lists: int = LISTS) -> DataFrame:
    """(_at, _rest, _node), and _about where once has it: of each text `lists` rows. _at: list, byte and the text's size; _rest: the eight other bytes."""
    more = [c for c in ("_about",) if c in once.columns]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                print_bytes = some.column("_print").flatten().to_numpy().view(np.uint8).reshape(-1, BYTES)
                chosen, sizes = print_bytes[:, _POSITIONS[:lists]], some.column("_size").to_numpy().astype(np.int64)
                ats = (np.arange(lists) << 8 | chosen[:, :, 0].astype(np.int64)) << 32 | sizes[:, None]
                rest = np.ascontiguousarray(chosen[:, :, 1:]).reshape(-1, 8).view(np.int64)
                each = np.repeat(np.arange(some.num_rows), lists)
                new = [pa.array(x.reshape(-1)) for x in (ats, rest)] + [some.column(c).take(pa.array(each)) for c in ("_node", *more)]
                yield pa.RecordBatch.from_arrays(new, names=["_at", "_rest", "_node", *more])

    schema = "_at long, _rest long, _node long" + ", _about array<long>" * len(more)
    return once.filter("_size > 0").select("_node", "_size", "_print", *more).mapInArrow(post, schema)


def lists_of(at: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The lists of whole buckets, by pairs of positions: (rows, starts, n) of those with two texts or more, rows ascending in each."""
    one, rows = rest.view(np.uint8).reshape(-1, 8).astype(np.int64), np.arange(len(at))
    for x, y in combinations(range(8), 2):
        order = np.sort((at >> 32 << 16 | one[:, x] << 8 | one[:, y]) << 32 | rows)
        key = order >> 32
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(starts, len(key)))
        order, n = (order & 0xFFFFFFFF)[np.repeat(n, n) > 1], n[n > 1]
        yield order, np.cumsum(n) - n, n


def tallied(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    each, place = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_inverse=True)
    return each, np.bincount(place, np.concatenate([np.zeros(0, np.int64), *counts]), len(each)).astype(np.int64)


def meet(at: np.ndarray, rest: np.ndarray, node: np.ndarray, about: np.ndarray, similarity: float, least: int) -> tuple[np.ndarray, ...]:
    """The pairs (0, a, b, n) that meet in n >= least lists of whole buckets and may be similar.

    about: of each text of the crowd its root (the pivot, if it is linked to that, or itself), the number of its shingles that others of the crowd have, its pivot, and how many of these
    shingles the pivot has; -1 for others. A text of the crowd with too few such shingles meets none but those outside.
    """
    size, crowd = at & 0xFFFFFFFF, about[:, 1] >= 0
    kind = np.where(crowd, ~reachable(about[:, 1], size, about[:, 1], similarity), -1)
    kind, root = np.array([2, 1, 0])[kind + 1], np.where(crowd, about[:, 0], node)
    # In a list: texts that meet the outside alone, then the open ones, root by root, then the outside.
    first = np.lexsort((root, kind))
    at, rest, node, size, kind, root, crowd = (x[first] for x in (at, rest, node, size, kind, root, crowd))
    shared, pivot, near = about[first, 1:].T
    run = np.cumsum(np.append(0, (kind[1:] != kind[:-1]) | (root[1:] != root[:-1])))
    rows, codes, counts, waiting = len(at), [], [], 0
    for order, starts, n in lists_of(at, rest):
        if not len(order):
            continue
        turn = np.append(True, run[order][1:] != run[order][:-1])
        turn[starts] = True
        runs = np.diff(np.append(np.flatnonzero(turn), len(order)))
        end, outside = np.repeat(starts + n, n), np.repeat(np.add.reduceat(kind[order] == 2, starts, dtype=np.int64), n)
        begin = np.where(kind[order] == 0, end - outside, np.repeat(np.cumsum(runs), runs))
        many = end - begin
        total, at_once = np.cumsum(many), 0
        while at_once < len(order):
            done = total[at_once - 1] if at_once else 0
            upto = max(at_once + 1, int(np.searchsorted(total, done + PAIRS, "right")))
            m = many[at_once:upto]
            a = np.repeat(order[at_once:upto], m)
            b = order[np.repeat(begin[at_once:upto] - (np.cumsum(m) - m), m) + np.arange(len(a))]
            at_once = upto
            most = np.where(crowd[a] & crowd[b], np.minimum(shared[a], shared[b]), np.minimum(size[a], size[b]))
            by_pivot = np.minimum(near[a], near[b]) + np.minimum(shared[a] - near[a], shared[b] - near[b])
            most = np.where(crowd[a] & crowd[b] & (pivot[a] == pivot[b]), np.minimum(most, by_pivot), most)
            open_pair = reachable(most, size[a], size[b], similarity)
            a, b = a[open_pair], b[open_pair]
            codes.append(np.minimum(a, b) * rows + np.maximum(a, b))
            counts.append(np.ones(len(a), np.int64))
            waiting += len(a)
            if waiting > PAIRS:
                codes, counts = ([x] for x in tallied(codes, counts))
                waiting = 0
    pairs, lists = tallied(codes, counts)
    pairs, lists = pairs[lists >= least], lists[lists >= least]
    a, b = node[pairs // rows], node[pairs % rows]
    return np.zeros(len(pairs), np.int64), np.minimum(a, b), np.maximum(a, b), lists


def stars(at: np.ndarray, rest: np.ndarray, node: np.ndarray, short: int) -> tuple[np.ndarray, ...]:
    """(1, text, pivot, company) of whole buckets: each text of a list of more than `short` with the pivot of most company, once a bucket."""
    first = np.lexsort((node, at >> 32))
    at, rest, node = at[first], rest[first], node[first]
    company, best, long = np.zeros(len(at), np.int64), np.full(len(at), -1), []
    for order, starts, n in lists_of(at, rest):
        company[order] += np.repeat(n - 1, n)
        if (more := n > short).any():
            long.append((order[np.repeat(more, n)], n[more]))
    for order, n in long:
        most = np.maximum.reduceat(company[order] << 32 | order, np.cumsum(n) - n)
        best[order] = np.maximum(best[order], np.repeat(most, n))
    found = np.flatnonzero(best >= 0)
    return np.ones(len(found), np.int64), node[found], node[best[found] & 0xFFFFFFFF], best[found] >> 32


def met(posted: DataFrame, similarity: float, short: int, least: int = 1, crowded: bool = False) -> DataFrame:
    """(_key, a, b, _n) as meet(), or if crowded stars(), gives them, of all postings: dealt by bucket, sorted, looked through a few buckets at a time."""
    names = ["_key", "a", "b", "_n"]

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        about = np.full((batch.num_rows, 4), -1)
        if "_about" in batch.schema.names:
            known = batch.column("_about").is_valid().to_numpy(zero_copy_only=False)
            about[known] = batch.column("_about").drop_null().flatten().to_numpy().reshape(-1, 4)
        return [batch.column(k).to_numpy() for k in range(3)] + [about]

    def found(part: list[np.ndarray]) -> pa.RecordBatch:
        rows = stars(*part[:3], short) if crowded else meet(*part, similarity, least)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, enough = [], 0, CHUNK
        whole = lambda: [np.concatenate(x) for x in zip(*kept, strict=True)]
        for batch in batches:
            kept.append(columns(batch))
            waiting += batch.num_rows
            if waiting >= enough:
                part = whole()
                end = int(np.searchsorted(part[0] >> 32, part[0][-1] >> 32))
                if end:
                    yield found([x[:end] for x in part])
                kept, waiting = [[x[end:] for x in part]], waiting - end
                enough = max(CHUNK, 2 * waiting)
        if waiting:
            yield found(whole())

    dealt = posted.repartition(F.shiftright("_at", 32)).sortWithinPartitions("_at")
    return dealt.mapInArrow(look, "_key long, a long, b long, _n long")


def bits_apart(a: str, b: str) -> Column:
    """In how many bits two prints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def close(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prints differ in MOST_APART bits at most, and those of small sets."""
    for end in "ab":
        pairs = pairs.join(prints.select(F.col("_node").alias(end), F.col("_size").alias(f"_s{end}"), F.col("_print").alias(f"_p{end}")), end)
    return pairs.filter((F.greatest("_sa", "_sb") <= SMALL) | (bits_apart("_pa", "_pb") <= MOST_APART)).select("a", "b")


def small_pairs(once: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of up to SMALL shingles of which one is the other and one shingle more."""
    some = once.filter(F.size("_sums") > 0).select("_node", "_sums")
    whole = some.select(F.col("_node").alias("_x"), F.get("_sums", F.lit(0)).alias("_sum"))
    less = some.filter(F.size("_sums") > 5).select(F.col("_node").alias("_y"), F.explode(F.slice("_sums", 2, SMALL)).alias("_sum"))
    return whole.join(less, "_sum").filter("_x <> _y").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with _k, the number of shingles they share, and _x and _y, the numbers they have."""
    left, right = sets.select(F.col("_node").alias("a"), F.col("_set").alias("_sa")), sets.select(F.col("_node").alias("b"), F.col("_set").alias("_sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("_k"), F.size("_sa").alias("_x"), F.size("_sb").alias("_y"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    return overlaps(pairs, sets).filter(F.col("_k") / (F.col("_x") + F.col("_y") - F.col("_k")) >= similarity).select("a", "b")


def reachable(most_shared: Column, x: Column, y: Column, similarity: float) -> Column:
    """Whether sets of sizes x and y that share most_shared at best can have the similarity."""
    return most_shared * (1 + similarity) >= (x + y) * similarity - 1e-9


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_TEXTS else df


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct()


def candidate_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, text: str, width: int) -> DataFrame:
    """(_node, _size, _set) of the nodes, from one text of each."""
    texts = rows.join(nodes, "_node", "left_semi").groupBy("_node").agg(F.min("_text").alias("_text")).select("_text")
    own = docs.join(few(cut(texts)), "_text", "left_semi").dropDuplicates(["_text"])
    return cut(add_nodes(own.select(text), text, width, "set"))


def lone_shingles(sets: DataFrame) -> DataFrame:
    """(_node, _lone): of each text with such ones the number of shingles that no other text has."""
    each = sets.select("_node", F.explode("_set").alias("_s"))
    return each.groupBy("_s").agg(F.count("*").alias("_n"), F.min("_node").alias("_node")).filter("_n = 1").groupBy("_node").agg(F.count("*").cast("int").alias("_lone"))


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5, short: int = SHORT) -> DataFrame:
    """(id_col, component_id): the smallest id reachable over pairs of texts with that similarity of their shingle sets.

    A row for each row of docs. Texts with the same words, case aside, are similar; so are all texts without words. Null ids count for
    nothing in a component's smallest id; an empty table gives an empty one.
    """
    if similarity < 0.8 or not 1 <= width <= 64:
        raise ValueError("lists and prints are laid out for similarities of 0.8 and more, shingles of up to 64 words")
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_body"), F.xxhash64(text).alias("_text"))
    made = cut(add_nodes(docs, "_body", width, "print"))
    rows = made.select("_id", "_text", "_node")
    ids = rows.groupBy("_node").agg(F.min("_id").alias("_least"))
    once = cut(made.groupBy("_node").agg(*[F.max(c).alias(c) for c in ("_size", "_print", "_sums")]))
    crowd, links = crowded(docs, rows, once, similarity, width, short)
    posted = postings(once if crowd is None else once.join(few(crowd), "_node", "left"))
    found = met(posted, similarity, short, LEAST_MET).groupBy("a", "b").agg(F.sum("_n").alias("_met")).filter(F.col("_met") >= LEAST_MET).select("a", "b")
    pairs = cut(found.unionByName(small_pairs(once)).distinct())
    pairs = cut(close(pairs, once.join(few(cut(ends(pairs))), "_node", "left_semi")))
    linked = verified(pairs, candidate_sets(docs, rows, ends(pairs), "_body", width), similarity)
    roots = cut(components(linked if links is None else linked.unionByName(links)))
    grouped = ids.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_root", F.coalesce("root", "_node"))
    least = grouped.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return rows.select(F.col("_id").alias(id_col), "_node").join(grouped.join(least, "_root").select("_node", "component_id"), "_node").drop("_node")


def crowded(docs: DataFrame, rows: DataFrame, once: DataFrame, similarity: float, width: int, short: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(_node, _about) of the texts that meet in lists of more than `short`, as meet() takes it, and their links (a, b); None where there are none."""
    star = cut(met(postings(once, CROWD_LISTS), similarity, short, crowded=True).filter("a <> b").select(F.col("a").alias("_node"), F.col("b").alias("_pivot")).distinct())
    if star.isEmpty():
        return None, None
    pull = cut(star.groupBy("_pivot").agg(F.count("*").alias("_pull")))
    # Each text's pivot is the one with most texts; a pivot goes with the one it has itself, so that a group ends at one.
    each = star.join(pull, "_pivot").select("_node", "_pull", "_pivot").unionByName(pull.select(F.col("_pivot").alias("_node"), "_pull", "_pivot"))
    best = cut(each.groupBy("_node").agg(F.max(F.struct("_pull", "_pivot"))["_pivot"].alias("_pivot")))
    above = best.select(F.col("_node").alias("_pivot"), F.col("_pivot").alias("_above"))
    best = cut(best.join(above, "_pivot").select("_node", F.col("_above").alias("_pivot")))
    sets = candidate_sets(docs, rows, best.select("_node"), "_body", width)
    tried = star.unionByName(best.filter("_node <> _pivot")).select(F.least("_node", "_pivot").alias("a"), F.greatest("_node", "_pivot").alias("b")).distinct()
    tried = cut(overlaps(tried, sets))
    linked = F.col("_k") / (F.col("_x") + F.col("_y") - F.col("_k")) >= similarity
    paired = best.withColumns({"a": F.least("_node", "_pivot"), "b": F.greatest("_node", "_pivot")}).join(tried.withColumn("_linked", linked), ["a", "b"], "left")
    about = paired.join(sets.select("_node", F.size("_set").alias("_size")), "_node").join(lone_shingles(sets), "_node", "left")
    shared = F.col("_size") - F.coalesce("_lone", F.lit(0))
    # All that a pivot has is near itself, but for what none other has.
    near = F.coalesce("_k", shared)
    values = [F.when(F.col("_linked"), F.col("_pivot")).otherwise(F.col("_node")), shared, F.col("_pivot"), near]
    return cut(about.select("_node", F.array(*[v.cast("long") for v in values]).alias("_about"))), tried.filter(linked).select("a", "b")
