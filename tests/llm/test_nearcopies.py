"""Near copies of the pipeline against brute force over 5-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
import parcelry.llm.nearcopies as nc
from parcelry.llm.nearcopies import near_copy_groups

DOCS = "doc_id bigint, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest id of each id's component; ids are unique."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = 0
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (both / (len(sets[a]) + len(sets[b]) - both) >= 0.8 if both else not sets[a] and not sets[b]):
                linked += sets[a] != sets[b]
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}, linked


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def made(rng, originals, copies, edits):
    rows = [(9001, None), (9002, " \n"), (9003, "one two"), (9004, "One  Two"), (9005, "one two three")]
    for k in range(originals):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 400))]
        rows += [(k * 1000 + c, edited(words, round(rng.random() * edits * len(words)), rng) if c else " ".join(words)) for c in range(copies)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,originals,copies,short", [(1, 12, 5, 30), (2, 2, 70, 8)])
def test_groups_equal_brute_force(spark, seed, originals, copies, short):
    rows = made(random.Random(seed), originals, copies, 0.05)
    want, linked = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(spark.createDataFrame(rows, DOCS), short=short).collect()}
    assert linked > 10 and got == want


def test_chains_past_the_pivot(spark):
    """Each text is like the next alone, so that in a long bucket most links are none of the pivot's; three chains stay apart."""
    rng, rows = random.Random(5), []
    for chain in range(3):
        words = [f"c{chain}w{rng.randrange(10**6)}" for _ in range(320)]
        rows += [(chain * 100 + k, " ".join(words[8 * k : 8 * k + 160])) for k in range(18)]
    want, _ = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(spark.createDataFrame(rows, DOCS), short=2).collect()}
    assert got == want and set(want.values()) == {0, 100, 200}


def test_one_of_each_edited_copy_stays(spark):
    rows = made(random.Random(3), 6, 3, 0.02)
    want = sorted(set(brute(rows)[0].values()))
    assert sorted(r["doc_id"] for r in cp.near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()) == want and len(want) < len(rows) - 4


def plain_print(text):
    """Bit by bit: 1 if more than half of the distinct shingles' mixed hashes have it."""
    import numpy as np

    hashes, keep = nc.shingle_set(text.lower().encode().split(), 5).tolist(), (1 << 64) - 1
    bits = []
    for salt, factor, last in zip(nc._SALTS.tolist(), nc._FACTORS.tolist(), nc._LAST.tolist(), strict=True):
        mixed = []
        for h in hashes:
            m = ((h ^ salt) * factor) & keep
            m = ((m ^ m >> 29) * last) & keep
            mixed.append(m ^ m >> 32)
        bits += [2 * sum(m >> k & 1 for m in mixed) > len(mixed) for k in range(64)]
    return np.array(bits)


def test_search_is_simhash_with_a_tally_of_positional_bytes(spark):
    """Prints follow the definition; each pair's tally is the number of lists (three positions, same bytes) that the two share."""
    from itertools import combinations

    rng = random.Random(11)
    words = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts = [" ".join(words), edited(words, 4, rng), edited(words, 6, rng), " ".join(f"v{rng.randrange(500)}" for _ in range(280))]
    once = nc.add_nodes(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], DOCS), "text", 5, "print")
    rows = {r["_node"]: r for r in once.collect()}
    bytes_of = {}
    for r in rows.values():
        bits = plain_print(texts[r["doc_id"]])
        assert [v & ((1 << 64) - 1) for v in r["_print"]] == [sum(int(b) << k for k, b in enumerate(bits[at : at + 64])) for at in range(0, len(bits), 64)]
        bytes_of[r["_node"]] = [tuple(bits[at : at + 8]) for at in range(0, len(bits), 8)]
    want = {}
    for a, b in combinations(sorted(rows), 2):
        same = [x == y for x, y in zip(bytes_of[a], bytes_of[b], strict=True)]
        if n := sum(same[p[0]] and same[p[x]] and same[p[y]] for p in nc._POSITIONS.tolist() for x, y in combinations(range(1, 9), 2)):
            want[a, b] = n
    got = {(r["a"], r["b"]): r["n"] for r in nc.met(nc.postings(once), 0.8, 8).filter("_key = 0").groupBy("a", "b").agg(F.sum("_n").alias("n")).collect()}
    assert got == want and len(want) >= 3


@pytest.mark.parametrize("short", [1, 8])
def test_pairs_at_the_bound_are_found(spark, short):
    """Pairs at exactly 0.8, of 4 against 5 shingles up to 180 against 180; none just below links."""
    rng, rows, fresh = random.Random(13), [], iter(range(10**7))
    new = lambda n: [f"z{next(fresh)}" for _ in range(n)]
    for k in range(150):
        n = 4 if k < 50 else 9 * rng.randrange(1, 21)
        both = new(n + 4 if n == 4 else n // 9 * 8 + 4)
        more = 1 if n == 4 else n // 9
        rows += [(4 * k, " ".join(both + ([] if n == 4 else new(more)))), (4 * k + 1, " ".join(both + new(more)))]
        below = new(n + 4)
        rows += [(4 * k + 2, " ".join(below)), (4 * k + 3, " ".join(below + new(n // 4 + 1)))]
    want, linked = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(spark.createDataFrame(rows, DOCS), short=short).collect()}
    assert linked == 150 and got == want


def test_a_large_group_costs_no_pairs(spark, monkeypatch):
    """500 copies of one text, from alike to far apart, and 30 texts like some of them: few pairs are left to compare, and no link is lost."""
    rng, made_of, count = random.Random(17), [f"w{k}" for k in range(150)], []
    rows = [(0, " ".join(made_of))]
    for k in range(1, 500):
        at = rng.sample(range(150), rng.randrange(1, 13))
        rows.append((k, " ".join(f"x{k}y{p}" if p in at else w for p, w in enumerate(made_of))))
    for k in range(30):
        rows.append((1000 + k, edited(rows[rng.randrange(500)][1].split(), rng.randrange(1, 4), rng)))
    rng.shuffle(rows)
    close = nc.close

    def counted(pairs, prints):
        count.append(pairs.count())
        return close(pairs, prints)

    monkeypatch.setattr(nc, "close", counted)
    want, linked = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and linked > 2000 and len(set(want.values())) > 100
    assert sum(count) < 20 * len(rows)


def test_bounds_of_a_crowd_lose_no_pair(spark):
    """Pairs of a crowd that neither share a root nor break a bound are made, with texts outside the crowd all."""
    import numpy as np

    rng, words = random.Random(19), [f"w{k}" for k in range(100)]
    texts = [" ".join(words)] + [edited(words, 1, rng) for _ in range(5)]
    once = nc.add_nodes(spark.createDataFrame(list(enumerate(texts)), DOCS), "text", 5, "print").orderBy("doc_id")
    posted = nc.postings(once).toPandas()
    order = np.argsort(posted["_at"].to_numpy() >> 32, kind="stable")
    at, rest, node = (posted[c].to_numpy()[order] for c in ("_at", "_rest", "_node"))
    nodes = [r["_node"] for r in once.collect()]

    def pairs(*about):
        found = nc.meet(at, rest, node, np.array([about[nodes.index(x)] for x in node.tolist()]), 0.8, 3)
        return {frozenset((nodes.index(a), nodes.index(b))) for a, b in zip(found[1].tolist(), found[2].tolist(), strict=True)}

    out, p = (-1, -1, -1, -1), nodes[0]
    every = {frozenset((a, b)) for a in range(6) for b in range(a)}
    assert pairs(out, out, out, out, out, out) == every
    # 1 and 2 of one root; 3 has too little that others have; 4 and 5 share at most 60 + 10 with the pivot's texts, or go by another.
    held = pairs((1, 96, p, 96), (1, 96, p, 92), (1, 96, p, 92), (2, 70, p, 70), (3, 96, p, 60), out)
    assert held == {frozenset(x) for x in [(0, 5), (1, 5), (2, 5), (3, 5), (4, 5)]}
    other = pairs((1, 96, p, 96), (1, 96, p, 92), (1, 96, p, 92), (2, 70, p, 70), (3, 96, nodes[1], 60), out)
    assert other == held | {frozenset(x) for x in [(0, 4), (1, 4), (2, 4)]}
