"""Mixing, sharding and line dedup against brute force, with the awkward cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelry.llm import queries
from parcelry.llm.common import word_count
from parcelry.llm.linededup import LineRuns, drop_frequent_lines, sorted_scans
from parcelry.llm.mixing import mix_sources, repeat_rows
from parcelry.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards

DOCS = "doc_id bigint, text string, source string"
AWKWARD = [(1, None, "b"), (2, "", None), (3, "x " * 5000, "a"), (4, "same text", "b"), (4, "same text", "b"), (None, "no id", "a"), (5, "\t\n\x0b", "é"), (6, "a b c", "é")]


def mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS).withColumn("n", word_count(F.col("text")))
    return mix_sources(df, F.col("n"), ids=[F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))], **options)


def fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing until none is above its cap."""
    open_, left, out = dict(sizes), share * sum(sizes.values()), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * open_[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        for s in over:
            del open_[s]
    return out


def test_mixing_reaches_targets(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(1, 40), rng.choice("aaaaaabbcdé")) for k in range(600)] + AWKWARD
    got = mixed(spark, rows, rows_per_block=10).collect()
    assert len(got) == len(rows)
    names = sorted({r["source"] for r in got if r["source"] is not None}) + [None]
    sizes = {s: sum(r["size"] for r in got if r["source"] == s) for s in names}
    targets = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(targets[s]) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= max((r["size"] for r in own), default=0) / 2 + 1e-6
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    again = mixed(spark, rows[::-1], rows_per_block=50).collect()
    key = lambda r: (str(r["doc_id"]), r["taken"], r["size"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert repeat_rows(mixed(spark, rows), ["doc_id"]).count() == sum(r["copies"] for r in got)


def test_mixing_of_nothing(spark):
    assert mixed(spark, []).count() == 0
    assert {r["taken"] for r in mixed(spark, [(1, None, None), (2, "", None)]).collect()} == {0}
    clash = spark.createDataFrame([(1, "a b", "s", 9.0, 9)], DOCS + ", target double, taken int")
    assert mix_sources(clash, word_count(F.col("text")), ids=[F.col("doc_id")]).columns.count("target") == 1


def test_hypergeometric_has_its_mean_and_range():
    rng = random.Random(1)
    draws = [hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert min(draws) >= 0 and max(draws) <= 20
    assert sum(draws) / 4000 == pytest.approx(6, abs=0.15)
    assert sum((d - 6) ** 2 for d in draws) / 4000 == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.1)
    assert hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric(rng, 0, 5, 3) == 0
    assert 0 <= hypergeometric(rng, 10**10, 3 * 10**10, 10**6) <= 10**6


def test_matrix_has_exact_margins():
    counts = [5, 0, 17, 1, 9, 100]
    matrix = communication_matrix(counts, 7, 4)
    assert [sum(r) for r in matrix] == counts
    assert Counter(sum(c) for c in zip(*matrix, strict=True)) == Counter([19, 19, 19, 19, 19, 19, 18])


def test_shards_are_exact_and_random(spark):
    rows = [(k, f"t{k % 50}", "s") for k in range(900)] + AWKWARD
    df = spark.createDataFrame(rows, DOCS)
    ids = [F.col("doc_id"), F.col("text")]
    got = shuffle_into_shards(df, 8, ids, bytes_per_partition=3000).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and set(by) == set(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = shuffle_into_shards(df.repartition(5), 8, ids, bytes_per_partition=3000).collect()
    key = lambda r: (r["shard"], r["slot"], str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    place = [r["slot"] for r in sorted((r for r in got if r["doc_id"] is not None), key=lambda r: r["doc_id"])]
    n = len(place)
    mean = sum(place) / n
    lag = sum((a - mean) * (b - mean) for a, b in zip(place, place[1:], strict=False)) / sum((a - mean) ** 2 for a in place)
    assert abs(lag) < 0.12
    assert shuffle_into_shards(spark.createDataFrame([], DOCS), 8, ids).count() == 0
    assert shuffle_into_shards(df.limit(3), 8, ids).count() == 3


def dropped(rows, least, chars):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(space))
    count = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and count[key(x)] >= least)]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(8)
    pool = ["Header", " header\t", "ÉCOLE", "école", "", "  ", "once", "x" * 300, "A B"]
    rows = [(k, "\n".join(rng.choice([*pool, f"own {k} {j}"]) for j in range(rng.randrange(12))), "s") for k in range(80)] + AWKWARD
    for batches in (1, 4, 5):
        got = drop_frequent_lines(spark.createDataFrame(rows, DOCS), 4, 1, batches).collect()
        show = lambda r: (str(r[0]), *r[1:])
        assert sorted(show((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"])) for r in got) == sorted(map(show, dropped(rows, 4, 1)))


def test_line_dedup_of_nothing_and_clashes(spark):
    assert drop_frequent_lines(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a", 7, 8, 9, 10, 11)], "doc_id bigint, text string, n_lines int, _lost int, _t1 int, _lines int, _u0 int")
    got = drop_frequent_lines(clash).first().asDict()
    assert got == {"doc_id": 1, "text": "a", "n_lines": 1, "_lost": 8, "_t1": 9, "_lines": 10, "_u0": 11, "n_dropped": 0, "kept_text": "a"}


def test_clashing_columns_stay(spark):
    mine = {"_key": 1, "_offset": 2, "_skey": 3, "_block": 4, "_part": 5, "_u1": 6, "_at": 7, "size": 8, "Shard": 9, "a.b": 10}
    df = spark.createDataFrame([(k, "some words here", "s", *mine.values()) for k in range(5)], DOCS + "".join(f", `{c}` int" for c in mine))
    mixed = mix_sources(df, F.col("size"), ids=[F.col("doc_id")]).collect()
    assert all({c: r[c] for c in mine} == mine for r in mixed) and all(r["size"] == 8 for r in mixed)
    dealt = shuffle_into_shards(df, 2, [F.col("doc_id")])
    assert "Shard" not in dealt.columns and dealt.columns.count("shard") == 1
    assert all({c: r[c] for c in mine if c != "Shard"} == {c: v for c, v in mine.items() if c != "Shard"} for r in dealt.collect())


def test_merges_and_anti_joins_use_the_order_of_runs(spark):
    runs = LineRuns(spark, 3, buckets=4)
    texts = spark.createDataFrame([(k, "\n".join(f"line {j}" for j in range(k, k + 50))) for k in range(40)], "k int, text string")
    one, two, three = runs.batches(texts, F.col("k") % 3, 3)
    runs.add_run(one)
    runs.add_run(two)
    with sorted_scans(spark):
        runs.settled[0].count()
        for plan in (runs.merged(two, three), runs.without_settled(three)):
            shown = plan._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in shown and "Exchange" not in shown and "Sort [" not in shown, shown
    runs.add_run(three)
    count = Counter(j for k in range(40) for j in range(k, k + 50))
    assert runs.frequent().distinct().count() == sum(n >= 3 for n in count.values())
    runs.close()


def test_runs_answer_what_is_new(spark):
    runs = LineRuns(spark, 2)
    old, new = (spark.createDataFrame([(t,)], "text string") for t in ("a\nb", "B\nc\nd"))
    assert runs.unseen(old).count() == 2
    runs.add(old)
    assert runs.unseen(new).count() == 2


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = queries.QUERIES[name](spark, d)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(show, r)) for r in cursor.fetchall())
    assert sorted(tuple(show(r[c]) for c in columns) for r in df.collect()) == want


def test_sharding_query_columns(spark):
    rows = queries.op2_sharding(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    import zlib

    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_line_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
