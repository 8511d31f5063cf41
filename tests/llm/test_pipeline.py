"""The pipeline's stages, one by one, against plain versions on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from parcelry.llm.decontam import plain
from test_nearcopies import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(None, "lonely text without an id " * 12, "en", "src0", 3), (10**9, None, None, None, None), (10**9 + 1, "", "en", None, 0)]
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    return base.unionByName(spark.createDataFrame(extra, base.schema)).cache()


def test_quality_keeps_columns_and_clean_documents(spark, docs):
    kept = cp.quality(spark, docs, DATA)
    assert kept.columns == docs.columns
    good = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").join(docs.filter("n_chars > 600"), "doc_id")
    assert good.join(kept, "doc_id", "left_semi").count() >= 0.9 * good.count()


def test_one_of_each_group_stays(spark, docs):
    twice = docs.unionByName(docs.filter("doc_id % 5 = 0")).unionByName(docs.filter("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 10**6))
    kept = cp.near_copies(spark, twice, DATA)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in twice.collect()}
    nobody = texts.pop(None)
    least = brute(list(texts.items()))[0]
    got = [r["doc_id"] for r in kept.collect()]
    assert nobody and sorted(x for x in got if x is not None) == sorted(set(least.values())) and got.count(None) == 1


def test_stages_keep_the_users_columns(spark, docs):
    """Columns named as anything that an operator makes come out as they went in."""
    mine = {"n_words": -7, "kept": -8, "base_failed": -9, "coverage": -1, "size": -2, "target": -3, "taken": -4, "_hash": -5, "_stratum": -6, "_u0": -10, "_words": -11, "spans": -12}
    some = docs.filter("doc_id < 60 OR doc_id IS NULL OR doc_id >= 1000000000")
    wide = some.select(*docs.columns[:2], *[F.lit(v).alias(c) for c, v in mine.items()], *docs.columns[2:])
    for _, stage in cp.STAGES:
        out = stage(spark, wide, DATA)
        assert [c for c in out.columns if c not in ("shard", "slot")] == wide.columns
        rows = out.collect()
        assert rows and all({c: r[c] for c in mine} == mine for r in rows)


def test_stages_of_nothing(spark, docs):
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_no_benchmark_window_is_left(spark, docs):
    items = [plain(r["text"]).split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)}
    clean = cp.decontamination(spark, docs, DATA)
    assert clean.columns == docs.columns
    rows = clean.collect()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = [r for r in rows if r["text"] != before[r["doc_id"]]]
    assert changed and all(r["n_chars"] == len(r["text"]) for r in changed)
    leaky = {i for i, t in before.items() if any(tuple(w) in windows for w in zip(*[plain(t).split()[k:] for k in range(10)], strict=False))}
    assert {r["doc_id"] for r in changed} <= leaky and set(before) - {r["doc_id"] for r in rows} <= leaky
    for r in changed:
        words = plain(r["text"]).split()
        assert not any(tuple(words[k : k + 10]) in windows for k in range(len(words) - 9))


def test_run(spark):
    out = cp.run(spark, DATA)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(out.columns)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and out.select("shard", "slot").distinct().count() == out.count()
    assert out.groupBy("doc_id", "text").count().filter("count > 2").count() == 0
