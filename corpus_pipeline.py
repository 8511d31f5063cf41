"""A training corpus from raw documents: quality, near copies, benchmark leaks, mixture and shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder as Parquet
and reads it again as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.llm.common import fenced, fresh_path, held, word_count
from parcelry.llm.decontam import scan_benchmark
from parcelry.llm.mixing import mix_sources, repeat_rows
from parcelry.llm.nearcopies import near_copy_groups
from parcelry.llm.quality import add_counts, fit_cutoffs, judge
from parcelry.llm.sharding import shuffle_into_shards

SHARDS = 8
#: Documents of which more than this share of the words is benchmark text go; of others the leaked spans go.
MOST_LEAKED = 0.5


def text_id() -> F.Column:
    return F.md5(F.coalesce("text", F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep.

    A null or empty text fails the base rules; a null language is a stratum; repeated rows are judged alike; an empty table gives an
    empty one. Columns of any name stay as they are. Texts are counted once: the counts are written beside them.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    inner, back = fenced(docs, keep=["doc_id", "lang", "text"])
    counted = held(add_counts(inner))
    return back(judge(counted, fit_cutoffs(counted, labels)).filter("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component over pairs of at least 0.8 in 5-word shingles: the one whose id names it.

    A row without id goes by its text's hash, above all ids, so that it stays only where no row of its group has an
    id. Rows equal in id and text are one document; texts without words are alike; an empty table gives an empty one. Columns of any
    name stay as they are.
    """
    hashed = F.xxhash64("text")
    keyed, back = fenced(docs, _hash=hashed, _row=F.coalesce("doc_id", F.lit(1 << 62) + F.pmod(hashed, F.lit(1 << 61))), _body=F.col("text"))
    stay = near_copy_groups(keyed.select("_row", "_body"), id_col="_row", text="_body").filter("_row = component_id").select("_row").distinct()
    return back(keyed.drop("_body").join(stay, "_row", "left_semi").dropDuplicates(["_row", "_hash"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that are mostly benchmark text go.

    Null and empty texts have no passage and stay; repeated rows are cleaned alike; an empty table gives an empty one. Columns of any name
    stay as they are, but for n_chars, which follows the text where that has changed.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    inner, back = fenced(docs, keep=["text", "n_chars"])
    scanned = scan_benchmark(inner, items, span_limit=1, coverage_limit=MOST_LEAKED).filter(F.col("coverage") <= MOST_LEAKED)
    changed = scanned.withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("n_hit") > 0, length).otherwise(F.col("n_chars")))
    return back(changed)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their weights; a document taken twice is two rows.

    Null and empty texts have no words, so that they go in or not by their place alone; a null source is one, the last; rows equal in id and
    text are interchangeable; an empty table gives an empty one. Columns of any name stay as they are.
    """
    inner, back = fenced(docs, _source=F.col("source"), _id=F.col("doc_id"), _words=word_count(F.col("text")), _text_md5=text_id())
    mixed = mix_sources(inner, F.col("_words"), "_source", ids=[F.col("_id"), F.col("_text_md5")])
    return back(repeat_rows(mixed, inner.columns))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with shard and slot, which replace columns of these names.

    Nulls and empty texts are rows like others; rows equal in id and text are interchangeable; an empty table gives an empty one.
    """
    return shuffle_into_shards(docs, SHARDS, ids=[F.col("doc_id"), text_id()])


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: Shingle similarity and certified cutoffs have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
