"""Lines that many documents share are removed from all of them.

Line hashes live in levelled sorted runs, as in a log-structured merge tree: every batch of documents writes one run with each line's
number of documents; when two runs stand on a level, they are merged into one of the next level. A line that has
reached the wanted number of documents is settled; later batches merge-anti-join the settled lines and add only
what is still open.

A run is a table in the shared folder, bucketed and sorted by hash. Runs have the same buckets, so that merges and anti-joins go
through two sorted runs bucket by bucket: their plans have no Exchange and no Sort.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, fenced, fresh_path, lower_ascii

HASHES = ["_h1", "_h2"]
#: At most so many settled lines (16 bytes each and the row's overhead) are broadcast; beyond it, a shuffled join.
BROADCAST_LINES = 200_000
#: Lets a scan of a sorted, bucketed table tell its order, where each bucket is one file.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def hash128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes: the second is seeded by the hash of a constant."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Of each line its key: trimmed of ASCII white space, A-Z lower-cased."""
    return F.transform(lines_of(lower_ascii(text)), lambda x: F.btrim(x, F.lit(SPACE)))


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SORTED_SCANS)
    spark.conf.set(SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_SCANS, before)


class LineRuns:
    """Levelled sorted runs of line hashes with document counts."""

    def __init__(self, spark: SparkSession, min_docs: int, min_chars: int = 1, path: str | None = None, buckets: int | None = None):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.path = path or fresh_path(spark, "line-runs")
        #: As many as a shuffle has partitions, so that what leaves a shuffle by hash has each bucket in one task, and one file.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []
        self.made = 0

    def _table(self, rows: DataFrame, by: str) -> DataFrame:
        """rows (_h1, _h2, _docs, by) as a table in parts by `by`."""
        self.made += 1
        name = f"{self.name}_{self.made:05d}"
        rows.write.partitionBy(by).bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", f"{self.path}/run-{self.made:05d}").saveAsTable(name)
        return self.spark.table(name)

    def _split(self, run: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The run written; its settled and its open lines."""
        written = self._table(run.select(*HASHES, "_docs", (F.col("_docs") >= self.min_docs).alias("_done")), "_done")
        return tuple(written.filter(F.col("_done") == done).select(*HASHES, "_docs") for done in (True, False))

    def hashes(self, text: Column) -> Column:
        """The distinct hashes of a text's lines of min_chars code points or more."""
        keys = F.filter(line_keys(text), lambda k: F.length(k) >= self.min_chars)
        return F.array_distinct(F.transform(keys, lambda k: F.struct(*[h.alias(n) for h, n in zip(hash128(k), HASHES, strict=True)])))

    def batches(self, docs: DataFrame, batch: Column, count: int, text: str = "text") -> list[DataFrame]:
        """Counts of each of `count` batches as sorted runs, by one pass over docs and one shuffle of counts."""
        lines = docs.select(batch.alias("_batch"), F.explode(self.hashes(F.col(text))).alias("h"))
        each = lines.groupBy("h._h1", "h._h2").agg(*[F.count_if(F.col("_batch") == b).alias(f"_n{b}") for b in range(count)])
        rows = each.select(*HASHES, F.posexplode(F.array(*[F.col(f"_n{b}") for b in range(count)])).alias("_batch", "_docs")).filter("_docs > 0")
        written = self._table(rows.select(*HASHES, "_docs", "_batch"), "_batch")
        return [written.filter(F.col("_batch") == b).select(*HASHES, "_docs") for b in range(count)]

    def without_settled(self, run: DataFrame) -> DataFrame:
        return reduce(lambda left, right: left.join(right.select(*HASHES).hint("merge"), HASHES, "left_anti"), self.settled, run)

    def merged(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Two runs as one, counts added."""
        other = right.withColumnRenamed("_docs", "_more").hint("merge")
        return left.join(other, HASHES, "full").select(*HASHES, (F.coalesce("_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("_docs"))

    def add_run(self, run: DataFrame) -> None:
        """A batch's counts (_h1, _h2, _docs), less what is settled; then levels are compacted while one holds two runs."""
        with sorted_scans(self.spark):
            level, (done, run) = 0, self._split(self.without_settled(run))
            self.settled.append(done)
            while True:
                if level == len(self.levels):
                    self.levels.append([])
                self.levels[level].append(run)
                if len(self.levels[level]) < 2:
                    return
                done, run = self._split(self.merged(*self.levels[level]))
                self.settled.append(done)
                self.levels[level], level = [], level + 1

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """One batch: every document counts once for each of its lines."""
        lines = docs.select(F.explode(self.hashes(F.col(text))).alias("h"))
        self.add_run(lines.groupBy("h._h1", "h._h2").agg(F.count("*").alias("_docs")))

    def frequent(self) -> DataFrame:
        """Hashes of all lines that at least min_docs of the documents added hold."""
        open_runs = [run for runs in self.levels for run in runs]
        with sorted_scans(self.spark):
            while len(open_runs) > 1:
                done, run = self._split(self.merged(*open_runs[:2]))
                self.settled.append(done)
                open_runs = [run, *open_runs[2:]]
        self.levels = [open_runs]
        empty = self.spark.range(0).selectExpr("id AS _h1", "id AS _h2")
        return reduce(lambda a, b: a.unionByName(b), [run.select(*HASHES) for run in self.settled], empty)

    def unseen(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Hashes of the batch's lines that no run holds: the merge-anti-join for first-come line dedup."""
        new = docs.select(F.explode(self.hashes(F.col(text))).alias("h")).select("h.*").distinct()
        runs = self.settled + [run for some in self.levels for run in some]
        return reduce(lambda left, right: left.join(right.select(*HASHES), HASHES, "left_anti"), runs, new)

    def close(self) -> None:
        """The runs' names go from the catalog; what frequent() gave must have been read."""
        for k in range(1, self.made + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k:05d}")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, text: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of min_chars code points or
    more that min_docs rows or more hold lose all their lines everywhere; the other lines stay, joined by newlines. A
    null or empty text is one empty line. Repeated rows count each; an empty table gives an empty one. Columns of docs named as
    the new ones are replaced, others of any name stay as they are.

    What a document loses depends on its text alone, so the lost places are gathered by the hash of the text: copies
    fold into one before the shuffle, and no id needs to be present or unique.
    """
    spark = docs.sparkSession
    full = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(text).alias("text"), *[h.alias(n) for h, n in zip(hash128(full), ("_t1", "_t2"), strict=True)])
    runs = LineRuns(spark, min_docs, min_chars)
    for run in runs.batches(texts, F.pmod(F.col("_t1"), F.lit(batches)), batches):
        runs.add_run(run)
    frequent = cut(runs.frequent())
    runs.close()
    if frequent.count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    lost = (
        texts.select("_t1", "_t2", F.posexplode(line_keys(F.col("text"))).alias("_pos", "_line"))
        .filter(F.length("_line") >= min_chars)
        .select("_t1", "_t2", "_pos", *[h.alias(n) for h, n in zip(hash128(F.col("_line")), HASHES, strict=True)])
        .join(frequent, HASHES)
        .groupBy("_t1", "_t2")
        .agg(F.collect_set("_pos").alias("_lost"))
    )
    lost = cut(lost)  # so that the join's two sides are plain exchanges, and a hot text is split
    inner, back = fenced(docs, ["n_lines", "n_dropped", "kept_text"], _text=full, **dict(zip(("_t1", "_t2"), hash128(full), strict=True)))
    nothing = F.array().cast("array<int>")
    joined = inner.join(lost, ["_t1", "_t2"], "left").withColumn("_lines", lines_of(F.col("_text"))).withColumn("_lost", F.coalesce("_lost", nothing))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    return back(
        joined,
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_lost").cast("long").alias("n_dropped"),
        F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n").alias("kept_text"),
    )
