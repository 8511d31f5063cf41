"""Shared pieces: words, keys, and where shared intermediate files go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read back: later uses read the columns they need."""
    path = fresh_path(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def fenced(df: DataFrame, new: Sequence[str] = (), keep: Sequence[str] = (), **made: Column) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with its columns under names (_u0, _u1, ...) that no operator gives, and the function that puts the names back.

    Columns named as one of `new`, which the operator is to give, go; those in `keep` keep their names; columns made from df stand
    beside. back(out, *more) selects df's columns, in their order, and more.
    """
    gone = {n.lower() for n in new}
    names = {c: c if c in keep else f"_u{k}" for k, c in enumerate(df.columns) if c.lower() not in gone or c in keep}
    inner = df.select(*[named(c).alias(a) for c, a in names.items()], *[c.alias(n) for n, c in made.items()])

    def back(out: DataFrame, *more: str | Column) -> DataFrame:
        stay = {c: a for c, a in names.items() if c.lower() not in gone}
        given = out.select(*more).columns if more else []
        return out.select(*stay.values(), *more).toDF(*stay, *given)  # renamed in a step of its own: an alias may be a name used in `more`

    return inner, back


def fenced_name(df: DataFrame, column: str) -> str:
    """The name that fenced() gives a column of df that stays."""
    return f"_u{df.columns.index(column)}"


def cut(df: DataFrame) -> DataFrame:
    """df computed and kept in the shared folder; its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces with about `most` bytes of text each (one row at least), which bounds what a worker holds."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(sizes) // most
        ends = [*(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        at = 0
        for end in ends:
            if end > at:
                yield batch.slice(at, end - at)
            at = end


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other characters kept; lower() does that, and fast, where all characters are ASCII."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def random_key(seed: int, *parts: Column) -> Column:
    """32 hex digits that depend on the seed and the parts (null counts as empty) alone, so that reruns agree."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def hex_digits(rows: int, rows_per_block: int, most: int) -> int:
    """Leading digits of a random key that make blocks of about rows_per_block rows."""
    digits = 0
    while digits < most and rows > rows_per_block * 16**digits:
        digits += 1
    return digits
