"""Uniform shuffle into shards of exact sizes.

The rows lie in logical partitions (the first digits of a hash-random key, so that a lost task is made again alike).
How many rows each partition sends to each shard is drawn exactly: the communication matrix of a uniform shuffle is
multivariate hypergeometric, row by row, given what the shards still lack. In each partition the rows, in random
order, are dealt by the partition's row of the matrix; after the exchange each shard is put in a second random order.

A partition is sized by bytes, so that long rows make more of them. The driver draws partitions times shards numbers, at most
MOST_CELLS of them; it sees counts only.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fenced, hex_digits, named, random_key

BYTES_PER_PARTITION = 8 << 20
PARTITION_DIGITS = 4
MOST_CELLS = 1 << 20


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of drawn are good, drawn without replacement: inversion outward from the mode.

    Ratios of neighbouring probabilities are exact in doubles; the weights are summed until they vanish, so that no
    factorials are needed and the counts may be of any size.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    weights = {mode: 1.0}
    for step in (1, -1):
        k, weight = mode, 1.0
        while low <= k + step <= high and weight > 1e-18:
            if step > 0:
                weight *= (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))
            else:
                weight *= k * (bad - drawn + k) / ((good - k + 1) * (drawn - k + 1))
            k += step
            weights[k] = weight
    left = rng.random() * math.fsum(weights.values())
    for k, weight in weights.items():
        left -= weight
        if left < 0:
            return k
    return mode


def communication_matrix(counts: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition the rows it sends to each shard; columns sum to shard sizes at most one apart."""
    rng, total = random.Random(seed), sum(counts)
    lacking = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = []
    for count in counts:
        row, left, pool = [], count, sum(lacking)
        for k in range(shards):
            pool -= lacking[k]
            row.append(hypergeometric(rng, lacking[k], pool, left))
            left -= row[-1]
        lacking = [a - b for a, b in zip(lacking, row, strict=True)]
        matrix.append(row)
    return matrix


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in a shuffle: its strings, and 16 bytes for each other column."""
    parts = [F.coalesce(F.octet_length(named(c)), F.lit(0)) if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes]
    return sum(parts, F.lit(32)).cast("long")


def shuffle_into_shards(df: DataFrame, shards: int, ids: Sequence[Column] = (), seed: int = 23, bytes_per_partition: int = BYTES_PER_PARTITION) -> DataFrame:
    """df with shard (0 to shards - 1, row counts at most one apart) and slot (0, 1, ... in each shard).

    ids feed the random keys; rows equal in all ids are interchangeable. Nulls count as empty, texts may be of any
    length, an empty table gives an empty one; columns of df named shard or slot are replaced, others of any name stay as they are.
    """
    if not 0 < shards <= MOST_CELLS:
        raise ValueError(f"shards must be from 1 to {MOST_CELLS}")
    spark, ids = df.sparkSession, list(ids)
    total = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]
    digits = max(1, hex_digits(total, bytes_per_partition, PARTITION_DIGITS))
    while digits and 16**digits * shards > MOST_CELLS:
        digits -= 1
    keys = [f"_id{k}" for k in range(len(ids))]
    inner, back = fenced(df, ["shard", "slot"], _key=random_key(seed, *ids), **dict(zip(keys, ids, strict=True)))
    keyed = inner.withColumn("_part", F.substring("_key", 1, digits))
    counts = {r["_part"]: r["n"] for r in keyed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    ends = [[p, [sum(row[: k + 1]) for k in range(shards)]] for p, row in zip(parts, matrix, strict=True)]
    drawn = spark.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps([{"p": p, "e": e} for p, e in ends])), "array<struct<p string, e array<bigint>>>")).alias("x")
    )
    drawn = drawn.select(F.col("x.p").alias("_part"), F.col("x.e").alias("_ends"))
    local = Window.partitionBy("_part").orderBy("_key", *keys)
    dealt = (
        keyed.withColumn("_at", F.row_number().over(local) - 1)
        .join(F.broadcast(drawn), "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda end: end <= F.col("_at"))))
        .withColumn("_key", F.substring("_key", 17, 16))
        .withColumn("_block", F.substring("_key", 1, digits))
        .drop("_part", "_at", "_ends")
    )
    blocks = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    again = Window.partitionBy("shard", "_block").orderBy("_key", *keys)
    placed = dealt.withColumn("_inside", F.row_number().over(again) - 1).join(offsets, ["shard", "_block"])
    return back(placed, "shard", (F.col("_offset") + F.col("_inside")).alias("slot"))
