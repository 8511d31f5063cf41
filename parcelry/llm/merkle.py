"""Merkle dataset manifest: a digest over every row, and for each row the proof that leads from it to the root.

Each source is a tree of its own, its leaves in order; the trees' roots, in the order of the sources, are the leaves of one
more tree. Runs of `fanout` consecutive nodes become one node, level by level, until one is left.

Leaves lie in aligned partitions of fanout ** LOCAL_LEVELS of them. A partition hashes its own subtree, and then subtree roots go
round in a butterfly: in round r every partition asks one member of each of the fanout groups (of fanout ** r partitions each) that
share its next node, and hashes that node itself. All members of a group so hold the same ancestors and the siblings on the way,
and no pass leads back down. A group that isn't full is asked by more partitions than it has members; its members
share the questions.

Only rows of one aligned partition, and `fanout` digests of a node, meet in a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import with_running
from .common import fenced, held

FANOUT = 16
LOCAL_LEVELS = 3
STEP = "struct<left: string, right: string>"
NO_STEPS = f"cast(array() as array<{STEP}>)"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the columns: each its UTF-8 byte count, a colon and its value, or a dash if null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def node(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(leaves: Sequence[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The nodes of each level, leaves first: `levels` levels above them, or up to a single node."""
    out = [list(leaves)]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([node(below[k : k + fanout]) for k in range(0, len(below), fanout)])
    return out


def siblings(level: Sequence[str], at: int, fanout: int) -> dict[str, str]:
    start = at - at % fanout
    return {"left": "".join(level[start:at]), "right": "".join(level[at + 1 : start + fanout])}


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 (hex) of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def butterfly(state: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, size, digest) with one row for each of a tree's `size` subtrees -> tree, idx, digest (the tree's root) and path.

    A tree of one subtree is done as it is. The rounds are as many as the largest tree needs.
    """
    largest = state.agg(F.max("size")).first()[0] or 0
    state, span = state.withColumn("path", F.expr(NO_STEPS)), 1
    while span < largest:
        nodes = F.ceil(F.col("size") / F.lit(span))
        own = F.floor(F.col("idx") / span)
        first = own - F.pmod(own, F.lit(fanout))
        asked = state.filter(nodes > 1).select("tree", "idx", "size", F.explode(F.sequence(first, F.least(first + fanout - 1, nodes - 1))).alias("n"))
        members = F.least(F.lit(span), F.col("size") - F.col("n") * span)
        asked = asked.select("tree", "idx", "n", (F.col("n") * span + F.pmod(F.pmod(F.col("idx"), F.lit(span)), members)).alias("member"))
        told = asked.join(state.select("tree", F.col("idx").alias("member"), F.col("digest").alias("told")), ["tree", "member"])
        met = told.groupBy("tree", "idx").agg(F.sort_array(F.collect_list(F.struct("n", "told"))).alias("run"))
        joined = lambda run, keep: F.array_join(F.transform(F.filter(run, keep), lambda x: x["told"]), "")
        after = state.join(met, ["tree", "idx"], "left").select(
            "tree",
            "idx",
            "size",
            F.when(F.col("run").isNull(), F.col("digest")).otherwise(F.sha2(joined(F.col("run"), lambda x: F.lit(True)), 256)).alias("digest"),
            F.when(F.col("run").isNull(), F.col("path"))
            .otherwise(F.concat("path", F.array(F.struct(joined(F.col("run"), lambda x: x["n"] < own).alias("left"), joined(F.col("run"), lambda x: x["n"] > own).alias("right")))))
            .alias("path"),
        )
        state, span = held(after), span * fanout
    return state.select("tree", "idx", "digest", "path")


def subtree_roots(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, part, p, leaf) -> tree, part, whole (root if the tree is this part alone), inner (root of a full-height part)."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        leaves = group.sort_by("p")["leaf"].to_pylist()
        roots = [levels_of(leaves, fanout, n)[-1] for n in (None, levels)]
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int64()), "whole": [roots[0][0]], "inner": [roots[1][0]]})

    return rows.select("tree", "part", "p", "leaf").groupBy("tree", "part").applyInArrow(build, "tree string, part bigint, whole string, inner string")


def prover(fanout: int, levels: int, names: Sequence[str]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Of a partition's rows and its upper proof: the rows named with the whole proof of each."""

    def prove(key: tuple, group: pa.Table, upper: pa.Table) -> pa.Table:
        group, above = group.sort_by("p"), upper.to_pylist()[0]
        own = levels_of(group["leaf"].to_pylist(), fanout, levels if above["parts"] > 1 else None)
        proofs = [[siblings(level, at // fanout**k, fanout) for k, level in enumerate(own[:-1])] + above["path"] for at in range(group.num_rows)]
        made = [pa.array([above[c]] * group.num_rows, pa.string()) for c in ("subroot", "root")]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table([*[group[c] for c in names], *made, pa.array(proofs, kind)], names=[*names, "subroot", "root", "proof"])

    return prove


def merkle_manifest(df: DataFrame, leaf: Column, source: str = "source", order: str = "doc_id", fanout: int = FANOUT, local_levels: int = LOCAL_LEVELS) -> DataFrame:
    """df with leaf, position (in its source, from 0), subroot, root and proof, an array of the siblings left and right of each level.

    Leaves of a source ascend by `order` (null first), then by digest: rows equal in both have the same leaf, and which of them comes
    first doesn't matter to any root. A null source is a tree of its own, the first. A lone leaf is its tree's root, a lone tree the
    root, with no sibling; an empty table gives an empty one. Columns of df named as the new ones are replaced, others of any
    name stay. A row of any length is its digest in all that follows; leaf is evaluated more than once: give a column that is read.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit(""))
    inner, back = fenced(df, ["leaf", "position", "subroot", "root", "proof"], tree=tree, at=F.col(order), leaf=leaf)
    part = F.floor((F.col("pos") - 1) / fanout**local_levels)
    rows = held(with_running(inner, ["tree"], [F.col("at"), F.col("leaf")]).select("*", (F.col("pos") - 1).alias("p"), part.alias("part")))

    parts = held(subtree_roots(rows, fanout, local_levels))
    counts = parts.groupBy("tree").agg(F.count("*").alias("parts"))
    state = held(parts.join(counts, "tree").select("tree", F.col("part").alias("idx"), F.col("parts").alias("size"), F.when(F.col("parts") > 1, F.col("inner")).otherwise(F.col("whole")).alias("digest")))
    low = butterfly(state, fanout)

    roots = held(low.filter("idx = 0").select(F.col("tree").alias("name"), "digest"))
    named = held(with_running(roots, [], [F.col("name")]).select("name", F.lit("").alias("tree"), (F.col("pos") - 1).alias("idx"), F.lit(roots.count()).alias("size"), "digest"))
    high = butterfly(named.select("tree", "idx", "size", "digest"), fanout).select("idx", F.col("digest").alias("root"), F.col("path").alias("top"))
    tops = named.select(F.col("name").alias("tree"), "idx").join(high, "idx").drop("idx")
    upper = (
        low.join(tops, "tree")
        .join(counts, "tree")
        .select("tree", F.col("idx").alias("part"), "parts", F.col("digest").alias("subroot"), "root", F.concat("path", "top").alias("path"))
    )
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in ("tree", "at", "pos", "part")], *T.StructType.fromDDL(f"subroot string, root string, proof array<{STEP}>").fields])
    prove = prover(fanout, local_levels, [f.name for f in schema.fields[:-3]])
    proved = rows.groupBy("tree", "part").cogroup(upper.groupBy("tree", "part")).applyInArrow(prove, schema)
    return back(proved, "leaf", F.col("p").alias("position"), "subroot", "root", "proof")
