"""One query for each operator, over whole tables, and DuckDB SQL where it can express the operator."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held, lower_ascii, word_count
from .decontam import items_digest, scan_benchmark
from .html import extract_main_text
from .langid import identify, train
from .lexical import rank_documents
from .licenses import scan_licenses
from .linededup import drop_frequent_lines
from .merkle import fold, leaf_digest, merkle_manifest, proof_digest
from .mixing import mix_sources
from .packing import pack
from .quality import add_counts, fit_cutoffs, judge
from .sharding import shuffle_into_shards
from .simhash import near_duplicates
from .tokencount import count_tokens, read_vocabulary

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id() -> F.Column:
    return F.md5(F.coalesce("text", F.lit("")))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"), text_id().alias("text_md5")))
    mixed = mix_sources(docs, F.col("words"), ids=[F.col("doc_id"), F.col("text_md5")])
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        text_id().alias("text_md5"),
    )
    return shuffle_into_shards(docs, SHARDS, ids=[F.col("doc_id"), F.col("text_md5")]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.map_keys("mixture").alias("languages"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs.select("doc_id", "text"), read_vocabulary(VOCABULARY)).select("doc_id", "n_tokens")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(add_counts(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), keep_text=False))
    judged = judge(counts, fit_cutoffs(counts, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), items_digest(F.col("hit_items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = leaf_digest([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in fields])
    hashed = held(docs.select("doc_id", "source", leaf_digest([F.col(c) for c in fields]).alias("original"), F.when(tampered, changed).alias("changed")))
    proved = merkle_manifest(hashed, F.col("original"))
    folded = proved.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack(docs, Path(TOKENIZER).read_text(), ids=[F.col("doc_id")])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_sharding, op3_language, op4_tokens, op5_licenses, op6_main_text, op7_simhash, op8_quality, op9_decontamination, op10_line_dedup, op11_merkle, op12_packing, op13_lexical)
}

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS m
  FROM documents
), k AS (SELECT *, md5(concat_ws(':', '11', coalesce(doc_id::VARCHAR, ''), m)) AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS total FROM k GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight, 2.0 * total AS full_at, 1.5 * sum(total) OVER () AS everything FROM s),
l AS (SELECT *, (everything - coalesce(sum(full_at) OVER (ORDER BY full_at / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY full_at / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, total, least(full_at, weight * coalesce((SELECT level FROM l WHERE level <= full_at / weight ORDER BY full_at / weight, source NULLS LAST LIMIT 1), 1e300)) AS target FROM l),
p AS (SELECT k.*, t.total, t.target, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, m, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, total::BIGINT AS source_size, target,
       (size * (CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END
        + CASE WHEN start + size * 0.5e0 < target - (CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END) * total THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

LEAKS_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)
), occ AS (
  SELECT r, i, win.n, item
  FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw, (SELECT DISTINCT n FROM win))) x
  JOIN win ON x.n = win.n AND x.g = win.g
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM occ GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

SEARCH_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
a AS (SELECT count(*)::HUGEINT AS n, sum(len(w))::HUGEINT AS l FROM t WHERE len(w) > 0),
f AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM t),
c AS (SELECT r, doc_id, n, term, count(*)::HUGEINT AS tf FROM f WHERE term IN (SELECT term FROM i) GROUP BY r, doc_id, n, term),
k AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM a)::DOUBLE + 2) / (2 * count(*) + 1)))::HUGEINT AS weight FROM c GROUP BY term),
s AS (SELECT item_id, text, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * c.n::HUGEINT * a.n) // a.l)))) AS score
      FROM c JOIN k USING (term) JOIN i USING (term), a GROUP BY item_id, text, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""

#: CRC-32 of the decimal doc_id, bit by bit: a byte is mixed in where the list has one, a shift follows for each -1.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295::BIGINT)"""
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def merkle_sql(levels: int) -> str:
    """The manifest in SQL, for trees of at most 16 ** levels leaves: nodes a<k> of the sources and b<k> of the sources' roots, level by level."""

    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    def nodes(t: str) -> list[str]:
        out, window = [], "OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
        for k in range(levels):
            out += [
                f"s{t}{k} AS (SELECT tree, i, coalesce(string_agg(h, '') {window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k} WHERE n > 1)",
                f"{t}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {t}{k} WHERE n > 1 GROUP BY tree, i // 16))",
            ]
        return out

    def single(t: str) -> str:
        return " UNION ALL ".join(f"SELECT tree, h FROM {t}{k} WHERE n = 1" for k in range(levels + 1))

    ctes = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {CRC_SQL} % 5 = 0 THEN {leaf(LOWER_SQL)} END AS changed FROM documents)",
        "a AS (SELECT *, coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)",
        "a0 AS (SELECT tree, p AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM a)",
        *nodes("a"),
        f"sub AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS i FROM ({single('a')}))",
        "b0 AS (SELECT '' AS tree, i, h, count(*) OVER () AS n FROM sub)",
        *nodes("b"),
        f"top AS ({single('b')})",
        "f AS (SELECT a.*, sub.h AS subroot, sub.i AS j, top.h AS root, coalesce(changed, leaf) AS f, '' AS s FROM a JOIN sub ON a.tree = sub.name, top)",
    ]
    last = "f"
    for t, tree, at in (("a", "x.tree", "p"), ("b", "''", "j")):
        for k in range(levels):
            ctes.append(
                f"f{t}{k} AS (SELECT x.* REPLACE (CASE WHEN y.l IS NULL THEN x.f ELSE sha256(y.l || x.f || y.r) END AS f, x.s || coalesce(y.l || y.r, '') AS s) FROM {last} x LEFT JOIN s{t}{k} y ON y.tree = {tree} AND y.i = x.{at} // {16**k})"
            )
            last = f"f{t}{k}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(s) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}"


ORACLES = {"op11_merkle": merkle_sql(6), "op1_mixing": MIX_SQL, "op9_decontamination": LEAKS_SQL, "op10_line_dedup": LINES_SQL, "op13_lexical": SEARCH_SQL}
