"""The registered queries of this subpackage, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, fertility, mixing, near_dedup, prefix_trie, quality_gam, sharding, spelling, token_counts, token_ids, toxicity, url_filter, warc
from claimloom.llm.common import shared_dir, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    scored = quality_gam.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=part != 2)
    return scored.select("doc_id", (part == 2).alias("held_out"), "score", "predicted")


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.derived_edits().alias("edits"))
    return token_counts.count_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_ids.write_ids(docs, shared_dir(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_ids.read_ids(spark, manifest, docs.schema["doc_id"].dataType.simpleString())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: Captures and list entries of the URL query fall in these days from the start of 2024.
DAYS = 360


def captures_of(pages: DataFrame) -> DataFrame:
    """A fetch time for each page, from its id."""
    span = F.lit(DAYS * 86_400)
    second = F.pmod(F.pmod(F.col("page_id"), span) * 7919, span)
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + second).alias("fetched_at"))


def entries_of(pages: DataFrame, per_pattern: int = 4) -> DataFrame:
    """Dated list entries for every pattern that the pages' URLs fall under, from the pattern's hash."""
    pattern = pages.select(F.explode(url_filter.patterns_of(F.col("url"))).alias("pattern")).distinct()
    e = pattern.select("pattern", F.explode(F.sequence(F.lit(1), F.lit(per_pattern))).alias("k"))
    h = lambda tag: F.conv(F.substring(F.md5(F.concat("pattern", F.lit(tag), F.col("k").cast("string"))), 1, 7), 16, 10).cast("long")
    action = F.element_at(F.array(F.lit("allow"), F.lit("block"), F.lit("remove")), (F.pmod(h("#a"), F.lit(3)) + 1).cast("int"))
    return e.select("pattern", action.alias("action"), F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(h("#t"), F.lit(DAYS)) * 86_400).alias("listed_at"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(captures_of(pages), entries_of(pages)).select("page_id", "fetched_at", "pattern", "action", "listed_at", "kept")


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fertility.judge(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text", "lang")


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op10_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs).drop("text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_of(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=part != 2)
    return scored.select("doc_id", (part == 2).alias("held_out"), "score", "predicted")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.slipped_words(table(spark, sf_dir, "documents")).filter(F.col("n") >= 2)
    return spelling.spelling_forms(words)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality_gam": op2_quality_gam,
    "op3_probminhash": op3_probminhash,
    "op4_token_counts": op4_token_counts,
    "op5_rans_ids": op5_rans_ids,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_fertility": op8_fertility,
    "op9_wu_manber": op9_wu_manber,
    "op10_lpt_shards": op10_lpt_shards,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_toxicity": op12_toxicity,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), text)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / greatest(0.25::DOUBLE, 1.0::DOUBLE - abs((length(COALESCE(text, '')) + 1)::DOUBLE / greatest(size, 1) - 1 - 6.0::DOUBLE) / 12.0::DOUBLE) AS key
  FROM d
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3) + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, cap / w AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - COALESCE(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (SELECT arg_min(level, ratio) AS fits FROM l WHERE ratio >= level),
t AS (SELECT source, source_size, CASE WHEN fits IS NULL OR ratio < fits THEN cap ELSE fits * w END AS target FROM l, f),
r AS (
  SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(target / t.source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS middle
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN target - epochs * source_size > 0 AND middle <= target - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""

OP7_SQL = r"""
WITH c AS (
  SELECT page_id, url, make_timestamp(CAST((1704067200 + (page_id * 7919) % 31104000) * 1000000 AS BIGINT)) AS fetched_at,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1) AS step
  FROM pages
), p AS (
  SELECT page_id, fetched_at, 0 AS rank, host || step AS pattern FROM c WHERE host <> '' AND step <> ''
  UNION ALL SELECT page_id, fetched_at, 1, host FROM c WHERE host <> ''
  UNION ALL
  SELECT page_id, fetched_at, CAST(i AS INTEGER), array_to_string(string_split(host, '.')[i:], '.')
  FROM (SELECT *, unnest(range(2, len(string_split(host, '.')))) AS i FROM c WHERE host <> '')
), e AS (
  SELECT pattern, max(action) AS action, listed_at FROM (
    SELECT pattern, ['allow', 'block', 'remove'][CAST('0x' || substr(md5(pattern || '#a' || k), 1, 7) AS BIGINT) % 3 + 1] AS action,
      make_timestamp(CAST((1704067200 + CAST('0x' || substr(md5(pattern || '#t' || k), 1, 7) AS BIGINT) % 360 * 86400) * 1000000 AS BIGINT)) AS listed_at
    FROM (SELECT DISTINCT pattern FROM p), (SELECT unnest(range(1, 5)) AS k)
  ) GROUP BY pattern, listed_at
), v AS (
  SELECT *, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to FROM e
), h AS (
  SELECT p.page_id, rank, v.pattern, v.action, v.listed_at FROM p JOIN v ON p.pattern = v.pattern
    AND v.action <> 'remove' AND v.listed_at <= p.fetched_at AND (v.valid_to IS NULL OR p.fetched_at < v.valid_to)
), b AS (
  SELECT page_id, arg_min(pattern, rank) AS pattern, arg_min(action, rank) AS action, arg_min(listed_at, rank) AS listed_at FROM h GROUP BY page_id
)
SELECT c.page_id, c.fetched_at, b.pattern, b.action, b.listed_at, COALESCE(b.action <> 'block', TRUE) AS kept FROM c LEFT JOIN b ON c.page_id = b.page_id
"""

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, sha256(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS turn_id, strlen(COALESCE(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT),
      lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT conv_id, turn_id, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth FROM (
    SELECT c.conv_id, turn_id, bytes, p FROM c JOIN t ON t.conv_id = c.base AND p <= h
    UNION ALL SELECT c.conv_id, turn_id, bytes, p FROM c JOIN t ON t.conv_id = c.conv_id AND p > h)
), m AS (
  SELECT conv_id, depth, bytes, string_agg(turn_id, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), l AS (SELECT conv_id, max(depth) AS len FROM m GROUP BY conv_id),
n AS (
  SELECT key, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(COALESCE(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM m JOIN l USING (conv_id) GROUP BY key, depth
), k AS (SELECT left(key, length(key) - 64) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
s AS (
  SELECT a.key, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.bytes)::BIGINT AS saved_tokens
  FROM w JOIN m a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.key
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN s USING (key) LEFT JOIN n p ON w.depth > 0 AND p.key = left(w.key, length(w.key) - 64)
"""

ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL, "op7_url_filter": OP7_SQL, "op11_prefix_trie": OP11_SQL}
