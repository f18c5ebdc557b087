"""Registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import bpe, chat, decontam, exactdedup, langid, licenses, linededup, sharding, simhash, urlfilter

#: Pages that carry one of these words put their URL on the block list.
ABUSIVE = ("idiot", "stupid", "trash", "pathetic", "disgusting", "worthless")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without those whose canonical URL was seen, in any capture, with abusive text."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(F.col("html").rlike("(?:" + "|".join(ABUSIVE) + ")")).select("url")
    return urlfilter.drop_listed(pages, listed)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.duplicate_lines(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_bpe": op5_bpe,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_license_scan": op9_license_scan,
    "op10_simhash": op10_simhash,
}

_CANONICAL = r"""
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '')
  || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN q = '' THEN '' ELSE '?' || q END
"""

ORACLES: dict[str, str] = {
    "op2_url_filter": rf"""
WITH a AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
), b AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '{urlfilter.TRACKING}'))), '&') AS q FROM a
), c AS (SELECT page_id, url, html, {_CANONICAL} AS canonical_url FROM b)
SELECT page_id, url, canonical_url FROM c
WHERE canonical_url IS NULL OR canonical_url NOT IN (
  SELECT canonical_url FROM c WHERE canonical_url IS NOT NULL AND regexp_matches(html, '{"|".join(ABUSIVE)}'))
""",
    "op3_exact_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "op4_chat_format": f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER w AS k,
    string_agg(coalesce(length(role)::VARCHAR || ':' || role, '-') || coalesce(length(text)::VARCHAR || ':' || text, '-'), '')
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS prefix
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), c AS (
  SELECT conv_id, count(*) AS n_turns, arg_max(prefix, k) AS whole,
    string_agg('{chat.BEGIN}' || coalesce(replace(replace(replace(role, '<|', '<||'), '\\', '\\\\'), chr(10), '\\n'), 'unknown') || chr(10)
      || coalesce(replace(text, '<|', '<||'), '') || '{chat.END}', chr(10) ORDER BY k) AS rendered
  FROM t GROUP BY conv_id
), i AS (SELECT DISTINCT t.prefix FROM t JOIN c USING (conv_id) WHERE t.k < c.n_turns)
SELECT conv_id, n_turns, rendered FROM c
WHERE whole NOT IN (SELECT prefix FROM i) AND conv_id = (SELECT min(d.conv_id) FROM c d WHERE d.whole = c.whole)
""",
}
