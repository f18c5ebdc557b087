"""Exact deduplication with skew-safe combining.

Copies of one text can number in the millions, so no task may receive all of
them.  Three combines, each of which groups by the full text, with the digest
only routing rows:

1. locally: the partial aggregate of the first grouping removes the copies that
   one task sees, before any row is sent;
2. by (digest, salt): copies of one text meet in ``salts`` places;
3. by digest: at most ``salts`` winners of each text meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row (doc_id, copies) for each distinct text: its smallest id and its number of rows.

    Texts are compared byte for byte.  Null texts count as equal to one another,
    an empty text equals only other empty texts.  Repeated rows count as copies.
    A null doc_id never wins against a number; if a text has no other, the
    result's doc_id is null.  An empty table gives an empty result.  Columns
    besides doc_id and text are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = rows.groupBy("digest", "salt", "text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    winners = salted.groupBy("digest", "text").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))
    return winners.select("doc_id", "copies")
