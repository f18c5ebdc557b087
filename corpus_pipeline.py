"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokens.

Each stage reads all that its predecessor kept, from Parquet.  All but the last
return the columns of ``documents``; the last returns doc_id, n_tokens,
token_ids and round_trip of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepforge.llm import bpe, decontam, langid, linededup, runtime, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are in none of the labelled languages."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out lines similar to earlier ones; documents of such lines alone go."""
    return linededup.drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item within its edit budget."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and checks that decoding gives them back."""
    return bpe.encode_decode(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: No stage can be expressed in SQL; tests/llm holds the rows of run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``: (doc_id, n_tokens, token_ids, round_trip) of what is left.

    A null or empty text is in no language and goes with the first stage.  Rows
    with a null doc_id, and different texts under one doc_id, are documents of
    their own; of rows equal in doc_id and text one is left.  Near copies, and
    lines as similar to each other, leave the smallest doc_id, null before all
    others among lines and after them among documents.  Texts of any length go
    through whole.  Columns of other names are carried to the last stage.  An
    empty table gives an empty result.  The table that a stage reads, and those
    that it makes for itself, are deleted once its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with runtime.scratch(spark) as made:
            docs, path = runtime.written(stage(spark, docs, sf_dir))
            made.remove(path)
            if before is not None:
                made.append(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
