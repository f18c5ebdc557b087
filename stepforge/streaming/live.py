"""A folder of JSON lines as a stream of traces, checked batch by batch.

A document is a whole trace, so no state is carried from batch to batch; the
findings of a batch are written under its number, and a batch that is run again
after a failure replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepforge.operators import lint
from stepforge.registry import Registry
from stepforge.sources import loader


def lint_stream(
    spark: SparkSession, folder: str, out: str, checkpoint: str, fmt: str | None = None, registry: Registry | None = None, rules=None, trigger: dict | None = None
) -> StreamingQuery:
    """Starts a query that checks the lines of new files in ``folder`` and writes findings to ``out/batch=N``."""
    lines = spark.readStream.text(folder)
    docs = lines.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    traces = loader.adapt(docs, fmt)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        lint.lint(batch, registry, rules).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")
        batch.unpersist()

    return traces.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
