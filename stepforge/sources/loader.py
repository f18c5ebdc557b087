"""Files of trace documents as canonical tables.

``.jsonl`` files are read line by line and split across tasks; any other file
is one document.  Adapters run inside ``mapInArrow``, a batch at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions.values import Doc, _arrow, bounded, pieces
from stepforge.sources import chat, model, native, observations, spans

ADAPTERS: dict[str, Callable[..., list[Doc]]] = {
    "native": native.traces,
    "openinference": spans.traces,
    "otel": spans.traces,
    "openai": chat.traces,
    "langfuse": observations.traces,
}


#: Steps of which a worker holds the rows as objects before they go on, but for a longer trace's.
HELD_STEPS = 4096


def adapter(fmt: str | None) -> Callable[..., list[Doc]]:
    if (fmt or "native") not in ADAPTERS:
        raise ValueError(f"unknown format {fmt!r}; there are {', '.join(ADAPTERS)}")
    return ADAPTERS[fmt or "native"]


def adapt(docs: DataFrame, fmt: str | None = None, tool_names=()) -> DataFrame:
    """Canonical traces of (source, start, text): text is one JSON document.

    Keys sort as the documents stand in their source.  Blank texts are skipped;
    a text that isn't JSON fails the job, with its source named.  A worker
    holds a few thousand steps at a time, or one document.
    """
    run, names = adapter(fmt), frozenset(tool_names or ())
    kind = _arrow(f"struct<{model.TRACE}>")
    bounded(docs.sparkSession)
    return docs.select("source", "start", "text").mapInArrow(lambda batches: adapted(batches, run, names, kind), model.TRACE)


def adapted(batches: Iterable[pa.RecordBatch], run: Callable[..., list[Doc]], names: frozenset[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    count: dict[tuple[str, int], int] = {}
    rows, held = [], 0
    for b in (piece for whole in batches for piece in pieces(whole)):
        for source, start, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = count[source, start] = count.get((source, start), -1) + 1
            if text is None or not text.strip():
                continue
            try:
                doc = json.loads(text)
            except ValueError as e:
                raise ValueError(f"{source}: {e}") from e
            if "\\ud" in text.lower():  # half of a surrogate pair has no UTF-8 form
                doc = json.loads(json.dumps(doc, ensure_ascii=False).encode("utf-8", "replace"))
            for sub, t in enumerate(run(doc, tool_names=names)):
                rows.append(t | {"trace_key": f"{source}#{start:016d}.{n:09d}.{sub:06d}"})
                held += 1 + len(t["steps"])
                if held >= HELD_STEPS:
                    yield pa.RecordBatch.from_struct_array(pa.array(rows, kind))
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_struct_array(pa.array(rows, kind))


def load(spark: SparkSession, path: str, fmt: str | None = None, tool_names=()) -> DataFrame:
    """Canonical traces of a file, folder or pattern; files named .jsonl, and all in a folder of such a name, are read
    by lines, others whole."""
    adapter(fmt)
    named = str(path).rstrip("/").endswith(".jsonl")
    lines = F.lit(True) if named else F.col("_metadata.file_name").endswith(".jsonl")  # a filter on names keeps other files from being read
    read = lambda whole, wanted: spark.read.text(str(path), wholetext=whole).filter(wanted).select("value", "_metadata")
    text = read(False, lines).unionByName(read(True, ~lines))
    docs = text.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    return adapt(docs, fmt, tool_names)


def documents(traces: DataFrame, fmt: str = "native") -> DataFrame:
    """(source, start, text): every trace as one JSON document, native or a message list ("openai"); adapt() reads them again."""
    if fmt not in ("native", "openai"):
        raise ValueError(f"traces can't be written as {fmt!r}")

    bounded(traces.sparkSession)
    return traces.select("trace_key", "run_id", "final_json", "steps").mapInArrow(lambda batches: written(batches, fmt), "source string, start long, text string")


def written(batches: Iterable[pa.RecordBatch], fmt: str) -> Iterator[pa.RecordBatch]:
    for b in (piece for whole in batches for piece in pieces(whole)):
        rows = b.to_pylist()
        docs = [model.exported(t) if fmt == "native" else {"run_id": t["run_id"], "messages": model.chat_messages(t)} for t in rows]
        yield pa.RecordBatch.from_arrays([pa.array([t["trace_key"] for t in rows], pa.string()), pa.array([0] * len(rows), pa.int64()), pa.array([json.dumps(x, ensure_ascii=False) for x in docs], pa.string())], ["source", "start", "text"])


def from_docs(spark: SparkSession, docs: list[Any], fmt: str | None = None, tool_names=()) -> DataFrame:
    """Canonical traces of documents in the driver's memory."""
    run = adapter(fmt)
    return model.frame(spark, [t for d in docs for t in run(d, tool_names=tool_names)])
