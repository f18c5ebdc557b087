"""Shared storage and size-checked broadcasts for the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a relation of measured size is sent to every executor.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, named by spark.checkpoint.dir.

    Only where the session names none and runs on this machine alone (as in
    tests) is a local folder made; a cluster must name one.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stepforge-")
        sc.setCheckpointDir(where)
    return where


#: Rows and bytes of an Arrow batch on its way to Python, at most.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def text_session(df: DataFrame) -> SparkSession:
    """The session, with Arrow batches bounded for columns of text: a batch of Spark's default 10,000 rows takes tens of
    megabytes in the JVM and again in Python, for every task."""
    spark = df.sparkSession
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        have = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB"))
        if not 0 < have <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


_SCRATCH: list[tuple[list[str], list[str]]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside are removed at the end, but for those that the caller takes out of the list; these
    are left to the scratch around, if there is one."""
    made: list[str] = []
    every: list[str] = []
    _SCRATCH.append((made, every))
    try:
        yield made
    finally:
        _SCRATCH.pop()
        if _SCRATCH:
            for x in _SCRATCH[-1]:
                x += [path for path in every if path not in made]
        for path in made:
            delete(spark, path)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written as Parquet to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stepforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH:
        for x in _SCRATCH[-1]:
            x.append(path)
    return spark.read.parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table made by written() that nothing will read again."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rows_of(spark: SparkSession, **columns: pa.Array | np.ndarray | list) -> DataFrame:
    """A small table of the driver's, handed over as Arrow: no Python worker takes part."""
    return spark.createDataFrame(pa.table(columns))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if ``rows`` rows of ``row_bytes`` fit the limit; else a shuffled join is left to Spark."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Gives freed memory back to the system; allocators otherwise keep it for as long as a Python worker lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """A function of batches that leaves no free memory with its worker when a task ends."""

    @functools.wraps(run)
    def call(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return call


_KEPT: dict[str, object] = {}


def kept(token: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task; only the operator that runs now keeps anything."""
    if token not in _KEPT:
        _KEPT.clear()
        _KEPT[token] = make()
    return _KEPT[token]
