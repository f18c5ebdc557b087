"""Sharding by balanced label propagation.

Documents that share a line are neighbours, once for each line they share; a
shard is a label.  All shards start equally full, with no regard to lines.  In
every round half of the documents (another half each time, so that two
neighbours don't swap for ever) ask for the shard that holds most of their
neighbours, if it beats their own.  Every pair of documents of a line counts,
however many they are, yet none is built: a line's documents are counted by
shard, and a document's votes are the counts of its lines without itself.  Moves
are granted so that no shard outgrows its capacity: between two shards as many
one way as the other, and beyond that as many as fit into the target's free
room; the moves with the greatest gains go first.  They are found by counting
moves by gain and hash, so none of the pairs of shards is sorted.  Each round is a few Spark
joins; its labels are written to the shared folder, so a lost executor costs at
most a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm import runtime
from stepforge.llm import textbuf as tb

SHARDS = 16
SLACK = 0.05
ROUNDS = 8
_NOT_BREAK = ~tb.table(b"\n")


@runtime.trimmed
def _line_keys(batches):
    """(key, doc_id) of every distinct line with a word in it."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        data, off = tb.buffers(b.column(1))
        for i, j in tb.slices(off):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e = tb.spans(d, o, _NOT_BREAK)
            if not len(s):
                continue
            has = np.add.reduceat(tb.WORD[d], s, dtype=np.int64) > 0
            key = np.stack([ids[i + tb.owner(s, o)], tb.hash_spans(d, s, e).view(np.int64)], 1)[has]
            key = np.unique(key, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 1]), pa.array(key[:, 0])], ["key", "doc_id"])


def _document_lines(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return d.mapInArrow(_line_keys, "key long, doc_id long")


def shared_lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id), each once: the lines with a word that more than one document has."""
    runtime.text_session(docs)
    lines, path = runtime.written(_document_lines(docs))
    keys = lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("key")
    out, _ = runtime.written(lines.join(keys, "key").distinct())
    runtime.delete(docs.sparkSession, path)
    return out


def even_start(nodes: DataFrame, shards: int) -> DataFrame:
    """(node, shard): position in order of hash, modulo the shards; sizes differ by one at most.

    Positions are counts of whole hash ranges plus a rank within one range, so
    nothing is sorted in one place.
    """
    h = nodes.select("node", F.xxhash64("node").alias("h")).withColumn("range", F.shiftrightunsigned("h", 50).cast("int"))
    sizes = h.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # at most 2**14 rows
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("h", "node")) - 1
    return h.withColumn("rank", rank).join(F.broadcast(before), "range").select("node", F.pmod(F.col("before") + F.col("rank"), F.lit(shards)).cast("int").alias("shard"))


def active(node: Column, r: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(node, F.lit(r)), 7), F.lit(2)) == 0


def quotas(asked: dict[tuple[int, int], int], size: list[int], cap: int, least: int) -> dict[tuple[int, int], int]:
    """Moves granted for each (from, to): as many as go the other way, and beyond that what fits the target's
    room up to ``cap`` and leaves the source ``least``."""
    both = {p: min(x, asked.get(p[::-1], 0)) for p, x in asked.items()}
    extra = {p: x - both[p] for p, x in asked.items()}
    for end, room in ((1, [max(0, cap - s) for s in size]), (0, [max(0, s - least) for s in size])):
        total: dict[int, int] = {}
        for p, x in extra.items():
            total[p[end]] = total.get(p[end], 0) + x
        extra = {p: x if total[p[end]] <= room[p[end]] else x * room[p[end]] // total[p[end]] for p, x in extra.items()}
    return {p: both[p] + extra[p] for p in asked}


def wishes(placed: DataFrame, ask: Column) -> DataFrame:
    """(u, src, dst, gain) of the documents that ``ask`` picks and that have more neighbours in another shard than in their own.

    ``placed``: (key, u, src), a line, a document that has it and the document's shard.
    """
    counts = placed.groupBy("key", F.col("src").alias("shard")).agg(F.count(F.lit(1)).alias("n"))  # at most ``shards`` rows a line
    others = F.col("n") - (F.col("shard") == F.col("src")).cast("long")
    votes = placed.filter(ask).join(counts, "key").groupBy("u", "src", "shard").agg(F.sum(others).alias("w"))
    best = votes.groupBy("u", "src").agg(F.max(F.struct("w", (-F.col("shard")).alias("to"))).alias("best"), F.max(F.when(F.col("shard") == F.col("src"), F.col("w"))).alias("own"))
    return best.select("u", "src", (-F.col("best.to")).alias("dst"), (F.col("best.w") - F.col("own")).alias("gain")).filter("src <> dst AND gain > 0")


def granted(moves: DataFrame, quota: DataFrame) -> DataFrame:
    """(node, dst) of the moves that ``quota`` (src, dst, quota) lets go: those with the greatest gains, to a
    sixteenth of a doubling, and among these those of the least hash.

    Moves are counted by cells of gain and hash; whole cells go, and a rank is
    taken in the one cell of each pair of shards that goes in part.
    """
    u = F.col("u")
    m = moves.withColumns({"level": F.floor(-16 * F.log2("gain")).cast("int"), "part": F.shiftrightunsigned(F.xxhash64(u), 54).cast("int")})
    cell = ["src", "dst", "level", "part"]
    upto = Window.partitionBy("src", "dst").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, 0)
    cells = m.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    go = cells.join(F.broadcast(quota), ["src", "dst"]).withColumn("left", F.col("quota") - F.col("upto") + F.col("n")).filter("left > 0").select(*cell, "n", "left")
    m = m.join(go, cell)
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(F.xxhash64(u), u))
    part = m.filter("n > left").withColumn("rank", rank).filter("rank <= left")
    return m.filter("n <= left").select(u.alias("node"), "dst").union(part.select(u.alias("node"), "dst"))


def balanced_labels(nodes: DataFrame, lines: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) for every node; sizes stay within ``slack`` of n / shards, or of one where the even start differs by more.

    ``lines``: (key, doc_id), each once; see shared_lines().  After ``rounds``
    rounds the labels stand as they are, settled or not: each round cuts less
    than the last, and more of them cost a few joins each.
    """
    spark = nodes.sparkSession
    labels, path = runtime.written(even_start(nodes.select("node").distinct(), shards))
    n = labels.count()
    cap = -(-n * round((1 + slack) * 10000) // (shards * 10000))
    least = n * round((1 - slack) * 10000) // (shards * 10000)
    for r in range(rounds):
        placed, placed_path = runtime.written(lines.join(labels, F.col("doc_id") == F.col("node")).select("key", F.col("doc_id").alias("u"), F.col("shard").alias("src")))
        moves, moves_path = runtime.written(wishes(placed, active(F.col("u"), r)))
        runtime.delete(spark, placed_path)
        asked = {(x["src"], x["dst"]): x["n"] for x in moves.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards squared at most
        if not asked:
            runtime.delete(spark, moves_path)
            continue
        size = [0] * shards
        for x in labels.groupBy("shard").count().collect():
            size[x["shard"]] = x["count"]
        quota = [(a, b, q) for (a, b), q in quotas(asked, size, cap, least).items()]  # shards squared at most
        src, dst, most = zip(*quota, strict=True)
        go = granted(moves, runtime.rows_of(spark, src=pa.array(src, pa.int32()), dst=pa.array(dst, pa.int32()), quota=pa.array(most, pa.int64())))
        nxt, nxt_path = runtime.written(labels.join(go, "node", "left").select("node", F.coalesce("dst", "shard").alias("shard")))
        runtime.delete(spark, path)
        runtime.delete(spark, moves_path)
        labels, path = nxt, nxt_path
    return labels


def cut_pairs(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """One row (cut, total): pairs of documents that share a line, once for each such line, between shards and in all.

    ``labels``: (node, shard); ``lines``: (key, doc_id), each once.
    """
    n = lines.join(labels, F.col("doc_id") == F.col("node")).groupBy("key", "shard").agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("n"))
    of = n.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    pairs = lambda twice: F.coalesce(F.sum(twice) / 2, F.lit(0)).cast("decimal(38,0)")
    square = (F.col("all") * F.col("all")).cast("decimal(38,0)")
    return of.agg(pairs(square - F.col("squares")).alias("cut"), pairs(square - F.col("all")).alias("total"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, shard) for every doc_id; see balanced_labels() and shared_lines().

    Documents are neighbours by equal lines that hold a word.  Null and empty
    texts have none and stay where the even start put them.  A null doc_id has no
    shard and is left out; rows that share a doc_id are one document.  Ties
    between shards go to the lowest number.  A text of any length is read whole;
    an empty table gives an empty result.  Other columns aren't read.
    """
    nodes = docs.select(F.col("doc_id").cast("long").alias("node")).filter("node IS NOT NULL")
    with runtime.scratch(docs.sparkSession) as made:
        out, path = runtime.written(balanced_labels(nodes, shared_lines(docs), shards, slack, rounds))
        made.remove(path)
    return out.select(F.col("node").alias("doc_id"), "shard")
