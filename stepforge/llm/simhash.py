"""SimHash near-duplicate groups by bit-sliced comparison.

A fingerprint has 128 bits, each the majority vote of the hashes of a
document's distinct words.  Equal fingerprints are merged first, so a hot copy
costs one row.  Candidates meet in tables keyed by masked fingerprints, and the
masks are a covering code: the bits are cut into parts, of which one must differ
in few bits if the whole is within the radius, and for any few bits of a part
some mask of it leaves them all out.  So every pair within the radius meets, and
nothing is missed.  A table's bucket of very many rows is cut into chunks, and
every pair of chunks is a task's work of its own.  Within a task buckets of like
length lie together, and the fingerprints vertically, one bit plane for each
of the 128 bits, 64 rows to a machine word.  One shifted copy of the planes
compares all neighbours of a distance at once; a Harley-Seal tree of carry-save
adders keeps 64 distances in five words, and after every 16 planes the words in
which all lanes exceed the radius are abandoned.  Of the pairs that are found
only some are held at a time: they are counted and joined to a forest as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm import components, runtime
from stepforge.llm import textbuf as tb

BITS = 128
RADIUS = 20
#: Distinct fingerprints up to which the masks have four parts, of 16 kept bits; beyond it three, of 21.
FOUR_PARTS = 1 << 24
#: Rows of a bucket from which it is cut, rows of a chunk, and rows of slots in one task, about.
HOT_ROWS, CHUNK_ROWS, TASK_ROWS = 1 << 16, 1 << 14, 1 << 19
#: Rows of buckets that are compared at once, and near pairs held at a time: a bucket of m near copies has m * m / 2.
BLOCK_ROWS, PIECE_PAIRS = 1 << 15, 1 << 18
#: One in so many fingerprints is counted to find the buckets to cut; what is cut affects only speed.
COUNTED = 64
_FAR = 2**63 - 1


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) words of fingerprint, and whether the text has a word at all."""
    data, off = tb.buffers(texts)
    n = len(texts)
    out, has = np.zeros((n, BITS // 64), np.uint64), np.zeros(n, bool)
    low48 = np.uint64((1 << 48) - 1)
    for i, j in tb.slices(off, 1 << 20):
        for d, o, r0, r1 in _pieces(data, off, i, j):
            s, e = tb.spans(d, o, tb.WORD)
            if not len(s):
                continue
            key = tb.hash_spans(d, s, e) & low48
            key |= tb.owner(s, o).astype(np.uint64) << np.uint64(48)
            key.sort()
            key = key[np.r_[True, key[1:] != key[:-1]]]
            row = (key >> np.uint64(48)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            rows = row[first]
            count = np.diff(np.r_[first, len(row)])
            f = key & low48
            for q in range(BITS // 64):
                bits = np.unpackbits(tb.mix(f + np.uint64(0x9E3779B97F4A7C15 * (q + 1) % 2**64)).view(np.uint8).reshape(-1, 8), axis=1)
                votes = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                out[r0 + rows, q] = np.packbits(2 * votes > count[:, None], axis=1).view(np.uint64)[:, 0]
            has[r0 + rows] = True
    return out, has


def _pieces(data, off, i, j):
    """At most 2**16 rows at a time, as lower-cased bytes."""
    for r0 in range(i, j, 1 << 16):
        r1 = min(j, r0 + (1 << 16))
        yield tb.LOWER[data[off[r0] : off[r1]]], off[r0 : r1 + 1] - off[r0], r0, r1


def _names(bits: int, dim: int) -> np.ndarray:
    """Vectors of ``dim`` bits, not 0, that leave every mask as many bits as can be: all of them, those with the
    highest bit, or the best of some random choices."""
    rng = np.random.default_rng(dim)
    every, half = np.arange(1, 2**dim), np.arange(2 ** (dim - 1), 2**dim)
    choices = [np.resize(every, bits), np.resize(half, bits), *(np.resize(rng.permutation(every), bits) for _ in range(400))]
    return max(choices, key=lambda c: int((np.bitwise_count(c[None, :] & every[:, None]) % 2).sum(axis=1).min()))


def cover(n: int, radius: int = RADIUS) -> np.ndarray:
    """(tables, 2) masks for n distinct fingerprints: of two that differ in at most ``radius`` bits some mask hides all of these.

    Of p parts whose limits r and one more each add up to radius + 1, one
    differs in at most r bits.  Its bits are named by different vectors of
    r + 1 bits; a mask for every vector but 0 keeps the bits whose names have
    an odd product with it, and r names are orthogonal to one of the vectors.
    """
    parts = 4 if n <= FOUR_PARTS else 3
    bits = np.random.default_rng(128).permutation(BITS)
    out = []
    for i, at in enumerate(np.array_split(bits, parts)):
        dim = (radius + 1 + i) // parts
        if dim == 0:
            continue
        names = _names(len(at), dim)
        for v in range(1, 2**dim):
            keep = np.zeros(BITS, np.uint8)
            keep[at[np.bitwise_count(names & v) % 2 == 1]] = 1
            out.append(np.packbits(keep).view(np.uint64))
    return np.array(out)


def _csa(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(planes: np.ndarray, valid: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Rows i for which rows i and i + shift differ in at most ``radius`` bits, among the lanes in ``valid``.

    planes: (BITS, words + room for the shift); valid: (words,), one bit for each row.
    """
    idx = np.flatnonzero(valid)
    alive = valid[idx]
    w, s = divmod(shift, 64)
    zero = np.zeros(len(idx), np.uint64)
    ones = twos = fours = eights = sixteens = over = zero
    s1, s2 = np.uint64(s), np.uint64(64 - s)
    for g in range(0, BITS, 16):
        if not len(idx):
            return np.zeros(0, np.int64)
        p = planes[g : g + 16]
        other = p[:, idx + w]
        if s:
            other = (other >> s1) | (p[:, idx + w + 1] << s2)
        x = p[:, idx] ^ other
        eight = []
        for h in (0, 8):
            four = []
            for q in (h, h + 4):
                ones, t1 = _csa(ones, x[q], x[q + 1])
                ones, t2 = _csa(ones, x[q + 2], x[q + 3])
                twos, f = _csa(twos, t1, t2)
                four.append(f)
            fours, e = _csa(fours, *four)
            eight.append(e)
        eights, c = _csa(eights, *eight)
        over = over | (sixteens & c)
        sixteens = sixteens ^ c
        greater, equal = over, ~zero
        for bit, plane in ((16, sixteens), (8, eights), (4, fours), (2, twos), (1, ones)):
            if radius & bit:
                equal = equal & plane
            else:
                greater = greater | (equal & plane)
                equal = equal & ~plane
        alive = alive & ~greater
        live = alive != 0
        if live.mean() < 0.8:  # abandon words in which no lane can come within the radius
            idx, alive, zero = idx[live], alive[live], zero[live]
            ones, twos, fours, eights, sixteens, over = (v[live] for v in (ones, twos, fours, eights, sixteens, over))
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(bits)
    return idx[word] * 64 + lane


def near_pieces(slot: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one slot within the radius, PIECE_PAIRS or one shift's more at a time; rows of a slot lie together."""
    n = len(slot)
    longest = int(np.diff(np.r_[np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]), n]).max()) if n else 0
    if longest < 2:
        return
    words = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1)
    room = words + longest // 64 + 2
    planes = np.zeros((BITS, room), np.uint64)
    planes.view(np.uint8).reshape(BITS, -1)[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    left, right, held = [], [], 0
    for shift in range(1, longest):
        same = slot[shift:] == slot[:-shift]
        if not same.any():
            break
        valid = np.zeros(words * 8, np.uint8)
        packed = np.packbits(same, bitorder="little")
        valid[: len(packed)] = packed
        i = within(planes, valid.view(np.uint64), shift, radius)
        if not len(i):
            continue
        left.append(i)
        right.append(i + shift)
        held += len(i)
        if held >= PIECE_PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def near_in_buckets(slot: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of near_pieces() at once."""
    pieces = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *near_pieces(slot, fp, radius)]
    return np.concatenate([a for a, _ in pieces]), np.concatenate([b for _, b in pieces])


def _binary(fp: np.ndarray) -> pa.Array:
    """Fingerprints as 16 bytes each."""
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(np.arange(0, 16 * len(fp) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(fp))])


@runtime.trimmed
def _fingerprint_batches(batches):
    for b in batches:
        fp, has = fingerprints(b.column(2))
        keep = pa.array(has)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), _binary(fp[has])], ["doc_id", "h", "fp"])


def _slot_batches(masks: np.ndarray):
    @runtime.trimmed
    def run(batches):
        tables = len(masks)
        number = np.arange(tables, dtype=np.uint64)
        for b in batches:
            fp = tb.buffers(b.column(0))[0].view(np.uint64).reshape(-1, 2)
            for lo in range(0, len(fp), 1024):
                f = fp[lo : lo + 1024]
                slot = tb.mix(tb.mix((f[:, :1] & masks[:, 0]) + number) ^ (f[:, 1:] & masks[:, 1]))
                slot = (slot & ~np.uint64(_TABLE)) | number
                f = f.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot.ravel().view(np.int64)), *(pa.array(np.repeat(f[:, q], tables)) for q in (0, 1))], ["slot", "f0", "f1"])

    return run


#: Low bits of a slot that hold the number of its table.
_TABLE = 1023
_EDGE = "a binary, b binary, n long"


def _first_met(x: np.ndarray, table: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which pairs, by their difference x, meet in ``table`` and in none before it: each pair of fingerprints does once."""
    out = (x[:, 0] & masks[table, 0]) | (x[:, 1] & masks[table, 1]) == 0
    for t in range(int(table.max(initial=0))):
        at = np.flatnonzero(out & (table > t))
        out[at[(x[at, 0] & masks[t, 0]) | (x[at, 1] & masks[t, 1]) == 0]] = False
    return out


def _by_length(slot: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by length of their bucket, without buckets of one row; numbers of the buckets, and where each ends.

    A block of buckets is shifted as often as its longest has rows: among their like, short ones cost few shifts."""
    order = np.lexsort((part, slot))
    s, p = slot[order], part[order]
    start = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1])])
    length = np.diff(np.r_[start, len(s)])
    by = np.argsort(length, kind="stable")
    by = by[length[by] > 1]
    start, length = start[by], length[by]
    ends = np.cumsum(length)
    bucket = np.repeat(np.arange(len(by)), length)
    return order[np.arange(len(bucket)) + (start - ends + length)[bucket]], bucket, ends


def _block_edges(slot, part, chunk, f, bucket, masks: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """What _edge_batches() says, for some whole buckets."""
    u = None
    for a, b in near_pieces(bucket, f, radius):
        # chunks of one bucket meet in several tasks: rows of one chunk are compared where it meets itself
        ok = (chunk[a] != chunk[b]) | (part[a] == 0) | (part[a] == -1 - chunk[a])
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if u is None:
            u, inv = np.unique(f, axis=0, return_inverse=True)
            inv, root, links = inv.ravel(), np.arange(len(u)), np.zeros(len(u), np.int64)
        first = _first_met(f[a] ^ f[b], slot[a] & _TABLE, masks)
        a, b = inv[a], inv[b]
        links += np.bincount(np.concatenate([a[first], b[first]]), minlength=len(u))
        a, b = root[a], root[b]
        apart = a != b
        if apart.any():  # trees of the pieces before are joined by their roots
            node, low = components.forest(a[apart], b[apart])
            root[node] = low
            root = root[root]
    if u is not None:
        node, has = np.flatnonzero(root != np.arange(len(u))), np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([_binary(u[node]), _binary(u[root[node]]), pa.nulls(len(node), pa.int64())], ["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([_binary(u[has]), pa.nulls(len(has), pa.binary()), pa.array(links[has])], ["a", "b", "n"])


def _edge_batches(masks: np.ndarray, radius: int):
    """Edges (a, b) of a forest over the fingerprints of a task, and (a, null, n): n near fingerprints of a, each pair counted once in all tasks."""

    @runtime.trimmed
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        slot, part, chunk = (t.column(q).to_numpy() for q in ("slot", "part", "chunk"))
        fp = np.stack([t.column(q).to_numpy() for q in ("f0", "f1")], 1).view(np.uint64)
        del t, got
        order, bucket, ends = _by_length(slot, part)
        slot, part, chunk, fp = (v[order] for v in (slot, part, chunk, fp))
        del order
        lo = 0
        while lo < len(ends):  # whole buckets, some BLOCK_ROWS at a time
            i = int(ends[lo - 1]) if lo else 0
            lo = max(lo + 1, int(np.searchsorted(ends, i + BLOCK_ROWS, side="right")))
            j = int(ends[lo - 1])
            yield from _block_edges(slot[i:j], part[i:j], chunk[i:j], fp[i:j], bucket[i:j], masks, radius)

    return run


def _cut(slots: DataFrame, distinct: DataFrame, masks: np.ndarray, n: int) -> tuple[DataFrame, int]:
    """``slots`` with ``part`` and ``chunk``: 0 but in buckets of very many rows, whose rows come once for every
    pair of their chunk with another (part > 0) and with itself (part = -1 - chunk); and how many rows that makes, about."""
    rows = n * len(masks)
    plain = slots.withColumns({"part": F.lit(0).cast("long"), "chunk": F.lit(0)})
    if n < HOT_ROWS:
        return plain, rows
    some = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(COUNTED)) == 0).select("fp").mapInArrow(_slot_batches(masks), "slot long, f0 long, f1 long")
    hot, _ = runtime.written(some.groupBy(F.col("slot").alias("hot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(1, HOT_ROWS // COUNTED)).select("hot", "n", F.ceil(F.col("n") * COUNTED / CHUNK_ROWS).cast("int").alias("chunks")))
    many, more = hot.agg(F.count(F.lit(1)), F.sum(F.col("n") * COUNTED * (F.col("chunks") - 1))).first()
    if not many:
        return plain, rows
    c = F.pmod(F.xxhash64("f0", "f1"), F.col("chunks")).cast("int")
    pair = lambda i: F.when(i == F.col("chunk"), (-1 - i).cast("long")).otherwise(F.least(i, F.col("chunk")).cast("long") * F.col("chunks") + F.greatest(i, F.col("chunk")))
    parts = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), pair))
    j = slots.join(runtime.small(hot.select("hot", "chunks"), many, 32), F.col("slot") == F.col("hot"), "left").withColumn("chunk", F.coalesce(c, F.lit(0)))
    return j.select("slot", "f0", "f1", F.explode(parts).alias("part"), "chunk"), rows + more


def _classes(docs: DataFrame, radius: int) -> DataFrame:
    """(doc_id, h, keep_id, keep_h, links): every row whose text has a word, the document that stays of its
    group, and how many other fingerprints are near."""
    spark = runtime.text_session(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps, _ = runtime.written(d.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(_fingerprint_batches, "doc_id long, h long, fp binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    distinct, _ = runtime.written(fps.groupBy("fp").agg(first))
    n = distinct.count()
    masks = cover(n, radius)
    slots = distinct.select("fp").mapInArrow(_slot_batches(masks), "slot long, f0 long, f1 long")
    slots, rows = _cut(slots, distinct, masks, n)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)
    met = slots.repartition(tasks, "slot", "part").mapInArrow(_edge_batches(masks, radius), _EDGE)
    met, _ = runtime.written(met)
    roots = components.components(met.filter("b IS NOT NULL").select("a", "b"))
    links = met.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("links"))
    named = distinct.join(links, F.col("fp") == F.col("a"), "left").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", F.coalesce("links", F.lit(0)).alias("links"))
    kept = named.groupBy("root").agg(F.min("first").alias("keep"))
    named = named.join(kept, "root").select("fp", F.col("keep.doc_id").alias("keep_id"), F.col("keep.h").alias("keep_h"), "links")
    return fps.join(named, "fp").select("doc_id", "h", "keep_id", "keep_h", "links")


def _copies(docs: DataFrame, radius: int) -> DataFrame:
    """(doc_id, h, keep_id, links), each once: the documents that go."""
    with runtime.scratch(docs.sparkSession) as made:
        c = _classes(docs, radius).filter("NOT (doc_id <=> keep_id AND h = keep_h)")
        out, path = runtime.written(c.select("doc_id", "h", "keep_id", "links").distinct())
        made.remove(path)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, keep_id, links) for every document that has a near copy before it in its group.

    Two documents are near copies if their fingerprints differ in at most
    ``radius`` of 128 bits, and every such pair is found; groups are the
    connected components, keep_id is the smallest doc_id of a group and names
    it, and ``links`` counts the different fingerprints that are near the
    document's own.  Words are runs of ASCII letters, digits and non-ASCII
    characters, in lower case.  A text that is null, empty or without words has
    no near copies; a text of any length counts whole.  A null doc_id comes
    after all others and is reported as null.  Rows that share a doc_id are one
    document if their texts are equal, else each takes part (the smaller hash of
    the text first, so that keep_id may equal doc_id).  An empty table gives an
    empty result.  Other columns aren't read.
    """
    return _copies(docs, radius).select("doc_id", "keep_id", "links")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group of near_duplicates().

    Of rows equal in doc_id and text one stays, any of them, if the text has a
    word; rows without words all stay.
    """
    h = runtime.fresh(docs, "text_hash")
    with runtime.scratch(docs.sparkSession) as made:
        c = _classes(docs, radius)
        # rows to drop, and documents that stay but are there more than once
        marks = c.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.expr("doc_id <=> keep_id AND h = keep_h")).alias("stays")).filter("NOT stays OR n > 1")
        marks, path = runtime.written(marks.select(F.col("doc_id").alias("m_doc"), F.col("h").alias("m_h"), "stays"))
        made.remove(path)
    rows = docs.withColumn(h, F.xxhash64(docs["text"].cast("string")))
    m = runtime.small(marks.select("m_doc", "m_h", F.col("stays").alias("m_stays")), marks.count(), 24)
    j = rows.join(m, rows["doc_id"].cast("long").eqNullSafe(m["m_doc"]) & (rows[h] == m["m_h"]), "left")
    columns = [rows[f"`{c}`"] for c in docs.columns]
    out = j.filter(m["m_stays"].isNull()).select(columns)
    if not marks.filter("stays").isEmpty():
        again = j.filter(m["m_stays"]).select(*columns, rows[h])
        out = out.union(again.dropDuplicates(["doc_id", h]).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return out
