"""Benchmark decontamination by q-gram counting in diagonal bands.

An occurrence of an item of m bytes with at most e edits shares at least
m + 1 - q - e*q q-grams with the text, all on e + 1 neighbouring diagonals
(text position minus item position).  Each item's diagonals are cut into bands
of S + e + 1 diagonals that begin every S and so overlap by e + 1; whatever the
drift, one band holds the whole occurrence.  Bands with enough shared q-grams
are verified by a banded alignment, so the result is exact: every (document,
item) whose best occurrence is within the edit budget, and no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm import runtime
from stepforge.llm import textbuf as tb

Q = 8
#: Length of the q-grams for short items, whose budget q-grams of Q bytes can't support.
SHORT_Q = 5
#: Normalised bytes below which an item is no evidence.
LEAST_BYTES = 8
EDIT_RATE = 0.1
#: Cells of a row of alignment matrices that are worked on at once.
CELLS = 1 << 18
#: Normalised bytes of benchmark that one pass over the documents looks for.
PASS_BYTES = 16 << 20
_SLOT_BITS = 21
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, every run of ASCII punctuation and white space as one space; none at a row's ends."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    data, off = tb.buffers(pc.utf8_lower(texts))
    if not len(data):
        return data, off
    word = tb.WORD[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first byte after a word stands for the gap
    first = off[:-1][np.diff(off) > 0]
    keep[first] = word[first]
    out = np.where(word, data, np.uint8(32))[keep]
    pos = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    off = pos[off]
    ends = off[1:][np.diff(off) > 0]
    trailing = ends[out[ends - 1] == 32] - 1
    if len(trailing):
        stay = np.ones(len(out), bool)
        stay[trailing] = False
        off = off - np.searchsorted(trailing, off)
        out = out[stay]
    return out, off


def grams(d: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes from each position as one number, q at most 8."""
    if len(d) < q:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([d, np.zeros(8 - q, np.uint8)]) if q < 8 else np.ascontiguousarray(d)
    return np.ndarray(len(d) - q + 1, "<u8", padded, 0, (1,)) & np.uint64(256**q - 1)


def edits_for(m: np.ndarray, rate: float) -> np.ndarray:
    return (rate * m).astype(np.int64)


def indexes(ids: list[int | None], texts: list[str | None], rate: float = EDIT_RATE) -> list[Index]:
    """The items by the length of q-gram that supports their budget: Q, SHORT_Q, and shorter ones where ``rate`` is high."""
    d, off = normalised(pa.array(texts, pa.string()))
    m = np.diff(off)
    edits = edits_for(m, rate)
    out, left = [], m >= LEAST_BYTES
    for q in (Q, *range(SHORT_Q, 0, -1)):
        some = left & (m + 1 - q - edits * q >= 1)
        left &= ~some
        if some.any():
            out.append(Index([x for x, ok in zip(ids, some, strict=True) if ok], [x for x, ok in zip(texts, some, strict=True) if ok], rate, q))
    if left.any():
        raise ValueError(f"items of {int(m[left][0])} bytes with {int(edits[left][0])} edits share no q-gram with their occurrences: lower the rate")
    return out


class Index:
    """q-gram postings of the items and each item's budget, threshold and band step."""

    def __init__(self, ids: list[int | None], texts: list[str | None], rate: float = EDIT_RATE, q: int = Q):
        d, off = normalised(pa.array(texts, pa.string()))
        m = np.diff(off)
        self.q, self.ids, self.bytes, self.off, self.m = q, ids, d, off, m
        self.edits = edits_for(m, rate)
        self.need = m + 1 - q - self.edits * q
        self.step = 2 ** np.ceil(np.log2(self.edits + 2)).astype(np.int64)
        g = grams(d, q)
        pos = np.arange(len(g))
        item = tb.owner(pos, off)
        ok = pos + q <= off[item + 1]
        g, item, pos = g[ok], item[ok], pos[ok] - off[item[ok]]
        order = np.argsort(g, kind="stable")
        g, self.item, self.pos = g[order], item[order], pos[order]
        self.gram, self.first = np.unique(g, return_index=True)
        self.count = np.diff(np.r_[self.first, len(g)])
        self.slot = np.zeros(1 << _SLOT_BITS, bool)
        self.slot[(self.gram * _MUL) >> np.uint64(64 - _SLOT_BITS)] = True


def candidates(ix: Index, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, first diagonal of the band, counted from the row's start) of the bands with enough shared q-grams."""
    none = (np.zeros(0, np.int64),) * 3
    g = grams(d, ix.q)
    at = np.flatnonzero(ix.slot[(g * _MUL) >> np.uint64(64 - _SLOT_BITS)])
    where = np.minimum(np.searchsorted(ix.gram, g[at]), len(ix.gram) - 1)
    ok = ix.gram[where] == g[at]
    at, where = at[ok], where[ok]
    row = tb.owner(at, off)
    ok = at + ix.q <= off[row + 1]
    at, where, row = at[ok], where[ok], row[ok]
    if not len(at):
        return none
    n = ix.count[where]
    post = np.repeat(ix.first[where], n) + tb.ragged(n)
    item, row = ix.item[post], np.repeat(row, n)
    diag = np.repeat(at, n) - off[row] - ix.pos[post]
    # no band of a (row, item) can reach the threshold unless all its hits together do
    pair = row * len(ix.m) + item
    if (len(off) - 1) * len(ix.m) <= 1 << 24:
        enough = np.bincount(pair, minlength=(len(off) - 1) * len(ix.m))[pair] >= ix.need[item]
    else:
        _, inv, cnt = np.unique(pair, return_inverse=True, return_counts=True)
        enough = cnt[inv] >= ix.need[item]
    pair, item, diag = pair[enough], item[enough], diag[enough]
    if not len(pair):
        return none
    step = ix.step[item]
    band = diag // step
    again = diag - band * step <= ix.edits[item]
    pair = np.concatenate([pair, pair[again]])
    band = np.concatenate([band, band[again] - 1])
    order = np.lexsort((band, pair))
    pair, band = pair[order], band[order]
    head = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])])
    cnt = np.diff(np.r_[head, len(pair)])
    row, item = pair[head] // len(ix.m), pair[head] % len(ix.m)
    ok = cnt >= ix.need[item]
    return row[ok], item[ok], band[head][ok] * ix.step[item[ok]]


def align(ix: Index, d: np.ndarray, off: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Fewest edits of each candidate's item against any substring of its band: dynamic programming row by row,
    all candidates at once; column k of a row is the cell on diagonal low + k."""
    width = int((ix.step[item] + ix.edits[item]).max()) + 1
    far = np.int32(1 << 20)
    k = np.arange(width, dtype=np.int32)
    inside = k[None, :] < (ix.step[item] + ix.edits[item] + 1)[:, None]
    start, size = off[row], off[row + 1] - off[row]
    padded = np.concatenate([d, np.zeros(1, np.uint8)])
    base = low[:, None] + k[None, :]  # text position before which row 0 stands
    cost = np.where(inside & (base >= 0) & (base <= size[:, None]), np.int32(0), far)
    best = np.full(len(row), far, np.int32)
    m = ix.m[item]
    order = np.argsort(-m, kind="stable")
    row, item, base, cost, inside, start, size, m = (v[order] for v in (row, item, base, cost, inside, start, size, m))
    done = np.empty(len(order), np.int64)
    live = len(order)
    for i in range(int(m[0]) + 1 if len(m) else 0):
        while live and m[live - 1] == i:
            done[live - 1] = cost[live - 1].min()
            live -= 1
        if not live:
            break
        t = base[:live] + i
        ok = (t >= 0) & (t < size[:live, None])
        text = padded[np.where(ok, start[:live, None] + t, len(d))]
        c = cost[:live]
        sub = c + np.where(ok & (text == ix.bytes[ix.off[item[:live]] + i][:, None]), np.int32(0), np.where(ok, np.int32(1), far))
        dele = np.full_like(c, far)
        dele[:, :-1] = c[:, 1:] + 1
        e = np.where(inside[:live] & (t + 1 >= 0) & (t + 1 <= size[:live, None]), np.minimum(sub, dele), far)
        cost[:live] = np.minimum(np.minimum.accumulate(e - k, axis=1) + k, far)
        cost[:live][(t + 1 < 0) | (t + 1 > size[:live, None])] = far
    best[order] = done
    return best


def matches(found_in: list[Index], texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, item id, edits) of every item within its budget in every text."""
    rows, ids, edits = [np.zeros(0, np.int64)], [pa.array([], pa.int64())], [np.zeros(0, np.int64)]
    data, off = tb.buffers(texts)
    for i, j in tb.slices(off):
        d, o = normalised(texts.slice(i, j - i))
        for ix in found_in:
            row, item, low = candidates(ix, d, o)
            order = np.argsort(ix.edits[item], kind="stable")  # bands of like width together
            row, item, low = row[order], item[order], low[order]
            width = ix.step[item] + ix.edits[item] + 1
            out, c = [], 0
            while c < len(row):
                n = max(1, int(np.searchsorted(width[c:] * np.arange(1, len(row) - c + 1), CELLS, side="right")))
                r, t = row[c : c + n], item[c : c + n]
                e = align(ix, d, o, r, t, low[c : c + n])
                ok = e <= ix.edits[t]
                out.append(np.stack([r[ok] + i, t[ok], e[ok]], 1))
                c += n
            if out:
                z = np.concatenate(out)
                z = z[np.lexsort((z[:, 2], z[:, 1], z[:, 0]))]
                z = z[np.r_[True, (z[1:, 0] != z[:-1, 0]) | (z[1:, 1] != z[:-1, 1])]] if len(z) else z
                rows.append(z[:, 0])
                ids.append(pa.array([ix.ids[t] for t in z[:, 1]], pa.int64()))
                edits.append(z[:, 2])
    return np.concatenate(rows), pa.concat_arrays(ids), np.concatenate(edits)


def _passes(benchmark: DataFrame, rate: float):
    """The indexes that each pass over the documents looks for."""
    runtime.text_session(benchmark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    size = F.octet_length("text").cast("long")
    passes = int(items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) // PASS_BYTES + 1
    for p in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else items
        rows = part.orderBy("item_id", "text").collect()
        found_in = indexes([r["item_id"] for r in rows], [r["text"] for r in rows], rate)
        if found_in:
            yield benchmark.sparkSession.sparkContext.broadcast(found_in)


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, edits): every document that holds a benchmark item within its edit budget.

    Text and items are compared in lower case with every run of ASCII
    punctuation and white space as one space.  The budget is ``rate`` of an
    item's bytes, rounded down.  Items of fewer than 8 bytes, and null items,
    are no evidence and match nothing; null and empty texts match nothing.  A
    null doc_id and a null item_id are carried as nulls; repeated documents and
    items are each reported, but a (document row, item row) only once, with its
    fewest edits.  A text of any length is searched whole; many or long items
    cost time, for alignments are worked on CELLS at once.  An empty table on
    either side gives an empty result.  Other columns aren't read.  The
    benchmark is sent to the executors in passes of at most PASS_BYTES; a larger
    one takes more passes over the documents.
    """
    spark = runtime.text_session(docs)
    found = None
    for shared in _passes(benchmark, rate):

        @runtime.trimmed
        def scan(batches, shared=shared):
            for b in batches:
                row, item, edits = matches(shared.value, b.column(1))
                if len(row):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), item, pa.array(edits)], ["doc_id", "item_id", "edits"])

        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, item_id long, edits long")
        found = hits if found is None else found.unionByName(hits)
    empty = {"doc_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "edits": pa.array([], pa.int64())}
    return runtime.rows_of(spark, **empty) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no item, whatever their doc_id; see contamination()."""
    out = docs.withColumn("text", F.col("text").cast("string"))
    at = out.columns.index("text")
    for shared in _passes(benchmark, rate):

        @runtime.trimmed
        def clean(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[matches(shared.value, b.column(at))[0]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(clean, out.schema)
    return out
