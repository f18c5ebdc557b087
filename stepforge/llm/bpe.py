"""Byte-level BPE encoding and decoding on padded matrices.

The text's bytes get character classes, from which the pre-token boundaries
follow by comparing neighbours.  Pre-tokens are hashed; those a worker has not
met are bucketed by length into padded matrices of token ids.  In every round
each row merges its leftmost pair of least rank: ranks come from a hash table
over id pairs, the row closes up over the merged cell, only the two pairs beside
it are looked up again, and finished rows leave the matrix.  A round goes on with
the further pairs of that rank, as the order of merges allows, so that rounds
don't grow with length, and long pre-tokens are first cut where no token of the
vocabulary can lie across.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm import runtime
from stepforge.llm import textbuf as tb

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes above which a pre-token is looked through for places that no token spans.
LONG = 32
NONE = np.int32(2**31 - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _CLASS:
        kind = {"L": _LETTER, "N": _NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[_WHITE] = _SPACE
        _CLASS.append(t)
    return _CLASS[0]


def byte_classes(d: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = _classes()
    c = table[d]
    lead = np.flatnonzero(d >= 0xC0)
    if len(lead):
        b = d[lead].astype(np.int64)
        size = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
        cp = np.where(b >= 0xF0, b & 7, np.where(b >= 0xE0, b & 15, b & 31))
        for i in (1, 2, 3):
            more = size > i
            cp = np.where(more, (cp << 6) | (d[np.minimum(lead + i, len(d) - 1)] & 63), cp)
        kind = table[np.minimum(cp, 0x10FFFF)]
        for i in range(4):
            at = size > i
            c[np.minimum(lead[at] + i, len(d) - 1)] = kind[at]
    return c


def pretokens(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens, as the vocabulary's pattern splits each row."""
    n = len(d)
    if not n:
        return np.zeros(0, np.int64)
    c = byte_classes(d)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(c[1:], c[:-1], out=cut[1:n])
    row = np.zeros(n + 1, bool)
    row[off] = True
    cut |= row
    # white space before anything else in its row: a last plain space goes with what follows, any other last one stands alone
    after = np.flatnonzero(cut[1:n] & ~row[1:n] & (c[:-1] == _SPACE)) + 1
    last = after - 1
    plain = d[last] == 32
    cut[last[plain]] = True
    cut[after[plain]] = False
    last = last[~plain]
    while len(at := last[(d[last] & 0xC0) == 0x80]):  # the first byte of a wide white space
        last = np.where((d[last] & 0xC0) == 0x80, last - 1, last)
        del at
    cut[last] = True
    # contractions: an apostrophe alone in its run, not taken by a space, before s t m d re ve ll
    q = np.flatnonzero(d[:-1] == 39)
    if len(q):
        ok = cut[q] & cut[q + 1] & ~row[q + 1] & (c[q + 1] == _LETTER)
        q = q[ok]
        padded = np.concatenate([d, np.zeros(2, np.uint8)])
        one, two = padded[q + 1], padded[q + 2]
        inside = ~row[np.minimum(q + 2, n)]
        pair = inside & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        single = np.isin(one, (115, 116, 109, 100))
        cut[q[single | pair] + 1] = False
        cut[q[single] + 2] = True
        cut[q[pair & ~single] + 3] = True
    return np.flatnonzero(cut[:n])


class Vocabulary:
    """Ranks, bytes and the hash table of mergeable pairs."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(ranks.values()) + 1
        words = [b""] * size
        for w, r in ranks.items():
            words[r] = w
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.trigrams = np.array(sorted({int.from_bytes(w[i : i + 3]) for w in ranks for i in range(len(w) - 2)} or {-1}), np.int64)
        left, right, rank = [], [], []
        for w, r in ranks.items():
            for i in range(1, len(w)):
                a, b = ranks.get(w[:i]), ranks.get(w[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(10, int(np.ceil(np.log2(max(len(key), 1) * 4))))
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        todo, rank, self.probes = key, np.array(rank, np.int32), 0
        slot = self._slot(todo)
        while len(todo):  # linear probing, all keys a step at a time
            self.probes += 1
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(slot), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.ranks[slot[put]] = todo[put], rank[put]
            todo, rank, slot = todo[~put], rank[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank, and so id, of the token that a and b make; NONE if none."""
        key = (a.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | b.astype(np.uint32).astype(np.uint64)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], NONE)
        at = np.flatnonzero((out == NONE) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(at):
                break
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[at]] == key[at]
            out[at[found]] = self.ranks[slot[at[found]]]
            at = at[~found & (self.keys[slot[at]] != np.uint64(2**64 - 1))]
        return out

    def merge(self, matrix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes the rows of byte ids: (matrix, sizes) with the merged ids first in each row.

        A round merges each row's leftmost pair of least rank and goes on with
        the further places of that rank, left to right, for as long as no merge
        makes a pair of lower rank, which would come first.
        """
        rows, width = matrix.shape
        if width < 2:
            return matrix, size
        rank = np.full((rows, width), NONE, np.int32)
        rank[:, :-1] = self.rank(matrix[:, :-1].ravel(), matrix[:, 1:].ravel()).reshape(rows, width - 1)
        rank[np.arange(1, width + 1)[None, :] >= size[:, None]] = NONE
        active, m, s = np.arange(rows), matrix.copy(), size.copy()
        out, out_size = matrix.copy(), size.copy()
        while len(active):
            best = rank.min(axis=1)
            done = best == NONE
            if done.any():
                out[active[done], : m.shape[1]] = m[done]
                out_size[active[done]] = s[done]
                live = ~done
                if not live.any():
                    break
                most = int(s[live].max())
                active, best, s = active[live], best[live], s[live]
                m, rank = m[live, :most], rank[live, :most]
            w = m.shape[1]
            hit = rank == best[:, None]
            if (hit[:, 1:] & hit[:, :-1]).any():  # places that overlap: every other one of a run
                cell = np.arange(w)[None, :]
                hit &= (cell - np.maximum.accumulate(np.where(hit, -1, cell), axis=1)) % 2 == 1
            ri, ci = np.nonzero(hit)
            new = best[ri]
            joined = (ci > 1) & hit[ri, ci - 2]  # the token before is one of this round
            left, right = np.full(len(ri), NONE), np.full(len(ri), NONE)
            at = np.flatnonzero(ci > 0)
            left[at] = self.rank(np.where(joined[at], new[at], m[ri[at], ci[at] - 1]), new[at])
            at = np.flatnonzero(ci + 2 < s[ri])
            right[at] = self.rank(new[at], m[ri[at], ci[at] + 2])
            early = np.minimum(left, right) < new
            if early.any():
                last = np.full(len(active), w)
                np.minimum.at(last, ri[early], ci[early])
                stay = ci <= last[ri]
                ri, ci, new, joined, left, right = (v[stay] for v in (ri, ci, new, joined, left, right))
            m[ri, ci], rank[ri, ci] = new, right
            at = np.flatnonzero(ci > 0)
            rank[ri[at], ci[at] - 1 - joined[at]] = left[at]
            if len(ri) == len(active):  # one place in each row
                cell = np.arange(w)[None, :]
                to = np.minimum(cell + (cell > ci[:, None]), w - 1)
                m, rank = np.take_along_axis(m, to, axis=1), np.take_along_axis(rank, to, axis=1)
                s = s - 1
            else:
                keep = np.ones((len(active), w), bool)
                keep[ri, ci + 1] = False
                fro, cells = np.nonzero(keep)
                to = np.cumsum(keep, axis=1)[fro, cells] - 1
                m[fro, to], rank[fro, to] = m[fro, cells], rank[fro, cells]
                s = s - np.bincount(ri, minlength=len(active))
            rank[np.arange(1, w + 1)[None, :] >= s[:, None]] = NONE
        return out, out_size

    def segments(self, d: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, word) of the parts of long words that no token can span: a token over a boundary is the
        two bytes beside it, or holds one of the two trigrams that do."""
        size = end - start
        long = np.flatnonzero(size > LONG)
        if not len(long):
            return start, end, np.arange(len(start))
        n = size[long] - 1
        of = np.repeat(long, n)
        p = start[of] + 1 + tb.ragged(n)
        x = np.concatenate([d, np.zeros(1, np.uint8)])
        three = (x[p - 2].astype(np.int64) << 16) | (x[p - 1].astype(np.int64) << 8) | x[p]
        tri = lambda v: self.trigrams[np.minimum(np.searchsorted(self.trigrams, v), len(self.trigrams) - 1)] == v
        cut = self.rank(self.byte_id[x[p - 1]], self.byte_id[x[p]]) == NONE
        cut &= ~((p - 2 >= start[of]) & tri(three))
        cut &= ~((p + 1 < end[of]) & tri(((three << 8) & 0xFFFFFF) | x[p + 1]))
        first, word = np.concatenate([start, p[cut]]), np.concatenate([np.arange(len(start)), of[cut]])
        order = np.lexsort((first, word))
        first, word = first[order], word[order]
        return first, np.where(np.r_[word[1:] == word[:-1], False], np.r_[first[1:], 0], end[word]), word

    def encode_words(self, d: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word), in the words' order."""
        words = len(start)
        start, end, word = self.segments(d, start, end)
        size = end - start
        count = np.zeros(len(start), np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        low, width = 0, 1
        while low < int(size.max(initial=0)):
            rows = np.flatnonzero((size > low) & (size <= width))
            step = max(1, (1 << 22) // width)
            for r in (rows[i : i + step] for i in range(0, len(rows), step)):
                cell = start[r][:, None] + np.arange(width)[None, :]
                inside = np.arange(width)[None, :] < size[r][:, None]
                m = np.where(inside, self.byte_id[d[np.minimum(cell, len(d) - 1)]], np.int32(-1))
                m, s = self.merge(m, size[r])
                count[r] = s
                pieces.append((r, m[np.arange(m.shape[1])[None, :] < s[:, None]]))
            low, width = width, width + (1 if width < 4 else 1 << (width.bit_length() - 2))  # 1 2 3 4 6 8 12 16 24 32 ...
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for r, ids in pieces:
            out[np.repeat(first[r], count[r]) + tb.ragged(count[r])] = ids
        return out, np.bincount(word, count, minlength=words).astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids."""
        n = self.length[ids]
        return self.bytes[np.repeat(self.start[ids], n) + tb.ragged(n)]


class Encoder:
    """A vocabulary with a worker's memory of the words it has encoded."""

    SLOT_BITS = 19
    POOL = 1 << 23

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.SLOT_BITS, np.uint64)
        self.first = np.zeros(1 << self.SLOT_BITS, np.int64)
        self.count = np.zeros(1 << self.SLOT_BITS, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _add(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), at + len(ids)), np.int32)
            grown[:at] = self.pool[:at]
            self.pool = grown
        self.pool[at : at + len(ids)] = ids
        self.used = at + len(ids)
        return at

    def encode(self, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in them)."""
        start = pretokens(d, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        end = np.r_[start[1:], len(d)]
        if self.used > self.POOL:
            self._clear()
        h = tb.hash_spans(d, start, end)
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        first, count = self.first[slot], self.count[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            u, one, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            w = miss[one]
            ids, n = self.v.encode_words(d, start[w], end[w])
            at = self._add(ids) + np.cumsum(n) - n
            first[miss], count[miss] = at[inv], n[inv]
            s = slot[w]
            self.keys[s] = u
            self.first[s], self.count[s] = at, n
        ids = self.pool[np.repeat(first, count) + tb.ragged(count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.searchsorted(start, off)]


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of every row.

    token_ids encode the whole text; round_trip says that decoding them gave
    back the text's bytes.  An empty text has no tokens and round_trip true; a
    null text has nulls in all three.  Repeated rows and null ids are kept as
    they are, an empty table gives an empty one, and other columns aren't read.
    Special tokens' names in a text are ordinary text.  A text of any length is
    encoded whole, in memory in proportion to it; a pre-token of a megabyte goes
    through the same matrices.  Of pairs with equal rank the leftmost is merged.
    """
    shared = runtime.text_session(docs).sparkContext.broadcast(Vocabulary(vocabulary))

    @runtime.trimmed
    def run(batches):
        enc = runtime.kept(f"bpe {vocabulary}", lambda: Encoder(shared.value))
        for b in batches:
            data, off = tb.buffers(b.column(1))
            null = ~np.asarray(b.column(1).is_valid())
            for i, j in tb.slices(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ids, at = enc.encode(d, o)
                back = enc.v.decode(ids)
                same = np.ones(j - i, bool)
                if not np.array_equal(back, d):
                    n = np.concatenate([[0], np.cumsum(enc.v.length[ids])])[at]
                    for r in range(j - i):
                        same[r] = np.array_equal(back[n[r] : n[r + 1]], d[o[r] : o[r + 1]])
                    for r in np.flatnonzero(~same):  # two words with one hash: encode the row without the memory
                        fixed, k = Encoder(enc.v).encode(d[o[r] : o[r + 1]], np.array([0, o[r + 1] - o[r]]))
                        same[r] = np.array_equal(enc.v.decode(fixed), d[o[r] : o[r + 1]])
                        ids = np.concatenate([ids[: at[r]], fixed, ids[at[r + 1] :]])
                        at = np.concatenate([at[: r + 1], at[r + 1 :] + len(fixed) - (at[r + 1] - at[r])])
                void = null[i:j]
                rows = pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.r_[void, False]) if void.any() else pa.array(at, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at), mask=void), rows, pa.array(same, mask=void)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids give a null text, ids outside the vocabulary an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    @runtime.trimmed
    def run(batches):
        v = shared.value
        for b in batches:
            ids = b.column(1)
            null = ~np.asarray(ids.is_valid())
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
            out = v.decode(flat)
            size = np.concatenate([[0], np.cumsum(v.length[flat])])
            at = size[np.concatenate([[0], np.cumsum(n)])]
            text = pa.Array.from_buffers(pa.large_string(), len(n), [pa.array(~null).buffers()[1] if null.any() else None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
