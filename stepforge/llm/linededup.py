"""Line deduplication by an exact set-similarity join.

A line is the set of its words.  A line goes if an earlier one, in order of
(doc_id, text version, line number), has Jaccard similarity of at least
``percent`` / 100 with it.  Different texts under one doc_id, or under null, are
versions, numbered from 0 in order of hash; a place is a doc_id and one number
that holds the version above 32 bits and the line number below.

1. One pass over the text counts word occurrences in 2**22 hash buckets and
   lists every line's place and 128-bit BLAKE2b digest, by which lines with the
   same bytes are told.  Such lines are merged, so a hot line is one line from
   here on.
2. A second pass orders each line's words by the counts, rarest first (a global
   order whatever the counts' precision), and sends the prefix that any similar
   line must share a word of.  Words meet in one task; pairs there must pass the
   length filter, the positional filter, and a bound on the symmetric
   difference from 64-bit parity bitmaps of the sets.  A long line is cut by
   word hash into groups of 32 to 64 words, each with a prefix and a bitmap of
   its own: if two lines are similar then so is at least one pair of their
   groups, for the line's overlap and union are sums over the groups.  So a
   bitmap never fills up, whatever a line's length.  At a hot word, one of more
   than HOT occurrences, lines meet by the pair of it and a later word of the
   prefix made one word longer: lines that must share two words share the first
   two there.  So a word of very many lines is many groups, not one.
3. For each line the likeliest earlier partners (least difference of bitmaps)
   are verified: a third pass fetches the words of these lines alone, and the
   Jaccard similarity is computed exactly, on the words themselves.  In a dense group one partner
   settles a line, so pairs stay linear in the lines.  Only if a line had more
   partners than were kept and none of them was similar, the join runs once more
   with all partners, at the prefix words of the lines still open, so the result
   is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm import runtime
from stepforge.llm import textbuf as tb

PERCENT = 80
_BUCKET_BITS = 22
_CHUNK_BITS = 16
_NOT_BREAK = ~tb.table(b"\n")
_LOWEST = -(2**63)
#: Partners of a line that one task sends to verification at first.
PARTNERS = 4
#: Bits of a place's number below the version.
VERSION_BITS = 32
#: Occurrences of a word (of its bucket) from which lines meet by two words.
HOT = 1 << 15
#: Postings' words in one task, about; the number of tasks follows from the corpus.
TASK_WORDS = 1 << 20
#: Ranges of hash by which the versions of one doc_id are numbered.
_RANGE_BITS = 10
_NUMBER = (1 << VERSION_BITS) - 1


class Lines:
    """The lines of a slice that hold a word, and their words in text order."""

    def __init__(self, data: np.ndarray, o: np.ndarray):
        self.data = data
        ls, le = tb.spans(data, o, _NOT_BREAK)
        d = tb.LOWER[data]
        s, e = tb.spans(d, o, tb.WORD)
        self.hash = tb.hash_spans(d, s, e)
        line = np.searchsorted(ls, s, side="right") - 1
        new = np.r_[True, line[1:] != line[:-1]] if len(line) else np.zeros(0, bool)
        used, self.line = line[new], np.cumsum(new) - 1
        self.start, self.end = ls[used], le[used]
        self.row = tb.owner(self.start, o)
        breaks = np.flatnonzero(data == 10)
        self.number = np.searchsorted(breaks, self.start) - np.searchsorted(breaks, o[self.row])

    def key(self) -> np.ndarray:
        return tb.hash_spans(self.data, self.start, self.end, 1).view(np.int64)

    def sets(self, rarity: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(line, word hash) of the distinct words, each line's rarest first; ties by hash."""
        h, line = self.hash, self.line
        q = rarity[h >> np.uint64(64 - _BUCKET_BITS)] if rarity is not None else np.zeros(len(h), np.uint64)
        order = None
        if len(self.start) < 1 << 20:
            key = (line.astype(np.uint64) << np.uint64(44)) | (q << np.uint64(32)) | (h >> np.uint64(32))
            order = np.argsort(key)
            k, g = key[order], h[order]
            if ((k[1:] == k[:-1]) & (g[1:] != g[:-1])).any():
                order = None
        if order is None:
            order = np.lexsort((h, q, line))
        h, line = h[order], line[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])] if len(h) else np.zeros(0, bool)
        return line[new], h[new]


def _walk(b: pa.RecordBatch):
    """Slices of a batch (doc_id, text, version) as (first row, Lines); line numbers hold the version."""
    data, off = tb.buffers(b.column(1))
    version = b.column(2).to_numpy(zero_copy_only=False)
    for i, j in tb.slices(off):
        x = Lines(data[off[i] : off[j]], off[i : j + 1] - off[i])
        if len(x.start):
            x.number = (version[i + x.row] << VERSION_BITS) | x.number
            yield i, x


@runtime.trimmed
def _scan(batches):
    """Rows of lines (k0, k1, doc_id, line_no), and at the end rows of word counts (chunk, counts)."""
    count = np.zeros(1 << _BUCKET_BITS, np.uint32)
    names = ["chunk", "counts", "k0", "k1", "doc_id", "line_no"]
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i, x in _walk(b):
            np.add.at(count, x.hash >> np.uint64(64 - _BUCKET_BITS), np.uint32(1))
            m = len(x.start)
            key = tb.digests(x.data, x.start, x.end)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(ids[i + x.row]), pa.array(x.number)], names)
    for c in range(1 << (_BUCKET_BITS - _CHUNK_BITS)):
        part = count[c << _CHUNK_BITS : (c + 1) << _CHUNK_BITS]
        at = np.flatnonzero(part)
        if len(at):
            blob = at.astype(np.uint16).tobytes() + part[at].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([blob], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(4))], names)


@runtime.trimmed
def _sum_counts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n = len(blob) // 6
            t = total.setdefault(c, np.zeros(1 << _CHUNK_BITS, np.uint64))
            t[np.frombuffer(blob[: 2 * n], np.uint16)] += np.frombuffer(blob[2 * n :], np.uint32)
    for c, t in total.items():
        blob = np.minimum(4095, np.log2(t + 1.0) * 100).astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "counts"])


def least_overlap(percent: int, total):
    """Words that two sets with ``total`` words between them must share."""
    return -(-percent * total // (100 + percent))


#: log2(1 + 1) in the units of _sum_counts: a bucket hit once holds a word that no other line has.
_ONCE = 100


#: Words of a group at which a 64-bit bitmap still tells sets apart.
GROUP_WORDS = 32


def splits(n: np.ndarray) -> np.ndarray:
    """log2 of the number of groups into which a line of n words is cut: groups have 32 to 64 words on average."""
    return np.log2(np.maximum(n // GROUP_WORDS, 1)).astype(np.int64)


def _group_postings(x: Lines, doc, key, line, h, n, split, sent, rarity, percent: int, hot: int) -> pa.RecordBatch:
    """Prefix postings of the groups of the lines in ``sent``; words come sorted by line and rarity."""
    use = sent[line]
    line, h = line[use], h[use]
    group = (h >> np.uint64(6)).astype(np.int64) & ((1 << split[line]) - 1)
    if split[sent].any():
        order = np.lexsort((group, line))  # stable: words stay in order of rarity
        line, h, group = line[order], h[order], group[order]
    first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (group[1:] != group[:-1])])
    size = np.diff(np.r_[first, len(line)])
    of = line[first]
    parity = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), first)
    need = -(-percent * size // 100)
    prefix = size - need + 1
    owner = np.repeat(np.arange(len(size)), prefix)
    pos = tb.ragged(prefix)
    at = first[owner] + pos
    rare = rarity[h[at] >> np.uint64(64 - _BUCKET_BITS)]
    shared = rare > _ONCE
    owner, pos, at, rare = owner[shared], pos[shared], at[shared], rare[shared]
    second = np.zeros(len(at), np.uint64)
    many = rare > min(4095, int(np.log2(hot + 1) * 100))
    if many.any():
        # groups that may share one word alone meet at it, all at two words of the longer prefix
        one = ~many | (need[owner] == 1)
        more = np.where(many, np.minimum(size[owner], prefix[owner] + 1) - pos - 1, 0)
        src, step = np.repeat(np.arange(len(at)), more), tb.ragged(more) + 1
        also = h[at[src] + step]
        ok = rarity[also >> np.uint64(64 - _BUCKET_BITS)] > _ONCE
        src, also = src[ok], also[ok]
        owner, pos, at = (np.concatenate([v[one], v[src]]) for v in (owner, pos, at))
        second = np.concatenate([second[one], tb.mix(also | np.uint64(1))])
    # lines that are cut alike meet; the word before is 0 at the start: if two groups agree in it they have met there already
    cut = tb.mix(split[of[owner]].astype(np.uint64) + np.uint64(1))
    before = np.where(pos > 0, h[at - 1] >> np.uint64(32), np.uint64(0))
    word = ((h[at] ^ cut ^ second) & ~np.uint64(0xFFFFFFFF)) | before
    of = of[owner]
    cols = (word.view(np.int64), (n[of] << 36) | (size[owner] << 18) | pos, key[of], parity[owner].view(np.int64), doc[of], x.number[of])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _POSTING)


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among sorted keys."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values if len(keys) else np.zeros(len(values), bool)


def _postings(rarity_of, percent: int, hot: int, wanted=None):
    """``wanted`` gives the sorted words (32 bits) to which the postings are restricted."""

    @runtime.trimmed
    def run(batches):
        rarity = rarity_of().astype(np.uint64)
        # lines sent lately from an earlier place aren't sent again; others are merged where they arrive
        recent = np.zeros((3, 1 << 16), np.int64)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, x in _walk(b):
                doc, key = ids[i + x.row], x.key()
                order = np.lexsort((x.number, doc, key))
                fresh = np.zeros(len(key), bool)
                fresh[order] = np.r_[True, key[order][1:] != key[order][:-1]]
                slot = key & 0xFFFF
                k, d, n = recent[:, slot]
                fresh &= (k != key) | (doc < d) | ((doc == d) & (x.number < n))
                recent[:, slot[fresh]] = np.stack([key, doc, x.number])[:, fresh]
                line, h = x.sets(rarity)
                n = np.bincount(line, minlength=len(x.start))
                first_split, other = splits(n), splits(-(-percent * n // 100))
                for split, sent in ((first_split, fresh), (other, fresh & (other != first_split))):
                    if sent.any():
                        out = _group_postings(x, doc, key, line, h, n, split, sent, rarity, percent, hot)
                        if wanted is not None:
                            out = out.filter(pa.array(_among(out.column(0).to_numpy() >> 32, wanted())))
                        if out.num_rows:
                            yield out

    return run


_POSTING = ["word", "size_pos", "k", "parity", "doc_id", "line_no"]


def similar_in_groups(word, size, pos, key, parity, place, percent: int, most: int | None = None, whole=None):
    """(earlier row, later row, difference of bitmaps) of pairs with one word that pass every filter, and the rows
    that met more than ``most`` earlier partners, whose pairs may be incomplete.

    word: the word above 32 bits, the word before it below; place: (rows, 2), document and line number.
    ``size`` counts the words of a posting's group, ``whole`` those of its line.
    Postings of equal lines are merged into the earliest place.
    """
    whole = size if whole is None else whole
    rank = np.empty(len(word), np.int64)
    rank[np.lexsort((place[:, 1], place[:, 0]))] = np.arange(len(word))
    before, word = word & np.uint64(0xFFFFFFFF), (word >> np.uint64(32) << np.uint64(18)) | size.astype(np.uint64)
    order = np.lexsort((rank, key, word))
    word, key, parity = word[order], key[order], parity[order]
    if len(word):
        keep = np.r_[True, (word[1:] != word[:-1]) | (key[1:] != key[:-1]) | (parity[1:] != parity[:-1])]
        order, word, parity = order[keep], word[keep], parity[keep]
    rank, before, size, pos, whole = (v[order] for v in (rank, before, size, pos, whole))
    word >>= np.uint64(18)
    full = np.zeros(len(word), np.int64)
    out, at, shift = [np.zeros((3, 0), np.int64)], np.arange(len(word)), 0
    while len(at):
        shift += 1
        at = at[at + shift < len(word)]
        to = at + shift
        # sorted by size: once a partner is too long or has another word, so are all later ones
        ok = (word[at] == word[to]) & (100 * size[at] >= percent * size[to])
        at, to = at[ok], to[ok]
        later = np.where(rank[at] > rank[to], at, to)
        total = size[at] + size[to]
        apart = total - 2 * least_overlap(percent, total)
        # no word before this one is shared, or the pair met there: so all of them differ
        ok = (pos[at] + pos[to] <= apart) & (100 * np.minimum(whole[at], whole[to]) >= percent * np.maximum(whole[at], whole[to])) & ((before[at] != before[to]) | (pos[at] == 0) | (pos[to] == 0))
        if most is not None:
            ok &= full[later] <= 4 * most
        a, b, later, apart = at[ok], to[ok], later[ok], apart[ok]
        diff = np.bitwise_count(parity[a] ^ parity[b]).astype(np.int64)
        ok = diff <= apart
        a, b, later, diff = a[ok], b[ok], later[ok], diff[ok]
        np.add.at(full, later, 1)
        out.append(np.stack([order[a + b - later], order[later], diff]))
    pairs = np.concatenate(out, axis=1)
    return pairs, order[full > most] if most is not None else order[:0]


def _candidates(percent: int, most: int | None):
    @runtime.trimmed
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        word, sp, key, parity, doc, line = (t.column(c).to_numpy() for c in range(6))
        pairs, cut = similar_in_groups(word.view(np.uint64), (sp >> 18) & 0x3FFFF, sp & 0x3FFFF, key, parity.view(np.uint64), np.stack([doc, line], 1), percent, most, sp >> 36)
        x, y, diff = pairs
        # rows of one line at one place are one: (y's place, difference, x's place), the likeliest first
        order = np.lexsort((line[x], doc[x], diff, line[y], doc[y]))
        x, y = x[order], y[order]
        same = lambda v: v[1:] == v[:-1]
        if len(x):
            keep = np.r_[True, ~(same(doc[x]) & same(line[x]) & same(doc[y]) & same(line[y]))]
            x, y = x[keep], y[keep]
        new = np.flatnonzero(np.r_[True, ~(same(doc[y]) & same(line[y]))]) if len(y) else np.zeros(0, np.int64)
        many = np.diff(np.r_[new, len(y)])
        more = np.zeros(len(y), bool)
        if most is not None:
            more = np.repeat(many > most, many)
            if len(cut):
                more |= np.isin(tb.mix(doc[y].view(np.uint64)) + line[y].astype(np.uint64), tb.mix(doc[cut].view(np.uint64)) + line[cut].astype(np.uint64))
            keep = tb.ragged(many) < most
            x, y, more = x[keep], y[keep], more[keep]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc[x], line[x], doc[y], line[y], more)], ["xd", "xl", "yd", "yl", "more"])

    return run


@runtime.trimmed
def _fetch(batches):
    """Words of the wanted lines, each with a space after it: (doc_id, text, version, lines) -> (doc_id, line_no, words)."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        data, off = tb.buffers(b.column(1))
        version = b.column(2).to_numpy(zero_copy_only=False)
        many = np.asarray(b.column(3).value_lengths()).astype(np.int64)
        want = (np.repeat(np.arange(len(many)), many) << 32) | (np.asarray(b.column(3).flatten()) & _NUMBER)
        for i, j in tb.slices(off):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e = tb.spans(d, o, _NOT_BREAK)
            row = tb.owner(s, o)
            breaks = np.flatnonzero(d == 10)
            number = np.searchsorted(breaks, s) - np.searchsorted(breaks, o[row])
            hit = np.isin(((i + row) << 32) | number, want)
            s, e, row, number = s[hit], e[hit], row[hit], number[hit]
            if not len(s):
                continue
            size = e - s
            text, at = tb.LOWER[d[np.repeat(s, size) + tb.ragged(size)]], np.concatenate([[0], np.cumsum(size)])
            ws, we = tb.spans(text, at, tb.WORD)
            n = np.bincount(tb.owner(ws, at), minlength=len(s))
            size = we - ws
            word_at = np.concatenate([[0], np.cumsum(size + 1)])
            joined = np.full(word_at[-1], 32, np.uint8)
            joined[np.repeat(word_at[:-1], size) + tb.ragged(size)] = text[np.repeat(ws, size) + tb.ragged(size)]
            line_at = word_at[np.concatenate([[0], np.cumsum(n)])]
            words = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(line_at.astype(np.int64)), pa.py_buffer(joined)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids[i + row]), pa.array((version[i + row] << VERSION_BITS) | number), words], ["doc_id", "line_no", "words"])


def _verified(d: DataFrame, pairs: DataFrame, percent: int, once: bool) -> DataFrame:
    """The (yd, yl) of ``pairs`` whose word sets are similar to those at (xd, xl); ``once`` says that no two rows of ``d`` are equal."""
    places = pairs.select(F.col("xd").alias("doc_id"), F.col("xl").alias("line_no")).union(pairs.select("yd", "yl")).distinct()
    needed, _ = runtime.written(places.groupBy("doc_id", F.shiftright("line_no", VERSION_BITS).alias("version")).agg(F.collect_list("line_no").alias("lines")))
    stats = needed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    with_lines = d.join(runtime.small(needed, int(stats[0]) * 6 + int(stats[1]), 8), ["doc_id", "version"])
    words = with_lines.select("doc_id", "text", "version", "lines").mapInArrow(_fetch, "doc_id long, line_no long, words string")
    words, _ = runtime.written(words if once else words.dropDuplicates(["doc_id", "line_no"]))
    of = lambda s: words.select(F.col("doc_id").alias(f"{s}d"), F.col("line_no").alias(f"{s}l"), F.col("words").alias(f"{s}w"))
    both = pairs.select("xd", "xl", "yd", "yl").distinct().join(of("x"), ["xd", "xl"]).join(of("y"), ["yd", "yl"])
    both = both.select("yd", "yl", *[F.array_distinct(F.split(c, " ")).alias(c) for c in ("xw", "yw")])
    # every set has one empty word, after the last space
    both = both.select("yd", "yl", (F.size(F.array_intersect("xw", "yw")) - 1).alias("o"), (F.size("xw") + F.size("yw") - 2).alias("n"))
    return both.filter((100 + percent) * F.col("o") >= percent * F.col("n")).select("yd", "yl").distinct()


def _versions(docs: DataFrame) -> DataFrame | None:
    """(doc, h1, h2, version, copies) of the texts whose doc_id, null among them, has several rows; None if there are none.

    Equal rows of doc_id and text are one version and counted in ``copies``.
    Versions are counts of whole hash ranges plus a rank within one, so the
    texts of one doc_id aren't sorted in one place.
    """
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    ids, _ = runtime.written(docs.groupBy(id_.alias("doc")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc"))
    count = ids.count()
    if not count:
        return None
    texts = docs.select(id_.alias("doc"), *_text_hash()).join(runtime.small(ids, count, 16), "doc", "left_semi")
    each, _ = runtime.written(texts.groupBy("doc", "h1", "h2").agg(F.count(F.lit(1)).alias("copies")).withColumn("range", F.shiftright("h1", 64 - _RANGE_BITS)))
    sizes = each.groupBy("doc", "range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("doc", "range", (F.sum("n").over(Window.partitionBy("doc").orderBy("range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("doc", "range").orderBy("h1", "h2")) - 1
    out, _ = runtime.written(each.withColumn("rank", rank).join(before, ["doc", "range"]).select("doc", "h1", "h2", (F.col("before") + F.col("rank")).alias("version"), "copies"))
    return out


def _text_hash() -> tuple[Column, Column]:
    text = F.col("text").cast("string")
    return F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")


def _with_versions(docs: DataFrame, versions: DataFrame | None, version: str, copies: str) -> DataFrame:
    """``docs`` with its rows' versions and copies; 0 and 1 where a doc_id has one row."""
    if versions is None:
        return docs.withColumns({version: F.lit(0).cast("long"), copies: F.lit(1).cast("long")})
    v = runtime.small(versions, versions.count(), 48).select(F.col("doc").alias("v_doc"), F.col("h1").alias("v_h1"), F.col("h2").alias("v_h2"), F.col("version").alias("v_version"), F.col("copies").alias("v_copies"))
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST)) == v["v_doc"]) & (F.xxhash64(docs["text"].cast("string")) == v["v_h1"]) & (F.hash(docs["text"].cast("string")) == v["v_h2"])
    joined = docs.join(v, on, "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce(v["v_version"], F.lit(0)).alias(version), F.coalesce(v["v_copies"], F.lit(1)).alias(copies))


def _marked(docs: DataFrame, versions: DataFrame | None, percent: int, partners: int, hot: int = HOT) -> DataFrame:
    """(doc_id, line_no, c): the places to remove, null as the lowest id; see duplicate_lines()."""
    with runtime.scratch(docs.sparkSession) as made:
        out, path = runtime.written(_places(docs, versions, percent, partners, hot))
        made.remove(path)
    return out


def _places(docs: DataFrame, versions: DataFrame | None, percent: int, partners: int, hot: int) -> DataFrame:
    spark = runtime.text_session(docs)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = _with_versions(d, versions, "version", "copies").select("doc_id", "text", "version")
    if versions is not None:
        d, _ = runtime.written(d)  # several passes follow
    scanned, _ = runtime.written(d.mapInArrow(_scan, "chunk int, counts binary, k0 long, k1 long, doc_id long, line_no long"))
    lines = scanned.filter("chunk IS NULL").select("k0", "k1", "doc_id", "line_no")
    repeated = lines.groupBy("k0", "k1").agg(F.min(F.struct("doc_id", "line_no")).alias("p"), F.max(F.struct("doc_id", "line_no")).alias("q")).filter("p < q").select("k0", "k1", "p")
    copies = lines.join(repeated, ["k0", "k1"]).filter(F.struct("doc_id", "line_no") != F.col("p")).select("doc_id", "line_no").distinct()

    # 2**22 counts of two bytes, however large the corpus
    sums = scanned.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(_sum_counts, "chunk int, counts binary")
    rarity = np.zeros(1 << _BUCKET_BITS, np.uint16)
    for r in sums.toLocalIterator():
        rarity[r["chunk"] << _CHUNK_BITS : (r["chunk"] + 1) << _CHUNK_BITS] = np.frombuffer(r["counts"], np.uint16)
    shared = spark.sparkContext.broadcast(rarity)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((np.exp2(rarity / 100) - 1).sum()) // TASK_WORDS)

    columns = "word long, size_pos long, k long, parity long, doc_id long, line_no long"
    word = F.shiftright("word", 32)
    met = d.mapInArrow(_postings(lambda: shared.value, percent, hot), columns).repartition(tasks, word)
    schema = "xd long, xl long, yd long, yl long, more boolean"
    pairs, _ = runtime.written(met.mapInArrow(_candidates(percent, partners), schema))
    near, _ = runtime.written(_verified(d, pairs, percent, versions is None))
    unsure = pairs.filter("more").select("yd", "yl").distinct().join(near, ["yd", "yl"], "left_anti")
    unsure, _ = runtime.written(unsure)
    if not unsure.isEmpty():
        # the partners of these lines are found at their own prefix words alone
        theirs = d.join(F.broadcast(unsure.select("yd").distinct()) if unsure.count() * 16 <= runtime.BROADCAST_BYTES else unsure.select("yd").distinct(), F.col("doc_id") == F.col("yd"), "left_semi")
        theirs = theirs.mapInArrow(_postings(lambda: shared.value, percent, hot), columns)
        keys, _ = runtime.written(theirs.join(unsure, (F.col("doc_id") == F.col("yd")) & (F.col("line_no") == F.col("yl")), "left_semi").select(word.alias("w")).distinct())
        if keys.count() * 8 <= runtime.BROADCAST_BYTES:
            few = spark.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy()))
            again = d.mapInArrow(_postings(lambda: shared.value, percent, hot, lambda: few.value), columns)
        else:
            again = d.mapInArrow(_postings(lambda: shared.value, percent, hot), columns).join(keys, word == F.col("w"), "left_semi")
        every = again.repartition(tasks, word).mapInArrow(_candidates(percent, None), schema)
        every, _ = runtime.written(every.join(unsure, ["yd", "yl"], "left_semi"))
        near = near.union(_verified(d, every, percent, versions is None)).distinct()
    marked = near.select(F.col("yd").alias("doc_id"), F.col("yl").alias("line_no"), F.lit(0).alias("c")).union(copies.select("doc_id", "line_no", F.lit(1)))
    return marked.groupBy("doc_id", "line_no").agg(F.max("c").alias("c"))


def duplicate_lines(docs: DataFrame, percent: int = PERCENT, partners: int = PARTNERS, hot: int = HOT) -> DataFrame:
    """(doc_id, line_no, copy) of every line to remove; copy says that an earlier line has the same bytes.

    Lines are what line feeds separate, numbered from 0; words are runs of
    ASCII letters, digits and non-ASCII characters in lower case.  A line is
    removed if an earlier line, itself removed or not, is similar enough.
    Lines without words are never removed; null and empty texts have none.  A
    null doc_id counts as the smallest (its lines come back with a null
    doc_id).  Rows that share a doc_id, or have none, are documents of their own
    if their texts differ, in order of the texts' hashes; a number then comes
    back once for each text.  Rows equal in doc_id and text are one document
    here.  Of lines as similar to each other the earliest stays.  An empty table
    gives an empty result; a document of any length is read whole, and a slice
    holds it whole.  Other columns aren't read.  ``partners`` and ``hot`` affect
    speed only.
    """
    marked = _marked(docs, _versions(docs), percent, partners, hot)
    doc = F.when(F.col("doc_id") != _LOWEST, F.col("doc_id")).alias("doc_id")
    return marked.select(doc, F.col("line_no").bitwiseAND(_NUMBER).alias("line_no"), (F.col("c") == 1).alias("copy"))


def drop_duplicate_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, with the lines of duplicate_lines() cut out of ``text``.

    A document all of whose lines with words go is dropped; other documents
    keep their remaining lines in order, and n_chars, where there is such a
    column, is the new length.  Of rows equal in doc_id and text that keep a
    word one is left, any of them: the others' lines all have an equal one
    before them.
    """
    doc, version, copies, key, number, cut = (runtime.fresh(docs, n) for n in ("doc_key", "text_version", "text_copies", "cut_doc", "cut_version", "cut_lines"))
    versions = _versions(docs)
    removed = _marked(docs, versions, percent, PARTNERS).groupBy(F.col("doc_id").alias(key), F.shiftright("line_no", VERSION_BITS).alias(number)).agg(F.collect_list(F.col("line_no").bitwiseAND(_NUMBER).cast("int")).alias(cut))
    removed, _ = runtime.written(removed)
    stats = removed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(cut)), F.lit(0))).first()
    placed = _with_versions(docs, versions, version, copies).withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)))
    joined = placed.join(runtime.small(removed, int(stats[0]) * 12 + int(stats[1]), 4), (F.col(doc) == F.col(key)) & (F.col(version) == F.col(number)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(cut, i)), "\n")
    out = joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept))
    word = F.coalesce(F.col("text").rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]"), F.lit(False))
    out = out.filter(F.col(cut).isNull() | word)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    if versions is not None:
        repeated = (F.col(copies) > 1) & word
        out = out.filter(~repeated).union(out.filter(repeated).dropDuplicates([doc, version]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
