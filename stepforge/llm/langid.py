"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ORDER bytes long with the
counts of the bytes that followed.  A byte costs -log2 of its share in the
longest context that has seen it, each longer context that has not costs an
escape (method C: distinct successors over distinct successors plus total), and
a byte no context has seen costs eight bits more.  The statistics are frozen, so
a byte's cost depends on its ORDER preceding bytes alone; a text's code length
is the sum over all its bytes, and the language with the shortest code wins.

A text is accepted if it is written in languages that the statistics know, be it
several: its parts of SEGMENT bytes are each coded in their best language, and
what their letters take in sum is held against what those of held-out documents
took, plus a margin.  Digits and signs tell nothing of a language there.

Costs are doubles.  A worker caches the costs of the windows it has met in a
direct-mapped table; windows missing there are resolved from the context trees,
so the table affects only speed.  Letters count in lower case.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.llm import runtime
from stepforge.llm import textbuf as tb

ORDER = 4
#: Labelled documents of each language that are learnt from, chosen by a hash of doc_id.
SAMPLE_PER_LANG = 300
#: One in so many of them is held out of the statistics and sets the limit of its language.
HOLD_OUT = 5
#: Held-out documents without which a language's limit is RAW_BITS.
LEAST_HELD = 8
RAW_BITS = 8.0
#: The limit in bits a byte of letters: this share of the held-out documents take less, and a margin.
QUANTILE, MARGIN_BITS = 0.99, 1.5
#: Bits beyond the limit that any text may take, so that a few names or keys don't reject a short one.
SLACK_BITS = 256
#: Bytes of the parts that may each be in another language.
SEGMENT = 64
#: Values in a worker's cache, of all languages together, as a power of two.
_CACHE_BITS = 21
#: Letters, and every byte of a multi-byte character.
_LETTER = tb.WORD & ~tb.table(b"0123456789")
_LANG = np.uint64(8 * (ORDER + 1))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_START = 10  # a text begins as if after ORDER line ends
_MASK = [np.uint64(256 ** (k + 1) - 1) for k in range(ORDER + 1)]


def windows(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte, it and its ORDER predecessors in its own row as one number, the byte lowest."""
    n = len(d)
    if not n:
        return np.zeros(0, np.uint64)
    pad = np.full(n + 7, _START, np.uint8)
    pad[7:] = d
    key = np.ndarray(n, ">u8", pad, 0, (1,)).astype(np.uint64) & _MASK[ORDER]
    first = off[:-1][np.diff(off) > 0]
    last = off[1:][np.diff(off) > 0]
    for i in range(ORDER):
        at = (first + i)[first + i < last]
        before = np.uint64(sum(_START << (8 * j) for j in range(i + 1, ORDER + 1)))
        key[at] = (key[at] & _MASK[i]) | before
    return key


class Model:
    """Costs of grams and escapes for every order; a language's number stands above a gram's 40 bits."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], limits: np.ndarray | None = None):
        """counts: for each order, (language number, gram of order + 1 bytes, count), each gram of a language once."""
        self.langs = langs
        self.limits = np.full(len(langs), RAW_BITS) if limits is None else limits
        self.grams, self.cost, self.contexts, self.escape = {}, {}, {}, {}
        for k in range(ORDER + 1):
            lang, gram, count = counts.get(k, (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            own = lang.astype(np.uint64) << _LANG
            self.contexts[k], at = np.unique(own | (gram >> np.uint64(8)), return_inverse=True)
            total, distinct = np.bincount(at, count), np.bincount(at)
            self.escape[k] = -np.log2(distinct / (distinct + total))
            order = np.argsort(own | gram)
            self.grams[k] = (own | gram)[order]
            self.cost[k] = -np.log2(count / (total + distinct)[at])[order]

    def bits(self, key: np.ndarray) -> np.ndarray:
        """(languages, windows) code length of each window's last byte, in bits."""
        out = np.zeros((len(self.langs), len(key)))
        for i in range(len(self.langs)):
            open_ = np.arange(len(key))
            for k in range(ORDER, -1, -1):
                if not len(open_) or not len(self.grams[k]):
                    continue
                own = np.uint64(i) << _LANG
                g = key[open_] & _MASK[k]
                at = np.minimum(np.searchsorted(self.grams[k], own | g), len(self.grams[k]) - 1)
                seen = self.grams[k][at] == own | g
                out[i, open_[seen]] += self.cost[k][at[seen]]
                open_, c = open_[~seen], g[~seen] >> np.uint64(8)
                at = np.minimum(np.searchsorted(self.contexts[k], own | c), len(self.contexts[k]) - 1)
                met = self.contexts[k][at] == own | c
                out[i, open_[met]] += self.escape[k][at[met]]
            out[i, open_] += RAW_BITS
        return out


class Scorer:
    """A model with a worker's cache of window costs."""

    def __init__(self, model: Model):
        self.model = model
        self.slot_bits = max(10, _CACHE_BITS - max(1, len(model.langs)).bit_length())
        self.keys = np.full(1 << self.slot_bits, 2**64 - 1, np.uint64)
        self.values = np.zeros((len(model.langs), 1 << self.slot_bits))

    def code_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, languages) code lengths in bits; the bits of the rows' letters, each part in its best language; the bytes of these."""
        data, off = tb.buffers(pc.utf8_lower(texts))
        n = len(self.model.langs)
        out, parts, letters = np.zeros((len(texts), n)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, j in tb.slices(off):
            o = off[i : j + 1] - off[i]
            d = data[off[i] : off[j]]
            key, letter = windows(d, o), _LETTER[d]
            if not len(key) or not n:
                continue
            slot = ((key * _MUL) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
            miss = np.flatnonzero(self.keys[slot] != key)
            fresh = None
            if len(miss):
                u, inv = np.unique(key[miss], return_inverse=True)
                fresh = self.model.bits(u)
            rows = np.flatnonzero(np.diff(o))
            many = -(-np.diff(o)[rows] // SEGMENT)
            start = np.repeat(o[rows], many) + tb.ragged(many) * SEGMENT
            first = np.cumsum(many) - many
            best = np.full(len(start), np.inf)
            for w in range(n):
                v = self.values[w][slot]
                if fresh is not None:
                    v[miss] = fresh[w][inv]
                out[i + rows, w] = np.add.reduceat(v, o[rows])
                np.minimum(best, np.add.reduceat(v * letter, start), out=best)
            parts[i + rows] = np.add.reduceat(best, first)
            letters[i + rows] = np.add.reduceat(letter, o[rows], dtype=np.int64)
            if fresh is not None:
                at = ((u * _MUL) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
                self.keys[at] = u  # of windows that share a slot the last stays, in keys and values alike
                self.values[:, at] = fresh
        return out, parts, letters


def _count_batches(langs: list[str]):
    number = {x: i for i, x in enumerate(langs)}

    @runtime.trimmed
    def run(batches):
        for b in batches:
            data, off = tb.buffers(pc.utf8_lower(b.column(1)))
            lang = np.array([number[x] for x in b.column(0).to_pylist()], np.uint64)
            for i, j in tb.slices(off):
                o = off[i : j + 1] - off[i]
                key = windows(data[off[i] : off[j]], o)
                of = np.repeat(lang[i:j], np.diff(o))
                for k in range(ORDER + 1):
                    u, c = np.unique((key & _MASK[k]) | (of << np.uint64(48)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array((u >> np.uint64(48)).astype(np.int32)), pa.array((u & _MASK[ORDER]).astype(np.int64)), pa.array(c.astype(np.int64))], ["k", "lang", "gram", "n"])

    return run


def _held(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc, F.lit(HOLD_OUT)), F.lit(HOLD_OUT)) == 0


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Context trees of every value of ``lang``, and their limits, from at most ``per_lang`` labelled documents each.

    The sample is the documents with the smallest hashes of doc_id, so it
    doesn't depend on the order or number of files; whole texts are counted.  Of
    rows that share lang and doc_id the smallest text is taken.  Rows with a
    null lang, doc_id or text teach nothing.  The model grows with the number of
    languages, not with the table.
    """
    spark = runtime.text_session(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = d.select("lang", "doc_id").withColumn("rn", F.dense_rank().over(rank)).filter(F.col("rn") <= per_lang).select("lang", "doc_id").distinct().collect()
    langs = sorted({r["lang"] for r in ids})
    if not langs:
        return Model([], {})
    chosen = runtime.rows_of(spark, lang=pa.array([r["lang"] for r in ids], pa.string()), doc_id=pa.array([r["doc_id"] for r in ids], pa.int64()))
    with runtime.scratch(spark):
        sample, _ = runtime.written(d.join(runtime.small(chosen, len(ids), 48), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text")))
        held = _held(F.col("doc_id"))
        t = sample.filter(~held).select("lang", "text").mapInArrow(_count_batches(langs), "k int, lang int, gram long, n long").groupBy("k", "lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        k, lang, gram, n = (t.column(c).to_numpy() for c in ("k", "lang", "gram", "n"))
        lang, gram = lang.astype(np.int64), gram.astype(np.uint64)
        model = Model(langs, {q: (lang[k == q], gram[k == q], n[k == q]) for q in range(ORDER + 1)})
        shared = spark.sparkContext.broadcast(model)

        @runtime.trimmed
        def score(batches):
            scorer = Scorer(shared.value)
            for b in batches:
                _, parts, letters = scorer.code_lengths(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts / np.maximum(letters, 1)), pa.array(letters)], ["lang", "bits", "size"])

        took = sample.filter(held).select("lang", "text").mapInArrow(score, "lang string, bits double, size long").filter("size > 0").select("lang", "bits").collect()
    for i, x in enumerate(langs):
        bits = [r["bits"] for r in took if r["lang"] == x]
        if len(bits) >= LEAST_HELD:
            model.limits[i] = np.quantile(bits, QUANTILE) + MARGIN_BITS
    return model


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("language", "bits_per_byte", "accepted")) -> DataFrame:
    """All columns of ``docs`` and three more: the language, the best code's bits for each byte, and whether it is accepted.

    ``names`` must not be among the columns of ``docs``.  A text that is null or
    empty is not accepted, nor one whose letters, each part in its best language,
    take more bits a byte than the limit of the whole text's best language, and
    SLACK_BITS besides (a text without letters is accepted); without bytes, or under a model without languages,
    language and bits are null.  Equal code lengths go to the first language in
    order of name.  A text of any length is scored whole.  Repeated rows and
    null ids are rows like others; an empty table gives an empty result.
    """
    spark = runtime.text_session(docs)
    shared = spark.sparkContext.broadcast(model)
    token = uuid.uuid4().hex
    at = docs.columns.index("text")

    @runtime.trimmed
    def run(batches):
        scorer = runtime.kept(token, lambda: Scorer(shared.value))
        langs = np.array([*scorer.model.langs, None], object)
        for b in batches:
            n = b.num_rows
            code, parts, letters = scorer.code_lengths(b.column(at))
            size = np.diff(tb.buffers(b.column(at))[1])
            best = np.argmin(code, axis=1) if len(langs) > 1 else np.zeros(n, np.int64)
            bits = code[np.arange(n), best] / np.maximum(size, 1) if len(langs) > 1 else np.zeros(n)
            void = (size == 0) | (len(langs) == 1)
            limit = scorer.model.limits[best] if len(langs) > 1 else np.zeros(n)
            found = [pa.array(langs[np.where(void, len(langs) - 1, best)], pa.string()), pa.array(bits, mask=void), pa.array(~void & (parts <= limit * letters + SLACK_BITS))]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *names])

    rows = docs.withColumn("text", F.col("text").cast("string"))
    fields = T.StructType([*rows.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return rows.mapInArrow(run, fields)


def language_id(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(doc_id, language, bits_per_byte, accepted) of every row; see fit() and identify()."""
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, per_lang)).select("doc_id", "language", "bits_per_byte", "accepted")


def keep_identified(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """The rows of ``docs``, all columns, in one of the languages that its labels name; see identify()."""
    names = tuple(runtime.fresh(docs, n) for n in ("language", "bits_per_byte", "accepted"))
    return identify(docs, fit(docs, per_lang), names).filter(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
