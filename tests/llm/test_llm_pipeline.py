import base64
import random

import corpus_pipeline
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from stepforge.llm import bpe, langid, simhash

from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_rows_against_plain_versions(spark):
    import public_tokenizers as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = {r[0] for r in docs.filter(langid._held(F.col("doc_id"))).select("doc_id").collect()}
    known = brute.languages([tuple(r) for r in docs.select("doc_id", "lang", "text").collect()], held)
    left = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if known[r["doc_id"]][2]]
    gone = brute.duplicate_lines(left)
    cut = []
    for d, text in left:
        lines = text.split("\n")
        kept = [x for n, x in enumerate(lines) if (d, n) not in gone]
        if len(kept) == len(lines) or brute.WORD.search("\n".join(kept)):
            cut.append((d, "\n".join(kept)))
    fp, has = simhash.fingerprints(pa.array([t for _, t in cut]))
    first = brute.groups([d for (d, _), ok in zip(cut, has, strict=True) if ok], fp[has], simhash.RADIUS)
    left = [(d, t) for d, t in cut if first.get(d, d) == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute.contamination(left, items)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: enc.encode_ordinary(t) for d, t in left if d not in bad}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    got = {r["doc_id"]: r["token_ids"] for r in rows}
    assert len(rows) == len(got) and all(r["round_trip"] for r in rows)
    assert got == want


def test_odd_rows_from_end_to_end(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = {r["doc_id"]: r["text"] for r in docs.filter("lang = 'en' AND length(text) > 500").limit(40).collect()}
    ids = sorted(some)
    rng = random.Random(2)
    words = " ".join(some.values()).replace("\n", " ").split()
    long = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(80_000))
    rows = [(d, t, "en") for d, t in some.items()]
    rows += [rows[0], rows[0], (None, None, "en"), (10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, long, "en"), (None, " ".join(rng.choices(words, k=200)), None), (None, " ".join(rng.choices(words, k=200)), None), (ids[1], " ".join(rng.choices(words, k=200)), "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit("z").alias(c) for c in ("language", "fp", "h", "version", "copies", "text_hash", "m_doc", "word", "n_tokens")])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "no document holds this sentence of a test")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(long) > 5_000_000 and all(r["round_trip"] for r in got)
    kept = [r["doc_id"] for r in got]
    assert kept.count(10**6 + 2) == 1 and kept.count(None) == 2 and kept.count(ids[0]) == 1 and kept.count(ids[1]) == 2
    assert not {10**6, 10**6 + 1} & set(kept) and set(kept) - {None, 10**6 + 2} <= set(ids)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("language", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SMALL).columns == ["doc_id", "n_tokens", "token_ids", "round_trip"]
