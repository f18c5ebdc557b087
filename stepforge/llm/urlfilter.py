"""URL filtering by a blocked Bloom filter before an exact join.

The filter is a table of 512-bit blocks, eight 64-bit words each; a URL has one
block and one bit in each of its words, so a probe touches one row.  Building
it is one grouping with bitwise OR; probing it is a join on the block number,
broadcast while the filter is small, and eight bit tests in generated code.  URLs that pass are joined
exactly with the list, which removes the filter's false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.llm import runtime

#: Bits of filter for each listed URL, before rounding up to a power of two.
BITS_PER_URL = 16
WORDS = 8
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def canonical(url: Column) -> Column:
    """Host in lower case without scheme, user, default port and leading www.; no fragment, no tracking
    parameters, the rest sorted; no trailing slash.  Null stays null."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    other = F.xxhash64(key, F.lit(0x5BD1E995))
    return F.pmod(h, F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(other, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def build_filter(listed: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """The filter's non-empty blocks (block, w0..w7) and the number of blocks."""
    blocks = 1
    while blocks * 64 * WORDS < n * BITS_PER_URL:
        blocks *= 2
    block, masks = _bits(F.col(key), blocks)
    rows = listed.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def drop_listed(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, url, canonical_url) of the pages whose canonical URL is not in ``listed`` (column url).

    URLs are compared by canonical(); a null url is never listed and such a
    page stays with a null canonical_url; an empty url is a URL like others, and
    so is one of any length; urls of another type are read as strings.  Repeated
    pages stay repeated, repeated or null listed URLs make no difference, and an
    empty list removes nothing.  Other columns are not read.  A filter above the
    broadcast limit is joined by shuffling pages and blocks by block number.
    """
    names = listed.select(canonical(F.col("url").cast("string")).alias("listed_url")).filter("listed_url IS NOT NULL").distinct()
    names, _ = runtime.written(names)
    n = names.count()
    p = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("canonical_url", canonical(F.col("url")))
    cols = ["page_id", "url", "canonical_url"]
    if n == 0:
        return p
    filt, blocks = build_filter(names, "listed_url", n)
    block, masks = _bits(F.col("canonical_url"), blocks)
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) != 0)
    blocks_of = runtime.small(filt, blocks, 2 * (WORDS + 1) * 8)  # a hashed row takes twice its payload
    probed = p.withColumn("block", block).join(blocks_of, "block", "left").withColumn("maybe", F.col("canonical_url").isNotNull() & F.coalesce(hit, F.lit(False)))
    sure = probed.filter(~F.col("maybe")).select(cols)
    return sure.unionByName(probed.filter("maybe").select(cols).join(names, F.col("canonical_url") == names["listed_url"], "left_anti"))
