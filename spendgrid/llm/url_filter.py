"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A rule is a canonical ``host + path`` key and a verdict; it fits its host and all subdomains when
the URL's path starts with the rule's. A URL is probed under its host suffixes of as many labels
as some listed host has, and each listed path length. Probes that pass the filter are possible hits; the join keeps the true ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 16
#: Bits set in a 64-bit block per key.
PROBES = 4
#: The filter never grows beyond this; a longer list only passes more false positives on to the join.
MAX_FILTER_BYTES = 8 * 1024 * 1024


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or a URL without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block_and_mask(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a key, and its ``PROBES`` bits inside the 64-bit block."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    h = F.xxhash64(F.concat(key, F.lit("#bits")))
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        bit = F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return block, mask


def build_filter(keys: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> np.ndarray:
    """Blocked Bloom filter of the ``key`` column as 64-bit blocks, one cache line's word a key.

    The blocks are OR-ed by a partial aggregate; what is collected is at most one row per block.
    """
    n = keys.count()
    blocks = 1
    while blocks * 64 < n * BITS_PER_KEY and blocks * 8 < max_bytes:
        blocks *= 2
    block, mask = _block_and_mask(F.col("key"), blocks)
    words = np.zeros(blocks, dtype=np.int64)
    found = keys.select(block.alias("b"), mask.alias("m")).groupBy("b").agg(F.expr("bit_or(m)").alias("m")).toArrow()
    words[found.column("b").to_numpy()] = found.column("m").to_numpy()
    return words


def _probe(words: np.ndarray, spark: SparkSession):
    shared = spark.sparkContext.broadcast(words)  # at most MAX_FILTER_BYTES

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            block = b.column(b.schema.get_field_index("block")).to_numpy()
            mask = b.column(b.schema.get_field_index("mask")).to_numpy()
            hit = (table[block] & mask) == mask
            yield b.filter(pa.array(hit))

    return probe


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``host, path, rule, verdict`` for every distinct URL of ``pages`` (null counts as a URL).

    ``rules(host, path, verdict)``: the longest fitting rule decides, ``host + path`` is its name;
    of equal rules, the smallest verdict. URLs that no rule fits get ``default``. Null and
    malformed URLs have an empty host and path and fit no rule. URLs are made distinct first, so
    a repeated URL is judged once; possible hits are joined to the rules on the exact key.
    """
    spark = pages.sparkSession
    listed = rules.select(F.concat("host", "path").alias("rule"), "host", "path", "verdict").groupBy("rule", "host", "path").agg(F.min("verdict").alias("verdict"))
    keyed = listed.withColumn("key", F.concat_ws(" ", "host", "path"))
    # distinct path lengths and label counts of the list
    lengths = sorted(r[0] for r in keyed.select(F.char_length("path")).distinct().collect())
    labels = sorted(r[0] for r in keyed.select(F.size(F.split("host", r"\."))).distinct().collect())
    words = build_filter(keyed, max_bytes)
    urls = pages.select(F.col(url_col).alias("url")).distinct().withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    # a host that has fewer labels is its own suffix, once
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]).cast("array<string>"))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("path"))
    cand = urls.filter("host <> ''").withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(starts))
    cand = cand.select("url", F.concat_ws(" ", "suffix", F.expr("substring(path, 1, start)")).alias("key"))
    block, mask = _block_and_mask(F.col("key"), len(words))
    cand = cand.select("url", "key", block.alias("block"), mask.alias("mask"))
    hits = cand.mapInArrow(_probe(words, spark), cand.schema).select("url", "key")
    exact = hits.join(keyed.select("key", "rule", "verdict"), "key")
    best = exact.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.char_length("rule")).alias("r"))
    j = urls.alias("u").join(best.alias("b"), F.col("u.url") == F.col("b.url"), "left")
    return j.select("u.url", "u.host", "u.path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


def judge_pages(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``; see ``filter_urls``."""
    verdicts = filter_urls(pages, rules, default, url_col)
    p = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    j = p.join(verdicts.select(F.col("url").alias("_v"), "rule", "verdict"), F.col("_url") == F.col("_v"), "left")
    return j.select(
        F.col("_id").alias(id_col), url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"),
        "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
