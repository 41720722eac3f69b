"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

Rules are (host, path, verdict). A rule fits a page if the page's host is the rule's host or a
subdomain of it and the page's path starts with the rule's path; the longest rule string wins.
A page has few candidates: for each shape (labels in the host, characters in the path) that some
rule has, the page's last labels plus the start of its path. The Bloom filter removes nearly all
candidates that are not listed; what passes is joined with the rules on the whole string, which
removes the false positives. Pages without a possible hit never enter a shuffle.

The filter is the only thing sent to all tasks; its size is bounded by MAX_BLOCKS (8 MB). Beyond
about four million rules it lets more candidates pass, and the join still decides.

Defined results: null url or no ``://``: host and path empty, no rule. Null or empty rule hosts,
null paths or verdicts: the rule is ignored. Two rules of the same string: the smaller verdict
wins. Repeated pages are judged each. No rules or no pages: default verdicts or no rows."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

WORDS = 8                    # 64-bit words of a block
MAX_BLOCKS = 1 << 17         # 64 bytes each
BITS_PER_RULE = 16
SALTS = [(0x9E3779B1 * (2 * i + 1)) & 0xFFFFFFFF for i in range(WORDS)]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _bit(h: Column, i: int) -> Column:
    low = h.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(SALTS[i] >> 1)  # below 2**63
    return F.shiftrightunsigned(low, 20).bitwiseAND(F.lit(63)).cast("int")


def build_filter(keys: DataFrame, n_keys: int) -> np.ndarray:
    """Bits of a blocked Bloom filter over the column ``key``: one row of words per block."""
    blocks = 1
    while blocks * 64 * WORDS < BITS_PER_RULE * n_keys and blocks < MAX_BLOCKS:
        blocks *= 2
    h = F.col("h")
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(h, i))).alias(f"w{i}")
             for i in range(WORDS)]
    rows = (keys.select(F.xxhash64("key").alias("h"))
            .groupBy(F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(blocks - 1)).alias("block"))
            .agg(*words).collect())  # at most MAX_BLOCKS rows
    bits = np.zeros((blocks, WORDS), dtype=np.uint64)
    for r in rows:
        bits[r.block] = np.array(r[1:], dtype=np.int64).view(np.uint64)
    return bits


def may_contain(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash: all eight bits of its block are set."""
    h = h.astype(np.int64).view(np.uint64)
    block = bits[((h >> np.uint64(40)) & np.uint64(len(bits) - 1)).astype(np.int64)]
    low = h & np.uint64(0xFFFFFFFF)
    hit = np.ones(len(h), dtype=bool)
    for i in range(WORDS):
        at = (low * np.uint64(SALTS[i] >> 1) >> np.uint64(20)) & np.uint64(63)
        hit &= (block[:, i] >> at) & np.uint64(1) == 1
    return hit


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id",
          url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page. See the module's text."""
    spark = pages.sparkSession
    rules = (rules.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull()
                          & F.col("verdict").isNotNull())
             .select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"),
                     "path", "verdict"))
    listed = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.min("verdict").alias("listed"))
    shapes = rules.select(_labels(F.col("host")).alias("n"), F.length("path").alias("m")).distinct().collect()
    bits = build_filter(listed, listed.count())
    sent = spark.sparkContext.broadcast(bits)  # at most 8 MB

    @F.pandas_udf("array<boolean>")
    def possible(hashes: pd.Series) -> pd.Series:
        n = [0 if h is None else len(h) for h in hashes]
        if not sum(n):
            return pd.Series([[] for _ in n])
        hit = may_contain(sent.value, np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes if h is not None]))
        return pd.Series(np.split(hit, np.cumsum(n)[:-1]))

    p = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"),
                     url_path(F.col(url)).alias("path"))
    shape = F.array(*[F.struct(F.lit(r.n).alias("n"), F.lit(r.m).alias("m")) for r in shapes])
    if not shapes:
        return p.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    fits = F.filter(shape, lambda s: (s["n"] <= _labels(F.col("host"))) & (s["m"] <= F.length("path")))
    p = p.withColumn("keys", F.transform(fits, lambda s: F.concat(
        F.call_function("substring_index", F.col("host"), F.lit("."), -s["n"]),
        F.col("path").substr(F.lit(1), s["m"]))))
    p = p.withColumn("seen", possible(F.transform("keys", lambda k: F.xxhash64(k))))
    p = p.withColumn("keys", F.filter("keys", lambda k, i: F.get(F.col("seen"), i))).drop("seen")
    clear = p.filter(F.size("keys") == 0).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rest = (p.filter(F.size("keys") > 0).withColumn("row", F.monotonically_increasing_id())
            .withColumn("key", F.explode("keys")).drop("keys").join(listed, "key", "left")
            .groupBy("row").agg(
                *[F.first(c).alias(c) for c in ("page_id", "host", "path")],
                F.max(F.when(F.col("listed").isNotNull(), F.struct(
                    F.length("key").alias("n"), F.col("key").alias("rule"), F.col("listed")))).alias("best")))
    return clear.unionByName(rest.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                                         F.coalesce("best.listed", F.lit(default)).alias("verdict")))
