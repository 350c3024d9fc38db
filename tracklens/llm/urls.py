"""URL rules by a blocked Bloom filter and an exact hash join.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with the rule's.
A url has one candidate key for each of its host suffixes and path prefixes that has the shape of some rule
(as many labels, as many characters). The Bloom filter has 512-bit blocks: one hash picks the block and eight
bits in it, so a test touches one block. It has BITS_PER_KEY bits a key up to MOST_BLOCKS blocks, fewer beyond, so
its size is bounded. Keys that pass go to a hash join with the list itself, which drops the false positives; the
longest rule that is left decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, free

#: Rules of the registered query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Verdict for urls that no rule fits.
OTHERWISE = "allow"
BITS_PER_KEY = 16
PROBES = 8
WORDS = 8  # of 64 bits in a block
MOST_BLOCKS = 1 << 18  # 16 MB
#: Up to so many words the filter is a literal of the plan; a longer one is a broadcast variable, tested in Arrow batches.
LITERAL_WORDS = 1 << 14
#: Up to so many rules the list is broadcast to the exact join; more are shuffled.
BROADCAST_RULES = 100_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ://."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(get(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), get(2)


def _bits(key: Column, blocks: int) -> list[tuple[Column, Column]]:
    """(word index, mask) of each probe of a key: one block, eight bits of it."""
    h = F.xxhash64(key)
    block = F.pmod(h, F.lit(blocks)).cast("long")
    out = []
    for i in range(PROBES):
        g = F.xxhash64(h, F.lit(i))
        out.append(((block * WORDS + F.pmod(g, F.lit(WORDS))).cast("int"), F.expr("1L"), F.pmod(F.shiftright(g, 8), F.lit(64)).cast("int")))
    return [(w, F.call_function("shiftleft", one, s)) for w, one, s in out]


class BlockedBloom:
    """Words of the filter, made by a bitwise or per word over all keys; the driver gets MOST_BLOCKS * WORDS of them at most."""

    def __init__(self, keys: DataFrame, n: int) -> None:
        (key,) = keys.columns
        self.spark = keys.sparkSession
        self.blocks = max(1, min(MOST_BLOCKS, -(-n * BITS_PER_KEY // (64 * WORDS))))
        bit = F.explode(F.array(*(F.struct(w.alias("w"), m.alias("m")) for w, m in _bits(F.col(key), self.blocks))))
        set_ = keys.select(bit.alias("b")).groupBy("b.w").agg(F.expr("bit_or(b.m)").alias("m")).toPandas()
        self.words = np.zeros(self.blocks * WORDS, dtype=np.int64)
        self.words[set_["w"].to_numpy(dtype=np.int64)] = set_["m"].to_numpy(dtype=np.int64)

    def passing(self, df: DataFrame, keys: str) -> DataFrame:
        """df with those keys of an array column that the list may hold."""
        if len(self.words) <= LITERAL_WORDS:
            words = F.lit(self.words.tolist())
            return df.withColumn(keys, F.filter(keys, lambda k: self._test(lambda w: F.get(words, w), k)))
        sent = self.spark.sparkContext.broadcast(self.words)

        def bits(at: pa.Array, mask: pa.Array) -> pa.Array:
            w, m = at.flatten().to_numpy(zero_copy_only=False), mask.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array((sent.value[w] & m) == m))

        hit, probes = free(df, "hit", "probes")
        df = df.withColumn(probes, F.flatten(F.transform(keys, lambda k: F.array(*(F.struct(w.alias("w"), m.alias("m")) for w, m in _bits(k, self.blocks))))))
        df = df.withColumn(hit, F.arrow_udf(bits, "array<boolean>")(F.transform(probes, lambda p: p["w"]), F.transform(probes, lambda p: p["m"])))
        return df.withColumn(keys, F.filter(keys, lambda k, i: F.forall(F.slice(hit, i * PROBES + 1, PROBES), lambda x: x))).drop(hit, probes)

    def _test(self, word, key: Column) -> Column:
        test = F.lit(True)
        for w, m in _bits(key, self.blocks):
            test = test & (word(w).bitwiseAND(m) == m)
        return test


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict; columns of these names are replaced.

    Of equally long rules the one with the longer host wins; of rules for the same host and path, block. Rules
    with a null host or path are left out. Null urls have an empty host and path, which only an empty rule fits.
    """
    df = df.drop("host", "path", "rule", "verdict")
    key, listed, row, cand, best = free(df, "key", "listed", "row", "cand", "best")
    listing = (
        rules.where("host is not null and path is not null")
        .select(F.concat("host", "path").alias(listed), F.length("host").alias("h"), (F.length("host") + F.length("path")).alias("n"), F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("chars"), "verdict")
        .groupBy(listed, "h", "n", "labels", "chars")
        .agg(F.max("verdict").alias("verdict"))  # block comes after allow
    )
    shapes = [(r[0], r[1]) for r in listing.groupBy("labels", "chars").count().collect()]  # labels and characters of a url are few
    host, path = parts(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    if not shapes:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    labels = F.size(F.split("host", "[.]"))
    shape = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in sorted(shapes)))
    fits = F.filter(shape, lambda x: (labels >= x["n"]) & (F.length("path") >= x["c"]))
    keys = F.transform(fits, lambda x: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -x["n"]), F.substr(F.col("path"), F.lit(1), x["c"])))
    n = listing.count()
    bloom = BlockedBloom(listing.select(listed), n)
    df = bloom.passing(df.withColumn(cand, keys), cand)
    urls = df.where(F.size(cand) > 0).select("host", "path", F.explode(cand).alias(key)).distinct()
    won = (
        urls.join(F.broadcast(listing) if n <= BROADCAST_RULES else listing, F.col(key) == F.col(listed))
        .groupBy("host", "path")
        .agg(F.max(F.struct("n", "h", listed, F.col("verdict").alias("v"))).alias(best))
    )
    # urls with the same host and path may be very many; they are dealt over several tasks
    passed = dealt_join(df.where(F.size(cand) > 0), won, ["host", "path"], "left")
    rest = df.where(F.size(cand) == 0).withColumn(best, F.lit(None).cast(won.schema[best].dataType))
    names = [c for c in df.columns if c != cand]
    out = passed.select(*names, best).unionByName(rest.select(*names, best))
    return out.select(*names, F.col(f"{best}.{listed}").alias("rule"), F.coalesce(F.col(f"{best}.v"), F.lit(otherwise)).alias("verdict"))
