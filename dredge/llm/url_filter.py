"""URL filter: ordered host/path rules, then a Bloom filter cascade over host keys.

The cascade holds a block list exactly, for every key that occurs in the corpus: level 1 encodes the
listed keys, level 2 the other corpus keys that level 1 wrongly accepts, level 3 the listed keys that
level 2 wrongly accepts, and so on until a level makes no mistake. A key is listed if it passes an odd
number of levels. Pages are then judged with broadcast bits alone: no join, no shuffle of pages.

Building shuffles only the distinct keys. Level 1 gets as many bits a key as it takes to accept wrongly no more
other keys than there are listed ones, so every later level encodes at most about that many: all levels together
have about ``n * (1.44 * log2(others / n) + 10 + 10)`` bits for n listed keys in the corpus (3 MB for a million
listed among a thousand million). A level's bits are OR-ed in the shuffle, counted before they are made, and
broadcast. Where a level would need over ``MAX_BITS``, or two keys share a hash (no cascade can tell them
apart), the verdict comes from a join on the keys instead, which needs no bound.

Defined edge cases: a null url or one without ``://`` has the empty host and path, no rule and the
verdict ``allow``; empty labels (``a..b``) make no key; repeated rows are judged alike; an empty table
or an empty list gives an empty cascade; columns besides ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.llm.common import LOWER, UPPER, checkpointed, table

#: (verdict, host, path): the rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The block list of the query: these names under each of these domains, with all subdomains.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{n}.{d}" for n in LISTED_NAMES for d in LISTED_DOMAINS)

#: Bits a key of the levels after the first.
BITS_PER_KEY = 10
#: The largest level: 64 MB.
MAX_BITS = 1 << 29
MAX_LEVELS = 40


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_keys(host: Column) -> Column:
    """A host and all its parent domains, as an array."""
    labels = F.split(host, r"\.")
    keys = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
    )
    return F.filter(keys, lambda k: (k != "") & ~k.startswith("."))


@dataclass
class Cascade:
    """Bit arrays of the levels, each a numpy array of unsigned 64-bit words."""

    levels: list[np.ndarray]
    hashes: list[int]  # hash functions of each level

    def passed(self, hashed: np.ndarray) -> np.ndarray:
        """For 64-bit key hashes, the number of leading levels that accept each."""
        depth = np.zeros(len(hashed), np.int64)
        alive = np.arange(len(hashed))
        for level, bits in enumerate(self.levels):
            alive = alive[contains(bits, hashed[alive], level, self.hashes[level])]
            depth[alive] += 1
        return depth

    def member(self, hashed: np.ndarray) -> np.ndarray:
        return self.passed(hashed) % 2 == 1


def mixed(hashed: np.ndarray, salt: int) -> np.ndarray:
    """A fresh 64-bit hash of a hash (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = hashed.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def positions(hashed: np.ndarray, level: int, n_bits: int, hashes: int) -> np.ndarray:
    """Bit positions of each hash, one row per hash function (double hashing)."""
    a, b = mixed(hashed, 2 * level), mixed(hashed, 2 * level + 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) % np.uint64(n_bits) for i in range(hashes)])


def contains(bits: np.ndarray, hashed: np.ndarray, level: int, hashes: int) -> np.ndarray:
    at = positions(hashed, level, len(bits) * 64, hashes)
    return ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def encode(keys: DataFrame, n_words: int, level: int, hashes: int) -> np.ndarray:
    """The bit array of a level: words are OR-ed per task and again in the shuffle, then collected."""

    def words(batches):
        for batch in batches:
            at = positions(batch.column(0).to_numpy().view(np.uint64), level, n_words * 64, hashes).ravel()
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            ids, where = np.unique(word, return_inverse=True)
            out = np.zeros(len(ids), np.uint64)
            np.bitwise_or.at(out, where, bit)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out.view(np.int64))], ["word", "bits"])

    rows = keys.select("h").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(n_words, np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def level_udf(shared, level: int, hashes: int):
    """Whether one level accepts a key hash."""

    @F.arrow_udf("boolean")
    def accepted(h: pa.Array) -> pa.Array:
        return pa.array(contains(shared.value, h.to_numpy().view(np.uint64), level, hashes))

    return accepted


def member_udf(shared):
    """Whether any hash of an array is of a listed key."""

    @F.arrow_udf("boolean")
    def is_listed(hashed: pa.Array) -> pa.Array:
        flat = hashed.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        hit = np.concatenate([[0], np.cumsum(shared.value.member(flat))])
        ends = np.cumsum(hashed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return pa.array(hit[ends] > hit[starts])

    return is_listed


def level_bits(n: int, others: int) -> int:
    """Bits a key with which a level of n keys accepts wrongly about n / 100 of the others, or n of very many."""
    return max(BITS_PER_KEY, math.ceil(math.log2(max(2, others / max(1, n))) / math.log(2)))


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """Levels over ``universe`` (h: hash of a distinct key, listed: boolean); None if a level would be too large or
    two keys share a hash."""
    cascade = Cascade([], [])
    inside, outside = universe.where("listed").select("h"), universe.where("NOT listed").select("h")
    n, others = inside.count(), outside.count()
    while n:
        level = len(cascade.levels)
        per_key = level_bits(n, others)
        if level >= MAX_LEVELS or n * per_key > max_bits:
            return None
        hashes = max(1, round(per_key * math.log(2)))
        bits = encode(inside, max(1, -(-n * per_key // 64)), level, hashes)
        cascade.levels.append(bits)
        cascade.hashes.append(hashes)
        accepted = level_udf(universe.sparkSession.sparkContext.broadcast(bits), level, hashes)
        wrong = checkpointed(outside.where(accepted("h")))
        inside, outside, n, others = wrong, inside, wrong.count(), n
    return cascade


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    listed: DataFrame,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """page_id, host, path, rule, verdict and whether the host is listed.

    ``listed`` has a column ``key``: hosts that are blocked with all their subdomains.
    """
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    corpus = parts.groupBy("host").agg(F.lit(1).alias("one")).select(F.explode(host_keys(F.col("host"))).alias("key"))
    keys = corpus.withColumns({"here": F.lit(True), "listed": F.lit(False)}).unionByName(
        listed.where("key IS NOT NULL").select(F.translate("key", UPPER, LOWER).alias("key"), F.lit(False).alias("here"), F.lit(True).alias("listed"))
    )
    both = keys.groupBy("key").agg(F.max("here").alias("here"), F.max("listed").alias("listed")).where("here")
    universe = checkpointed(both.select("key", F.xxhash64("key").alias("h"), "listed"))
    cascade = build_cascade(universe, max_bits)
    if cascade is not None:
        is_listed = member_udf(pages.sparkSession.sparkContext.broadcast(cascade))
        judged = parts.withColumn("is_listed", is_listed(F.transform(host_keys(F.col("host")), lambda k: F.xxhash64(k))))
    else:
        bad = parts.select("host").distinct().select("host", F.explode(host_keys(F.col("host"))).alias("key"))
        bad = bad.join(universe.where("listed").select("key"), "key", "left_semi").select("host").distinct()
        judged = parts.join(bad.withColumn("hit", F.lit(True)), "host", "left").withColumn("is_listed", F.coalesce("hit", F.lit(False)))
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("is_listed"), "block").otherwise("allow")
    return judged.withColumn("r", rule).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "is_listed")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest rule and verdict."""
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), RULES, listed)


def _fits(rule: tuple[str, str, str]) -> str:
    _, h, p = rule
    return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"


_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, {" OR ".join(f"(host = '{k}' OR ends_with(host, '.{k}'))" for k in LISTED)} AS is_listed,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r[1]}{r[2]}'" for r in _ORDERED)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r[0]}'" for r in _ORDERED)} END AS ruled FROM c)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN is_listed THEN 'block' ELSE 'allow' END) AS verdict, is_listed FROM d
"""
