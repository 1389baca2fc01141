"""URL filters by a cascade of Bloom filters.

The first level encodes the listed keys, the second those keys of the corpus that pass the first by
mistake, the third the listed keys that pass the second, and so on until no mistake is left. Over
the key universe that the cascade was built for, the first level that a key fails tells exactly
whether it is listed, so judging a URL joins with nothing.

Keys are a rule's host and path joined. A URL's keys are its host suffixes and path prefixes of the
shapes (labels, path length) that rules have; the universe is every such key of the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, mix64, prepare

BLOCK, ALLOW = "block", "allow"
#: (host, path, verdict)
RULES = (("com", "/en/", BLOCK), ("example.com", "/en/7", ALLOW), ("net", "/de/", ALLOW), ("example.net", "/de/8", BLOCK), ("org", "/es/", BLOCK))
#: A cascade of more bytes is not broadcast: the keys are split by hash, with a cascade for each part.
BROADCAST_BYTES = 64 << 20


def host_and_path(url) -> tuple:
    """Columns (host, path): both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    salt: int
    words: np.ndarray  # uint64

    def spots(self, k1: np.ndarray, k2: np.ndarray) -> list[np.ndarray]:
        return spots(self.bits, self.hashes, self.salt, k1, k2)

    def passes(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out = np.ones(len(k1), bool)
        for s in self.spots(k1, k2):
            out &= (self.words[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def spots(bits: int, hashes: int, salt: int, k1: np.ndarray, k2: np.ndarray) -> list[np.ndarray]:
    a = mix64(k1.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))
    b = mix64(k2.view(np.uint64) ^ a) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe."""
        out = np.zeros(len(k1), bool)
        open_ = np.arange(len(k1))
        for n, level in enumerate(self.levels):
            ok = level.passes(k1[open_], k2[open_])
            out[open_[~ok]] = n % 2 == 1
            open_ = open_[ok]
        out[open_] = len(self.levels) % 2 == 1
        return out

    @property
    def bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def build_cascade(spark: SparkSession, keys: DataFrame, max_levels: int = 64, max_bytes: int = BROADCAST_BYTES) -> Cascade:
    """``keys(k1, k2, listed)``: the distinct keys of the universe, listed ones included.

    Each level's bits are set by partial words per partition, or-ed per word in Spark; the driver
    gets the finished filter, whose size follows from counted keys and is checked first against
    ``max_bytes``; a larger cascade is a MemoryError, upon which :func:`url_filter` splits the keys.
    """
    with Scratch(spark) as scratch:
        keys = scratch.table(keys)
        counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        listed, others = counts.get(True, 0), counts.get(False, 0)
        levels: list[Level] = []
        if not listed:
            return Cascade(())
        side, n = keys.where("listed"), listed
        opposite = keys.where("NOT listed")
        ratio = listed / max(1, others)
        while n:
            if len(levels) == max_levels:
                raise RuntimeError("two different keys have the same 128-bit hash")
            rate = min(0.5, max(1e-9, math.sqrt(0.5) * ratio)) if not levels else 0.5
            hashes = max(1, round(-math.log2(rate)))
            bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
            if bits / 8 + sum(x.words.nbytes for x in levels) > max_bytes:
                raise MemoryError(f"the cascade needs more than {max_bytes} bytes")
            salt = len(levels) + 1

            def words(batches, bits=bits, hashes=hashes, salt=salt):
                for b in batches:
                    at = np.concatenate(spots(bits, hashes, salt, b.column(0).to_numpy(), b.column(1).to_numpy()))
                    where, inverse = np.unique(at >> 6, return_inverse=True)
                    value = np.zeros(len(where), np.uint64)
                    np.bitwise_or.at(value, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(value.view(np.int64))], ["w", "v"])

            got = side.select("k1", "k2").mapInArrow(words, "w long, v long").groupBy("w").agg(F.expr("bit_or(v)").alias("v")).toPandas()
            filled = np.zeros(-(-bits // 64), np.uint64)
            filled[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(np.uint64)
            level = Level(bits, hashes, salt, filled)
            levels.append(level)

            def wrong(batches, level=level):
                for b in batches:
                    yield b.filter(pa.array(level.passes(b.column(0).to_numpy(), b.column(1).to_numpy())))

            passing = scratch.table(opposite.select("k1", "k2").mapInArrow(wrong, "k1 long, k2 long"))
            side, opposite, n = passing, side, passing.count()
        return Cascade(tuple(levels))


def _keyed(pages: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """Adds ``__keys``: the URL's keys of these (labels, path length) shapes, null where it has none."""
    labels = F.size(F.split("host", r"\."))
    keys = [F.when((F.col("host") != "") & (labels >= n) & (F.length("path") >= m), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m))) for n, m in shapes]
    return pages.withColumn("__keys", F.array(*keys))


def url_filter(spark: SparkSession, pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = ALLOW, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A rule (host, path, verdict) fits its host and all subdomains where the path starts with the
    rule's; the longest (host and path together) wins, ties going to the longer host; ``default`` is the verdict of URLs that no rule
    fits. Null, empty and malformed URLs have empty host and path, no rule and the default verdict.
    Repeated rows are judged alike; an empty table gives an empty result; columns of the input
    named host, path, rule or verdict are replaced. Where a cascade would exceed ``max_bytes``, the keys are
    split by hash and the pages pass one part's cascades after the other.
    """
    prepare(spark)
    rules = sorted(set(rules))
    host, path = host_and_path(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    keyed = _keyed(pages, shapes)
    hashed = [F.xxhash64(F.col("key")).alias("k1"), F.xxhash64(F.lit(1), F.col("key")).alias("k2")]
    corpus = keyed.select(F.explode("__keys").alias("key")).where("key IS NOT NULL").distinct()
    marked = spark.createDataFrame([(h + p, v) for h, p, v in rules], "key string, verdict string")
    with Scratch(spark) as scratch:
        universe = corpus.select("key", F.lit(None).cast("string").alias("verdict")).unionByName(marked).groupBy(*hashed)
        universe = scratch.table(universe.agg(*(F.max(F.coalesce(F.col("verdict") == v, F.lit(False))).alias(v) for v in (BLOCK, ALLOW))))
        split = 1
        while True:
            try:
                judged = _judge_parts(spark, scratch, keyed, universe, split, [m for _, m in shapes], default, max_bytes)
                break
            except MemoryError:
                split *= 2
    judged = judged.drop("__keys", "__best")
    return judged.select(*(c for c in judged.columns if c not in ("rule", "verdict")), "rule", "verdict")


def _judge_parts(spark: SparkSession, scratch: Scratch, pages: DataFrame, universe: DataFrame, split: int, paths: list[int], default: str, max_bytes: int) -> DataFrame:
    """``pages(__keys)`` judged by the cascades of ``split`` parts of the keys, one after the other; a table between two."""
    k1 = F.transform("__keys", lambda k: F.xxhash64(k))
    k2 = F.transform("__keys", lambda k: F.xxhash64(F.lit(1), k))
    pages = pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "__best": F.lit(-1).cast("long")})
    for part in range(split):
        some = universe if split == 1 else universe.where(F.pmod("k1", F.lit(split)) == part)
        sent = spark.sparkContext.broadcast({v: build_cascade(spark, some.select("k1", "k2", F.col(v).alias("listed")), max_bytes=max_bytes) for v in (BLOCK, ALLOW)})  # each within max_bytes
        judged = _judge(sent, split, part, paths)("__keys", k1, k2)
        pages = pages.withColumn("__judged", judged)
        better = F.col("__judged.rank") > F.col("__best")
        pages = pages.withColumns({c: F.when(better, F.col(f"__judged.{x}")).otherwise(F.col(c)) for c, x in (("rule", "rule"), ("verdict", "verdict"), ("__best", "rank"))}).drop("__judged")
        if split > 1:
            pages = scratch.table(pages) if part < split - 1 else scratch.keep(pages)
            sent.unpersist()
    return pages


def _judge(sent, split: int, part: int, paths: list[int]):
    @F.pandas_udf("struct<rank long, rule string, verdict string>")
    def judge(keys: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.DataFrame:
        """Each row's longest listed key among those of this part, ties going to the longer host."""
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        flat = [np.concatenate([np.asarray(x, np.int64) for x in k] or [np.zeros(0, np.int64)]) for k in (k1, k2)]
        flat_keys = [x for row in keys for x in row]
        here = np.fromiter((x is not None for x in flat_keys), bool, len(flat_keys)) & (flat[0] % split == part)
        hit = {v: c.listed(*flat) & here for v, c in sent.value.items()}
        rank, rule, verdict = [-1] * len(keys), [None] * len(keys), [None] * len(keys)
        row, starts = np.repeat(np.arange(len(keys)), sizes), np.cumsum(sizes) - sizes
        for i in np.flatnonzero(hit[BLOCK] | hit[ALLOW]).tolist():
            r, key = row[i], flat_keys[i]
            if (new := len(key) << 32 | len(key) - paths[i - starts[r]]) > rank[r]:
                rank[r], rule[r], verdict[r] = new, key, BLOCK if hit[BLOCK][i] else ALLOW
        return pd.DataFrame({"rank": rank, "rule": rule, "verdict": verdict})

    return judge


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(spark, pages).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT h.page_id, h.host, h.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
