"""URL filters with a cascade of Bloom filters.

Level 1 holds the listed keys. Level 2 holds the unlisted keys of the corpus that
level 1 lets through, level 3 the listed keys that level 2 lets through, and so
on until no key is wrong. The corpus's complete key universe is covered, so the
answer is exact for every key in it, and a task needs only the filters: no join.

A key's two hashes are computed by Spark; filters are built from them by
aggregates and hold at most ``MAX_BYTES``. A list too large for that is split by
hash into several cascades, which are looked up in passes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import written

MAX_BYTES = 64 << 20
FIRST_RATE, RATE = 0.01, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# A level is a plain tuple (bits as uint64 words, size in bits, probes, salt), so
# that tasks can load it without this package.
Level = tuple[np.ndarray, int, int, int]


def has(level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    bits, size, probes, salt = level
    found = np.ones(len(h1), bool)
    for at in _probes(h1, h2, size, probes, salt):
        found &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _probes(h1, h2, size, probes, salt):
    # both hashes enter every probe, mixed anew at each level: keys that meet at one level part at another
    a = (h1.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1) ^ (h2.view(np.uint64) * np.uint64(2 * salt + 1))) * np.uint64(0xFF51AFD7ED558CCD)
    a ^= a >> np.uint64(32)
    b = h2.view(np.uint64) | np.uint64(1)
    for i in range(probes):
        yield (a + np.uint64(i) * b) % np.uint64(size)


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A filter of ``n`` keys (h1, h2): tasks set bits, Spark ors them by word."""
    probes = max(1, round(-np.log2(rate)))
    size = max(64, int(np.ceil(n * probes / np.log(2))))

    def words(batches):
        for frame in batches:
            h1, h2 = frame["h1"].to_numpy(np.int64), frame["h2"].to_numpy(np.int64)
            at = np.unique(np.concatenate([*_probes(h1, h2, size, probes, salt)]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.empty(0, np.uint64)
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": bits.view(np.int64)})

    got = keys.mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # size/64 rows
    out = np.zeros(size // 64 + 1, np.uint64)
    out[got["word"]] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out, size, probes, salt


def contains(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Is the key listed? The first level that has not seen it decides."""
    out = np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    for depth, level in enumerate(levels):
        here = has(level, h1[open_], h2[open_])
        out[open_[~here]] = depth % 2 == 1
        open_ = open_[here]
    out[open_] = len(levels) % 2 == 1
    return out


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(11), key)


def build(listed: DataFrame, universe: DataFrame) -> list[list[Level]]:
    """Cascades for the distinct keys (column ``key``) of ``listed`` over those of
    ``universe``; one unless the list exceeds MAX_BYTES. Null keys are not listed."""
    h1, h2 = key_hashes(F.col("key"))
    inside = listed.where("key is not null").select(h1.alias("h1"), h2.alias("h2")).distinct()
    inside = written(inside, "listed-keys")
    n = inside.count()
    shards = -(-int(n * 10 / 8) // MAX_BYTES) or 1
    out_side = universe.where("key is not null").select(h1.alias("h1"), h2.alias("h2")).distinct()
    out_side = written(out_side.join(inside, ["h1", "h2"], "left_anti"), "unlisted-keys")
    return [_cascade(*(x.where(shard_of(shards) == s) if shards > 1 else x for x in (inside, out_side))) for s in range(shards)]


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("h2"), F.lit(shards))


def _cascade(inside: DataFrame, outside: DataFrame) -> list[Level]:
    levels: list[Level] = []
    wanted, others = inside, outside
    while True:
        n = wanted.count()
        if not n:
            return levels or [_level(inside, 0, RATE, 1)]
        levels.append(_level(wanted, n, RATE if levels else FIRST_RATE, len(levels) + 1))
        passed = _passing(others, levels[-1])
        wanted, others = written(passed, "cascade-wrong"), wanted


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for frame in batches:
            yield frame[has(shared.value, frame["h1"].to_numpy(np.int64), frame["h2"].to_numpy(np.int64))]

    return keys.mapInPandas(run, "h1 long, h2 long")


def _lookup(shared):
    """A column function: the two hash arrays of a row's keys -> which are listed."""

    @F.pandas_udf("array<boolean>")
    def look(chunks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for first, second in chunks:
            sizes = first.map(len).to_numpy(int)
            h1 = np.concatenate([*first, np.empty(0, np.int64)]).astype(np.int64)
            h2 = np.concatenate([*second, np.empty(0, np.int64)]).astype(np.int64)
            yield pd.Series(np.split(contains(shared.value, h1, h2), np.cumsum(sizes)[:-1]) if len(sizes) else [])

    return look


def flag(rows: DataFrame, cascades: list[list[Level]], keys_col: str, out: str) -> DataFrame:
    """``rows`` with ``out``: which of the keys in the array ``keys_col`` are listed
    (array<boolean>, in their order). One pass for each cascade."""
    spark: SparkSession = rows.sparkSession
    keys = F.coalesce(F.col(keys_col), F.array().cast("array<string>"))
    rows = rows.withColumn(out, F.transform(keys, lambda _: F.lit(False)))
    for s, levels in enumerate(cascades):
        look = _lookup(spark.sparkContext.broadcast(levels))
        got = look(F.transform(keys, lambda k: key_hashes(k)[0]), F.transform(keys, lambda k: key_hashes(k)[1]))
        mine = F.transform(keys, lambda k: F.pmod(key_hashes(k)[1], F.lit(len(cascades))) == s)
        rows = rows.withColumn("_got", got).withColumn(out, F.zip_with(out, F.zip_with("_got", mine, lambda a, b: a & b), lambda a, b: a | b)).drop("_got")
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. A null url or one
    without ``://`` has both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column, depth: int) -> Column:
    """The keys under which a url may be listed: the host and each domain above
    it, alone and with each of the path's first ``depth`` prefixes that end in ``/``."""
    labels = F.split(host, r"\.")
    hosts = F.when(host == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.split(path, "/")
    most = F.least(F.size(parts) - 1, F.lit(depth))
    paths = F.transform(F.sequence(F.lit(0), most), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], blocked_hosts: DataFrame, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    ``rules``: (key, verdict) with keys like ``example.net/en/``: a host and a path
    that starts and ends with ``/``. A rule fits its host and all subdomains where
    the url's path starts with the rule's; the longest that fits decides. Where
    none fits, a url is blocked if its host or a domain above it is a key of
    ``blocked_hosts`` (column ``key``). Empty hosts are allowed unless listed.
    Repeated rows are judged each; other columns are not read.
    """
    if any("/" not in key or not key.endswith("/") for key, _ in rules):
        raise ValueError("a rule is a host followed by a path that ends with /")
    spark = pages.sparkSession
    depth = max([key.count("/") for key, _ in rules], default=0)
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", url_keys(F.col("host"), F.col("path"), depth))
    rule_keys = spark.createDataFrame([(key,) for key, _ in rules], "key string")
    listed = rule_keys.unionByName(blocked_hosts.select("key"))
    cascades = build(listed, rows.select(F.explode("keys").alias("key")))
    flagged = flag(rows, cascades, "keys", "listed")
    hits = F.transform(F.filter(F.arrays_zip("keys", "listed"), lambda x: x["listed"]), lambda x: x["keys"])
    fit = F.filter(hits, lambda k: k.contains("/"))
    longest = F.array_max(F.transform(fit, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    verdicts = F.create_map(*[F.lit(x) for rule in rules for x in rule]) if rules else F.lit(None).cast("map<string,string>")
    found = flagged.select("id", "host", "path", longest.alias("rule"), F.exists(hits, lambda k: ~k.contains("/")).alias("blocked"))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")])
                        .otherwise(F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
