"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

# Bytes of text that a Python task turns into token arrays at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: the
    lineage ends there, and a lost executor costs only a new read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def hash_pair(*cols) -> tuple[Column, Column]:
    """128 bits of hash in two longs."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(-7046029254386353131), *cols)


def hot_split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: int = 100,
                   hot: list[tuple] | None = None) -> DataFrame:
    """Equi-join against ``right`` (one row per key) whatever the skew of ``left``.

    The ``most`` commonest keys of the left side are joined by broadcast, so that
    no key of the rest holds more than ``1/most`` of the rows. ``keys`` must not be
    null. ``hot`` names the commonest keys where the caller knows them; else they are
    counted first, so ``left`` is best a stored table.
    """
    if hot is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        hot = [tuple(r[k] for k in keys) for r in counts.orderBy(F.desc("_n")).limit(most).collect()]
    if not hot:
        return left.join(right, keys, how)
    hot_keys = left.sparkSession.createDataFrame(hot, left.select(*keys).schema)
    mark = left.join(F.broadcast(hot_keys.withColumn("_hot", F.lit(True))), keys, "left")
    cold = mark.where("_hot is null").drop("_hot").join(right, keys, how)
    hot_right = right.join(F.broadcast(hot_keys), keys, "left_semi")
    return cold.unionByName(mark.where("_hot").drop("_hot").join(F.broadcast(hot_right), keys, how))


def size_slices(sizes, limit: int = SLICE_BYTES):
    """(from, to) ranges of ``sizes`` that come to ``limit`` at most; a larger one is a range of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def slices(texts, limit: int = SLICE_BYTES):
    """``size_slices`` of texts by their characters."""
    return size_slices([len(t) if t else 0 for t in texts], limit)


def hashed_words(token_lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens in a row, and the count of each list."""
    import itertools

    import xxhash

    lens = np.fromiter(map(len, token_lists), np.int64, len(token_lists))
    flat = np.empty(int(lens.sum()), object)
    flat[:] = list(itertools.chain.from_iterable(token_lists))
    codes, uniq = pd.factorize(flat)
    known = np.fromiter((xxhash.xxh3_64_intdigest(u) for u in uniq), np.uint64, len(uniq))
    return (known[codes] if len(uniq) else np.empty(0, np.uint64)), lens


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 in, uint64 out)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_hashes(words: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each list, in order, and how many each list has
    (none for lists shorter than ``n``)."""
    counts = np.maximum(lens - n + 1, 0)
    if len(words) < n:
        return np.empty(0, np.uint64), counts
    h = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    ends = np.cumsum(lens)
    starts = ends - lens
    keep = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts) if c] or [np.empty(0, np.int64)])
    return h[keep.astype(np.int64)], counts
