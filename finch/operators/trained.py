"""Embeddings trained on the corpus: weighted signed hashing, then a linear reduction.

A text's tokens are hashed to ``wide`` buckets with a sign each; a bucket weighs by how few
of the texts hold it (counted over all of them). The wide vectors are reduced to ``dim`` values by
the leading right singular vectors of the whole (texts x buckets) matrix, found by randomised
power iteration: each round every task multiplies its texts with the current basis and back,
the partial products are summed by bucket, and a ``wide x dim`` matrix is made orthogonal. The matrix of
texts is never stored dense and never moves; what reaches the driver has a size set by the parameters.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import run_lengths, token_buckets
from ..session import scratch_path

WIDE, DIM = 4096, 64
ROUNDS = 6
SLICE = 512                     # texts that a task holds dense at a time
MODEL_BYTES = 64 << 20          # a larger model is refused: it is broadcast


class Embedder(NamedTuple):
    weights: np.ndarray         # (wide,)
    basis: np.ndarray           # (wide, dim), orthonormal columns


def signed_buckets(text, wide: int = WIDE) -> Column:
    """array<int>: a number below ``2 * wide`` for each token: its bucket, plus ``wide`` where its sign is negative."""
    return token_buckets(text, 2 * wide)


def bucket_weights(ids: DataFrame, wide: int = WIDE) -> np.ndarray:
    """ln((1 + n) / (1 + df)) + 1 by bucket, from rows (ids) of all texts."""
    n = ids.count()
    held = ids.select(F.explode(F.array_distinct(F.transform("ids", lambda x: x % wide))).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(wide)
    for r in held.collect():                              # at most ``wide`` rows
        df[r["b"]] = r["df"]
    return np.log((1 + n) / (1 + df)) + 1


def weighted_pairs(ids: Column, weights: np.ndarray) -> Column:
    """array<struct<b int, x double>>: the wide vector by bucket, buckets whose signs cancel left out."""
    wide = len(weights)
    w = F.array(*[F.lit(float(x)) for x in weights])

    def entries(runs: Column) -> Column:
        # a bucket's negative run comes right behind its positive one
        def entry(r: Column, k: Column) -> Column:
            other = F.get(runs, F.when(r["v"] % 2 == 0, k + 1).otherwise(k - 1))
            same = F.coalesce(F.floor(other["v"] / 2) == F.floor(r["v"] / 2), F.lit(False))
            n = F.when(r["v"] % 2 == 0, r["n"] - F.when(same, other["n"]).otherwise(0)).when(same, 0).otherwise(-r["n"])
            b = F.floor(r["v"] / 2).cast("int")
            return F.struct(b.alias("b"), (n * w[b]).alias("x"))
        return F.filter(F.transform(runs, entry), lambda p: p["x"] != 0)
    coded = F.transform(ids, lambda x: (x % wide) * 2 + F.floor(x / wide).cast("int"))
    return F.transform(F.array(run_lengths(coded)), entries)[0]


def _dense(column: pa.ListArray, weights: np.ndarray) -> np.ndarray:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide, row = len(weights), np.repeat(np.arange(len(lengths)), lengths)
    signs = np.where(ids < wide, 1.0, -1.0)
    return np.bincount(row * wide + ids % wide, signs, minlength=len(lengths) * wide).reshape(len(lengths), wide) * weights


def train_embedder(texts: DataFrame, text_col: str, wide: int = WIDE, dim: int = DIM, rounds: int = ROUNDS, seed: int = 11) -> Embedder:
    """Weights and basis from every row of ``texts``. Null and empty texts are zero
    vectors. The hashed ids are stored once; each round reads them. Without any token the basis is a fixed random one."""
    if dim > wide:
        raise ValueError("the reduction cannot be wider than the hashed vectors")
    if wide * dim * 8 > MODEL_BYTES:
        raise ValueError(f"{wide} x {dim} values exceed {MODEL_BYTES} bytes")
    spark = texts.sparkSession
    path = scratch_path(spark, "hashed-texts")
    texts.select(F.coalesce(signed_buckets(text_col, wide), F.array().cast("array<int>")).alias("ids")).write.parquet(path)
    ids = spark.read.parquet(path)
    weights = bucket_weights(ids, wide)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, dim)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((weights, basis))

        def there_and_back(batches, shared=shared):
            weights, basis = shared.value
            total = np.zeros_like(basis)
            for batch in batches:
                for a in range(0, batch.num_rows, SLICE):
                    m = _dense(batch.column(0).slice(a, SLICE), weights)
                    n = np.sqrt(np.einsum("ij,ij->i", m, m))
                    m /= np.where(n > 0, n, 1)[:, None]      # a long text counts no more than a short one
                    total += m.T @ (m @ basis)
            some = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["b", "s"])

        parts = ids.mapInArrow(there_and_back, "b int, s array<double>")
        summed = parts.groupBy("b").agg(F.array(*[F.sum(F.col("s")[k]) for k in range(dim)]).alias("s")).collect()   # wide rows
        shared.destroy()
        if not summed:
            break
        product = np.zeros((wide, dim))
        for r in summed:
            product[r["b"]] = r["s"]
        # directions that the texts do not span keep their old place
        product += 1e-9 * np.abs(product).max() * basis
        basis, _ = np.linalg.qr(product)
    return Embedder(weights, basis)


def embed_trained(df: DataFrame, text_col: str, model: Embedder, out_col: str = "embedding") -> DataFrame:
    """``df`` with the reduced vector of each text (zeros without tokens)."""
    wide = len(model.weights)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def reduce(ids: pa.Array) -> pa.Array:
        parts = [_dense(ids.slice(a, SLICE), shared.value.weights) @ shared.value.basis for a in range(0, len(ids), SLICE)]
        dense = np.concatenate(parts) if parts else np.empty((0, model.basis.shape[1]))
        offsets = np.arange(len(dense) + 1, dtype=np.int32) * dense.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(dense.ravel()))

    return df.withColumn(out_col, reduce(F.coalesce(signed_buckets(text_col, wide), F.array().cast("array<int>"))))
