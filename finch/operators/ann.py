"""Approximate cosine top-k with an inverted file.

Coarse centroids come from spherical k-means over all stored vectors: every round assigns
the vectors to centroids in tasks and sums each centroid's vectors by partial aggregates, so a
round moves at most ``lists x tasks`` rows. The index is a Parquet table of (id, vector, list),
in files of the list they belong to; a list of any size is many splits, so no list is
read by one task alone. A question is compared with the centroids only, its ``probes``
nearest lists are read (the others are pruned from the scan), and what they hold is
scored exactly. With ``probes`` equal to the number of lists the answer is that of the exact search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.constants import TOP_K
from ..session import scratch_path

# Centroids are broadcast; more than so many bytes of them are refused.
CENTROID_BYTES = 64 << 20
SEED_ROWS = 20                  # vectors taken for each starting centroid, by hash of their id
QUESTIONS = 100_000             # questions of a pass, at most; their vectors are broadcast within CENTROID_BYTES
ROW_SLICE = 2048


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(n > 0, n, 1)[:, None]


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows; another length raises."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise ValueError(f"a vector of length {lengths[lengths != dim][0]} where {dim} is expected")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _nearest(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(m[a : a + ROW_SLICE] @ centroids.T, 1) for a in range(0, len(m), ROW_SLICE)] or [np.empty(0, int)])


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(cid, v) of the vectors that have a direction."""
    v = F.col(vec_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("cid"), v.alias("v")).where(
        F.col("cid").isNotNull() & F.exists("v", lambda x: x != 0))


def train_centroids(vectors: DataFrame, dim: int, lists: int, rounds: int = 8) -> np.ndarray:
    """(lists, dim) unit centroids of ``vectors`` (cid, v), at most as many as there are vectors.

    The start is a bounded sample (``SEED_ROWS`` vectors a centroid, the first by hash
    of the id) in which far points are drawn one after the other; each round then sums all vectors.
    """
    if lists * dim * 8 > CENTROID_BYTES:
        raise ValueError(f"{lists} centroids of {dim} values exceed {CENTROID_BYTES} bytes")
    seeds = vectors.orderBy(F.xxhash64("cid"), "cid").limit(max(lists, min(lists * SEED_ROWS, CENTROID_BYTES // (8 * dim)))).collect()
    if not seeds:
        return np.empty((0, dim))
    pool = _unit(np.array([r["v"] for r in seeds], float).reshape(len(seeds), -1))
    if pool.shape[1] != dim:
        raise ValueError(f"vectors of length {pool.shape[1]} where {dim} is expected")
    chosen, near = [0], pool @ pool[0]
    while len(chosen) < min(lists, len(pool)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-12:
            break                                       # only equal directions are left
        chosen.append(far)
        near = np.maximum(near, pool @ pool[far])
    centroids = pool[chosen]
    spark = vectors.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(batches, shared=shared):
            total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
            for batch in batches:
                m = _unit(_rows(batch.column(0), dim))
                at = _nearest(m, shared.value)
                np.add.at(total, at, m)
                count += np.bincount(at, minlength=len(count))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["list", "s"])

        parts = vectors.select("v").mapInArrow(sums, "list int, s array<double>")
        got = parts.groupBy("list").agg(F.array(*[F.sum(F.col("s")[k]) for k in range(dim)]).alias("s")).collect()
        new = centroids.copy()
        for r in got:
            new[r["list"]] = r["s"]
        new = _unit(new)
        shared.destroy()
        if np.abs(new - centroids).max() < 1e-6:
            break
        centroids = new
    return centroids


def build_index(df: DataFrame, path: str, *, id_col: str, vec_col: str, dim: int, lists: int, rounds: int = 8) -> None:
    """Write the inverted file of ``df`` below ``path``: ``lists/list=<n>`` and ``centroids``.

    Every vector is stored, under its nearest centroid; null and zero vectors, which
    have no cosine with anything, are left out. Tasks write their own part of each list
    (no shuffle), so a list that holds most vectors stays spread over files.
    """
    spark = df.sparkSession
    vectors = _vectors(df, id_col, vec_col)
    centroids = train_centroids(vectors, dim, lists, rounds)
    shared = spark.sparkContext.broadcast(centroids)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                at = _nearest(_unit(_rows(batch.column(1), dim)), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32))], names=["cid", "v", "list"])

    vectors.mapInArrow(place, "cid long, v array<double>, list int").write.partitionBy("list").parquet(f"{path}/lists")
    # plain numbers: without Arrow on the driver Spark takes no numpy value inside an array
    spark.createDataFrame(list(enumerate(centroids.tolist())), "list int, c array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def ann_topk(spark: SparkSession, path: str, queries: DataFrame, *, query_id: str, query_vec: str, dim: int,
             probes: int, k: int = TOP_K) -> DataFrame:
    """(qid, cid, sim, rank): the ``k`` best vectors of each question's ``probes`` nearest lists.

    Ties go to the smaller id. Questions travel by broadcast in passes of a bounded size; each
    task scores the vectors of its splits against the questions that probe their list and passes on its own
    best ``k`` of each question. Questions without a direction have no rows.
    """
    stored = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    centroids = np.array([r["c"] for r in stored], float).reshape(len(stored), dim)
    asked = _vectors(queries, query_id, query_vec).dropDuplicates(["cid"])
    block = min(QUESTIONS, max(1, CENTROID_BYTES // (8 * dim)))
    rows = asked.limit(block + 1).collect()
    if len(rows) <= block:
        passes = [rows] if rows else []
    else:
        kept = scratch_path(spark, "ann-questions")
        parts = -(-asked.count() // block) * 2           # a hash part of twice as many stays within the block
        asked.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int")).write.partitionBy("part").parquet(kept)
        passes = (spark.read.parquet(kept).where(F.col("part") == p).collect() for p in range(parts))
    out = scratch_path(spark, "ann-hits")
    schema = "qid long, cid long, sim double"
    spark.createDataFrame([], schema).write.parquet(out)
    for rows in passes:
        if rows:
            _probe(spark, path, rows, centroids, dim, probes, k).write.mode("append").parquet(out)
    hits = spark.read.schema(schema).parquet(out)
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "cid")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "cid", "sim", "rank")


def _probe(spark: SparkSession, path: str, rows: list, centroids: np.ndarray, dim: int, probes: int, k: int) -> DataFrame:
    """Local best hits of the questions ``rows`` in the lists they probe."""
    qids = np.array([r["cid"] for r in rows], np.int64)
    q = np.array([r["v"] for r in rows], float).reshape(len(rows), -1)
    if q.shape[1] != dim:
        raise ValueError(f"questions of length {q.shape[1]} where {dim} is expected")
    near = _unit(q) @ centroids.T
    probed = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    wanted = sorted({int(x) for x in probed.ravel()})
    askers = {n: np.flatnonzero((probed == n).any(1)) for n in wanted}
    shared = spark.sparkContext.broadcast((qids, q, np.einsum("ij,ij->i", q, q), askers))

    def best(batches):
        qids, q, q2, askers = shared.value
        held: list[tuple] = []

        def cut():
            i, c, s = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((c, -s, i))
            i, c, s = i[order], c[order], s[order]
            start = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
            rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
            return i[rank < k], c[rank < k], s[rank < k]

        for batch in batches:
            lists = batch.column(2).to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            m = _rows(batch.column(1), dim)
            for n in np.unique(lists):
                here = np.flatnonzero(lists == n)
                for a in range(0, len(here), ROW_SLICE):
                    at = here[a : a + ROW_SLICE]
                    part, m2 = m[at], np.einsum("ij,ij->i", m[at], m[at])
                    for b in range(0, len(askers[n]), 1024):
                        who = askers[n][b : b + 1024]
                        s = (part @ q[who].T) / np.sqrt(m2[:, None] * q2[who][None, :])
                        level = np.partition(s, max(len(at) - k, 0), axis=0)[max(len(at) - k, 0)]
                        r, c = np.nonzero(s >= level - 1e-9)
                        # pairs that may stay are scored anew in one order, so equal vectors tie
                        exact = np.concatenate([np.einsum("ij,ij->i", part[r[x : x + 8192]], q[who[c[x : x + 8192]]]) / np.sqrt(
                            m2[r[x : x + 8192]] * q2[who[c[x : x + 8192]]]) for x in range(0, len(r), 8192)])
                        held.append((who[c], ids[at[r]], exact))
                        if sum(len(x[0]) for x in held) > 4 * k * len(qids) + (1 << 18):
                            held = [cut()]
        if held:
            i, c, s = cut()
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(c, pa.int64()), pa.array(s)], names=["qid", "cid", "sim"])

    table = spark.read.schema("cid long, v array<double>, list int").parquet(f"{path}/lists").where(F.col("list").isin(wanted))
    return table.select("cid", "v", "list").mapInArrow(best, "qid long, cid long, sim double")
