"""Exact cosine top-k retrieval, embeddings and search reports.

Plan shape for ``knn_topk``: a block of query vectors (at most QUERY_BLOCK_BYTES)
is broadcast; every candidate partition scores its rows against the block with a
BLAS matrix product inside ``mapInArrow`` and emits only its local top-k per query.
A per-query ``row_number`` window then keeps the global top-k; Spark inserts a
partial ``WindowGroupLimit`` before that shuffle, so at most partitions * k rows
per query ever move. No pair table (query x candidate) is materialised.

The matrix product only selects: its last bits depend on the shape of the batch.
The score of a selected pair is computed anew, in one fixed order, so equal vectors
have equal scores wherever they stand.

Query sets larger than one block take one pass per block over a stored (id,
vector) candidate table; only one block is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.constants import REPORT_FORMAT, TOP_K
from ..functions.vectors import HASH_DIM, token_buckets
from ..session import scratch_path
from .ordering import dense_index

QUERY_BLOCK_BYTES = 64 << 20  # query vectors broadcast per pass over the candidates
QUERY_SUB_BLOCK = 1024        # queries scored per matrix product inside a task
ROW_SLICE = 4096              # candidate rows scored per matrix product
MARGIN = 1e-9                 # scores this close to the k-th best are computed anew

HIT_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType(), False),
    T.StructField("cid", T.LongType(), False),
    T.StructField("cpos", T.IntegerType(), False),
    T.StructField("sim", T.DoubleType(), False),
])


# ---------------------------------------------------------------------------
# numpy helpers used inside tasks
# ---------------------------------------------------------------------------

def _matrix(lst: pa.ListArray, kind: str, dim: int) -> np.ndarray:
    """Vectors as rows: counts of bucket ids, or the stored values. A value of
    another length or a bucket outside the width raises."""
    n = len(lst)
    lengths = lst.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    vals = lst.flatten().to_numpy(zero_copy_only=False)
    if kind == "dense":
        if (lengths != dim).any():
            raise ValueError(f"a vector of length {lengths[lengths != dim][0]} where {dim} is expected")
        return vals.astype(np.float64).reshape(n, dim)
    if len(vals) and not 0 <= vals.min() <= vals.max() < dim:
        raise ValueError(f"a bucket outside 0..{dim - 1}")
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    return np.bincount(rows * dim + vals.astype(np.int64), minlength=n * dim).reshape(n, dim).astype(np.float64)


def _select_topk(qi, cid, cpos, sim, k: int, distinct: bool):
    """Per query index: best ``k`` by (sim desc, cid, cpos); with ``distinct`` only
    the smallest key of each equal score is kept (and counts once)."""
    if len(qi) == 0:
        return qi, cid, cpos, sim
    order = np.lexsort((cpos, cid, -sim, qi))
    qi, cid, cpos, sim = qi[order], cid[order], cpos[order], sim[order]
    if distinct:
        keep = np.ones(len(qi), dtype=bool)
        keep[1:] = (qi[1:] != qi[:-1]) | (sim[1:] != sim[:-1])
        qi, cid, cpos, sim = qi[keep], cid[keep], cpos[keep], sim[keep]
    start = np.r_[0, np.flatnonzero(qi[1:] != qi[:-1]) + 1]
    rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.r_[start, len(qi)]))
    keep = rank < k
    return qi[keep], cid[keep], cpos[keep], sim[keep]


def _block_candidates(S: np.ndarray, k: int, distinct: bool):
    """(row, query) index pairs that can be in a query's top-k within S. With
    ``distinct`` k counts scores that differ by more than the margin."""
    n = S.shape[0]
    if n <= k:
        return np.nonzero(np.isfinite(S))
    if distinct:
        down = -np.sort(-S, axis=0)
        with np.errstate(invalid="ignore"):
            step = np.cumsum(np.r_[np.ones((1, S.shape[1]), int), (down[:-1] - down[1:] > MARGIN).astype(int)], axis=0)
        last = np.maximum((step <= k).sum(0) - 1, 0)
        kth = down[last, np.arange(S.shape[1])]
    else:
        kth = np.partition(S, n - k, axis=0)[n - k, :]
    return np.nonzero((S >= kth[None, :] - MARGIN) & np.isfinite(S))


def _make_scorer(bc, kind: str, dim: int, k: int, distinct: bool, sub_block: int = QUERY_SUB_BLOCK):
    def score(batches):
        qids, Q, qn2_all = bc.value
        subs = [(lo, np.ascontiguousarray(Q[lo:lo + sub_block].T), qn2_all[lo:lo + sub_block])
                for lo in range(0, len(qids), sub_block)]
        acc = []
        for rb in batches:
            for lo in range(0, rb.num_rows, ROW_SLICE):
                part = rb.slice(lo, ROW_SLICE)
                part = part.filter(part.column(2).is_valid())
                if part.num_rows == 0:
                    continue
                M = _matrix(part.column(2), kind, dim)
                cn2 = np.einsum("ij,ij->i", M, M)
                cid = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                cpos = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for q0, QT, qn2 in subs:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        S = (M @ QT) / np.sqrt(cn2[:, None] * qn2[None, :])
                    S[~np.isfinite(S)] = -np.inf
                    r, q = _block_candidates(S, k, distinct)
                    exact = np.empty(len(r))
                    for a in range(0, len(r), 8192):
                        rr, qq = r[a:a + 8192], q[a:a + 8192]
                        # one pair at a time in the order of the dimensions, then one rounding of the quotient
                        exact[a:a + 8192] = np.einsum("ij,ij->i", M[rr], Q[q0 + qq]) / np.sqrt(cn2[rr] * qn2[qq])
                    acc.append((q.astype(np.int64) + q0, cid[r], cpos[r], exact))
            if sum(len(x[0]) for x in acc) > 8 * k * len(qids):
                acc = [_select_topk(*map(np.concatenate, zip(*acc)), k, distinct)]
        if not acc:
            return
        qi, cid, cpos, sim = _select_topk(*map(np.concatenate, zip(*acc)), k, distinct)
        if len(qi):
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[qi], pa.int64()), pa.array(cid, pa.int64()), pa.array(cpos, pa.int32()), pa.array(sim, pa.float64())],
                schema=pa.schema([("qid", pa.int64(), False), ("cid", pa.int64(), False), ("cpos", pa.int32(), False), ("sim", pa.float64(), False)]))
    return score


def _query_vectors(queries: DataFrame, kind: str, dim: int) -> DataFrame:
    """(qid, v binary): each query's vector in 8 * dim bytes; zero vectors, which
    have no cosine with anything, and null ones go."""
    def run(batches):
        for rb in batches:
            rb = rb.filter(rb.column(1).is_valid())
            Q = _matrix(rb.column(1), kind, dim)
            keep = np.einsum("ij,ij->i", Q, Q) > 0
            ids = rb.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array([x.tobytes() for x in Q[keep]], pa.binary())], names=["qid", "v"])
    return queries.mapInArrow(run, "qid long, v binary")


def knn_topk(candidates: DataFrame, queries: DataFrame, *, cand_id: str, cand_vec: str,
             query_id: str, query_vec: str, dim: int, cand_pos: str | None = None, k: int = TOP_K, kind: str = "dense",
             distinct_scores: bool = False, block_rows: int | None = None, sub_block: int = QUERY_SUB_BLOCK) -> DataFrame:
    """Exact cosine top-k of every query over every candidate.

    ``kind="dense"``: vectors are array<float|double> of length ``dim`` (any other
    length raises); ``kind="buckets"``: vectors are array<int> token bucket ids
    (hashed bag of words of width ``dim``). A candidate's key is ``cand_id``, or
    the pair (``cand_id``, ``cand_pos``). Ties break on the smaller key. With
    ``distinct_scores`` a score already taken by a smaller key is skipped, which
    is the search that skips repeated texts and repeated scores whenever equal
    texts get equal vectors (one embedder for the whole table).

    The broadcast block holds at most ``QUERY_BLOCK_BYTES`` of query vectors
    (``block_rows`` overrides); inside a task queries are scored in sub-blocks,
    so task memory stays at ROW_SLICE x QUERY_SUB_BLOCK scores. With more than
    one block the compact candidate table (id, vector) is stored once, and each
    pass adds its hits to a stored table before the next block is collected.

    Returns (qid, cid, cpos, sim, rank) with rank 1..k; cpos is 0 without ``cand_pos``.
    """
    spark = candidates.sparkSession
    if block_rows is None:
        block_rows = max(1, QUERY_BLOCK_BYTES // (8 * dim))
    q = _query_vectors(queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_vec).alias("qv")), kind, dim)
    pos = F.col(cand_pos).cast("int") if cand_pos else F.lit(0)
    cands = candidates.select(F.col(cand_id).cast("long").alias("cid"), pos.alias("cpos"), F.col(cand_vec).alias("v"))

    def scored(rows):
        block = (np.array([r["qid"] for r in rows], np.int64), np.array([np.frombuffer(r["v"]) for r in rows]).reshape(len(rows), dim))
        bc = spark.sparkContext.broadcast((*block, np.einsum("ij,ij->i", block[1], block[1])))
        return bc, cands.mapInArrow(_make_scorer(bc, kind, dim, k, distinct_scores, sub_block), HIT_SCHEMA)

    first = q.limit(block_rows + 1).collect()
    if len(first) <= block_rows:
        hits = scored(sorted(first))[1]
    else:
        path = scratch_path(spark, "knn")
        cands.write.parquet(f"{path}/candidates")
        cands = spark.read.parquet(f"{path}/candidates")
        dense_index(q, ["qid"], "_qidx").withColumn("block", F.floor(F.col("_qidx") / block_rows).cast("int")).write.partitionBy("block").parquet(f"{path}/queries")
        stored = spark.read.parquet(f"{path}/queries")
        for b in range(stored.agg(F.max("block")).first()[0] + 1):
            bc, part = scored(stored.where(F.col("block") == b).select("qid", "v").collect())
            part.write.mode("append").parquet(f"{path}/hits")
            bc.destroy()
        hits = spark.read.schema(HIT_SCHEMA).parquet(f"{path}/hits")
    if distinct_scores:
        hits = hits.groupBy("qid", "sim").agg(F.min(F.struct("cid", "cpos")).alias("c")).select("qid", "c.cid", "c.cpos", "sim")
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("cid"), F.col("cpos"))
    return (hits.withColumn("rank", F.row_number().over(w))
                .where(F.col("rank") <= k)
                .select("qid", "cid", "cpos", "sim", "rank"))


# ---------------------------------------------------------------------------
# embeddings
# ---------------------------------------------------------------------------

def embed_buckets(df: DataFrame, text_col: str, out_col: str = "buckets", dim: int = HASH_DIM) -> DataFrame:
    """Default embedder, JVM-side: hashed bag of words as token bucket ids."""
    return df.withColumn(out_col, token_buckets(text_col, dim))


def embed_with(df: DataFrame, text_col: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]],
               out_col: str = "embedding") -> DataFrame:
    """Plug-in embedder: ``factory()`` builds the model once per task, inside the
    worker, and its batch callable runs over Arrow batches; the model itself never
    travels with the plan. Null texts are embedded as empty ones."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in chunks:
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in model(texts.fillna("").tolist())], dtype=object)
    return df.withColumn(out_col, _embed(F.col(text_col)))


def embed_new(chunks: DataFrame, path: str, key_cols: list[str], embed: Callable[[DataFrame], DataFrame]) -> None:
    """K6: embed the rows whose key is not stored at ``path`` yet and append them
    (keys and what ``embed`` adds); rows that are stored are not embedded again."""
    from ..sinks.files import stored_keys
    stored = stored_keys(chunks.sparkSession, path, key_cols)
    new = chunks if stored is None else chunks.join(stored, key_cols, "left_anti")
    embed(new).write.mode("append").parquet(path)


class HashingEmbedder:
    """Deterministic Python embedder: the same hashed bag of words as
    ``embed_buckets`` returned as dense float counts (used as the default
    plug-in model and in tests)."""

    def __init__(self, dim: int = HASH_DIM):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import hashlib
        import re
        pat = re.compile(r"[^\W_]+")          # letters and digits
        out = []
        for t in texts:
            v = np.zeros(self.dim, dtype=np.float32)
            for tok in pat.findall(t.lower()):
                h = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16)
                v[h % self.dim] += 1.0
            out.append(v)
        return out


# ---------------------------------------------------------------------------
# reports
# ---------------------------------------------------------------------------

def search_report(hits: DataFrame, text_col: str = "text", fmt: str = REPORT_FORMAT) -> DataFrame:
    """One printable line per hit: rank, score to 3 decimals, text."""
    return hits.withColumn("line", F.format_string(fmt, F.col("rank"), F.col("sim"), F.col(text_col)))
