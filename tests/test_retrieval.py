import numpy as np
import pytest
from pyspark.sql import Row, functions as F, types as T

from finch.operators.retrieval import HashingEmbedder, embed_buckets, embed_with, knn_topk


def brute(C, cids, Q, qids, k, distinct=False):
    out = {}
    for qi, q in zip(qids, Q):
        sims = (C @ q) / (np.linalg.norm(C, axis=1) * np.linalg.norm(q))
        order = sorted(range(len(cids)), key=lambda i: (-sims[i], cids[i]))
        seen, res = set(), []
        for i in order:
            if distinct and sims[i] in seen:
                continue
            seen.add(sims[i])
            res.append((cids[i], round(float(sims[i]), 9)))
            if len(res) == k:
                break
        out[qi] = res
    return out


def collect_hits(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.cid, round(r.sim, 9)))
    return out


@pytest.mark.parametrize("block_rows,sub_block", [(1024, 1024), (3, 1024), (1024, 2)])
def test_dense_topk_matches_brute_force(spark, block_rows, sub_block):
    rng = np.random.default_rng(7)
    C = rng.normal(size=(300, 8)).astype(np.float32)
    C[10] = C[11]                      # exact tie: smaller id first
    Q = rng.normal(size=(7, 8)).astype(np.float32)
    cands = spark.createDataFrame([(i, C[i].tolist()) for i in range(300)], "id long, v array<float>").repartition(5)
    qs = spark.createDataFrame([(100 + i, Q[i].tolist()) for i in range(7)], "qid long, qv array<float>")
    got = collect_hits(knn_topk(cands, qs, cand_id="id", cand_vec="v", query_id="qid", query_vec="qv", k=5, dim=8,
                                block_rows=block_rows, sub_block=sub_block))
    exp = brute(C.astype(np.float64), list(range(300)), Q.astype(np.float64), [100 + i for i in range(7)], 5)
    assert got == exp


def test_bucket_topk_distinct_and_ties(spark):
    texts = ["money money bank", "bank money money", "save money", "save money", "bank", "", "retire early save",
             "money bank", "money bank"]
    cands = embed_buckets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3), "text")
    qs = embed_buckets(spark.createDataFrame([(1, "money bank"), (2, "save")], "qid long, text string"), "text")
    kw = dict(cand_id="id", cand_vec="buckets", query_id="qid", query_vec="buckets", kind="buckets", k=3, dim=256)
    plain = collect_hits(knn_topk(cands, qs, **kw))
    dedup = collect_hits(knn_topk(cands, qs, distinct_scores=True, **kw))
    assert [c for c, _ in plain[1]] == [7, 8, 0]      # equal scores: ids ascending
    assert [c for c, _ in dedup[1]][:2] == [7, 0]      # repeated texts/scores skipped
    assert len({s for _, s in dedup[1]}) == len(dedup[1])
    assert [c for c, _ in plain[2]][:2] == [2, 3]
    assert 5 not in [c for c, _ in plain[1] + plain[2]]   # empty text has no vector


def test_topk_plan_has_no_pair_table(spark):
    cands = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(50)], "id long, v array<double>")
    qs = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qv array<double>")
    plan = knn_topk(cands, qs, cand_id="id", cand_vec="v", query_id="qid", query_vec="qv", dim=2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "MapInArrow" in plan
    assert "WindowGroupLimit" in plan


def test_python_embedder_matches_native_buckets(spark):
    df = spark.createDataFrame([(1, "Saving money, SAVING time: 2024 Öl")], "id long, text string")
    native = embed_buckets(df, "text").first().buckets
    dense = embed_with(df, "text", HashingEmbedder).first().embedding
    counts = np.bincount(native, minlength=256)
    assert list(counts) == [int(x) for x in dense]


def test_topk_edge_cases(spark):
    cands = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    qs = spark.createDataFrame([(7, [0.0, 0.0]), (8, [2.0, 0.0])], "qid long, qv array<double>")
    hits = knn_topk(cands, qs, cand_id="id", cand_vec="v", query_id="qid", query_vec="qv", dim=2).collect()
    assert [(r.qid, r.cid, r.rank) for r in hits] == [(8, 1, 1)]        # zero vectors have no cosine
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert knn_topk(empty, qs, cand_id="id", cand_vec="v", query_id="qid", query_vec="qv", dim=2).count() == 0


def test_wrong_length_raises(spark):
    cands = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 3.0])], "id long, v array<double>")
    qs = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, qv array<double>")
    with pytest.raises(Exception, match="length 3 where 2"):
        knn_topk(cands, qs, cand_id="id", cand_vec="v", query_id="qid", query_vec="qv", dim=2).collect()


def test_equal_vectors_have_equal_scores_in_any_partition(spark):
    rng = np.random.default_rng(3)
    V = rng.normal(size=(601, 48))
    V[600] = V[100]
    rows = [(i, V[i].tolist()) for i in range(601)]
    big = spark.createDataFrame(rows[:600], "id long, v array<double>").coalesce(1)
    cands = big.unionByName(spark.createDataFrame(rows[600:], "id long, v array<double>").coalesce(1))
    qs = spark.createDataFrame([(i, (V[100] + 0.1 * rng.normal(size=48)).tolist()) for i in range(40)], "qid long, qv array<double>")
    kw = dict(cand_id="id", cand_vec="v", query_id="qid", query_vec="qv", dim=48, k=5)
    plain, once = collect_hits(knn_topk(cands, qs, **kw)), collect_hits(knn_topk(cands, qs, distinct_scores=True, **kw))
    assert all([c for c, _ in h][:2] == [100, 600] for h in plain.values())
    assert all([c for c, _ in h].count(100) == 1 and 600 not in [c for c, _ in h] and len(h) == 5 for h in once.values())


def test_keys_may_be_pairs_and_large(spark):
    cands = spark.createDataFrame([(2**40, 2**24, [1.0, 0.0]), (2**40, 3, [1.0, 0.0]), (1, 9, [0.0, 1.0])], "doc long, pos int, v array<double>")
    qs = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, qv array<double>")
    got = knn_topk(cands, qs, cand_id="doc", cand_pos="pos", cand_vec="v", query_id="qid", query_vec="qv", dim=2, k=2).orderBy("rank").collect()
    assert [(r.cid, r.cpos) for r in got] == [(2**40, 3), (2**40, 2**24)]


def test_one_block_at_a_time_on_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame as D
    qs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "qid long, qv array<double>")
    cands = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)], "id long, v array<double>")
    kind, real, seen = type(qs), type(qs).collect, []
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(real(self)) or seen[-1])
    hits = knn_topk(cands, qs, cand_id="id", cand_vec="v", query_id="qid", query_vec="qv", dim=2, k=3, block_rows=4)
    assert seen and max(map(len, seen)) <= 5
    assert hits.count() == 60 and isinstance(hits, D)
