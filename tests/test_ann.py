import numpy as np
import pytest

from finch.operators.ann import ann_topk, build_index, train_centroids
from finch.operators.retrieval import knn_topk
from finch.session import scratch_path

KEYS = dict(query_id="qid", query_vec="qv", dim=16)


@pytest.fixture(scope="module")
def tables(spark):
    """4,000 vectors around 60 centres (a third of them around one), 200 questions near them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    of = np.where(rng.random(4000) < 0.33, 0, rng.integers(0, 60, 4000))
    v = centres[of] + 0.5 * rng.normal(size=(4000, 16))
    v[17] = v[18]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [0.0] * 16)]
    q = centres[rng.integers(0, 60, 200)] + 0.6 * rng.normal(size=(200, 16))
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(900, [0.0] * 16), (901, None)], "qid long, qv array<double>")
    path = scratch_path(spark, "test-ann")
    build_index(vectors, path, id_col="id", vec_col="v", dim=16, lists=40)
    return vectors, asked, path


def hits(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.cid, round(r.sim, 9)))
    return out


def exact(vectors, asked):
    return hits(knn_topk(vectors.na.drop(), asked, cand_id="id", cand_vec="v", query_id="qid", query_vec="qv", dim=16))


def test_full_probe_is_the_exact_answer(spark, tables):
    vectors, asked, path = tables
    assert hits(ann_topk(spark, path, asked, probes=40, **KEYS)) == exact(vectors, asked)


def test_recall_at_a_quarter_of_the_lists(spark, tables):
    vectors, asked, path = tables
    want, got = exact(vectors, asked), hits(ann_topk(spark, path, asked, probes=10, **KEYS))
    found = sum(len({c for c, _ in want[q]} & {c for c, _ in got[q]}) for q in want)
    assert found / sum(map(len, want.values())) >= 0.9


def test_several_passes_of_questions(spark, tables, monkeypatch):
    import finch.operators.ann as ann
    vectors, asked, path = tables
    monkeypatch.setattr(ann, "QUESTIONS", 30)
    assert hits(ann_topk(spark, path, asked, probes=40, **KEYS)) == exact(vectors, asked)


def test_no_list_is_read_by_one_task_alone(spark, tables):
    """Every task writes its own file of a list, so the list that holds a third of the vectors has several."""
    _, _, path = tables
    files = spark.read.parquet(f"{path}/lists").selectExpr("list", "input_file_name() AS f").groupBy("list").agg({"f": "count"}).orderBy("count(f)", ascending=False)
    largest = files.first()["list"]
    assert spark.read.parquet(f"{path}/lists").where(f"list = {largest}").selectExpr("input_file_name() AS f").distinct().count() >= 3


def test_only_probed_lists_are_scanned(spark, tables):
    _, asked, path = tables
    import finch.operators.ann as ann
    rows = ann._vectors(asked, "qid", "qv").limit(1).collect()
    stored = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    plan = ann._probe(spark, path, rows, np.array([r["c"] for r in stored]), 16, 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "Exchange" not in plan


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert train_centroids(none.selectExpr("id AS cid", "v"), 4, 3).shape == (0, 4)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    path = scratch_path(spark, "test-ann-same")
    build_index(same, path, id_col="id", vec_col="v", dim=2, lists=8)
    asked = spark.createDataFrame([(1, [2.0, 4.0])], "qid long, qv array<double>")
    assert [c for c, _ in hits(ann_topk(spark, path, asked, query_id="qid", query_vec="qv", dim=2, probes=3, k=3))[1]] == [0, 1, 2]


def test_another_length_raises(spark, tables):
    _, _, path = tables
    odd = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, qv array<double>")
    with pytest.raises(ValueError, match="length 2"):
        ann_topk(spark, path, odd, probes=1, **KEYS)


def test_index_without_arrow_on_the_driver(spark, tables):
    """Sessions without Arrow for local data take no numpy number inside an array."""
    vectors, asked, _ = tables
    key, path = "spark.sql.execution.arrow.pyspark.enabled", scratch_path(spark, "test-ann-plain")
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        build_index(vectors, path, id_col="id", vec_col="v", dim=16, lists=8)
        got = hits(ann_topk(spark, path, asked, probes=8, **KEYS))
    finally:
        spark.conf.set(key, old)
    assert got == exact(vectors, asked)
