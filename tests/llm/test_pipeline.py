import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_jaccard_join import edited, plain


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, words):
    rng = random.Random(3)
    d = str(tmp_path_factory.mktemp("sf"))
    item = words(40, 77777, 590)
    rows = []
    for k in range(200):
        rows.append((k, "\n".join([words(60, k, 590), words(50, 500 + k, 590), "Terms of use apply to all of it."]), "en", f"s{k % 3}"))
    for k in range(20):                                            # near copies of one document, in one line
        base = words(200, 9000 + k // 4, 590)
        rows.append((1000 + k, base if k % 4 == 0 else edited(base, rng, 3), "en", "s9"))
    for k in range(5):
        rows.append((2000 + k, f"{words(30, 8000 + k)}\n{words(9, k)} {item} {words(9, 60 + k)}", "en", "s9"))
    for k in range(30):
        rows.append((3000 + k, " !! ".join([words(1, k).upper()] * 50) + " $$$ ### " * 20, "en", "s9"))
    rows += [(4000, None, None, None), (4001, "", "en", "s1"), (5, rows[5][1], "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumn("n_lines", F.lit("extra")).withColumn("_k", F.lit(1))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(not 3000 <= r[0] < 4000), 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns, name
        kept[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if k == 2:
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            once = dict(rows)
            assert set(kept[name]) == {c for *_, c in plain(list(once.items())).values()} and docs.count() == len(kept[name])
    quality, lines, near, clean, tokens = kept.values()
    assert sum(k in quality for k in range(200)) >= 197 and sum(3000 <= k < 4000 for k in quality) <= 2
    assert sum("Terms of use" in (t or "") for t in lines.values()) == 1
    assert sum(1000 <= k < 1020 for k in near) == 5
    assert not any(2000 <= k < 2010 for k in clean) and set(clean) == {k for k in near if not 2000 <= k < 2010}
    assert set(tokens) == set(clean)
    assert docs.where("not parity or not round_trip").count() == 0
    assert spark.read.parquet(str(tmp_path / "1")).where("n_chars <> length(text)").count() == 0


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == [], name


def test_run(spark):
    d = "/root/testdata/sf0.001"
    out = cp.run(spark, d)
    assert 0 < out.count() < spark.read.parquet(f"{d}/documents.parquet").count()
    assert [n for n, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5
