import random

import pytest

from finch.llm import resampling


@pytest.fixture(scope="module")
def labelled(spark, frame, words):
    rows = [(k, words(60 + k % 50, k)) for k in range(300)]
    rows += [(1000 + k, words(1, k).upper() * 1 + " !! " + " ".join([words(1, k)] * 40) + " $$$ ###" * 10) for k in range(60)]
    labels = [(k, int(k < 1000), 0) for k, _ in rows if k % 2 == 0]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_good_documents_stay_and_junk_goes(frame, labelled):
    rows, labels = labelled
    got = resampling.resample(frame(rows), labels).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(got) == len(rows)
    assert sum(k in kept for k in range(300)) >= 294
    assert sum(k in kept for k in range(1000, 1060)) <= 2
    assert sorted(r["rank"] for r in got) == list(range(len(rows)))


def test_k_is_exact_and_draws_repeat(frame, labelled):
    rows, labels = labelled
    a = {r["doc_id"] for r in resampling.resample(frame(rows, 2), labels, k=50).where("kept").collect()}
    b = {r["doc_id"] for r in resampling.keep_good(frame(rows, 5), labels, k=50).collect()}
    assert len(a) == 50 and a == b


def test_edges(spark, frame, labelled):
    rows, labels = labelled
    odd = rows + [(None, rows[0][1]), (5000, None), (5001, ""), (7, rows[7][1]), (5002, "w " * 30000)]
    assert resampling.resample(frame(odd), labels).count() == len(odd)
    kept = resampling.keep_good(frame(odd), labels)
    assert kept.columns == ["doc_id", "text", "h", "row", "key"]
    assert kept.where("doc_id = 7").count() in (0, 2) and kept.where("doc_id = 9").count() == 1
    none = spark.createDataFrame([], labels.schema)
    assert resampling.keep_good(frame(odd), none).count() == len(odd)
    assert resampling.resample(frame([]), labels).collect() == []
    nulls = spark.createDataFrame([(None, 1, 0), (2, None, None), (4, 1, None)], labels.schema)
    assert resampling.resample(frame(odd), nulls).count() == len(odd)


def test_gumbel_noise_has_its_distribution(spark):
    import numpy as np
    x = np.array([r[0] for r in spark.range(20000).select(resampling.gumbel("id")).collect()])
    assert abs(x.mean() - 0.5772) < 0.03 and abs(x.std() - np.pi / 6**0.5) < 0.03


def test_toxic_documents_go(spark, frame, words):
    rng = random.Random(3)
    bad = ["vile", "scum", "moron", "filth", "creep"]
    rows, labels, planted = [], [], set()
    for k in range(1200):
        text = words(80 + k % 60, k).split()
        toxic = k % 4 == 0
        for w in rng.sample(bad, 2 if toxic else 0):
            text[rng.randrange(len(text))] = w
        rows.append((k, " ".join(text)))
        if k % 3:
            labels.append((k, 1, int(toxic)))
        elif toxic:
            planted.add(k)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = resampling.resample(frame(rows), labels).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(planted) == 100 and len(planted & kept) <= 5
    assert sum(k in kept for k in range(1200) if k % 4) >= 0.97 * 900
    assert {r["doc_id"] for r in resampling.keep_good(frame(rows, 5), labels).collect()} == kept
