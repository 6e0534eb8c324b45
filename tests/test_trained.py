import hashlib
import math
import random
import re

import numpy as np
import pytest

from finch.operators.retrieval import knn_topk
from finch.operators.trained import Embedder, bucket_weights, embed_trained, signed_buckets, train_embedder, weighted_pairs

WIDE = 64


def wide_vector(text, weights):
    v = np.zeros(WIDE)
    for t in re.findall(r"[^\W_]+", (text or "").lower()):
        h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % (2 * WIDE)
        v[h % WIDE] += 1 if h < WIDE else -1
    return v * weights


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    topics = [["save", "bank", "rate", "loan"], ["fund", "stock", "bond", "yield"], ["rent", "house", "lease", "tenant"]]
    common = ["the", "a", "of", "and", "to", "is"]
    rows = [(i, " ".join(rng.choice(topics[i % 3] if rng.random() < 0.4 else common) for _ in range(25))) for i in range(240)]
    return spark.createDataFrame(rows + [(900, None), (901, ""), (902, "!!")], "id long, text string").repartition(4)


def test_weights_and_wide_vectors(spark, texts):
    ids = texts.select("id", "text", signed_buckets("text", WIDE).alias("ids"))
    weights = bucket_weights(ids, WIDE)
    n, held = texts.count(), np.zeros(WIDE)
    for r in texts.collect():
        held[[b for b in {int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % WIDE for t in re.findall(r"\w+", r.text or "")}]] += 1
    assert np.allclose(weights, [math.log((1 + n) / (1 + d)) + 1 for d in held])
    for r in ids.where("text is not null").select("text", weighted_pairs(ids["ids"], weights).alias("p")).limit(20).collect():
        v = np.zeros(WIDE)
        for p in r.p:
            v[p.b] = p.x
        assert np.allclose(v, wide_vector(r.text, weights))


def test_full_width_keeps_all_cosines(spark, texts):
    model = train_embedder(texts, "text", wide=WIDE, dim=WIDE)
    got = {r.id: np.array(r.embedding) for r in embed_trained(texts, "text", model).collect()}
    want = {r.id: wide_vector(r.text, model.weights) for r in texts.collect()}
    for a, b in [(0, 3), (1, 2), (5, 90), (7, 7)]:
        assert np.isclose(got[a] @ got[b], want[a] @ want[b])
    assert not got[900].any() and not got[901].any() and not got[902].any()


def test_basis_spans_the_leading_directions(spark, texts):
    model = train_embedder(texts, "text", wide=WIDE, dim=6, rounds=12)
    m = np.array([wide_vector(r.text, model.weights) for r in texts.collect()])
    m /= np.where((n := np.linalg.norm(m, axis=1)) > 0, n, 1)[:, None]
    best = (np.linalg.svd(m, compute_uv=False)[:6] ** 2).sum()
    assert np.allclose(model.basis.T @ model.basis, np.eye(6))
    assert ((m @ model.basis) ** 2).sum() > 0.98 * best


def test_topics_are_nearer_than_words(spark, texts):
    model = train_embedder(texts, "text", wide=WIDE, dim=8)
    vectors = embed_trained(texts, "text", model)
    hits = knn_topk(vectors, vectors.where("id < 60"), cand_id="id", cand_vec="embedding", query_id="id", query_vec="embedding", dim=8, k=6).collect()
    same = [r.qid % 3 == r.cid % 3 for r in hits if r.qid != r.cid]
    assert sum(same) / len(same) > 0.8


def test_no_texts(spark):
    none = spark.createDataFrame([], "id long, text string")
    model = train_embedder(none, "text", wide=8, dim=3)
    assert isinstance(model, Embedder) and model.basis.shape == (8, 3)
    assert embed_trained(none, "text", model).collect() == []


def test_sizes_are_checked(spark, texts):
    with pytest.raises(ValueError):
        train_embedder(texts, "text", wide=4, dim=8)
