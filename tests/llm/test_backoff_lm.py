"""Scores against n-gram dictionaries."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from finch.llm import backoff_lm as lm


def plain(rows, held, order, mu):
    def toks(t):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + ["\n"]

    counts = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if not held(i):
            x = toks(t)
            for n in range(1, order + 1):
                counts[n].update(tuple(x[a : a + n]) for a in range(len(x) - n + 1))
    total, types = sum(counts[1].values()), len(counts[1])

    def prob(h, w):
        if not h:
            return (counts[1][(w,)] + 0.5) / (total + 0.5 * (types + 1))
        return (counts[len(h) + 1][(*h, w)] + mu * prob(h[1:], w)) / (counts[len(h)][h] + mu)

    out = {}
    for i, t in rows:
        x = toks(t)
        out[i] = (held(i), len(x), sum(counts[1][(w,)] > 0 for w in x), total, sum(math.log10(prob((), w)) for w in x),
                  sum(math.log10(prob(tuple(x[max(0, k - order + 1) : k]), w)) for k, w in enumerate(x)))
    return out, prob, counts


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_dictionaries(frame, words, monkeypatch, order):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 3000)       # several buckets and ranges
    monkeypatch.setattr(lm, "RANGE_BYTES", 2000)
    monkeypatch.setattr(lm, "STRETCH", 37)              # long texts in several lanes
    rows = [(k, words(30 + k, k, 60)) for k in range(40)] + [(50, None), (51, ""), (52, "ÀB Ab c\x0bd\x1fe"), (53, words(4000, 9, 80))]
    want, _, _ = plain(rows, lambda i: i % 4 == 1, order, lm.MU)
    got = lm.score_documents(frame(rows), held_out=F.col("doc_id") % 4 == 1, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4]) and r["score"] == pytest.approx(w[5])


def test_counts_beyond_32_bits():
    """Three buckets of two billion occurrences each."""
    import numpy as np
    import pandas as pd
    grams = np.array([5, 9], np.uint64)
    frame = pd.DataFrame({"n": 1, "range": 0, "bucket": [1, 2, 3], "grams": [lm._pack(grams)] * 3,
                          "counts": [lm._zip(np.array([2_000_000_000, 1], np.uint64).tobytes())] * 3})
    out = lm._answer(frame)
    assert [lm._unzip(x, np.uint64).tolist() for x in out["counts"]] == [[6_000_000_000, 3]] * 3
    assert out["tokens"].sum() == 6_000_000_003 and out["types"].sum() == 2


def test_automaton_states_arcs_and_failure():
    """a b a b: states of the histories seen; an unseen word falls to the root."""
    import numpy as np
    words = np.array([3, 7, 3, 7, 11], np.uint64)
    lens = np.array([5])
    grams = lm._grams(words, lens, 3, 64)
    counts = [np.array([dict(zip(*np.unique(g, return_counts=True)))[u] for u in np.unique(g)], float) for g in grams]
    machine = lm.Automaton(grams, counts, 4.0, 5 + 0.5 * 4)
    assert len(machine.fail) == 1 + 3 + 3 and (machine.fail[1:4] == 0).all() and (machine.fail[4:] > 0).all()
    a, b, end = (int(machine.words[k]) for k in (0, 1, 4))
    _, state = machine.step(np.zeros(1, np.int64), np.array([a]))
    logs, state = machine.step(state, np.array([b]))
    p_b = 2.5 / 7
    assert logs[0] == pytest.approx(math.log10((2 + 4 * p_b) / (2 + 4))) and state[0] >= 4
    logs, state = machine.step(state, np.array([b]))            # a b b: two failure arcs, then the root's arc
    assert logs[0] == pytest.approx(math.log10(4 / 6 * 4 / 6 * p_b)) and 0 < state[0] < 4


def test_shared_hashes_still_make_an_automaton(words):
    """With hashes of 12 bits n-grams collide; every arc stays single and all scores finite."""
    import numpy as np
    tokens, lens = lm._tokens([words(3000, 1), words(900, 2)])
    grams = lm._grams(tokens, lens, 3, 12)
    counts = [np.unique(g, return_counts=True)[1].astype(float) for g in grams]
    counts[0][::3] = counts[1][::5] = 0                     # histories unseen though their n-grams are not
    machine = lm.Automaton(grams, counts, 4.0, len(tokens) + 500.0)
    assert machine.arcs.is_unique
    scores = machine.traverse(lens, 2)
    assert np.isfinite(scores).all() and (scores < 0).all()


def test_histories_give_distributions(words):
    rows = [(k, words(30, k, 20)) for k in range(5)]
    _, prob, counts = plain(rows, lambda i: False, 2, lm.MU)
    vocabulary = [w for (w,) in counts[1]]
    for h in [(), (vocabulary[0],), ("unseen",)]:
        assert sum(prob(h, w) for w in vocabulary) + prob(h, "never") == pytest.approx(1)


def test_edges(frame, words):
    rows = [(None, "a b"), (1, "a b"), (1, "a b")]
    got = lm.score_documents(frame(rows)).collect()
    assert len(got) == 3 and {r["train_tokens"] for r in got} == {9} and len({r["score"] for r in got}) == 1
    alone = lm.score_documents(frame(rows), held_out=F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in alone} == {(0, 0)}
    assert lm.score_documents(frame([])).collect() == []


def test_held_out_copies_score_better_than_the_base(spark):
    from finch.llm import queries
    got = queries.op4_backoff_lm(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
