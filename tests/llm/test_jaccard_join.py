"""The join against a comparison of all pairs, and its parts."""

import random
from itertools import combinations

import numpy as np
import pytest

from finch.llm import jaccard_join as jj
from finch.llm.components import connected_components


def shingle_set(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain(rows, threshold=0.8):
    """doc_id -> (text_id, copies, n_links, class_id) for distinct ids."""
    first, copies = {}, {}
    for i, t in sorted(rows):
        first.setdefault(t or "", i)
        copies[t or ""] = copies.get(t or "", 0) + 1
    sets = {t: shingle_set(t) for t in first}
    root, links = {t: t for t in first}, dict.fromkeys(first, 0)

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(first, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for t in first:
        least[find(t)] = min(least.get(find(t), first[t]), first[t])
    return {i: (first[t or ""], copies[t or ""], links[t or ""], least[find(t or "")]) for i, t in rows}


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows(words):
    rng, out = random.Random(5), []
    for g in range(12):
        base = words(rng.randrange(40, 160), 100 + g)
        out += [edited(base, rng, rng.randrange(0, 5)) for _ in range(rng.randrange(1, 9))]
    base = words(120, 900)
    out += [edited(base, rng, rng.randrange(1, 4)) for _ in range(70)] + [base] * 9 + [base.upper()]
    out += ["", None, " ", "a b c", "a b c", "A  b c", "a b c d", "x " * 50, words(9000, 901), edited(words(9000, 901), rng, 30)]
    out += [words(80, 2000 + k) for k in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("classes", [jj.BLOCK_CLASSES, 16])
def test_against_all_pairs(frame, rows, monkeypatch, classes):
    monkeypatch.setattr(jj, "BLOCK_CLASSES", classes)
    got = {r["doc_id"]: (r["text_id"], r["copies"], r["n_links"], r["class_id"]) for r in jj.near_duplicate_documents(frame(rows)).collect()}
    assert got == plain(rows)


def test_keep_first(frame, rows):
    want = plain(rows)
    kept = jj.keep_first(frame(rows))
    assert kept.columns == ["doc_id", "text", "h", "row", "key"]
    assert {r["doc_id"] for r in kept.collect()} == {c for *_, c in want.values()}


def test_edges(frame, words):
    t = words(30, 1)
    odd = [(None, t), (None, t), (3, t), (3, t), (4, words(30, 2)), (4, words(30, 2)), (5, None), (5, None)]
    got = jj.near_duplicate_documents(frame(odd)).collect()
    assert len(got) == len(odd)
    assert {(r["text_id"], r["copies"], r["class_id"]) for r in got if r["doc_id"] in (None, 3)} == {(None, 4, None)}
    kept = [(r["doc_id"], r["text"]) for r in jj.keep_first(frame(odd)).collect()]
    assert sorted(kept, key=str) == sorted([(None, t), (4, words(30, 2)), (5, None)], key=str)
    assert jj.near_duplicate_documents(frame([])).collect() == [] and jj.keep_first(frame([])).collect() == []


def test_pruning_keeps_similar_pairs():
    for n, m in jj.least_matches(0.8, jj.TOLERANCE):
        assert 0 < m < 0.8 * n
        below = sum(_binomial(n, k, 0.8) for k in range(m))
        assert below < 1e-6                        # a pair at the threshold is all but never dropped
    assert jj.least_matches(0.8, jj.TOLERANCE)[-1][1] > 0.4 * jj.HASHES


def _binomial(n, k, p):
    from math import comb
    return comb(n, k) * p**k * (1 - p) ** (n - k)


def test_minhash_estimates_jaccard():
    a, b = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(200, 1200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = jj.minhashes([np.unique(a), np.unique(b), np.empty(0, np.uint64)])
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15 and (s[2] == 0xFFFFFFFF).all()


def test_both_exact_counts_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(60)]
    s = jj._Sets(sets)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(20, 60)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert (s.overlaps(i, j) == want).all()
    assert (s.matrix(np.arange(20), np.arange(20, 60))[i, j - 20] == want).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000 + k, 9999) for k in range(300)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.keys() == root.keys()
    assert len({(find(n), r) for n, r in got.items()}) == len(set(got.values())) == len({find(n) for n in got})
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
