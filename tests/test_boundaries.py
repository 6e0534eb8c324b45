import math
import random
import re
from collections import Counter

import pytest

from finch.operators.boundaries import chunk_sentences_learnt, learn_boundaries
from finch.operators.chunks import chunk_sentences


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    nouns = ["market", "bank", "saver", "fund", "house", "student", "lender", "broker"]
    verbs = ["saw", "paid", "met", "asked", "told"]
    starts = ["The", "A", "Each", "This"]
    rows = []
    for k in range(300):
        s = []
        for _ in range(12):
            who = rng.choice(["Dr. Miller", "Mr. Lopez", "the U.S. economy", "St. Ives", "J. Stone", rng.choice(nouns), rng.choice(nouns), rng.choice(nouns)])
            s.append(f"{rng.choice(starts)} {rng.choice(nouns)} {rng.choice(verbs)} {who}" + rng.choice([".", ".", ".", "!", '."']))
        rows.append((k, rng.choice([" ", "\n"]).join(s)))
    return spark.createDataFrame(rows + [(900, None), (901, ""), (902, " \n ")], "doc_id long, text string")


def words(df):
    return {tuple(r) if len(r) > 1 else r[0] for r in df.collect()}


def test_learns_what_the_texts_hold(spark, corpus):
    learnt = learn_boundaries(corpus)
    assert words(learnt.abbreviations) >= {"dr", "mr", "u.s", "st"}
    assert not words(learnt.abbreviations) & {"market", "bank", "saver", "fund"}
    assert words(learnt.starters) >= {"the", "a", "each", "this"} and "miller" not in words(learnt.starters)
    assert ("j", "stone") in words(learnt.collocations)


def test_scores_by_hand(spark, corpus):
    """The ratio of every word, recomputed word by word."""
    counts = Counter()
    for r in corpus.collect():
        for t in (r.text or "").split():
            w = t.lstrip("\"'([{").rstrip("\"')]},;:!?").lower()
            counts[w[:-1] if w.endswith(".") else w, w.endswith(".")] += 1
    n, with_period = sum(counts.values()), sum(m for (_, p), m in counts.items() if p)
    p = with_period / n
    want = set()
    for w in {w for (w, _) in counts}:
        a, b = counts[w, True], counts[w, False]
        if a:
            ratio = 2 * (a * math.log(0.99) + b * math.log(0.01) - a * math.log(p) - b * math.log(1 - p))
            length = len(w.replace(".", ""))
            if ratio * math.exp(-length) * (w.count(".") + 1) * length ** -b >= 0.3:
                want.add(w)
    assert words(learn_boundaries(corpus).abbreviations) == want


def test_abbreviations_no_longer_split(spark, corpus):
    learnt = learn_boundaries(corpus)
    text = 'He saw the U.S. economy grow. Dr. Miller left! "It fell." The bank paid Mr. Lopez. St. Ives is far.'
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rule = [r.text for r in chunk_sentences(docs, "doc_id", "text").orderBy("pos").collect()]
    got = [r.text for r in chunk_sentences_learnt(docs, "doc_id", "text", learnt).orderBy("pos").collect()]
    assert "He saw the U.S." in rule
    assert got == ["He saw the U.S. economy grow.", "Dr. Miller left!", '"It fell."', "The bank paid Mr. Lopez.", "St. Ives is far."]
    joined = chunk_sentences_learnt(docs, "doc_id", "text", learnt, literals=0)
    assert [r.text for r in joined.orderBy("pos").collect()] == got


def test_join_and_set_agree_and_nothing_is_lost(spark, corpus):
    learnt = learn_boundaries(corpus)
    sets = {(r.doc_id, r.pos): r.text for r in chunk_sentences_learnt(corpus, "doc_id", "text", learnt).collect()}
    joined = {(r.doc_id, r.pos): r.text for r in chunk_sentences_learnt(corpus, "doc_id", "text", learnt, literals=0).collect()}
    assert sets == joined
    for r in corpus.where("doc_id < 900").collect():
        parts = [sets[r.doc_id, k] for k in range(sum(d == r.doc_id for d, _ in sets))]
        assert re.sub(r"\s+", "", "".join(parts)) == re.sub(r"\s+", "", r.text)
    assert not [d for d, _ in sets if d >= 900]


def test_no_shuffle_of_texts(spark, corpus):
    plan = chunk_sentences_learnt(corpus, "doc_id", "text", learn_boundaries(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("text", [None, "", "no period here", "1. 2. 3."])
def test_nothing_to_learn(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    learnt = learn_boundaries(docs)
    assert [t.collect() for t in learnt] == [[], [], []]
    assert chunk_sentences_learnt(docs, "doc_id", "text").collect() == chunk_sentences(docs, "doc_id", "text").collect()
