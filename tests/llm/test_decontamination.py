import random

import numpy as np
import pytest

from finch.llm import decontamination as dc


def plain_align(x, y):
    h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    best = 0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if x[i - 1] == y[j - 1] else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(2, 9, rng.integers(1, 30)).astype(np.uint64), rng.integers(2, 9, rng.integers(1, 50)).astype(np.uint64)) for _ in range(200)]
    assert dc.align(*map(list, zip(*pairs))).tolist() == [plain_align(x, y) for x, y in pairs]


@pytest.fixture(scope="module")
def planted(spark, words):
    rng = random.Random(9)
    items = [(k, words(30 + k, 300 + k, 600).capitalize() + ".") for k in range(12)] + [(50, words(200, 400, 600)), (51, None), (52, ""), (53, "tiny item"), (54, "yes")]
    docs, want = [], set()
    for d in range(120):
        text = words(rng.randrange(5, 300), 1000 + d, 600).split()
        if d % 3 == 0:
            k = rng.randrange(13)
            w = items[k][1].split()
            if d % 2:                                        # edited copy
                for _ in range(len(w) // 8):
                    w[rng.randrange(len(w))] = "changed"
                del w[rng.randrange(len(w))]
            if items[k][0] == 50 and d % 4 == 0:
                w = w[60:140]                                # part of a long item
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() if d % 5 == 0 else x for x in w]
            want.add((d, items[k][0]))
        docs.append((d, " ".join(text)))
    return docs, spark.createDataFrame(items, "item_id long, text string"), want


def test_planted_items_are_found_and_clean_documents_are_not(frame, planted):
    docs, items, want = planted
    got = {(r["id"], r["item"]) for r in dc.contaminated(frame(docs), items).collect()}
    assert got == want
    left = dc.drop_contaminated(frame(docs), items)
    assert left.columns == ["doc_id", "text", "h", "row", "key"]
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_common_passage_and_several_scans(frame, planted, monkeypatch, words):
    docs, items, want = planted
    item = next(r["text"] for r in items.where("item_id = 3").collect())
    more = docs + [(500 + k, f"{words(10, k)} {item} {words(10, 50 + k)}") for k in range(300)]
    monkeypatch.setattr(dc, "MAX_SEEDS", 200)
    got = {(r["id"], r["item"]) for r in dc.contaminated(frame(more), items).collect()}
    assert got == want | {(500 + k, 3) for k in range(300)}


def test_edges(spark, frame, planted):
    docs, items, _ = planted
    text = dict(docs)[0]
    odd = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "a tiny, item!"), (5, "tiny things"), (6, "she said yes and left")]
    got = sorted((r["id"] or 0, r["item"]) for r in dc.contaminated(frame(odd), items).collect())
    assert len({i for i, _ in got}) == 2            # an item of a few words is no evidence
    assert {r["doc_id"] for r in dc.drop_contaminated(frame(odd), items).collect()} == {2, 3, 4, 5, 6}
    none = spark.createDataFrame([], items.schema)
    assert dc.drop_contaminated(frame(odd), none).count() == len(odd)
    assert dc.contaminated(frame([]), items).collect() == []
    twice = items.unionByName(items)
    assert dc.contaminated(frame(odd), twice).count() == len(got)


def test_edited_copy_that_many_documents_share(spark, frame, words):
    item = [f"item{k}" for k in range(40)]
    edited = ["changed" if k % 6 == 5 else w for k, w in enumerate(item)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for copy in (edited, item[:22]):                        # every sixth word changed; little more than half of the item
        docs = [(k, f"{words(20, k)} {' '.join(copy)} {words(20, 500 + k)}") for k in range(300)]
        clean = [(1000 + k, words(60, 1000 + k)) for k in range(20)]
        got = dc.contaminated(frame(docs + clean), items).collect()
        assert {r["id"] for r in got} == set(range(300)) and len(got) == 300
        scores = plain_align(item, copy) / (2 * len(item))
        assert all(abs(r["score"] - scores) < 1e-9 for r in got)


def test_item_ids_that_are_null_or_repeat(spark, frame, words):
    texts = [words(30, 700 + k) for k in range(4)]
    items = spark.createDataFrame(list(zip([None, 7, 7, 1 << 60], texts)), "item_id long, text string")
    got = {(r["id"], r["item"]) for r in dc.contaminated(frame(list(enumerate(texts))), items).collect()}
    assert got == {(0, None), (1, 7), (2, 7), (3, 1 << 60)}


def test_every_third_or_fourth_word_changed(spark, frame, words):
    item = [f"item{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = []
    for k, every in enumerate((3, 4)):
        copy = ["changed" if i % every == every - 1 else w for i, w in enumerate(item)]
        docs += [(100 * k + n, f"{words(15, n)} {' '.join(copy)} {words(15, 90 + n)}") for n in range(40)]
    got = {r["id"]: r["score"] for r in dc.contaminated(frame(docs + [(900, words(80, 3))]), items, least=0.45).collect()}
    assert set(got) == set(range(40)) | set(range(100, 140))


def test_recall_against_every_window(spark, frame, words):
    """Brute force: all items aligned with all documents; edits of one word in two to eight, planted in common words."""
    rng = random.Random(12)
    items = [(k, words(rng.randrange(14, 60), 800 + k, 60)) for k in range(15)]
    docs = []
    for d in range(90):
        w = items[rng.randrange(15)][1].split()
        for i in range(len(w)):
            if rng.random() < rng.choice([0, 0.1, 0.25, 0.4]):
                w[i] = words(1, d * 100 + i, 60)
        docs.append((d, " ".join([words(rng.randrange(5, 60), 5000 + d, 60), *w, words(20, 7000 + d, 60)])))
    want = set()
    for d, text in docs:
        for k, item in items:
            x = dc.normalise(item)
            if plain_align(x, dc.normalise(text)) >= dc.SCORE * 2 * len(x):
                want.add((d, k))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"]) for r in dc.contaminated(frame(docs), table).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 50


def test_seed_that_thousands_of_items_share(spark, frame, words):
    """A phrase common to 3,000 items and 300 documents: all seeds meet, no item is found where only the phrase stands."""
    phrase = "which of the following words"
    items = spark.createDataFrame([(k, f"{phrase} {words(20, k, 5000)}") for k in range(3000)], "item_id long, text string")
    docs = [(d, f"{words(10, d)} {phrase} {words(30, 9000 + d)}") for d in range(300)]
    docs += [(1000, f"x {phrase} {words(20, 77, 5000)} y")]
    assert {(r["id"], r["item"]) for r in dc.contaminated(frame(docs), items).collect()} == {(1000, 77)}
