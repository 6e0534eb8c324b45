import random
import zlib
from collections import Counter

import pytest

from finch.llm import spelling_variants as sv


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute(counts, dominance=5):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if one_edit(w, v)]
        form = min(near)[1] if near and -min(near)[0] >= dominance * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    rows = {}
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, *rest)
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_every_pair(seed):
    rng = random.Random(seed)
    letters = "abéz"[: 1 + seed % 4]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 10))) for _ in range(80)})
    index = sv.Index(words)
    found = set()
    for side in (True, False):
        i, j = index.near(words, side)
        found |= {(words[a], index.words[b]) for a, b in zip(i, j)}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_words_unknown_to_the_index():
    index = sv.Index(["karton", "garten"])
    i, j = index.near(["kartön", "garte", "xyzxyz"], True)
    assert {(a, index.words[b]) for a, b in zip(i.tolist(), j.tolist())} == {(0, "karton"), (1, "garten")}


def shown(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def occurrences(spark, counts):
    return spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string")


def test_chains_ties_and_roots(spark):
    counts = {"letter": 250, "lettre": 5, "lettar": 50, "lettbr": 50, "letttr": 10, "lattar": 10, "alonely": 7, "alonelz": 7, "rareword": 4}
    want = brute({w: n for w, n in counts.items() if n >= 5})
    got = shown(sv.group_variants(occurrences(spark, counts)))
    assert got == want
    assert got["lattar"][:2] == ("lettar", "letter") and got["alonely"][0] is None and "rareword" not in got


@pytest.mark.parametrize("chars", [40, 1 << 20])
def test_hot_halves_are_dealt_over_buckets(spark, chars):
    """A third of the words share their first half; buckets of 40 characters give the same rows."""
    rng = random.Random(4)
    words = ["common" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)]
    words += ["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(120)]
    counts = {w: rng.choice([1, 2, 10, 60]) for w in words}
    got = shown(sv.group_variants(occurrences(spark, counts), least_count=1, bucket_chars=chars))
    assert got == brute(counts)


def test_documents_as_the_contract_has_them(spark, frame, words):
    """Damaged runs counted by hand; nulls, empty texts, repeated rows, clashing columns and a very long text and word."""
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choice(["Überaus", "uberaus", "ÜBERAUS", "straße-Lang", "x1yellow", "yellows", "kurz"]) for _ in range(400))) for k in range(20)]
    texts += [(None, "yellow " * 300), (3, None), (4, ""), (5, "yellow " * 9), (5, "yellow " * 9), (6, words(40_000, 5)), (7, ("q" * 3000 + " ") * 6)]
    counts = Counter()
    for i, t in texts:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            else:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if run and h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1:]
                counts[run] += len(run) >= 6
                run = ""
    assert shown(sv.spelling_variants(frame(texts))) == brute({w: n for w, n in counts.items() if n >= 5})


def test_nothing_to_group(spark, frame):
    assert sv.spelling_variants(frame([])).collect() == []
    assert sv.spelling_variants(frame([(1, None), (2, "short words only")])).collect() == []


def test_columns_and_types(frame):
    assert sv.spelling_variants(frame([(1, "yellow " * 5)])).dtypes == [
        ("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
