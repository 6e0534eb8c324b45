"""Fingerprints against a plain-Python version with the same hash function."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from finch.llm import queries, syncmers


def spark_hash(*values):
    """xxhash64 of a column list: each value is hashed with the last result as seed."""
    seed = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            data = x.encode() if isinstance(x, str) else (x & (2**64 - 1)).to_bytes(8, "little")
            seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_fingerprint(text, k=8, s=2):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
    if words and (len(text) < 512 or len(words) * 16 < len(text)):
        words = list(text)
    h = [spark_hash(w) for w in words]
    if not h:
        return []
    if len(h) < k:
        return [spark_hash(h) >> 32]
    out = []
    for i in range(len(h) - k + 1):
        mers = [spark_hash(*h[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(mers[0], mers[-1]) == min(mers):
            x = spark_hash(*h[i : i + k]) >> 32
            if x not in out:
                out.append(x)
    return out


def hexed(fp):
    return "".join(f"{x & 0xFFFFFFFF:08x}" for x in fp)


def near(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_match_the_plain_version(frame, words):
    rows = [(1, words(50, 1)), (2, words(70, 2)), (5, words(50, 1)), (9, ""), (10, None), (12, "one two"), (20, "é" * 9 + " ñ"), (21, "same " * 40),
            (22, words(3000, 3)), (None, words(30, 4))]
    got = {r["doc_id"]: r for r in syncmers.fingerprint_edits(frame(rows)).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == hexed(a) and r["edited_fingerprint"] == hexed(b)
        assert r["near_edited"] == pytest.approx(near(a, b)) and r["near_next"] == pytest.approx(near(a, c))
    assert len(got) == len(rows)


def test_repeated_rows_and_small_tables(frame, words):
    text = words(20, 5)
    got = syncmers.fingerprint_edits(frame([(1, text), (1, text), (2, "b c d")])).collect()
    assert len(got) == 3
    twins = [r for r in got if r["doc_id"] == 1]
    assert twins[0] == twins[1]
    one = syncmers.fingerprint_edits(frame([(7, text)])).collect()[0]
    assert one["near_next"] == 1.0
    assert syncmers.fingerprint_edits(frame([])).collect() == []


def test_anchors_do_not_depend_on_their_context(spark, words):
    part = words(200, 6)
    df = spark.createDataFrame([(words(30, 7) + " " + part,), (words(11, 8) + " " + part + " " + words(9, 9),)], "text string")
    a, b = [{(x["pos"], x["hash"]) for x in r[0]} for r in df.select(syncmers.syncmers(F.col("text"))).collect()]
    inner_a = {(p - 30, h) for p, h in a if p >= 30}
    inner_b = {(p - 11, h) for p, h in b if 11 <= p <= 11 + 200 - 8}
    assert inner_a == inner_b and inner_a


def test_plan_has_no_python(spark):
    plan = queries.op1_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_short_and_unspaced_texts_are_like_their_edits(spark, frame, words):
    """Nine in ten texts of 40 characters or more keep a likeness above 0.3 when a quarter is replaced."""
    rows = [(k, words(5 + k % 90, k)) for k in range(300)] + [(1000 + k, words(300, k).replace(" ", "")) for k in range(20)]
    got = [r["near_edited"] for r in syncmers.fingerprint_edits(frame([r for r in rows if len(r[1]) >= 40])).collect()]
    assert sum(x > 0.3 for x in got) >= 0.9 * len(got)
    from finch.llm.common import table
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("length(text) >= 40")
    got = [r["near_edited"] for r in syncmers.fingerprint_edits(docs).collect()]
    assert sum(x > 0.3 for x in got) >= 0.9 * len(got)


def test_one_changed_character_of_an_unspaced_text(frame, words):
    text = words(400, 8).replace(" ", "")
    got = {r["doc_id"]: r for r in syncmers.fingerprint_edits(frame([(1, text), (2, text[:700] + "?" + text[701:])])).collect()}
    assert got[1]["near_next"] > 0.9
