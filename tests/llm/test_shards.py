import zlib
from collections import Counter, defaultdict

import pytest

from finch.llm import queries, shards


def check_law(rows, n):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(n)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def cuts(rows):
    """Members outside the shard that holds most of their group."""
    held = defaultdict(Counter)
    for r in rows:
        held[r["text_group"]][r["shard"]] += 1
    return sum(sum(c.values()) - max(c.values()) for c in held.values())


def test_groups_stay_together_and_sizes_even(frame, words):
    rows = [(g * 10 + k, f"group {g} " + words(5, g)) for g in range(150) for k in range(4)] + [(5000 + k, words(20, 9000 + k)) for k in range(400)]
    got = shards.shard_documents(frame(rows, 7)).collect()
    assert len(got) == len(rows)
    check_law(got, 8)
    text = dict(rows)
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    assert cuts(got) < 0.1 * 450                       # a random deal cuts about three of four links


def test_one_group_of_a_third(frame, words):
    rows = [(k, "hot") for k in range(400)] + [(1000 + g * 10 + k, f"pair {g}") for g in range(200) for k in range(2)] + [(9000 + k, words(9, k)) for k in range(400)]
    got = shards.shard_documents(frame(rows)).collect()
    check_law(got, 8)
    hot = Counter(r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot"))
    assert len(hot) <= 6 and cuts([r for r in got if r["text_crc32"] != zlib.crc32(b"hot")]) < 40


def test_edges(frame):
    rows = [(None, None), (None, ""), (1, "a"), (1, "a"), (2, "é")]
    got = shards.shard_documents(frame(rows)).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [1, 1, 2, 2, 3]
    check_law(got, 8)
    assert len({r["text_group"] for r in got}) == 3
    assert shards.shard_documents(frame([])).collect() == []


@pytest.mark.parametrize("n", [1, 3])
def test_other_counts(frame, n):
    got = shards.shard_documents(frame([(k, f"t{k % 5}") for k in range(31)]), n).collect()
    check_law(got, n)


def test_query(spark):
    rows = queries.op9_sharding(spark, "/root/testdata/sf0.001").collect()
    check_law(rows, 8)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
