import random

import duckdb
import numpy as np
import pytest

from finch.llm import bloom_cascade as bc
from finch.llm import queries


def test_exact_over_the_universe(spark, monkeypatch):
    keys = [f"host{k}.example" for k in range(5000)]
    listed = set(random.Random(1).sample(keys, 700)) | {"elsewhere.example"}
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    given = spark.createDataFrame([(k,) for k in listed] + [(k,) for k in list(listed)[:5]], "key string")
    for limit in (bc.MAX_BYTES, 300):                   # one cascade, and several
        monkeypatch.setattr(bc, "MAX_BYTES", limit)
        cascades = bc.build(given, universe)
        assert (len(cascades) > 1) == (limit == 300) and max(map(len, cascades)) > 1
        rows = spark.createDataFrame([(keys[a : a + 7],) for a in range(0, 5000, 7)] + [([],), (None,)], "keys array<string>")
        got = [x for r in bc.flag(rows, cascades, "keys", "hit").collect() for x in zip(r["keys"] or [], r["hit"])]
        assert len(got) == 5000 and all(hit == (k in listed) for k, hit in got)


def plain(url, rules, blocked):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    up = lambda name: host == name or host.endswith("." + name)
    fit = [k for k, _ in rules if up(k.split("/", 1)[0]) and path.startswith("/" + k.split("/", 1)[1])]
    rule = max(fit, key=len, default=None)
    return host, path, rule, dict(rules)[rule] if rule else "block" if any(up(b) for b in blocked) else "allow"


def test_rules_against_plain_python(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://NET", "http://net/", "http://a.net/x", "http://Example.NET/en/x?y#z", "http://m.example.net/en",
            "http://example.net/en/", "http://badnet/", "http://x.org/fr/", "http://x.org/fr", "http://x.org/de/fr/", "http://w.example.com/de/1",
            "http://example.com?/de/", "http://spam.example.com/x", "http://sub.spam.example.com#/de/", "http://ÀB.com/", "http://a..net//en/", "ftp://u/://net/"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls + urls[:3])], "page_id long, url string, keys int")
    blocked = spark.createDataFrame([("spam.example.com",), (None,)], "key string")
    got = bc.judge_urls(pages, queries.URL_RULES, blocked).collect()
    assert len(got) == len(urls) + 3
    for r in got:
        want = plain((urls + urls[:3])[r["page_id"]], queries.URL_RULES, ["spam.example.com"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want
    assert bc.judge_urls(pages.limit(0), queries.URL_RULES, blocked).collect() == []
    assert {r["verdict"] for r in bc.judge_urls(pages, [], blocked.limit(0)).collect()} == {"allow"}
    with pytest.raises(ValueError):
        bc.judge_urls(pages, [("net", "block")], blocked)


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{d}/pages.parquet'")
    want = sorted(con.sql(queries.ORACLE["op5_bloom_cascade"]).fetchall())
    assert sorted(map(tuple, queries.op5_bloom_cascade(spark, d).collect())) == want


def test_level_has_what_it_was_given():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(-2**63, 2**63, (2, 1000))
    at = np.unique(np.concatenate(list(bc._probes(h1, h2, 5000, 3, 1))))
    bits = np.zeros(5000 // 64 + 1, np.uint64)
    np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    assert bc.has((bits, 5000, 3, 1), h1, h2).all()
