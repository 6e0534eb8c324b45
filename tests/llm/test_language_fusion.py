import pytest

from finch.llm import language_fusion as lf

EN = "the house and the water with other things that were there when they went home "
DE = "das haus und das wasser mit anderen dingen die dort waren als sie nach hause gingen "


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, EN * (1 + k % 3), "en") for k in range(20)] + [(100 + k, DE * (1 + k % 3), "DE") for k in range(20)] + [(300, None, "en"), (301, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def page(url, lang, text):
    return url, f'<!DOCTYPE html><html lang="{lang}"><head><style>das und die</style></head><body><p>{text}</p></body></html>' if lang else f"<p>{text}</p>"


def run(spark, labelled, pages):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r for r in lf.identify(df, labelled).collect()}


def test_text_decides_where_it_is_long(spark, labelled):
    pages = [page(f"http://a{k % 5}.example.de/x", "de", DE) for k in range(30)] + [page(f"http://b{k % 5}.example.uk/x", "en", EN) for k in range(30)]
    pages += [page("http://a0.example.de/y", "de", EN * 5)]                   # declares the wrong language
    got = run(spark, labelled, pages)
    assert [got[k]["lang"] for k in range(61)] == ["de"] * 30 + ["en"] * 31
    assert got[60]["declared"] == "de" and got[60]["suffix"] == "de" and got[0]["confidence"] > 0.99


def test_other_evidence_decides_where_text_is_short(spark, labelled):
    pages = [page(f"http://a{k % 5}.example.de/x", "de", DE) for k in range(30)] + [page(f"http://b{k % 5}.example.uk/x", "en", EN) for k in range(30)]
    pages += [("http://a1.example.de/z", ""), ("http://b1.example.uk/z", ""), ("http://new.example.org/", '<html lang="de">'), ("http://other.uk", None)]
    got = run(spark, labelled, pages)
    assert [got[k]["lang"] for k in range(60, 64)] == ["de", "en", "de", "en"]


def test_edges(spark, labelled):
    pages = [(None, None), ("", ""), ("no scheme", "<p>"), ("http://a.de", DE * 3000), ("http://a.de", DE * 3000)]
    got = run(spark, labelled, pages)
    assert len(got) == 5 and got[3]["lang"] == "de" and got[3]["host"] == "a.de" and got[0]["lang"] in ("de", "en")
    assert run(spark, labelled, [])  == {}
    none = run(spark, labelled.limit(0), pages)
    assert {r["lang"] for r in none.values()} == {None} and len(none) == 5


def test_whole_table(spark):
    from finch.llm import queries
    d = "/root/testdata/sf0.001"
    got = queries.op7_language_fusion(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/pages.parquet").count()
    by_path = spark.read.parquet(f"{d}/pages.parquet").selectExpr("page_id", "regexp_extract(url, '://[^/]*/(..)/', 1) AS p").collect()
    want = {r["page_id"]: r["p"] for r in by_path}
    assert sum(r["lang"] == want[r["page_id"]] for r in got) >= 0.97 * len(got)
