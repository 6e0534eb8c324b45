import numpy as np
from pyspark.sql import Row, functions as F

from finch.operators import evaluate as ev
from finch.operators import prompts as pr
from finch.operators import reports as rp
from finch.session import scratch_path
from finch.sinks.files import append_rows, write_csv
from finch.sources.files import read_sitemap, read_transactions_csv


def test_context_order_and_truncation(spark):
    hits = spark.createDataFrame([Row(q=1, rank=2, text="b" * 15000), Row(q=1, rank=1, text="a" * 15000),
                                  Row(q=2, rank=1, text="solo")])
    ctx = {r.q: r.context for r in pr.build_context(hits, "q").collect()}
    assert len(ctx[1]) == 20000 and ctx[1].startswith("a" * 15000 + " b")
    assert ctx[2] == "solo"


def test_render_missing_and_absent_fields(spark):
    df = spark.createDataFrame([Row(question="Q?", age=None, name="x")], "question string, age int, name string")
    out = df.select(pr.render("Q: {question} age={age} ev={life_event}", persona="", columns=df.columns).alias("p")).first().p
    assert out == "Q: Q? age=N/A ev=N/A"
    pieces = pr.template_pieces("[{persona}] {a}", persona="P")
    assert pieces == [("lit", "[P] "), ("col", "a")]


def test_validate_profiles_reasons(spark):
    raw = spark.createDataFrame([
        Row(age="30", income="5", debt="0", assets="1", credit_score="700", employment="Employed",
            risk_tolerance="Low", time_horizon="Long-term"),
        Row(age="old", income="5k", debt="0", assets="1", credit_score="700", employment="Retired",
            risk_tolerance="Low", time_horizon="Soon"),
    ])
    rows = pr.validate_profiles(raw).collect()
    assert rows[0].valid and rows[0].reason == "" and rows[0].age == 30
    assert not rows[1].valid and rows[1].reason == "age,income,employment,time_horizon" and rows[1].age is None


def test_sparse_cosine_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, size=(6, 16)), rng.integers(0, 4, size=(6, 16))
    def sparse(m):
        return spark.createDataFrame([(i, j, int(m[i, j])) for i in range(6) for j in range(16) if m[i, j]],
                                     "k long, b int, c long")
    got = {r.k: r.sim for r in ev.sparse_cosine(sparse(a), sparse(b), ["k"]).collect()}
    for i in range(6):
        exp = a[i] @ b[i] / np.sqrt((a[i] @ a[i]) * (b[i] @ b[i]))
        assert abs(got[i] - exp) < 1e-12


def test_score_vectors(spark):
    df = spark.createDataFrame([Row(t=[1.0, 0.0], r=[1.0, 0.0], n=[0.0, 1.0])])
    r = ev.score_vectors(df, "t", "r", "n").first()
    assert (r.rag_score, r.non_rag_score) == (1.0, 0.0)


def test_reports(spark):
    df = spark.createDataFrame([Row(Date="01/31/2023", Category="A"), Row(Date="2024-01-02", Category="A"),
                                Row(Date="bad", Category="B")])
    m = rp.with_month_year(df)
    assert [r.Month for r in m.orderBy("Category", "Month").collect()] == [1, 1, None]
    assert {r.Month: r.Count for r in rp.count_per(m, "Month").collect()} == {1: 2}
    share = {r.Category: r.Percent for r in rp.share_of_total(rp.count_per(df, "Category")).collect()}
    assert abs(share["A"] - 200 / 3) < 1e-9


def test_csv_roundtrip_keeps_spaces(spark):
    path = scratch_path(spark, "t-csv")
    df = spark.createDataFrame([Row(Date="1/2/2023", Description=" lead and trail ", Amount="-5.00")])
    write_csv(df, path)
    assert read_transactions_csv(spark, path, multi_line=True).first().Description == " lead and trail "


def test_keyed_append(spark):
    path = scratch_path(spark, "t-append")
    df = spark.createDataFrame([Row(id=1, v="a"), Row(id=2, v="b")])
    append_rows(df, path, ["id"])
    append_rows(spark.createDataFrame([Row(id=2, v="B"), Row(id=3, v="c")]), path, ["id"])
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    append_rows(df, path)   # unkeyed: a rerun duplicates, as the original
    assert spark.read.parquet(path).count() == 5


def test_sitemap_reader(spark):
    path = scratch_path(spark, "t-sitemap")
    xml = ('<?xml version="1.0"?><urlset><url><loc>https://u:p@a.com:81/x/t1/?a=1&amp;b=2</loc>'
           '<priority>0.5</priority></url>\n<url><changefreq>daily</changefreq></url>'
           '<url><loc>http://b.org/y/</loc></url></urlset>')
    spark.createDataFrame([Row(value=xml)]).coalesce(1).write.text(path)
    rows = read_sitemap(spark, path, name="main").orderBy("pos").collect()
    assert [(r.pos, r.loc, r.changefreq, r.priority, r.domain, r.sitemap_name) for r in rows] == [
        (0, "https://u:p@a.com:81/x/t1/?a=1&b=2", "", "0.5", "u:p@a.com:81", "main"),
        (1, "", "daily", "", "", "main"),
        (2, "http://b.org/y/", "", "", "b.org", "main")]


def test_generator_plugin(spark):
    df = spark.createDataFrame([Row(k=1, prompt='x\n   Your Question: "Why?"\n')])
    out = pr.generate(df, ["k"], "prompt", pr.StubGenerator).first()
    assert out.attempt == 1 and 'Your Question: "Why?"' in out.response


def test_no_hits_frame_is_used_without_context(spark):
    from finch.functions.constants import PROMPT_NO_HITS, PROMPT_RAG
    df = spark.createDataFrame([Row(question="Q", context=None), Row(question="Q", context="ctx")],
                               "question string, context string")
    frame = F.when(F.col("context").isNull(), pr.render(PROMPT_NO_HITS, persona="P", columns=df.columns)) \
             .otherwise(pr.render(PROMPT_RAG, persona="P", columns=df.columns))
    a, b = [r.p for r in df.select(frame.alias("p")).collect()]
    assert "\nContext:" not in a and "\nContext: ctx" in b
    assert "Age: N/A" in a and 'Your Question: "Q"' in a


def test_csv_by_header_with_quotes_and_line_breaks(spark, tmp_path):
    import pytest
    f = tmp_path / "export.csv"
    f.write_text('Date,Amount,Card Member,Description\n01/02/2023,4.50,J DOE,"say ""hi"", ok\nsecond line"\n01/03/2023,,,plain\n')
    rows = read_transactions_csv(spark, str(f), multi_line=True).orderBy("Date").collect()
    assert rows[0].asDict() == {"Date": "01/02/2023", "Description": 'say "hi", ok\nsecond line', "Amount": "4.50", "Card Member": "J DOE"}
    assert rows[1].Description == "plain" and rows[1].Amount is None and len(rows) == 2
    with pytest.raises(ValueError, match="Amount"):
        (tmp_path / "bad.csv").write_text("Date,Description\n1,2\n")
        read_transactions_csv(spark, str(tmp_path / "bad.csv"), multi_line=True)


def test_prompt_frames_keep_their_blanks():
    from finch.functions import constants as c
    assert "financial resources. \n                You prioritize" in c.PERSONA
    assert "situation and goals.\n                \n                Example 1:" in c.PERSONA and "Response Style: \n" in c.PERSONA
    for frame in (c.PROMPT_RAG, c.PROMPT_NO_HITS, c.PROMPT_NON_RAG, c.PROMPT_RAG_NOTEBOOK, c.PROMPT_NON_RAG_NOTEBOOK, c.PROMPT_LOCAL_NOTEBOOK):
        lines = frame.split("\n")
        assert sum(x.endswith('"{employment}", ') for x in lines) == 1 and sum("credit score: {credit_score}, " in x and x.endswith(" ") for x in lines) == 1
    for frame in (c.PROMPT_RAG_NOTEBOOK, c.PROMPT_NON_RAG_NOTEBOOK, c.PROMPT_LOCAL_NOTEBOOK):
        assert "next steps. \n" in frame and "Response Style: \n" in frame and frame.startswith("[INST]\n    Persona")
    assert c.PROMPT_NON_RAG_NOTEBOOK.count("Example ") == 3 and c.PROMPT_RAG_NOTEBOOK.count("Example ") == 2
    assert c.PROMPT_LOCAL_NOTEBOOK.count('{time_horizon}"".') == 1 and "{life_event}" not in c.PROMPT_LOCAL_NOTEBOOK


def test_embedder_is_built_in_the_worker(spark):
    from finch.operators.retrieval import embed_with

    class Unpicklable:
        def __init__(self):
            import threading
            self.lock = threading.Lock()

        def __call__(self, texts):
            return [[float(len(t))] for t in texts]

    got = embed_with(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda: Unpicklable()).collect()
    assert [r.embedding for r in got] == [[2.0], [0.0]]


def test_page_files_in_ranges(spark, tmp_path):
    """One large file is read by several tasks; page numbers hold across its ranges."""
    from finch.sources.files import read_page_files
    big = [f"page {k} é " + "x" * (k * 37 % 400) for k in range(700)]
    (tmp_path / "big.txt").write_text("\f".join(big) + "\f")
    (tmp_path / "small.txt").write_text("one\nline two\f\fthree")
    (tmp_path / "empty.txt").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        pages = read_page_files(spark, str(tmp_path))
        rows = pages.collect()
        tasks = spark.read.option("lineSep", "\f").text(str(tmp_path / "big.txt")).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {}
    for r in rows:
        got.setdefault(r.path.rsplit("/", 1)[1], {})[r.page_no] = r.text
    assert tasks > 5 and got["big.txt"] == dict(enumerate(big))
    assert got["small.txt"] == {0: "one\nline two", 1: "", 2: "three"} and "empty.txt" not in got


def test_book_of_a_language_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """The pages of one language are volumes by several tasks, numbered through in document order."""
    from finch.plans import corpus
    docs = [(k, "en" if k % 9 else "de", f"{k} " + "x" * (k * 613 % 9000)) for k in range(300)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    books = []
    monkeypatch.setattr(corpus, "read_page_files", lambda s, path, **k: (books.append(path), read_page_files(s, path, **k))[1])
    from finch.sources.files import read_page_files
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1000")
        rows = corpus.scan_page_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    files = spark.read.text(f"{books[0]}/lang=en").inputFiles()
    assert len(files) > 2
    for lang in ("en", "de"):
        want = [(k, p, t[p * 2000 : p * 2000 + 2000]) for k, g, t in docs if g == lang for p in range(-(-len(t) // 2000))]
        got = sorted((r for r in rows if r.lang == lang), key=lambda r: r.page_no)
        assert [r.page_no for r in got] == list(range(len(want))) and [(r.doc_id, r.doc_page, r.text) for r in got] == want
