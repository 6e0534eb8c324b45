from urllib.parse import urlparse

from pyspark.sql import Row, functions as F

from helpers import col1
from finch.functions import urls as u
from finch.operators import links as lk
from finch.operators import pages as pg


def test_markdown_links_regex(spark):
    md = ["[a](x) [b]\n(y) [c](z)", "[](e) no ( [d](f(g)"]
    assert col1(spark, md, u.markdown_links("x")) == [["x", "z"], ["e", "f(g"]]


def test_authority_matches_urlparse(spark):
    urls = ["https://u:p@h.example.com:81/a/b?q=1#f", "http://x.org", "//nohost/path", "mailto:a@b", "http://h/a%"]
    assert col1(spark, urls, u.url_authority("x")) == [
        urlparse(x).netloc if x.split("://")[0].isalpha() and "://" in x else "" for x in urls]


def test_topic_and_file_name(spark):
    assert col1(spark, ["https://a.com/x/chapter-one/", "short"], u.url_topic("x")) == ["chapter-one", None]
    assert col1(spark, ["https://r.com/wiki/Über_fünf-2?x=1"], u.url_file_name("x")) == ["Über_fünf2x1.txt"]


def test_crawl_matches_python_closure(spark):
    # cyclic graph: 0->1->2->0, 2->3, 4 unreachable, self loop 3->3
    edges = [("index", "a"), ("a", "b"), ("b", "index"), ("b", "c"), ("c", "c"), ("d", "a")]
    df = spark.createDataFrame([Row(src=s, target=t, url="https://w/wiki/" + t) for s, t in edges])
    got = {r.target: r.depth for r in lk.crawl(df).collect()}
    assert got == {"a": 1, "b": 2, "index": 3, "c": 3}
    one = {r.target for r in lk.crawl(df, max_rounds=1).collect()}
    assert one == {"a"}


def test_skip_first_and_percent(spark):
    df = spark.createDataFrame([Row(pos=0, loc="a%"), Row(pos=1, loc="b"), Row(pos=2, loc="c")])
    assert [r.loc for r in lk.skip_first(lk.drop_percent_urls(df), ["pos"]).collect()] == ["c"]


HTML = """<html><body><nav>menu</nav><main><h1> Title </h1><script>x=1</script>
<div><p>one <b>two</b></p><!-- c --><style>p{}</style><p>three</p></div>text<p>four</p></main></body></html>"""


def test_exact_extraction():
    text = lambda html: pg.main_node(html)[2]
    assert text(HTML) == "Title one\ntwo\nthree four"
    assert text("<body><p>x</p><script>s</script></body>") == "x"
    assert pg.main_node("<body><main></main><article><p>a</p></article></body>") == ("main", "", "")       # an empty node counts
    assert pg.main_node('<div role="main"><div>a b c</div><p>kept</p></div>')[1:] == ("<div>a b c</div><p>kept</p>", "a b c kept")
    assert pg.main_node("<article>own<article><p>in</p></article><p>tail</p></article>x")[2] == "in tail"
    assert text("<article><h1>Title here</h1><p>one two</p><p>three four</p></article>") == "Title here one two three four"
    assert text("<article><p>a &lt;b&gt;\n c<br>d<!-- no --></p><style>s</style><div><script>s</script>e</div></article>") == "a <b>\n c\nd e"
    assert text("<article><p>a</b></p></i>t<p>b") == "a b"
    assert pg.main_node(None) == pg.main_node("") == pg.main_node("plain") == (None, None, "")


def test_deep_pages_do_not_end_the_task():
    assert pg.main_node("<body>" + "<p>x" * 100_000)[2] == "\n".join("x" * 100_000)
    assert pg.main_node("<article>" + "<i>" * 50_000 + "</b>" * 50_000)[2] == ""


def test_main_block_and_native_text(spark):
    df = spark.createDataFrame([Row(id=1, html=HTML), Row(id=2, html="<body><article><p>a &amp; b</p></article></body>")])
    rows = {r.id: r for r in pg.page_text(df).collect()}
    assert rows[1].tag == "main" and rows[2].tag == "article"
    assert rows[1].text == "Title\none\ntwo\nthree\ntext\nfour"
    assert rows[2].text == "a & b"


def test_fetch_outcome(spark):
    log = spark.createDataFrame([
        Row(url="u1", n=1, err=True, body="e"), Row(url="u1", n=2, err=True, body="e"), Row(url="u1", n=3, err=False, body="ok3"),
        Row(url="u2", n=1, err=False, body="An unknown error occurred"), Row(url="u2", n=2, err=False, body="ok"),
        *[Row(url="u3", n=i, err=True, body="e") for i in range(1, 8)],
    ])
    out = {r.url: r for r in pg.fetch_outcome(log, "url", ["n"], F.col("err"), "body").collect()}
    assert (out["u1"].ok, out["u1"].attempt, out["u1"].text, out["u1"].waited_sec) == (True, 2, "ok3", 3.0)
    assert (out["u2"].attempt, out["u2"].text, out["u2"].waited_sec) == (1, "ok", 1.0)
    assert (out["u3"].ok, out["u3"].text, out["u3"].waited_sec) == (False, "Failed to retrieve content after several attempts", 31.0)


def test_fetch_outcome_hot_url_is_cut_before_shuffle(spark):
    # one URL holds a third of all attempts: only its first 5 attempts per map
    # partition may cross the shuffle (partial WindowGroupLimit before Exchange)
    from pyspark.sql import functions as F
    n = 30000
    log = (spark.range(n).repartition(8)
                .select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 500).cast("string"))).alias("url"),
                        F.col("id").alias("n"), (F.col("id") < 6).alias("err"), F.lit("body").alias("body")))
    out = pg.fetch_outcome(log, "url", ["n"], F.col("err"), "body")
    plan = out._jdf.queryExecution().executedPlan().toString()
    limits = [l for l in plan.split("\n") if "WindowGroupLimit" in l]
    assert any("Partial" in l for l in limits) and any("Final" in l for l in limits)
    hot = out.where("url = 'hot'").first()
    assert (hot.ok, hot.attempt, hot.waited_sec) == (True, 2, 3.0)   # ids 0 and 3 failed, 6 succeeded


def test_text_dir_flat_and_recursive(spark):
    from finch.session import scratch_path
    from finch.sinks.files import write_docs_as_text
    from finch.sources.files import read_text_dir
    root = scratch_path(spark, "t-dir")
    docs = spark.createDataFrame([Row(lang="en", doc_id=1, text="a"), Row(lang="fr", doc_id=2, text="b")])
    write_docs_as_text(docs, root, ["lang", "doc_id"])
    assert read_text_dir(spark, root).count() == 2                             # recursive, *.txt only
    assert read_text_dir(spark, f"{root}/lang=en/doc_id=1", recursive=False).count() == 1


def test_crawl_has_no_depth_limit(spark):
    import inspect
    assert inspect.signature(lk.crawl).parameters["max_rounds"].default is None
    chain = spark.createDataFrame([("index" if i == 0 else f"p{i}", f"p{i + 1}", f"u{i}") for i in range(24)], "src string, target string, url string")
    assert lk.crawl(chain).count() == 24 and lk.crawl(chain, max_rounds=5).count() == 5


def test_text_file_names(spark):
    from finch.sinks.files import text_file_name
    got = [r[0] for r in spark.createDataFrame([("a.pdf",), ("b.PDF",), ("c.pdf.x",)], "f string").select(text_file_name("f")).collect()]
    assert got == ["a.txt", "b.PDF.txt", "c.pdf.x.txt"]


def test_ordered_write(spark):
    from finch.session import scratch_path
    from finch.sinks.files import write_ordered
    path = scratch_path(spark, "t-ordered")
    write_ordered(spark.range(1000).select((999 - F.col("id")).alias("pos")), path, "pos")
    files = sorted({r[0] for r in spark.read.parquet(path).select(F.col("_metadata.file_path")).collect()})
    assert [r.pos for f in files for r in spark.read.parquet(f).collect()] == list(range(1000))


def test_a_round_exchanges_only_its_frontier(spark):
    """No exchange below the edges' and the visited pages' bucketed scans."""
    from finch.session import scratch_path
    path = scratch_path(spark, "crawl-plan")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        edges = lk._bucketed(spark.range(200).selectExpr("concat('p', id) AS src", "concat('p', id + 1) AS target", "'u' AS url"), "t_plan_edges", f"{path}/e", "src", 8)
        visited = lk._bucketed(spark.createDataFrame([("p1", "u", 1)], "target string, url string, depth int"), "t_plan_visited", f"{path}/v", "target", 8)
        frontier = spark.createDataFrame([("p1",)], "target string")
        plan = lk.next_pages(frontier, edges, visited)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        for t in ("t_plan_edges", "t_plan_visited"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
    scans = [i for i, line in enumerate(plan) if "FileScan" in line]
    assert len(scans) == 2 and sum("Exchange" in line for line in plan) == 2        # the frontier, and what it reaches
    depth = [max(line.find("+- "), line.find(":- "), -1) for line in plan]
    for i in scans:
        at = i
        for k in range(i, -1, -1):                          # up the tree to the join
            if depth[k] < depth[at]:
                at = k
                assert "Exchange" not in plan[k]
                if "Join" in plan[k]:
                    break
        assert "Join" in plan[at]


def test_crawl_without_pages(spark):
    assert lk.crawl(spark.createDataFrame([], "src string, target string, url string")).collect() == []


def test_many_short_files_are_read_by_few_tasks(spark, tmp_path):
    """A short file is a small part of a task; compressed files are unpacked, others taken byte by byte."""
    import gzip
    from finch.sources.files import read_text_dir
    cores = spark.sparkContext.defaultParallelism
    texts = {f"{k}.txt": f"\ufeffText {k}\r\n" for k in range(64 * cores)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "x.gz").write_bytes(gzip.compress(b"packed"))
    files = read_text_dir(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= cores + 1        # four or more files a task before
    assert {r.path.rsplit("/", 1)[1]: r.text for r in files.collect()} == texts
    assert [r.text for r in read_text_dir(spark, str(tmp_path), glob="*.gz").collect()] == ["packed"]
    assert files.sparkSession is spark
