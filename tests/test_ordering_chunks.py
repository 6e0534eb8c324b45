from pyspark.sql import Row, Window, functions as F

from finch.operators.chunks import chunk_sentences, concat_pages, dense_chunk_ids
from finch.operators.ordering import dense_index


def test_dense_index_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("v")).repartition(7)
    got = dense_index(df, ["k"], num_partitions=6).collect()
    assert sorted((r.k, r.idx) for r in got) == [(i, i) for i in range(5000)]


def test_dense_chunk_ids(spark):
    docs = spark.createDataFrame([Row(doc_id=5, text="A. B. C."), Row(doc_id=2, text="D! E."), Row(doc_id=9, text="")])
    ch = dense_chunk_ids(docs, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.pos, r.seq_id) for r in ch) == [(2, 0, 0), (2, 1, 1), (5, 0, 2), (5, 1, 3), (5, 2, 4)]


def test_concat_pages_in_order_without_separator(spark):
    pages = spark.createDataFrame([Row(doc=1, page_no=1, text="b"), Row(doc=1, page_no=0, text="a"), Row(doc=1, page_no=2, text="c")])
    assert concat_pages(pages, "doc").first().text == "abc"


from hypothesis import given, settings, strategies as st  # noqa: E402

from finch.operators.chunks import chunk_pages, clean_pages, prefix_scan  # noqa: E402

PAGE_CHARS = st.lists(st.sampled_from(list("ab.!?'\")] #\n") + ["  ", "x."]), max_size=12).map("".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(PAGE_CHARS, max_size=5)), min_size=1, max_size=4))
def test_chunk_pages_equals_concatenate_then_split(spark, docs):
    rows = [Row(doc=d * 10 + k, page_no=i, text=t) for k, (d, ps) in enumerate(docs) for i, t in enumerate(ps)]
    if not rows:
        return
    pages = spark.createDataFrame(rows, "doc long, page_no int, text string")
    expect = chunk_sentences(concat_pages(clean_pages(pages), "doc"), "doc", "text")
    got = chunk_pages(pages, "doc")
    assert sorted(map(tuple, got.select("doc", "pos", "text").collect())) == \
        sorted(map(tuple, expect.select("doc", "pos", "text").collect()))


def test_chunk_pages_cross_page_cases(spark):
    pages = spark.createDataFrame([
        Row(doc=1, page_no=0, text="He said. It ended."), Row(doc=1, page_no=1, text="' Next one"),
        Row(doc=1, page_no=2, text="%%%"), Row(doc=1, page_no=3, text="\") then!"), Row(doc=1, page_no=4, text="\" Last"),
        Row(doc=2, page_no=0, text="' Starts new doc."),
    ])
    got = sorted(map(tuple, chunk_pages(pages, "doc", lowercase=False).collect()))
    assert got == [(1, 0, "He said."), (1, 1, "It ended.'"), (1, 2, "Next one\") then!\""), (1, 3, "Last"),
                   (2, 0, "' Starts new doc.")]


def test_prefix_scan_max_and_sum(spark):
    df = spark.createDataFrame([Row(g=i, v=(i if i % 3 == 0 else None), w=1) for i in range(50)])
    mx = {r.g: r.m for r in prefix_scan(df, "g", "v", "m", "max").collect()}
    sm = {r.g: r.s for r in prefix_scan(df, "g", "w", "s", "sum").collect()}
    assert mx[0] is None and mx[1] == 0 and mx[4] == 3 and mx[49] == 48
    assert all(sm[i] == i for i in range(50))


def test_plugin_splitter(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="Mr. Smith left. He came back.")])
    rule = [r.text for r in chunk_sentences(docs, "doc_id", "text").orderBy("pos").collect()]
    assert rule == ["Mr.", "Smith left.", "He came back."]

    def abbrev_aware(t):
        import re
        return re.split(r"(?<!Mr\.)(?<=[.!?])\s+", t)
    plug = [r.text for r in chunk_sentences(docs, "doc_id", "text", splitter=lambda: abbrev_aware).orderBy("pos").collect()]
    assert plug == ["Mr. Smith left.", "He came back."]


def test_configure_for_input(spark):
    from finch.session import configure_for_input
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert configure_for_input(spark, 100 << 40) == 819200        # 100 TB / 128 MB
        assert configure_for_input(spark, 1 << 20) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def _gathered(pages):
    """The same chunks by way of each document's whole text."""
    return sorted(map(tuple, chunk_sentences(concat_pages(clean_pages(pages), "doc"), "doc", "text").collect()))


def test_page_chunks_equal_those_of_the_joined_text(spark):
    pages = spark.createDataFrame([Row(doc=1, page_no=i, text=t) for i, t in enumerate(
        ["One. Two", "more. Three!", "' Four", "five."])] + [Row(doc=2, page_no=0, text="Solo.")])
    paged = sorted(map(tuple, chunk_pages(pages, "doc").collect()))
    assert paged == _gathered(pages) == [(1, 0, "one."), (1, 1, "twomore."), (1, 2, "three!'"), (1, 3, "fourfive."), (2, 0, "solo.")]


def test_hot_document_spreads_over_partitions(spark):
    # one document holds most pages: it must not land in one task
    words = ["alpha", "beta.", "gamma", "delta!", "'", "eps"]
    rows = [Row(doc=0, page_no=i, text=" ".join(words[(i + j) % 6] for j in range(7))) for i in range(1200)]
    rows += [Row(doc=d, page_no=0, text="small doc. end") for d in range(1, 40)]
    pages = spark.createDataFrame(rows, "doc long, page_no int, text string").repartition(8)
    assert sorted(map(tuple, chunk_pages(pages, "doc").collect())) == _gathered(pages)
    # the range-partitioned scan places the hot document's pages in several partitions
    from finch.operators.chunks import prefix_scan
    narrow = pages.select(F.struct("doc", "page_no").alias("k"), "doc", F.lit(1).alias("one"))
    parts = prefix_scan(narrow, "k", "one", "s").where("doc = 0").select(F.spark_partition_id()).distinct().count()
    assert parts > 1


def test_broadcast_is_bounded_in_bytes(spark):
    from finch.operators.ordering import broadcast_if_small, bytes_at_most
    wide = spark.createDataFrame([(1, "x" * 5000)], "k int, t string")
    assert bytes_at_most(wide, 6000) and not bytes_at_most(wide, 4000) and bytes_at_most(wide.limit(0), 1)
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hint(broadcast_if_small(wide, 6000)) and not hint(broadcast_if_small(wide, 4000))


def test_checkpoint_folder_is_asked_for_off_a_local_master():
    import pytest
    from finch.session import checkpoint_root

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Fake:
        def __init__(self, master, **conf):
            self.conf, self.sparkContext = Conf(conf), type("S", (), {"master": master})

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoint_root(Fake(master))
    assert checkpoint_root(Fake("yarn", **{"spark.checkpoint.dir": "hdfs:///c/"})) == "hdfs:///c"
    assert checkpoint_root(Fake("local[8]")).endswith("finch-checkpoints")
