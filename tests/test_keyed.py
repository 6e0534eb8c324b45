import pytest
from pyspark.sql import functions as F

from finch.operators.retrieval import embed_buckets
from finch.session import scratch_path
from finch.sinks import keyed

SCHEMA = "doc long, pos int, text string"


def chunks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def embed(df):
    return embed_buckets(df, "text")


def stored(spark, path):
    return {(r.doc, r.pos): (r.text, tuple(r.buckets)) for r in keyed.read_keyed(spark, path).collect()}


def wanted(spark, rows):
    return {(r.doc, r.pos): (r.text, tuple(r.buckets)) for r in embed(chunks(spark, rows)).collect()}


@pytest.fixture
def path(spark):
    return scratch_path(spark, "keyed")


def test_changed_new_and_deleted_texts(spark, path):
    first = [(d, p, f"text {d} {p}") for d in range(6) for p in range(4)]
    assert keyed.read_keyed(spark, path) is None
    assert keyed.embed_upsert(chunks(spark, first), path, ["doc", "pos"], "text", embed, buckets=8)
    assert stored(spark, path) == wanted(spark, first)
    second = [(d, p, t + (" changed" if (d, p) == (2, 1) else "")) for d, p, t in first if d != 4] + [(9, 0, "new text")]
    assert keyed.embed_upsert(chunks(spark, second), path, ["doc", "pos"], "text", embed)
    assert stored(spark, path) == wanted(spark, second)
    assert not keyed.embed_upsert(chunks(spark, second), path, ["doc", "pos"], "text", embed)


def test_only_changed_texts_are_embedded(spark, path):
    first = [(d, 0, f"text {d}") for d in range(20)]
    seen = spark.sparkContext.accumulator(0)

    def counting(df):
        @F.pandas_udf("string")
        def look(s):
            seen.add(len(s))
            return s
        return embed(df.withColumn("text", look("text")))
    keyed.embed_upsert(chunks(spark, first), path, ["doc", "pos"], "text", counting, buckets=4)
    before = seen.value
    keyed.embed_upsert(chunks(spark, first[:-1] + [(19, 0, "other")]), path, ["doc", "pos"], "text", counting)
    assert before == 20 and 1 <= seen.value - before <= 2      # the check for any change may look at the row once more


def test_untouched_buckets_keep_their_files(spark, path):
    first = [(d, 0, f"text {d}") for d in range(60)]
    keyed.embed_upsert(chunks(spark, first), path, ["doc", "pos"], "text", embed, buckets=16)
    keyed.embed_upsert(chunks(spark, [(0, 0, "other")] + first[1:]), path, ["doc", "pos"], "text", embed)
    version, at, buckets, _ = keyed._current(spark, path)
    assert (version, buckets) == (2, 16) and sum(v == 2 for v in at.values()) == 1


def test_crash_between_write_and_manifest_leaves_the_old_version(spark, path, monkeypatch):
    first = [(1, 0, "one"), (2, 0, "two")]
    second = [(1, 0, "one changed"), (3, 0, "three")]
    keyed.embed_upsert(chunks(spark, first), path, ["doc", "pos"], "text", embed, buckets=4)

    def killed(*_):
        raise RuntimeError("killed")
    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", killed)
        with pytest.raises(RuntimeError):
            keyed.embed_upsert(chunks(spark, second), path, ["doc", "pos"], "text", embed)
    assert stored(spark, path) == wanted(spark, first)
    assert keyed.embed_upsert(chunks(spark, second), path, ["doc", "pos"], "text", embed)
    assert stored(spark, path) == wanted(spark, second)


def test_a_version_is_written_once(spark, path):
    keyed.apply_changes(chunks(spark, [(1, 0, "a")]), path, ["doc", "pos"], buckets=2)
    with pytest.raises(Exception, match="(?i)exists"):
        keyed._commit(spark, path, 1, {}, 2, [])


def test_batches_and_replaced_groups(spark, path):
    assert keyed.apply_changes(chunks(spark, [(1, p, f"v1 {p}") for p in range(5)] + [(None, 0, "null key")]), path, ["doc", "pos"], buckets=4, batch="b1", replaces=["doc"])
    assert not keyed.apply_changes(chunks(spark, [(1, 0, "again")]), path, ["doc", "pos"], batch="b1", replaces=["doc"])
    assert keyed.apply_changes(chunks(spark, [(1, 0, "v2"), (2, 0, "x")]), path, ["doc", "pos"], batch="b2", replaces=["doc"])
    assert sorted((r.doc or 0, r.pos, r.text) for r in keyed.read_keyed(spark, path).collect()) == [(0, 0, "null key"), (1, 0, "v2"), (2, 0, "x")]


def test_deleting_everything(spark, path):
    keyed.apply_changes(chunks(spark, [(1, 0, "a"), (2, 0, "b")]), path, ["doc", "pos"], buckets=3)
    keyed.apply_changes(chunks(spark, [(1, 0, "a"), (2, 0, "b")]).withColumn("_deleted", F.lit(True)), path, ["doc", "pos"])
    assert keyed.read_keyed(spark, path).collect() == []
    keyed.apply_changes(chunks(spark, [(3, 0, "c")]), path, ["doc", "pos"])
    assert [r.doc for r in keyed.read_keyed(spark, path).collect()] == [3]


def test_an_update_reads_its_rows_once(spark, path):
    """Changes are found by one join; neither they nor the vanished rows make the chunks anew."""
    first = [(d, p, f"text {d} {p}") for d in range(10) for p in range(4)]
    second = [(d, p, t + (" changed" if d == 2 else "")) for d, p, t in first if d != 4] + [(9, 9, "new text")]
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        @F.pandas_udf("string")
        def look(s):
            seen.add(len(s))
            return s
        return chunks(spark, rows).withColumn("text", look("text"))
    keyed.embed_upsert(counted(first), path, ["doc", "pos"], "text", embed, buckets=4)
    before = seen.value
    assert keyed.embed_upsert(counted(second), path, ["doc", "pos"], "text", embed)
    assert (before, seen.value - before) == (len(first), len(second))
    assert stored(spark, path) == wanted(spark, second)


def test_a_first_version_is_not_staged_and_holds_no_digest(spark, path):
    keyed.embed_upsert(chunks(spark, [(1, 0, "one"), (2, 0, None)]), path, ["doc", "pos"], "text", embed, buckets=2)
    assert keyed.read_keyed(spark, path).columns == ["doc", "pos", "text", "buckets"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}/staged/*")
    assert not keyed.embed_upsert(chunks(spark, [(1, 0, "one"), (2, 0, "")]), path, ["doc", "pos"], "text", embed)


def test_a_large_bucket_is_merged_by_several_tasks(spark, path, monkeypatch):
    """Repeated and null keys included: a group's rows meet in one slice."""
    monkeypatch.setattr(keyed, "SLICE_BYTES", 2000)
    first = [(d, p, f"text {d} {p}" * 3) for d in range(300) for p in range(4)] + [(None, 0, "null"), (7, 0, "again")]
    keyed.apply_changes(chunks(spark, first), path, ["doc", "pos"], buckets=2)
    change = chunks(spark, [(d, 1, f"v2 {d}") for d in range(0, 300, 3)] + [(None, 0, "null v2"), (7, 0, "a"), (7, 0, "b")]).withColumn("_deleted", F.lit(False))
    keyed.apply_changes(change.union(chunks(spark, [(5, 2, "")]).withColumn("_deleted", F.lit(True))), path, ["doc", "pos"])
    want = [r for r in first if not (r[1] == 1 and r[0] % 3 == 0) and r[:2] not in ((None, 0), (7, 0), (5, 2))]
    want += [(d, 1, f"v2 {d}") for d in range(0, 300, 3)] + [(None, 0, "null v2"), (7, 0, "a"), (7, 0, "b")]
    assert sorted(map(str, keyed.read_keyed(spark, path).collect())) == sorted(f"Row(doc={d}, pos={p}, text={t!r})" for d, p, t in want)
    files = spark.read.parquet(f"{path}/data/version=2").selectExpr("bucket", "_metadata.file_path AS f").distinct()
    assert files.groupBy("bucket").count().agg(F.min("count")).first()[0] >= 3


def test_stored_rows_are_shuffled_once(spark, path):
    first = chunks(spark, [(d, 0, f"text {d}") for d in range(20)])
    keyed.apply_changes(first, path, ["doc", "pos"], buckets=2)
    schema = keyed.read_keyed(spark, path).schema
    dealt = first.withColumn("_gone", F.lit(False)).withColumn("_bucket", keyed.bucket_of(["doc", "pos"], 2))
    merged = keyed._merged(spark, path, keyed._folders(path, keyed._current(spark, path)[1]), dealt, lambda df: df, schema.fieldNames(), ["doc", "pos"], 2, 0)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 1
    assert "Join" not in plan


def test_tables_that_hold_digests_go_on(spark, path):
    """Tables of earlier versions store the texts' digests."""
    rows = [(1, 0, "one"), (2, 0, "two")]
    keyed.apply_changes(embed(chunks(spark, rows).withColumn("text_sha256", F.sha2("text", 256))), path, ["doc", "pos"], buckets=2)
    assert not keyed.embed_upsert(chunks(spark, rows), path, ["doc", "pos"], "text", embed)
    assert keyed.embed_upsert(chunks(spark, [(1, 0, "one"), (2, 0, "other")]), path, ["doc", "pos"], "text", embed)
    assert stored(spark, path) == wanted(spark, [(1, 0, "one"), (2, 0, "other")])
    assert keyed.read_keyed(spark, path).where("text_sha256 <> sha2(text, 256) OR text_sha256 IS NULL").isEmpty()
