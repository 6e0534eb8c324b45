from pyspark.sql import Row

from finch.session import scratch_path
from finch.sinks.files import write_docs_as_text
from finch.streaming.ingest import ingest_text_stream


def test_stream_ingest_chunks_new_files_once(spark):
    src, sink = scratch_path(spark, "t-src"), scratch_path(spark, "t-sink")
    ckpt = scratch_path(spark, "t-ckpt")
    docs = spark.createDataFrame([Row(doc_id=1, text="A b. C d!"), Row(doc_id=2, text="E.")])
    write_docs_as_text(docs, src, ["doc_id"])
    ingest_text_stream(spark, f"{src}/*", sink, doc_id_pattern="doc_id=(\\d+)", checkpoint=ckpt)
    ingest_text_stream(spark, f"{src}/*", sink, doc_id_pattern="doc_id=(\\d+)", checkpoint=ckpt)  # nothing new
    got = sorted((r.doc, r.pos, r.text) for r in spark.read.parquet(sink).collect())
    assert got == [(1, 0, "A b."), (1, 1, "C d!"), (2, 0, "E.")]


def test_stream_ingest_picks_up_new_files_only(spark):
    src, sink = scratch_path(spark, "t-src2"), scratch_path(spark, "t-sink2")
    ckpt = scratch_path(spark, "t-ckpt2")
    write_docs_as_text(spark.createDataFrame([Row(doc_id=1, text="One. Two.")]), f"{src}/a", ["doc_id"])
    ingest_text_stream(spark, f"{src}/*/*", sink, doc_id_pattern="doc_id=(\\d+)", checkpoint=ckpt)
    write_docs_as_text(spark.createDataFrame([Row(doc_id=2, text="Three.")]), f"{src}/b", ["doc_id"])
    ingest_text_stream(spark, f"{src}/*/*", sink, doc_id_pattern="doc_id=(\\d+)", checkpoint=ckpt)
    got = sorted((r.doc, r.pos, r.text) for r in spark.read.parquet(sink).collect())
    assert got == [(1, 0, "One."), (1, 1, "Two."), (2, 0, "Three.")]


CHILD = """
import sys
sys.path.insert(0, {repo!r})
from finch.session import get_session
from finch.streaming.ingest import ingest_text_stream
spark = get_session("local[2]", shuffle_partitions=2, extra={{"spark.checkpoint.dir": {root!r}}})
ingest_text_stream(spark, {src!r}, {sink!r})
"""


def test_default_checkpoint_goes_on_in_another_process(spark, tmp_path):
    import os
    import subprocess
    import sys
    repo, src, sink = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "src", str(tmp_path / "sink")
    src.mkdir()
    for k, text in enumerate(["One. Two.", "Three."]):
        (src / f"{k}.txt").write_text(text)
        code = CHILD.format(repo=repo, root=str(tmp_path / "ckpt"), src=str(src), sink=sink)
        run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-1500:]
    assert sorted(r.text for r in spark.read.parquet(sink).collect()) == ["One.", "Three.", "Two."]


def test_rewritten_file_and_replayed_batch(spark, tmp_path):
    from finch.sinks.keyed import read_keyed
    from finch.streaming.ingest import chunk_upsert, ingest_text_upsert
    src, sink = tmp_path / "src", str(tmp_path / "table")
    kw = dict(doc_id_pattern=r"doc-(\d+)", checkpoint=str(tmp_path / "ckpt"), buckets=4)

    def rows():
        return sorted((r.doc, r.pos, r.text) for r in read_keyed(spark, sink).collect())
    src.mkdir()
    (src / "doc-1_a.txt").write_text("One. Two. Three.")
    (src / "doc-2_a.txt").write_text("Other.")
    ingest_text_upsert(spark, str(src), sink, **kw)
    assert rows() == [(1, 0, "One."), (1, 1, "Two."), (1, 2, "Three."), (2, 0, "Other.")]
    (src / "doc-1_b.txt").write_text("Uno.")
    (src / "doc-2_b.txt").write_text("  ")
    ingest_text_upsert(spark, str(src), sink, **kw)
    assert rows() == [(1, 0, "Uno.")]
    upsert = chunk_upsert(sink, "stream", buckets=4)
    batch = spark.createDataFrame([(7, "2024-01-01", "p", "First. Second.")], "doc long, written string, path string, text string")
    upsert(batch, 5)
    after = rows()
    upsert(batch.withColumn("text", batch["text"]), 5)
    upsert(batch, 5)
    assert rows() == after == [(1, 0, "Uno."), (7, 0, "First."), (7, 1, "Second.")]


def test_last_written_file_of_a_batch_counts(spark, tmp_path):
    from finch.sinks.keyed import read_keyed
    from finch.streaming.ingest import chunk_upsert
    sink = str(tmp_path / "table")
    rows = [(1, f"2024-01-0{k}", f"p{k}", f"Day {k}. Night {k}.") for k in (2, 3, 1)]
    chunk_upsert(sink, "s", buckets=2)(spark.createDataFrame(rows, "doc long, written string, path string, text string"), 0)
    assert sorted((r.pos, r.text) for r in read_keyed(spark, sink).collect()) == [(0, "Day 3."), (1, "Night 3.")]


def test_files_are_made_by_all_tasks(spark):
    """A table in one partition becomes files by several tasks: a file costs the same however short."""
    src = scratch_path(spark, "t-many")
    write_docs_as_text(spark.range(40).selectExpr("id AS doc_id", "concat('Text ', id) AS text").coalesce(1), src, ["doc_id"])
    files = spark.read.text(src).inputFiles()
    assert len(files) == 40 and len({f.rsplit("/", 1)[1].split("-")[1] for f in files}) > 2
    assert {(r.doc_id, r.value) for r in spark.read.text(src).collect()} == {(k, f"Text {k}") for k in range(40)}


def test_documents_of_a_folder_are_files_named_by_their_ids(spark):
    """No folder and no checksum file for each document; one row is one file, also of a repeated document."""
    import os
    src, sink = scratch_path(spark, "t-named"), scratch_path(spark, "t-named-sink")
    docs = [(1, "en", "One. Two."), (2, "en", "Three."), (2, "en", "Three."), (3, "a/b=%", "Four.\nFive."), (4, None, None)]
    folders = write_docs_as_text(spark.createDataFrame(docs, "doc_id long, lang string, text string"), src, ["lang"], name_col="doc_id")
    top = src.removeprefix("file://")
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    assert sorted(os.listdir(top)) == sorted(["_SUCCESS", *(names.getPartitionPathString("lang", x) for x in ("en", "a/b=%", None))])
    assert sorted(f.split("-")[0] for f in os.listdir(f"{top}/lang=en")) == ["doc_id=1", "doc_id=2", "doc_id=2"]
    ingest_text_stream(spark, folders, sink, doc_id_pattern="doc_id=(\\d+)", checkpoint=scratch_path(spark, "t-named-ckpt"), max_files_per_trigger=2)
    assert sorted((r.doc, r.pos, r.text) for r in spark.read.parquet(sink).collect()) == \
        [(1, 0, "One."), (1, 1, "Two."), (2, 0, "Three."), (2, 0, "Three."), (3, 0, "Four."), (3, 1, "Five.")]


def test_documents_in_a_store_that_only_spark_reaches(spark, tmp_path):
    """The same rows through Spark's writer, one folder more; a second write takes the place of the first."""
    spark.conf.set("fs.viewfs.mounttable.t-store.link./out", f"file://{tmp_path}")
    try:
        for docs in ([(9, "en", "Old.")], [(1, "en", "One. Two."), (2, "de", "Drei.")]):
            folders = write_docs_as_text(spark.createDataFrame(docs, "doc_id long, lang string, text string"), "viewfs://t-store/out/src", ["lang"], name_col="doc_id")
        assert folders == "viewfs://t-store/out/src/*/*"
        sink = str(tmp_path / "sink")
        ingest_text_stream(spark, f"{tmp_path}/src/*/*", sink, doc_id_pattern="doc_id=(\\d+)", checkpoint=str(tmp_path / "ckpt"))
        assert sorted((r.doc, r.pos, r.text) for r in spark.read.parquet(sink).collect()) == [(1, 0, "One."), (1, 1, "Two."), (2, 0, "Drei.")]
    finally:
        spark.conf.unset("fs.viewfs.mounttable.t-store.link./out")


def test_a_batch_of_many_files_is_few_tasks(spark, tmp_path):
    src, tasks = tmp_path / "src", []
    src.mkdir()
    for k in range(300):
        (src / f"{k}.txt").write_text(f"Text {k}.")
    q = ingest_text_stream(spark, str(src), str(tmp_path / "sink"), checkpoint=str(tmp_path / "ckpt"))
    tracker = spark.sparkContext.statusTracker()
    for job in tracker.getJobIdsForGroup(str(q.runId)):
        tasks += [tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(job).stageIds]
    assert tasks and sum(tasks) <= 6 * spark.sparkContext.defaultParallelism       # 300 to list them alone before
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 300


def test_rows_that_lie_evenly_are_not_shuffled(spark):
    src = scratch_path(spark, "t-even")
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(0, 4 * cores, 1, 2 * cores).selectExpr("id AS doc_id", "spark_partition_id() AS part", "'Text' AS text")
    write_docs_as_text(docs, src, ["part"], name_col="doc_id")
    files = spark.read.text(f"{src}/*").inputFiles()
    assert len(files) == 4 * cores
    for f in files:
        folder, name = f.rsplit("/", 2)[1:]
        assert int(folder.split("=")[1]) == int(name.split("-")[2])
