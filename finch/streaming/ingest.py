"""Incremental corpus ingest with Structured Streaming.

New text files in a folder are read as whole documents, split into sentence
chunks and appended to a parquet chunk table. The stream's checkpoint lives
below the shared checkpoint folder, so a restarted job (or a lost executor)
neither skips nor repeats files; ``availableNow`` processes what has arrived
and stops, which suits a scheduled indexing job.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunks import chunk_sentences
from ..session import checkpoint_root, for_many_files
from ..sinks.keyed import BUCKETS, apply_changes
from ..sources.files import whole_files


def _checkpoint(spark: SparkSession, source: str, sink: str) -> str:
    return f"{checkpoint_root(spark)}/finch-streams/{hashlib.sha256(f'{source}\n{sink}'.encode()).hexdigest()[:32]}"


def ingest_text_stream(spark: SparkSession, source: str, sink: str, *, doc_id_pattern: str | None = None,
                       clean: bool = False, checkpoint: str | None = None, glob: str = "*.txt",
                       max_files_per_trigger: int = 1000, wait: bool = True, compression: str | None = None) -> StreamingQuery:
    """Start (and by default finish) the ingest stream.

    ``doc_id_pattern``: a regex with one group that turns the file path into a
    numeric document id; without it the path is the document key. The default
    checkpoint folder is named by a digest of source and sink, so that a new
    process goes on where the last one stopped. The stream runs in a session of its own, in
    which the log of its files is written anew every 1000 batches (else every 10: quadratic in files).
    ``compression``: the codec of the chunk table, if not the session's.
    """
    own = for_many_files(spark)
    if compression:
        own.conf.set("spark.sql.parquet.compression.codec", compression)
    own.conf.set("spark.sql.streaming.fileSource.log.compactInterval", "1000")
    docs = whole_files(own.readStream.option("maxFilesPerTrigger", max_files_per_trigger), source, glob, F.input_file_name())
    if doc_id_pattern:
        docs = docs.withColumn("doc", F.regexp_extract("path", doc_id_pattern, 1).cast("long"))
    else:
        docs = docs.withColumnRenamed("path", "doc")
    chunks = chunk_sentences(docs.select("doc", "text"), "doc", "text", clean=clean)
    ckpt = checkpoint or _checkpoint(spark, source, sink)
    q = (chunks.writeStream.format("parquet").outputMode("append")
               .option("path", sink).option("checkpointLocation", ckpt)
               .trigger(availableNow=True).start())
    if wait:
        q.awaitTermination()
    return q


def chunk_upsert(path: str, name: str, clean: bool = False, buckets: int = BUCKETS):
    """A ``foreachBatch`` function that brings a batch of files (doc, written, path,
    text) into the keyed chunk table at ``path``.

    The table's manifest takes up ``name`` and the batch number together with the
    chunks, so a batch that Spark delivers again changes nothing. A document's chunks replace all that
    an earlier file of the same document left; of several files of it in one batch the last written counts.
    """
    def upsert(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("doc").agg(F.max(F.struct("written", "path")).alias("last"))
        newest = newest.select(F.col("doc").alias("d"), "last.*").withColumnRenamed("path", "p")
        files = batch.join(newest.select("d", "p"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("path") == F.col("p")), "left_semi")
        chunks = chunk_sentences(files.select("doc", "text"), "doc", "text", clean=clean)
        # a file without a sentence still empties its document
        bare = files.select("doc").withColumn("pos", F.lit(-1)).withColumn("_deleted", F.lit(True))
        apply_changes(chunks.withColumn("_deleted", F.lit(False)).unionByName(bare, allowMissingColumns=True), path, ["doc", "pos"],
                      buckets=buckets, batch=f"{name}:{number}", replaces=["doc"])
    return upsert


def ingest_text_upsert(spark: SparkSession, source: str, path: str, *, doc_id_pattern: str | None = None, clean: bool = False,
                       checkpoint: str | None = None, glob: str = "*.txt", max_files_per_trigger: int = 1000,
                       buckets: int = BUCKETS, wait: bool = True) -> StreamingQuery:
    """Like ``ingest_text_stream``, into a keyed table, exactly once: a replayed batch
    is known by its number, and a later file of a document replaces its chunks."""
    stream = (spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files_per_trigger)
                   .text(source, wholetext=True))
    files = stream.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written"), F.col("value").alias("text"))
    doc = F.regexp_extract("path", doc_id_pattern, 1).cast("long") if doc_id_pattern else F.col("path")
    ckpt = checkpoint or _checkpoint(spark, source, path)
    name = hashlib.sha256(ckpt.encode()).hexdigest()[:16]
    q = (files.withColumn("doc", doc).writeStream.foreachBatch(chunk_upsert(path, name, clean, buckets))
              .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    if wait:
        q.awaitTermination()
    return q
