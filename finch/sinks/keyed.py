"""Keyed tables: upserts and deletes on hash-bucketed Parquet with a manifest.

``<path>/data/version=<n>/bucket=<b>`` holds the rows of a bucket as version n left
them; ``<path>/manifest/version=<n>`` is one Parquet file that names, for each bucket,
the version whose folder is current. An update rewrites only the buckets that it
touches, into folders of its own, and then writes the manifest. The manifest is one
file, moved into place as a whole by the job commit, so a reader sees the old version or
the new one; an update that dies before that leaves folders that no manifest names.
Versions are written once: a second writer of the same version fails.

Keys are hashed to a fixed number of buckets, so a bucket's share of the rows is even whatever
the keys, and the manifest has as many rows as there are buckets. A bucket may be large: it is
written by many tasks then, each of which sorts a bounded part of it. The rows of an update and
the stored rows of the buckets that it touches are shuffled once, together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.errors import AnalysisException

BUCKETS = 256                   # of a new table; choose about one per 128 MB to come
SLICE_BYTES = 16 << 20          # of stored Parquet; a larger bucket is dealt to several tasks
FEW_BUCKETS = 16                # a new table of at most so many is written by the tasks that make its rows
DELETED = "_deleted"            # rows of an update with true here go
DIGEST = "text_sha256"          # stored by tables of earlier versions of this code


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, int], int, list[str]] | None:
    """(version, version of each bucket, buckets, applied batch ids) of the last manifest."""
    try:
        log = spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    version = log.agg(F.max("version")).first()[0]
    rows = log.where(F.col("version") == version).collect()
    return version, {r["bucket"]: r["at"] for r in rows if r["at"] is not None}, rows[0]["buckets"], rows[0]["batches"]


def _folders(path: str, at: dict[int, int], wanted=None) -> list[str]:
    return [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(at.items()) if wanted is None or b in wanted]


def _read(spark: SparkSession, path: str, folders: list[str], schema) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{path}/data").schema(schema).parquet(*folders).select(*schema.fieldNames())


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows of a keyed table; None before its first version."""
    found = _current(spark, path)
    if found is None:
        return None
    schema = spark.read.parquet(f"{path}/schema").schema
    return _read(spark, path, _folders(path, found[1]), schema)


def bucket_of(key_cols: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key_cols), F.lit(buckets)).cast("int")


def apply_changes(changes: DataFrame, path: str, key_cols: list[str], *, buckets: int = BUCKETS,
                  batch: str | None = None, replaces: list[str] | None = None) -> bool:
    """Bring ``changes`` into the keyed table at ``path``; False if ``batch`` is in it already.

    A row replaces the one of its key; with ``_deleted`` true it only removes it. ``changes`` holds a
    key once. With ``replaces`` (some of the key columns) a change removes every
    stored row that agrees with it in these, so a shorter new group leaves no old rows; buckets
    are then chosen by them alone. The last thousand ``batch`` ids are remembered with the data they
    brought, in the same manifest, so a batch that is delivered again changes nothing.
    """
    return _apply(changes, path, key_cols, buckets, batch=batch, replaces=replaces)


def _bytes(spark: SparkSession, folders: list[str]) -> int:
    """Size of the Parquet files in ``folders``."""
    if not folders:
        return 0
    files = spark.read.parquet(*folders).select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.sum("file_size")).first()[0] or 0


def _apply(changes: DataFrame, path: str, key_cols: list[str], buckets: int, *, batch: str | None = None, replaces: list[str] | None = None,
           finish: Callable[[DataFrame], DataFrame] = lambda df: df, idle: bool = True) -> bool:
    """``apply_changes``; ``finish`` adds columns to the rows that come in, once a row. Without
    ``idle`` an update of no row makes no version, and the answer is False."""
    spark = changes.sparkSession
    found = _current(spark, path)
    version, at, buckets, batches = found or (0, {}, buckets, [])
    if batch is not None and batch in batches:
        return False
    by = replaces or key_cols
    gone = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in changes.columns else F.lit(False)
    plain = [c for c in changes.columns if c != DELETED]
    dealt = changes.withColumn("_gone", gone).withColumn("_bucket", bucket_of(by, buckets)).drop(DELETED)
    target = f"{path}/data/version={version + 1}"
    if found is None:
        # nothing is stored that a row could replace, so the rows go straight to their buckets;
        # where a task's share of a bucket would be a small file they are brought together first
        new = dealt.where(~F.col("_gone"))
        new = finish((new if buckets <= FEW_BUCKETS else new.hint("rebalance", "_bucket")).select(*plain))
        spark.createDataFrame([], new.schema).write.mode("overwrite").parquet(f"{path}/schema")
        new, touched = new.withColumn("_bucket", bucket_of(by, buckets)), set()
    else:
        staged = f"{path}/staged/version={version + 1}-{spark.sparkContext.applicationId}"
        dealt.write.mode("overwrite").option("compression", "zstd").parquet(staged)     # what is new is computed once
        dealt = spark.read.schema(dealt.schema).parquet(staged)
        touched = {r["_bucket"] for r in dealt.select("_bucket").distinct().collect()}      # at most ``buckets`` numbers
        if not touched and not idle:
            return False
        new = _merged(spark, path, _folders(path, at, touched), dealt, finish, plain, by, buckets, _bytes(spark, [staged]) // max(len(touched), 1))
    new.withColumnRenamed("_bucket", "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(target)
    filled = {r["bucket"] for r in spark.read.parquet(target).select("bucket").distinct().collect()} if not _is_empty(spark, target) else set()
    after = {b: v for b, v in at.items() if b not in touched} | {b: version + 1 for b in filled}
    _commit(spark, path, version + 1, after, buckets, (batches + [batch] if batch is not None else batches)[-1000:])
    return True


def _merged(spark: SparkSession, path: str, folders: list[str], dealt: DataFrame, finish: Callable[[DataFrame], DataFrame],
            plain: list[str], by: list[str], buckets: int, incoming: int) -> DataFrame:
    """The rows of the touched buckets after the update, with their ``_bucket``: a stored row stays if
    no change agrees with it in ``by``. All rows of such a group meet in one slice of one bucket."""
    old = _read(spark, path, folders, spark.read.parquet(f"{path}/schema").schema)
    fresh = finish(dealt.where(~F.col("_gone")).select(*plain))
    keys = [F.col(f"`{c}`") for c in by]
    rows = old.withColumn("_change", F.lit(0)).unionByName(fresh.withColumn("_change", F.lit(1)))
    rows = rows.unionByName(dealt.where("_gone").select(*keys).withColumn("_change", F.lit(2)), allowMissingColumns=True)
    slices = 1 + (_bytes(spark, folders) // max(len(folders), 1) + incoming) // SLICE_BYTES
    # the numbers are worked out again behind the shuffle, so they do not move
    part = {"_bucket": bucket_of(by, buckets)}
    if slices > 1:
        part["_slice"] = F.floor(F.pmod(F.xxhash64(*by), F.lit(buckets * slices)) / buckets).cast("int")
        rows = rows.repartition(2 * buckets * slices, *part.values())
    else:
        rows = rows.repartition(*part.values())
    rows = rows.withColumns(part)
    last = F.max("_change").over(Window.partitionBy(*part, *keys))
    return rows.withColumn("_last", last).where("_change = 1 OR _last = 0").drop("_change", "_last", "_slice")


def _is_empty(spark: SparkSession, target: str) -> bool:
    """Did the update leave no row in the buckets it touched (its folder then has no schema)?"""
    try:
        return spark.read.parquet(target).isEmpty()
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        return True


def _commit(spark: SparkSession, path: str, version: int, at: dict[int, int], buckets: int, batches: list[str]) -> None:
    """Write the manifest: the moment at which the update holds."""
    rows = [(b, v, buckets, batches) for b, v in sorted(at.items())] or [(None, None, buckets, batches)]
    log = spark.createDataFrame(rows, "bucket int, at int, buckets int, batches array<string>")
    log.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")


def embed_upsert(chunks: DataFrame, path: str, key_cols: list[str], text_col: str, embed: Callable[[DataFrame], DataFrame],
                 *, buckets: int = BUCKETS, complete: bool = True) -> bool:
    """K6 as an update: afterwards every row of ``chunks`` is stored with its embedding.

    Only new rows and rows whose text differs from the stored one are embedded. With
    ``complete`` rows that are stored but no longer in ``chunks`` go. ``embed`` adds its columns to (keys, text).
    False if nothing had to change.
    """
    spark = chunks.sparkSession
    rows = chunks.select(*key_cols, F.col(text_col).alias("text"))
    found = _current(spark, path)
    if found is None:
        return _apply(rows, path, key_cols, buckets, finish=embed)
    old = read_keyed(spark, path)
    known = old.select(*key_cols, _likeness("text").alias("_old"))
    parts = 1 + _bytes(spark, _folders(path, found[1])) // SLICE_BYTES
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rows, known = rows.repartition(parts, *key_cols), known.repartition(parts, *key_cols)
    # one join tells the new, the changed and the vanished rows
    both = rows.withColumn("_now", F.lit(True)).join(known, key_cols, "full" if complete else "left")
    gone = F.col("_now").isNull()
    update = both.where(gone | F.col("_old").isNull() | (F.col("_old") != _likeness("text"))).select(*key_cols, "text", gone.alias(DELETED))
    if DIGEST in old.columns:
        return _apply(update, path, key_cols, buckets, idle=False,
                      finish=lambda df: embed(df.withColumn(DIGEST, F.sha2(F.coalesce("text", F.lit("")), 256))))
    return _apply(update, path, key_cols, buckets, finish=embed, idle=False)


def _likeness(text_col: str) -> Column:
    """Equal for equal texts (null: empty): a short text itself, the 32 bytes of its SHA-256 for others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.when(F.octet_length(text) < 32, text.cast("binary")).otherwise(F.unhex(F.sha2(text, 256)))
