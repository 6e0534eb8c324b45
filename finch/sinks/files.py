"""Sinks: CSV with header, text keyed by file, appended chunk tables."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row and no index column; values are written as they
    are (Spark's writer would otherwise trim surrounding spaces), quotes doubled."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def write_docs_as_text(df: DataFrame, path: str, key_cols: list[str], text_col: str = "text", name_col: str | None = None) -> str:
    """One text file per row (in a folder per key value), for readers that want
    files; tables of many documents belong in ``write_text_by_file``. With ``name_col``
    a file's name begins with that column's value. Returns the pattern of the folders that hold the files."""
    named = [name_col] if name_col else []
    return write_many_files(df.select(*key_cols, *named, text_col), path, key_cols, text_col, name_col=name_col, overwrite=True)


def write_many_files(df: DataFrame, path: str, key_cols: list[str], text_col: str, *, name_col: str | None = None, overwrite: bool = False) -> str:
    """Each row becomes a text file, in folders ``key=value`` as Spark names them; returns the
    pattern of the folders with files. Making a file costs the same however short it is, so rows
    are dealt evenly to all tasks unless they are so already. Where ``path`` is a mounted folder (``file:``) tasks make the files
    themselves: Spark's writer starts a process for each file there, and for its checksum file, to set the
    mode. In other stores Spark writes them, and each task moves its own files into place; ``name_col`` is then one folder more."""
    spark = df.sparkSession
    folder, taken = _mounted(spark, path, overwrite)
    if taken:
        raise ValueError(f"{path} exists")
    names = [name_col] if name_col else []
    with _shuffle_dropped(spark):
        dealt = df if _is_even(df) else df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not folder:
            keys = [*key_cols, *names]
            (dealt.select(*keys, text_col).write.option("mapreduce.fileoutputcommitter.algorithm.version", 2)
               .option("maxRecordsPerFile", 1).partitionBy(*keys).mode("overwrite" if overwrite else "errorifexists").text(path))
            return path + "/*" * len(keys)
        rows = dealt.select(*(F.col(c).cast("string") for c in [*key_cols, *names]), F.col(text_col).cast("binary"))
        rows.mapInArrow(_file_maker(folder, key_cols, name_col), "files long").collect()
    shutil.rmtree(f"{folder}/_temporary", ignore_errors=True)
    os.makedirs(folder, exist_ok=True)
    open(f"{folder}/_SUCCESS", "w").close()
    return path + "/*" * len(key_cols)


def _is_even(df: DataFrame) -> bool:
    """Has no task more than twice its share of the rows? Of a stored table only the counts are read."""
    most, rows = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return not rows or most * df.sparkSession.sparkContext.defaultParallelism <= 2 * rows


def _mounted(spark: SparkSession, path: str, overwrite: bool) -> tuple[str | None, bool]:
    """The plain path of a folder in a mounted file system (else None), emptied if it may be; does it exist still?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    uri = fs.makeQualified(at).toUri()
    if uri.getScheme() != "file":
        return None, False
    if overwrite:
        fs.delete(at, True)
    return uri.getPath().rstrip("/"), fs.exists(at)


@contextmanager
def _shuffle_dropped(spark: SparkSession):
    """What is run inside leaves no shuffle files: they would lie beside the files made of them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _file_maker(root: str, key_cols: list[str], name_col: str | None):
    """A ``mapInArrow`` function over (keys, name, text): a file for each row below ``root``. A task
    makes its files in a folder of its own and moves them when it has all. Their names follow from
    the rows it was dealt, in whatever order they came, so a task that runs again replaces them."""
    job = uuid.uuid4().hex[:12]
    odd = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")         # as Spark escapes them

    def part(col: str, value: str | None) -> str:
        escaped = [odd.sub(lambda m: f"%{ord(m[0]):02X}", x) for x in (col, value or "__HIVE_DEFAULT_PARTITION__")]
        return "=".join(escaped)

    def make(batches):
        task = TaskContext.get()
        number, own = task.partitionId(), f"{root}/_temporary/{task.taskAttemptId()}"
        made: dict[str, int] = {}       # files so far, by folder
        folders: dict[tuple, str] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for *keys, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    name = f"{part(name_col, keys.pop())}-" if name_col else ""
                    sub = folders.get(tuple(keys))
                    if sub is None:
                        sub = folders[tuple(keys)] = "/".join(map(part, key_cols, keys))
                        os.makedirs(f"{own}/{sub}", exist_ok=True)      # null and "" share a folder
                    k = 0 if name else made.get(sub, 0)
                    while True:
                        try:
                            file = open(f"{own}/{sub}/{name}part-{number:05d}-{job}.c{k:03d}.txt", "xb")
                            break
                        except FileExistsError:
                            k += 1
                    with file:
                        file.write((text or b"") + b"\n")
                    made[sub] = k + 1
        for sub in made:
            os.makedirs(f"{root}/{sub}", exist_ok=True)
            for name in os.listdir(f"{own}/{sub}"):
                os.replace(f"{own}/{sub}/{name}", f"{root}/{sub}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([len(made)], pa.int64())], names=["files"])

    return make


def write_text_by_file(df: DataFrame, path: str, file_col: str = "file", text_col: str = "text") -> None:
    """Texts keyed by file name, as a Parquet table (not a folder for each). A
    later write of the same name wins, so callers pass one row per file (see
    operators.links.file_name_dedup)."""
    df.select(file_col, text_col).write.mode("overwrite").parquet(path)


def text_file_name(col) -> F.Column:
    """The text file that a document file's text is saved under: ``.pdf`` at the
    end becomes ``.txt``, any other name gets ``.txt`` added."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.regexp_replace(c, r"\.pdf$", ""), F.lit(".txt"))


def write_ordered(df: DataFrame, path: str, order_col: str) -> None:
    """Rows in ``order_col`` order: ranges of it in successive files, sorted within."""
    df.repartitionByRange(order_col).sortWithinPartitions(order_col).write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str, key_cols: list[str] | None = None) -> None:
    """Append rows to a parquet table. With ``key_cols`` rows whose key is
    already stored are skipped (left anti-join against the stored keys), so a
    rerun adds nothing; without it a rerun duplicates rows, as the original."""
    if key_cols:
        stored = stored_keys(df.sparkSession, path, key_cols)
        if stored is not None:
            df = df.join(stored, key_cols, "left_anti")
    df.write.mode("append").parquet(path)


def stored_keys(spark, path: str, key_cols: list[str]) -> DataFrame | None:
    """The keys of a stored table; None before the first write."""
    try:
        return spark.read.parquet(path).select(*key_cols)
    except Exception as e:  # noqa: BLE001 - first write: nothing stored yet
        if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
            raise
        return None
