"""File sources: text directories, transaction CSVs, sitemap XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import for_many_files

TXN_SCHEMA = T.StructType([
    T.StructField("Date", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Amount", T.StringType()),
])

SITEMAP_URL_SCHEMA = T.StructType([
    T.StructField("loc", T.StringType()),
    T.StructField("changefreq", T.StringType()),
    T.StructField("priority", T.StringType()),
])


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def whole_files(reader, path: str, glob: str, path_col: F.Column) -> DataFrame:
    """Whole files as (path, text) rows of a reader (of a table or a stream). Files whose names end in ``.txt``
    are never compressed, so their bytes are taken as they are: the text reader, which unpacks
    others, copies all Hadoop settings for each file, and that takes longer than to read a short one."""
    reader = reader.option("pathGlobFilter", glob)
    if glob.endswith(".txt"):
        files, text = reader.format("binaryFile").schema(BINARY_FILE_SCHEMA).load(path), F.col("content").cast("string")
    else:
        files, text = reader.text(path, wholetext=True), F.col("value")
    return files.select(path_col.alias("path"), text.alias("text"))


def read_text_dir(spark: SparkSession, path: str, recursive: bool = True, glob: str = "*.txt") -> DataFrame:
    """One row per text file: (path, text). Whole files, so one document is
    one row; files are split across tasks, never concatenated. A task reads many short ones."""
    files = whole_files(for_many_files(spark).read.option("recursiveFileLookup", recursive), path, glob, F.col("_metadata.file_path"))
    none = spark.range(0).where(F.lit(False)).select(F.col("id").cast("string").alias("path"), F.col("id").cast("string").alias("text"))
    return none.union(files)        # a table of the caller's session; the files are dealt by the other's settings


def read_transactions_csv(spark: SparkSession, path: str, schema: T.StructType = TXN_SCHEMA,
                          *, multi_line: bool) -> DataFrame:
    """Transactions CSV, columns found by their header names: first those of
    ``schema`` (cast to its types; Amount is text, so it prints as stored), then
    any others as text, in file order. A column that the header lacks raises.

    Fields are quoted as in RFC 4180 (a quote inside is doubled). The caller says
    whether fields may hold line breaks: ``multi_line=True`` reads every file in one
    task, as only its start tells where a record begins; ``False`` lets Spark split large files.
    """
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
                .option("multiLine", multi_line).csv(path))
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"CSV without column(s) {', '.join(missing)}: {', '.join(raw.columns)}")
    named = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]
    return raw.select(*named, *[F.col(f"`{c}`") for c in raw.columns if c not in schema.names])


def read_sitemap(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Sitemap ``<url>`` entries in document order: (file, pos, loc, changefreq,
    priority, domain, sitemap_name); missing fields become "".

    Each sitemap file is one row (the protocol caps a file at 50,000 URLs and
    50 MB), its ``<url>`` blocks are exploded with their position and parsed
    with ``from_xml``; many sitemap files spread over many tasks.
    """
    from ..functions.urls import url_authority
    raw = (spark.read.text(path, wholetext=True)
                .select(F.col("_metadata.file_path").alias("file"), "value"))
    blocks = raw.select("file", F.posexplode(F.regexp_extract_all("value", F.lit("(?s)<url>.*?</url>"), 0))
                        .alias("pos", "block"))
    parsed = blocks.select("file", "pos", F.from_xml("block", SITEMAP_URL_SCHEMA).alias("u"))
    return parsed.select(
        "file", "pos",
        F.coalesce(F.col("u.loc"), F.lit("")).alias("loc"),
        F.coalesce(F.col("u.changefreq"), F.lit("")).alias("changefreq"),
        F.coalesce(F.col("u.priority"), F.lit("")).alias("priority"),
        F.coalesce(url_authority(F.col("u.loc")), F.lit("")).alias("domain"),
        F.lit(name or "").alias("sitemap_name"),
    )


def read_page_files(spark: SparkSession, path: str, glob: str = "*.txt", by_folder: bool = False) -> DataFrame:
    """Pages of paginated text files, a form feed behind each page -> (path, page_no, text).

    The reader cuts at form feeds, so a large file is read in ranges by several
    tasks, over any file system that Spark reads. A page's number is its place in its range
    plus the pages of the file's earlier ranges: only the count of each range (a row
    per split) is added up and sent to the tasks, and no text is moved. An empty file has no
    pages. With ``by_folder`` the files of a folder are the volumes of one book, in order
    of their names: numbers run on from one to the next (a name that is
    longer comes later, as part files are numbered).
    """
    raw = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("lineSep", "\f").text(path)
                .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("id"), F.col("value").alias("text")))
    ranges = raw.groupBy("path", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    book = F.regexp_extract("path", "^(.*)/", 1) if by_folder else F.col("path")
    before = Window.partitionBy("book").orderBy(F.length("path"), "path", "start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("book", book).select("path", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(F.broadcast(ranges), ["path", "start"]).select("path", (F.col("id") + F.col("shift")).cast("int").alias("page_no"), "text")
