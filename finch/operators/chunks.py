"""Document cleaning, sentence chunks, chunk ids and counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import ensure_checkpoint_dir, scratch_path

from ..functions.text import clean_pdf_text, pages_of, sentence_count, sentence_split


def split_pages(docs: DataFrame, id_col: str, text_col: str, page_chars: int = 2000) -> DataFrame:
    """Fixed-size pages of each document -> (id, page_no, text)."""
    return docs.select(F.col(id_col), F.posexplode(pages_of(text_col, page_chars)).alias("page_no", "text"))


def clean_pages(pages: DataFrame, text_col: str = "text", lowercase: bool = True) -> DataFrame:
    return pages.withColumn(text_col, clean_pdf_text(text_col, lowercase))


def concat_pages(pages: DataFrame, doc_col: str, page_col: str = "page_no",
                 text_col: str = "text", sep: str = "") -> DataFrame:
    """Join a document's pages in page order (no separator by default, so words
    at page ends fuse as in the original). One group is one document."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col(text_col).alias("t"))))
    return pages.groupBy(doc_col).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), sep).alias(text_col))


def split_with(factory: Callable[[], Callable[[str], list[str]]]):
    """Plug-in sentence splitter (e.g. a Punkt model) as an Arrow-batched pandas
    UDF: str -> array<string>. ``factory()`` builds the splitter once per task, inside the worker."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _split(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        splitter = factory()
        for texts in chunks:
            yield pd.Series([[s.strip() for s in splitter(t) if s.strip()] if t is not None else None for t in texts], dtype=object)
    return _split


def chunk_sentences(docs: DataFrame, doc_col: str, text_col: str, clean: bool = False,
                    lowercase: bool = True, splitter: Callable[[], Callable[[str], list[str]]] | None = None) -> DataFrame:
    """Sentence chunks -> (doc, pos, text), keyed by (doc, pos). Text files are chunked as
    they are; page text from PDFs is cleaned first (``clean=True``). The rule
    splitter runs JVM-side; ``splitter`` plugs in any Python splitter by its factory."""
    text = clean_pdf_text(text_col, lowercase) if clean else F.col(text_col)
    parts = split_with(splitter)(text) if splitter else sentence_split(text)
    return docs.select(F.col(doc_col), F.posexplode(parts).alias("pos", "text"))


def dense_chunk_ids(docs: DataFrame, doc_col: str, text_col: str, out_col: str = "seq_id") -> DataFrame:
    """Sequential ids from 0 over all sentence chunks in (doc, pos) order ->
    (doc, pos, out_col). One row per document id is expected.

    Per-document counts get a running offset in document order (a prefix sum
    over the counts table, never over chunk rows); positions are exploded last,
    from the counts alone, so each text is split once and never moves.
    """
    counts = docs.select(doc_col, sentence_count(text_col).alias("_n")).where("_n > 0")
    offs = _prefix_sums(counts, doc_col, "_n", "_off")
    pos = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("pos")
    return offs.select(doc_col, pos, "_off").select(doc_col, "pos", (F.col("_off") + F.col("pos")).alias(out_col))


def prefix_scan(df: DataFrame, order_col: str, val_col: str, out_col: str, op: str = "sum") -> DataFrame:
    """Exclusive running ``sum`` or ``max`` of ``val_col`` in ``order_col``
    order over the whole table: computed inside each range partition (a window
    per partition, bounded by partition size) and stitched with the running
    value of earlier partitions (one row per partition meets on a task). No
    window is keyed by a business key, so a huge document or account is split
    across partitions like any other rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    agg = F.sum if op == "sum" else F.max
    # pinned so the per-partition totals and the rows use one partitioning
    ensure_checkpoint_dir(spark)
    ranged = df.repartitionByRange(n, order_col).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    w_in = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_loc", agg(val_col).over(w_in))
    totals = ranged.groupBy("_pid").agg(agg(val_col).alias("_tot"))
    base = totals.select("_pid", agg("_tot").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    if op == "sum":
        combined = F.coalesce(F.col("_base"), F.lit(0)) + F.coalesce(F.col("_loc"), F.lit(0))
    else:
        combined = F.greatest(F.col("_base"), F.col("_loc"))
    return (local.join(F.broadcast(base), "_pid")
                 .withColumn(out_col, combined)
                 .drop("_pid", "_loc", "_base"))


def _prefix_sums(df: DataFrame, idx_col: str, val_col: str, out_col: str) -> DataFrame:
    return prefix_scan(df, idx_col, val_col, out_col, "sum")


CLOSERS = "[\"')\\]]"
NON_CLOSER = "[^\"')\\]]"


def chunk_pages(pages: DataFrame, doc_col: str, page_col: str = "page_no", text_col: str = "text",
                lowercase: bool = True) -> DataFrame:
    """Sentence chunks of each document's cleaned pages joined without a
    separator, computed without ever building a document's text.

    Cleaned pages have no whitespace at either end, so no sentence boundary
    (punctuation, closing quotes, whitespace) sits on a page junction: pages
    split locally, and the last piece of a page continues into the next page.
    The one boundary that depends on earlier pages is a page that begins with
    closing quotes and a space right after text ending in . ! or ?; the
    nearest earlier page with a non-closer character comes from a running max
    over (document, page) order. Sentence numbers are running sums of boundary
    counts. Both scans run on a narrow projection of a page-feature table
    written once to the shared checkpoint folder; only the pieces of one
    sentence are grouped to rebuild it.
    Equal to ``chunk_sentences(concat_pages(clean_pages(pages)))``.
    """
    spark = pages.sparkSession
    t = clean_pdf_text(text_col, lowercase)
    feat = (pages.select(F.col(doc_col).alias("_doc"), F.col(page_col).alias("_page"), t.alias("_t"))
                 .where(F.col("_t") != "")
                 .select("_doc", "_page", sentence_split("_t").alias("_f"),
                         F.regexp_extract("_t", f"^({CLOSERS}+) ", 1).alias("_lead"),
                         F.regexp_extract("_t", f"({NON_CLOSER}){CLOSERS}*$", 1).alias("_tail")))
    path = scratch_path(spark, "page-features")
    feat.write.parquet(path)
    feat = spark.read.parquet(path)

    key = F.struct("_doc", "_page")
    narrow = feat.select(key.alias("_k"), "_doc", (F.col("_lead") != "").alias("_hl"),
                         (F.size("_f") - 1).alias("_nb"),
                         F.when(F.col("_tail") != "", F.struct(key.alias("k"), F.col("_tail").alias("c"))).alias("_tk"))
    scanned = prefix_scan(narrow, "_k", "_tk", "_prev", "max")
    cross = (F.col("_hl") & (F.col("_prev.k._doc") == F.col("_doc")) & F.col("_prev.c").isin(".", "!", "?"))
    counted = prefix_scan(scanned.withColumn("_x", F.coalesce(cross, F.lit(False)))
                                 .withColumn("_b", F.col("_nb") + F.col("_x").cast("int")),
                          "_k", "_b", "_S", "sum")
    first = counted.groupBy("_doc").agg(F.min("_S").alias("_S0"))
    per_page = counted.join(first, "_doc").select(F.col("_k._doc").alias("_doc"), F.col("_k._page").alias("_page"),
                                                 "_x", (F.col("_S") - F.col("_S0")).alias("_base"))

    rest0 = F.expr("substring(element_at(_f, 1), char_length(_lead) + 2)")
    pieces = F.when(F.col("_x"), F.concat(F.array(F.col("_lead"), rest0), F.slice("_f", 2, F.size("_f")))) \
              .otherwise(F.col("_f"))
    exploded = (feat.join(per_page, ["_doc", "_page"])
                    .select("_doc", "_page", "_base", F.posexplode(pieces).alias("_j", "_piece"))
                    .withColumn("_sid", F.col("_base") + F.col("_j")))
    ordered = F.array_sort(F.collect_list(F.struct("_page", "_j", "_piece")))
    sent = exploded.groupBy("_doc", "_sid").agg(F.array_join(F.transform(ordered, lambda x: x["_piece"]), "").alias("text"))
    return sent.select(F.col("_doc").alias(doc_col), F.col("_sid").cast("int").alias("pos"), "text")


def chunk_counts(chunks: DataFrame, doc_col: str) -> DataFrame:
    return chunks.groupBy(doc_col).agg(F.count(F.lit(1)).alias("n_chunks"))
