"""The corpus pipeline: stages over ``documents``, each written as Parquet and
read again as the next one's input. Every stage takes all rows that its
predecessor kept, whatever extra columns, nulls, repeated rows or empty tables
they bring; all but the last return the columns they got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from finch.llm import decontamination, jaccard_join, line_templates, resampling, sentencepiece_codec
from finch.llm.common import table
from finch.session import scratch_path


# Rows of text that a Python worker unpacks at a time; workers live on from stage to stage and keep what they once took.
BATCH_ROWS = 500


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws; the others go."""
    bounded(spark)
    return resampling.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates that an earlier document
    has; ``n_chars`` follows. A document that loses all its lines goes."""
    kept = line_templates.drop_recurring_lines(docs, stats=False, drop_emptied=True)
    return kept.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in docs.dtypes])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    bounded(spark)
    return jaccard_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited."""
    bounded(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    bounded(spark)
    return sentencepiece_codec.encode_documents(docs, keep=100_000)      # segments; memory before time here


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", tokenize),
]

# Model-based and iterative stages have no SQL form; the pipeline is tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
