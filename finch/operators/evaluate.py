"""Answer evaluation: similarity of generated answers to a true answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import HASH_DIM, cosine, token_buckets


def score_vectors(cases: DataFrame, true_col: str, rag_col: str, non_rag_col: str) -> DataFrame:
    """Cosine of the RAG and the non-RAG answer vectors to the true answer."""
    return cases.withColumn("rag_score", cosine(true_col, rag_col)) \
                .withColumn("non_rag_score", cosine(true_col, non_rag_col))


def sparse_vectors(texts: DataFrame, key_cols: list[str], text_col: str, dim: int = HASH_DIM) -> DataFrame:
    """Hashed bag of words in sparse form: (keys..., b, c)."""
    return (texts.select(*key_cols, F.explode(token_buckets(text_col, dim)).alias("b"))
                 .groupBy(*key_cols, "b").agg(F.count(F.lit(1)).alias("c")))


def sparse_cosine(x: DataFrame, y: DataFrame, key_cols: list[str]) -> DataFrame:
    """Cosine per key of two sparse vectors (keys..., b, c). Dot products are
    an equi-join on (keys, bucket), never a pair table; integer counts make
    dot / sqrt(|x|^2 |y|^2) exactly reproducible."""
    dot = (x.alias("x").join(y.alias("y"), [*key_cols, "b"])
            .groupBy(*key_cols).agg(F.sum(F.col("x.c") * F.col("y.c")).alias("dot")))
    nx = x.groupBy(*key_cols).agg(F.sum(F.col("c") * F.col("c")).alias("nx"))
    ny = y.groupBy(*key_cols).agg(F.sum(F.col("c") * F.col("c")).alias("ny"))
    return (nx.join(ny, key_cols).join(dot, key_cols, "left")
              .select(*key_cols, F.try_divide(F.coalesce("dot", F.lit(0)).cast("double"),
                                              F.sqrt((F.col("nx") * F.col("ny")).cast("double"))).alias("sim")))
