import random

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def frame(spark):
    """rows of (doc_id, text) as a table, with columns that operators use inside."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("h", T.StringType()), T.StructField("row", T.LongType()), T.StructField("key", T.StringType())])

    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], schema).repartition(parts)
    return make


@pytest.fixture(scope="session")
def words():
    """A function: n words of a small invented vocabulary, fixed by its seed."""
    def make(n, seed, size=400):
        rng = random.Random(seed)
        return " ".join("w" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10 % 10] + "uvwxyz"[k // 100 % 6] for k in (rng.randrange(size) for _ in range(n)))
    return make
