"""Shared by test modules of both folders; not a conftest, so its name is the only one on the path."""

SMALL = "/root/testdata/sf0.001"


def col1(spark, values, expr, name="x"):
    """Apply a column expression to a one-column frame of strings."""
    from pyspark.sql import types as T
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, T.StringType())]))
    return [r[0] for r in df.select(expr).collect()]
