"""Categorisation as a running loop: a model is asked again only for batches without a valid answer.

Every round writes its answers as one attempt of a stored table and then a marker; a job that is started
again after a crash goes on behind the last marked attempt, so no finished round is asked twice. A round's
batches are those of the work table less those with a stored valid answer (an anti-join on the batch id), and
what is looked at to end the loop is whether any such batch is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import MAX_ATTEMPTS
from ..session import scratch_path
from .prompts import generate
from .transactions import batch_valid, first_valid, response_block

ATTEMPT_SCHEMA = "batch_id long, attempt int, response string, block array<string>, valid boolean"


def _finished(spark: SparkSession, path: str) -> int:
    """The last attempt that was written to its end."""
    try:
        return spark.read.parquet(f"{path}/finished").agg(F.max("attempt")).first()[0] or 0
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def stored_attempts(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, attempt, response, block, valid) of all finished attempts."""
    folders = [f"{path}/answers/attempt={k}" for k in range(1, _finished(spark, path) + 1)]
    if not folders:
        return spark.createDataFrame([], ATTEMPT_SCHEMA)
    return spark.read.option("basePath", f"{path}/answers").schema(ATTEMPT_SCHEMA).parquet(*folders).select("batch_id", "attempt", "response", "block", "valid")


def ask_model(factory: Callable[[], Callable[[list[str]], list[str]]]):
    """A ``respond`` function that runs a text generator over the prompts."""
    return lambda pending, attempt: generate(pending, ["batch_id"], "prompt", factory, attempt).select("batch_id", "response")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, stored in the shared folder and read back."""
    kept = scratch_path(df.sparkSession, name)
    df.write.parquet(kept)
    return df.sparkSession.read.parquet(kept)


def categorise_retry(batches: DataFrame, path: str, respond: Callable[[DataFrame, int], DataFrame],
                     max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The rows of every batch's first valid answer (as ``first_valid`` has them),
    asking at most ``max_attempts`` times.

    ``batches`` is (batch_id, prompt); ``respond(pending, attempt)`` returns (batch_id,
    response) for the batches it is given. A batch without an answer, or with a null one, stays pending. Answers are kept below
    ``path``; ``rejects`` lists the batches that never got a valid one.
    """
    spark = batches.sparkSession
    begun = _finished(spark, path)
    if begun < max_attempts:                # every round looks at the work table several times: it is worked out once
        batches = written(batches, "retry-batches")
    for attempt in range(begun + 1, max_attempts + 1):
        accepted = stored_attempts(spark, path).where("valid").select("batch_id")
        pending = batches.join(accepted, "batch_id", "left_anti")
        if pending.isEmpty():
            break
        answers = batch_valid(response_block(respond(pending, attempt)))
        answers.select(F.col("batch_id").cast("long").alias("batch_id"), "response", "block", "valid").write.mode("overwrite").parquet(f"{path}/answers/attempt={attempt}")
        spark.createDataFrame([(attempt,)], "attempt int").coalesce(1).write.mode("append").parquet(f"{path}/finished")
    return first_valid(stored_attempts(spark, path), max_attempts)


def rejects(batches: DataFrame, path: str) -> DataFrame:
    """(batch_id, attempts): batches without a valid answer so far, and how often they were asked."""
    tried = stored_attempts(batches.sparkSession, path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("valid").alias("valid"))
    left = batches.select("batch_id").join(tried, "batch_id", "left").where(~F.coalesce("valid", F.lit(False)))
    return left.select("batch_id", F.coalesce("attempts", F.lit(0)).alias("attempts"))
