import pytest
from pyspark.sql import functions as F

from finch.operators import retry
from finch.session import scratch_path


def prompts(spark, n):
    return spark.createDataFrame([(k, f"prompt {k}") for k in range(n)], "batch_id long, prompt string").repartition(3)


def stub(calls):
    """Batch k is answered well from attempt k % 6 + 1 on (never for 5)."""
    def respond(pending, attempt):
        @F.udf("string")
        def say(k):
            calls.add(1)
            good = attempt > k % 6 and k % 6 != 5
            return f"Here:\n\n2024 - shop {k} - {attempt} - Food\n\nbye" if good else "Sorry"
        return pending.select("batch_id", say("batch_id").alias("response"))
    return respond


def test_only_pending_batches_are_asked_again(spark):
    calls, path = spark.sparkContext.accumulator(0), scratch_path(spark, "retry")
    batches = prompts(spark, 24)
    rows = retry.categorise_retry(batches, path, stub(calls)).collect()
    assert {(r.batch_id, r.attempt) for r in rows} == {(k, k % 6 + 1) for k in range(24) if k % 6 < 4}
    assert calls.value == 24 + 20 + 16 + 12
    assert {(r.batch_id, r.attempts) for r in retry.rejects(batches, path).collect()} == {(k, 4) for k in range(24) if k % 6 > 3}


def test_goes_on_after_a_crash(spark):
    calls, path = spark.sparkContext.accumulator(0), scratch_path(spark, "retry")
    batches = prompts(spark, 12)
    ask = stub(calls)

    def dies(pending, attempt):
        if attempt == 3:
            raise RuntimeError("killed")
        return ask(pending, attempt)
    with pytest.raises(RuntimeError):
        retry.categorise_retry(batches, path, dies)
    assert calls.value == 12 + 10 and retry.stored_attempts(spark, path).count() == 22
    rows = retry.categorise_retry(batches, path, ask).collect()
    assert calls.value == 12 + 10 + 8 + 6 and {r.batch_id for r in rows} == {k for k in range(12) if k % 6 < 4}


def test_ends_when_all_are_valid(spark):
    calls, path = spark.sparkContext.accumulator(0), scratch_path(spark, "retry")
    batches = prompts(spark, 12).where("batch_id % 6 < 2")
    retry.categorise_retry(batches, path, stub(calls))
    assert calls.value == 4 + 2 and retry.rejects(batches, path).collect() == []
    retry.categorise_retry(batches, path, stub(calls))
    assert calls.value == 6


def test_missing_answers_and_no_batches(spark):
    path = scratch_path(spark, "retry")
    batches = prompts(spark, 3)
    assert retry.categorise_retry(batches, path, lambda p, n: p.where("batch_id > 0").select("batch_id", F.lit(None).cast("string").alias("response"))).collect() == []
    assert {(r.batch_id, r.attempts) for r in retry.rejects(batches, path).collect()} == {(0, 0), (1, 4), (2, 4)}
    assert retry.categorise_retry(prompts(spark, 0), scratch_path(spark, "retry"), stub(spark.sparkContext.accumulator(0))).collect() == []


def test_generator_plugin(spark):
    def model():
        return lambda texts: [f"Ok:\n\n2024 - {t} - 1 - Rent\n\nbye" for t in texts]
    rows = retry.categorise_retry(prompts(spark, 2), scratch_path(spark, "retry"), retry.ask_model(model)).collect()
    assert sorted(r.Description for r in rows) == ["prompt 0", "prompt 1"]


def test_work_table_is_worked_out_once(spark):
    """Rounds look at the stored batches, not at what they were made from."""
    seen, calls, path = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), scratch_path(spark, "retry")

    @F.udf("string")
    def made(k):
        seen.add(1)
        return f"prompt {k}"
    batches = spark.range(12).select(F.col("id").alias("batch_id"), made("id").alias("prompt"))
    batches = batches.groupBy("batch_id").agg(F.max("prompt").alias("prompt")).where("prompt <> ''")
    assert retry.categorise_retry(batches, path, stub(calls)).count() == 8 and seen.value == 12
