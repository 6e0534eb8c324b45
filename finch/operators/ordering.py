"""Global order without a single-partition window, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir

# Size above which a side is never broadcast.
MAX_BROADCAST_BYTES = 64 << 20


def dense_index(df: DataFrame, order_cols: list, out_col: str = "idx",
                num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Add a 0-based position in ``order_cols`` order (a distributed zipWithIndex).

    Range-partition on the order, number rows inside each partition, then add
    the row count of all earlier partitions. Only the per-partition counts (one
    row per partition, a proven bound) meet on one task; no global window.

    The numbered table is checkpointed (shared checkpoint folder) so the
    counts and the rows come from the same partition contents: the count
    branch is pruned to fewer columns, and adaptive execution may then feed the
    range sampler differently sized input partitions than the row branch,
    which would move the range bounds. The checkpoint also survives executor
    loss. ``checkpoint=False`` is only safe when both branches plan identically.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        ensure_checkpoint_dir(spark)
        tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out_col, F.col("_off") + local)
                  .drop("_pid", "_mid", "_off"))


def bytes_at_most(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> bool:
    """Do the rows, printed as JSON, come to at most ``limit`` bytes? Sums are
    taken map-side; only one number reaches the driver."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0]
    return (size or 0) <= limit


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after checking the size in bytes; otherwise leave the
    join to the planner (sort-merge with AQE skew handling). ``df`` is read twice,
    so callers pass a stored or cheap table."""
    return F.broadcast(df) if bytes_at_most(df, limit) else df
