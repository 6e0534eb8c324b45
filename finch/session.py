"""Spark session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

# Settings the operators assume. AQE re-plans joins and coalesces small shuffle
# partitions at run time; skew-join splitting covers hot keys in equi-joins.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "finch",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's settings.

    On a cluster pass ``master=None`` and let spark-submit decide; tests pass
    ``local[*]``. A checkpoint folder is only set here when the cluster did not
    name one (``spark.checkpoint.dir``).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session that names none gets a folder under the system temp dir only if
    its master is local (tests); on a cluster the setting has to be there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[[^,\]]*(,[^\]]*)?\])?$", master):
            raise ValueError(f"spark.checkpoint.dir is not set and the master is {master}: name a folder that all executors share")
        root = os.path.join(os.environ.get("TMPDIR", "/tmp"), "finch-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` write to the shared checkpoint folder."""
    root = checkpoint_root(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint root for intermediate tables."""
    return f"{checkpoint_root(spark)}/finch-scratch/{name}-{uuid.uuid4().hex[:12]}"


def for_many_files(spark: SparkSession) -> SparkSession:
    """A session of its own, set as ``spark``, to read folders of many short files. Spark takes opening a file
    for as dear as reading 4 MB and lists paths in up to 10,000 tasks; a short file would be a good part of a
    task. Here a task reads many, and a list of paths is dealt to as many tasks as run at once."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.files.openCostInBytes", str(64 << 10))
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(spark.sparkContext.defaultParallelism))
    return own


def configure_for_input(spark: SparkSession, input_bytes: int, target_bytes: int = 128 << 20,
                        min_partitions: int = 200) -> int:
    """Size shuffles for the data at hand: about one shuffle partition per
    ``target_bytes`` of input (AQE coalesces small ones at run time and splits
    skewed ones), and file splits of the same size. Returns the partition count."""
    n = max(min_partitions, -(-input_bytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes // 2))
    return n
