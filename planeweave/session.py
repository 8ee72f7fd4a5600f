"""Session defaults and lineage cutting."""

from __future__ import annotations

import contextlib
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("planeweave")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    A directory of our own is chosen only for a local master (tests); on a cluster a
    machine-local folder would be lost with its machine, so the setting is required.
    """
    spark = df.sparkSession
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        configured = ctx.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None
        )
        if configured is None:
            if not ctx.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        ctx.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by ``keys`` into the session's number of shuffle partitions, which adaptive execution leaves alone.

    It merges partitions by their compressed size down to a few for each core; rows that pack well then fill a
    task's memory, and rows that are multiplied later start from very few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Actions inside send at most ``rows`` rows at a time to Python kernels: for rows that hold whole tiles."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
