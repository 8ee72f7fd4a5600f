"""Incremental jobs over newly arriving files."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """Fresh folder for tables and stream state, inside the shared checkpoint folder.

    Without one a temporary folder is used, which only a local master may do.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/planeweave-{os.urandom(8).hex()}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def collect_results(stream: DataFrame, measure: Callable[[DataFrame], DataFrame], table: str, checkpoint: str):
    """Measure each batch of arriving rows and append its results under its batch number.

    A batch owns one partition of the table and overwrites it when retried, so a lost
    executor or driver cannot duplicate rows. Start with ``trigger(availableNow=True)`` for a
    scheduled run or a processing-time trigger for a continuous one.
    """
    def save(batch: DataFrame, number: int) -> None:
        measure(batch).write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def latest_results(spark: SparkSession, table: str, key: str = "image_id") -> DataFrame:
    """Rows of the newest batch of each image: a later measurement replaces the earlier."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, [key, "batch_id"], "left_semi")


def partials(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mergeable measurements per key and ``version``: counts, sum, extremes and the squares about the mean."""
    v = F.when(F.abs(value) < float("inf"), F.col(value).cast("double"))
    return rows.groupBy(*keys, "version").agg(
        F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("non_finite"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        (F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count(v)).alias("squares"), F.min(v).alias("min"), F.max(v).alias("max"))


def merge_partials(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and version from any number of partials, still mergeable."""
    mean = F.try_divide(F.sum("sum"), F.sum("n"))
    between = F.sum(F.when(F.col("n") > 0, F.col("sum") * F.col("sum") / F.col("n"))) - mean * F.sum("sum")
    return found.groupBy(*keys, "version").agg(
        F.sum("n").alias("n"), F.sum("non_finite").alias("non_finite"), F.sum("sum").alias("sum"),
        (F.sum("squares") + F.greatest(F.coalesce(between, F.lit(0.0)), F.lit(0.0))).alias("squares"), F.min("min").alias("min"), F.max("max").alias("max"))


def collect_partials(stream: DataFrame, keys: list[str], table: str, checkpoint: str, value: str = "value"):
    """Collect measurements of images whose rows may arrive in several batches.

    A batch appends partials, not results, so an image that is split over batches loses nothing: rows of one
    ``version`` add up. A later version of an image replaces the earlier ones when results are read. Retried
    batches overwrite their own partition, as in :func:`collect_results`.
    """
    return collect_results(stream, lambda batch: partials(batch, keys, value), table, checkpoint)


def compact(spark: SparkSession, table: str, target: str, keys: list[str]) -> None:
    """Partials of all batches so far as one batch 0 of a new table; give the old one's state folder to no
    other stream afterwards."""
    merge_partials(spark.read.parquet(table), keys).write.parquet(f"{target}/batch_id=0")


def merged_results(spark: SparkSession, table: str, keys: list[str], image: str = "image_id") -> DataFrame:
    """Results of each image's newest version: n, non_finite, mean, sample std (0 for one value), min, max."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy(image).agg(F.max("version").alias("version"))
    m = merge_partials(rows.join(newest, [image, "version"], "left_semi"), keys)
    std = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).when(F.col("n") == 1, F.lit(0.0))
    return m.select(*keys, "version", "n", "non_finite", F.try_divide(F.col("sum"), F.col("n")).alias("mean"), std.alias("std"), "min", "max")


def drop_duplicate_objects(stream: DataFrame, uid: list[str], ingest_time: str, delay: str) -> DataFrame:
    """Copies of an image object that arrive within ``delay`` of the first are dropped."""
    return stream.withWatermark(ingest_time, delay).dropDuplicatesWithinWatermark(uid)
