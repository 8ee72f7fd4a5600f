"""What several text operators share: words, stored tables, row identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planeweave.session import cut_lineage

#: Words are the longest runs without these characters (space, and tab to carriage return).
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; chosen by ``cut_lineage`` under a local master where unset."""
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        cut_lineage(spark.range(0).toDF("id"))
    return ctx.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there: lineage ends
    here, and a lost executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a non-null text; empty without words."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def fixed_hash(*cols: Column | str) -> Column:
    """Non-negative 60-bit number from the md5 of the columns' texts: the same in any engine."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def in_fold(key: str = "doc_id") -> Column:
    """True for held-out rows: crc32 of the key as text, modulo 5, is 0. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0
