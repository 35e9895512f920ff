"""Shared helpers of the llm operators: table access and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters 0x09 to 0x0D.
SEPARATORS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Tells Spark to remove the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_place(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and go on from there, so that no lineage is left behind.

    What the write shuffled is removed when it has ended, as nothing refers to it any more.
    """
    spark, path = df.sparkSession, path or new_place(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame, path: str) -> None:
    """Empty a table that cut has written, once nothing is read from it any more."""
    table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def words_native(text: Column) -> Column:
    """The words of a text, as an array without empty entries; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
