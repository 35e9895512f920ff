"""Sources and sinks. Schemas are always given, never inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold a JSON array of records (or one record)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def unwrap(df: DataFrame, field: str) -> DataFrame:
    """The records held in an array field of container documents."""
    return df.select(F.explode(field).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, quoted line breaks, doubled quotes and, perhaps, a byte-order mark. Nothing between commas is null;
    two quotes are an empty text."""
    null = uuid.uuid4().hex  # Spark's reader needs a text that stands for null: one that was drawn later than any in the file
    # A quote is escaped by itself alone: unset, its escape is escaped by \0, which texts may hold.
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', charToEscapeQuoteEscaping='"', nullValue=null, encoding="UTF-8")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that read_csv reads back as it was: blanks around texts stay, null is nothing and an empty text two quotes. A
    single column is followed by one without name and values, as a null alone would be a blank line, which is no row."""
    whole = df if len(df.columns) > 1 else df.withColumn("", F.lit(None).cast("string"))
    whole.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def text_boolean(col: Column | str) -> Column:
    """True where a text says so, in any case and with blanks around it; null stays null."""
    return F.lower(F.trim(col)) == "true"


def read_table(
    spark: SparkSession,
    url: str,
    name: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    parts: int = 32,
) -> DataFrame:
    """A table of a relational database (a jdbc: url, read in ranges of key) or of a folder of Parquet extracts."""
    if not url.startswith("jdbc:"):
        return spark.read.parquet(f"{url}/{name}.parquet")
    if key and bounds:
        return spark.read.jdbc(url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return spark.read.jdbc(url, name)


def vectors_long(df: DataFrame, vector: str, ids: list[str]) -> DataFrame:
    """One row for each entry that isn't zero: ids, feature_id, value."""
    return df.select(*ids, F.posexplode(vector).alias("feature_id", "value")).where("value != 0")


def write_partitioned(df: DataFrame, path: str, keys: list[str], form: str = "parquet") -> None:
    """A folder for each value of keys; rows of a key are gathered first, so small keys give one file."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).format(form).save(path)


def write_table(df: DataFrame, path: str, columns: list[str], sort: list[str] | None = None) -> None:
    """A small result table as one CSV file with fixed columns."""
    small = df.select(*columns).coalesce(1)
    (small.sortWithinPartitions(*sort) if sort else small).write.mode("overwrite").csv(path, header=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder the cluster names in spark.checkpoint.dir; where that is unset, in a temporary
    folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder, from which lineage goes on."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
