"""A corpus pipeline: quality rules, line dedup, near-dedup, removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, with n_chars as the length of the text they leave.

Defined cases: a null text fails the quality rules, as it has no words; a null lang or source is kept as it is; rows
with a null id are judged by the quality rules, keep their lines and passages and are nobody's copies; rows that repeat
an id are judged one by one, and of equal or similar ones the first by id and hash stays; a text that the line stage
empties is a document without shingles, which is nobody's copy unless id and text are equal, and is packed as its end id
alone; further columns of documents are left out, whatever their names; an empty table goes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import line_dedup, minhash, packing, quality, suffix
from pairlab.llm.common import cut, table
from pairlab.llm.queries import BYTE_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def recounted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    judged = quality.judge_quality(docs, table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that resemble an earlier one."""
    return recounted(line_dedup.dedup_lines(docs, keep=("lang", "source")))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of the smallest id of each group of near duplicates (similarity 0.8 or more).

    Each row is a node of its own: rows that repeat an id with different texts are judged one by one, and become one only
    where their texts are alike or, if they have no words, equal. Rows without an id stay.
    """
    rows = cut(docs.where("doc_id IS NOT NULL").select(*COLUMNS, F.monotonically_increasing_id().alias("__node")))
    judged = minhash.near_duplicates(rows, percent=80, id_col="__node").select(F.col("doc_id").alias("__node"), "n_shingles", "component_id")
    named = rows.select("__node", "doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("hash"), F.xxhash64("text").alias("same")).join(judged, "__node")
    group = [F.when(F.col("n_shingles") > 0, F.col("component_id")), F.when(F.col("n_shingles") == 0, F.struct("doc_id", "same"))]
    first = named.groupBy(*group).agg(F.min(F.struct("doc_id", "hash", "__node")).alias("f")).select("f.__node")
    return rows.join(first, "__node", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the bytes of 50-byte strings that a smaller document has too."""
    return recounted(suffix.kept_text(suffix.remove_repeats(docs, keep=("lang", "source"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", keep_first),
    ("suffix_dedup", drop_passages),
    ("packing", pack),
]

#: SQL can't express the forest, the components or the tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result goes through a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
