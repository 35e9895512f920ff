"""Queries of the sources and sinks: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.registry import query, table
from pairlab.sources import io


@query("s1_read_records", "SELECT n_nationkey, n_name FROM nation")
def s1(spark, sf):
    path = io.scratch(spark, "s1")
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"),
    )
    nations.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return io.read_records(
        spark,
        path,
        "n_nationkey int, n_name string, n_regionkey int",
    ).select("n_nationkey", "n_name")


@query("s2_unwrap", "SELECT conv_id, turn, role FROM conversations")
def s2(spark, sf):
    boxes = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.collect_list(F.struct("conv_id", "turn", "role")).alias("records"),
    )
    return io.unwrap(boxes, "records")


@query("s3_jsonl", "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents")
def s3(spark, sf):
    path = io.scratch(spark, "s3")
    docs = table(spark, sf, "documents")
    io.write_jsonl(docs, path)
    return io.read_jsonl(spark, path, docs.schema).select(
        "doc_id",
        "lang",
        "n_chars",
        F.md5("text").alias("text_md5"),
    )


@query("s4_csv", "SELECT doc_id, md5(text) AS text_md5, lang = 'en' AS english FROM documents")
def s4(spark, sf):
    path = io.scratch(spark, "s4")
    io.write_csv(
        table(spark, sf, "documents").select(
            "doc_id",
            "text",
            F.when(F.col("lang") == "en", " True").when(F.col("lang").isNotNull(), "false").alias("english"),
        ),
        path,
    )
    return io.read_csv(spark, path, "doc_id long, text string, english string").select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        io.text_boolean("english").alias("english"),
    )


@query("s5_read_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def s5(spark, sf):
    return io.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")


@query("s6_vectors_long", """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS feature_id, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings) WHERE v > 0""")
def s6(spark, sf):
    relu = table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda v: F.greatest(v, F.lit(0.0).cast("float"))).alias("v"),
    )
    return io.vectors_long(relu, "v", ["vec_id"]).withColumn("value", F.col("value").cast("double"))


@query("s7_write_partitioned", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def s7(spark, sf):
    path = io.scratch(spark, "s7")
    io.write_partitioned(
        table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"),
        path,
        ["o_orderpriority"],
    )
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("s8_write_table", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def s8(spark, sf):
    path = io.scratch(spark, "s8")
    counts = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    io.write_table(counts, path, ["n_regionkey", "n"], ["n_regionkey"])
    return io.read_csv(spark, path, "n_regionkey int, n long")
