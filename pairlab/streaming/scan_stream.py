"""A continuous scan: records that arrive as files are scanned once each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlab.operators.scan import rules_fingerprint, scan_rules


#: Parts of a sink's keys; a batch reads the parts its own records fall in.
PARTS = 64


def scan_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    sink: str,
    checkpoint: str,
    ident: str,
    text: str,
    rules: list[tuple[str, str, str]],
    form: str = "parquet",
) -> StreamingQuery:
    """Scan what has arrived in source and append findings to sink; started again, it goes on where it stopped.

    Scanning is stateless. A batch leaves out records that the sink has with the same rules, so neither a batch that is
    run again nor a record that arrives twice is scanned twice, and no state grows with the stream. The sink lies in
    folders by rules and part of the id's hash: a batch reads the ids alone, of its own rules and parts. Of records that
    repeat an id in one batch, the one of the least text is scanned.
    """
    arriving = spark.readStream.schema(schema).format(form).load(source)
    marked = arriving.select(
        ident,
        F.col(text).alias("__text"),
        rules_fingerprint(rules).alias("rules_hash"),
        F.pmod(F.xxhash64(ident), F.lit(PARTS)).cast("int").alias("part"),
    )

    def append(batch: DataFrame, _: int) -> None:
        batch = batch.persist()  # it is read twice, and once from its source
        try:
            fresh = batch.groupBy(ident, "rules_hash", "part").agg(F.min("__text").alias("__text"))
            try:
                done = batch.sparkSession.read.parquet(sink).select(ident, "rules_hash", "part")
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":  # nothing has been written yet
                    raise
            else:
                mine = [r["part"] for r in batch.select("part").distinct().collect()]  # at most PARTS
                fresh = fresh.join(done.where(F.col("part").isin(mine)), [ident, "rules_hash", "part"], "left_anti")
            scanned = fresh.select(ident, scan_rules("__text", rules).alias("findings"), "rules_hash", "part")
            scanned.write.mode("append").partitionBy("rules_hash", "part").parquet(sink)
        finally:
            batch.unpersist()

    return marked.writeStream.foreachBatch(append).option(
        "checkpointLocation",
        checkpoint,
    ).trigger(availableNow=True).start()
