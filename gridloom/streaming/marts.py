"""Structured Streaming: landing of messages and hourly marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import latest
from ..sources.bronze import bronze_rows

MESSAGES = "topic string, key binary, value binary, partition int, offset bigint, timestamp timestamp"


def message_stream(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """Messages from a broker (``kafka``) or, with the same columns, from a folder of files."""
    reader = spark.readStream.format(source).options(**options)
    return (reader if source == "kafka" else reader.schema(MESSAGES)).load()


def land(messages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to the partitioned lake, once per message: the checkpoint makes the file sink exact."""
    rows = bronze_rows(messages.withWatermark("timestamp", "10 minutes").dropDuplicatesWithinWatermark(["topic", "partition", "offset"]))
    out = rows.withColumn("date", F.substring("ingestion_timestamp", 1, 10)).writeStream.partitionBy("topic", "date").format("parquet")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def hourly(events: DataFrame, key: str, ts: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and means by hour and key; works on streams and tables."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, "1 hour"), key).agg(F.count("*").alias("n"), F.round(F.avg(value), 8).alias("avg_value"), F.max(value).alias("max_value")).select(F.col("window.start").alias("hour"), key, "n", "avg_value", "max_value")


def write_changes(mart: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Write what each batch changes to ``path``, under the batch's number, so that a batch run twice replaces itself."""

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    return mart.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_changes(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key that ``write_changes`` has written."""
    return latest(spark.read.parquet(f"{path}/rows"), keys, [F.desc("batch")]).drop("batch")
