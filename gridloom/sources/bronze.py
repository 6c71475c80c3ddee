"""Schemas and reading of landed events; staging, facts and marts as pure functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BRONZE = "topic string, kafka_key string, kafka_partition int, kafka_offset bigint, ingestion_timestamp string, raw_value string"
TELEMETRY = (
    "timestamp string, step int, network string, bus_voltage_pu map<string,double>, line_loading_percent map<string,double>, "
    "gen_power_mw map<string,double>, total_load_mw double, total_generation_mw double, active_contingencies array<string>"
)
TOPIC = "grid.telemetry.raw"


def bronze_rows(messages: DataFrame) -> DataFrame:
    """Broker messages (``topic``, ``key``, ``value``, ``partition``, ``offset``) as landed rows."""
    return messages.select(
        "topic", F.col("key").cast("string").alias("kafka_key"), F.col("partition").cast("int").alias("kafka_partition"), F.col("offset").cast("long").alias("kafka_offset"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ingestion_timestamp"), F.col("value").cast("string").alias("raw_value"),
    )


def jsonl_messages(spark: SparkSession, path: str, topic: str = TOPIC) -> DataFrame:
    """Lines of JSON as messages; blank lines are none.

    A file stands for a partition and a line's number in it for the offset, both
    marked by hashes of the file's path, size and time: 31 bits in the partition, 22
    above the line's 40.  So a file landed again, beside others or under other
    split settings, has the same keys, and other files have others.

    Numbers are counted by blocks: the scan numbers the lines of a block in a row,
    so a line's own number less its block's least, plus the lines of the blocks
    before, is its number in the file.  Only a row a block is grouped and sorted.
    """
    about = F.col("_metadata")
    key = F.xxhash64(about["file_path"], about["file_size"], about["file_modification_time"])
    lines = spark.read.text(path).select("value", key.alias("file"), about["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(blocks.withColumn("before", before), ["file", "block"])
    line = F.col("before") + F.col("id") - F.col("least")
    mark = F.shiftleft(F.shiftrightunsigned("file", 42), 40)
    partition = F.col("file").bitwiseAND(F.lit(2**31 - 1)).cast("int")
    said = numbered.filter(F.trim("value") != "")
    return said.select(F.lit(topic).alias("topic"), F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), partition.alias("partition"), mark.bitwiseOR(line).alias("offset"))


def write_bronze(rows: DataFrame, path: str) -> None:
    rows.withColumn("date", F.substring("ingestion_timestamp", 1, 10)).write.mode("append").partitionBy("topic", "date").parquet(path)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BRONZE + ", date date").parquet(path)


def staged(bronze: DataFrame, topic: str = TOPIC) -> DataFrame:
    """Typed telemetry: the payload is parsed once; unreadable payloads have ``is_corrupt``."""
    parsed = bronze.filter(F.col("topic") == topic).dropDuplicates(["topic", "kafka_partition", "kafka_offset"]).withColumn("j", F.from_json("raw_value", TELEMETRY))
    return parsed.select(
        F.col("j.network").alias("network"), F.col("j.step").alias("step"), F.try_to_timestamp("j.timestamp").alias("event_timestamp"),
        F.coalesce(F.size("j.active_contingencies"), F.lit(0)).alias("n_contingencies"), "j.total_load_mw", "j.total_generation_mw",
        "j.bus_voltage_pu", "j.line_loading_percent", "j.gen_power_mw", (F.col("j.network").isNull() & F.col("raw_value").isNotNull()).alias("is_corrupt"),
    )


def unnested(stage: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """One row per entry of a map; rows without the map disappear."""
    return stage.select("network", "step", "event_timestamp", F.explode(column).alias(key, value))


def bus_voltage(stage: DataFrame, limits: DataFrame, scope: DataFrame) -> DataFrame:
    from ..operators.relational import exists_in, with_limits

    facts = unnested(stage, "bus_voltage_pu", "bus", "voltage_pu").withColumn("bus_id", F.expr("try_cast(bus as int)")).drop("bus")
    return with_limits(exists_in(facts, scope, ["network", "bus_id"], "in_scope"), limits, "network", "voltage_pu", "v_min_pu", "v_max_pu", F.col("in_scope"))


def line_loading(stage: DataFrame) -> DataFrame:
    return unnested(stage, "line_loading_percent", "line_id", "loading_percent").withColumn("is_overloaded", F.col("loading_percent") > 100)


def generator_power(stage: DataFrame) -> DataFrame:
    return unnested(stage, "gen_power_mw", "gen_id", "power_mw")


def grid_summary(stage: DataFrame) -> DataFrame:
    return stage.select("network", "step", "event_timestamp", "total_load_mw", "total_generation_mw", (F.col("total_generation_mw") - F.col("total_load_mw")).alias("power_balance_mw"), (F.col("n_contingencies") > 0).alias("has_contingency"))


def voltage_quality_hourly(facts: DataFrame, place: str = "bus_id", value: str = "voltage_pu") -> DataFrame:
    from ..operators.relational import rate_percent

    hits, scope = F.count_if(F.col("is_violation")), F.count_if(F.col("in_scope"))
    return facts.groupBy("network", place, F.date_trunc("hour", "event_timestamp").alias("hour")).agg(
        F.round(F.avg(value), 4).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.round(F.stddev_samp(value), 4).alias("stddev_value"),
        F.bool_or("in_scope").alias("in_scope"), F.count("*").alias("readings"), hits.alias("violations"), rate_percent(hits, scope).alias("violation_rate"),
    )
