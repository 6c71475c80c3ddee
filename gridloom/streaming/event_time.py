"""Hourly marts of lines and voltages by event time, and an account of what came late.

The marts are those of :mod:`gridloom.serving.marts`: the same aggregates, on a
stream grouped by windows whose state goes once the watermark has passed them, so
state holds the open hours only and each hour is written once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..serving import marts

#: Columns by which a message is the same as another: what the broker gives, or the landed row's with the time it was landed.
DEDUP_KEYS = {"offset": ["topic", "kafka_partition", "kafka_offset"], "reference": ["topic", "kafka_partition", "kafka_offset", "ingestion_timestamp"]}


def once(landed: DataFrame, key: str = "offset", ts: str = "event_timestamp", late: str = "10 minutes") -> DataFrame:
    """Landed rows without repetitions.

    ``offset`` knows a message by its place at the broker, so one that is read twice
    counts once; ``reference`` takes the time of landing too, so it counts twice.
    On a stream a repetition is looked for as long as the watermark lets it in.
    """
    if key not in DEDUP_KEYS:
        raise ValueError(f"key is one of {', '.join(DEDUP_KEYS)}")
    if not landed.isStreaming:
        return landed.dropDuplicates(DEDUP_KEYS[key])
    return landed.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(DEDUP_KEYS[key])


def closed_hours(mart: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Append the hours that the watermark has closed to ``path/rows``, each once; a restart goes on where the last run ended."""
    out = mart.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    return out.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def line_hours(facts: DataFrame, path: str, late: str = "10 minutes", **trigger) -> StreamingQuery:
    return closed_hours(marts.line_loading_hourly(facts, late), path, **trigger)


def voltage_hours(facts: DataFrame, path: str, late: str = "10 minutes", **trigger) -> StreamingQuery:
    return closed_hours(marts.voltage_hourly(facts, late), path, **trigger)


def lateness(facts: DataFrame, keys: list[str], ts: str = "event_timestamp", late_seconds: int = 600, shards: int = 1) -> DataFrame:
    """``keys``, ``shard``, ``newest``, ``rows``, ``late_rows`` so far, for each key that a batch touches.

    A row is late if it lies more than ``late_seconds`` behind what its own key had
    shown before the batch.  With ``shards`` a key's rows are dealt to so many
    states, each with its own newest row, so that no key is one task's.
    """
    kinds = ", ".join(f"{k} {facts.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, parts, state: GroupState):
        newest, rows, late = state.get if state.exists else (None, 0, 0)
        before = newest
        for part in parts:
            at = part["at"].astype("int64")
            rows += len(at)
            if before is not None:
                late += int((at < before - late_seconds).sum())
            if len(at):
                newest = int(at.max()) if newest is None else max(newest, int(at.max()))
        state.update((newest, rows, late))
        yield pd.DataFrame([(*key, newest, rows, late)], columns=[*keys, "shard", "newest", "rows", "late_rows"])

    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    seen = facts.filter(F.col(ts).isNotNull()).select(*keys, F.pmod(F.xxhash64(*facts.columns), F.lit(shards)).cast("int").alias("shard"), at.alias("at"))
    grouped = seen.groupBy(*keys, "shard").applyInPandasWithState(run, f"{kinds}, shard int, newest long, rows long, late_rows long", "newest long, rows long, late long", "update", GroupStateTimeout.NoTimeout)
    return grouped.withColumn("newest", F.timestamp_seconds("newest"))


def hours_until(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`closed_hours` has written."""
    return spark.read.parquet(f"{path}/rows")
