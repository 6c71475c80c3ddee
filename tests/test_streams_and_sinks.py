"""Event-time marts, lateness, repeated messages, several sinks, day chunks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gridloom.serving import marts
from gridloom.streaming import event_time, sinks

T = dt.datetime(2024, 1, 1)
FACTS = "network string, line_id long, event_timestamp timestamp, loading_percent double, is_overloaded boolean"


def facts(spark, minutes, network="n"):
    return spark.createDataFrame([(network, m % 2, T + dt.timedelta(minutes=m), float(m), m % 3 == 0) for m in minutes], FACTS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batch_and_stream_agree_and_a_restart_loses_nothing(spark, tmp_path):
    every, source = [], str(tmp_path / "in")
    for lot in (range(0, 100), range(90, 200), range(195, 400)):
        some = facts(spark, lot)
        every.append(some)
        some.write.mode("append").parquet(source)
        stream = spark.readStream.schema(FACTS).parquet(source)
        event_time.line_hours(stream, str(tmp_path / "out"), availableNow=True).awaitTermination()  # a run each, from the last one's state
    batch = marts.line_loading_hourly(every[0].unionByName(every[1]).unionByName(every[2]))
    closed = F.col("hour_bucket") + F.expr("interval 1 hour") <= F.lit(T + dt.timedelta(minutes=389)).cast("timestamp_ntz")
    assert rows(event_time.hours_until(spark, str(tmp_path / "out"))) == rows(batch.filter(closed)) != []


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, lot in enumerate(([0, 5, 200], [3, 195, 201, 210], [190, 205, 211])):
        facts(spark, lot, "a").unionByName(facts(spark, [m // 50 for m in lot], "b")).coalesce(1).write.mode("append").parquet(source)
        counted = event_time.lateness(spark.readStream.schema(FACTS).parquet(source), ["network"], late_seconds=600)
        save = lambda some, batch, i=i: some.write.mode("overwrite").parquet(str(tmp_path / f"late/{i}-{batch}"))
        counted.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = {r.network: (r.rows, r.late_rows, r.newest) for r in spark.read.parquet(*(str(tmp_path / "late" / x) for x in os.listdir(tmp_path / "late") if x.startswith("2-"))).collect()}
    assert last == {"a": (10, 2, T + dt.timedelta(minutes=211)), "b": (10, 0, T + dt.timedelta(minutes=4))}  # 3 and 190 came late
    sharded = event_time.lateness(spark.readStream.schema(FACTS).parquet(source), ["network"], shards=3)
    assert sharded.columns == ["network", "shard", "newest", "rows", "late_rows"]


def test_repeated_messages(spark, tmp_path):
    schema = "topic string, kafka_partition int, kafka_offset long, ingestion_timestamp string, event_timestamp timestamp"
    landed = spark.createDataFrame([("t", 0, 1, "a", T), ("t", 0, 1, "a", T), ("t", 0, 1, "b", T), ("t", 0, 2, "a", T)], schema)
    assert event_time.once(landed).count() == 2 and event_time.once(landed, "reference").count() == 3
    with pytest.raises(ValueError):
        event_time.once(landed, "hash")
    landed.write.parquet(str(tmp_path / "in"))
    for key, n in (("offset", 2), ("reference", 3)):
        stream = event_time.once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), key)
        event_time.closed_hours(stream, str(tmp_path / key), availableNow=True).awaitTermination()
        assert event_time.hours_until(spark, str(tmp_path / key)).count() == n


def test_a_batch_that_fails_between_sinks_leaves_each_once(spark, tmp_path):
    batch, path = spark.range(10).selectExpr("id as step", "id * 2 as x"), str(tmp_path)
    calls = []

    def breaks(rows, folder):
        rows.limit(3).write.mode("overwrite").parquet(folder)  # half done
        raise OSError("the sink is away")

    def counted(rows, folder):
        calls.append(folder)
        sinks.json_lines(rows, folder)

    with pytest.raises(OSError):
        sinks.fan_out(batch, 0, path, {"a": counted, "b": breaks, "c": sinks.producer_rows})
    assert sinks.committed(spark, path, "a").count() == 10
    assert sinks.fan_out(batch, 0, path, {"a": counted, "b": sinks.parquet_rows, "c": sinks.producer_rows}) == ["b", "c"]
    assert sinks.fan_out(batch, 0, path, {"a": counted, "b": sinks.parquet_rows}) == [] and len(calls) == 1
    sinks.parquet_rows(batch, f"{path}/b/batch=1")  # written, never committed
    assert sinks.committed(spark, path, "b").count() == 10
    sent = sinks.committed(spark, path, "c").orderBy("key").first()
    assert bytes(sent.key) == b"0" and bytes(sent.value) == b'{"step":0,"x":0}'


def test_days_are_replaced_alone_and_pruned(spark, tmp_path):
    path = str(tmp_path / "days")
    rows_ = spark.range(300).selectExpr("id % 7 as place", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 15) as ts", "id as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put together again
    sinks.write_days(rows_, path, "ts", ["place"], rows_a_file=40)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path) if f.startswith("day=")}
    assert len(before) == 4 and len([x for x in os.listdir(f"{path}/day=2024-01-01") if x.endswith(".parquet")]) > 1  # a day is dealt to several tasks
    sinks.write_days(rows_.filter("ts >= timestamp_ntz'2024-01-02 00:00:00' and ts < timestamp_ntz'2024-01-02 06:00:00'"), path, "ts", ["place"])
    assert sinks.read_days(spark, path).groupBy("day").count().orderBy("day").collect() == [(dt.date(2024, 1, 1), 96), (dt.date(2024, 1, 2), 24), (dt.date(2024, 1, 3), 96), (dt.date(2024, 1, 4), 12)]
    scan = sinks.read_days(spark, path, "2024-01-02", "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in scan and sinks.read_days(spark, path, "2024-01-03").count() == 108
    one = spark.read.parquet(f"{path}/day=2024-01-02").collect()
    assert [r.place for r in one] == sorted(r.place for r in one)
    sinks.write_days(rows_.limit(1).selectExpr("place", "cast(null as timestamp_ntz) as ts", "v"), path, "ts", ["place"])
    assert sinks.read_days(spark, path).filter("day is null").count() == 1


def test_landed_lines_have_the_same_keys_whatever_the_splits(spark, tmp_path):
    from gridloom.sources import bronze

    lines = [f'{{"n": {i}, "pad": "{"x" * (i % 50)}"}}' for i in range(2000)]
    lines[7] = "  "
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.jsonl").write_text("\n".join(lines))
    os.utime(tmp_path / "one" / "a.jsonl", (1e9, 1e9))

    def keys(path, **conf):
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.files.{k}", v)
        got = {(r.value, r.partition, r.offset) for r in bronze.jsonl_messages(spark, path).collect()}
        for k in conf:
            spark.conf.unset(f"spark.sql.files.{k}")
        return got

    alone = keys(str(tmp_path / "one" / "a.jsonl"))
    numbers = {bytes(v).decode(): o & (2**40 - 1) for v, _, o in alone}
    assert numbers == {x: i for i, x in enumerate(lines) if x.strip()}  # a running number, blank lines counted but not landed
    assert keys(str(tmp_path / "one" / "a.jsonl"), maxPartitionBytes="3000", openCostInBytes="10") == alone
    (tmp_path / "one" / "b.jsonl").write_text("\n".join(lines))
    both = keys(str(tmp_path / "one"), maxPartitionBytes="9000")
    assert alone < both and len({(p, o) for _, p, o in both}) == 2 * len(alone)
