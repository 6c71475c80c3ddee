"""Queries over measurement files: Spark writes ``events`` in each dataset's own layout, and its format reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship
from ..sources import formats
from .catalogue import hour_of, query, read


def _place(spark: SparkSession, name: str) -> str:
    ship(spark)
    formats.register(spark)
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""select 'M' || user_id as series_id, date_trunc('second', ts) as ts_utc, case when event_id % 19 <> 0 then round(value * 2, 6) end as value
from events where event_type <> 'view' and date_trunc('second', ts) >= timestamp '2024-01-03 00:00:00' and 'M' || user_id in ('M3', 'M17', 'M42', 'M8')""")
def source_smart_meter(spark, d):
    path = _place(spark, "meter")
    kwh = F.when(F.col("event_id") % 19 == 0, "Null").otherwise(F.col("value").cast("string"))
    tariff = F.when(F.col("event_type") == "view", "ToU").otherwise("Std")
    home = F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("LCLid")
    lines = read(spark, d, "events").select(home, tariff.alias("stdorToU"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.'0000000'").alias("DateTime"), kwh.alias("KWH/hh (per half hour) "))
    lines.write.csv(path, header=True)
    rows = spark.read.format("smart_meter").option("start", "2024-01-03").option("split_mb", 1).load(path)
    return rows.filter(F.col("series_id").isin("M3", "M17", "M42", "M8")).select("series_id", "ts_utc", F.round("value", 6).alias("value"))


_SLOT = "to_minutes(30 * (hour(ts) * 2 + minute(ts) // 30)::int)"


@query(f"""with c as (select user_id, case when event_type = 'view' then 'pv' else 'load' end as kind, date_trunc('day', ts) + {_SLOT} - interval 10 hour as ts_utc, round(sum(value) * 2, 6) as value from events group by all),
g as (select distinct user_id, case when event_type = 'view' then 'pv' else 'load' end as kind, date_trunc('day', ts) + to_minutes(30 * s::int) - interval 10 hour as ts_utc from events, range(48) t(s)),
missing as (select distinct user_id, date_trunc('day', ts) as day, case when event_type = 'view' then 'GG' when event_type = 'click' then 'CL' else 'GC' end as channel from events),
n as (select user_id, case when channel = 'GG' then 'pv' else 'load' end as kind, day + to_minutes(30 * s::int) - interval 10 hour as ts_utc, count(*) as channels from missing, range(48) t(s) group by all),
have as (select user_id, case when event_type = 'view' then 'pv' else 'load' end as kind, date_trunc('day', ts) + {_SLOT} - interval 10 hour as ts_utc, count(distinct case when event_type = 'view' then 'GG' when event_type = 'click' then 'CL' else 'GC' end) as there from events group by all)
select 'c' || lpad(user_id::varchar, greatest(3, length(user_id::varchar))::int, '0') as series_id, kind, ts_utc, case when there = channels then value end as value
from g join n using (user_id, kind, ts_utc) left join have using (user_id, kind, ts_utc) left join c using (user_id, kind, ts_utc)""")
def source_solar_homes(spark, d):
    path = _place(spark, "homes")
    channel = F.when(F.col("event_type") == "view", "GG").when(F.col("event_type") == "click", "CL").otherwise("GC")
    slot = F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)
    names = [f"{m // 60 % 24}:{m % 60:02d}" for m in range(30, 1441, 30)]
    cells = [F.sum(F.when(F.col("slot") == k, F.col("value"))).alias(c) for k, c in enumerate(names)]
    days = read(spark, d, "events").select(F.col("user_id").alias("Customer"), channel.alias("Consumption Category"), F.date_format("ts", "d/MM/yyyy").alias("date"), slot.alias("slot"), "value")
    days.groupBy("Customer", "Consumption Category", "date").agg(*cells).write.csv(path, header=True)
    rows = formats.added_up(spark.read.format("solar_homes").option("zone", "Australia/Brisbane").option("split_mb", 4).load(path))
    return rows.select("series_id", "kind", "ts_utc", F.round("value", 6).alias("value"))


@query("""with h as (select event_type, strftime(ts, '%Y-%m-%d %H:00:00')::timestamp as ts_utc, avg(value) as v, max(value) as t from events group by 1, 2)
select event_type, 'irradiance' as kind, ts_utc, case when v > 20 then round(v, 8) end as value from h union all select event_type, 'temperature', ts_utc, round(t, 8) from h""")
def source_hourly_map_api(spark, d):
    path = _place(spark, "map-api")
    hour = F.date_format("ts", "yyyyMMddHH")
    h = read(spark, d, "events").groupBy("event_type", hour.alias("h")).agg(F.avg("value").alias("v"), F.max("value").alias("t")).withColumn("v", F.when(F.col("v") > 20, F.col("v")).otherwise(-999.0))
    hours = lambda c: F.map_from_entries(F.collect_list(F.struct("h", c)))
    both = h.groupBy("event_type").agg(hours("v").alias("a"), hours("t").alias("b"))  # one document a station: an hour is a row
    parameter = F.struct(F.struct(F.col("a").alias("ALLSKY_SFC_SW_DWN"), F.col("b").alias("T2M")).alias("parameter"))
    doc = F.to_json(F.struct(parameter.alias("properties"), F.struct(F.lit(-999.0).alias("fill_value"), F.lit("UTC").alias("time_standard")).alias("header")))
    both.select("event_type", doc.alias("value")).repartition("event_type").write.partitionBy("event_type").format("text").save(path)
    return _of_stations(spark, "hourly_map_api", path)


def _of_stations(spark: SparkSession, source: str, path: str) -> DataFrame:
    rows = spark.read.format(source).option("series", "file").load(path)
    return rows.select(F.regexp_extract("series_id", "event_type=([^/]*)/", 1).alias("event_type"), "kind", "ts_utc", F.round("value", 8).alias("value"))


@query("""with h as (select event_type, date_trunc('hour', ts) as ts_utc, avg(value) as v, max(value) as t from events group by 1, 2)
select event_type, 'pv' as kind, ts_utc, round(v / 2500, 8) as value from h union all select event_type, 'temperature', ts_utc, round(t, 8) from h""")
def source_hourly_record_api(spark, d):
    path = _place(spark, "record-api")
    h = read(spark, d, "events").groupBy("event_type", hour_of().alias("h")).agg(F.avg("value").alias("P"), F.max("value").alias("T2m"))
    record = F.struct(F.date_format("h", "yyyyMMdd:HH'10'").alias("time"), "P", "T2m")
    docs = h.groupBy("event_type").agg(F.collect_list(record).alias("hourly"))  # one document a station: an hour is a record
    doc = F.to_json(F.struct(F.struct(F.struct(F.lit(2.5).alias("peak_power")).alias("pv_module")).alias("inputs"), F.struct("hourly").alias("outputs")))
    docs.select("event_type", doc.alias("value")).repartition("event_type").write.partitionBy("event_type").format("text").save(path)
    return _of_stations(spark, "hourly_record_api", path)


@query("""with s as (select time_bucket(interval 15 minute, ts) as ts_utc, event_type, round(avg(value), 6) as value from events where event_type in ('click', 'view', 'error') group by 1, 2),
slots as (select distinct time_bucket(interval 15 minute, ts) as ts_utc from events), names(event_type, kind, series_id) as (values ('click', 'load', 'H0_pload'), ('view', 'reactive', 'H0_qload'), ('error', 'pv', 'PV1'))
select kind, series_id, ts_utc, value from slots cross join names left join s using (ts_utc, event_type) where kind <> 'reactive'""")
def source_profile_table(spark, d):
    path = _place(spark, "profiles")
    quarter = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900).cast("timestamp_ntz")
    mean = lambda kind, name: F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6).alias(name)
    slots = read(spark, d, "events").groupBy(quarter.alias("at")).agg(mean("click", "H0_pload"), mean("view", "H0_qload"), mean("error", "PV1"))
    wall = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), "at"), "dd.MM.yyyy HH:mm")
    # one file in order of time, as repeated hours ask for: a row a quarter of an hour
    slots.withColumn("time", wall).coalesce(1).sortWithinPartitions("at").select("time", "H0_pload", "H0_qload", "PV1").write.csv(path, header=True, sep=";")
    rows = spark.read.format("profile_table").load(path).filter("kind in ('load', 'pv')")
    return rows.select("kind", "series_id", "ts_utc", "value")


@query("""with m as (select user_id, max(value) as kwp from events group by 1), b as (select user_id, min(ts) as s, min(ts) + interval 5 day as e from events where user_id % 10 = 0 group by 1)
select user_id::varchar as series_id, date_trunc('second', ts) - interval 30 minute as ts_utc, round(value * 1.9, 6) as value from events join m using (user_id)
where date_trunc('second', ts) - interval 30 minute >= timestamp '2024-01-02' and date_trunc('second', ts) - interval 30 minute < timestamp '2024-01-20' and value * 1.9 <= 1.5 * kwp
 and not exists (select 1 from b where b.user_id = events.user_id and date_trunc('second', ts) between date_trunc('second', s) and date_trunc('second', e))""")
def source_pv_fleet(spark, d):
    path = _place(spark, "fleet")
    e = read(spark, d, "events").select(F.col("user_id").alias("ss_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("datetime_GMT"), "value")
    e.select("ss_id", "datetime_GMT", (F.col("value") * 950).alias("generation_Wh"), F.year("datetime_GMT").alias("year"), F.month("datetime_GMT").alias("month")).write.partitionBy("year", "month").parquet(f"{path}/data")
    e.groupBy("ss_id").agg(F.max("value").alias("kWp")).write.csv(f"{path}/metadata.csv", header=True)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    bad = e.filter("ss_id % 10 = 0").groupBy("ss_id").agg(F.min("datetime_GMT").alias("s"))
    bad.select("ss_id", stamp("s").alias("start_datetime_GMT"), stamp(F.col("s") + F.expr("interval 5 day")).alias("end_datetime_GMT")).write.csv(f"{path}/bad_data.csv", header=True)
    rows = spark.read.format("pv_fleet").options(start="2024-01-02", end="2024-01-20").load(path)
    return rows.select("series_id", "ts_utc", F.round("value", 6).alias("value"))


@query("""with h as (select event_type, date_trunc('hour', ts) as ts_utc, avg(value) as v, max(value) as t from events group by 1, 2)
select event_type, 'irradiance' as kind, ts_utc, case when v > 20 then round(v / 3.6, 8) end as value from h union all select event_type, 'temperature', ts_utc, round(t, 8) from h""")
def source_weather_station(spark, d):
    path = _place(spark, "station")
    h = read(spark, d, "events").groupBy("event_type", hour_of().alias("at")).agg(F.avg("value").alias("v"), F.max("value").alias("t"))
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    ended = F.col("at") + F.expr("interval 1 hour")
    lines = h.select(
        "event_type", F.date_format(ended, "yyyy/MM/dd").alias("Data"), F.date_format(ended, "HHmm 'UTC'").alias("Hora UTC"), F.lit("0").alias("CHUVA (mm)"),
        F.when(F.col("v") > 20, comma(F.col("v"))).otherwise("-9999").alias("RADIACAO GLOBAL (Kj/m2)"), comma(F.col("t")).alias("TEMPERATURA DO AR - BULBO SECO"),
    )
    lines.repartition("event_type").write.partitionBy("event_type").csv(path, header=True, sep=";")
    rows = spark.read.format("weather_station").load(path)  # its series are files
    return rows.select(F.regexp_extract("series_id", "event_type=([^/]*)/", 1).alias("event_type"), "kind", "ts_utc", F.round("value", 8).alias("value"))


