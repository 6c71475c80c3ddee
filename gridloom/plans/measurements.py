"""Queries over landed messages, quality rules of series, a study's series, and the reads that take a range of time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, quality, study_series
from ..serving import reads, results
from ..session import shared_folder
from ..sources import bronze
from ..streaming import marts as stream_marts
from . import served
from .catalogue import query, read


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- landing ---------------------------------------------------------------------------------------------------------


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """An event as a step's telemetry: two buses, a line, a generator or none."""
    u, v = F.col("user_id"), F.col("value")
    entry = lambda k, x: F.create_map(k.cast("string"), x)
    buses = F.map_concat(entry(u % 20, 0.9 + v / 500), entry(F.lit("out"), F.lit(1.0)))
    return read(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("event_id").cast("int").alias("step"), F.col("event_type").alias("network"), buses.alias("bus_voltage_pu"),
        F.when(F.col("event_id") % 3 != 0, entry(u % 20, v)).alias("line_loading_percent"), F.when(F.col("event_id") % 4 == 0, entry(u % 7, v / 10)).alias("gen_power_mw"),
        v.alias("total_load_mw"), (u % 10).cast("double").alias("total_generation_mw"), F.when(F.col("event_id") % 9 == 0, F.array(F.lit("line_3"))).alias("active_contingencies"),
    )


def _landed(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry as lines of JSON, landed twice in the lake, and staged."""
    path = _place(spark, "landed")
    _payloads(spark, d).write.json(f"{path}/in")
    for _ in range(2):
        bronze.write_bronze(bronze.bronze_rows(bronze.jsonl_messages(spark, f"{path}/in")), f"{path}/lake")
    return bronze.staged(bronze.read_bronze(spark, f"{path}/lake"))


@query("""with v as (select event_type as network, user_id % 20 as bus_id, ts, 0.9 + value / 500 as pu from events), s as (select 'click' as network, unnest(range(10)) as bus_id),
f as (select v.*, s.bus_id is not null as in_scope, case when s.bus_id is null then false else pu < 0.92::double or pu > 1.05::double end as bad from v left join s using (network, bus_id))
select network, bus_id::int as bus_id, date_trunc('hour', ts) as hour, min(pu) as min_value, max(pu) as max_value, bool_or(in_scope) as in_scope, count(*) as readings, count(*) filter (bad) as violations, round(100.0::double * (count(*) filter (bad)) / nullif(count(*) filter (in_scope), 0), 2) as violation_rate from f group by all""")
def medallion_voltage_hourly(spark, d):
    """From lines of JSON to the hourly mart; what was landed twice counts once, and entries without a bus number go."""
    limits = spark.createDataFrame([("click", 0.92, 1.05)], "network string, v_min_pu double, v_max_pu double")
    scope = spark.createDataFrame([("click", b) for b in range(10)], "network string, bus_id int")
    facts = bronze.bus_voltage(_landed(spark, d), limits, scope).filter("bus_id is not null")
    made = bronze.voltage_quality_hourly(facts).drop("avg_value", "stddev_value")
    return made.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""select event_type as network, event_id::int as step, user_id % 20 as line_id, value as loading_percent, value > 100 as is_overloaded, null as gen_id, null as power_mw from events where event_id % 3 <> 0 union all
select event_type, event_id::int, null, null, null, user_id % 7, value / 10 from events where event_id % 4 = 0""")
def medallion_entries(spark, d):
    """Lines and generators of the staged telemetry, a row an entry; a step without the map has none."""
    stage = _landed(spark, d)
    line = bronze.line_loading(stage).select("network", "step", F.col("line_id").cast("long").alias("line_id"), "loading_percent", "is_overloaded", F.lit(None).cast("long").alias("gen_id"), F.lit(None).cast("double").alias("power_mw"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    return line.unionByName(bronze.generator_power(stage).select("network", "step", none("line_id", "long"), none("loading_percent", "double"), none("is_overloaded", "boolean"), F.col("gen_id").cast("long").alias("gen_id"), "power_mw"))


@query("select event_id::int as step, value as total_load_mw, (user_id % 10)::double as total_generation_mw, round((user_id % 10)::double - value, 9) as power_balance_mw, event_id % 9 = 0 as has_contingency, ts as event_timestamp from events")
def medallion_grid_summary(spark, d):
    made = bronze.grid_summary(_landed(spark, d)).drop("network")
    return made.withColumns({"power_balance_mw": F.round("power_balance_mw", 9), "event_timestamp": F.col("event_timestamp").cast("timestamp_ntz")})


@query("select case when event_id % 6 = 0 then 'alerts' else 'grid.telemetry.raw' end as topic, count(*) as n from events group by 1")
def stream_landed(spark, d):
    """Messages of two topics landed by a stream that comes twice over the same input; the lake's own count of them."""
    path = _place(spark, "stream-landed")
    topic = F.when(F.col("event_id") % 6 == 0, "alerts").otherwise(bronze.TOPIC)
    messages = read(spark, d, "events").select(topic.alias("topic"), F.lit(None).cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))
    messages.write.parquet(f"{path}/in")
    for _ in range(2):
        stream_marts.land(stream_marts.message_stream(spark, "parquet", path=f"{path}/in"), f"{path}/lake", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return reads.topic_counts(bronze.read_bronze(spark, f"{path}/lake"))


# --- reads by time and by field --------------------------------------------------------------------------------------


@query(served._VOLT + " select network, bus_id, hour_bucket, n_readings, violation_rate_pct from v where hour_bucket between timestamp '2024-01-03 05:00:00' and timestamp '2024-01-09 17:00:00' and network = 'click'")
def voltage_between(spark, d):
    made = reads.voltage_between(served.voltage(spark, d), "2024-01-03 05:00:00", "2024-01-09 17:00:00", "click")
    return made.select("network", "bus_id", "hour_bucket", "n_readings", "violation_rate_pct")


@query(served._RUN + " select run_id, 'verification' as field from m where run_id % 4 <> 1 union all select run_id, 'phase_model' from m where run_id % 3 = 0 union all select run_id, 'series_source' from m where run_id % 4 <> 0")
def payload_fields(spark, d):
    """Which fields a payload holds at all, whatever their values."""
    raw = served.raw_results(spark, d)
    parts = [reads.having_field(raw, f).select("run_id", F.lit(f).alias("field")) for f in ("verification", "phase_model", "series_source")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""with j as (select o_orderkey as cell, case when o_orderkey % 6 <> 0 then case when o_orderkey % 5 = 0 then 'qsts' else 'deterministic' end end as method, o_orderkey % 7 as rc, o_totalprice / 1e5 as lam from orders)
select cell, case when method is null then '-' else method end as method, case when method is null then 'rc=' || rc else 'ok' end as status, case when method is not null then lam end as lambda_max,
case when method is not null then case when cell % 3 = 0 then 'series/a' when cell % 3 = 1 then 'n1|profiles:2016-06-01+28d' else 'snapshot:n1' end end as series_key, case when cell % 2 = 0 then 'keep' else 'remove' end as existing_pv from j""")
def flat_cells(spark, d):
    """A row a cell and method; cells without a result say how they ended."""
    k, o = F.col("o_orderkey"), read(spark, d, "orders")
    cells = o.select(
        k.alias("cell"), (k % 7).alias("returncode"), F.lit("n1").alias("network"), F.when(k % 3 == 0, "series/a").alias("qsts_series"), F.lit("2016-06-01").alias("qsts_start"), F.lit(28).alias("qsts_days"), (k % 3 == 1).alias("qsts_network_profiles"),
        F.lit(None).cast("int").alias("block_average_min"), F.when(k % 2 == 0, "keep").alias("existing_pv"), F.lit(1.0).alias("seconds"),
    )
    payload = F.to_json(F.struct(F.lit("ok").alias("status"), (F.col("o_totalprice") / 1e5).alias("lambda_max")))
    found = o.filter(k % 6 != 0).select(k.alias("cell"), F.when(k % 5 == 0, "qsts").otherwise("deterministic").alias("method"), payload.alias("raw_value"))
    return results.flatten(cells, found).select("cell", "method", "status", "lambda_max", "series_key", "existing_pv")


# --- quality of series -----------------------------------------------------------------------------------------------


def _series(spark: SparkSession, d: str) -> DataFrame:
    mean = F.when(F.max("value") < 200, F.avg("value") * 5)
    return read(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts_utc")).agg(mean.alias("value"))


_SERIES_SQL = "h as (select event_type as series_id, date_trunc('hour', ts) as ts_utc, case when max(value) < 200 then avg(value) * 5 end as value from events group by all)"
_SUN_SQL = """g as (select *, ts_utc + interval 30 minute as mid, 2 * pi() * (dayofyear(ts_utc + interval 30 minute) - 1) / case when dayofmonth(last_day(make_date(year(ts_utc), 2, 1))) = 29 then 366.0::double else 365.0::double end as a from h),
z as (select *, 0.006918 - 0.399912 * cos(a) + 0.070257 * sin(a) - 0.006758 * cos(2 * a) + 0.000907 * sin(2 * a) - 0.002697 * cos(3 * a) + 0.00148 * sin(3 * a) as dec,
 229.18 * (0.000075 + 0.001868 * cos(a) - 0.032077 * sin(a) - 0.014615 * cos(2 * a) - 0.040849 * sin(2 * a)) as eot from g),
m as (select *, sin(radians(-22.9)) * sin(dec) + cos(radians(-22.9)) * cos(dec) * cos(radians((hour(mid) * 60.0::double + minute(mid) + eot + 4.0 * -43.2) / 4.0 - 180)) as mu, 1361.0 * (1 + 0.033 * cos(a)) as flux from z)"""


@query(f"""with {_SERIES_SQL}, {_SUN_SQL}, l as (select *, case when mu <= 0 then case when value is not null then 0.0::double end else value end as lit, 1.5 * flux * pow(greatest(mu, 0), 1.2::double) + 100 as possible, 1.2 * flux * pow(greatest(mu, 0), 1.2::double) + 50 as seldom from m)
select series_id, ts_utc, round(case when lit <= possible then lit end, 6) as value, coalesce(lit > seldom and lit <= possible, false) as rare from l""")
def irradiance_checked(spark, d):
    """Night is dark, what no sky gives is null, what it seldom gives is marked."""
    return quality.check_irradiance(_series(spark, d), -22.9, -43.2).select("series_id", "ts_utc", F.round("value", 6).alias("value"), "rare")


@query(f"with {_SERIES_SQL} select series_id, round(avg((value is not null)::int), 9) as completeness, count(*) filter (value is null) as nulls from h group by 1 having avg((value is not null)::int) >= 0.5")
def series_completeness(spark, d):
    return quality.completeness(_series(spark, d), 0.5).withColumn("completeness", F.round("completeness", 9))


@query("select event_id, case when value - 20 >= 0 then value - 20 when value - 20 >= -1.5 then 0.0 end as value from events")
def clipped_values(spark, d):
    return read(spark, d, "events").select("event_id", quality.clip_negative(F.col("value") - 20, 1.5).alias("value"))


@query("""with e as (select event_type, date_trunc('minute', ts) as m, floor(value / 50) as v from events), x as (select event_type, m, v, count(*) as k from e group by all), s as (select event_type, m, sum(k) as n, sum(case when k > 1 then k else 0 end) as same from x group by all having sum(k) > 1)
select coalesce(sum(n), 0)::bigint as rows_sharing_stamp, coalesce(sum(same), 0)::bigint as exact_copies from s""")
def repeated_stamps(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("minute", "ts").alias("ts_utc"), F.floor(F.col("value") / 50).alias("value"))
    return quality.duplicate_census(rows)


@query(f"""with {_SERIES_SQL}, {_SUN_SQL}, n as (select series_id, count(*) filter (value > 0.02 * 5000) as lit, count(*) as steps from m where mu <= 0 group by 1) select series_id from n where lit > 0.02 * steps""")
def lit_at_night(spark, d):
    rows = _series(spark, d)
    peaks = rows.select("series_id").distinct().withColumn("kwp", F.lit(5000.0))
    return quality.night_faulty(rows, peaks, -22.9, -43.2)


@query("select user_id % 50 as place, case when count(*) > 2 then round(corr(value, event_id % 100), 6) end as r from events where event_id % 100 > 0 group by 1")
def daylight_correlations(spark, d):
    rows = read(spark, d, "events").select((F.col("user_id") % 50).alias("place"), "value", (F.col("event_id") % 100).cast("double").alias("pv"))
    return aggregates.daylight_correlation(rows, "place", "value", "pv").withColumn("r", F.round("r", 6))


# --- a study's series ------------------------------------------------------------------------------------------------


@query("""with e as (select 'home' || (user_id % 5) as series_id, date_trunc('hour', ts) as ts, avg(value) as v from events group by all), l as (select ts, avg(v) * 5 as total from e group by 1),
p as (select date_trunc('hour', ts) as ts, sum(x * kwp) / sum(kwp) as pv from (select 'sys' || (user_id % 3) as series_id, 1.0 + user_id % 3 as kwp, date_trunc('hour', ts) as ts, avg(least(value / 300, 1)) as x from events group by all) group by 1),
t as (select unnest(generate_series(timestamp '2024-01-08', timestamp '2024-01-14 23:00:00', interval 1 hour)) as ts), top as (select max(total) as peak from l),
lf as (select t.ts, median(total) as total from t join l on l.ts::time = t.ts::time and abs(date_diff('day', l.ts::date, t.ts::date)) <= 7 where not exists (select 1 from l where l.ts = t.ts) group by 1),
pf as (select t.ts, median(pv) as pv from t join p on p.ts::time = t.ts::time and abs(date_diff('day', p.ts::date, t.ts::date)) <= 7 where not exists (select 1 from p where p.ts = t.ts) group by 1),
la as (select * from l union all select * from lf), pa as (select * from p union all select * from pf)
select (epoch(t.ts - timestamp '2024-01-08') / 3600)::int as step, t.ts as local_time, round(0.8 * total / peak, 8) as load_mult, round(case when pv < 0.0001 then 0 else least(pv, 1) end, 8) as pv_mult from t join la using (ts) join pa using (ts), top""")
def study_week(spark, d):
    """A week of load and PV out of five homes and three systems, built, saved, read back by its digests.

    Hours that no home or system reports are filled by climatology.
    """
    e = read(spark, d, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts_utc")
    homes = e.groupBy(F.concat(F.lit("home"), (F.col("user_id") % 5).cast("string")).alias("series_id"), hour).agg(F.avg("value").alias("value"))
    kwp = F.col("user_id") % 3
    systems = e.groupBy(F.concat(F.lit("sys"), kwp.cast("string")).alias("series_id"), hour).agg(F.avg(F.least(F.col("value") / 300, F.lit(1.0))).alias("value"))
    capacities = e.select(F.concat(F.lit("sys"), kwp.cast("string")).alias("series_id"), (1.0 + kwp).alias("kwp")).distinct()
    site = study_series.Site(-22.9, -43.2, 0.0)
    made, manifest = study_series.build_series(study_series.Source("homes", homes, 3600), study_series.Source("systems", systems, 3600, "pv", capacities=capacities), site, "2024-01-08", 7, 24, peak_load_mult=0.8)
    path = _place(spark, "study")
    study_series.save_series(made, manifest, path)
    again, _ = study_series.load_series(spark, path)
    return again.select("step", "local_time", F.round("load_mult", 8).alias("load_mult"), F.round("pv_mult", 8).alias("pv_mult"))


