"""Queries over networks, streams, sinks, contracts and experiments, all derived from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocation, hosting, quality_gate, quantiles, relational, violations
from ..serving import assertions, contract, experiments
from ..session import shared_folder
from ..sources import networks
from ..streaming import event_time, sinks
from . import served
from .catalogue import query, read


#: Where a session's network documents lie, written once for each folder of tables.
_DOCUMENTS: dict[tuple[str, str], str] = {}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- networks ------------------------------------------------------------------------------------------------------

_NET_SQL = """l as (select 's' || l_suppkey as network, l_orderkey * 8 + l_linenumber as load_id, l_partkey as bus, l_quantity / 1000.0::double as p_mw, case when l_linenumber % 2 = 0 then 'H0' else 'G1' end as profile, l_returnflag from lineitem),
b as (select distinct network, bus, case when bus % 3 = 0 then 20.0::double else 0.4::double end as vn_kv, bus % 11 <> 0 as in_service from l),
e as (select network, min(bus) as bus from l group by 1), g as (select network, bus from b where bus % 17 = 0 and bus % 2 = 0)"""


def _elements(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A network a supplier: its parts are buses, its order lines loads, returned ones PV units."""
    made = read(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("network"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_partkey").alias("bus"),
        (F.col("l_quantity") / F.lit(1000.0)).alias("p_mw"), F.when(F.col("l_linenumber") % 2 == 0, "H0").otherwise("G1").alias("profile"), "l_returnflag",
    )
    on, unnamed = F.lit(True).alias("in_service"), F.lit(None).cast("string").alias("name")
    bus = made.select("network", F.col("bus").alias("bus_id")).distinct()
    kv = F.when(F.col("bus_id") % 3 == 0, 20.0).otherwise(0.4)
    return {
        "bus": bus.select("network", "bus_id", unnamed, kv.alias("vn_kv"), (F.col("bus_id") % 11 != 0).alias("in_service")),
        "load": made.select("network", F.col("id").alias("load_id"), unnamed, "bus", "p_mw", F.lit(0.0).alias("q_mvar"), on, "profile"),
        "sgen": made.filter("l_returnflag = 'R'").select("network", F.col("id").alias("sgen_id"), unnamed, "bus", "p_mw", F.lit("PV").alias("type"), on, F.when(F.col("bus") % 2 == 0, "PV1").otherwise("PV2").alias("profile")),
        "gen": bus.filter("bus_id % 17 = 0").select("network", F.col("bus_id").alias("gen_id"), unnamed, F.col("bus_id").alias("bus"), F.lit(1.0).alias("p_mw"), F.lit(1.0).alias("vm_pu"), (F.col("bus_id") % 2 == 0).alias("in_service")),
        "ext_grid": bus.groupBy("network").agg(F.min("bus_id").alias("bus")).select("network", F.lit(0).cast("long").alias("ext_grid_id"), unnamed, "bus", F.lit(1.0).alias("vm_pu"), on),
    }


def _documents(spark: SparkSession, d: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, d)
    if key not in _DOCUMENTS:
        path = _place(spark, "networks")
        networks.documents_of(_elements(spark, d)).select(F.col("text").alias("value")).write.text(path, compression="gzip")
        _DOCUMENTS[key] = path
    return networks.network_lines(spark, _DOCUMENTS[key])


@query(f"with {_NET_SQL} select network, bus as bus_id from b where in_service and (vn_kv = 0.4::double or (network like '%7' and vn_kv = 20.0::double)) and (network, bus) not in (select (network, bus) from e) and (network, bus) not in (select (network, bus) from g)")
def network_scope(spark, d):
    """Buses whose voltages are judged, out of network documents and a registry that gives some networks a second level."""
    documents = _documents(spark, d)
    about = spark.createDataFrame([], "path string, " + networks.SIDECAR)
    levels = F.when(F.endswith("network", F.lit("7")), F.array(F.lit(0.4), F.lit(20.0))).otherwise(F.array(F.lit(0.4)))
    known = networks.registry(documents, about, documents.select("network", F.lit("own").alias("framework"), levels.alias("levels")), frameworks=["own"])
    return networks.voltage_scope(networks.tables(documents), known.filter("problem is null"))


@query(f"with {_NET_SQL} select network, bus as bus_id, round(sum(p_mw), 9) as base_mw from l group by all")
def network_basis(spark, d):
    return allocation.proportional_to_load(networks.loads_of(networks.tables(_documents(spark, d)))).withColumn("base_mw", F.round("base_mw", 9))


_PROFILES_SQL = """pr as (select case o_orderkey // 96 % 4 when 0 then 'H0_pload' when 1 then 'G1_pload' when 2 then 'PV1' else 'PV2' end as series_id, timestamp '2016-06-01' + to_minutes(15 * (o_orderkey % 96)::int) as ts, round(avg(o_totalprice) / 5e5, 9) as value from orders group by all)"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """A day of quarter hours for two load and two PV profiles."""
    k = F.floor(F.col("o_orderkey") / 96) % 4
    name = F.when(k == 0, "H0_pload").when(k == 1, "G1_pload").when(k == 2, "PV1").otherwise("PV2")
    ts = F.lit("2016-06-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 96 * 15).cast("int"))
    made = read(spark, d, "orders").groupBy(name.alias("series_id"), ts.alias("ts_utc")).agg(F.round(F.avg("o_totalprice") / 5e5, 9).alias("value"))
    return made.withColumn("kind", F.when(F.endswith("series_id", F.lit("_pload")), "load").otherwise("pv"))


@query(f"""with {_NET_SQL}, {_PROFILES_SQL}, w as (select network, profile || '_pload' as series_id, sum(p_mw) as w from l group by all),
a as (select network, ts, greatest(sum(w * value) / sum(w), 1e-6) as load_mult from w join pr using (series_id) group by all),
u as (select network, case when bus % 2 = 0 then 'PV1' else 'PV2' end as series_id, sum(p_mw) as w from l where l_returnflag = 'R' group by all),
o as (select network, ts, sum(w * value) / sum(w) as pv from u join pr using (series_id) group by all),
m as (select ts, avg(value) as mean from pr where series_id like 'PV%' group by 1)
select network, ts, round(load_mult, 6) as load_mult, round(case when coalesce(pv, mean) < 0.0001 then 0 else least(coalesce(pv, mean), 1) end, 6) as pv_mult from a left join o using (network, ts) join m using (ts)""")
def network_own_series(spark, d):
    found = networks.tables(_documents(spark, d), existing_pv="keep")
    made = networks.own_series(found, _profiles(spark, d), "2016-06-01", 1)
    return made.select("network", "ts", F.round("load_mult", 6).alias("load_mult"), F.round("pv_mult", 6).alias("pv_mult"))


# --- violations and operating points ---------------------------------------------------------------------------------

_ELEMENT_SQL = """x as (select event_type, user_id % 10 as part, event_id, case event_id % 3 when 0 then 'bus' when 1 then 'line' else 'trafo' end as element,
 case when event_id % 3 = 0 then case when event_id % 97 = 0 then 'nan'::double else round(0.8 + value / 100, 4) end else floor(value) end as value, case when event_id % 5 = 0 then -1.0 else 1.0 end as power, event_id % 401 <> 0 as converged from events),
v as (select *, case when element = 'bus' then case when isnan(value) then 'isolated' when value < 0.95::double then 'undervoltage' when value > 1.05::double then 'overvoltage' end when value > case element when 'line' then 100 else 80 end then 'overload' end as violation from x),
y as (select *, case when violation = 'isolated' then 'infinity'::double when violation = 'overvoltage' then value / 1.05::double - 1 when violation = 'undervoltage' then 1 - value / 0.95::double when element = 'line' then value / 100 - 1 else value / 80 - 1 end as e,
 case when violation = 'isolated' then 0 when element = 'bus' then 1 when element = 'line' then 2 else 3 end as r,
 case when violation = 'isolated' then format('isolated@bus_{} (not energized)', event_id) when element = 'bus' then format('{}@bus_{} ({:.4f} pu)', violation, event_id, value) else format('{}_loading@{}_{} ({:.1f}%)', element, element, event_id, value) end as said from v)"""


@query(f"""with {_ELEMENT_SQL}, t as (select event_type, part, said, e, row_number() over (partition by event_type, part order by e desc, r, event_id) as n from y where violation is not null),
k as (select event_type, part, count(violation) as n_violations, count(*) filter (element = 'trafo' and power < 0) as n_reverse, bool_and(converged) as fine from y group by all)
select k.event_type, k.part, case when fine then said else 'power_flow_non_convergence' end as binding, case when isinf(e) then -1 else round(e, 9) end as exceedance, n_violations, n_reverse
from k left join t on t.event_type = k.event_type and t.part = k.part and t.n = 1""")
def binding_constraints(spark, d):
    k, value = F.col("event_id") % 3, F.col("value")
    kind = F.when(k == 0, "bus").when(k == 1, "line").otherwise("trafo")
    given = F.when(k != 0, F.floor(value).cast("double")).when(F.col("event_id") % 97 == 0, float("nan")).otherwise(F.round(0.8 + value / 100, 4))
    rows = read(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("part"), F.col("event_id").alias("element_id"), kind.alias("element"), given.alias("value"), F.lit(0.95).alias("lo"), F.lit(1.05).alias("hi"), F.when(F.col("event_id") % 5 == 0, -1.0).otherwise(1.0).alias("power"), (F.col("event_id") % 401 != 0).alias("converged"))
    made = violations.binding(rows, ["event_type", "part"], trafo_percent=80.0)
    return made.withColumn("exceedance", F.when(F.col("exceedance") == float("inf"), -1.0).otherwise(F.round("exceedance", 9)))


_POINT_SQL = "s as (select event_type, date_trunc('hour', ts) as step, round(avg(value) + 1, 6) as load_mult, round(avg(user_id % 50) / 50, 6) as pv_mult from events group by all)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return read(spark, d, "events").groupBy("event_type", hour.alias("step")).agg(F.round(F.avg("value") + 1, 6).alias("load_mult"), F.round(F.avg(F.col("user_id") % 50) / 50, 6).alias("pv_mult"))


@query(f"""with {_POINT_SQL}, p as (select event_type, max(pv_mult) as top from s group by 1)
select event_type, 'min_load_high_pv' as rule, step, load_mult, pv_mult from s join p using (event_type) where pv_mult >= 0.8 * top qualify row_number() over (partition by event_type order by load_mult, pv_mult desc, step) = 1 union all
select event_type, 'max_pv_to_load', step, load_mult, pv_mult from s where pv_mult > 0 qualify row_number() over (partition by event_type order by pv_mult / load_mult desc, step) = 1""")
def critical_points(spark, d):
    steps = _steps(spark, d)
    one, two = (hosting.critical_point(steps, ["event_type"], rule, 0.8).withColumn("rule", F.lit(rule)) for rule in ("min_load_high_pv", "max_pv_to_load"))
    return one.unionByName(two).select("event_type", "rule", "step", "load_mult", "pv_mult")


@query("""with x as (select case when l_suppkey % 9 <> 0 then l_suppkey % 9 end as part, case when l_linenumber = 7 and l_partkey % 50 = 0 then 1e12::double when l_partkey % 97 = 0 then null else l_extendedprice end as v from lineitem)
select part, quantile_disc(v, 0.1) as q10, quantile_disc(v, 0.999) as top from x group by 1""")
def quantiles_with_nulls(spark, d):
    """Groups whose key is null, values that are null, and outliers that lie far from all others."""
    v = F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 50 == 0), 1e12).when(F.col("l_partkey") % 97 == 0, None).otherwise(F.col("l_extendedprice"))
    x = read(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey") % 9).alias("part"), v.alias("v"))
    return quantiles.null_safe_join(quantiles.quantile_type1(x, ["part"], "v", 0.1, "q10"), quantiles.quantile_type1(x, ["part"], "v", 0.999, "top"), ["part"])


# --- streams and sinks -----------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events*.parquet")


_CLOSED = " from v where hour_bucket + interval 1 hour <= (select max(ts) - interval 10 minute from events)"


@query(served._LINE + " select network, line_id, hour_bucket, round(avg_loading_percent, 8) as avg_loading_percent, max_loading_percent, n_readings, n_overload_events, overload_rate_pct" + _CLOSED)
def stream_line_hours(spark, d):
    """Hours of lines that the watermark has closed, appended once each."""
    path, events = _place(spark, "line-hours"), _event_stream(spark, d)
    facts = events.select(F.col("event_type").alias("network"), (F.col("user_id") % 20).alias("line_id"), F.col("ts").alias("event_timestamp"), (F.col("value") * 0.977).alias("loading_percent"))
    event_time.line_hours(facts.withColumn("is_overloaded", F.col("loading_percent") > 100), path, availableNow=True).awaitTermination()
    return event_time.hours_until(spark, path).withColumn("avg_loading_percent", F.round("avg_loading_percent", 8))


@query(served._VOLT + " select network, bus_id, hour_bucket, round(avg_voltage_pu, 8) as avg_voltage_pu, min_voltage_pu, max_voltage_pu, round(stddev_voltage_pu, 8) as stddev_voltage_pu, is_in_scope, n_readings, n_violations, violation_rate_pct" + _CLOSED)
def stream_voltage_hours(spark, d):
    path, events = _place(spark, "voltage-hours"), _event_stream(spark, d)
    facts = events.select(F.col("event_type").alias("network"), (F.col("user_id") % 20).alias("bus_id"), F.col("ts").alias("event_timestamp"), (0.9 + F.col("value") / 500).alias("voltage_pu"), (F.col("user_id") % 7 != 0).alias("in_scope"))
    limits = spark.createDataFrame(served.BANDS, "network string, lo double, hi double")
    judged = served.with_limits(facts, limits, "network", "voltage_pu", "lo", "hi", F.col("in_scope"))
    event_time.voltage_hours(judged, path, availableNow=True).awaitTermination()
    return event_time.hours_until(spark, path).withColumns({c: F.round(c, 8) for c in ("avg_voltage_pu", "stddev_voltage_pu")})


@query("""with g as (select event_type, user_id % 3 as part, max(epoch(date_trunc('second', ts))::bigint) as newest from events group by all),
b as (select event_id, event_type, epoch(date_trunc('second', ts))::bigint as moment, (select max(newest) from g where g.event_type = events.event_type and g.part < events.user_id % 3) as before from events)
select event_type, count(*) as rows, count(*) filter (moment < before - 600) as late_rows from b group by 1""")
def stream_lateness(spark, d):
    """Events that come in three lots, one after the other; state outlives each run."""
    path, events = _place(spark, "late"), read(spark, d, "events")
    for part in range(3):
        events.filter(F.col("user_id") % 3 == part).write.mode("append").parquet(f"{path}/in")
        counted = event_time.lateness(spark.readStream.schema(events.schema).parquet(f"{path}/in"), ["event_type"], "ts", 600)
        save = lambda rows, batch, part=part: rows.write.mode("overwrite").parquet(f"{path}/out/lot={part}/batch={batch}")
        counted.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = relational.latest(spark.read.parquet(f"{path}/out"), ["event_type", "shard"], [F.desc("lot"), F.desc("batch")])
    return last.groupBy("event_type").agg(F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows"))


@query("""select sink, event_type, count(*) as n, round(sum(value), 4) as total from events, (values ('lines'), ('rows'), ('producer')) s(sink) group by all""")
def stream_fan_out(spark, d):
    """Three sinks of one stream; the batch comes twice and counts once."""
    path = _place(spark, "fan-out")
    kinds = {"lines": sinks.json_lines, "rows": sinks.parquet_rows, "producer": lambda rows, folder: sinks.producer_rows(rows, folder, "event_id")}
    sinks.fan_out_stream(_event_stream(spark, d), path, kinds, availableNow=True).awaitTermination()
    sinks.fan_out(read(spark, d, "events"), 0, path, kinds)
    sent = sinks.committed(spark, path, "producer").select(F.from_json(F.col("value").cast("string"), "event_type string, value double").alias("j")).select("j.*")
    rows = [sinks.committed(spark, path, "lines"), sinks.committed(spark, path, "rows"), sent]
    made = [r.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("sink", F.lit(n)) for r, n in zip(rows, kinds, strict=True)]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("""select ts::date as day, event_type, count(*) as n, round(sum(case when ts::date = date '2024-01-05' then value + 1 else value end), 4) as total from events
where (ts::date <> date '2024-01-05' or event_type <> 'view') and ts::date between date '2024-01-04' and date '2024-01-06' group by all""")
def days_rewritten(spark, d):
    """A table in chunks of days, of which one is written anew."""
    path, events = _place(spark, "days"), read(spark, d, "events")
    sinks.write_days(events, path, "ts", ["event_type", "user_id"])
    again = events.filter((F.to_date("ts") == F.lit("2024-01-05").cast("date")) & (F.col("event_type") != "view"))
    sinks.write_days(again.withColumn("value", F.col("value") + 1), path, "ts", ["event_type", "user_id"])
    rows = sinks.read_days(spark, path, "2024-01-04", "2024-01-06")
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- assertions and the contract -------------------------------------------------------------------------------------

_STATUS_SQL = """case when o_orderkey % 53 = 0 then 'lost' when o_orderkey % 5 = 1 then 'baseline_infeasible' else 'ok' end"""


def _faulty(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables in which every assertion has something to find."""
    k, e = F.col("o_orderkey"), read(spark, d, "events")
    method = F.when(k % 59 == 0, "guess").when(k % 3 == 0, "deterministic").when(k % 3 == 1, "stochastic").otherwise("qsts")
    status = F.when(k % 53 == 0, "lost").when(k % 5 == 1, "baseline_infeasible").otherwise("ok")
    low = F.when(k % 37 != 0, 1.0)
    lam = F.when(k % 41 == 0, -1.0).when(k % 43 != 0, F.lit(2.0))
    results = read(spark, d, "orders").select(
        "o_orderkey", method.alias("method"), status.alias("status"), ((status == "ok") & (k % 7 != 0)).alias("is_comparable"), lam.alias("lambda_max"), F.when(k % 47 == 0, 1.5).otherwise(2.5).alias("lambda_fail"),
        F.when(k % 61 != 0, "en50160").alias("criterion_framework"), F.when(status == "ok", k / 100.0).alias("total_pv_mw_comparable"), F.when(k % 67 == 0, -k / 1.0).otherwise(k / 1.0).alias("total_pv_mw_reported"),
        F.when(k % 71 != 0, 0.1).alias("hc_alpha"), F.when(k % 73 != 0, 0.25).alias("load_scale"), low.alias("hc_lambda_ci_low"), F.lit(3.0).alias("hc_lambda_ci_high"),
    )
    at = e.select(F.when(F.col("event_id") % 79 != 0, F.col("event_type")).alias("network"), (F.col("user_id") % 20).alias("bus_id"), F.col("ts").alias("event_timestamp"), (0.75 + F.col("value") / 500).alias("voltage_pu"), (F.col("user_id") % 7 != 0).alias("in_scope"), "event_id")
    buses = e.select("event_type", (F.col("user_id") % 20).alias("bus_id")).distinct()
    return {
        "results": results, "voltage": at.withColumn("is_violation", F.col("in_scope") | (F.col("event_id") % 83 == 0)), "lines": e.select((F.col("value") - 2).alias("loading_percent")),
        "summary": e.select(F.col("value").alias("total_load_mw"), F.lit(50.0).alias("total_generation_mw"), (50 - F.col("value") + F.when(F.col("event_id") % 89 == 0, 1.0).otherwise(0.0)).alias("power_balance_mw")),
        "limits": buses.filter("event_type in ('click', 'view', 'purchase') and (event_type <> 'view' or bus_id < 2)").filter("event_type = 'view' or bus_id = 0").select(F.col("event_type").alias("network")),
        "scope": buses.filter("event_type <> 'signup'").select(F.col("event_type").alias("network"), (F.col("bus_id") % 15).alias("bus_id")),
    }


_FAULTY_SQL = f"""r as (select *, o_orderkey as k, case when o_orderkey % 59 = 0 then 'guess' when o_orderkey % 3 = 0 then 'deterministic' when o_orderkey % 3 = 1 then 'stochastic' else 'qsts' end as method, {_STATUS_SQL} as status,
 case when o_orderkey % 41 = 0 then -1.0 when o_orderkey % 43 <> 0 then 2.0 end as lam, case when o_orderkey % 47 = 0 then 1.5 else 2.5 end as fail from orders), c as (select *, status = 'ok' and k % 7 <> 0 as comparable from r),
v as (select case when event_id % 79 <> 0 then event_type end as network, 0.75::double + value / 500 as pu, user_id % 7 <> 0 as in_scope, event_id from events),
b as (select distinct event_type, user_id % 20 as bus_id from events), l as (select event_type as network from b where event_type in ('click', 'purchase') and bus_id = 0 or event_type = 'view' and bus_id < 2), s as (select event_type as network, bus_id % 15 as bus_id from b where event_type <> 'signup')"""


@query(f"""with {_FAULTY_SQL}, f(name, n) as (
select 'bracket_is_ordered', count(*) filter (comparable and method in ('deterministic', 'qsts') and lam >= fail) from c union all
select 'comparable_rows_are_complete', count(*) filter (comparable and (k % 61 = 0 or lam is null or (method = 'stochastic' and k % 71 = 0) or (method = 'deterministic' and k % 73 = 0))) from c union all
select 'capacity_is_not_negative', count(*) filter ((k % 67 = 0 and k > 0) or lam < 0) from c union all
select 'stochastic_rows_have_interval', count(*) filter (comparable and method = 'stochastic' and k % 37 = 0) from c union all
select 'methods_are_known', count(*) filter (method = 'guess') from c union all select 'statuses_are_known', count(*) filter (status = 'lost') from c union all
select 'loading_is_not_negative', count(*) filter (value - 2 < 0) from events union all select 'power_balance_reconciles', count(*) filter (event_id % 89 = 0) from events union all
select 'out_of_scope_never_violates', count(*) filter (not in_scope and event_id % 83 = 0) from v union all select 'voltage_is_physical', count(*) filter (pu < 0.8::double or pu > 1.2::double) from v union all
select 'keys_are_not_null', count(*) filter (network is null) from v union all
select 'networks_have_limits', count(*) from (select distinct network from v) n where not exists (select 1 from l where l.network = n.network) union all
select 'networks_have_scope', count(*) from (select distinct network from v) n where not exists (select 1 from s where s.network = n.network) union all
select 'scope_keys_are_unique', count(*) from (select network, bus_id from s group by all having count(*) > 1) union all select 'limits_are_unique', count(*) from (select network from l group by all having count(*) > 1))
select name, n::bigint as n from f""")
def assertion_counts(spark, d):
    """All fifteen assertions, each with seeded faults."""
    return assertions.counts(_faulty(spark, d))


@query(f"""with {_FAULTY_SQL}, x as (select count(*) filter (comparable and method = 'deterministic') as a, count(*) filter (comparable and method = 'stochastic') as b, count(*) filter (comparable and method = 'qsts') as q,
 count(*) filter (status = 'baseline_infeasible') as i, count(*) filter (comparable and not k > 0) as p, count(*) filter (method = 'stochastic' and k % 37 = 0 and comparable) as o, count(*) filter (method = 'stochastic' and k % 37 = 0 and not comparable and status = 'ok') as g from c),
z as (select count(*) filter (lo is null) as none, count(*) as n, count(distinct network) as nets from (select event_type as network from events) e left join (select distinct network, 1 as lo from l) m using (network))
select 'telemetry is landed' as "check", n > 0 as holds from z union all select 'every method has a comparable row', a > 0 and b > 0 and q > 0 from x union all select 'an infeasible baseline is recorded and never a capacity', i > 0 from x union all
select 'comparable capacities are positive and finite', p = 0 from x union all select 'stochastic rows are comparable only with an interval', o = 0 and g > 0 from x union all select 'every simulated network has voltages', nets > 1 from z union all
select 'every voltage has limits', none = 0 from z union all select 'held buses are out of scope and never flagged', true union all select 'daily figures are there', n > 0 from z""")
def contract_checks(spark, d):
    """The nine checks while the tables are written: three fail, as faults are seeded."""
    path, tables = _place(spark, "contract"), _faulty(spark, d)
    e = read(spark, d, "events")
    bands = tables["limits"].distinct().withColumns({"v_min_pu": F.lit(0.9), "v_max_pu": F.lit(1.1)})
    voltage = e.select(F.col("event_type").alias("network"), (F.col("user_id") % 20).alias("bus_id"), (F.col("user_id") % 7 != 0).alias("in_scope"), F.lit(False).alias("is_violation")).join(bands, "network", "left")
    watched = contract.Contract()
    for name, table in (("bronze", e), ("results", tables["results"]), ("voltage", voltage), ("daily", served.daily(spark, d))):
        watched.watch(name, table).write.parquet(f"{path}/{name}")
    return contract.report(spark, watched.checks()).select("check", "holds")


# --- experiments and quality -----------------------------------------------------------------------------------------


def _spec(k: Column, alpha: Column, turned: bool = False) -> Column:
    """A nested specification; the same one may have its names in another order."""
    inner = F.struct(alpha.alias("alpha"), F.lit(10).alias("n")) if not turned else F.struct(F.lit(10).alias("n"), alpha.alias("alpha"))
    parts = [(k % 5).alias("network"), inner.alias("mc"), F.array(F.lit("qsts"), (k % 2).cast("string")).alias("methods")]
    return F.to_json(F.struct(*(reversed(parts) if turned else parts)))


@query("""select o_orderkey as id, case when o_orderkey % 4 = 0 then 'new' when o_orderkey % 4 = 1 then 'changed' else 'failed' end as state, o_orderkey % 4 <> 0 as clean from orders where o_orderkey % 4 <> 3 and not (o_orderkey % 4 = 2 and o_orderkey % 3 = 0)""")
def pending_cells(spark, d):
    """Cells whose specification has not run to its end: some never ran, some ran otherwise, some failed, of which a third ran again."""
    k = F.col("o_orderkey")
    orders = read(spark, d, "orders")
    cells = orders.select(k.alias("id"), _spec(k, F.lit(0.1)).alias("spec"))
    first = orders.filter(k % 4 != 0).select(k.alias("id"), _spec(k, F.when(k % 4 == 1, 0.2).otherwise(0.1), turned=True).alias("cell"), F.when(k % 4 == 2, 1).otherwise(0).alias("returncode"), F.lit("2024-01-01").alias("started"))
    second = orders.filter((k % 4 == 2) & (k % 3 == 0)).select(k.alias("id"), _spec(k, F.lit(0.1)).alias("cell"), F.lit(0).alias("returncode"), F.lit("2024-01-02").alias("started"))
    return experiments.pending(cells, first.unionByName(second)).select("id", "state", "clean")


@query("""with r as (select o_custkey % 7 as protocol, o_orderkey as run, o_orderkey % 90 + 1 as estimate_min, case o_orderkey % 5 when 0 then ['--methods', 'qsts', '--qsts-criterion', 'prodist'] when 1 then ['--methods', 'qsts', 'stochastic', '--qsts-criterion', 'prodist', '-v']
 when 2 then ['--qsts-criterion', 'prodist'] when 3 then ['--methods', 'qsts', '--qsts-criterion', 'zero_tolerance'] else ['--methods', 'stochastic', '--qsts-criterion', 'prodist'] end as args from orders)
select protocol, run, array_to_string(case when run % 5 < 3 then args || ['--qsts-backend', 'torch', '--device', 'cuda'] else args end, ' ') as args,
 case when run % 5 = 0 then greatest(1, round_even(estimate_min / 20.0, 0)::bigint) else estimate_min end as estimate_min, case when run % 5 < 3 then 'torch' else 'pandapower' end as backend from r""")
def derived_protocols(spark, d):
    k = F.col("o_orderkey")
    words = lambda *x: F.array(*map(F.lit, x))
    args = (
        F.when(k % 5 == 0, words("--methods", "qsts", "--qsts-criterion", "prodist")).when(k % 5 == 1, words("--methods", "qsts", "stochastic", "--qsts-criterion", "prodist", "-v"))
        .when(k % 5 == 2, words("--qsts-criterion", "prodist")).when(k % 5 == 3, words("--methods", "qsts", "--qsts-criterion", "zero_tolerance")).otherwise(words("--methods", "stochastic", "--qsts-criterion", "prodist"))
    )
    runs = read(spark, d, "orders").select((F.col("o_custkey") % 7).alias("protocol"), k.alias("run"), args.alias("args"), (k % 90 + 1).alias("estimate_min"))
    made = experiments.derived_protocol(runs, "cuda")
    return made.select("protocol", "run", F.array_join("args", " ").alias("args"), "estimate_min", "backend")


@query("""with e as (select user_id % 40 as series_id, date_trunc('hour', ts) as ts_utc, case when user_id % 40 = 3 then null when event_id % 31 = 0 then -1 else round(floor(value / 60), 0) end as value from events),
s as (select series_id, ts_utc, count(*) as k, count(distinct value) as vals, count(value) as there, max(value) as value from e group by all),
x as (select series_id, count(*) filter (there = 0) as nulls, epoch(max(ts_utc) - min(ts_utc)) / 3600 + 1 - count(*) as absent, count(*) filter (there > 0) as known, count(*) filter (k > 1) as repeated, count(*) filter (vals > 1) as conflicting, count(*) filter (value < 0) as negative from s group by 1),
n as (select *, case when value is distinct from lag(value) over w or row_number() over w = 1 then 1 else 0 end as fresh from s window w as (partition by series_id order by ts_utc)),
m as (select *, sum(fresh) over (partition by series_id order by ts_utc rows unbounded preceding) as run from n), f as (select series_id, count(*) as n from m where value <> 0 group by series_id, run having count(*) > 3), g as (select series_id, sum(n) as n from f group by 1),
i(code, severity, series_id, n) as (select 'gaps', 'warning', series_id, nulls + greatest(absent, 0) from x union all select 'no_values', 'error', series_id, (known = 0)::int from x union all select 'repeated_stamps', 'warning', series_id, repeated from x union all
 select 'conflicting_stamps', 'error', series_id, conflicting from x union all select 'negative', 'warning', series_id, negative from x union all select 'flat', 'warning', series_id, n from g)
select code, severity, count(distinct series_id) as series, sum(n)::bigint as n from i where n > 0 group by all""")
def source_quality_report(spark, d):
    """Issues of forty series by code."""
    value = F.when(F.col("user_id") % 40 == 3, None).when(F.col("event_id") % 31 == 0, -1.0).otherwise(F.floor(F.col("value") / 60).cast("double"))
    rows = read(spark, d, "events").select((F.col("user_id") % 40).alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts_utc"), value.alias("value"))
    return quality_gate.report(quality_gate.basic(rows, 3600, longest_flat=3))
