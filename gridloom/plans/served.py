"""The service's and the dashboards' queries over stand-in tables, each with its SQL.

``events`` gives telemetry, ``orders`` study results: their payloads are written
as JSON and staged like landed ones, while the SQL states the typed columns.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import with_limits
from ..serving import assertions, marts, reads
from ..session import shared_folder
from .catalogue import query, read

# Voltage bands of the stand-in networks; one network has none.
BANDS = [("click", 0.91, 1.05), ("view", 0.92, 1.1), ("purchase", 0.93, 1.05), ("signup", 0.9, 1.02)]


def voltage_facts(spark, d) -> DataFrame:
    facts = read(spark, d, "events").select(F.col("event_type").alias("network"), (F.col("user_id") % 20).alias("bus_id"), F.col("ts").alias("event_timestamp"), (0.9 + F.col("value") / 500).alias("voltage_pu"), (F.col("user_id") % 7 != 0).alias("in_scope"))
    return with_limits(facts, spark.createDataFrame(BANDS, "network string, lo double, hi double"), "network", "voltage_pu", "lo", "hi", F.col("in_scope"))


def voltage(spark, d) -> DataFrame:
    return marts.voltage_hourly(voltage_facts(spark, d))


def line_facts(spark, d) -> DataFrame:
    facts = read(spark, d, "events").select(F.col("event_type").alias("network"), (F.col("user_id") % 20).alias("line_id"), F.col("ts").alias("event_timestamp"), (F.col("value") * 0.977).alias("loading_percent"))
    return facts.withColumn("is_overloaded", F.col("loading_percent") > 100)


def lines(spark, d) -> DataFrame:
    return marts.line_loading_hourly(line_facts(spark, d))


def summary(spark, d) -> DataFrame:
    made = (F.col("user_id") % 10).cast("double")
    return read(spark, d, "events").select(F.col("event_type").alias("network"), F.col("ts").alias("event_timestamp"), F.col("value").alias("total_load_mw"), made.alias("total_generation_mw"), (made - F.col("value")).alias("power_balance_mw"), (F.col("event_id") % 9 == 0).alias("has_contingency"))


def daily(spark, d) -> DataFrame:
    return marts.kpis_daily(summary(spark, d))


def raw_results(spark, d) -> DataFrame:
    """Payloads of both versions with missing fields, failures and all three methods."""
    k, lam, kind = F.col("o_orderkey"), F.col("o_totalprice") / 49999.0, F.left("o_orderpriority", F.lit(1))
    method = F.when(kind.isin("1", "2"), "deterministic").when(kind == "3", "stochastic").otherwise("qsts")
    binding = F.when(k % 3 == 1, F.concat(F.lit("overvoltage@"), (k % 4).cast("string"))).when(k % 3 == 2, F.concat(F.lit("line_loading@"), (k % 4).cast("string")))
    window = lambda i, v: F.struct(F.lit(i).alias("index"), v.alias("lambda_max"))
    payload = F.struct(
        F.when(k % 11 != 0, 2).alias("schema_version"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"), (k % 7 != 0).alias("bounded"),
        F.when(k % 2 != 0, k % 13 != 1).alias("resolved"), (F.col("o_totalprice") / 997.0).alias("total_pv_mw"), lam.alias("lambda_max"), binding.alias("binding_constraint"),
        F.struct(F.when(F.col("o_custkey") % 2 == 0, "en50160").otherwise("prodist").alias("framework"), F.lit(0.25).alias("load_scale")).alias("conditions"),
        F.when(k % 5 != 0, lam * 0.9).alias("hc_lambda_ci_low"), (lam * 1.1).alias("hc_lambda_ci_high"),
        F.when(k % 3 == 0, "zero_tolerance").when(k % 3 == 1, "prodist_m8_drp_drc").otherwise("en50160_weekly").alias("criterion"),
        F.when(k % 4 != 0, "own").alias("series_source"), F.when(k % 6 == 0, "unbalanced").when(k % 6 == 3, "balanced_equivalent").alias("phase_model"),
        (k % 52).alias("critical_window"), F.struct(F.when(k % 2 == 0, "remove").otherwise("keep").alias("existing_pv")).alias("params"),
        F.array(window(0, lam), window(1, F.when(k % 4 != 0, lam * 2))).alias("windows"),
        F.when(k % 4 != 1, F.struct((0.0101 * (k % 5)).alias("worst_bus_upper_drp"), (0.00101 * (k % 5)).alias("worst_bus_upper_drc"), (k % 5 < 3).alias("within_regulatory_allowance_per_bus"))).alias("verification"),
    )
    return read(spark, d, "orders").select(F.concat(F.lit("n"), (F.col("o_custkey") % 5).cast("string")).alias("network"), method.alias("method"), k.alias("run_id"), F.col("o_orderdate").alias("run_timestamp"), F.to_json(payload).alias("raw_value"))


#: Where the staged results of a session's tables lie.
_STAGED: dict[tuple[str, str], str] = {}


def results(spark, d) -> DataFrame:
    """The staged results, parsed once a session and stored by network and method, so that a panel reads its own."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STAGED:
        path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
        # a task sorts its rows by network and method before it writes, so they are dealt out by size
        marts.stage_results(raw_results(spark, d)).hint("rebalance", "network", "method").write.partitionBy("network", "method").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


_VOLT = f"""with l(network, lo, hi) as (values {", ".join(map(str, BANDS))}), f as (
  select event_type as network, user_id % 20 as bus_id, ts, 0.9 + value / 500 as voltage_pu, user_id % 7 <> 0 as in_scope from events
), g as (select f.*, case when not in_scope then false else voltage_pu < lo or voltage_pu > hi end as bad from f left join l using (network)
), v as (select network, bus_id, date_trunc('hour', ts) as hour_bucket, avg(voltage_pu) as avg_voltage_pu, min(voltage_pu) as min_voltage_pu, max(voltage_pu) as max_voltage_pu,
  stddev_samp(voltage_pu) as stddev_voltage_pu, bool_or(in_scope) as is_in_scope, count(*) as n_readings, count(*) filter (bad) as n_violations,
  round(100.0::double * (count(*) filter (bad)) / nullif(count(*) filter (in_scope), 0), 2) as violation_rate_pct from g group by all)"""
_LINE = """with f as (select event_type as network, user_id % 20 as line_id, ts, value * 0.977::double as x from events),
v as (select network, line_id, date_trunc('hour', ts) as hour_bucket, avg(x) as avg_loading_percent, max(x) as max_loading_percent, count(*) as n_readings,
  count(*) filter (x > 100) as n_overload_events, round(100.0::double * (count(*) filter (x > 100)) / count(*), 2) as overload_rate_pct from f group by all)"""
_DAY = """with v as (select event_type as network, date_trunc('day', ts) as day_bucket, avg(value) as avg_load_mw, max(value) as peak_load_mw, min(value) as min_load_mw,
  avg((user_id % 10)::double) as avg_generation_mw, round(avg(value) / nullif(max(value), 0), 4) as load_factor, count(*) filter (event_id % 9 = 0) as n_contingency_steps, count(*) as n_steps from events group by all)"""
_RUN = """with o as (select *, o_orderkey as k, o_totalprice / 49999.0::double as lam, left(o_orderpriority, 1) as p from orders),
r as (select 'n' || (o_custkey % 5) as network, case when p in ('1', '2') then 'deterministic' when p = '3' then 'stochastic' else 'qsts' end as method, k as run_id, o_orderdate as run_timestamp, k % 11 <> 0 as second,
  case when k % 11 = 0 then 'legacy_invalid' when o_orderstatus = 'P' then 'error' else 'ok' end as status, k % 7 <> 0 as is_bounded, case when k % 2 <> 0 then k % 13 <> 1 end as is_resolved,
  case when k % 11 <> 0 or p <> '3' then o_totalprice / 997.0::double end as mw, lam as lambda_max, case k % 3 when 1 then 'overvoltage@' || (k % 4) when 2 then 'line_loading@' || (k % 4) end as binding_constraint,
  case when o_custkey % 2 = 0 then 'en50160' else 'prodist' end as criterion_framework, case when k % 5 <> 0 then lam * 0.9 end as ci_low, lam * 1.1 as ci_high,
  case k % 3 when 0 then 'zero_tolerance' when 1 then 'prodist_m8_drp_drc' else 'en50160_weekly' end as criterion, case when k % 4 <> 0 then 'own' else 'synthetic' end as series,
  case k % 6 when 0 then 'unbalanced' when 3 then 'balanced_equivalent' else 'balanced' end as phase_model, case when k % 2 = 0 then 'remove' else 'keep' end as existing_pv from o),
m as (select *, second and status = 'ok' and is_bounded and coalesce(is_resolved, true) and (method <> 'stochastic' or ci_low is not null) as comparable from r),
q as (select * from m where network = 'n1' and method = 'qsts' and status = 'ok' qualify row_number() over (partition by criterion, series order by run_timestamp desc, run_id desc) = 1),
s as (select * from (select * from m where method in ('deterministic', 'stochastic') and status = 'ok' qualify row_number() over (partition by network, method, criterion_framework, phase_model, existing_pv order by run_timestamp desc, run_id desc) = 1) where method = 'deterministic')"""


def _close(df: DataFrame, *columns: str) -> DataFrame:
    """Means depend on the order of summing; eight digits do not."""
    return reduce(lambda x, c: x.withColumn(c, F.round(c, 8)), columns, df)


@query(_DAY + " select * replace (round(avg_load_mw, 8) as avg_load_mw, round(avg_generation_mw, 8) as avg_generation_mw) from v order by day_bucket desc, network limit 100")
def serve_kpis_daily(spark, d):
    return _close(reads.kpis(daily(spark, d)), "avg_load_mw", "avg_generation_mw")


@query(_VOLT + " select * replace (round(avg_voltage_pu, 8) as avg_voltage_pu, round(stddev_voltage_pu, 8) as stddev_voltage_pu) from v where bus_id = 3 order by hour_bucket desc, bus_id, network limit 500")
def serve_voltage_hourly(spark, d):
    return _close(reads.voltage_by_hour(voltage(spark, d), bus_id=3), "avg_voltage_pu", "stddev_voltage_pu")


@query(_VOLT + " select network, bus_id, hour_bucket, violation_rate_pct, n_readings from v where violation_rate_pct >= 0 order by violation_rate_pct desc, hour_bucket desc, network, bus_id limit 20")
def serve_violations(spark, d):
    return reads.violations(voltage(spark, d)).select("network", "bus_id", "hour_bucket", "violation_rate_pct", "n_readings")


@query(_LINE + " select * replace (round(avg_loading_percent, 8) as avg_loading_percent) from v where network = 'view' order by hour_bucket desc, line_id, network limit 500")
def serve_lines_hourly(spark, d):
    return _close(reads.lines_by_hour(lines(spark, d), "view"), "avg_loading_percent")


@query(_LINE + " select network, line_id, hour_bucket, n_overload_events, overload_rate_pct from v where n_overload_events > 0 order by overload_rate_pct desc, hour_bucket desc, network, line_id limit 20")
def serve_overloaded(spark, d):
    return reads.overloaded(lines(spark, d)).select("network", "line_id", "hour_bucket", "n_overload_events", "overload_rate_pct")


@query(_RUN + " select network, method, run_id, run_timestamp, status, criterion_framework, mw as total_pv_mw_comparable, lambda_max from m where comparable and criterion_framework = 'prodist' order by run_timestamp desc, method, run_id limit 100")
def serve_capacities(spark, d):
    return reads.capacities(results(spark, d), framework="prodist").select("network", "method", "run_id", "run_timestamp", "status", "criterion_framework", "total_pv_mw_comparable", "lambda_max")


@query(_RUN + " select network, method, run_id, status, is_bounded, is_resolved, comparable as is_comparable, mw as total_pv_mw_reported, case when comparable then mw end as total_pv_mw_comparable, series as series_source, phase_model from m")
def study_results_staged(spark, d):
    return results(spark, d).select("network", "method", "run_id", "status", "is_bounded", "is_resolved", "is_comparable", "total_pv_mw_reported", "total_pv_mw_comparable", "series_source", "phase_model")


@query(_DAY + " select max(peak_load_mw) as peak_load_mw, round(avg(load_factor), 3) as load_factor, sum(n_contingency_steps)::bigint as contingency_steps, sum(n_steps)::bigint as steps from v where network = 'view'")
def panel_load_figures(spark, d):
    return reads.load_figures(daily(spark, d), "view")


@query(_DAY + " select day_bucket as time, round(avg_load_mw, 8) as avg_load_mw, peak_load_mw, min_load_mw, round(avg_generation_mw, 8) as avg_generation_mw from v where network = 'view'")
def panel_load_by_day(spark, d):
    return _close(reads.load_by_day(daily(spark, d), "view"), "avg_load_mw", "avg_generation_mw")


@query(_LINE + " select hour_bucket as time, max(max_loading_percent) as max_loading_percent, round(avg(avg_loading_percent), 8) as mean_loading_percent from v where network = 'view' group by 1")
def panel_loading_by_hour(spark, d):
    return _close(reads.loading_by_hour(lines(spark, d), "view"), "mean_loading_percent")


@query(_LINE + """ select line_id, round(max(max_loading_percent), 1) as max_loading_percent, sum(n_overload_events)::bigint as overload_events,
round(100.0::double * sum(n_overload_events) / sum(n_readings), 2) as overload_rate_pct from v where network = 'view' group by 1 order by 2 desc, 1 limit 15""")
def panel_most_loaded(spark, d):
    return reads.most_loaded(lines(spark, d), "view")


_RATE = "round(100.0::double * sum(n_violations) / nullif(sum(n_readings), 0), 2) as violation_rate_pct"


@query(_VOLT + f" select {_RATE}, min(min_voltage_pu) as min_voltage_pu, max(max_voltage_pu) as max_voltage_pu from v where network = 'view' and is_in_scope")
def panel_voltage_figures(spark, d):
    return reads.voltage_figures(voltage(spark, d), "view")


@query(_VOLT + f" select hour_bucket as time, min(min_voltage_pu) as min_pu, round(avg(avg_voltage_pu), 8) as mean_pu, max(max_voltage_pu) as max_pu, {_RATE} from v where network = 'view' and is_in_scope group by 1")
def panel_voltage_envelope(spark, d):
    return _close(reads.voltage_envelope(voltage(spark, d), "view"), "mean_pu")


@query(_VOLT + f""" select bus_id, round(min(min_voltage_pu), 4) as min_voltage_pu, round(max(max_voltage_pu), 4) as max_voltage_pu, sum(n_violations)::bigint as violations, {_RATE}
from v where network = 'view' and is_in_scope group by 1 order by violation_rate_pct desc nulls last, bus_id limit 20""")
def panel_worst_buses(spark, d):
    return reads.worst_buses(voltage(spark, d), "view")


@query(_RUN + """ select method, criterion_framework, series as series_source, phase_model, existing_pv, round(lambda_max, 3) as lambda_max, round(mw, 3) as total_pv_mw, binding_constraint, round(ci_low, 3) as ci_low
from m where network = 'n1' and comparable qualify row_number() over (partition by method, criterion_framework, series, phase_model, existing_pv order by run_timestamp desc, run_id desc) = 1""")
def panel_latest_comparable(spark, d):
    return reads.latest_comparable(results(spark, d), "n1").select("method", "criterion_framework", "series_source", "phase_model", "existing_pv", "lambda_max", "total_pv_mw", "binding_constraint", "ci_low")


@query(_RUN + " select method || ' / ' || criterion_framework as label, mw from m where network = 'n1' and comparable qualify row_number() over (partition by method, criterion_framework order by run_timestamp desc, run_id desc) = 1")
def panel_capacity_bars(spark, d):
    return reads.capacity_bars(results(spark, d), "n1")


@query(_RUN + " select method, criterion_framework, split_part(binding_constraint, '@', 1) as constraint_type, count(*) as runs from m where network = 'n1' and comparable and binding_constraint is not null group by 1, 2, 3")
def panel_constraint_counts(spark, d):
    return reads.constraint_counts(results(spark, d), "n1")


@query(_RUN + " select method, status, criterion_framework, is_bounded, is_resolved, '' as error, run_timestamp from m where network = 'n1' and not comparable order by run_timestamp desc, run_id desc limit 20")
def panel_not_comparable(spark, d):
    return reads.not_comparable(results(spark, d), "n1")


@query(_RUN + " select criterion, series, round(lambda_max, 3) as lambda_max, round(mw, 3) as total_pv_mw, binding_constraint, run_timestamp from q")
def panel_series_runs(spark, d):
    return reads.series_runs(results(spark, d), "n1").select("criterion", "series", "lambda_max", "total_pv_mw", "binding_constraint", "run_timestamp")


@query(_RUN + """, w as (select series, max(lambda_max) filter (criterion = 'zero_tolerance') as z, max(lambda_max) filter (criterion = 'prodist_m8_drp_drc') as p, max(lambda_max) filter (criterion = 'en50160_weekly') as e from q group by 1)
select series, round(z, 3) as tau_zero, round(p, 3) as prodist_drp_drc, round(e, 3) as en50160_weekly, round(100 * (p / nullif(z, 0) - 1), 1) as duration_gain_pct from w""")
def panel_duration_gain(spark, d):
    return reads.duration_gain(results(spark, d), "n1")


@query(_RUN + """ select criterion, (run_id % 52)::int as critical_week, round(100 * (0.0101::double * (run_id % 5)), 2) as worst_bus_drp_pct, round(100 * (0.00101::double * (run_id % 5)), 2) as worst_bus_drc_pct,
run_id % 5 < 3 as within_allowance from q where run_id % 4 <> 1""")
def panel_verification(spark, d):
    return reads.verification(results(spark, d), "n1")


@query(_RUN + " select 'week 00' as week, criterion, lambda_max from q union all select 'week 01', criterion, lambda_max * 2 from q where run_id % 4 <> 0")
def panel_weekly_capacities(spark, d):
    return reads.weekly_capacities(results(spark, d), "n1")


@query(_RUN + " select network, phase_model, existing_pv, 0.25::double as load_scale, round(lambda_max, 3) as lambda_max, 'per_unit_of_nominal_load' as lambda_unit, round(mw, 3) as total_pv_mw, binding_constraint from s where criterion_framework = 'prodist'")
def panel_networks(spark, d):
    return reads.network_panel(results(spark, d), "prodist").drop("country", "source_vm_pu")


@query(_RUN + """ select criterion_framework as framework, split_part(binding_constraint, '@', 1) as constraint_type, count(distinct network) as networks, string_agg(distinct network, ', ' order by network) as which
from s where binding_constraint is not null group by 1, 2""")
def panel_binding_mix(spark, d):
    return reads.binding_mix(results(spark, d))


@query(_RUN + """, w as (select network, criterion_framework as framework, max(lambda_max) filter (phase_model = 'unbalanced') as u, max(lambda_max) filter (phase_model = 'balanced_equivalent') as b from s where phase_model <> 'balanced' group by 1, 2)
select network, framework, round(u, 2) as unbalanced_kwp, round(b, 2) as balanced_equivalent_kwp, round(100 * (b / nullif(u, 0) - 1), 1) as balanced_overestimate_pct from w""")
def panel_unbalance_effect(spark, d):
    return reads.unbalance_effect(results(spark, d)).drop("source_vm_pu", "max_vuf_pct")


@query(_RUN + " select case when phase_model <> 'balanced' then network || ' / ' || phase_model else network end as label, mw from s where criterion_framework = 'prodist'")
def panel_capacity_by_network(spark, d):
    return reads.capacity_by_network(results(spark, d), "prodist")


@query("select distinct event_type as network from events")
def variable_networks(spark, d):
    return reads.choices(daily(spark, d))


@query(_VOLT + " select network, bus_id, round(avg(violation_rate_pct), 2) as mean_rate, sum(n_violations)::bigint as violations from v group by 1, 2")
def debug_violations_by_bus(spark, d):
    return reads.violations_by_bus(voltage(spark, d))


@query(_VOLT + """ select 'networks_have_limits' as name, count(distinct network) as n from v where network not in (select network from l) union all
select 'voltage_is_physical', count(*) from f where voltage_pu < 0.8 or voltage_pu > 1.2 union all select 'out_of_scope_never_violates', count(*) from g where not in_scope and bad""")
def data_quality_counts(spark, d):
    facts, none = voltage_facts(spark, d), spark.createDataFrame([], "network string, bus_id long")
    checks = assertions.assertions(summary(spark, d), facts, line_facts(spark, d), results(spark, d), spark.createDataFrame(BANDS, "network string, lo double, hi double"), none)
    shown = ["networks_have_limits", "voltage_is_physical", "out_of_scope_never_violates"]
    return reduce(DataFrame.unionByName, (checks[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in shown))
