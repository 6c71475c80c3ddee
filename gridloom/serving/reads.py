"""The read queries of the service and of the five dashboards, one function each.

Filters apply only where given, so that they reach the scan; every limited order
is total.  ``daily``, ``lines``, ``voltage`` and ``results`` are the tables of
:mod:`gridloom.serving.marts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest, rate_percent

#: Criteria without any allowance.
ZERO_TOLERANCE = ("zero_tolerance", "prodist_m8_zero_tolerance")


def _given(df: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        df = df if value is None else df.filter(F.col(name) == value)
    return df


def _first(df: DataFrame, limit: int, most: int, *order) -> DataFrame:
    if not 1 <= limit <= most:
        raise ValueError(f"limit is 1 to {most}")
    return df.orderBy(*order).limit(limit)


def _between(df: DataFrame, column: str, start, end) -> DataFrame:
    df = df if start is None else df.filter(F.col(column) >= start)
    return df if end is None else df.filter(F.col(column) <= end)


# --- service ---------------------------------------------------------------


def health(spark: SparkSession) -> dict[str, str]:
    """Never raises: says whether the session answers."""
    try:
        return {"status": "ok" if spark.sql("select 1").count() == 1 else "degraded"}
    except Exception as e:  # noqa: BLE001
        return {"status": "degraded", "error": type(e).__name__}


def kpis(daily: DataFrame, network: str | None = None, limit: int = 100) -> DataFrame:
    return _first(_given(daily, network=network), limit, 1000, F.desc("day_bucket"), "network")


def voltage_by_hour(voltage: DataFrame, network: str | None = None, bus_id: int | None = None, limit: int = 500) -> DataFrame:
    return _first(_given(voltage, network=network, bus_id=bus_id), limit, 5000, F.desc("hour_bucket"), "bus_id", "network")


def voltage_between(voltage: DataFrame, start=None, end=None, network: str | None = None) -> DataFrame:
    """The hours from ``start`` to ``end``, both included; the range reaches the scan of a stored mart."""
    return _between(_given(voltage, network=network), "hour_bucket", *(x if x is None else F.lit(x).cast("timestamp_ntz") for x in (start, end)))


def having_field(raw: DataFrame, field: str, column: str = "raw_value") -> DataFrame:
    """Payloads in which a field of the first level is there, even as null."""
    return raw.filter(F.array_contains(F.json_object_keys(column), field))


def violations(voltage: DataFrame, network: str | None = None, min_rate: float = 0.0, limit: int = 20) -> DataFrame:
    """Rates of zero are kept by the default; hours out of scope have none and are not."""
    if not 0 <= min_rate <= 100:
        raise ValueError("min_rate is 0 to 100")
    rows = _given(voltage, network=network).filter(F.col("violation_rate_pct") >= min_rate)
    return _first(rows, limit, 500, F.desc("violation_rate_pct"), F.desc("hour_bucket"), "network", "bus_id")


def lines_by_hour(lines: DataFrame, network: str | None = None, line_id: int | None = None, limit: int = 500) -> DataFrame:
    return _first(_given(lines, network=network, line_id=line_id), limit, 5000, F.desc("hour_bucket"), "line_id", "network")


def overloaded(lines: DataFrame, network: str | None = None, limit: int = 20) -> DataFrame:
    rows = _given(lines, network=network).filter("n_overload_events > 0")
    return _first(rows, limit, 500, F.desc("overload_rate_pct"), F.desc("hour_bucket"), "network", "line_id")


def capacities(results: DataFrame, network: str | None = None, framework: str | None = None, comparable_only: bool = True, limit: int = 100) -> DataFrame:
    rows = _given(results, network=network, criterion_framework=framework)
    rows = rows.filter("is_comparable") if comparable_only else rows
    return _first(rows, limit, 1000, F.desc("run_timestamp"), "method", "run_id")


# --- telemetry and voltage dashboards --------------------------------------


def load_figures(daily: DataFrame, network: str) -> DataFrame:
    """Peak load, mean load factor, steps with a contingency, steps."""
    return _given(daily, network=network).agg(
        F.max("peak_load_mw").alias("peak_load_mw"), F.round(F.avg("load_factor"), 3).alias("load_factor"),
        F.sum("n_contingency_steps").alias("contingency_steps"), F.sum("n_steps").alias("steps"),
    )


def load_by_day(daily: DataFrame, network: str, start=None, end=None) -> DataFrame:
    rows = _between(_given(daily, network=network), "day_bucket", start, end)
    return rows.select(F.col("day_bucket").alias("time"), "avg_load_mw", "peak_load_mw", "min_load_mw", "avg_generation_mw").orderBy("time")


def loading_by_hour(lines: DataFrame, network: str, start=None, end=None) -> DataFrame:
    rows = _between(_given(lines, network=network), "hour_bucket", start, end).groupBy(F.col("hour_bucket").alias("time"))
    return rows.agg(F.max("max_loading_percent").alias("max_loading_percent"), F.avg("avg_loading_percent").alias("mean_loading_percent")).orderBy("time")


def most_loaded(lines: DataFrame, network: str, limit: int = 15) -> DataFrame:
    events, readings = F.sum("n_overload_events"), F.sum("n_readings")
    rows = _given(lines, network=network).groupBy("line_id").agg(F.round(F.max("max_loading_percent"), 1).alias("max_loading_percent"), events.alias("overload_events"), rate_percent(events, readings).alias("overload_rate_pct"))
    return rows.orderBy(F.desc_nulls_last("max_loading_percent"), "line_id").limit(limit)


def _judged(voltage: DataFrame, network: str) -> DataFrame:
    return _given(voltage, network=network).filter("is_in_scope")


def _rate() -> Column:
    return rate_percent(F.sum("n_violations"), F.sum("n_readings")).alias("violation_rate_pct")


def voltage_figures(voltage: DataFrame, network: str) -> DataFrame:
    """Violation rate, lowest and highest voltage of the buses in scope."""
    return _judged(voltage, network).agg(_rate(), F.min("min_voltage_pu").alias("min_voltage_pu"), F.max("max_voltage_pu").alias("max_voltage_pu"))


def voltage_envelope(voltage: DataFrame, network: str, start=None, end=None) -> DataFrame:
    rows = _between(_judged(voltage, network), "hour_bucket", start, end).groupBy(F.col("hour_bucket").alias("time"))
    return rows.agg(F.min("min_voltage_pu").alias("min_pu"), F.avg("avg_voltage_pu").alias("mean_pu"), F.max("max_voltage_pu").alias("max_pu"), _rate()).orderBy("time")


def worst_buses(voltage: DataFrame, network: str, limit: int = 20) -> DataFrame:
    rows = _judged(voltage, network).groupBy("bus_id").agg(
        F.round(F.min("min_voltage_pu"), 4).alias("min_voltage_pu"), F.round(F.max("max_voltage_pu"), 4).alias("max_voltage_pu"), F.sum("n_violations").alias("violations"), _rate()
    )
    return rows.orderBy(F.desc_nulls_last("violation_rate_pct"), "bus_id").limit(limit)


# --- hosting-capacity dashboards -------------------------------------------

def _newest() -> list[Column]:
    return [F.desc("run_timestamp"), F.desc("run_id")]



def _comparable(results: DataFrame, network: str) -> DataFrame:
    return _given(results, network=network).filter("is_comparable")


def latest_comparable(results: DataFrame, network: str) -> DataFrame:
    keys = ["method", "criterion_framework", "load_scale", "hc_alpha", "series_source", "series_block_average_min", "phase_model", "existing_pv"]
    shown = [F.round(c, 3).alias(n) for c, n in (("lambda_max", "lambda_max"), ("total_pv_mw_comparable", "total_pv_mw"), ("hc_lambda_ci_low", "ci_low"), ("hc_lambda_ci_high", "ci_high"))]
    return latest(_comparable(results, network), keys, _newest()).select(*(F.col(k).alias("block_min" if k == "series_block_average_min" else k) for k in keys), *shown, "binding_constraint", "run_label", "run_timestamp")


def capacity_bars(results: DataFrame, network: str) -> DataFrame:
    rows = latest(_comparable(results, network), ["method", "criterion_framework"], _newest())
    return rows.select(F.concat_ws(" / ", "method", "criterion_framework").alias("label"), F.col("total_pv_mw_comparable").alias("mw"))


def _constraint_type() -> Column:
    return F.split_part("binding_constraint", F.lit("@"), F.lit(1)).alias("constraint_type")


def constraint_counts(results: DataFrame, network: str) -> DataFrame:
    rows = _comparable(results, network).filter("binding_constraint is not null")
    return rows.groupBy("method", "criterion_framework", _constraint_type()).agg(F.count("*").alias("runs")).orderBy("method", "criterion_framework", F.desc("runs"), "constraint_type")


def not_comparable(results: DataFrame, network: str, limit: int = 20) -> DataFrame:
    rows = _given(results, network=network).filter("not is_comparable").orderBy(*_newest()).limit(limit)
    return rows.select("method", "status", "criterion_framework", "is_bounded", "is_resolved", F.left(F.coalesce("error", F.lit("")), F.lit(140)).alias("error"), "run_timestamp")


def latest_series_runs(results: DataFrame, network: str) -> DataFrame:
    """The newest good time-series run of each criterion, series, block and aggregation."""
    rows = _given(results, network=network, method="qsts", status="ok")
    return latest(rows, ["qsts_criterion", "series_source", "series_manifest_sha256", "series_block_average_min", "load_aggregated"], _newest())


def series_runs(results: DataFrame, network: str) -> DataFrame:
    week = lambda q: F.round(F.col("window_lambda_quantiles")[q], 3).alias(f"week_{q}")
    return latest_series_runs(results, network).select(
        F.col("qsts_criterion").alias("criterion"), F.round("lambda_max", 3).alias("lambda_max"), F.round("total_pv_mw_reported", 3).alias("total_pv_mw"), "binding_constraint",
        F.col("series_source").alias("series"), week("p10"), week("p50"), F.col("baseline_lower_compliant").alias("baseline_lower_ok"), "run_timestamp",
    ).orderBy("series", "criterion")


def duration_gain(results: DataFrame, network: str) -> DataFrame:
    """Capacities by criterion side by side and what the weekly allowance gains over zero tolerance, by series."""
    of = lambda *names: F.max(F.when(F.col("qsts_criterion").isin(*names), F.col("lambda_max")))
    zero, weekly = of(*ZERO_TOLERANCE), of("prodist_m8_drp_drc")
    block = F.concat(F.lit(" | "), F.col("series_block_average_min").cast("string"), F.lit(" min blocks"))
    series = F.concat(F.col("series_source"), F.coalesce(block, F.lit("")), F.when(F.col("load_aggregated"), " | aggregated").otherwise(""))
    return latest_series_runs(results, network).groupBy(series.alias("series")).agg(
        F.round(zero, 3).alias("tau_zero"), F.round(weekly, 3).alias("prodist_drp_drc"), F.round(of("en50160_weekly"), 3).alias("en50160_weekly"),
        F.round(100 * (weekly / F.nullif(zero, F.lit(0.0)) - 1), 1).alias("duration_gain_pct"),
    ).orderBy("series")


def verification(results: DataFrame, network: str) -> DataFrame:
    percent = lambda f: F.round(100 * F.col(f"verification.{f}"), 2)
    return latest_series_runs(results, network).filter("verification is not null").select(
        F.col("qsts_criterion").alias("criterion"), F.col("critical_window").alias("critical_week"), percent("worst_bus_upper_drp").alias("worst_bus_drp_pct"),
        percent("worst_bus_upper_drc").alias("worst_bus_drc_pct"), F.col("verification.within_regulatory_allowance_per_bus").alias("within_allowance"),
    ).orderBy("criterion")


def weekly_capacities(results: DataFrame, network: str) -> DataFrame:
    rows = latest_series_runs(results, network).select(F.col("qsts_criterion").alias("criterion"), F.explode("windows").alias("w")).filter("w.lambda_max is not null")
    week = F.concat(F.lit("week "), F.lpad(F.col("w.index").cast("string"), 2, "0"))
    return rows.select(week.alias("week"), "criterion", F.col("w.lambda_max").alias("lambda_max")).orderBy("week", "criterion")


def latest_snapshots(results: DataFrame) -> DataFrame:
    """The newest good snapshot run of each network, method and study condition."""
    rows = results.filter(F.col("method").isin("deterministic", "stochastic") & (F.col("status") == "ok"))
    return latest(rows, ["network", "method", "criterion_framework", "phase_model", "source_vm_pu", "existing_pv", "load_scale"], _newest()).filter("method = 'deterministic'")


def network_panel(results: DataFrame, framework: str) -> DataFrame:
    rounded = [F.round(c, 3).alias(n) for c, n in (("source_vm_pu", "source_vm_pu"), ("lambda_max", "lambda_max"), ("total_pv_mw_reported", "total_pv_mw"))]
    unit = F.coalesce("lambda_unit", F.lit("per_unit_of_nominal_load")).alias("lambda_unit")
    return latest_snapshots(_given(results, criterion_framework=framework)).select("network", F.col("network_country").alias("country"), "phase_model", "existing_pv", "load_scale", *rounded, unit, "binding_constraint").orderBy("network", "phase_model")


def binding_mix(results: DataFrame) -> DataFrame:
    rows = latest_snapshots(results).filter("binding_constraint is not null").groupBy(F.col("criterion_framework").alias("framework"), _constraint_type())
    return rows.agg(F.count_distinct("network").alias("networks"), F.array_join(F.sort_array(F.collect_set("network")), ", ").alias("which")).orderBy("framework", F.desc("networks"), "constraint_type")


def unbalance_effect(results: DataFrame) -> DataFrame:
    of = lambda model, c="lambda_max": F.max(F.when(F.col("phase_model") == model, F.col(c)))
    real, spread = of("unbalanced"), of("balanced_equivalent")
    rows = latest_snapshots(results).filter("has_phase_model").groupBy("network", F.col("criterion_framework").alias("framework"), F.round("source_vm_pu", 3).alias("source_vm_pu"))
    return rows.agg(
        F.round(real, 2).alias("unbalanced_kwp"), F.round(spread, 2).alias("balanced_equivalent_kwp"), F.round(100 * (spread / F.nullif(real, F.lit(0.0)) - 1), 1).alias("balanced_overestimate_pct"),
        F.round(of("unbalanced", "max_vuf_percent"), 2).alias("max_vuf_pct"),
    ).orderBy("network", "framework", "source_vm_pu")


def capacity_by_network(results: DataFrame, framework: str) -> DataFrame:
    label = F.when(F.col("phase_model") != "balanced", F.concat_ws(" / ", "network", "phase_model")).otherwise(F.col("network"))
    rows = latest_snapshots(_given(results, criterion_framework=framework)).filter("total_pv_mw_reported is not null")
    return rows.select(label.alias("label"), F.col("total_pv_mw_reported").alias("mw")).orderBy(F.desc("mw"), "label")


# --- variables and lake checks ---------------------------------------------


def choices(table: DataFrame, column: str = "network") -> DataFrame:
    return table.select(column).distinct().orderBy(column)


def topic_counts(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("topic").agg(F.count("*").alias("n")).orderBy("topic")


def violations_by_bus(voltage: DataFrame) -> DataFrame:
    rows = voltage.groupBy("network", "bus_id").agg(F.round(F.avg("violation_rate_pct"), 2).alias("mean_rate"), F.sum("n_violations").alias("violations"))
    return rows.orderBy(F.desc_nulls_last("mean_rate"), "network", "bus_id")
