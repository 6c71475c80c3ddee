"""Gold marts and the typed, gated table of study results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import rate_percent

#: Fields of a study's payload that the marts and dashboards read.
RESULT = (
    "schema_version int, status string, error string, bounded boolean, resolved boolean, total_pv_mw double, hosting_capacity_mw_p50 double, "
    "lambda_max double, lambda_fail double, lambda_unit string, binding_constraint string, "
    "conditions struct<framework string, criterion_kind string, v_min_pu double, v_max_pu double, load_scale double>, "
    "alpha double, hc_lambda_ci_low double, hc_lambda_ci_high double, hc_mw_p50 double, n_scenarios int, n_censored int, "
    "criterion string, total_steps int, steps_per_day int, first_violating_step int, critical_window int, series_source string, "
    "series_manifest_sha256 string, phase_model string, source_vm_pu double, max_vuf_percent double, baseline_lower_compliant boolean, "
    "params struct<series_source string, series_manifest_sha256 string, series_block_average_min int, load_aggregated boolean, existing_pv string, run_label string, network_country string>, "
    "provenance struct<git_commit string, git_dirty boolean>, window_lambda_quantiles map<string,double>, "
    "windows array<struct<index int, lambda_max double>>, "
    "verification struct<worst_bus_upper_drp double, worst_bus_upper_drc double, within_regulatory_allowance_per_bus boolean>"
)


def kpis_daily(summary: DataFrame) -> DataFrame:
    """``network, event_timestamp, total_load_mw, total_generation_mw, has_contingency`` by day."""
    load = F.col("total_load_mw")
    return summary.groupBy("network", F.date_trunc("day", "event_timestamp").cast("timestamp_ntz").alias("day_bucket")).agg(
        F.avg(load).alias("avg_load_mw"), F.max(load).alias("peak_load_mw"), F.min(load).alias("min_load_mw"), F.avg("total_generation_mw").alias("avg_generation_mw"),
        F.round(F.avg(load) / F.nullif(F.max(load), F.lit(0.0)), 4).alias("load_factor"), F.count_if("has_contingency").alias("n_contingency_steps"), F.count("*").alias("n_steps"),
    )


def _by_hour(facts: DataFrame, keys: list[str], late: str, *values: Column) -> DataFrame:
    """Aggregates by ``keys`` and hour; on a stream by windows that close ``late`` behind the newest row."""
    if not facts.isStreaming:
        return facts.groupBy(*keys, F.date_trunc("hour", "event_timestamp").cast("timestamp_ntz").alias("hour_bucket")).agg(*values)
    stamped = facts.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp")).withWatermark("event_timestamp", late)
    made = stamped.groupBy(*keys, F.window("event_timestamp", "1 hour")).agg(*values)
    return made.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("hour_bucket"), *(c for c in made.columns if c not in (*keys, "window")))


def line_loading_hourly(facts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``network, line_id, event_timestamp, loading_percent, is_overloaded`` by hour and line."""
    over = F.count_if("is_overloaded")
    return _by_hour(
        facts, ["network", "line_id"], late,
        F.avg("loading_percent").alias("avg_loading_percent"), F.max("loading_percent").alias("max_loading_percent"),
        F.count("*").alias("n_readings"), over.alias("n_overload_events"), rate_percent(over, F.count("*")).alias("overload_rate_pct"),
    )


def voltage_hourly(facts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``network, bus_id, event_timestamp, voltage_pu, in_scope, is_violation`` by hour and bus; rates count readings in scope only."""
    hits = F.count_if("is_violation")
    return _by_hour(
        facts, ["network", "bus_id"], late,
        F.avg("voltage_pu").alias("avg_voltage_pu"), F.min("voltage_pu").alias("min_voltage_pu"), F.max("voltage_pu").alias("max_voltage_pu"),
        F.stddev_samp("voltage_pu").alias("stddev_voltage_pu"), F.bool_or("in_scope").alias("is_in_scope"), F.count("*").alias("n_readings"),
        hits.alias("n_violations"), rate_percent(hits, F.count_if("in_scope")).alias("violation_rate_pct"),
    )


def stage_results(raw: DataFrame) -> DataFrame:
    """Study results (``network, method, run_id, run_timestamp, raw_value``), parsed once, with the gate ``is_comparable``.

    A result of the first version has no status of its own and is never comparable.
    A result is comparable if it is of the second version, ok, bounded, resolved
    (or silent about it) and, if stochastic, has both ends of its interval.
    """
    parsed = raw.withColumn("j", F.from_json("raw_value", RESULT)).withColumn("schema_version", F.coalesce("j.schema_version", F.lit(1)))
    second = F.col("schema_version") >= 2
    old_power = F.when(F.col("method") == "stochastic", F.col("j.hosting_capacity_mw_p50")).when(F.col("method").isin("deterministic", "qsts"), F.col("j.total_pv_mw"))
    as_they_are = ["error", "lambda_max", "lambda_fail", "lambda_unit", "binding_constraint", "hc_lambda_ci_low", "hc_lambda_ci_high", "n_scenarios", "n_censored", "source_vm_pu", "max_vuf_percent",
                   "critical_window", "baseline_lower_compliant", "window_lambda_quantiles", "windows", "verification"]
    typed = parsed.select(
        "network", "method", "run_id", "run_timestamp", "schema_version", *(F.col(f"j.{c}").alias(c) for c in as_they_are),
        F.when(second, F.col("j.status")).otherwise("legacy_invalid").alias("status"), F.coalesce("j.bounded", F.lit(False)).alias("is_bounded"), F.col("j.resolved").alias("is_resolved"),
        F.when(second, F.col("j.total_pv_mw")).otherwise(old_power).alias("total_pv_mw_reported"),
        F.col("j.conditions.framework").alias("criterion_framework"), F.col("j.conditions.criterion_kind").alias("criterion_kind"),
        F.col("j.conditions.v_min_pu").alias("v_min_pu"), F.col("j.conditions.v_max_pu").alias("v_max_pu"), F.col("j.conditions.load_scale").alias("load_scale"),
        F.col("j.alpha").alias("hc_alpha"), F.col("j.hc_mw_p50").alias("total_pv_mw_p50"), F.col("j.criterion").alias("qsts_criterion"), F.col("j.total_steps").alias("qsts_total_steps"),
        F.col("j.steps_per_day").alias("qsts_steps_per_day"), F.col("j.first_violating_step").alias("qsts_first_violating_step"),
        F.coalesce("j.series_source", "j.params.series_source", F.lit("synthetic")).alias("series_source"),
        F.coalesce("j.series_manifest_sha256", "j.params.series_manifest_sha256").alias("series_manifest_sha256"),
        F.col("j.params.series_block_average_min").alias("series_block_average_min"), F.col("j.params.load_aggregated").alias("load_aggregated"),
        F.coalesce("j.phase_model", F.lit("balanced")).alias("phase_model"), F.col("j.phase_model").isNotNull().alias("has_phase_model"), F.col("j.params.existing_pv").alias("existing_pv"),
        F.col("j.params.run_label").alias("run_label"), F.col("j.params.network_country").alias("network_country"), F.col("j.provenance.git_commit").alias("git_commit"), F.col("j.provenance.git_dirty").alias("git_dirty"),
    )
    interval = F.col("hc_lambda_ci_low").isNotNull() & F.col("hc_lambda_ci_high").isNotNull()
    gate = second & (F.col("status") == "ok") & F.col("is_bounded") & F.coalesce("is_resolved", F.lit(True)) & ((F.col("method") != "stochastic") | interval)
    gated = typed.withColumn("is_comparable", F.coalesce(gate, F.lit(False)))
    return gated.withColumn("total_pv_mw_comparable", F.when(F.col("is_comparable"), F.col("total_pv_mw_reported")))
