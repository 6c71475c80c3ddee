"""Data-quality assertions: each is a query that must give no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("deterministic", "stochastic", "qsts")
STATUSES = ("ok", "baseline_infeasible", "no_daylight", "error", "legacy_invalid")


def nulls(table: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null in any of ``columns``."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return table.filter(bad)


def repeated(table: DataFrame, *keys: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def not_among(table: DataFrame, column: str, values) -> DataFrame:
    return table.filter(~F.col(column).isin(*values))


def row_rules() -> dict[str, dict[str, Column]]:
    """What no single row may be, by table and assertion; all rules of a table take one pass."""
    comparable = F.col("is_comparable")
    incomplete = F.col("criterion_framework").isNull() | F.col("total_pv_mw_comparable").isNull() | F.col("lambda_max").isNull()
    incomplete = incomplete | ((F.col("method") == "stochastic") & F.col("hc_alpha").isNull()) | ((F.col("method") == "deterministic") & F.col("load_scale").isNull())
    return {
        "results": {
            "bracket_is_ordered": comparable & F.col("method").isin("deterministic", "qsts") & (F.col("lambda_max") >= F.col("lambda_fail")),
            "comparable_rows_are_complete": comparable & incomplete,
            "capacity_is_not_negative": (F.col("total_pv_mw_reported") < 0) | (F.col("lambda_max") < 0),
            "stochastic_rows_have_interval": comparable & (F.col("method") == "stochastic") & (F.col("hc_lambda_ci_low").isNull() | F.col("hc_lambda_ci_high").isNull()),
            "methods_are_known": ~F.col("method").isin(*METHODS),
            "statuses_are_known": ~F.col("status").isin(*STATUSES),
        },
        "lines": {"loading_is_not_negative": F.col("loading_percent") < 0},
        "summary": {"power_balance_reconciles": F.abs(F.col("power_balance_mw") - (F.col("total_generation_mw") - F.col("total_load_mw"))) > 0.001},
        "voltage": {
            "out_of_scope_never_violates": ~F.col("in_scope") & F.col("is_violation"),
            "voltage_is_physical": (F.col("voltage_pu") < 0.8) | (F.col("voltage_pu") > 1.2),
            "keys_are_not_null": F.col("network").isNull() | F.col("bus_id").isNull() | F.col("event_timestamp").isNull(),
        },
    }


def table_rules(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Assertions on a whole table: rows that must not be there."""
    seen = tables["voltage"].select("network").distinct()
    return {
        "networks_have_limits": seen.join(tables["limits"].select("network"), "network", "left_anti"),
        "networks_have_scope": seen.join(tables["scope"].select("network"), "network", "left_anti"),
        "scope_keys_are_unique": repeated(tables["scope"], "network", "bus_id"),
        "limits_are_unique": repeated(tables["limits"], "network"),
    }


def assertions(summary: DataFrame, voltage_facts: DataFrame, line_facts: DataFrame, results: DataFrame, limits: DataFrame, scope: DataFrame) -> dict[str, DataFrame]:
    """The offending rows of each assertion.  Facts as in :mod:`gridloom.sources.bronze`, ``results`` as in :mod:`gridloom.serving.marts`."""
    tables = {"summary": summary, "voltage": voltage_facts, "lines": line_facts, "results": results, "limits": limits, "scope": scope}
    return table_rules(tables) | {name: tables[table].filter(bad) for table, rules in row_rules().items() for name, bad in rules.items()}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, n``: offending rows (or keys) of all fifteen assertions; a table's row rules are counted in one pass."""
    parts = []
    for table, rules in row_rules().items():
        one = tables[table].agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()))
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in rules))).alias("x")).select("x.*"))
    parts += [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in table_rules(tables).items()]
    return reduce(DataFrame.unionByName, parts)


def failures(checks: dict[str, DataFrame]) -> list[str]:
    """Names of the assertions that do not hold; each stops at its first row."""
    return [name for name, rows in checks.items() if not rows.isEmpty()]
