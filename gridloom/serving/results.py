"""Study results on their way in and out: payload envelopes, stored rows, flat tables, comparisons of two protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import null_safe_join

#: Fixed value: the version of the payload that :func:`gridloom.serving.marts.stage_results` accepts.
PAYLOAD_VERSION = 2


def _finite(df: DataFrame, name: str) -> Column:
    """Infinite and undefined numbers have no JSON form, so they are null."""
    c = F.col(name)
    if dict(df.dtypes)[name] not in ("double", "float"):
        return c.alias(name)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)


def envelope(results: DataFrame, fields: list[str], params: list[str] = (), provenance: list[str] = ()) -> DataFrame:
    """``network, method, run_id, run_timestamp, raw_value``: one JSON payload a result.

    A result with an ``error`` has that status, whatever else it holds; else one
    whose ``baseline_ok`` is false is ``baseline_infeasible``, one without
    ``daylight_steps`` is ``no_daylight`` (columns that are absent or null do not
    count).  Each row is judged alone, so one failure leaves its siblings as
    they are.
    """
    has = lambda name, test: F.coalesce(test, F.lit(False)) if name in results.columns else F.lit(False)
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    status = (
        F.when(error.isNotNull(), "error")
        .when(has("baseline_ok", ~F.col("baseline_ok")), "baseline_infeasible")
        .when(has("daylight_steps", F.col("daylight_steps") == 0), "no_daylight")
        .otherwise("ok")
    )
    ok = status == "ok"
    own = [F.when(ok, _finite(results, f)).alias(f) for f in fields]
    nested = [F.struct(*(_finite(results, c) for c in some)).alias(name) for name, some in (("params", params), ("provenance", provenance)) if some]
    payload = F.struct(F.lit(PAYLOAD_VERSION).alias("schema_version"), "method", F.col("network").alias("network_name"), status.alias("status"), error.alias("error"), *nested, *own)
    return results.select("network", "method", "run_id", "run_timestamp", F.to_json(payload).alias("raw_value"))


def write_results(rows: DataFrame, path: str, rows_a_file: int = 500_000) -> None:
    """Appends rows under ``network=/method=``; a folder gets as many tasks and files as its rows ask for."""
    sizes = rows.groupBy("network", "method").agg(F.ceil(F.count("*") / rows_a_file).cast("int").alias("__files"))
    dealt = null_safe_join(rows, sizes, ["network", "method"]).withColumn("__file", F.pmod(F.xxhash64("run_id"), F.col("__files"))).drop("__files")
    dealt.repartition("network", "method", "__file").drop("__file").write.mode("append").partitionBy("network", "method").parquet(path)


_FLAT = (
    "status string, criterion string, conditions struct<framework string>, lambda_max double, total_pv_mw double, binding_constraint string, bounded boolean, "
    "series_manifest_sha256 string, params struct<series_manifest_sha256 string>"
)


def flatten(cells: DataFrame, results: DataFrame) -> DataFrame:
    """One row a cell and method; a cell without results has method ``-`` and its return code for a status.

    ``cells``: ``cell, returncode, network, qsts_series, qsts_start, qsts_days, qsts_network_profiles, block_average_min, existing_pv, seconds``;
    ``results``: ``cell, method, raw_value``.
    """
    j = results.select("cell", "method", F.from_json("raw_value", _FLAT).alias("j"))
    both = cells.join(j, "cell", "left")
    profiles = F.concat("network", F.lit("|profiles:"), "qsts_start", F.lit("+"), F.col("qsts_days").cast("string"), F.lit("d"))
    key = F.coalesce("qsts_series", F.when(F.col("qsts_network_profiles"), profiles), F.concat(F.lit("snapshot:"), F.col("network")))
    none = F.col("method").isNull()
    return both.select(
        "cell", F.when(~none, key).alias("series_key"), F.coalesce("method", F.lit("-")).alias("method"),
        F.when(none, F.concat(F.lit("rc="), F.col("returncode").cast("string"))).otherwise(F.col("j.status")).alias("status"),
        F.coalesce("j.criterion", "j.conditions.framework").alias("criterion"), F.col("j.lambda_max").alias("lambda_max"), F.col("j.total_pv_mw").alias("total_pv_mw"),
        F.col("j.binding_constraint").alias("binding"), F.col("j.bounded").alias("bounded"), F.coalesce("j.params.series_manifest_sha256", "j.series_manifest_sha256").alias("series_manifest"),
        "block_average_min", F.coalesce("existing_pv", F.lit("remove")).alias("existing_pv"), "seconds",
    )


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """``verdict`` of each key: ``ok``, ``different``, ``only_a``, ``only_b``; ``abs_diff`` where both have a value.

    ``a``, ``b``: keys, ``status``, ``bounded``, ``lambda_max``.  Status and
    boundedness must agree.  A capacity that is not bounded is a lower bound, so
    its number is not compared; a value on one side alone is a difference.
    """
    sides = [df.select(*keys, F.struct("status", F.coalesce("bounded", F.lit(False)).alias("bounded"), F.col("lambda_max").alias("value")).alias(n)) for df, n in ((a, "a"), (b, "b"))]
    both = sides[0].join(sides[1], keys, "full_outer")
    diff = F.abs(F.col("a.value") - F.col("b.value"))
    alike = F.col("a.status").eqNullSafe(F.col("b.status")) & (F.col("a.bounded") == F.col("b.bounded"))
    close = F.when(diff.isNotNull(), (diff <= tolerance + 1e-12) | ~F.col("a.bounded")).otherwise(F.col("a.value").isNull() & F.col("b.value").isNull())
    verdict = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(alike & close, "ok").otherwise("different")
    return both.select(*keys, F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"), diff.alias("abs_diff"), verdict.alias("verdict"))


def exit_status(compared: DataFrame) -> int:
    """1 if a pair differs, else 0."""
    return int(not compared.filter("verdict = 'different'").isEmpty())
