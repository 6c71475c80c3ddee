"""Violations from given voltages and loadings: flags, ranking, and the classes of weekly criteria.  No solver is involved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack of the comparisons with limits.
SLACK = 1e-6


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def flags(elements: DataFrame, line_percent: float = 100.0, trafo_percent: float = 100.0) -> DataFrame:
    """``violation``: ``undervoltage``, ``overvoltage``, ``isolated``, ``overload``, or null, for long results.

    ``elements``: ``element`` (bus, line, trafo), ``value``, ``lo``, ``hi``.  A bus
    without a finite voltage is isolated; a branch without a finite loading is not
    judged.  Lines and transformers have limits of their own.
    """
    value, bus = F.col("value"), F.col("element") == "bus"
    made = F.when(bus & ~_finite(value), "isolated").when(bus & (value < F.col("lo")), "undervoltage").when(bus & (value > F.col("hi")), "overvoltage")
    most = F.when(F.col("element") == "line", line_percent).when(F.col("element") == "trafo", trafo_percent)
    return elements.withColumn("violation", made.when(~bus & _finite(value) & (value > most), "overload"))


def exceedance(value: Column, lo: Column, hi: Column) -> Column:
    """How far a value lies beyond its band, relative to the limit; infinite for NaN."""
    return F.when(F.isnan(value), F.lit(float("inf"))).otherwise(F.greatest(value / hi - 1, 1 - value / lo))


def worst(df: DataFrame, keys: list[str], label: str, value: str, lo: str, hi: str) -> DataFrame:
    """The label, of any type that can be ordered, of the largest relative exceedance of each key; ties to the smallest label."""
    x = exceedance(F.col(value), F.col(lo), F.col(hi))
    first = F.struct(F.coalesce(-F.col("__x"), F.lit(float("inf"))).alias("x"), F.col(label).alias("i"))
    return df.withColumn("__x", x).groupBy(*keys).agg(F.min_by(label, first).alias(label), F.max("__x").alias("exceedance"))


#: How a binding constraint is named, and what stands for a run that did not converge.
LABELS = {"undervoltage": "undervoltage@bus_%s (%.4f pu)", "overvoltage": "overvoltage@bus_%s (%.4f pu)", "isolated": "isolated@bus_%s (not energized)", "line": "line_loading@line_%s (%.1f%%)", "trafo": "trafo_loading@trafo_%s (%.1f%%)"}
NOT_CONVERGED = "power_flow_non_convergence"


def binding(elements: DataFrame, keys: list[str], line_percent: float = 100.0, trafo_percent: float = 100.0) -> DataFrame:
    """Of each key: ``binding``, the label of its most exceeded element (null if none), ``exceedance``, ``n_violations`` and ``n_reverse``.

    ``elements`` as for :func:`flags`, with ``element_id`` and ``power``, that of a
    transformer's upper side: below 0 it feeds back, which is told, not judged.
    An isolated bus is exceeded without end.  Ties go to isolated buses, then buses,
    lines, transformers, and to the smaller id.  A key with a row whose
    ``converged`` is false is bound by that.
    """
    kind = F.when(F.col("element") == "bus", F.col("violation")).otherwise(F.col("element"))
    bus = F.when(F.col("violation") == "overvoltage", F.col("value") / F.col("hi") - 1).otherwise(1 - F.col("value") / F.col("lo"))
    branch = F.col("value") / F.when(F.col("element") == "line", line_percent).otherwise(trafo_percent) - 1
    how = F.when(F.col("violation") == "isolated", float("inf")).when(F.col("element") == "bus", bus).otherwise(branch)
    said = F.lit(None).cast("string")
    for name, form in LABELS.items():
        said = F.when(kind == name, F.format_string(form, F.col("element_id").cast("string"), "value") if form.count("%") > 1 else F.format_string(form, F.col("element_id").cast("string"))).otherwise(said)
    rank = F.when(F.col("violation") == "isolated", 0).when(F.col("element") == "bus", 1).when(F.col("element") == "line", 2).otherwise(3)
    hit = F.col("violation").isNotNull()
    judged = flags(elements, line_percent, trafo_percent).withColumns({"__x": F.when(hit, how), "__said": F.when(hit, said)})
    first = F.when(hit, F.struct((-F.col("__x")).alias("x"), rank.alias("rank"), F.col("element_id").alias("i")))
    failed = F.bool_or(~F.col("converged")) if "converged" in elements.columns else F.lit(False)
    reverse = F.count_if((F.col("element") == "trafo") & _finite(F.col("power")) & (F.col("power") < 0)) if "power" in elements.columns else F.lit(0).cast("long")
    found = judged.groupBy(*keys).agg(F.min_by("__said", first).alias("binding"), F.max("__x").alias("exceedance"), F.count("violation").alias("n_violations"), reverse.alias("n_reverse"), failed.alias("__failed"))
    return found.withColumn("binding", F.when(F.coalesce("__failed", F.lit(False)), NOT_CONVERGED).otherwise(F.col("binding"))).drop("__failed")


def classify(steps: DataFrame, precarious: float, critical: float) -> DataFrame:
    """The events of each step as rows (``kind``), from ``v_max``, ``loading``, ``rating``, ``base_loading`` and ``converged``.

    Loading counts only beyond the larger of the rating and the loading without
    PV.  A step that did not converge has all three events.
    """
    failed = ~F.col("converged")
    found = {
        "critical": failed | (F.col("v_max") > critical + SLACK),
        "precarious": failed | ((F.col("v_max") > precarious + SLACK) & (F.col("v_max") <= critical + SLACK)),
        "thermal": failed | (F.col("loading") > F.greatest("rating", "base_loading") + SLACK),
    }
    kinds = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(kind)) for kind, test in found.items())))
    return steps.select("*", F.explode(kinds).alias("kind"))
