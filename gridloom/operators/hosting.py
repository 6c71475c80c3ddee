"""Hosting-capacity estimators that need no power flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weekly_sweep(events: DataFrame, windows: DataFrame, kinds: dict[str, float], priority: list[str]) -> DataFrame:
    """Capacity of each window: the first threshold at which a kind's count exceeds its allowance.

    ``events``: ``win``, ``theta``, ``kind``; ``windows``: ``win``, ``n_readings``,
    ``cap``.  Counts run over thresholds with ties taken together; an allowance is
    the floor of the share of readings, or the count at threshold 0 if larger.
    Without any exceedance the capacity is ``cap`` and not bounded.
    """
    w = Window.partitionBy("win").orderBy("theta").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # equal thresholds are counted before the windows are sorted
    steps = events.groupBy("win", "theta").agg(*(F.count_if(F.col("kind") == k).alias(f"at_{k}") for k in kinds))
    base = steps.filter("theta <= 0").groupBy("win").agg(*(F.sum(f"at_{k}").alias(f"base_{k}") for k in kinds))
    counted = steps.select("win", "theta", *(F.sum(f"at_{k}").over(w).alias(f"n_{k}") for k in kinds))
    known = counted.join(base, "win", "left").join(windows, "win")
    over = {k: F.col(f"n_{k}") > F.greatest(F.floor(F.lit(f) * F.col("n_readings") + 1e-9), F.col(f"base_{k}")) for k, f in kinds.items()}
    binding = F.coalesce(*(F.when(over[k], F.lit(k)) for k in priority))
    first = known.withColumn("binding", binding).filter("binding is not null").groupBy("win").agg(F.min("theta").alias("theta"), F.min_by("binding", "theta").alias("binding"))
    joined = windows.join(first, "win", "left")
    return joined.select("win", F.coalesce("theta", "cap").alias("capacity"), F.col("theta").isNotNull().alias("bounded"), "binding")


def exceedance_counts(readings: DataFrame, low: float, high: float) -> DataFrame:
    """Per-place counts of precarious and critical readings, the worst place and the share of any place.

    ``readings``: ``place``, ``step``, ``value``.
    """
    per = readings.groupBy("place").agg(F.count_if((F.col("value") > low) & (F.col("value") <= high)).alias("precarious"), F.count_if(F.col("value") > high).alias("critical"), F.count("*").alias("n"))
    return per.agg(F.max(F.col("precarious") / F.col("n")).alias("worst_precarious"), F.max(F.col("critical") / F.col("n")).alias("worst_critical"), F.count_if(F.col("critical") > 0).alias("places_critical"), F.count("*").alias("places"))


def critical_point(steps: DataFrame, keys: list[str], rule: str = "min_load_high_pv", pv_fraction: float = 0.9) -> DataFrame:
    """The step of each key's series at which a snapshot study is made: ``keys``, ``step``, ``load_mult``, ``pv_mult``.

    ``min_load_high_pv``: the least load among steps with at least ``pv_fraction``
    of the largest PV, then the larger PV; ``max_pv_to_load``: the largest PV over
    load.  Ties go to the earlier step.  A series without PV fails the job.
    """
    if rule not in ("min_load_high_pv", "max_pv_to_load") or not 0 < pv_fraction <= 1:
        raise ValueError("rule is min_load_high_pv or max_pv_to_load, pv_fraction above 0 and at most 1")
    load, pv = F.col("load_mult"), F.col("pv_mult")
    point = F.struct("step", "load_mult", "pv_mult")
    sun = F.when(F.max("pv_mult") > 0, F.max("pv_mult")).otherwise(F.raise_error(F.lit("a series has no PV output")).cast("double"))
    peak = steps.groupBy(*keys).agg(sun.alias("__peak"))
    both = steps.join(peak, keys)
    if rule == "min_load_high_pv":
        found = both.filter(pv >= pv_fraction * F.col("__peak")).groupBy(*keys).agg(F.min_by(point, F.struct(load, (-pv).alias("pv"), "step")).alias("p"))
    else:
        sunny = F.when((pv > 0) & (F.col("__peak") > 0), F.struct((-pv / load).alias("r"), "step"))
        found = both.filter("__peak > 0").groupBy(*keys).agg(F.min_by(point, sunny).alias("p"))
    return found.select(*keys, "p.*")
