"""Aggregations over readings of many series, as groupings with partial sums on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse_repeats(df: DataFrame, keys: list[str | Column], value: str) -> DataFrame:
    """Mean of the rows of a key, their number, and whether they are in conflict (differ, or some are null)."""
    differ = (F.count_distinct(value) > 1) | ((F.count(value) > 0) & (F.count(value) < F.count("*")))
    return df.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n"), differ.alias("conflict"))


def complete_sum(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``total``: the sum of a key's values; null where one is missing."""
    return df.groupBy(*keys).agg(F.when(F.count(value) == F.count("*"), F.sum(value)).alias("total"))


def complete_series(df: DataFrame, key: str, slot: str, least: float) -> DataFrame:
    """``key``, ``completeness``: series that have at least the share ``least`` of all slots that occur."""
    slots = df.agg(F.count_distinct(slot)).scalar()
    share = df.groupBy(key).agg(F.count_distinct(slot).alias("n")).select(key, (F.col("n") / slots).alias("completeness"))
    return share.filter(F.col("completeness") >= least)


def scaled_mean(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """``total``: the mean of the values that are there, times ``n``; unbiased where some are missing."""
    return df.groupBy(*keys).agg((F.avg(value) * n).alias("total"))


def weighted_mean(df: DataFrame, keys: list[str], value: Column, weight: str) -> DataFrame:
    """``mean``: weighted by the capacities of those that report."""
    present = F.sum(F.when(value.isNotNull(), F.col(weight)))
    return df.groupBy(*keys).agg((F.sum(value * F.col(weight)) / F.nullif(present, F.lit(0.0))).alias("mean"))


def share_below(df: DataFrame, keys: list[str], value: str, bound: float) -> DataFrame:
    """``p``: the share of values below ``bound``."""
    return df.groupBy(*keys).agg(F.avg((F.col(value) < bound).cast("int")).alias("p"))


def diurnal(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``peak_hour``, ``ratio`` (largest to smallest hourly mean), ``mean``, ``capacity_factor`` (mean to peak hour's mean)."""
    hours = df.groupBy(key, F.hour(ts).alias("__h")).agg(F.avg(value).alias("__v"))
    top, mean = F.max("__v"), F.avg("__v")
    zero = F.lit(0.0)
    return hours.groupBy(key).agg(F.max_by("__h", "__v").alias("peak_hour"), (top / F.nullif(F.min("__v"), zero)).alias("ratio"), mean.alias("mean"), (mean / F.nullif(top, zero)).alias("capacity_factor"))


def daylight_correlation(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``r``: the correlation of two series where the second is positive; null with two readings or fewer."""
    return df.filter(F.col(b) > 0).groupBy(key).agg(F.when(F.count("*") > 2, F.corr(a, b)).alias("r"))


def local_hours(df: DataFrame, key: str, ts: str, value: str, zone: str) -> DataFrame:
    """Hourly means on a wall clock: the repeated hour of autumn is one mean, spring's skipped hour the middle of its neighbours.

    Only hours that the clock leaves out are filled, and only between hours that are there.
    """
    wall = F.date_trunc("hour", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts).cast("timestamp_ntz"))).cast("timestamp_ntz")
    hours = df.groupBy(key, wall.alias("wall")).agg(F.count("*").alias("n"), F.avg(value).alias(value))
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("wall")))
    hour = F.expr("interval 1 hour")
    around = hours.select(key, F.explode(F.array(F.struct((F.col("wall") + hour).alias("wall"), F.col(value).alias("__v")), F.struct((F.col("wall") - hour).alias("wall"), F.col(value).alias("__v")))).alias("x")).select(key, "x.*")
    skipped = around.filter(F.col("wall") != back).groupBy(key, "wall").agg(F.count("*").alias("__n"), F.avg("__v").alias(value)).filter("__n = 2")
    return hours.unionByName(skipped.select(key, "wall", F.lit(0).cast("long").alias("n"), value))


def paired_points(runs: DataFrame, kind: str, base: str, other: str, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Values of runs of kind ``base`` with those of ``other`` at the same operating point, and the verdict of ``base <= other``."""
    left = runs.filter(F.col(kind) == base).select(*keys, F.col(value).alias("base_value"))
    right = runs.filter(F.col(kind) == other).select(*keys, F.col(value).alias("other_value"))
    verdict = F.when(F.col("other_value").isNull(), "SKIP").when(F.col("base_value") <= F.col("other_value") + tolerance, "OK").otherwise("FAIL")
    return left.join(right, keys, "left").withColumn("verdict", verdict)
