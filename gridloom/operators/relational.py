"""Joins and group operators of the warehouse layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group; Spark limits the groups before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join for which null keys are equal; the keys come once, from the left."""
    other = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(F.col(f"__r_{k}"))
    return left.join(other, same, how).drop(*(f"__r_{k}" for k in keys))


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which Spark can split the left side's hot keys.

    Adaptive execution splits skewed partitions only between two plain shuffles.
    An aggregate on ``right`` already lies by ``keys`` and would get none; a
    second key, derived from the first ones, gives it one.
    """
    other = right.select(*(F.col(k).alias(f"__key_{k}") for k in keys), *(c for c in right.columns if c not in keys), F.xxhash64(*keys).alias("__key"))
    same = F.xxhash64(*(left[k] for k in keys)) == F.col("__key")
    for k in keys:
        same = same & (left[k] == F.col(f"__key_{k}"))
    return left.join(other, same, how).drop("__key", *(f"__key_{k}" for k in keys))


def with_limits(facts: DataFrame, limits: DataFrame, key: str, value: str, low: str, high: str, in_scope: Column) -> DataFrame:
    """Limits joined and ``is_violation``: false out of scope, null where the limits are unknown."""
    joined = facts.join(limits, key, "left")
    outside = (F.col(value) < F.col(low)) | (F.col(value) > F.col(high))
    return joined.withColumn("is_violation", F.when(~in_scope, F.lit(False)).otherwise(outside))


def exists_in(facts: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """A boolean that says whether ``keys`` has the row's keys."""
    hits = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    return facts.join(hits, on, "left").withColumn(name, F.col("__hit").isNotNull()).drop("__hit")


def missing_keys(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return facts.select(key).distinct().join(dimension.select(key), key, "left_anti")


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and the batch's rows with new keys, one of each key (the smallest row)."""
    rest = [c for c in batch.columns if c not in keys]
    once = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*")
    return target.unionByName(once.join(target.select(*keys), keys, "left_anti"))


def outside_intervals(facts: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Rows that no closed interval of the same key covers; a null end is open."""
    bad = intervals.select(F.col(key).alias("__key"), F.col(start).alias("__start"), F.col(end).alias("__end"))
    hit = (F.col(key) == F.col("__key")) & (F.col(at) >= F.col("__start")) & (F.col("__end").isNull() | (F.col(at) <= F.col("__end")))
    return facts.join(bad, hit, "left_anti")


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows of both by key: same, changed, only in one."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.abs(F.col("a") - F.col("b")) <= tolerance, "same").otherwise("changed")
    return both.withColumn("status", status)


def rate_percent(hits: Column, rows: Column, digits: int = 2) -> Column:
    """Null without rows."""
    return F.round(100.0 * hits.cast("double") / F.nullif(rows.cast("double"), F.lit(0.0)), digits)


def within_spans(points: DataFrame, spans: DataFrame, step: str, start: str, length: str, width: int) -> DataFrame:
    """``points`` with each span ``[start, start + length)`` that holds their step: an equi-join on ranges of ``width`` steps."""
    ranges = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(length) - 1) / width))
    cut = spans.filter(F.col(length) > 0).withColumn("__range", F.explode(ranges))
    placed = points.withColumn("__range", F.floor(F.col(step) / width))
    return placed.join(cut, "__range").filter((F.col(step) >= F.col(start)) & (F.col(step) < F.col(start) + F.col(length))).drop("__range")


def nearest(df: DataFrame, distance: str, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows of the smallest distance."""
    return df.orderBy(distance, *ties).limit(most)
