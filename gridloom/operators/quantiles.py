"""Exact order statistics of large groups.

Groups of at most ``WHOLE`` rows are sorted whole, many to a task.  The different
values of a larger one are counted and cut into ranges at their own approximate
quantiles, and only the ranges that hold a wanted rank are sorted, so no task
sorts a large group, wherever its values lie.  The cuts only say who sorts what;
ranks come from exact counts.  Null keys are keys like others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .relational import null_safe_join

#: Ranges into which a group's different values are cut, and the accuracy of the cuts.
RANGES, ACCURACY = 128, 1000
#: Rows of a group that one task sorts.
WHOLE = 100_000


def confidence_ranks(n: int, q: float, confidence: float) -> tuple[int | None, int | None]:
    """Ranks of the order statistics around a quantile, from the binomial distribution; none if ``n`` is too small.

    Terms beyond 40 standard deviations from the mean are left out; they are below 1e-300.
    """
    sd = math.sqrt(n * q * (1 - q))
    first, last = max(0, math.floor(n * q - 40 * sd - 40)), min(n, math.ceil(n * q + 40 * sd + 40))
    k = np.arange(first, last, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1) * q / (1 - q)))])
    terms = np.exp(logs - logs.max())
    total, tail = np.cumsum(terms) / terms.sum(), (1 - confidence) / 2
    low, high = np.flatnonzero(total <= tail), np.flatnonzero(total >= 1 - tail)
    high = high[first + high + 1 <= n]
    return (int(first + low[-1] + 1) if len(low) else None), (int(first + high[0] + 1) if len(high) else None)


def values_at(df: DataFrame, keys: list[str], value: str, ranks: DataFrame, whole: int = WHOLE) -> DataFrame:
    """``keys``, ``name``, ``value``: the value at each rank (from 1, nulls not counted) of ``ranks`` (``keys``, ``name``, ``rank``)."""
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("__key"), F.col(value).alias("__v"))
    wanted = ranks.select(F.struct(*keys).alias("__key"), "name", "rank")
    large = F.broadcast(rows.groupBy("__key").agg(F.count("*").alias("__n")).filter(F.col("__n") > whole).select("__key"))  # at most a group each ``whole`` rows
    # the struct is the key of window and join, nulls in it are equal: its rows are dealt out once
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__v"))
    small = rows.join(large, "__key", "left_anti").withColumn("__place", place).join(wanted, "__key").filter(F.col("__place") == F.col("rank"))
    cut = _by_ranges(rows.join(large, "__key", "left_semi").select("__key.*", "__v"), keys, wanted.join(large, "__key", "left_semi").select("__key.*", "name", "rank"))
    return small.select("__key.*", "name", F.col("__v").alias("value")).unionByName(cut)


def _by_ranges(rows: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """The same of groups that no task sorts whole; ``rows`` are ``keys`` and ``__v``."""
    known = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    cuts = known.groupBy(*keys).agg(F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)], ACCURACY).alias("__cuts"))
    place = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
    placed = null_safe_join(known, cuts, keys).select(*keys, place.alias("__b"), "__v", "__n")
    sums = placed.groupBy(*keys, "__b").agg(F.sum("__n").alias("__all"))
    before = F.coalesce(F.sum("__all").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = (F.col("rank") > F.col("__before")) & (F.col("rank") <= F.col("__before") + F.col("__all"))
    wanted = null_safe_join(sums.withColumn("__before", before), ranks, keys).filter(within).select(*keys, "__b", "name", (F.col("rank") - F.col("__before")).alias("__rank"))
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__b", "name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    found = null_safe_join(placed, wanted, [*keys, "__b"]).withColumn("__upto", upto)
    here = (F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__n"))
    return found.filter(here).select(*keys, "name", F.col("__v").alias("value"))


def _wide(found: DataFrame, keys: list[str], groups: DataFrame, names: list[str]) -> DataFrame:
    pivoted = found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))
    return null_safe_join(groups, pivoted, keys, "left")


def _ranks(groups: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()))
    return groups.select(*keys, F.explode(pairs).alias("r")).select(*keys, "r.name", "r.rank")


def _sizes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("__size"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles, one column a share."""
    groups, n = _sizes(df, keys, value), F.col("__size")
    at = {name: (n - 1) * F.lit(q) for name, q in shares.items()}
    ranks = {f"{name}_{side}": F.when(n > 0, cut(p) + 1) for name, p in at.items() for side, cut in (("lo", F.floor), ("hi", F.ceil))}
    wide = _wide(values_at(df, keys, value, _ranks(groups, keys, ranks)), keys, groups, list(ranks))
    line = lambda name: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at[name] - F.floor(at[name]))
    return wide.select(*keys, *(line(name).alias(name) for name in shares))


def quantile_type1(df: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """The value of rank ``ceil(q n)`` of each group."""
    groups = _sizes(df, keys, value)
    rank = F.greatest(F.ceil(F.lit(q) * F.col("__size") - 1e-9), F.lit(1))
    return _wide(values_at(df, keys, value, _ranks(groups, keys, {name: rank})), keys, groups, [name]).drop("__size")


def quantile_interval(df: DataFrame, keys: list[str], value: str, q: float, confidence: float) -> DataFrame:
    """``n``, ``lo``, ``hi``: distribution-free interval of a quantile from each group's own size; an end is null where the group is too small."""
    ship(df.sparkSession)

    @F.pandas_udf("low long, high long")
    def ends(n: pd.Series) -> pd.DataFrame:
        made = {k: confidence_ranks(int(k), q, confidence) for k in n.unique()}
        return pd.DataFrame({"low": [made[k][0] for k in n], "high": [made[k][1] for k in n]}, dtype="Int64")

    groups = _sizes(df, keys, value)
    known = groups.select("__size").distinct().withColumn("__ends", ends("__size"))
    ranked = groups.join(known, "__size")
    found = values_at(df, keys, value, _ranks(ranked, keys, {"lo": F.col("__ends.low"), "hi": F.col("__ends.high")}))
    return _wide(found, keys, groups, ["lo", "hi"]).withColumnRenamed("__size", "n")
