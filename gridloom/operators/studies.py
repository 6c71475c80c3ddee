"""Summaries of hosting-capacity results: weeks of a year, scenarios of a study."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quantiles
from .relational import null_safe_join


def annual(weeks: DataFrame) -> DataFrame:
    """The least of the bounded weeks, its week, and the spread over bounded weeks only."""
    bounded = F.col("bounded")
    value = F.when(bounded, F.col("capacity"))
    return weeks.agg(F.min(value).alias("capacity"), F.min_by(F.when(bounded, F.col("win")), F.when(bounded, F.struct("capacity", "win"))).alias("critical_window"), *(F.percentile(value, q).alias(f"p{int(100 * q)}") for q in (0.1, 0.5, 0.9)), F.count_if(~bounded).alias("censored"))


def stochastic(found: DataFrame, keys: list[str], alpha: float = 0.1, confidence: float = 0.95) -> DataFrame:
    """The ``alpha`` quantile of each study's capacities (``lambda_max``, ``bounded``) with its distribution-free interval."""
    counts = found.groupBy(*keys).agg(F.count_if(~F.col("bounded")).alias("censored"), F.count("*").alias("scenarios"))
    value = quantiles.quantile_type1(found, keys, "lambda_max", alpha, "lambda")
    ends = quantiles.quantile_interval(found, keys, "lambda_max", alpha, confidence).select(*keys, F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    return null_safe_join(null_safe_join(counts, value, keys), ends, keys)


def violation_probability(found: DataFrame, lambdas: list[float]) -> DataFrame:
    """Share of scenarios whose capacity is below each ``lambda``."""
    return found.select("lambda_max", F.explode(F.array(*map(F.lit, lambdas))).alias("lambda")).groupBy("lambda").agg(F.avg((F.col("lambda_max") < F.col("lambda")).cast("int")).alias("p"))
