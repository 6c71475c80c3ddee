"""Quality rules of long series (``series_id, ts_utc, value``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solar


def clip_negative(value: Column, small: float = 0.0) -> Column:
    """Null for negative values, 0 for those within ``small`` of it."""
    return F.when(value >= 0, value).when(value >= -small, 0.0)


def check_irradiance(df: DataFrame, latitude: float, longitude: float, minutes: int = 60) -> DataFrame:
    """Night becomes 0 first; then what no sky can give is null and ``rare`` marks what it seldom gives."""
    middle = F.col("ts_utc") + F.make_dt_interval(mins=F.lit(minutes // 2))
    mu = solar.cos_zenith(middle, latitude, longitude)
    lit = F.when(mu <= 0, F.when(F.col("value").isNotNull(), 0.0)).otherwise(F.col("value"))
    possible, rare = (solar.irradiance_limit(middle, mu, *k) for k in ((1.5, 100.0), (1.2, 50.0)))
    return df.withColumn("value", lit).withColumns({"rare": F.coalesce((F.col("value") > rare) & (F.col("value") <= possible), F.lit(False)), "value": F.when(F.col("value") <= possible, F.col("value"))})


def monthly_offsets(df: DataFrame, longitude: float, minutes: int, key: str = "series_id", ts: str = "ts_utc", value: str = "value", share: float = 0.2) -> DataFrame:
    """``key``, ``month``, ``off``, ``days``: the median of the days' minutes between the energy's centre and solar noon.

    Days are the sun's, so none is cut in two; only days with nine tenths of their
    steps count, and of these only days with at least ``share`` of the energy that
    nine in ten of the series' days do not exceed.
    """
    middle = F.col(ts) + F.make_dt_interval(mins=F.lit(minutes // 2), secs=F.lit(minutes % 2 * 30).cast("decimal(18,6)"))
    at = F.hour(middle) * 60 + F.minute(middle) + F.second(middle) / 60.0
    noon = 720 - 4.0 * longitude - solar.time_equation(solar.day_angle(middle))
    # minutes from noon, wrapped to half a day on either side
    off = F.pmod(at - noon + 720, F.lit(1440.0)) - 720
    day = F.to_date(middle + F.make_dt_interval(secs=F.lit(round(240 * longitude, 6)).cast("decimal(18,6)")))
    power = F.greatest(F.col(value), F.lit(0.0))
    daily = df.filter(F.col(value).isNotNull()).groupBy(key, day.alias("day")).agg(F.count("*").alias("n"), F.sum(power).alias("sum"), (F.sum(power * off) / F.nullif(F.sum(power), F.lit(0.0))).alias("off"))
    whole = daily.filter(F.col("n") >= 0.9 * 1440 / minutes)
    least = whole.groupBy(key).agg((F.percentile("sum", F.lit(0.9)) * share).alias("least"))  # a value a day
    return whole.join(least, key).filter((F.col("sum") >= F.col("least")) & F.col("off").isNotNull()).groupBy(key, F.trunc("day", "month").alias("month")).agg(F.median("off").alias("off"), F.count("*").alias("days"))


def alignment(df: DataFrame, longitude: float, minutes: int) -> DataFrame:
    """Per series: minutes between the energy's daily centre and solar noon, the months' spread and ``aligned``."""
    spread = F.when(F.count("*") >= 3, F.max("off") - F.min("off"))
    report = monthly_offsets(df, longitude, minutes).groupBy("series_id").agg((F.sum(F.col("off") * F.col("days")) / F.sum("days")).alias("offset_minutes"), spread.alias("spread_minutes"))
    return report.withColumn("aligned", (F.abs("offset_minutes") <= max(20.0, minutes / 3)) & F.coalesce(F.col("spread_minutes") <= 45, F.lit(True)))


def night_faulty(df: DataFrame, peaks: DataFrame, latitude: float, longitude: float, share: float = 0.02, minutes: int = 60) -> DataFrame:
    """Series that give over ``share`` of their peak (``series_id, kwp``) on over ``share`` of the nights' steps."""
    middle = F.col("ts_utc") + F.make_dt_interval(mins=F.lit(minutes // 2))
    dark = df.filter(solar.cos_zenith(middle, latitude, longitude) <= 0).join(peaks, "series_id")
    return dark.groupBy("series_id").agg(F.count_if(F.col("value") > share * F.col("kwp")).alias("lit"), F.count("*").alias("steps")).filter(F.col("lit") > share * F.col("steps")).select("series_id")


def completeness(df: DataFrame, least: float = 0.0) -> DataFrame:
    return df.groupBy("series_id").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("completeness"), F.count_if(F.col("value").isNull()).alias("nulls")).filter(F.col("completeness") >= least)


def duplicate_census(df: DataFrame) -> DataFrame:
    """How many rows share series and stamp, and how many of these are exact copies."""
    exact = df.groupBy("series_id", "ts_utc", "value").agg(F.count("*").alias("k"))
    return exact.groupBy("series_id", "ts_utc").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("same")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_sharing_stamp"), F.coalesce(F.sum("same"), F.lit(0)).alias("exact_copies"))
