"""Issues of series as a table, and the gate that a study's sources pass.

Every rule gives rows ``series_id, code, severity, n``; sources are a union of
them, so a report is one grouping, and a gate one small question to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality, series

#: Codes of the rules by how grave they are.
SEVERITIES = {"error": ("no_values", "misaligned", "lit_at_night", "conflicting_stamps"), "warning": ("gaps", "negative", "impossible", "rare", "flat", "repeated_stamps")}
ISSUES = "series_id string, code string, severity string, n long"


class QualityError(ValueError):
    """Sources that a study must not be built on."""


def issue(rows: DataFrame, code: str, n: str = "n") -> DataFrame:
    """``rows`` (``series_id``, a count) as issues of one code; counts of 0 are none."""
    severity = next(s for s, codes in SEVERITIES.items() if code in codes)
    return rows.filter(F.col(n) > 0).select(F.col("series_id").cast("string").alias("series_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(n).cast("long").alias("n"))


def basic(rows: DataFrame, seconds: int, longest_flat: int = 12) -> DataFrame:
    """Gaps, negative values, series without values, repeated and conflicting stamps, long runs of one value that is not 0."""
    value = F.col("value")
    stamps = rows.filter("ts_utc is not null").groupBy("series_id", "ts_utc").agg(F.count("*").alias("k"), F.count_distinct("value").alias("values"), F.count("value").alias("there"), F.max("value").alias("value"))
    span = F.round((F.unix_timestamp(F.max("ts_utc")) - F.unix_timestamp(F.min("ts_utc"))) / seconds) + 1
    each = stamps.groupBy("series_id").agg(
        F.count_if(F.col("there") == 0).alias("nulls"), (span - F.count("*")).alias("absent"), F.count_if(F.col("there") > 0).alias("known"),
        F.count_if(F.col("k") > 1).alias("repeated"), F.count_if(F.col("values") > 1).alias("conflicting"), F.count_if(value < 0).alias("negative"),
    )
    whole = each.withColumns({"gaps": F.col("nulls") + F.greatest("absent", F.lit(0)), "empty": (F.col("known") == 0).cast("int")})
    flat = series.runs(stamps.select("series_id", "ts_utc", "value"), "series_id", ["ts_utc"], "value").filter("value <> 0").groupBy("series_id", "run").agg(F.count("*").alias("n")).filter(F.col("n") > longest_flat)
    flats = flat.groupBy("series_id").agg(F.sum("n").alias("n"))
    parts = [issue(whole, code, column) for code, column in (("gaps", "gaps"), ("no_values", "empty"), ("repeated_stamps", "repeated"), ("conflicting_stamps", "conflicting"), ("negative", "negative"))]
    return reduce(DataFrame.unionByName, [*parts, issue(flats, "flat")])


def irradiance(rows: DataFrame, latitude: float, longitude: float, minutes: int) -> DataFrame:
    """Values that no sky gives, values that it seldom gives, and series whose day is not the sun's."""
    checked = quality.check_irradiance(rows.withColumn("given", F.col("value")), latitude, longitude, minutes)
    counts = checked.groupBy("series_id").agg(F.count_if(F.col("given").isNotNull() & F.col("value").isNull()).alias("impossible"), F.count_if("rare").alias("rare"))
    late = quality.alignment(checked, longitude, minutes).filter("not aligned").select("series_id", F.lit(1).alias("n"))
    return reduce(DataFrame.unionByName, [issue(counts, "impossible", "impossible"), issue(counts, "rare", "rare"), issue(late, "misaligned")])


def fleet(rows: DataFrame, peaks: DataFrame, latitude: float, longitude: float, minutes: int) -> DataFrame:
    """Systems that give power at night."""
    return issue(quality.night_faulty(rows, peaks, latitude, longitude, minutes=minutes).withColumn("n", F.lit(1)), "lit_at_night")


def report(issues: DataFrame) -> DataFrame:
    """``code, severity, series, n``: how many series an issue touches, and how often."""
    return issues.groupBy("code", "severity").agg(F.count_distinct("series_id").alias("series"), F.sum("n").alias("n"))


def passed(issues: DataFrame, name: str, allow: tuple[str, ...] = ()) -> list[dict]:
    """The report as rows for a manifest; an error that names what is grave and not allowed.

    At most a row a code reaches the driver.
    """
    found = [r.asDict() for r in report(issues).orderBy("severity", "code").collect()]
    grave = [r for r in found if r["severity"] == "error" and r["code"] not in allow]
    if grave:
        raise QualityError(f"{name}: " + "; ".join(f"{r['code']} in {r['series']} series" for r in grave))
    return found


def good_series(rows: DataFrame, issues: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` of series without a grave issue: a fleet goes on without its faulty members."""
    bad = issues.filter((F.col("severity") == "error") & ~F.col("code").isin(*allow, "")).select("series_id").distinct()
    return rows.join(bad, rows["series_id"].cast("string") == bad["series_id"], "left_anti")
