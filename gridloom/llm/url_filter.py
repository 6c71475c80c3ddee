"""URL filters by host suffix and path prefix, in DataFrame functions only.

Every URL is expanded to the expressions ``host suffix + path prefix`` whose
shapes occur among the rules; their SHA-256 digests meet the rules' digests in
an equi-join on a short digest prefix, and the full digest confirms each hit.
The longest fitting rule gives the verdict.

Edge cases.  A null URL, or one without ``://``, has an empty host and path.  A
repeated URL is judged once and joined back, so a URL that a third of the rows
share costs one row in the expansion.  Repeated rows stay repeated.  Of equal
rules with different verdicts ``block`` wins.  Without rules, or when no rule
fits, the verdict is ``default``.  Input columns other than the two named are
not read, so any names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_join

#: Hexadecimal digits of the digest on which the join is made (4 bytes).
PREFIX = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = rest.substr(F.length(raw) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def parse_rules(rules: DataFrame) -> DataFrame:
    """``rule`` (host, then path from the first slash) and ``verdict`` -> digests and shapes."""
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule"))
    path = F.when(slash > 0, F.col("rule").substr(slash, F.length("rule"))).otherwise("")
    return (
        rules.filter("rule is not null")
        .select("rule", "verdict", F.translate(host, UPPER, LOWER).alias("rule_host"), path.alias("rule_path"))
        .withColumns({"labels": F.size(F.split("rule_host", r"\.")), "chars": F.length("rule_path"), "digest": F.sha2(F.concat("rule_host", "rule_path"), 256)})
        .groupBy("digest", "labels", "chars")
        .agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("hit"))
    )


def url_filter(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``key``, ``host``, ``path``, ``rule``, ``verdict``."""
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    known = parse_rules(rules)
    shapes = known.agg(F.collect_set(F.struct("labels", "chars")).alias("shapes")).scalar()
    parts = judged.select("host", "path").distinct().withColumns({"parts": F.split("host", r"\."), "shapes": shapes})
    fitting = F.filter("shapes", lambda s: (s["labels"] <= F.size("parts")) & (s["chars"] <= F.length("path")))
    expressed = F.transform(fitting, lambda s: F.sha2(F.concat(F.array_join(F.slice("parts", F.size("parts") - s["labels"] + 1, s["labels"]), "."), F.substring("path", F.lit(1), s["chars"])), 256))
    asked = parts.select("host", "path", F.explode(expressed).alias("asked"))
    hits = asked.withColumn("short", F.substring("asked", 1, PREFIX)).join(known.withColumn("short", F.substring("digest", 1, PREFIX)), "short").filter("asked = digest")
    best = hits.groupBy("host", "path").agg(F.max("hit").alias("hit"))
    return keyed_join(judged, best, ["host", "path"], "left").select(
        key, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )


#: The rules of the query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, verdict string")
