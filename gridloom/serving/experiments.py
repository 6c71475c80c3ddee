"""The data side of experiments: which cells are still to run, and protocols derived from others.

Specifications are nested JSON.  Two are the same if their canonical forms are:
names sorted at every level, no white space, numbers by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import latest

#: Options of a run, what they default to, and what a derived run adds.
METHODS_OPTION, CRITERION_OPTION, PLAIN_CRITERION = "--methods", "--qsts-criterion", "zero_tolerance"
DEFAULT_METHODS = ("deterministic", "stochastic", "qsts")
FASTER = 20


def canonical(spec: Column) -> Column:
    """A JSON text's canonical form; null if it is none."""
    return F.to_json(F.try_parse_json(spec))


def spec_digest(spec: Column) -> Column:
    return F.sha2(canonical(spec), 256)


def cell_states(cells: DataFrame, manifests: DataFrame) -> DataFrame:
    """``id``, ``digest`` and ``state`` of every cell: ``done``, ``failed``, ``changed`` or ``new``; ``clean`` says that old output must go first.

    ``cells``: ``id``, ``spec``; ``manifests``: ``id``, ``cell`` (the specification
    that ran), ``returncode``, ``started``.  Done is a cell whose last run of this
    very specification ended with 0.  A cell with runs but none of its
    specification has changed.  A specification that is no JSON fails the job.
    """
    wrong = F.raise_error(F.concat(F.lit("no specification: cell "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("string")
    own = cells.select("id", F.coalesce(spec_digest(F.col("spec")), wrong).alias("digest"))
    ran = manifests.select("id", spec_digest(F.col("cell")).alias("digest"), "returncode", "started")
    last = latest(ran.filter("digest is not null"), ["id", "digest"], [F.desc_nulls_last("started"), F.desc_nulls_last("returncode")]).select("id", "digest", "returncode")
    known = manifests.select("id").distinct().withColumn("__ran", F.lit(True))
    both = own.join(last, ["id", "digest"], "left").join(known, "id", "left")
    state = F.when(F.col("returncode") == 0, "done").when(F.col("returncode").isNotNull(), "failed").when(F.col("__ran"), "changed").otherwise("new")
    return both.select("id", "digest", state.alias("state"), (~state.isin("done", "new")).alias("clean"))


def pending(cells: DataFrame, manifests: DataFrame) -> DataFrame:
    """The cells that are still to run, with ``state`` and ``clean``."""
    todo = cell_states(cells, manifests).filter("state <> 'done'")
    return cells.join(todo, "id")


def methods_of(args: Column) -> Column:
    """The values of the methods' option, up to the next option; the default where it is absent."""
    at = F.array_position(args, METHODS_OPTION).cast("int")
    rest = F.slice(args, at + 1, F.greatest(F.size(args) - at, F.lit(0)))
    # the first option after it ends the list
    ends = F.array_position(F.transform(rest, lambda x: x.startswith("--")), True).cast("int")
    named = F.when(ends > 0, F.slice(rest, F.lit(1), ends - 1)).otherwise(rest)
    return F.when(at > 0, named).otherwise(F.array(*map(F.lit, DEFAULT_METHODS)))


def uses_duration(args: Column) -> Column:
    """Whether a run judges a series by a criterion over time."""
    at = F.array_position(args, CRITERION_OPTION).cast("int")
    criterion = F.get(args, at)
    return (at > 0) & (F.coalesce(criterion, F.lit(PLAIN_CRITERION)) != PLAIN_CRITERION) & F.array_contains(methods_of(args), "qsts")


def derived_protocol(runs: DataFrame, device: str) -> DataFrame:
    """``runs`` (``protocol``, ``run``, ``args``, ``estimate_min``) as those of a derived protocol.

    Runs by a criterion over time get the batched backend's options, and a
    shorter estimate if they do nothing else; others stay.  ``backend`` says which
    is which, and ``source_digest`` ties every row to the protocol it came from:
    SHA-256 over the runs' digests by run.
    """
    fast = uses_duration(F.col("args"))
    added = F.concat("args", F.array(*map(F.lit, ("--qsts-backend", "torch", "--device", device))))
    alone = fast & (methods_of(F.col("args")) == F.array(F.lit("qsts")))
    shorter = F.greatest(F.lit(1), F.bround(F.col("estimate_min") / FASTER).cast("long"))
    own = F.sha2(F.to_json(F.struct("run", "args", "estimate_min")), 256)
    source = runs.groupBy("protocol").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", own.alias("h")))), lambda x: x["h"]), ","), 256).alias("source_digest"))
    made = runs.select(
        "protocol", "run", F.when(fast, added).otherwise(F.col("args")).alias("args"), F.when(alone, shorter).otherwise(F.col("estimate_min").cast("long")).alias("estimate_min"),
        F.when(fast, "torch").otherwise("pandapower").alias("backend"),
    )
    return made.join(source, "protocol")
