"""Components and reachability over edge tables, as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .relational import keyed_join

#: Levels of a search that are one job.
HOPS = 6


def _checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``v`` and ``component`` (its smallest vertex) of every vertex in ``edges`` (``u``, ``v``).

    Alternating large-star and small-star steps; each round's edges are
    checkpointed, so the plan does not grow.  A vertex that many edges share is a
    hot key of both joins, whose smaller side has a row a vertex, so Spark can split
    it.  Rounds grow with the logarithm of the longest path.
    """
    now = _checkpointed(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = keyed_join(both, _lowest(both), ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _lowest(large)
        small = keyed_join(large, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        after = _checkpointed(small)
        # stable once every vertex points at one vertex that points at none
        moving = after.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u").unionByName(after.select(F.col("v").alias("u")).join(after.select("u"), "u", "left_semi").select("u"))
        now = after
        if moving.isEmpty():
            break
    return now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("component")).unionByName(now.select("v", F.col("v").alias("component")).distinct())


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node``: all that ``roots`` (``node``) reach over undirected ``edges`` (``a``, ``b``), themselves included.

    By components, so a long chain takes rounds by the logarithm of its length.
    """
    found = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    own = found.join(roots.select(F.col("node").alias("v")), "v", "left_semi").select("component").distinct()
    return found.join(own, "component", "left_semi").select(F.col("v").alias("node")).unionByName(roots.select("node")).distinct()


def waves(start: DataFrame, keys: list[str], step: Callable[[DataFrame], DataFrame], hops: int = HOPS) -> DataFrame:
    """``start`` (``keys``, others, ``depth`` 0) and all that ``step`` reaches from it, each where it is reached first.

    ``step`` gives the neighbours of a level's rows, one row of each key.  Edges lead
    both ways, so a level's neighbours lie in it or in the levels beside it: they
    are compared with two levels, never with all that was seen.  ``hops`` levels are
    one job and one checkpoint.
    """
    last, depth = _checkpointed(start), 0
    before, done = None, [last]
    while True:
        made = []
        for _ in range(hops):
            depth += 1
            new = step(last).join(last.select(keys), keys, "left_anti")
            new = new if before is None else new.join(before.select(keys), keys, "left_anti")
            before, last = last, new.withColumn("depth", F.lit(depth)).select(start.columns).persist()
            made.append(last)
        batch = _checkpointed(reduce(DataFrame.unionByName, made))
        for level in made:
            level.unpersist()
        done.append(batch)
        before, last = batch.filter(F.col("depth") == depth - 1), batch.filter(F.col("depth") == depth)
        if last.isEmpty():
            return reduce(DataFrame.unionByName, done)


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node`` and ``depth`` of all nodes that ``roots`` reach."""
    both = _checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    step = lambda level: both.join(level.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
    return waves(roots.select("node").distinct().withColumn("depth", F.lit(0)), ["node"], step)
