"""Exact top-k search by integer inner product, block at a time.

Vectors are quantised to integer weights and dealt, in ranges of ``BLOCK``
consecutive rows, to shards; a shard sorts its vectors by id and cuts them into
blocks.  A block keeps its forward index (the weights of its vectors) and each
term's largest and smallest weight.  A query bounds a block by the sum of its
terms' best products, scores blocks in the order of these bounds, and stops at
the first block whose bound is below its k-th score so far.

Queries against all rows is the task, so each group of queries meets each shard
of blocks once; both have a fixed size, so a task's memory does not depend on
the data, and only k rows per query and shard leave a task.  Where shards are
many, each query first meets one of them alone, and takes its k-th score there
to the others, which need only beat it.

Scores are exact at any size: sums that 64-bit floats cannot hold are made of
whole numbers, and rows are ranked by scores of up to 38 digits.

Edge cases.  Null vectors and vectors with null or non-finite components take
no part, neither as queries nor as candidates, nor do rows without an id.
Shorter vectors count as padded with zeros.  Ties go to the smaller id.  Repeated
rows and rows that share an id are rows of their own: only the query's very row
is no candidate for it, and each query row has its own ranks from 1.  A weight beyond
1.7e308 counts as that; a score beyond 64 bits is returned as the nearest long,
and ranks as 10^38 - 1 at most.
A query with fewer candidates than k returns all.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BLOCK, SHARD, GROUP = 256, 8192, 4096
#: Whole numbers that 64-bit floats hold exactly are smaller than this.
EXACT = 2.0**53
_LEAST, _MOST = -(10**38) + 1, 10**38 - 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = flat.value_lengths().to_numpy()
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat.flatten().to_numpy()
    return out


def search_shard(ids: np.ndarray, own: np.ndarray, rows: np.ndarray, query_own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None, block: int = BLOCK):
    """The best ``k`` of ``rows`` for each query: (query index, row index, score).

    ``own`` and ``query_own`` number the rows, so that none is its own candidate;
    scores below ``floor`` are not wanted.  Weights must be such that floats hold
    all sums.
    """
    order = np.lexsort((own, ids))
    ids, own, rows = ids[order], own[order], rows[order]
    cuts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(rows, cuts), np.minimum.reduceat(rows, cuts)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = plus @ high.T + minus @ low.T
    turn = np.argsort(-bound, axis=1, kind="stable")
    n = len(query_own)
    floor = np.full(n, -np.inf) if floor is None else floor
    best = np.full((n, k), -np.inf)
    which = np.full((n, k), len(ids), np.int64)
    alive = np.arange(n)
    for step in range(len(cuts)):
        at = turn[alive, step]
        going = bound[alive, at] >= np.maximum(best[alive, k - 1], floor[alive])
        alive, at = alive[going], at[going]
        if not len(alive):
            break
        for b in np.unique(at):
            q = alive[at == b]
            lo, hi = cuts[b], min(cuts[b] + block, len(ids))
            score = queries[q] @ rows[lo:hi].T
            score[(own[lo:hi][None, :] == query_own[q][:, None]) | (score < floor[q][:, None])] = -np.inf
            # only rows that reach the k-th score can enter, ties by smaller id
            some = np.flatnonzero((score >= best[q, k - 1][:, None]).any(axis=1) & np.isfinite(score.max(axis=1)))
            if not len(some):
                continue
            q, score = q[some], score[some]
            all_scores = np.concatenate([best[q], score], axis=1)
            all_rows = np.concatenate([which[q], np.broadcast_to(np.arange(lo, hi), score.shape)], axis=1)
            pick = np.lexsort((all_rows, -all_scores), axis=1)[:, :k]
            best[q] = np.take_along_axis(all_scores, pick, axis=1)
            which[q] = np.take_along_axis(all_rows, pick, axis=1)
    found = np.isfinite(best)
    q, _ = np.nonzero(found)
    return q, order[which[found]], best[found]


def exact_best(ids, own, rows, query_own, query, k: int, step: int = 1 << 18) -> tuple[list[int], list[int]]:
    """The best ``k`` of ``rows`` for one query, by sums of Python's whole numbers: row indices and scores."""
    asked, found = [int(x) for x in query], []
    for lo in range(0, len(rows), max(1, step // max(1, rows.shape[1]))):
        part = rows[lo : lo + max(1, step // max(1, rows.shape[1]))]
        sums = [sum(int(x) * y for x, y in zip(row, asked, strict=True)) for row in part.tolist()]
        found += [(-s, ids[lo + i], lo + i) for i, s in enumerate(sums) if own[lo + i] != query_own]
        found = sorted(found)[:k]
    return [i for _, _, i in found], [min(max(-s, _LEAST), _MOST) for s, _, _ in found]


def search(ids, own, rows, query_own, queries, k: int, floor=None):
    """``search_shard``, whatever the weights; scores come as whole numbers."""
    width = max(rows.shape[1], queries.shape[1])
    rows, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, queries))
    most = math.sqrt(EXACT / max(1, width))
    tame, calm = (np.abs(x).max(axis=1, initial=0) < most for x in (rows, queries))
    q, r, score = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if tame.any() and calm.any():
        q, r, found = search_shard(ids[tame], own[tame], rows[tame], query_own[calm], queries[calm], k, None if floor is None else floor[calm])
        q, r, score = np.flatnonzero(calm)[q], np.flatnonzero(tame)[r], found.astype(np.int64).tolist()
    for asks, held in ((calm, np.flatnonzero(~tame)), (~calm, np.arange(len(tame)))):  # rare, so one query at a time
        for at in np.flatnonzero(asks) if len(held) else ():
            first, found = exact_best(ids[held], own[held], rows[held], query_own[at], queries[at], k)
            q, r = np.append(q, np.full(len(first), at)), np.append(r, held[first].astype(np.int64))
            score += found
    return q, r, score


def topk_search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the best ``k`` rows for each row where ``is_query`` holds."""
    value = F.col(vector)
    fit = value.isNotNull() & F.col(key).isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    # a weight beyond the longs' range is whole as it is
    weight = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    whole = F.transform(value, lambda x: weight(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(1.7e308)), F.lit(-1.7e308))))
    rows = vectors.filter(fit).select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("own"), whole.alias("weights"))
    # written down, so that a row keeps its number in every branch below, whatever is lost meanwhile
    rows = checkpointed(rows.withColumn("asks", is_query(F.col("id"))))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, groups = max(1, math.ceil(n / SHARD)), max(1, math.ceil(asked / GROUP))
    shard = F.pmod(F.xxhash64(F.expr(f"own div {BLOCK}")), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("own"), F.lit(groups)).cast("int")

    def run(cells: pa.Table) -> pa.Table:
        asks = cells["asks"].to_numpy()
        ids, own, matrix = cells["id"].to_numpy(), cells["own"].to_numpy(), _matrix(cells["weights"])
        q, r, score = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if asks.any() and not asks.all():
            floor = cells["floor"].to_numpy()[asks] if "floor" in cells.column_names else None
            q, r, score = search(ids[~asks], own[~asks], matrix[~asks], own[asks], matrix[asks], k, floor)
        made = [pa.array(x, pa.int64()) for x in (own[asks][q], ids[asks][q], own[~asks][r], ids[~asks][r])]
        return pa.table([*made, pa.array(score, pa.decimal128(38, 0))], ["asker", "query_id", "own", "vec_id", "score"])

    made = "asker long, query_id long, own long, vec_id long, score decimal(38,0)"
    cell = lambda g, s, asks: F.struct(g.cast("int").alias("g"), s.cast("int").alias("s"), F.lit(asks).alias("asks"))
    every = lambda count: F.sequence(F.lit(0), F.lit(count - 1))
    held = F.transform(every(groups), lambda g: cell(g, shard, False))
    columns = ["id", "own", "weights", "cell.*"]
    place = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "own")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)

    if shards < 3:
        asking = F.when(F.col("asks"), F.transform(every(shards), lambda s: cell(group, s, True))).otherwise(F.array())
        found = rows.select("id", "own", "weights", F.explode(F.concat(held, asking)).alias("cell")).select(columns).groupBy("g", "s").applyInArrow(run, made)
    else:
        # first one shard a query, dealt evenly; then its k-th score there is the least that the others must reach
        first = F.pmod(F.xxhash64("own", F.lit("first")), F.lit(shards)).cast("int")
        cells = lambda asking: F.explode(F.concat(held, F.when(F.col("asks"), asking).otherwise(F.array()))).alias("cell")
        seen = rows.select("id", "own", "weights", cells(F.array(cell(group, first, True)))).select(columns).groupBy("g", "s").applyInArrow(run, made)
        least = seen.groupBy("asker").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k)
        # rounded down, so that no row of that very score is lost
        least = least.select("asker", (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15).alias("floor"))
        others = F.transform(F.filter(every(shards), lambda s: s != first), lambda s: cell(group, s, True))
        again = rows.join(least, F.col("own") == F.col("asker"), "left").select("id", "own", "weights", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), cells(others)).select(*columns, "floor")
        found = seen.unionByName(again.groupBy("g", "s").applyInArrow(run, made))
    long = F.lit(2**63 - 1).cast("decimal(38,0)")
    score = F.greatest(F.least("score", long), -long - 1).cast("long")
    return best(found).select("query_id", "rank", "vec_id", score.alias("score"))
