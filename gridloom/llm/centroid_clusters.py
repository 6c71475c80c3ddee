"""Exact k-means over whole numbers by delta rounds.

Vectors become whole numbers once.  Every round writes each vector with its
cluster and its distance to it, and the driver keeps each cluster's count and
component sums (``k`` times the width).  A round reads the last one's table and
compares a vector with the centroids that changed since, as no other can have
come nearer; a vector whose own centroid changed meets all of them.  Only vectors
that moved are read again: their components, summed by old and new cluster, are
the signed transfers that the sums take.  If no centroid changes the rounds
are over, as all later ones would repeat it.

A round's table is written to the shared folder and the one before it is
removed.  Transfers are at most k * k rows a component; nothing else reaches the
driver, and only centroids go out.

Exactness.  Distances are made in floats where these hold them, in 64-bit
integers where those do, else in Python's whole numbers.  Sums are kept in two
halves and put together in whole numbers.

Edge cases.  Vectors of another width, null ones and those holding null or
non-finite components take no part.  Components beyond 2^53 after scaling count
as that; a distance or inertia beyond 64 bits is returned as the largest long.
Repeated rows are vectors of their own.  A null id hashes as an empty one; equal
hashes go by the vector.  With fewer than ``k`` vectors each is a centroid.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import removed, slices, written

#: Components are cut at this, and added up in two halves of which the lower has so many bits.
MOST, LOW = 2**53, 26
LONG = 2**63 - 1


def whole_vectors(vectors: DataFrame, width: int, scale: int, key: str, vector: str) -> DataFrame:
    """``id`` and ``v``, the components of every fit vector as longs."""
    value = F.col(vector)
    fit = value.isNotNull() & (F.size(value) == width) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    cut = lambda x: F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(MOST))), F.lit(-float(MOST)))
    return vectors.filter(F.coalesce(fit, F.lit(False))).select(F.col(key).alias("id"), F.transform(value, lambda x: F.floor(cut(x)).cast("long")).alias("v"))


def seeds(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the ``k`` smallest hashes of salted ids, by hash."""
    mark = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in rows.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()]


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``v`` to rows of ``c``, exact; of Python's whole numbers if no other type holds them."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    bound = v.shape[1] * (2 * most) ** 2
    if bound < 2**53:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a, b = (v, c) if bound < 2**63 else (v.astype(object), c.astype(object))
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


def nearest(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; ``owner`` -1 has none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner] | (distance == LONG)
    some = np.flatnonzero(changed)
    kept = np.flatnonzero(~lost)
    if len(some) and len(kept):
        d = distances(v[kept], centroids[some])
        best = d.argmin(1)
        least, number = d[np.arange(len(kept)), best], some[best]
        nearer = (least < distance[kept]) | ((least == distance[kept]) & (number < owner[kept]))
        owner[kept[nearer]], distance[kept[nearer]] = number[nearer], least[nearer]
    if lost.any():
        d = distances(v[lost], centroids)
        best = d.argmin(1)
        owner[lost], distance[lost] = best, np.minimum(d[np.arange(len(best)), best], LONG).astype(np.int64)
    return owner, distance


def assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """Every vector with its cluster and distance now, and the cluster before."""
    first = "cluster" not in state.columns

    def run(batches):
        for batch in slices(batches, 8192):
            n, v = batch.num_rows, batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            before = np.full(n, -1, np.int64) if first else batch.column("cluster").to_numpy().astype(np.int64)
            owner, distance = nearest(v, before, np.zeros(n, np.int64) if first else batch.column("distance").to_numpy(), centroids, changed)
            columns = [batch.column("id"), batch.column("v"), *(pa.array(x.astype(t)) for x, t in ((owner, np.int32), (distance, np.int64), (before, np.int32))), pa.array(owner != before)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cluster", "distance", "origin", "moved"])

    kind = state.schema["id"].dataType.simpleString()
    return state.mapInArrow(run, f"id {kind}, v array<long>, cluster int, distance long, origin int, moved boolean")


def transfers(state: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """(old cluster, new cluster, component, sum, vectors) of the vectors that moved."""
    parts = state.filter("moved").select("origin", "cluster", F.posexplode("v").alias("at", "x"))
    high, low = F.sum(F.shiftright("x", LOW)), F.sum(F.col("x").bitwiseAND(2**LOW - 1))
    found = parts.groupBy("origin", "cluster", "at").agg(high.alias("high"), low.alias("low"), F.count("*").alias("n")).collect()
    return [(r.origin, r.cluster, r["at"], (r.high << LOW) + r.low, r.n) for r in found]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` of every vector that takes part."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, width, scale, key, vector)
    centroids = np.array(seeds(rows, k, salt), np.int64).reshape(-1, width)
    base = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    changed = np.ones(len(centroids), bool)
    counts = [0] * len(centroids)
    sums = [[0] * width for _ in centroids]
    state = rows
    for r in range(rounds + 1 if len(centroids) else 0):
        state = written(assigned(state, centroids, changed), f"{base}/{r}")
        if r:
            removed(spark, f"{base}/{r - 1}")
        if r == rounds:
            break
        for old, new, at, total, n in transfers(state):
            for c, sign in ((old, -1), (new, 1)):
                if c >= 0:
                    sums[c][at] += sign * total
                    counts[c] += sign * n * (at == 0)
        later = np.array([[x // counts[c] for x in sums[c]] if counts[c] else centroids[c] for c in range(len(centroids))], np.int64)
        changed = (later != centroids).any(axis=1)
        centroids = later
        if not changed.any():
            break
    if not len(centroids):
        state = assigned(rows.limit(0), np.zeros((1, width), np.int64), np.ones(1, bool))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    each = state.groupBy("cluster").agg(exact.alias("total")).collect()  # k rows
    total = sum(int(r.total) for r in each)
    told = [(int(r.cluster), min(int(r.total), LONG), min(total, LONG), [int(x) for x in centroids[r.cluster]]) for r in each]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return state.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
