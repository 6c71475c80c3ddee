"""N-gram Jaccard self-join by chosen paths.

A document's set is that of its word runs of ``GRAM`` words.  Equal sets are
joined first, by digest, and stand as one set from then on.  Every set is
embedded into ``TOKENS`` min-hash tokens; a run starts all sets in one node, and
a node passes a set on to the children named by those of its tokens that a hash
of node and token samples, ``1 / THRESHOLD`` of them on average.  So two sets at
the threshold share one child on average, more similar ones more, dissimilar
ones soon none.  Nodes of at most ``SMALL`` sets are brute-forced, larger ones
split again, in ``RUNS`` runs.  A node that ``DEPTH`` splits leave large is
brute-forced in tiles, so no set is ever dropped.  A pair at the very threshold
meets in a run with a chance of 0.63, 0.47, 0.37, 0.31, 0.27 and 0.24 after one to
six levels, so 16 runs that were independent would miss it with under 0.0001 % to 1.4 %;
they share one set of min-hashes, so the true figure is somewhat higher.  More
similar pairs are missed less.  Tests ask for 99 % of the links at 0.8 to 0.85
without a split and for 97 % with nodes of at most 20 sets.

Brute force in a node compares min-hash tokens and yields only a forest of the
likely pairs; the forests' components are blocks of similar sets.  Within each
block all pairs are then decided exactly, on whole sets, once, in tiles of
bounded size; a tile yields link counts and again a forest, never pairs.

Edge cases.  Words are those of ``words.py``; a text with fewer than ``GRAM``
words has one run of all its words, and one without words (null, empty) has no
set, no links and its own class.  Repeated rows count as documents of their own
and link to each other; ``class_id`` is the smallest id of a class.  A null id
stays null and counts as larger than all others; a class of null ids alone has a
null ``class_id``.  ``class_key`` tells classes apart whatever their ids (null
for texts without words).  An empty table gives no rows.  Other columns are not
read, but those named in ``carry`` pass through, unless named as the results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.network import components
from .common import SPACES, checkpointed, keyed_join, slices
from .words import gram_hashes, mixed, word_hashes

GRAM, THRESHOLD = 5, 0.8
TOKENS, RUNS, DEPTH, SMALL, TILE = 128, 16, 5, 2048, 256
#: Runs of words in a tile's sets, on average, from which its sets are fewer than ``TILE``.
RUN = 2000
#: A pair is likely if this share of its tokens agrees: four standard errors under the threshold.
LIKELY = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / TOKENS)

#: The same for the low bits of the tokens, of which unlike tokens agree in half.
LIKELY_BITS = (1 + THRESHOLD) / 2 - 4 * math.sqrt((1 + THRESHOLD) * (1 - THRESHOLD) / 4 / TOKENS)

_ODD = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, size=TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = (np.arange(TOKENS, dtype=np.uint64) + np.uint64(1)) << np.uint64(16)
_CHOSEN = np.uint64(int(2**64 / THRESHOLD / TOKENS))


def gram_set(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a whole text."""
    words = word_hashes(data)
    return np.unique(gram_hashes(words, min(GRAM, max(1, len(words)))))


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """``TOKENS`` min-hash values of 64 bits."""
    least = np.full(TOKENS, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 1024):
        least = np.minimum(least, (grams[at : at + 1024] * _ODD[:, None]).min(axis=1))
    return mixed(least)


def sketch(least: np.ndarray) -> np.ndarray:
    """16 bits of each min-hash value, to compare sets by and to split large nodes."""
    return (least & np.uint64(0xFFFF)).astype("<u2")


def children(nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each node for one set: (index of the node, child)."""
    names = mixed(_PLACE ^ mixed(tokens.astype(np.uint64)))
    at, token = np.nonzero(mixed(nodes[:, None] ^ names[None, :]) < _CHOSEN)
    return at, mixed(nodes[at] * np.uint64(0x9E3779B97F4A7C15) + names[token])


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sums(grams: np.ndarray) -> list[int]:
    """A digest of a set: two sums of its spread members."""
    return _long(np.array([mixed(grams + np.uint64(k)).sum(dtype=np.uint64) for k in (11, 13)], np.uint64)).tolist()


def _sketches(texts: DataFrame, carry: list[str]) -> DataFrame:
    """Ids, digest (``s1``, ``s2``) and size ``n`` of the set, its sketch, and its nodes of the first level in all runs."""
    roots = mixed(np.arange(1, RUNS + 1, dtype=np.uint64))

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                grams = gram_set((text or "").encode())
                least = min_hashes(grams)
                rows.append((*_sums(grams), len(grams), sketch(least).tobytes() if len(grams) else None, _long(children(roots, least)[1])))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*ids, "s1", "s2", "n", "tokens", "nodes"])

    made = T.StructType.fromDDL("s1 long, s2 long, n int, tokens binary, nodes array<long>")
    ids = ["id", "d", "t", *carry]
    return texts.mapInArrow(run, T.StructType([*(texts.schema[c] for c in ids), *made.fields]))


def _split(large: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            reps, nodes = [], []
            for rep, node, x in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_pylist(), strict=True):
                below = children(np.array([node]), np.frombuffer(x, "<u2"))[1]
                reps += [rep] * len(below)
                nodes += _long(below).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(nodes, pa.int64())], ["rep", "node"])

    return large.select("rep", "node", "tokens").mapInArrow(run, "rep long, node long")


def _shared(nodes: DataFrame) -> DataFrame:
    """Nodes with two sets or more, and how many."""
    return checkpointed(keyed_join(nodes, nodes.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1"), ["node"]).select("rep", "node", "m"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in each vertex's component, for edges ``a``-``b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        root = root[root]
        if (root == before).all():
            break
    return root


def _tiles(rows: DataFrame, seed: int) -> DataFrame:
    """Rows in pairs of tiles: a group's rows go to ``tiles`` tiles, each of which meets each.

    ``i``, ``j`` name the pair and ``side`` the row's tile in it.
    """
    tiles = F.col("tiles")
    own = F.pmod(F.xxhash64("rep", F.lit(seed)), tiles)
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    )


def _sections(group: pa.Table, key: str):
    """Runs of rows of one (key, i, j), in arrow order after sorting."""
    group = group.sort_by([(key, "ascending"), ("i", "ascending"), ("j", "ascending"), ("side", "ascending"), ("rep", "ascending")]).combine_chunks()
    keys = np.stack([group[c].to_numpy() for c in (key, "i", "j")])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, group.num_rows], strict=True):
        if hi - lo > 1:
            yield group.slice(lo, hi - lo)


def _pairs(part: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of both sides, and whether they are the same tile."""
    side = part["side"].to_numpy()
    if part["i"][0].as_py() == part["j"][0].as_py():
        every = np.arange(len(side))
        return every, every, True
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


def _likely(nodes: DataFrame, groups: int) -> DataFrame:
    """Forests of the likely pairs in each node."""

    def run(group: pa.Table) -> pa.Table:
        us, vs = [], []
        for part in _sections(group, "node"):
            a, b, same = _pairs(part)
            if not len(a) or not len(b):
                continue
            rep = part["rep"].to_numpy()
            tokens = np.frombuffer(b"".join(part["tokens"].to_pylist()), "<u2").reshape(-1, TOKENS)
            root = np.arange(len(rep))
            bits = np.packbits((tokens & 1).astype(bool), axis=1).view("<u8")
            for at in range(0, len(a), 128):
                differ = np.bitwise_count(bits[a[at : at + 128], None, :] ^ bits[None, b, :]).sum(axis=2, dtype=np.uint8)
                p, q = np.nonzero(differ <= (1 - LIKELY_BITS) * TOKENS)
                p, q = a[at + p], b[q]
                apart = (p < q) & (root[p] != root[q])  # pairs that are joined already add nothing
                p, q = p[apart], q[apart]
                for lo in range(0, len(p), 8192):
                    x, y = p[lo : lo + 8192], q[lo : lo + 8192]
                    agree = np.count_nonzero(tokens[x] == tokens[y], axis=1) >= LIKELY * TOKENS
                    root = root[forest(len(rep), np.concatenate([x[agree], np.arange(len(rep))]), np.concatenate([y[agree], root]))]
            moved = np.flatnonzero(root != np.arange(len(rep)))
            us.append(rep[moved])
            vs.append(rep[root[moved]])
        cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
        return pa.table({"u": pa.array(cat(us), pa.int64()), "v": pa.array(cat(vs), pa.int64())})

    dealt = _tiles(nodes.withColumn("tiles", F.ceil(F.col("m") / SMALL)), 1).withColumn("g", F.pmod(F.xxhash64("node", "i", "j"), F.lit(groups)))
    return dealt.select("g", "node", "i", "j", "side", "rep", "tokens").groupBy("g").applyInArrow(run, "u long, v long")


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Exact intersection sizes of the sets ``a`` with the sets ``b``."""
    sizes = [len(x) for x in sets]
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, many = np.unique(token, return_inverse=True, return_counts=True)
    keep = many > 1
    column = np.cumsum(keep) - 1
    here = keep[at]
    owner, column = owner[here], column[at[here]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), np.float64)
    for lo in range(0, int(keep.sum()), chunk):
        f, t = np.searchsorted(column, [lo, lo + chunk])
        has = np.zeros((len(sets), min(chunk, int(keep.sum()) - lo)), np.float32)
        has[owner[f:t], column[f:t] - lo] = 1
        out += has[a] @ has[b].T
    return out


def _decided(blocks: DataFrame, groups: int, threshold: float) -> DataFrame:
    """Exact links in each pair of tiles: ``rep``, ``links`` (documents) and ``root``, the tile's smallest linked set."""

    def run(group: pa.Table) -> pa.Table:
        out = {"rep": [], "links": [], "root": []}
        for part in _sections(group, "block"):
            a, b, same = _pairs(part)
            if not len(a) or not len(b):
                continue
            rep, weight = part["rep"].to_numpy(), part["weight"].to_numpy()
            first = np.concatenate([[True], (rep[1:] != rep[:-1]) | (np.diff(part["side"].to_numpy()) != 0)])  # repeated rows stand once
            a, b = a[first[a]], b[first[b]]
            sets = [np.frombuffer(x, np.uint64) for x in part["grams"].to_pylist()]
            sizes = np.array([len(x) for x in sets], np.float64)
            common = overlaps(sets, a, b)
            linked = common >= threshold * (sizes[a][:, None] + sizes[b][None, :] - common) - 1e-9
            if same:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(rep), np.int64)
            links[a] += linked @ weight[b]
            if not same:
                links[b] += linked.T @ weight[a]
            p, q = np.nonzero(linked)
            root = forest(len(rep), a[p], b[q])
            some = np.flatnonzero(links)
            out["rep"].append(rep[some])
            out["links"].append(links[some])
            out["root"].append(rep[root[some]])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in out.items()})

    dealt = _tiles(blocks, 2).withColumn("g", F.pmod(F.xxhash64("block", "i", "j"), F.lit(groups)))
    return dealt.select("g", "block", "i", "j", "side", "rep", "weight", "grams").groupBy("g").applyInArrow(run, "rep long, links long, root long")


def _with_grams(texts: DataFrame) -> DataFrame:
    """The sets, one row of each (rows may share an id and a text; all that do meet in one task, or a few)."""
    names = ["rep", "block", "tiles", "weight"]

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            new = []
            for rep in batch.column("rep").to_pylist():
                new.append(rep not in seen)
                seen.add(rep)
            batch = batch.filter(pa.array(new, pa.bool_()))
            grams = [gram_set((x or "").encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([x.tobytes() for x in grams], pa.binary())], [*names, "grams"])

    return texts.select(*names, "text").mapInArrow(run, "rep long, block long, tiles long, weight long, grams binary")


def jaccard_join(documents: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns of ``carry``, ``class_id``, ``n_links`` (other documents at ``threshold`` or more) and ``class_key`` of every row."""
    made = ("class_id", "n_links", "class_key", key)
    named = {f"carry_{k}": c for k, c in enumerate(c for c in carry if c not in made)}
    id_ = F.col(key).cast("long")
    # all rows with one set are one, held by the text with the smallest id
    texts = documents.select(id_.alias("id"), F.coalesce(id_, F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("t"), "text", *(F.col(c).alias(n) for n, c in named.items()))
    rows = checkpointed(_sketches(texts, list(named)))
    members = rows.select("id", *named, "s1", "s2", "n")
    weights = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("d", "t")).alias("at"), F.min("id").alias("least"), F.count("*").alias("weight")).select("s1", "s2", "n", "at.d", "at.t", "least", "weight")
    sets = checkpointed(
        rows.drop("id", *named).filter("n > 0").dropDuplicates(["d", "t", "s1", "s2", "n"])
        .join(weights, ["d", "t", "s1", "s2", "n"])
        .select(F.monotonically_increasing_id().alias("rep"), "d", "t", "least", "s1", "s2", "n", "weight", "tokens", "nodes")
    )
    # recursion: large nodes split, small ones stay
    level = _shared(sets.select("rep", F.explode("nodes").alias("node")))
    small = level.filter(F.col("m") <= SMALL)
    for _ in range(DEPTH):
        large = level.filter(F.col("m") > SMALL)
        if large.isEmpty():
            break
        level = _shared(_split(large.join(sets.select("rep", "tokens"), "rep")))
        small = small.unionByName(level.filter(F.col("m") <= SMALL))
    else:
        small = small.unionByName(level.filter(F.col("m") > SMALL))
    edges = _likely(small.join(sets.select("rep", "tokens"), "rep"), max(1, math.ceil(small.count() / 10_000)))
    blocks = components(edges).select(F.col("v").alias("rep"), F.col("component").alias("block")).join(sets.select("rep", "d", "t", "n", "weight"), "rep")
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / (TILE * RUN)))
    placed = checkpointed(blocks.join(blocks.groupBy("block").agg(tiles.alias("tiles")), "block").drop("n"))
    grams = _with_grams(texts.select("d", "t", "text").join(placed.hint("shuffle_hash"), ["d", "t"]))
    found = checkpointed(_decided(grams, max(1, math.ceil(placed.count() / 500)), threshold))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("v").alias("rep"), F.col("component").alias("class_key"))
    first = classes.join(sets.select("rep", "least"), "rep").groupBy("class_key").agg(F.min("least").alias("class_id"))
    classes = classes.join(first, "class_key")
    result = sets.select("rep", "least", "s1", "s2", "n", "weight").join(links, "rep", "left").join(classes, "rep", "left")
    # a set that is linked to none is a class by itself
    alone = F.col("class_key").isNull()
    result = result.select("s1", "s2", "n", F.when(alone, F.col("least")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("class_key", "rep").alias("class_key"), F.lit(True).alias("has"))
    done = members.join(result, ["s1", "s2", "n"], "left")
    return done.select(F.col("id").alias(key), *(F.col(n).alias(c) for n, c in named.items()), F.when(F.col("has"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_key")


def representatives(documents: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """The rows of ``documents``, but of each class exactly one: that with the smallest id (null: largest), then row digest.

    Rows whose texts have no words are classes of their own, so all of them stay.
    """
    columns = documents.columns
    marked = documents.withColumn("__digest", F.xxhash64(*columns))
    joined = jaccard_join(marked, threshold, key, ("__digest",)).filter("class_key is not null")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).cast("long").alias("id"), "__digest")
    chosen = joined.groupBy("class_key").agg(F.min(order).alias("at")).select("class_key", F.coalesce("at.id", F.lit(2**63 - 1)).alias("__id"), F.col("at.__digest").alias("__chosen"))
    # equal rows are alike, so of those that were chosen together one stays
    wordy = marked.withColumn("__at", F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))).filter(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) != "")
    kept = wordy.join(chosen.drop("class_key"), (F.col("__at") == F.col("__id")) & (F.col("__digest") == F.col("__chosen"))).dropDuplicates(["__at", "__digest"])
    blank = documents.filter(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == "")
    return kept.select(columns).unionByName(blank)
