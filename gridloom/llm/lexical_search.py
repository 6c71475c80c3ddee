"""Ranked lexical search as a blocked sparse matrix product of 64-bit integers.

The left matrix has a row an item and a column a term: how often the item says
the term.  The right one has a row a term and a column a document: the term's
impact there.  Both are cut into blocks.  A task reads documents from a forward
index, turns each block of them into rows by term, and merges these rows item
by item (Gustavson's order) into one accumulator the width of the block; the k
best of a block leave it, and a window over all blocks keeps the k best of an
item.

The forward index is written once to the shared folder: for each document with
a term its length and the frequencies of the terms that items may say.  Which
these are is told by a bitmap of ``BUCKETS`` bits, whatever the number of items;
a term kept by a chance collision finds no row in the product, so results are
exact.  Document frequencies are counted from the index.

Bounds.  A block of documents has at most ``DOCUMENTS`` documents or, but for
its last one, ``ENTRIES`` entries.  Items are dealt by hash into blocks of about
``ASKED`` entries, each broadcast on its own; an item is never cut, so a block
can be larger by the length of one text.

Edge cases.  A null text has no terms, so such items have no rows and such
documents count nowhere.  Repeated documents are rows of their own, and so are
repeated items: each has its ranks from 1.  Equal scores go by ascending id,
null ids last.  An item with fewer than k documents above 0 returns all of
them.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, slices

#: Fixed value: what a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits that tell which terms the items may say.
BUCKETS = 1 << 20
#: Size of a block of documents, and of one of items.
DOCUMENTS, ENTRIES, ASKED = 16_384, 2_000_000, 1_000_000
#: Terms whose bit a worker remembers.
MEMORY = 200_000

# bytes of a term stay (A-Z as a-z), all others become spaces; bytes above 127 belong to terms
_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order."""
    return text.encode().translate(_BYTES).split()


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """``row``, ``item_id``, ``copies`` and ``terms`` (with repeats) of every different item that has terms; the rows' numbers are written down."""
    said = F.translate(F.col("text"), UPPER, LOWER)
    different = items.select(F.col(item).alias("item_id"), F.col(text).alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    found = different.select("item_id", "copies", F.regexp_extract_all(said, F.lit(TERM), F.lit(0)).alias("terms")).filter(F.size("terms") > 0)
    return checkpointed(found.withColumn("row", F.monotonically_increasing_id()))


def term_bits(terms: DataFrame) -> np.ndarray:
    """Which of ``BUCKETS`` buckets hold a term: at most ``BUCKETS`` bits reach the driver."""
    bucket = F.crc32(F.col("term").cast("binary")) % BUCKETS + 1  # the first of Spark's bitmaps, 1, has bits for 1 to 32,768
    parts = terms.select(bucket.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(BUCKETS, bool)
    for at, bits in parts:
        bits = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little").astype(bool)
        first = (int(at) - 1) * len(bits)
        out[first : first + len(bits)] |= bits[: max(0, BUCKETS - first)]
    return out


def forward_index(documents: DataFrame, bits: np.ndarray, key: str, text: str) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms`` and ``tfs`` of every document with a term."""
    held = documents.sparkSession.sparkContext.broadcast(np.packbits(bits))  # BUCKETS / 8 bytes

    def run(batches):
        there = np.unpackbits(held.value).astype(bool).tolist()

        @functools.lru_cache(MEMORY)
        def wanted(term: bytes) -> bool:
            return there[zlib.crc32(term) % BUCKETS]

        for batch in slices(batches):
            rows, sizes, terms, tfs, starts = [], [], [], [], [0]
            for at, text in enumerate(batch.column(1).to_pylist()):
                if text and (found := terms_of(text)):
                    some = [(t, n) for t, n in Counter(found).items() if wanted(t)]
                    terms += [t for t, _ in some]
                    tfs += [n for _, n in some]
                    rows.append(at)
                    sizes.append(len(found))
                    starts.append(len(terms))
            starts = pa.array(starts, pa.int32())
            lists = [pa.ListArray.from_arrays(starts, x) for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"doc_id {kind}, n long, terms array<string>, tfs array<int>")


def weight(docs: int, df: np.ndarray) -> np.ndarray:
    """Weights of terms found in ``df`` of ``docs`` documents."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def damping(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The part of a document's length in its impacts; whole numbers of any size."""
    if len(n) and 75 * int(n.max()) * docs >= 2**63:
        n = n.astype(object)
    return (100 - 75 + 75 * n * docs // total).astype(np.int64)


class Items:
    """A block of items: the terms and their weights, and a sparse row of (term, times) an item."""

    def __init__(self, entries: pa.Table, docs: int):
        coded = entries["term"].combine_chunks().dictionary_encode()
        self.terms, which = coded.dictionary, coded.indices.to_numpy()
        df = np.zeros(len(self.terms), np.int64)
        df[which] = entries["df"].to_numpy()
        self.weights = weight(docs, df)
        order = np.argsort(entries["row"].to_numpy(), kind="stable")
        self.rows, self.starts = np.unique(entries["row"].to_numpy()[order], return_index=True)
        self.starts = np.append(self.starts, len(order))
        self.which, self.times = which[order], entries["times"].to_numpy()[order]


def product(items: Items, frame: pa.Table, docs: int, total: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best documents of a block for each item: place in ``items.rows``, place in ``frame``, score."""
    order = pc.sort_indices(frame["doc_id"].combine_chunks(), null_placement="at_end").to_numpy()
    frame = frame.take(order).combine_chunks()
    n, terms, tfs = (frame[x].combine_chunks() for x in ("n", "terms", "tfs"))
    m = damping(n.to_numpy(), docs, total)
    at = pc.index_in(terms.flatten(), value_set=items.terms)
    held = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    term = at.take(pa.array(held)).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(frame)), terms.value_lengths().to_numpy())[held]
    tf = tfs.flatten().to_numpy()[held].astype(np.int64)
    impact = items.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    by_term = np.argsort(term, kind="stable")
    doc, impact = doc[by_term], impact[by_term]
    starts = np.searchsorted(term[by_term], np.arange(len(items.terms) + 1))
    sums = np.zeros(len(frame), np.int64)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i in range(len(items.rows)):
        for e in range(items.starts[i], items.starts[i + 1]):
            lo, hi = starts[items.which[e]], starts[items.which[e] + 1]
            sums[doc[lo:hi]] += items.times[e] * impact[lo:hi]  # a term names a document once
        best = np.flatnonzero(sums > 0)
        if len(best) > k:
            scores = sums[best]
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            above = best[scores > least]
            best = np.concatenate([above, best[scores == least][: k - len(above)]])
        found.append((i, best, sums[best]))
        sums[:] = 0
    which = np.repeat([i for i, _, _ in found], [len(b) for _, b, _ in found]).astype(np.int64)
    place = np.concatenate([b for _, b, _ in found]) if found else np.zeros(0, np.int64)
    return which, order[place].astype(np.int64), np.concatenate([s for _, _, s in found]) if found else place


def _blocks(batches):
    """Consecutive batches as tables of a block's size."""
    held, docs, entries = [], 0, 0
    for batch in slices(batches):
        size = len(batch.column("terms").flatten())
        if held and (docs + batch.num_rows > DOCUMENTS or entries + size > ENTRIES):
            yield pa.Table.from_batches(held)
            held, docs, entries = [], 0, 0
        held.append(batch)
        docs, entries = docs + batch.num_rows, entries + size
    if held:
        yield pa.Table.from_batches(held)


def _best(index: DataFrame, items: Items, docs: int, total: int, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        for frame in _blocks(batches):
            which, place, score = product(shared.value, frame, docs, total, k)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.rows[which]), frame["doc_id"].combine_chunks().take(pa.array(place)), pa.array(score)], ["row", "doc_id", "score"])

    return index.mapInArrow(run, f"row long, doc_id {index.schema['doc_id'].dataType.simpleString()}, score long")


def lexical_search(documents: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", asked: int = ASKED) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` highest-scoring documents of each item."""
    questions = item_terms(items, item, text)
    entries = questions.select("row", F.explode("terms").alias("term")).groupBy("row", "term").agg(F.count("*").alias("times"))
    index = checkpointed(forward_index(documents, term_bits(entries.select("term").distinct()), key, text))
    docs, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    entries = checkpointed(entries.join(df, "term"))
    blocks = max(1, math.ceil(entries.count() / asked))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    some = [entries.filter(block == b).toArrow() for b in range(blocks)] if docs else []
    best = [_best(index, Items(x, docs), docs, total, k) for x in some if len(x)]
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    if not best:
        return questions.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(documents.schema[key].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = functools.reduce(DataFrame.unionByName, best).withColumn("rank", rank).filter(F.col("rank") <= k)
    asked_by = questions.select("row", "item_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return found.join(asked_by, "row").select("item_id", "rank", "doc_id", "score")
