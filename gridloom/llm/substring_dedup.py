"""Substring deduplication: words in windows that also start earlier go.

Suffixes of the word sequences are split by prefix into groups of bounded size,
and each group becomes a sorted suffix array with longest common prefixes, which
is its suffix tree: runs whose common prefix reaches ``WIDTH`` words are the
deep internal nodes, and all their occurrences but the earliest repeat.

Only suffixes that can repeat enter a tree.  Each window of ``WIDTH`` words names
one anchor, its leftmost smallest run of ``PREFIX`` words by hash; equal windows
name equal anchors, so windows whose anchor occurs once are done.  An anchor's
run of words is the prefix by which suffixes are grouped; the tree is built to
its right and to its left, so one suffix serves all windows that name the anchor
(about one in nine words is an anchor).

Prefixes have the length that makes their groups fit.  Where one has more than
``HOT`` occurrences, its windows go by a longer run of words, the one that starts
at the anchor or, where the window ends before, ends with the window: of the
lengths in ``LONGER``, the first whose run has ``HOT`` occurrences or fewer.  The
length follows from the run's words alone, so equal windows always meet.  Of
equal windows under hot prefixes only the earliest of about a megabyte of texts
takes part; the others repeat for certain.  Windows whose longest run is still
hot are their own nodes: leaves of ``WIDTH`` words that differ in nothing, whose
earliest is a pre-aggregated minimum, so a passage that a third of the documents
share gathers nowhere.  Exact copies of a whole text are found by digest first;
all their windows start earlier in the first copy.

Words are compared as 64-bit hashes.

Edge cases.  A null or empty text has no words; texts shorter than ``WIDTH``
lose words only as exact copies do, that is none.  Rows that repeat a document
id and text count as one document; with other texts they are ordered by text
hash.  A null id counts as a number under -2^62 that follows from the text's
hash, so that such rows stand before all others and are spread over all tasks.
An empty table gives no rows.  Other columns pass through unless named
``n_words``, ``n_removed`` or ``kept``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest, keyed_join, slices
from .words import gram_hashes, joined_hashes, portions

WIDTH, PREFIX, LONGER = 20, 5, (10, 15)
#: Occurrences of a prefix that go into a tree at most, and suffixes in a group about.
HOT, GROUP = 2000, 25_000
#: Marks a window that may be, or is, the earliest of its node.
EXEMPT = -1

_SPAN = WIDTH - PREFIX
_TIE = 29


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _ties(h1: pa.Array) -> np.ndarray:
    return h1.to_numpy() & ((1 << _TIE) - 1)


class Portion:
    """The words of some texts in one array, and the anchor of each of their windows (never falling)."""

    def __init__(self, texts: list[bytes]):
        self.words, self.starts = joined_hashes(texts)
        self.sizes = np.diff(self.starts)
        self.grams = gram_hashes(self.words, PREFIX)
        n = np.maximum(self.sizes - WIDTH + 1, 0)
        self.windows = np.repeat(self.starts[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # the high bits of a run's hash, then its place: the least of a window is its leftmost smallest
        bits = np.uint64(max(1, len(self.words)).bit_length())
        least = (self.grams >> bits << bits) | np.arange(len(self.grams), dtype=np.uint64)
        reach = 1
        while reach <= _SPAN:
            step = min(reach, _SPAN + 1 - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        self.anchors = (least[self.windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def run(self, first: np.ndarray, size: np.ndarray | int) -> pa.Array:
        """The words from ``first`` on, ``size`` of them, as bytes."""
        size = np.broadcast_to(size, first.shape).astype(np.int64)
        ends = np.cumsum(size)
        at = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        offsets = np.concatenate([[0], ends * 8]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(self.words[at].tobytes())])


def _portions(batches, columns: tuple[str, ...] = ()):
    """Portions of the texts in which repeated rows (``d``, ``h1``) stand once; the texts are dealt by ``d``, so all of them meet in one task."""
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches):
        new = []
        for key in zip(batch.column("d").to_pylist(), batch.column("h1").to_pylist(), strict=True):
            new.append(key not in seen)
            seen.add(key)
        if not all(new):
            batch = batch.filter(pa.array(new, pa.bool_()))
        texts = [x.encode() for x in batch.column("text").to_pylist()]
        for lo, hi in portions(list(map(len, texts))):
            part = batch.slice(lo, hi - lo)
            yield Portion(texts[lo:hi]), part.column("d").to_numpy(), _ties(part.column("h1")), *(part.column(c) for c in columns)


def _anchors(texts: DataFrame) -> DataFrame:
    """``d``, ``pos`` and ``gram`` (56 bits: a chance agreement only brings in a suffix in vain) of every anchor."""

    def run(batches):
        for texts, d, _ in _portions(batches):
            at = np.unique(texts.anchors)
            text = texts.text_of(at)
            made = pa.array(d[text]), pa.array((at - texts.starts[text]).astype(np.int32)), pa.array(_long(texts.grams[at] >> np.uint64(8)))
            yield pa.RecordBatch.from_arrays(list(made), ["d", "pos", "gram"])

    return texts.mapInArrow(run, "d long, pos int, gram long")


def pack_code(pos: np.ndarray, left: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """A text's tie-breaking hash (29 bits), an anchor's position (30) and the words before it (4)."""
    return (tie.astype(np.int64) << 34) | (pos.astype(np.int64) << 4) | left


def _tie(code):
    return code >> 34


def _pos(code):
    return (code >> 4) & (2**30 - 1)


def _named(texts: Portion, places: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the anchors in ``places`` (twice the position, plus one where hot): place, whether hot, first window and end of windows."""
    text = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy())
    both = np.unique((text << 32) | places.flatten().to_numpy())
    text, at, hot = both >> 32, (both & (2**32 - 1)) >> 1, (both & 1).astype(bool)
    at = at + texts.starts[text]
    first, last = np.searchsorted(texts.anchors, at), np.searchsorted(texts.anchors, at, "right")
    good = (first < last) & (at < texts.starts[text + 1])  # else the position belongs to another text with this id
    return at[good], hot[good], first[good], last[good]


def _suffixes(texts: DataFrame, groups: int) -> DataFrame:
    """Of each anchor that repeats, its words with those that its windows reach; where hot, the mask of all its windows."""

    def run(batches):
        for texts, d, tie, places in _portions(batches, ("places",)):
            at, hot, first, last = _named(texts, places)
            text = texts.text_of(at)
            left = at - texts.windows[first]
            g = np.where(hot, d[text] * 0x9E3779B1 % groups, _long(texts.grams[at]) % groups)
            words = texts.run(texts.windows[first], last - first - 1 + WIDTH)
            columns = [pa.array(g), pa.array(d[text]), pa.array(pack_code(at - texts.starts[text], left, tie[text])), words, pa.array(((1 << (last - first)) - 1).astype(np.int32), mask=~hot)]
            if hot.any():
                none = pa.scalar(None, pa.binary())
                columns[3] = pa.compute.if_else(pa.array(hot), none, words)
            yield pa.RecordBatch.from_arrays(columns, ["g", "d", "code", "words", "mask"])

    return texts.select("d", "h1", "text", "__row", "places").mapInArrow(run, "g long, d long, code long, words binary, mask int")


def _candidates(texts: DataFrame) -> DataFrame:
    """The windows under hot prefixes that may be the earliest of their node, with their longer runs' hashes."""
    runs = [f"run_{size}" for size in LONGER]

    def run(batches):
        for texts, d, tie, places in _portions(batches, ("places",)):
            at, hot, first, last = _named(texts, places)
            size = (last - first)[hot]
            own = np.repeat(first[hot] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            at, window = texts.anchors[own], texts.windows[own]
            node = _long(gram_hashes(texts.words, WIDTH)[window])
            text = texts.text_of(window)
            order = np.lexsort((window, tie[text], d[text], node))
            order = order[np.flatnonzero(np.diff(node[order], prepend=node[order][:1] - 1) != 0)] if len(order) else order
            at, window, text, node = at[order], window[order], text[order], node[order]
            longer = [_long(gram_hashes(texts.words, n)[np.minimum(at, window + WIDTH - n)] if len(at) else np.zeros(0, np.uint64)) for n in LONGER]
            made = [d[text], pack_code(at - texts.starts[text], at - window, tie[text]), node, *longer]
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), texts.run(window, WIDTH)], ["d", "code", "node", *runs, "words"])

    some = texts.filter(F.exists("places", lambda x: x % 2 == 1))
    return some.select("d", "h1", "text", "__row", "places").mapInArrow(run, "d long, code long, node long, " + "".join(f"{x} long, " for x in runs) + "words binary")


def _lengthened(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``prefix``: the shortest of the longer runs that fits; null where none does."""
    runs = [f"run_{size}" for size in LONGER]
    hot = candidates.groupingSets([[x] for x in runs], *runs).agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(F.coalesce(*runs).alias("run"), F.lit(True).alias("hot"))
    prefix = F.lit(None).cast("long")
    for name in reversed(runs):
        candidates = keyed_join(candidates, hot.select(F.col("run").alias(name), F.col("hot").alias(f"hot_{name}")), [name], "left")
        prefix = F.when(F.col(f"hot_{name}").isNull(), F.col(name)).otherwise(prefix)
    return candidates.withColumn("prefix", prefix)


def _classes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over the letters, and the common prefix of each entry with the one before."""
    order = np.lexsort(columns[::-1])
    letters = np.stack([c[order] for c in columns], axis=1)
    same = np.zeros((len(order), len(columns)), bool)
    same[1:] = letters[1:] == letters[:-1]
    return order, np.logical_and.accumulate(same, axis=1).sum(axis=1)


def repeats(d: np.ndarray, code: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Bit ``i`` of a suffix's mask: the window ``i`` words after its first one starts earlier elsewhere."""
    n = len(d)
    left = (code & 15).astype(np.int64)
    size = np.array([len(x) for x in words], np.int64) // 8
    flat = np.frombuffer(b"".join(words), "<u8")
    row = np.repeat(np.arange(n), size)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    table = np.zeros((n, _SPAN + WIDTH), np.uint64)
    table[row, inside + _SPAN - left[row]] = flat
    right_order, right_common = _classes([table[:, c] for c in range(_SPAN, _SPAN + WIDTH)])
    left_order, left_common = _classes([table[:, c] for c in range(_SPAN - 1, -1, -1)])
    turn = np.empty(n, np.int64)
    turn[np.lexsort((_pos(code), _tie(code), d))] = np.arange(n)
    mask = np.zeros(n, np.int64)
    for before in range(_SPAN + 1):
        has = np.flatnonzero((left >= before) & (size - left >= WIDTH - before))
        if len(has) < 2:
            continue
        node = np.empty(n, np.int64)
        node[right_order] = np.cumsum(right_common < WIDTH - before)
        side = np.empty(n, np.int64)
        side[left_order] = np.cumsum(left_common < before)
        name = (node * (n + 1) + side)[has]
        order = np.lexsort((turn[has], name))
        again = order[1:][name[order[1:]] == name[order[:-1]]]
        rows = has[again]
        mask[rows] |= np.int64(1) << (left[rows] - before)
    return mask


def _trees(suffixes: DataFrame) -> DataFrame:
    """``d``, ``tie``, ``start`` and ``mask``: windows that repeat, and (``EXEMPT``) candidates that do not."""

    def run(group: pa.Table) -> pa.Table:
        d, code = group["d"].to_numpy(), group["code"].to_numpy()
        given, asked = group["mask"].fill_null(0).to_numpy(), group["words"].is_valid().to_numpy()
        mask = np.where(asked, 0, given).astype(np.int64)
        mask[asked] = repeats(d[asked], code[asked], group["words"].drop_null().to_pylist())
        mask = np.where(given == EXEMPT, np.where(mask == 0, EXEMPT, 0), mask)
        some = np.flatnonzero(mask)
        start = _pos(code) - (code & 15)
        return pa.table({"d": d[some], "tie": pa.array(_tie(code)[some], pa.int32()), "start": pa.array(start[some], pa.int32()), "mask": pa.array(mask[some], pa.int32())})

    return suffixes.groupBy("g").applyInArrow(run, "d long, tie int, start int, mask int")


def _leaves(windows: DataFrame) -> DataFrame:
    """The earliest window of each node of ``WIDTH`` words."""
    code = F.col("code")
    tie, start = F.shiftright(code, 34).cast("int"), (F.shiftright(code, 4).bitwiseAND(F.lit(2**30 - 1)) - code.bitwiseAND(F.lit(15))).cast("int")
    first = windows.groupBy("node").agg(F.min(F.struct("d", tie.alias("tie"), start.alias("start"))).alias("at"))
    return first.select("at.d", "at.tie", "at.start", F.lit(EXEMPT).alias("mask"))


def cut(words: list[bytes], spans: list[dict], tie: int) -> list[bytes]:
    """The words that no repeated window covers."""
    repeated = np.zeros(len(words) + _SPAN + 1, bool)
    own = [s for s in spans if s["tie"] == tie]
    for s in own:
        if s["mask"] != EXEMPT:
            for bit in range(s["mask"].bit_length()):
                repeated[s["start"] + bit] |= bool(s["mask"] >> bit & 1)
    for s in own:
        if s["mask"] == EXEMPT:
            repeated[s["start"]] = False
    edge = np.zeros(len(repeated) + WIDTH, np.int32)
    starts = np.flatnonzero(repeated)
    edge[starts] += 1
    edge[starts + WIDTH] -= 1
    free = np.cumsum(edge)[: len(words)] == 0
    return [words[i] for i in np.flatnonzero(free)] if len(words) else []


def _kept(rows: DataFrame, rest: list[str], schema: T.StructType) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            n, gone, kept = [], [], []
            for text, tie, first, spans in zip(batch.column("__text").to_pylist(), _ties(batch.column("__h1")).tolist(), batch.column("__first").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                words = text.encode().split()
                if not first and len(words) >= WIDTH:
                    stay = []
                else:
                    stay = cut(words, spans, tie) if spans else words
                n.append(len(words))
                gone.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__rest_{c}") for c in rest), *made], [*rest, "n_words", "n_removed", "kept"])

    fields = {f.name: f for f in schema.fields} | {"n_words": T.StructField("n_words", T.LongType()), "n_removed": T.StructField("n_removed", T.LongType()), "kept": T.StructField("kept", T.StringType())}
    return rows.mapInArrow(run, T.StructType([fields[c] for c in (*rest, "n_words", "n_removed", "kept")]))


def substring_dedup(documents: DataFrame) -> DataFrame:
    """Every row with ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space)."""
    rest = [c for c in documents.columns if c not in ("n_words", "n_removed", "kept")]
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / 40 / GROUP))  # about one suffix in 40 bytes enters a tree
    text = F.coalesce("text", F.lit(""))
    h1, h2 = digest(text)
    no_id = F.lit(-(2**63)) + F.shiftrightunsigned(h1, 2)
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("d"), text.alias("text"), h1, h2, F.struct(*(F.col(c) for c in rest if c != "text"), F.col("text").isNull().alias("__null")).alias("__row"))
    # the first document of each text; its d holds the text's first digest
    copies = keyed.select("h1", "h2", "d").groupBy("h1", "h2").agg(F.min("d").alias("d"))
    originals = copies.groupBy("d").agg(F.collect_set("h1").alias("firsts"))
    # one shuffle of the texts, shared by all that follows, as every branch takes the same columns
    dealt = keyed.repartition("d")
    marked = dealt.join(originals.hint("shuffle_hash"), "d", "left").withColumn("first", F.coalesce(F.array_contains("firsts", F.col("h1")), F.lit(False)))
    firsts = marked.filter("first")
    anchors = _anchors(firsts.select("d", "h1", "text", "__row"))
    repeated = anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram", (F.col("n") > HOT).cast("int").alias("hot"))
    places = keyed_join(anchors, repeated, ["gram"]).groupBy("d").agg(F.collect_list(F.col("pos").cast("long") * 2 + F.col("hot")).alias("places"))
    placed = firsts.join(places.hint("shuffle_hash"), "d")
    windows = _lengthened(_candidates(placed))
    longer = windows.filter("prefix is not null").select(F.pmod("prefix", F.lit(groups)).alias("g"), "d", "code", "words", F.lit(EXEMPT).alias("mask"))
    spans = _trees(_suffixes(placed, groups).unionByName(longer)).unionByName(_leaves(windows.filter("prefix is null")))
    spans = spans.groupBy("d").agg(F.collect_list(F.struct("tie", "start", "mask")).alias("spans"))
    rows = marked.join(spans.hint("shuffle_hash"), "d", "left")
    whole = F.when(~F.col("__row.__null"), F.col("text"))
    flat = rows.select(F.col("text").alias("__text"), F.col("h1").alias("__h1"), F.col("first").alias("__first"), F.col("spans").alias("__spans"), *((whole if c == "text" else F.col(f"__row.{c}")).alias(f"__rest_{c}") for c in rest))
    return _kept(flat, rest, documents.schema)
