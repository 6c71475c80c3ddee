"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents are tokenised whole and cut only where they exceed a sequence.  The
pieces are dealt into groups of bounded size; each group is packed best-fit
decreasing and certified by a dual-feasible-function lower bound on its number
of sequences.  Groups with a gap above their bound give up the documents of all
their part-filled sequences, the others those of their emptiest one; these
documents are dealt together into fewer groups, of a bounded size, and packed
again, and a round counts only where it saves sequences.  The rounds end when
the number of sequences meets the lower bound over all pieces, whatever their
number, or when a round saves nothing.  A sequence is named by the number of
its first piece, of which each piece has its own.

Frequent words' ids are remembered, which holds for tokenizers with the settings
in ``_SETTINGS``; any other file encodes whole texts.

Edge cases.  A null or empty text has only the end token.  Repeated rows and
repeated ids are packed as documents of their own.  A document longer than a
sequence gives full pieces and a shorter last one.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import null_safe_join
from .common import checkpointed, slices

SIZE, END_ID = 4096, 1
#: Pieces in a group that one task packs at first, about, and times as many in later rounds at most.
GROUP, WIDEST = 50_000, 8
#: Words whose ids a worker remembers, in each of two generations, and words looked up at once.
MEMORY, CHUNK = 400_000, 50_000

_MARK = rb"[!-&(-/:-@\[-`{-~]"
_STOP = re.compile(_MARK + rb"(?<=[a-z].)" + _MARK + rb"*(?=[ \n])")
_PLAIN = re.compile("[a-zß-öø-ÿ]+")

#: The normaliser, splitter and model settings under which a text's ids are its words' ids.
_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "splitter": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "bytes": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    "model": ("BPE", "</w>", False),
    "added": {"<|startoftext|>", "<|endoftext|>"},
}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=4)
def by_words(path: str) -> bool:
    """Whether the file's settings are those under which words can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    splitters, model = (made.get("pre_tokenizer") or {}).get("pretokenizers", []), made["model"]
    found = {
        "normalizer": made.get("normalizer"),
        "splitter": splitters[0].get("pattern") if len(splitters) == 2 else None,
        "bytes": splitters[-1] if splitters else None,
        "model": (model.get("type"), model.get("end_of_word_suffix"), bool(model.get("ignore_merges"))),
        "added": {x["content"] for x in made.get("added_tokens") or []},
    }
    return found == _SETTINGS and not model.get("dropout")


@functools.lru_cache(maxsize=2)
def whole_encoder(path: str):
    """A function from a whole text to its ids and the end token, four bytes each."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)

    def encode(text: str | None) -> bytes:
        ids = [*made.encode(text or "", add_special_tokens=False).ids, END_ID]
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode


def text_encoder(path: str, memory: int | None = None):
    """A function from a text to its ids and the end token, four bytes each."""
    if not by_words(path):
        return whole_encoder(path)
    encode = word_encoder(path, memory or MEMORY)
    return lambda text: token_bytes(encode, text)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, memory: int = MEMORY):
    """A function from words to the bytes of their ids.

    The tokenizer splits at white space before anything else, so a text's ids
    are its words' ids in order; frequent words are remembered.  A word of
    lower-case Latin letters alone is one unit, which the normaliser leaves as it
    is, so the model is asked for its merges directly.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    made = Tokenizer.from_file(path)
    encode, merges = getattr(made, "encode_batch_fast", made.encode_batch), made.model.tokenize
    spelling = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {c: spelling.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
    new: dict[bytes, bytes] = {}
    old: dict[bytes, bytes] = {}

    def ids(words: list[bytes]) -> bytes:
        nonlocal new, old
        missing = set(words).difference(new)
        if missing:
            if len(new) + len(missing) > memory:
                old, new = new, {}
                missing = set(words)
            new.update((w, old[w]) for w in missing if w in old)
            missing = [w for w in missing if w not in old]
            others = []
            for w in missing:
                word = w.decode()
                if _PLAIN.fullmatch(word):
                    ids = [t.id for t in merges(word if word.isascii() else word.translate(letters))]
                    new[w] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    others.append(w)
            for w, e in zip(others, encode([w.decode() for w in others], add_special_tokens=False), strict=True):
                ids = e.ids
                new[w] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(new.__getitem__, words))

    return ids


def token_bytes(encode, text: str | None) -> bytes:
    """The ids of a whole text and the end token, four bytes each.

    Two rewritings that change no id make more words alike: ASCII letters are
    lower-cased, as the tokenizer does first, unless the text may hold one of its
    special strings; and marks (but apostrophes) between a letter and a space,
    which are a unit of their own, become a word.
    """
    data = (text or "").encode()
    if b"<|" not in data:
        data = _STOP.sub(rb" \g<0>", data.lower())
    words = data.split()
    made = b"".join(encode(words[at : at + CHUNK]) for at in range(0, len(words), CHUNK))
    return made + END_ID.to_bytes(4, "little")


def tokenize_pieces(documents: DataFrame, tokenizer_path: str, size: int = SIZE, memory: int = MEMORY) -> DataFrame:
    """Pieces of at most ``size`` ids of every document, with a checksum of their ids."""

    def run(batches):
        encode = text_encoder(tokenizer_path, memory)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text)
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, size: int = SIZE, times: np.ndarray | None = None) -> int:
    """The best bound of two families of dual feasible functions for items of these lengths, each ``times`` (once)."""
    if not len(lengths):
        return 0
    n = np.zeros(size + 1, np.int64)
    np.add.at(n, lengths, 1 if times is None else times)
    at = np.arange(size + 1)
    count, total = np.cumsum(n), np.cumsum(n * at)
    best = -(-int(total[-1]) // size)
    # items over size - t fill a bin, items under t vanish
    t = np.arange(1, size // 2 + 1)
    big = count[-1] - count[size - t]
    mid = total[size - t] - total[t - 1]
    best = max(best, int((big + -(-mid // size)).max()))
    # u(k): x counts (k+1)x rounded down to a share of k, unless (k+1)x is whole
    for k in range(1, 41):
        whole = ((k + 1) * at) % size == 0
        best = max(best, -(-int((n * np.where(whole, at * k, ((k + 1) * at) // size * size)).sum()) // (size * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fill; the open bins' free sizes are the bits of one integer."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    fill: list[int] = []
    open_sizes = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = open_sizes >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_sizes &= ~(1 << room)
        else:
            b, room = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += need
        if room > need:
            free[room - need].append(b)
            open_sizes |= 1 << (room - need)
    return bins, offsets, np.array(fill, np.int64)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, pid long, g long, bin long, offset long, fill long, bins long, bound long, emptiness long, first long"


def _pack(dealt: DataFrame, size: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group["pid"].to_numpy(), kind="stable")))
        lengths = group["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, size)
        emptiness = np.empty(len(fill), np.int64)  # 0 for the emptiest sequence
        emptiness[np.argsort(fill, kind="stable")] = np.arange(len(fill))
        first = np.empty(len(fill), np.int64)  # the piece at the start of each sequence
        first[bins[offsets == 0]] = group["pid"].to_numpy()[offsets == 0]
        made = {"bin": bins, "offset": offsets, "fill": fill[bins], "bins": np.full(len(bins), len(fill)), "bound": np.full(len(bins), lower_bound(lengths, size)), "emptiness": emptiness[bins], "first": first[bins]}
        for name, column in made.items():
            group = group.append_column(name, pa.array(column, pa.int64()))
        return group.select([x.split()[0] for x in _PACKED.split(", ")])

    return dealt.groupBy("g").applyInArrow(run, _PACKED)


def pack(pieces: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    pieces = checkpointed(pieces.withColumn("pid", F.monotonically_increasing_id()))
    sizes = np.array([(r[0], r[1]) for r in pieces.groupBy("length").count().collect()], np.int64).reshape(-1, 2)
    n = int(sizes[:, 1].sum())
    least = lower_bound(sizes[:, 0], size, sizes[:, 1])
    groups = max(1, math.ceil(n / group))
    packed = checkpointed(_pack(pieces.withColumn("g", F.pmod(F.xxhash64("pid"), F.lit(groups))), size).withColumn("round", F.lit(0)))
    # every sequence has one piece at offset 0
    for turn in itertools.count(1):  # each saves a sequence at least
        if not n or packed.filter("offset = 0").count() <= least:
            break
        # all part-filled sequences where the bound shows a gap, else each turn the emptiest that is left
        gives = (F.col("fill") < size) & ((F.col("bins") > F.col("bound")) | (F.col("emptiness") == turn - 1 - F.col("round")))
        many, before = packed.filter(gives).agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if many == 0:
            break
        groups = max(1, math.ceil(many / group / WIDEST), min(groups // 2, math.ceil(many / group)))
        again = packed.filter(gives).select("doc_id", "piece", "start", "length", "ids_crc32", "pid", F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(groups)).alias("g"))
        redone = checkpointed(_pack(again, size).withColumn("round", F.lit(turn)))
        if redone.filter("offset = 0").count() >= before:
            break
        packed = checkpointed(packed.filter(~gives).unionByName(redone))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("first").alias("sequence_id"), "offset")


def pack_documents(documents: DataFrame, tokenizer_path: str, size: int = SIZE, memory: int = MEMORY) -> DataFrame:
    return pack(tokenize_pieces(documents, tokenizer_path, size, memory), size)


def sequences(packed: DataFrame, documents: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """The packed token sequences: ``sequence_id`` and ``input_ids``, at most ``size`` each.

    Pieces are known by document, place, length and checksum; those that agree in
    all of them hold the same ids and are told apart by a number.  So rows may
    share ids or have none.
    """

    def run(batches):
        encode = text_encoder(tokenizer_path)
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text)
                parts = [data[at : at + 4 * size] for at in range(0, len(data), 4 * size)]
                ids = [np.frombuffer(x, "<u4").astype(np.int32).tolist() for x in parts]
                columns = [pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "length", "ids_crc32", "ids"])

    alike = ["doc_id", "piece", "length", "ids_crc32"]
    number = F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(0))).alias("number")
    ids = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, length long, ids_crc32 long, ids array<int>")
    whole = null_safe_join(packed.select(*alike, "sequence_id", "offset", number), ids.select(*alike, "ids", number), [*alike, "number"])
    return whole.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("input_ids"))
