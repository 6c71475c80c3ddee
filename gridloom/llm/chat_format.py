"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole, turn by turn, between control strings that
are single tokens of the tokenizer; control strings inside roles and texts are
escaped, reversibly.  The whole rendering is encoded once with offsets.  The
assistant texts' sorted spans and the sorted token spans are intersected by
binary search, so the mask has exactly the tokens that make up those texts.

Edge cases.  A null text or role is empty.  Turns go by ``turn``, ties by role
and text; nulls come first.  Repeated rows are turns of their own.  A
conversation is one training record and so one row; a turn without an id is a
conversation of its own, as nothing says that such turns belong together.  An empty assistant text has an empty span.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that no role or text may hold unescaped: our marks and those of common templates.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Double each backslash and put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted)]


def loss_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a span; ``offsets`` and ``spans`` are sorted."""
    mask = np.zeros(len(offsets), bool)
    for start, end in spans:
        first = np.searchsorted(offsets[:, 1], start, "right")
        last = np.searchsorted(offsets[:, 0], end, "left")
        mask[first:last] = True
    return mask


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the runs of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(offsets[a, 0]), int(offsets[b - 1, 1])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    made = Tokenizer.from_file(path)
    made.post_processor = ByteLevel(trim_offsets=False)  # offsets keep the spaces
    made.add_tokens([AddedToken(x, normalized=False) for x in CONTROL])
    return made


def chat_format(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """``conv_id``, ``formatted``, ``input_ids``, ``loss_mask`` and ``loss_spans`` (characters under the mask)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    whole = conversations.select("conv_id", "turn", "role", "text", alone.alias("alone")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(batches):
        encode = tokenizer(tokenizer_path)
        for batch in slices(batches):
            if batch.num_rows:
                made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
                ids, masks, spans = [], [], []
                for (_, wanted), e in zip(made, encode.encode_batch([x for x, _ in made], add_special_tokens=False), strict=True):
                    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                    mask = loss_tokens(offsets, wanted)
                    ids.append(e.ids)
                    masks.append(mask.tolist())
                    spans.append([{"start": a, "end": b} for a, b in masked_spans(offsets, mask)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id"),
                        pa.array([x for x, _ in made], pa.string()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(masks, pa.list_(pa.bool_())),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"],
                )

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"conv_id {kind}, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of ``chat_format``'s rows, from the formatted strings and masks alone."""

    def run(batches):
        for batch in slices(batches):
            turns, loss = [], []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns.append([{"role": r, "text": t} for r, t in parse(text)])
                loss.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("formatted"), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(loss, pa.string())],
                ["conv_id", "formatted", "turns", "loss_text"],
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, formatted string, turns array<struct<role:string,text:string>>, loss_text string")
