"""Language identification by segmentation-marginalised unigram models.

For each language, probabilities over the pieces of a fixed public vocabulary
are fitted by expectation maximisation; a word's probability is the sum over
all its segmentations into pieces, by the forward algorithm.  Pieces never
cross white space, so a text's log-probability is the sum of its words'.  The
fit reads a bounded sample of labelled rows: of each language at most ``SAMPLE``
different whole texts, those of the smallest hashes, with at most ``CHARACTERS``
characters in all; texts of more than ``LONG`` characters come last.  Scoring
reads every whole text.  All pieces of the vocabulary count, and words of every
length.

Edge cases.  A text that is null or has no letters is ``und`` with score 0, and
so is every text if no labelled row was given.  Ties go to the language that
sorts first.  Repeated rows are scored alike.  Rows with a null language teach
nothing.  Letters outside the vocabulary cost a fixed small probability.  Other
columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, slices

#: Whole texts of each language from which its model is fitted, at most; rounds of the fit.
SAMPLE, ROUNDS = 300, 2
#: Characters of these texts in all, at most (one text is always taken); texts longer than ``LONG`` come last.
CHARACTERS, LONG = 20_000_000, 60_000
#: Languages at most; more are an error before any model is made.
LANGUAGES = 250
#: Hash ranges by which the sample's rows are counted.
RANGES = 1024
#: Probability of a character that no piece covers, and words a worker remembers.
UNSEEN, MEMORY = 1e-7, 200_000
#: A text in a known language has at least this posterior, and a log-probability a character at most
#: this much below that of the least likely text of the language's own sample.
LEAST_SCORE, MARGIN = 0.5, 2.0

_LETTER = re.compile(r"[^\W\d_]")
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[str, ...]:
    """The text pieces of a sentencepiece model, lower case, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return tuple(sorted({p.lower() for p in map(model.id_to_piece, keep)}))


@dataclass(frozen=True)
class Model:
    """Languages, pieces, the probability of each piece (row) in each language (column), and each sample's least log-probability a character."""

    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    probability: np.ndarray
    least: tuple[float, ...] = ()


NOTHING = Model((), (), np.zeros((0, 0), np.float32))


class Trie:
    """Pieces level by level: sorted tables from (node, character) to the next node, whose place is also the piece's."""

    def __init__(self, pieces):
        at = {x: i + 1 for i, x in enumerate(pieces)}
        self.longest = max(map(len, at), default=0)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = {"": 0}
        for size in range(1, self.longest + 1):
            level = sorted({x[:size] for x in at if len(x) >= size}, key=lambda x: (above[x[:-1]], ord(x[-1])))
            keys = [(above[x[:-1]] << 21) | ord(x[-1]) for x in level]
            self.levels.append((np.array([*keys, 2**63 - 1], np.int64), np.array([*(at.get(x, 0) for x in level), 0], np.int64)))
            above = {x: i for i, x in enumerate(level)}

    def places(self, words: list[str], width: int) -> list[np.ndarray]:
        """For words of one length: by size of a piece, word and start, the piece's number (from 1; 0: none)."""
        codes = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)
        out, nodes = [], np.zeros(codes.shape, np.int64)
        for size in range(1, min(self.longest, width) + 1):
            keys, pieces = self.levels[size - 1]
            nodes = nodes[:, : width - size + 1]
            wanted = np.where(nodes < 0, -1, (nodes << 21) | codes[:, size - 1 :])
            found = np.searchsorted(keys, wanted)
            nodes = np.where(keys[found] == wanted, found, -1)
            out.append(pieces[nodes])  # the last place, -1, has no piece
        return out


def log_sums(places: list[np.ndarray], probability: np.ndarray, words: int, width: int, backward: bool = False, last: bool = False) -> np.ndarray:
    """Logs of the forward (or backward) sums over all segmentations, by position, word and language; the ``last`` position's alone if asked.

    ``probability`` has a row a piece (row 0: none) and a column a language.  Sums
    are scaled where they get small, all that later steps read by one factor, so
    words may have any length.
    """
    longest, shape = len(places), (words, probability.shape[1])
    sums, scale, logs = [np.ones(shape)], np.zeros(shape), np.zeros((1 if last else width + 1, *shape))
    for j in range(1, width + 1):
        total = sums[-1] * UNSEEN
        for size in range(1, min(longest, j) + 1):
            here = places[size - 1][:, width - j if backward else j - size]
            hit = np.flatnonzero(here)
            if len(hit):
                total[hit] += sums[-size][hit] * probability[here[hit]]
        sums.append(total)
        del sums[: -max(1, longest)]
        low = total < 1e-120
        if low.any():
            up = np.where(low, 1e120, 1.0)
            sums = [x * up for x in sums]
            scale -= np.log(up)
        if not last or j == width:
            logs[0 if last else j] = np.log(np.maximum(sums[-1], 1e-300)) + scale
    return logs[::-1] if backward else logs


def by_width(words, most: int = 200_000):
    """Lists of words of one length, of about ``most`` characters."""
    widths: dict[int, list[str]] = {}
    for w in words:
        widths.setdefault(len(w), []).append(w)
    for width, some in widths.items():
        step = max(1, most // width)
        for lo in range(0, len(some), step):
            yield width, some[lo : lo + step]


def fit(words: Counter, pieces: tuple[str, ...], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from word counts, by expectation maximisation."""
    trie = Trie(pieces)

    def parts():
        for width, some in by_width(words):
            yield width, trie.places(some, width), np.array([words[w] for w in some], float)

    counts = np.zeros(len(pieces) + 1)
    for _, places, times in parts():
        for size, at in enumerate(places, 1):
            np.add.at(counts, at, (times / size)[:, None])
    for _ in range(rounds):
        # a piece that no word holds cannot be counted
        p = np.where(counts > 0, counts + 0.01, 0.0) / (counts[1:].sum() + 0.01 * len(pieces))
        p[0] = 0.0
        counts = np.zeros(len(pieces) + 1)
        for width, places, times in parts():
            ahead, back = (log_sums(places, p[:, None], len(times), width, backward)[:, :, 0] for backward in (False, True))
            for size, at in enumerate(places, 1):
                share = np.exp(ahead[: width - size + 1].T + back[size:].T - ahead[width][:, None]) * p[at]
                np.add.at(counts, at, times[:, None] * share)
    return (counts[1:] + 0.01) / (counts[1:].sum() + 0.01 * len(pieces))


def marked(text: str) -> list[str]:
    """The lower-case words of a text, each with the mark of a word's start."""
    return ["▁" + w for w in _SPACE.split(text.lower()) if w]


def sampled(labelled: DataFrame, sample: int = SAMPLE) -> tuple[int, DataFrame]:
    """The number of languages, and ``lang``, ``h1``, ``h2`` of the different texts that each is fitted on.

    Texts are known by their hashes alone, so rows that share an id or a text
    bring no more.  They are first counted by language and hash range; only the
    ranges that the smallest hashes can lie in are then ranked, so a language that
    most rows have brings no more rows to one task than others.
    """
    cell = F.shiftrightunsigned("h1", 64 - RANGES.bit_length() + 1).cast("int") + F.when(F.col("size") > LONG, RANGES).otherwise(0)
    rows = labelled.filter("lang is not null and text is not null").select("lang", *digest(F.col("text")), F.length("text").cast("long").alias("size"))
    rows = rows.distinct().withColumn("cell", cell)
    counts = rows.groupBy("lang", "cell").agg(F.count("*").alias("n"))
    languages = counts.select("lang").distinct().count()
    if languages > LANGUAGES:
        raise ValueError(f"{languages} languages; the bound is {LANGUAGES}")
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    wanted = counts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < sample).select("lang", "cell")
    # at most 2 * RANGES rows a language
    near = rows.join(F.broadcast(wanted), ["lang", "cell"], "left_semi")
    by_hash = Window.partitionBy("lang").orderBy("cell", "h1", "h2")
    ranked = near.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= sample)
    upto = ranked.withColumn("upto", F.sum("size").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    return languages, upto.filter((F.col("place") == 1) | (F.col("upto") <= CHARACTERS)).select("lang", "h1", "h2")


def train(labelled: DataFrame, vocabulary_path: str, sample: int = SAMPLE) -> Model:
    """The models, from ``text`` and ``lang``.

    The sample's size, and so the models', has a fixed bound: ``LANGUAGES`` times
    the vocabulary, as 32-bit numbers.
    """
    languages, chosen = sampled(labelled, sample)
    if not languages:
        return NOTHING
    # at most ``sample`` rows a language; of the rows that share a text one stays
    said = labelled.filter("text is not null").select("lang", "text", *digest(F.col("text")))
    texts = said.join(F.broadcast(chosen), ["lang", "h1", "h2"], "left_semi").groupBy("lang", "h1", "h2").agg(F.first("text").alias("text"))

    def run(group: pa.Table) -> pa.Table:
        some = sorted(group["text"].to_pylist())
        words: Counter = Counter()
        for text in some:
            words.update(marked(text))
        pieces = vocabulary(vocabulary_path)
        p = fit(words, pieces).astype(np.float32)
        _, _, rates = _scored(Scorer(Model(("own",), pieces, p[:, None])), some)
        least = min((r for r in rates if r > -math.inf), default=0.0)
        return pa.table({"lang": group["lang"].slice(0, 1), "p": pa.array([p], pa.list_(pa.float32())), "least": [least]})

    found = texts.groupBy("lang").applyInArrow(run, "lang string, p array<float>, least double").toArrow().sort_by("lang").combine_chunks()
    probability = np.array([p.values.to_numpy() for p in found["p"]], np.float32)
    return Model(tuple(found["lang"].to_pylist()), vocabulary(vocabulary_path), probability.T.copy(), tuple(found["least"].to_pylist()))


class Scorer:
    """Log-probabilities of words for all languages, by one forward pass over many words at once; they are remembered."""

    def __init__(self, model: Model):
        width = max(1, len(model.languages))
        self.languages = model.languages
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, width))
        self.trie = Trie(model.pieces)
        self.probability = np.concatenate([np.zeros((1, width)), model.probability.astype(np.float64).reshape(-1, width)])

    def words(self, words: list[str], width: int) -> np.ndarray:
        """Words of one length."""
        return log_sums(self.trie.places(words, width), self.probability, len(words), width, last=True)[0]

    def learn(self, missing: list[str]) -> None:
        """Score words and remember them."""
        while len(self.known) + len(missing) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for width, some in by_width(missing, max(1000, 800_000 // max(4, len(self.languages)))):
            first = len(self.known)
            self.rows[first : first + len(some)] = self.words(some, width)
            self.known.update(zip(some, range(first, first + len(some)), strict=True))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum over the words of each whole text, and its number of characters in words (a word's start counts as one)."""
        split = [marked(x) for x in texts]
        missing = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(missing) > MEMORY:
            self.known.clear()
            missing = list({w for words in split for w in words})
        self.learn(missing)
        get = self.known.__getitem__
        logs = np.array([self.rows[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0) for words in split]).reshape(len(texts), -1)
        return logs, np.array([sum(map(len, words)) for words in split], float)


def _scored(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and log-probability a character of each text."""
    names, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [-math.inf] * len(texts)
    usable = [i for i, x in enumerate(texts) if scorer.languages and x is not None and _LETTER.search(x)]
    at = 0
    while at < len(usable):  # about a million characters at a time
        size, end = 0, at
        while end < len(usable) and (end == at or size < 1_000_000):
            size += len(texts[usable[end]])
            end += 1
        some = usable[at:end]
        logs, signs = scorer.texts([texts[i] for i in some])
        best = logs.argmax(axis=1)
        share = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        rate = logs.max(axis=1) / signs
        for i, b, s, r in zip(some, best.tolist(), share.tolist(), rate.tolist(), strict=True):
            names[i], scores[i], rates[i] = scorer.languages[b], s, r
        at = end
    return names, scores, rates


def predict(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (the posterior under equal priors) of every row."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # at most LANGUAGES x the vocabulary

    def run(batches):
        scorer = Scorer(held.value)
        for batch in slices(batches):
            names, scores, _ = _scored(scorer, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, lang_pred string, score double")


def known(documents: DataFrame, model: Model, score: float = LEAST_SCORE, margin: float = MARGIN, text: str = "text") -> DataFrame:
    """The rows of ``documents`` whose text is in a language of the models.

    It has a letter, a score of ``score`` or more, and a log-probability a
    character that is at most ``margin`` below that of the least likely text which
    its language was learned from: scripts and signs that no language uses stay
    below.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        bound = {x: least - margin for x, least in zip(held.value.languages, held.value.least, strict=True)}
        for batch in slices(batches):
            names, scores, rates = _scored(scorer, batch.column(text).to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= score and r >= bound[n] for n, s, r in zip(names, scores, rates, strict=True)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
