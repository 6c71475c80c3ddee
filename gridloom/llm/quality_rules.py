"""Quality rules: base counts and a hashed n-gram likelihood ratio, in DataFrame functions only.

Base counts come from array functions over each whole text.  The ratio is that
of two multinomials over hashed one- and two-word runs, one of the trusted
documents and one of the raw corpus, each counted over all its documents; a
text's log-ratios are summed and divided by its number of runs.  A document is
kept if it passes the base rules and its ratio reaches that which all but the
share ``LOST`` of the trusted documents of ``MIN_WORDS`` words or more reach: one
bound, from all of them, for every document, without sampling.  For this bound a
trusted text is scored without the counts of its own fold of ``FOLDS`` (by text
hash, so copies share one), as it would else vouch for itself.

Runs are reduced to a fixed number of buckets, so the two tables have a fixed
size and reach the tasks as one array.

Edge cases.  A null or empty text, or one of white space, has no words and
fails the base rules.  Repeated rows are judged alike (and counted each).  With
no trusted document, or none at all, every ratio is 0 and the base rules decide
alone.  Three-word windows are compared by 64-bit hashes within one text.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, keyed_join

#: Buckets of the hashed runs and the added count of each.
BUCKETS, SMOOTHING = 8192, 1.0
#: Share of the trusted documents below the least mean log-ratio that is kept, and the rank's accuracy (1 / ACCURACY).
LOST, ACCURACY, FOLDS = 0.01, 20_000, 8
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Maximal runs of other than ASCII white space."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def bound_once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also inside inner lambdas."""
    return F.transform(F.array(value), use)[0]


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeat_words(hashes: Column) -> Column:
    """Words in three-word windows that the text has twice or more."""
    n = F.size(hashes)
    windows = F.when(n >= 3, F.transform(F.slice(hashes, 1, n - 2), lambda h, i: F.struct(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def starts(s):
        same = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return F.sort_array(F.array_compact(same))

    def covered(s):
        return F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return bound_once(bound_once(F.sort_array(windows), starts), covered)


def grams(hashes: Column) -> Column:
    """Buckets of the one- and two-word runs."""
    pairs = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(hashes, i), x), F.lit(BUCKETS)).cast("int"))
    return F.concat(F.transform(hashes, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")), pairs)


def mean_ratio(words: Column, ratios: Column) -> Column:
    """The mean log-ratio of the runs of hashed words; 0 without any."""
    mean = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.size(g)
    return F.when(F.size(words) > 0, bound_once(grams(words), mean)).otherwise(0.0)


def with_trust(documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """``fold`` (null if not trusted) and ``text`` of every row; ``trusted`` has the trusted ``doc_id``."""
    ids = trusted.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("spread")).filter("id is not null").distinct().withColumn("good", F.lit(1))
    # a null id is no trusted one, so its rows may lie anywhere
    rows = documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("spread"), "text")
    # the join deals the texts out by id at every size, and what many rows share can be split; the trusted ids of a partition are few
    marked = keyed_join(rows, ids.hint("shuffle_hash"), ["id", "spread"], "left")
    return marked.select(F.when(F.col("good").isNotNull(), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")).alias("fold"), "text")


def least_ratio(marked: DataFrame, tables: Column) -> DataFrame:
    """One row with the mean log-ratio that all but ``LOST`` of the trusted documents reach; 0 without any."""
    # a condition inside the aggregate, not a filter: the join stays as it is in the ratio table, which has its shuffle in common
    ratio = bound_once(hashed(words_of(F.col("text"))), lambda w: F.when(F.size(w) >= MIN_WORDS, mean_ratio(w, F.get(tables, F.col("fold") + 1))))
    return marked.agg(F.coalesce(F.percentile_approx(F.when(F.col("fold").isNotNull(), ratio), LOST, ACCURACY), F.lit(0.0)).alias("least"))


def ratio_table(marked: DataFrame) -> DataFrame:
    """One row with tables of every bucket's log-ratio: of all trusted documents, and of those outside each fold."""
    names = ["good", *(f"good_{k}" for k in range(FOLDS))]
    within = [F.count_if(F.col("fold") == k).alias(f"good_{k}") for k in range(FOLDS)]
    found = marked.select("fold", F.explode(bound_once(hashed(words_of(F.col("text"))), grams)).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count("fold").alias("good"), *within)
    every = marked.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    some = lambda c: F.coalesce(c, F.lit(0))
    counts = every.join(found, "b", "left").select("b", some("raw").alias("raw"), some("good").alias("good"), *(some(F.col("good") - F.col(c)).alias(c) for c in names[1:]))
    all_rows = Window.partitionBy(F.lit(1))
    share = lambda c: (F.col(c) + SMOOTHING) / (F.sum(c).over(all_rows) + SMOOTHING * BUCKETS)
    logs = counts.select("b", *(F.when(F.sum(c).over(all_rows) > 0, F.log(share(c) / share("raw"))).otherwise(0.0).alias(c) for c in names))
    held = F.sort_array(F.collect_list(F.struct("b", *names)))
    return logs.agg(held.alias("held")).select(F.array(*(F.col(f"held.{c}") for c in names)).alias("tables"))


def quality_rules(documents: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``log_ratio`` and ``kept`` of every row; a ``threshold`` given replaces the derived one."""
    text = F.coalesce("text", F.lit(""))
    marked = with_trust(documents, trusted)
    tables = ratio_table(marked).scalar()
    least = least_ratio(marked.withColumn("tables", tables), F.col("tables")).scalar() if threshold is None else F.lit(threshold)
    documents = documents.select("doc_id", "text", F.get(tables, F.lit(0)).alias("ratios"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    scored = documents.select(
        "doc_id",
        bound_once(hashed(words_of(F.col("text"))), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat"), mean_ratio(w, F.col("ratios")).alias("ratio"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound_once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, repeat = F.col("w.n").cast("long"), F.col("w.repeat").cast("long")
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    ratio = F.col("w.ratio")
    return scored.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), failed.alias("base_failed"), ratio.alias("log_ratio"), (~failed & (ratio >= least)).alias("kept"))
