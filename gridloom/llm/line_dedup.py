"""Line deduplication across documents, in DataFrame functions only.

Normalised lines are exploded and hashed (128 bits), the documents that hold a
hash are counted, and lines of hashes over the threshold go, except in the
largest document id holding them.  What goes is a list of positions per
document; the kept lines are the other positions, in order.

Edge cases.  A null or empty text is one empty line and becomes an empty text.
Keys shorter than ``min_chars`` are never dropped.  Rows that repeat a document
id count as one document; each row keeps its own lines.  A null id counts as a
document below all others.  An empty table gives no rows.  Other columns pass
through unless named ``n_lines``, ``n_dropped`` or ``kept``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, digest, keyed_join
from .url_filter import LOWER, UPPER

MIN_CHARS, MIN_DOCUMENTS = 20, 3


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def line_dedup(documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Every row with ``n_lines``, ``n_dropped`` and ``kept`` (the text that stays)."""
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = keyed.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars).select("d", "t", "pos", *digest(F.col("key")))
    common = (
        keyed.groupBy("h1", "h2", "d").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("d").alias("keeper"))
        .filter(F.col("n") >= min_documents).select("h1", "h2", "keeper")
    )
    gone = keyed_join(keyed, common, ["h1", "h2"]).filter("d != keeper").groupBy("d", "t").agg(F.collect_set("pos").alias("gone"))
    rest = [c for c in documents.columns if c not in ("n_lines", "n_dropped", "kept")]
    gone = gone.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("gone").alias("__gone"))
    rows = documents.select(*rest, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__d"), F.xxhash64(text).alias("__t"))
    joined = rows.join(gone, ["__d", "__t"], "left").withColumn("__lines", F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return joined.select(*rest, F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
