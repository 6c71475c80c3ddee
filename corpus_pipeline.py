"""The training-corpus pipeline: five stages over ``documents``, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``; ``n_chars`` follows the
text.  The tokenizer and vocabulary files are public ones on every machine.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard_join, language_id, line_dedup, packing, substring_dedup
from gridloom.session import shared_folder, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words whose ids a worker remembers; workers serve the other stages too, so fewer than the operator's own.
WORD_MEMORY = 150_000


def _renewed(docs: DataFrame, text: str) -> DataFrame:
    docs = docs.withColumn("text", F.col(text))
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; texts without letters, of no clear language or in none of them go."""
    ship(spark)
    model = language_id.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.known(docs, model).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share."""
    return _renewed(line_dedup.line_dedup(docs), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the smallest id; repeated rows are of one class."""
    ship(spark)
    return jaccard_join.representatives(docs.select(COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier place, has."""
    ship(spark)
    return _renewed(substring_dedup.substring_dedup(docs.select(COLUMNS)), "kept")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed into sequences."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memory=WORD_MEMORY)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packed", packed)]

#: Language scores, near-duplicate sketches and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
