"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import keyed_join  # noqa: F401  (for the operators)
from ..session import shared_folder

#: The six ASCII white-space characters that end a word.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def digest(text) -> list:
    """Two 64-bit hashes of a string column: together as good as 128 bits."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def slices(batches, rows: int = 512):
    """Arrow batches cut small, so that what a task holds as Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a folder and read from it: cuts the lineage like a checkpoint, but can be removed."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
