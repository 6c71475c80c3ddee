"""Several sinks of one stream, and tables in chunks of days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_folder

#: A sink takes a batch's rows and the folder of that batch; it replaces what lies there.
Sink = Callable[[DataFrame, str], None]


def json_lines(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def parquet_rows(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


def producer_rows(rows: DataFrame, folder: str, key: str = "step") -> None:
    """``key`` and ``value`` as a producer would send them: the key as text, the row as JSON bytes."""
    rows.select(F.col(key).cast("string").cast("binary").alias("key"), F.to_json(F.struct(*rows.columns)).cast("binary").alias("value")).write.mode("overwrite").parquet(folder)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def fan_out(rows: DataFrame, batch: int, path: str, sinks: dict[str, Sink]) -> list[str]:
    """One batch into every sink that has not committed it; returns the names of those written.

    A sink owns the folder ``path/<name>/batch=<n>``, replaces it as a whole, and
    then puts down its mark in ``path/commits``; a batch that comes again after a
    failure goes only to sinks without the mark, and replaces what they had begun.
    The batch is computed once, however many sinks there are.
    """
    spark, made = rows.sparkSession, []
    todo = [n for n in sinks if not _there(spark, f"{path}/commits/sink={n}/batch={batch}/_SUCCESS")]
    if not todo:
        return made
    shared_folder(spark)
    once = rows.persist()
    try:
        for name in todo:
            sinks[name](once, f"{path}/{name}/batch={batch}")
            mark = spark.range(1).select(F.current_timestamp().alias("committed_at"))
            mark.write.mode("overwrite").parquet(f"{path}/commits/sink={name}/batch={batch}")
            made.append(name)
    finally:
        once.unpersist()
    return made


def fan_out_stream(stream: DataFrame, path: str, sinks: dict[str, Sink], **trigger) -> StreamingQuery:
    """:func:`fan_out` of each batch of a stream."""

    def save(rows: DataFrame, batch: int) -> None:
        fan_out(rows, batch, path, sinks)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def committed(spark: SparkSession, path: str, sink: str) -> DataFrame:
    """The rows of a sink's committed batches alone; ``batch`` is their number."""
    marks = spark.read.parquet(f"{path}/commits").filter(F.col("sink") == sink).select("batch").distinct()
    folder = f"{path}/{sink}"
    rows = spark.read.format("json" if _is_json(spark, folder) else "parquet").load(folder)
    return rows.join(F.broadcast(marks), "batch", "left_semi")  # a row a batch


def _is_json(spark: SparkSession, folder: str) -> bool:
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").limit(1).collect()
    return bool(names) and ".json" in names[0].path


def write_days(rows: DataFrame, path: str, ts: str, order: list[str], rows_a_file: int = 2_000_000) -> None:
    """Replace the days that ``rows`` hold, and no others, under ``path/day=``.

    Within a file rows are sorted by ``order`` and time, so readers skip by
    statistics.  A day's rows are dealt to as many tasks as ``rows_a_file`` asks
    for, by their own count, so a full day is no single task's.
    """
    stamped = rows.withColumn("day", F.to_date(ts))
    counts = stamped.groupBy(F.col("day").alias("__day")).agg(F.ceil(F.count("*") / rows_a_file).cast("int").alias("__files"))
    dealt = stamped.join(F.broadcast(counts), F.col("day").eqNullSafe(F.col("__day"))).drop("__day")  # a row a day
    dealt = dealt.withColumn("__file", F.pmod(F.xxhash64(*order, ts), F.col("__files")))
    ready = dealt.repartition("day", "__file").sortWithinPartitions("day", *order, ts).drop("__files", "__file")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The days from ``first`` to ``last``; only their folders are listed in the scan."""
    rows = spark.read.parquet(path)
    rows = rows if first is None else rows.filter(F.col("day") >= F.lit(first).cast("date"))
    return rows if last is None else rows.filter(F.col("day") <= F.lit(last).cast("date"))
