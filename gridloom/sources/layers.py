"""Register layers, archive members, seed tables and criteria files.

Folders are listed by Spark's own reader, so they may lie in any store.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import zipfile
from dataclasses import dataclass, fields
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.feeder import MONTHS
from .datasets import DatasetError

#: Names of the register's layers and of the columns that the conversion needs.
REQUIRED = {
    "SSDBT": ["PAC_1", "PAC_2", "TIP_CND", "COMP", "UNI_TR_MT"],
    "UNTRMT": ["COD_ID", "PAC_1", "PAC_2", "POT_NOM"],
    "SEGCON": ["COD_ID", "R1", "X1", "CNOM"],
    "UCBT_tab": ["PAC", "UNI_TR_MT", *MONTHS],
}
OPTIONAL = ["RAMLIG", "EQTRMT", "UGBT_tab", "CRVCRG"]
#: Separators that a layer's header is tried with.
SEPARATORS = (";", ",", "\t", "|")


def layer_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Path of each layer (CSV or Parquet) by its lower-case stem; contents are not read.

    A layer is a file of that name, or a folder of that name which holds its parts.
    """
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    place = F.when(F.lower(parent).rlike(r"\.(csv|parquet)$"), parent).otherwise(F.col("path")).alias("place")
    found = {}
    for row in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(place).distinct().orderBy("place").collect():  # a layer each
        stem, ending = os.path.splitext(unquote(row.place).rsplit("/", 1)[-1])
        if ending.lower() in (".csv", ".parquet"):
            found.setdefault(stem.lower(), unquote(row.place))
    return found


def separator(header: str) -> str:
    """The candidate by which a header falls into most different names."""
    return max(SEPARATORS, key=lambda c: len({x.strip() for x in next(csv.reader([header], delimiter=c), [])}))


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A layer as trimmed strings with upper-case names; columns of binary and nested types, as geometries are, are left out."""
    if path.lower().endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        head = spark.read.text(path).first()
        df = spark.read.csv(path, header=True, sep=separator(head.value if head else ""), inferSchema=False, nullValue=None, emptyValue="")
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    return df.select(*(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c.lstrip("\ufeff").strip().upper()) for c in flat))


def inspect(spark: SparkSession, folder: str, required: dict[str, list[str]] | None = None, optional: list[str] | None = None) -> DataFrame:
    """A row a layer: its file, its rows, the needed columns that it lacks, and whether it can be converted.

    All layers' rows are counted by one job.
    """
    required = REQUIRED if required is None else required
    wanted = dict(required) | {name: [] for name in (OPTIONAL if optional is None else optional)}
    files = layer_files(spark, folder)
    found = {name: read_layer(spark, files[name.lower()]) for name in wanted if name.lower() in files}
    about = []
    for name, columns in wanted.items():
        lacking = [c for c in columns if name in found and c.upper() not in found[name].columns]
        about.append((name, name in required, files.get(name.lower()), lacking))
    listed = spark.createDataFrame(about, "layer string, needed boolean, path string, lacking array<string>")
    counts = [rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows") for name, rows in found.items()]
    counted = reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "layer string, n_rows long")
    ready = F.col("path").isNotNull() & (F.size("lacking") == 0)
    return listed.join(counted, "layer", "left").select("layer", "needed", "path", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "lacking", (ready | (~F.col("needed") & F.col("path").isNull())).alias("ready"))


def read_layers(spark: SparkSession, folder: str, required: dict[str, list[str]] | None = None, optional: list[str] | None = None) -> dict[str, DataFrame]:
    """All layers that are there; an error names each required layer or column that is not."""
    required = REQUIRED if required is None else required
    files = layer_files(spark, folder)
    names = [*required, *(OPTIONAL if optional is None else optional)]
    tables = {n: read_layer(spark, files[n.lower()]) for n in names if n.lower() in files}
    wrong = [f"layer {n} is not there" for n in required if n not in tables]
    wrong += [f"layer {n} lacks {c}" for n in required if n in tables for c in required[n] if c.upper() not in tables[n].columns]
    if wrong:
        raise DatasetError("; ".join(wrong))
    return tables


def archive_lines(spark: SparkSession, path: str, member: str = r"(?i)\.csv$", encoding: str = "utf-8") -> DataFrame:
    """``archive, member, line_no, line`` of the members whose names match; members are unpacked as streams, a task an archive.

    ``path`` may be a pattern.  Archives over 2 GB are beyond the reader.
    """
    wanted = re.compile(member)

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for name in sorted(n for n in z.namelist() if wanted.search(n)):
                        with io.TextIOWrapper(z.open(name), encoding, errors="replace") as text:
                            at, lines = 0, []
                            for line in text:
                                lines.append(line.rstrip("\r\n"))
                                if len(lines) == 10_000:
                                    yield rows(archive, name, at, lines)
                                    at, lines = at + len(lines), []
                            if lines:
                                yield rows(archive, name, at, lines)

    def rows(archive, name, at, lines):
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([archive] * n), pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), pa.array(lines)], ["archive", "member", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line_no long, line string")


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    """The seed of voltage limits, one row a network; a band that is none is an error."""
    df = spark.read.csv(path, header=True, schema="network string, v_min_pu double, v_max_pu double", enforceSchema=False)
    wrong = df.filter("network is null or v_min_pu is null or v_max_pu is null or v_min_pu >= v_max_pu").limit(1).collect()
    if wrong or not df.groupBy("network").count().filter("count > 1").isEmpty():
        raise DatasetError(f"{path}: not one band a network")
    return df


def write_scope(scope: DataFrame, path: str) -> None:
    """The seed of buses in scope (``network``, ``bus_id``), sorted."""
    scope.select("network", "bus_id").distinct().orderBy("network", "bus_id").write.csv(path, header=True)


@dataclass(frozen=True)
class Criterion:
    """Bands of voltages and the shares of a window's readings that may lie in each; the names are those of the files."""

    name: str
    adequate_lo_pu: float
    adequate_hi_pu: float
    critical_lo_pu: float
    critical_hi_pu: float
    upper_precarious_max: float
    upper_critical_max: float
    lower_precarious_max: float
    lower_critical_max: float
    thermal_max: float = 0.0
    reading_minutes: int = 10
    window_days: int = 7
    reference: str = ""
    to_verify: bool = False

    def allowances(self) -> dict[str, float]:
        """The shares that :func:`gridloom.operators.hosting.weekly_sweep` takes."""
        return {"precarious": self.upper_precarious_max, "critical": self.upper_critical_max, "thermal": self.thermal_max}


def load_criteria(spark: SparkSession, path: str, known: dict[str, Criterion] | None = None) -> dict[str, Criterion]:
    """``known`` and the criteria of a JSON file, one or a list; a name always means the same numbers."""
    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # a settings file
    out, names = dict(known or {}), {f.name for f in fields(Criterion)}
    for one in found if isinstance(found, list) else [found]:
        if set(one) - names:
            raise DatasetError(f"unknown fields of a criterion: {sorted(set(one) - names)}")
        made = Criterion(**one)
        if out.setdefault(made.name, made) != made:
            raise DatasetError(f"criterion {made.name!r} is known with other numbers")
    return out
