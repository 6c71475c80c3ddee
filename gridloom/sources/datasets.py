"""Raw measurement files as one long form: ``dataset, kind, series_id, ts_utc, value``.

``ts_utc`` is the start of the interval.  Loads and generation are mean kW,
irradiance mean W/m2, fleets and profiles as their docstrings say.  Bad cells
become nulls here; :mod:`gridloom.operators.quality` judges them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import first_format, local_to_utc, number
from ..operators.relational import outside_intervals


class DatasetError(ValueError):
    """A file that is not what its reader expects."""


def _long(df: DataFrame, dataset: str, kind: Column | str, series: Column | str, ts: Column | str, value: Column | str) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.lit(dataset).alias("dataset"), kind.alias("kind"), col(series).cast("string").alias("series_id"), col(ts).cast("timestamp_ntz").alias("ts_utc"), col(value).cast("double").alias("value"))


def solar_homes(spark: SparkSession, path: str, zone: str = "Australia/Sydney") -> DataFrame:
    """Half-hour columns named by the interval's end, a title line first, one row a customer, channel and day.

    Loads add both load channels, and are null where one that has a row has no
    value.  Stamps that the clock shows twice or never are left out.
    """
    lines = spark.read.text(path)
    header = lines.filter(F.ltrim(F.regexp_replace("value", '^[﻿"]+', "")).startswith("Customer")).first()
    if header is None:
        raise DatasetError("no header that starts with Customer")
    names = [c.strip().strip('"') for c in header.value.split(",")]
    slots = [i for i, c in enumerate(names) if c.replace(":", "").isdigit() and ":" in c]
    if len(slots) != 48:
        raise DatasetError(f"48 half-hour columns expected, {len(slots)} found")
    missing = {"Customer", "Consumption Category", "date"} - set(names)
    if missing:
        raise DatasetError(f"columns missing: {sorted(missing)}")
    row = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(len(names)))))
    at = {c: F.col(f"r.c{i}") for i, c in enumerate(names)}
    day = first_format(F.trim(at["date"]), "d/M/yyyy", "d-MMM-yy", "d/M/yy", "yyyy-MM-dd")
    start = lambda c: (int(c.split(":")[0]) * 60 + int(c.split(":")[1]) - 30) % 1440
    cells = F.array(*(F.struct(F.lit(start(names[i])).alias("m"), number(F.col(f"r.c{i}")).alias("kwh")) for i in slots))
    rows = lines.select(row.alias("r")).filter(at["Customer"].try_cast("int").isNotNull())
    flat = rows.select(at["Customer"].cast("int").alias("customer"), F.trim(at["Consumption Category"]).alias("channel"), day.alias("day"), F.explode(cells).alias("x"))
    stamped = flat.withColumn("ts", local_to_utc(F.col("day") + F.make_dt_interval(mins=F.col("x.m")), zone)).filter("ts is not null")
    kind = F.when(F.col("channel") == "GG", "pv").otherwise("load")
    kw = F.col("x.kwh") * 2
    total = stamped.groupBy(kind.alias("kind"), "customer", "ts").agg(F.when(F.count(kw) == F.count("*"), F.sum(kw)).alias("kw"))
    return _long(total, "solar_homes", F.col("kind"), F.format_string("c%03d", "customer"), "ts", "kw")


def smart_meter(spark: SparkSession, path: str, tariff: str | None = "Std", homes: list[str] | None = None, start: str | None = None, end: str | None = None, first: int | None = None) -> DataFrame:
    """Half-hour energies of many homes; rows of one home and stamp are averaged.

    ``first`` keeps the homes of the smallest ids that have data in the period.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    value = next((c for c in raw.columns if c.upper().startswith("KWH")), None)
    if value is None or "LCLid" not in raw.columns:
        raise DatasetError("columns LCLid and KWH/hh expected")
    rows = raw.select(F.col("LCLid").alias("home"), F.trim("stdorToU").alias("tariff"), F.try_to_timestamp("DateTime").cast("timestamp_ntz").alias("ts"), (number(F.col(f"`{value}`")) * 2).alias("kw"))
    rows = rows if tariff is None else rows.filter(F.col("tariff") == tariff)
    rows = rows if homes is None else rows.filter(F.col("home").isin(homes))
    rows = rows if start is None else rows.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    rows = rows if end is None else rows.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    if first is not None:
        rows = rows.join(rows.filter("kw is not null").select("home").distinct().orderBy("home").limit(first), "home", "left_semi")
    return _long(rows.filter("ts is not null").groupBy("home", "ts").agg(F.avg("kw").alias("kw")), "smart_meter", "load", "home", "ts", "kw")


def hourly_map_api(spark: SparkSession, path: str) -> DataFrame:
    """A JSON answer with one map of hours (``yyyyMMddHH``) for each parameter; irradiance and air temperature, in UTC."""
    schema = "properties struct<parameter map<string,map<string,double>>>, header struct<fill_value double, time_standard string>, parameters map<string,struct<units string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    parameter = F.col("properties.parameter")
    units = F.replace(F.coalesce(F.col("parameters")["ALLSKY_SFC_SW_DWN"]["units"], F.lit("Wh/m^2")), F.lit(" "), F.lit(""))
    bad = F.when(parameter["ALLSKY_SFC_SW_DWN"].isNull(), "no irradiance").when(F.upper(F.coalesce("header.time_standard", F.lit("UTC"))) != "UTC", "not in UTC").when(~units.isin("Wh/m^2", "W/m^2"), F.concat(F.lit("unit "), units))
    checked = doc.withColumn("p", F.when(bad.isNull(), parameter).otherwise(F.raise_error(F.concat(F.lit("hourly_map_api: "), bad))))
    cells = checked.select(F.coalesce("header.fill_value", F.lit(-999.0)).alias("fill"), F.explode("p").alias("name", "hours")).select("fill", "name", F.explode("hours").alias("hour", "value"))
    kind = F.when(F.col("name") == "ALLSKY_SFC_SW_DWN", "irradiance").otherwise("temperature")
    ts = F.try_to_timestamp("hour", F.lit("yyyyMMddHH"))
    return _long(cells.filter(F.col("name").isin("ALLSKY_SFC_SW_DWN", "T2M")), "hourly_map_api", kind, "name", ts, F.when(F.col("value") > F.col("fill"), F.col("value")))


def hourly_record_api(spark: SparkSession, path: str) -> DataFrame:
    """A JSON answer with an array of hourly records; power in W becomes per unit of the module's peak, stamps are cut to the hour."""
    schema = "inputs struct<pv_module struct<peak_power double>>, outputs struct<hourly array<struct<time string, P double, T2m double>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("inputs.pv_module.peak_power").alias("peak"), F.explode("outputs.hourly").alias("h"))
    ts = F.date_trunc("hour", F.try_to_timestamp("h.time", F.lit("yyyyMMdd:HHmm")))
    made = F.struct(F.lit("pv").alias("kind"), (F.col("h.P") / (F.col("peak") * 1000)).alias("v"))
    warm = F.struct(F.lit("temperature").alias("kind"), F.col("h.T2m").alias("v"))
    return _long(rows.select(ts.alias("ts"), F.explode(F.array(made, warm)).alias("x")), "hourly_record_api", F.col("x.kind"), F.col("x.kind"), "ts", F.col("x.v"))


def profile_table(spark: SparkSession, path: str, zone: str = "Europe/Berlin", sep: str = ";") -> DataFrame:
    """Wall-clock profiles ``<name>_pload``, ``<name>_qload`` and ``PV...``; hours that occur twice are told apart by their order in the file."""
    raw = spark.read.csv(path, header=True, sep=sep)
    kinds = {c: "load" if c.endswith("_pload") else "reactive" if c.endswith("_qload") else "pv" for c in raw.columns if c.endswith(("_pload", "_qload")) or c.upper().startswith("PV")}
    if "time" not in raw.columns or not kinds:
        raise DatasetError("a time column and profiles expected")
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(k).alias("kind"), number(F.col(f"`{c}`")).alias("v")) for c, k in kinds.items()))
    rows = raw.select(F.try_to_timestamp("time", F.lit("dd.MM.yyyy HH:mm")).cast("timestamp_ntz").alias("wall"), F.monotonically_increasing_id().alias("n"), cells.alias("cells")).filter("wall is not null")
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("wall").orderBy("n")) - 1
    early = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("wall"))
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), early)
    rows = rows.withColumn("ts", F.when(back == F.col("wall"), early + F.make_dt_interval(hours=again.cast("int"))))
    return _long(rows.filter("ts is not null").select("ts", F.explode("cells").alias("x")), "profile_table", F.col("x.kind"), F.col("x.name"), "ts", F.col("x.v"))


def pv_fleet(spark: SparkSession, root: str, ids: list[int], start: str, end: str, minutes: int = 30) -> DataFrame:
    """Metered systems under ``year=/month=`` folders, period-ending stamps in GMT; null readings and impossible ones go.

    Folders are pruned by month and systems pushed to the scan; readings whose
    stamp lies in a bad period of their system (``bad_data.csv``) are left out.
    """
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    month = F.col("year") * 12 + F.col("month")
    months = [int(s[:4]) * 12 + int(s[5:7]) for s in (start, end)]
    rows = spark.read.parquet(f"{root}/data").filter(month.between(*months) | (month == months[1] + 1)).filter(F.col("ss_id").isin(ids)).select("ss_id", F.col("datetime_GMT").cast("timestamp_ntz").alias("stamp"), "generation_Wh")
    meta = spark.read.csv(f"{root}/metadata.csv", header=True).select(F.col("ss_id").cast("long").alias("ss_id"), F.col("kWp").cast("double").alias("kwp"))
    bad = spark.read.csv(f"{root}/bad_data.csv", header=True).select(F.col("ss_id").cast("long").alias("ss_id"), F.try_to_timestamp("start_datetime_GMT").cast("timestamp_ntz").alias("s"), F.try_to_timestamp("end_datetime_GMT").cast("timestamp_ntz").alias("e"))
    kw = F.col("generation_Wh") / 1000 * (60 / minutes)
    rows = rows.withColumns({"kw": kw, "ts": F.col("stamp") - F.make_dt_interval(mins=F.lit(minutes))}).filter((F.col("ts") >= first) & (F.col("ts") < last))
    good = outside_intervals(rows, bad, "ss_id", "stamp", "s", "e").join(meta, "ss_id").filter("kw >= 0 and kw <= 1.5 * kwp")
    return _long(good, "pv_fleet", "pv", "ss_id", "ts", "kw")


def weather_station(spark: SparkSession, path: str) -> DataFrame:
    """Hourly station files, one a year and station: any of two separators, decimal comma or point, header lines or none.

    Stamps end their hour.  Radiation in kJ/m2 becomes mean W/m2; -9999 and
    blanks are nulls.  Files are small (a station's year) and read whole.
    """
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    lines = files.select("path", F.filter(F.split(text, "\r?\n"), lambda x: F.length(x) > 0).alias("lines"))
    header = F.filter("lines", lambda x: F.lower(x).rlike("^data"))
    header = F.element_at(F.filter(header, lambda x: F.lower(x).contains("hora")), 1)
    sep = F.when(header.contains(";"), ";").otherwise(",")
    lines = lines.withColumns({"h": F.lower(header), "sep": sep})
    # a station's header may itself hold a comma in a name, so the separator is fixed before the split
    names = F.split("h", F.concat(F.lit("["), F.col("sep"), F.lit("]")))
    place = lambda word: F.array_position(F.transform(names, lambda n: n.contains(word)), True)
    lines = lines.withColumns({"radiation": place("radia"), "warm": place("bulbo seco")})
    cells = lines.select("path", "radiation", "warm", F.explode(F.transform("lines", lambda x: F.split(x, F.concat(F.lit("["), F.col("sep"), F.lit("]"))))).alias("x"))
    hour = F.regexp_extract(F.trim(F.col("x")[1]), r"^(\d\d):?(\d\d)", 0)
    ended = first_format(F.concat_ws(" ", F.trim(F.col("x")[0]), F.replace(hour, F.lit(":"), F.lit(""))), "yyyy/MM/dd HHmm", "yyyy-MM-dd HHmm", "dd/MM/yyyy HHmm", "dd-MM-yyyy HHmm")
    rows = cells.filter(F.size("x") > 3).withColumn("ts", ended - F.expr("interval 1 hour")).filter("ts is not null")
    value = lambda at: F.when(number(F.get("x", at - 1)) > -9999, number(F.get("x", at - 1)))
    made = F.array(F.struct(F.lit("irradiance").alias("kind"), (value(F.col("radiation").cast("int")) / 3.6).alias("v")), F.struct(F.lit("temperature").alias("kind"), value(F.col("warm").cast("int")).alias("v")))
    return _long(rows.select("path", "ts", F.explode(made).alias("x")), "weather_station", F.col("x.kind"), "path", "ts", F.col("x.v"))


READERS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (solar_homes, smart_meter, hourly_map_api, hourly_record_api, profile_table, pv_fleet, weather_station)
}


def load(spark: SparkSession, dataset: str, path: str, **options) -> DataFrame:
    if dataset not in READERS:
        raise DatasetError(f"unknown dataset {dataset!r}; known: {sorted(READERS)}")
    return READERS[dataset](spark, path, **options)
