"""The seven measurement datasets as Spark data sources: ``spark.read.format("smart_meter")``.

Each gives the long form of :mod:`gridloom.sources.datasets`, one row a cell of
its files: ``dataset, kind, series_id, ts_utc, value``.  Options are typed and
checked before any file is opened.  Files of lines are cut into byte ranges of
``split_mb``, other files are one partition each.  Comparisons of ``kind``,
``series_id`` and ``ts_utc`` with constants are taken from the query: they prune
files by what their names and folders say, columns before they are parsed, and
rows before they leave the reader.

Files are opened by Arrow, so a path may lie in any store that Arrow knows; for
stores that only Spark reads there are the readers of ``datasets``.

Differences from those: a home's two load channels are rows of their own
(:func:`added_up` adds them), and repeated readings are not averaged.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import typing
from collections.abc import Iterator
from dataclasses import MISSING, dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
import pyarrow.fs as pa_fs
import pyarrow.parquet as pa_parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .datasets import DatasetError

LONG = "dataset string, kind string, series_id string, ts_utc timestamp_ntz, value double"
_STAMP = pa.timestamp("us")


# --- options -------------------------------------------------------------------------------------------------------


def _moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


#: How an option's text becomes a value, by its type's name.
_READ = {
    "str": str, "int": int, "float": float, "datetime": _moment,
    "bool": lambda t: {"true": True, "false": False}[t.lower()],
    "words": lambda t: tuple(x.strip() for x in t.split(",") if x.strip()),
    "numbers": lambda t: tuple(int(x) for x in t.split(",") if x.strip()),
}


def option(kind: str, default: typing.Any = MISSING, least: float | None = None, choices: tuple = ()) -> typing.Any:
    made = {"metadata": {"kind": kind, "least": least, "choices": choices}}
    return field(**made) if default is MISSING else field(default=default, **made)


def checked(options: type, given: dict[str, str], source: str):
    """``given`` as an object of ``options``; an error names every option that is unknown, missing or of another type."""
    known, wrong, made = {f.name: f for f in fields(options)}, [], {}
    for name, text in given.items():
        if name.lower() not in known:
            wrong.append(f"unknown option {name!r}")
            continue
        f = known[name.lower()]
        try:
            value = _READ[f.metadata["kind"]](text)
        except (ValueError, KeyError):
            wrong.append(f"option {f.name} = {text!r} is not of type {f.metadata['kind']}")
            continue
        if f.metadata["least"] is not None and value < f.metadata["least"]:
            wrong.append(f"option {f.name} is below {f.metadata['least']}")
        elif f.metadata["choices"] and value not in f.metadata["choices"]:
            wrong.append(f"option {f.name} is none of {', '.join(f.metadata['choices'])}")
        made[f.name] = value
    wrong += [f"option {n} is missing" for n, f in known.items() if f.default is MISSING and n not in made]
    if wrong:
        raise DatasetError(f"{source}: {'; '.join(sorted(wrong))}; known: {', '.join(known)}")
    return options(**made)


@dataclass(frozen=True)
class Files:
    path: str = option("str")


@dataclass(frozen=True)
class Lines(Files):
    split_mb: float = option("float", 64.0, least=0.0001)


@dataclass(frozen=True)
class AnswerOptions(Files):
    series: str = option("str", "parameter", choices=("parameter", "file"))


@dataclass(frozen=True)
class HomesOptions(Lines):
    zone: str = option("str", "Australia/Sydney")


@dataclass(frozen=True)
class MeterOptions(Lines):
    tariff: str = option("str", "Std", choices=("Std", "ToU", "all"))
    homes: tuple = option("words", ())
    start: dt.datetime | None = option("datetime", None)
    end: dt.datetime | None = option("datetime", None)


@dataclass(frozen=True)
class ProfileOptions(Files):
    zone: str = option("str", "Europe/Berlin")
    sep: str = option("str", ";")


@dataclass(frozen=True)
class FleetOptions(Files):
    start: dt.datetime = option("datetime")
    end: dt.datetime = option("datetime")
    ids: tuple = option("numbers", ())
    minutes: int = option("int", 30, least=1)


# --- what the query wants ------------------------------------------------------------------------------------------


@dataclass
class Wanted:
    """The conjunction of the filters that were taken: sets of texts, and ends of the time."""

    kind: set | None = None
    series_id: set | None = None
    first: dt.datetime | None = None  # at least
    last: dt.datetime | None = None  # at most
    exact: list = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether rows that fail ``f`` will be left out here."""
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if isinstance(f, IsNotNull):
            return name in ("kind", "series_id", "ts_utc", "dataset")  # these are never null
        if name in ("kind", "series_id") and isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            now = getattr(self, name)
            setattr(self, name, values if now is None else now & values)
            return True
        if name == "ts_utc" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            at = f.value.replace(tzinfo=None)
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.first = max(self.first or at, at)
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.last = min(self.last or at, at)
            self.exact.append((type(f).__name__, at))
            return True
        return False

    def wants(self, kind: str) -> bool:
        return self.kind is None or kind in self.kind

    def rows(self, made: pa.Table) -> pa.Table:
        keep = pc.is_valid(made["ts_utc"])
        for name in ("kind", "series_id"):
            if getattr(self, name) is not None:
                keep = pc.and_(keep, pc.is_in(made[name], pa.array(sorted(x for x in getattr(self, name) if x is not None), pa.string())))
        compare = {"EqualTo": pc.equal, "GreaterThan": pc.greater, "GreaterThanOrEqual": pc.greater_equal, "LessThan": pc.less, "LessThanOrEqual": pc.less_equal}
        for how, at in self.exact:
            keep = pc.and_(keep, compare[how](made["ts_utc"], pa.scalar(at, _STAMP)))
        return made.filter(keep)


# --- files ---------------------------------------------------------------------------------------------------------


@dataclass
class Part(InputPartition):
    """A file, or the lines of a file that begin in a range of bytes."""

    path: str
    start: int = 0
    end: int | None = None
    header: str = ""

    def __post_init__(self):
        super().__init__(self.path)


def opened(path: str) -> tuple[pa_fs.FileSystem, str]:
    fs, place = pa_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path)) if re.match(r"\w+:/", path) else (pa_fs.LocalFileSystem(), path)
    return fs, place.rstrip("/")


def listed(path: str, endings: tuple[str, ...]) -> list[pa_fs.FileInfo]:
    """The file itself, or all files below the folder that end so, by name; hidden ones are skipped."""
    fs, place = opened(path)
    info = fs.get_file_info(place)
    if info.type == pa_fs.FileType.File:
        return [info]
    if info.type == pa_fs.FileType.NotFound:
        raise DatasetError(f"{path} is not there")
    found = fs.get_file_info(pa_fs.FileSelector(place, recursive=True))
    seen = lambda x: not any(p[:1] in "._" for p in x.path[len(place) + 1 :].split("/"))
    return sorted((x for x in found if x.type == pa_fs.FileType.File and x.path.lower().endswith(endings) and seen(x)), key=lambda x: x.path)


def content(uri: str, path: str) -> bytes:
    with opened(uri)[0].open_input_file(path) as f:
        return f.read()


def head(uri: str, path: str, size: int = 1 << 16) -> bytes:
    with opened(uri)[0].open_input_file(path) as f:
        return f.read(size)


def whole_lines(uri: str, part: Part) -> bytes:
    """The lines whose first byte lies in the part's range."""
    before = max(0, part.start - 1)
    with opened(uri)[0].open_input_file(part.path) as f:
        f.seek(before)
        data = [f.read(part.end - before)]
        while data[-1] and not data[-1].endswith(b"\n"):
            more = f.read(1 << 16)
            data.append(more[: more.find(b"\n") + 1] or more)
    lines = b"".join(data)
    return lines[lines.find(b"\n") + 1 :] if part.start and b"\n" in lines else b"" if part.start else lines


def ranges(path: str, start: int, size: int, split_mb: float, header: str) -> list[Part]:
    step = max(1, int(split_mb * (1 << 20)))
    return [Part(path, at, min(size, at + step), header) for at in range(start, size, step)]


def numbers(texts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Numbers with decimal point or comma; NaN if a text is none."""
    plain = pc.replace_substring(pc.utf8_trim_whitespace(texts), ",", ".")
    return pd.to_numeric(plain.to_pandas(), errors="coerce").to_numpy(float)


def moments(texts: pd.Series, *formats: str) -> pd.Series:
    """Time stamps by the first format that fits; each different text is read once."""
    texts = texts.astype("string").str.strip()
    different = pd.Series(texts.dropna().unique(), dtype="string")
    made = pd.Series(pd.NaT, index=different.index, dtype="datetime64[us]")
    for f in formats:
        made = made.fillna(pd.to_datetime(different, format=f, errors="coerce").astype("datetime64[us]"))
    return texts.map(dict(zip(different, made, strict=True))).astype("datetime64[us]")


def utc(walls: pd.Series, zone: str, first: np.ndarray | None = None) -> pd.Series:
    """UTC of wall times; null where the clock skips one, or shows it twice and ``first`` does not tell which."""
    made = walls.dt.tz_localize(zone, ambiguous="NaT" if first is None else first, nonexistent="NaT")
    return made.dt.tz_convert("UTC").dt.tz_localize(None)


def long_form(kind, series, ts, values) -> pa.Table:
    n = len(values)
    text = lambda x: pa.array([x] * n, pa.string()) if isinstance(x, str) else pa.array(x, pa.string())
    stamps = ts if isinstance(ts, (pa.Array, pa.ChunkedArray)) else pa.array(np.asarray(ts, "datetime64[us]"))
    return pa.table({"kind": text(kind), "series_id": text(series), "ts_utc": stamps, "value": pa.array(np.asarray(values, float), from_pandas=True)})


# --- the sources ---------------------------------------------------------------------------------------------------


class _Reader(DataSourceReader):
    def __init__(self, source: type[Measurements], options):
        self.source, self.options, self.wanted = source, options, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Part]:
        return self.source.parts(self.options, self.wanted) or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            for made in self.source.parse(self.options, partition, self.wanted):
                kept = self.wanted.rows(made)
                yield from kept.add_column(0, "dataset", pa.array([self.source.name()] * len(kept), pa.string())).to_batches(max_chunksize=10_000)


class Measurements(DataSource):
    """What the sources share: their schema, checked options, and a reader that takes filters."""

    kind: type = Files

    def schema(self) -> str:
        return LONG

    def reader(self, schema) -> _Reader:
        return _Reader(type(self), checked(self.kind, dict(self.options), self.name()))

    @staticmethod
    def parts(options, wanted: Wanted) -> list[Part]:
        raise NotImplementedError

    @staticmethod
    def parse(options, part: Part, wanted: Wanted) -> Iterator[pa.Table]:
        raise NotImplementedError


def _csv(data: bytes, names: list[str], columns: list[str], sep: str = ",") -> pa.Table:
    return pa_csv.read_csv(
        io.BytesIO(data), pa_csv.ReadOptions(column_names=names), pa_csv.ParseOptions(delimiter=sep, invalid_row_handler=lambda _: "skip"),
        pa_csv.ConvertOptions(column_types={c: pa.string() for c in columns}, include_columns=columns, strings_can_be_null=False),
    )


class SmartMeter(Measurements):
    """Half-hour energies of many homes as mean kW."""

    kind = MeterOptions

    @classmethod
    def name(cls) -> str:
        return "smart_meter"

    @staticmethod
    def parts(options, wanted):
        if not wanted.wants("load"):
            return []
        out = []
        for info in listed(options.path, (".csv", ".txt")):
            line = head(options.path, info.path).split(b"\n")[0]
            names = [c.strip() for c in line.decode("utf-8-sig").strip().split(",")]
            if "LCLid" not in names or not any(c.upper().startswith("KWH") for c in names):
                raise DatasetError(f"{info.path}: columns LCLid and KWH/hh expected")
            out += ranges(info.path, len(line) + 1, info.size, options.split_mb, ",".join(names))
        return out

    @staticmethod
    def parse(options, part, wanted):
        data = whole_lines(options.path, part)
        if not data:
            return
        names = part.header.split(",")
        energy = next(c for c in names if c.upper().startswith("KWH"))
        rows = _csv(data, names, ["LCLid", "stdorToU", "DateTime", energy])
        homes = [x for x in (wanted.series_id, set(options.homes) or None) if x is not None]
        for some in homes:
            rows = rows.filter(pc.is_in(rows["LCLid"], pa.array(sorted(some), pa.string())))
        if options.tariff != "all":
            rows = rows.filter(pc.equal(pc.utf8_trim_whitespace(rows["stdorToU"]), options.tariff))
        ts = pc.strptime(pc.utf8_slice_codeunits(rows["DateTime"], 0, 19), "%Y-%m-%d %H:%M:%S", "us", error_is_null=True)
        made = long_form("load", rows["LCLid"].combine_chunks(), ts, numbers(rows[energy]) * 2)
        for bound, keep in ((options.start, pc.greater_equal), (options.end, pc.less)):
            made = made if bound is None else made.filter(keep(made["ts_utc"], pa.scalar(bound, _STAMP)))
        yield made


class SolarHomes(Measurements):
    """48 half-hour columns a customer, channel and day, named by the interval's end, below a title line."""

    kind = HomesOptions
    KINDS = {"GG": "pv", "GC": "load", "CL": "load"}

    @classmethod
    def name(cls) -> str:
        return "solar_homes"

    @staticmethod
    def parts(options, wanted):
        out = []
        for info in listed(options.path, (".csv",)):
            top = head(options.path, info.path)
            found = re.search(rb'^[\xef\xbb\xbf"]*Customer[^\n]*', top, re.M)
            if not found:
                raise DatasetError(f"{info.path}: no header that starts with Customer")
            names = [c.strip().strip('"') for c in found[0].decode("utf-8-sig").strip().split(",")]
            slots = [c for c in names if re.fullmatch(r"\d+:\d\d", c)]
            missing = {"Customer", "Consumption Category", "date"} - set(names)
            if len(slots) != 48 or missing:
                raise DatasetError(f"{info.path}: columns missing: {sorted(missing)}" if missing else f"{info.path}: 48 half-hour columns expected, {len(slots)} found")
            out += ranges(info.path, found.end() + 1, info.size, options.split_mb, ",".join(names))
        return out

    @staticmethod
    def parse(options, part, wanted):
        data = whole_lines(options.path, part)
        if not data:
            return
        names = part.header.split(",")
        slots = [c for c in names if re.fullmatch(r"\d+:\d\d", c)]
        rows = _csv(data, names, ["Customer", "Consumption Category", "date", *slots])
        channel = pc.utf8_trim_whitespace(rows["Consumption Category"]).to_pandas()
        kind = channel.map(lambda c: SolarHomes.KINDS.get(c, "load"))
        customer = pd.to_numeric(rows["Customer"].to_pandas(), errors="coerce")
        day = moments(rows["date"].to_pandas(), "%d/%m/%Y", "%d-%b-%y", "%d/%m/%y", "%Y-%m-%d")
        keep = customer.notna() & kind.map(wanted.wants)
        at = np.flatnonzero(keep.to_numpy())
        cells = np.stack([numbers(rows[c]) for c in slots], axis=1)[at]
        begin = np.array([(int(c.split(":")[0]) * 60 + int(c.split(":")[1]) - 30) % 1440 for c in slots])
        walls = pd.Series((day.to_numpy()[at][:, None] + begin.astype("timedelta64[m]")[None, :]).reshape(-1))
        series = customer.iloc[at].astype(int).map("c{:03d}".format)
        yield long_form(np.repeat(kind.iloc[at].to_numpy(), 48), np.repeat(series.to_numpy(), 48), utc(walls, options.zone), cells.reshape(-1) * 2)


class ProfileTable(Measurements):
    """Wall-clock profiles; hours shown twice are told apart by their order in the file."""

    kind = ProfileOptions

    @classmethod
    def name(cls) -> str:
        return "profile_table"

    @staticmethod
    def kinds(names: list[str]) -> dict[str, str]:
        kind = lambda c: "load" if c.endswith("_pload") else "reactive" if c.endswith("_qload") else "pv" if c.upper().startswith("PV") else None
        return {c: k for c in names if (k := kind(c))}

    @staticmethod
    def parts(options, wanted):
        out = []
        for info in listed(options.path, (".csv", ".txt")):
            names = head(options.path, info.path).split(b"\n")[0].decode("utf-8-sig").strip()
            if "time" not in names.split(options.sep) or not ProfileTable.kinds(names.split(options.sep)):
                raise DatasetError(f"{info.path}: a time column and profiles expected")
            out.append(Part(info.path, header=names))
        return out

    @staticmethod
    def parse(options, part, wanted):
        names = part.header.split(options.sep)
        asked = {c: k for c, k in ProfileTable.kinds(names).items() if wanted.wants(k) and (wanted.series_id is None or c in wanted.series_id)}
        rows = _csv(content(options.path, part.path).split(b"\n", 1)[-1] or b"\n", names, ["time", *asked], options.sep)
        walls = moments(rows["time"].to_pandas(), "%d.%m.%Y %H:%M")
        again = walls.groupby(walls, dropna=False).cumcount().to_numpy()
        ts = utc(walls, options.zone, first=again == 0)
        for c, kind in asked.items():
            yield long_form(kind, c, ts, numbers(rows[c]))


class HourlyMapApi(Measurements):
    """JSON answers with a map of hours for each parameter; a series is a parameter or, if so asked, a file."""

    kind = AnswerOptions

    @classmethod
    def name(cls) -> str:
        return "hourly_map_api"

    @staticmethod
    def parts(options, wanted):
        return [Part(x.path) for x in listed(options.path, (".json", ".txt"))]

    @staticmethod
    def parse(options, part, wanted):
        doc = json.loads(content(options.path, part.path))
        about, found = doc.get("header") or {}, (doc.get("properties") or {}).get("parameter") or {}
        units = ((doc.get("parameters") or {}).get("ALLSKY_SFC_SW_DWN") or {}).get("units", "Wh/m^2").replace(" ", "")
        if "ALLSKY_SFC_SW_DWN" not in found:
            raise DatasetError(f"{part.path}: no irradiance")
        if (about.get("time_standard") or "UTC").upper() != "UTC":
            raise DatasetError(f"{part.path}: not in UTC")
        if units not in ("Wh/m^2", "W/m^2"):
            raise DatasetError(f"{part.path}: unit {units}")
        fill = about.get("fill_value", -999.0)
        for name, kind in (("ALLSKY_SFC_SW_DWN", "irradiance"), ("T2M", "temperature")):
            hours = found.get(name) or {}
            if hours and wanted.wants(kind):
                values = np.array([np.nan if v is None else v for v in hours.values()], float)
                yield long_form(kind, name if options.series == "parameter" else part.path, moments(pd.Series(list(hours)), "%Y%m%d%H"), np.where(values > fill, values, np.nan))


class HourlyRecordApi(Measurements):
    """JSON answers with an array of hourly records; stamps are cut to the hour."""

    kind = AnswerOptions

    @classmethod
    def name(cls) -> str:
        return "hourly_record_api"

    @staticmethod
    def parts(options, wanted):
        return [Part(x.path) for x in listed(options.path, (".json", ".txt"))]

    @staticmethod
    def parse(options, part, wanted):
        doc = json.loads(content(options.path, part.path))
        rows = pd.DataFrame(doc["outputs"]["hourly"])
        ts = moments(rows["time"], "%Y%m%d:%H%M").dt.floor("h")
        peak = doc["inputs"]["pv_module"]["peak_power"] * 1000
        for kind, column, scale in (("pv", "P", peak), ("temperature", "T2m", 1.0)):
            if wanted.wants(kind) and column in rows:
                yield long_form(kind, kind if options.series == "parameter" else part.path, ts, pd.to_numeric(rows[column], errors="coerce") / scale)


class PvFleet(Measurements):
    """Metered systems under ``data/year=/month=``, with capacities and bad periods beside; readings that no system gives go."""

    kind = FleetOptions

    @classmethod
    def name(cls) -> str:
        return "pv_fleet"

    @staticmethod
    def parts(options, wanted):
        first = max(options.start, wanted.first or options.start)
        last = min(options.end, wanted.last or options.end)
        months = (first.year * 12 + first.month, (last + dt.timedelta(minutes=options.minutes)).year * 12 + (last + dt.timedelta(minutes=options.minutes)).month)
        out = []
        for info in listed(f"{options.path}/data", (".parquet",)) if wanted.wants("pv") else []:
            found = re.search(r"year=(\d+)/month=(\d+)/", info.path)
            if found and months[0] <= int(found[1]) * 12 + int(found[2]) <= months[1]:
                out.append(Part(info.path))
        return out

    @staticmethod
    def parse(options, part, wanted):
        fs, _ = opened(options.path)
        about = lambda name, **how: pd.concat([pd.read_csv(io.BytesIO(content(options.path, x.path)), **how) for x in listed(f"{options.path}/{name}", (".csv",))])
        meta, bad = about("metadata.csv"), about("bad_data.csv", parse_dates=["start_datetime_GMT", "end_datetime_GMT"])
        ids = set(options.ids) or set(meta["ss_id"])
        if wanted.series_id is not None:
            ids &= {int(x) for x in wanted.series_id if x and re.fullmatch(r"\d{1,18}", x)}
        table = pa_parquet.ParquetFile(fs.open_input_file(part.path))
        for batch in table.iter_batches(columns=["ss_id", "datetime_GMT", "generation_Wh"]):
            rows = batch.filter(pc.is_in(batch.column("ss_id"), pa.array(sorted(ids), batch.schema.field("ss_id").type))).to_pandas()
            rows["stamp"] = pd.to_datetime(rows["datetime_GMT"], utc=True).dt.tz_localize(None)
            rows = rows.merge(meta[["ss_id", "kWp"]], on="ss_id")
            rows["kw"] = rows["generation_Wh"] / 1000 * (60 / options.minutes)
            rows["ts"] = rows["stamp"] - pd.Timedelta(minutes=options.minutes)
            rows = rows[(rows["ts"] >= options.start) & (rows["ts"] < options.end) & (rows["kw"] >= 0) & (rows["kw"] <= 1.5 * rows["kWp"])]
            near = rows.reset_index().merge(bad, on="ss_id")
            hit = near[(near["stamp"] >= near["start_datetime_GMT"]) & (near["end_datetime_GMT"].isna() | (near["stamp"] <= near["end_datetime_GMT"]))]
            rows = rows.drop(index=hit["index"].unique())
            yield long_form("pv", rows["ss_id"].astype(str), rows["ts"], rows["kw"])


class WeatherStation(Measurements):
    """A station's year by the hour, of any of two separators, decimal comma or point, header lines or none."""

    @classmethod
    def name(cls) -> str:
        return "weather_station"

    @staticmethod
    def parts(options, wanted):
        return [Part(x.path) for x in listed(options.path, (".csv",))]

    @staticmethod
    def parse(options, part, wanted):
        data = content(options.path, part.path)
        try:
            text = data.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = data.decode("latin-1")
        lines = [x for x in text.splitlines() if x]
        top = next((i for i, x in enumerate(lines) if x.lower().startswith("data") and "hora" in x.lower()), None)
        if top is None:
            raise DatasetError(f"{part.path}: no header with date and hour")
        sep = ";" if ";" in lines[top] else ","
        names = lines[top].lower().split(sep)
        cells = [x.split(sep) for x in lines[top + 1 :]]
        cells = [x for x in cells if len(x) > 3]
        hours = pd.Series([re.sub(r"^(\d\d):?(\d\d).*", r"\1\2", x[1].strip()) for x in cells], dtype="string")
        ended = moments(pd.Series([x[0].strip() for x in cells], dtype="string") + " " + hours, "%Y/%m/%d %H%M", "%Y-%m-%d %H%M", "%d/%m/%Y %H%M", "%d-%m-%Y %H%M")
        for kind, word, scale in (("irradiance", "radia", 3.6), ("temperature", "bulbo seco", 1.0)):
            at = next((i for i, n in enumerate(names) if word in n), None)
            if wanted.wants(kind):
                values = numbers(pa.array([x[at] if at is not None and at < len(x) else "" for x in cells], pa.string()))
                yield long_form(kind, part.path, ended - pd.Timedelta(hours=1), np.where(values > -9999, values, np.nan) / scale)


SOURCES: dict[str, type[Measurements]] = {s.name(): s for s in (SolarHomes, SmartMeter, HourlyMapApi, HourlyRecordApi, ProfileTable, PvFleet, WeatherStation)}


def register(spark: SparkSession) -> None:
    """Make all formats known to the session, and let Spark hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES.values():
        spark.dataSource.register(source)


def added_up(cells: DataFrame) -> DataFrame:
    """One value a series, kind and stamp: the sum of its cells, null where one is missing."""
    keys = ["dataset", "kind", "series_id", "ts_utc"]
    return cells.groupBy(*keys).agg(F.when(F.count("value") == F.count("*"), F.sum("value")).alias("value"))
