"""The measurement datasets as data sources: equal to the column-expression readers, with checked options and pushed filters."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.sources import datasets, formats


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    formats.register(spark)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def homes(tmp_path_factory):
    slots = [f"{m // 60}:{m % 60:02d}" for m in range(30, 1440, 30)] + ["0:00"]
    head = "Customer,Generator Capacity,Postcode,Consumption Category,date," + ",".join(slots) + ",Row Quality"
    day = lambda c, ch, d, first: f"{c},1.0,2000,{ch},{d},{first}," + ",".join(f"{i / 8}" for i in range(47)) + ","
    dates = ["1/07/2012", "1-Jul-12", "01/07/2012", "2012-07-02", "7/04/2013", "7/10/2012"]
    path = tmp_path_factory.mktemp("homes") / "a.csv"
    path.write_text("\n".join(["a title line", head, *(day(c, ch, d, "" if c == 3 else "0.5") for c in range(1, 12) for ch in ("GC", "CL", "GG") for d in dates[3:]), day(12, "GC", dates[0], "1"), day(13, "GC", dates[1], "1"), day(14, "GG", dates[2], "1"), "not,a,row"]))
    return str(path)


@pytest.mark.parametrize("split", ["64", "0.003"])
def test_solar_homes(spark, homes, split):
    got = spark.read.format("solar_homes").option("split_mb", split).load(homes)
    assert (got.rdd.getNumPartitions() > 1) == (split != "64")
    assert rows(formats.added_up(got)) == rows(datasets.solar_homes(spark, homes))
    some = got.filter("kind = 'pv' and series_id in ('c002', 'c014') and ts_utc >= timestamp_ntz'2012-07-01 20:00:00'")
    native = datasets.solar_homes(spark, homes).filter("kind = 'pv' and series_id in ('c002', 'c014') and ts_utc >= timestamp_ntz'2012-07-01 20:00:00'")
    assert rows(some) == rows(native) and some.count() > 0


def test_filters_reach_the_source(spark, homes):
    some = spark.read.format("solar_homes").load(homes).filter("kind = 'pv' and ts_utc < timestamp_ntz'2012-08-01 00:00:00' and value > 1")
    scan, text = plan(some).split("BatchScan")[1], plan(some)
    assert "kind" in scan and "ts_utc" in scan
    left = text.split("BatchScan")[0]
    assert "value" in left and "ts_utc#" not in left.split("Filter")[1].split(")")[0] and "pv" not in left  # Spark tests only what the source did not take


METER = "LCLid,stdorToU,DateTime,KWH/hh (per half hour) ,Acorn,Acorn_grouped\n" + "".join(
    f"M{h},{'ToU' if h % 4 == 0 else 'Std'},2013-01-{1 + i // 48:02d} {i % 48 // 2:02d}:{i % 2 * 30:02d}:00.0000000, {'Null' if i % 17 == 0 else i / 64} ,A,B\n" for h in range(9) for i in range(100)
)


@pytest.mark.parametrize("split", ["64", "0.001"])
def test_smart_meter(spark, tmp_path, split):
    (tmp_path / "m.csv").write_text(METER.rstrip("\n"))
    load = lambda **o: spark.read.format("smart_meter").options(split_mb=split, **o).load(str(tmp_path))
    native = datasets.smart_meter(spark, str(tmp_path / "m.csv"))
    assert rows(load()) == rows(native)
    assert (load().rdd.getNumPartitions() > 20) == (split != "64")
    assert rows(load(tariff="ToU", homes="M4, M8", start="2013-01-02", end="2013-01-03")) == rows(datasets.smart_meter(spark, str(tmp_path / "m.csv"), "ToU", ["M4", "M8"], "2013-01-02", "2013-01-03"))
    assert load(tariff="all").filter("series_id = 'M4'").count() == 100 and load().filter("kind = 'pv'").count() == 0
    assert rows(load().filter("series_id = 'M3' and value is null")) == rows(native.filter("series_id = 'M3' and value is null"))


@pytest.mark.parametrize(
    ("source", "options", "said"),
    [
        ("smart_meter", {"tarif": "Std"}, "unknown option 'tarif'"),
        ("smart_meter", {"tariff": "Best"}, "option tariff is none of Std, ToU, all"),
        ("smart_meter", {"split_mb": "many"}, "not of type float"),
        ("smart_meter", {"split_mb": "0"}, "option split_mb is below"),
        ("smart_meter", {"start": "yesterday"}, "not of type datetime"),
        ("pv_fleet", {"start": "2020-01-01"}, "option end is missing"),
        ("pv_fleet", {"start": "2020-01-01", "end": "2020-02-01", "ids": "1,x"}, "not of type numbers"),
    ],
)
def test_options_are_checked(spark, tmp_path, source, options, said):
    (tmp_path / "m.csv").write_text(METER)
    with pytest.raises(Exception, match="(?s)" + said):
        spark.read.format(source).options(**options).load(str(tmp_path)).collect()


def test_missing_and_wrong_files(spark, tmp_path):
    with pytest.raises(Exception, match="is not there"):
        spark.read.format("smart_meter").load(str(tmp_path / "none")).collect()
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    for source, said in (("smart_meter", "LCLid"), ("solar_homes", "no header"), ("profile_table", "a time column"), ("weather_station", "no header")):
        with pytest.raises(Exception, match=said):
            spark.read.format(source).load(str(tmp_path)).collect()
    (tmp_path / "sub").mkdir()
    assert spark.read.format("smart_meter").load(str(tmp_path / "sub")).count() == 0


def test_json_apis(spark, tmp_path):
    doc = {"properties": {"parameter": {"ALLSKY_SFC_SW_DWN": {"2024010100": 5.0, "2024010101": -999.0}, "T2M": {"2024010100": 20.0}}}, "header": {"fill_value": -999.0, "time_standard": "UTC"}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    got = spark.read.format("hourly_map_api").load(str(tmp_path / "a.json"))
    assert rows(got) == rows(datasets.hourly_map_api(spark, str(tmp_path / "a.json")))
    assert got.filter("kind = 'temperature'").count() == 1
    doc["parameters"] = {"ALLSKY_SFC_SW_DWN": {"units": "MJ / m^2"}}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="unit MJ/m"):
        spark.read.format("hourly_map_api").load(str(tmp_path / "b.json")).collect()
    doc = {"inputs": {"pv_module": {"peak_power": 2.0}}, "outputs": {"hourly": [{"time": f"20200101:{h:02d}10", "P": 50.0 * h, "T2m": 25.0} for h in range(24)]}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert rows(spark.read.format("hourly_record_api").load(str(tmp_path / "c.json"))) == rows(datasets.hourly_record_api(spark, str(tmp_path / "c.json")))


def test_profile_table(spark, tmp_path):
    walls = ["30.10.2016 01:45", "30.10.2016 02:00", "30.10.2016 02:00", "30.10.2016 03:00", "27.03.2016 02:30"]
    (tmp_path / "p.csv").write_text("time;H0_pload;H0_qload;PV1\n" + "\n".join(f"{w};{i};;0,5" for i, w in enumerate(walls)))
    got = spark.read.format("profile_table").load(str(tmp_path / "p.csv"))
    assert rows(got) == rows(datasets.profile_table(spark, str(tmp_path / "p.csv")))
    assert {r.series_id for r in got.filter("kind in ('load', 'pv')").collect()} == {"H0_pload", "PV1"}


def test_pv_fleet(spark, tmp_path):
    at = lambda m, h: dt.datetime(2020, m, 1, h)
    data = [(1, at(6, 10), 500.0), (1, at(6, 11), -1.0), (1, at(6, 12), 5000.0), (1, at(6, 13), 400.0), (2, at(6, 10), 300.0), (3, at(6, 10), 300.0), (1, at(7, 10), 100.0), (3, at(8, 10), 90.0)]
    df = spark.createDataFrame(data, "ss_id long, datetime_GMT timestamp_ntz, generation_Wh double")
    df.withColumns({"year": F.year("datetime_GMT"), "month": F.month("datetime_GMT")}).write.partitionBy("year", "month").parquet(str(tmp_path / "data"))
    (tmp_path / "metadata.csv").write_text("ss_id,kWp\n1,2.0\n2,2.0\n3,2.0\n")
    (tmp_path / "bad_data.csv").write_text("ss_id,start_datetime_GMT,end_datetime_GMT\n1,2020-06-01 13:00:00,2020-06-01 14:00:00\n2,2020-05-01 00:00:00,\n")
    load = lambda **o: spark.read.format("pv_fleet").options(**o).load(str(tmp_path))
    assert rows(load(ids="1,2", start="2020-06-01", end="2020-06-02")) == rows(datasets.pv_fleet(spark, str(tmp_path), [1, 2], "2020-06-01", "2020-06-02"))
    every = load(start="2020-01-01", end="2021-01-01")
    assert every.count() == 4 and every.rdd.getNumPartitions() > every.filter("ts_utc >= timestamp_ntz'2020-08-01 00:00:00'").rdd.getNumPartitions() == 1
    assert [r.value for r in every.filter("series_id = '3' and ts_utc >= timestamp_ntz'2020-07-15 00:00:00'").collect()] == [pytest.approx(0.18)]


@pytest.mark.parametrize("official", [True, False])
def test_weather_station(spark, tmp_path, official):
    top = "Data;Hora UTC;PRECIPITAÇÃO TOTAL, HORÁRIO (mm);RADIACAO GLOBAL (Kj/m²);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);UMIDADE;"
    lines = ["REGIAO:;S", "UF:;SC", top, "2024/01/01;0100 UTC;0;360,0;22,5;80;", "2024-01-01;02:00;0;-9999;;80;"]
    if official:
        (tmp_path / "w.csv").write_bytes("\n".join(lines).encode("latin-1"))
    else:
        (tmp_path / "w.csv").write_text("\n".join(",".join(c.replace(",", ".") for c in x.split(";")) for x in lines[2:]))
    keyed = lambda df: sorted((r.kind, str(r.ts_utc), None if r.value is None else round(r.value, 9)) for r in df.collect())
    got = spark.read.format("weather_station").load(str(tmp_path))
    assert keyed(got) == keyed(datasets.weather_station(spark, str(tmp_path / "w.csv"))) and got.count() == 4


def test_lines_belong_to_the_range_of_their_first_byte(tmp_path):
    text = b"".join(b"%d" % i * (i % 7) + b"\n" for i in range(60)) + b"the end"
    (tmp_path / "t.csv").write_bytes(text)
    for size in (1, 3, 10, 1000):
        parts = [formats.Part(str(tmp_path / "t.csv"), at, min(len(text), at + size)) for at in range(0, len(text), size)]
        assert b"".join(formats.whole_lines(str(tmp_path), p) for p in parts) == text
    assert pd.isna(formats.moments(pd.Series(["x", None]), "%Y")).all()
