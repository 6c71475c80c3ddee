import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridloom.functions.clock import local_to_utc
from gridloom.operators import quality
from gridloom.sources import datasets


def rows(df):
    return {(r.kind, r.series_id, str(r.ts_utc)): r.value for r in df.collect()}


def test_wall_clock(spark):
    walls = ["2013-04-07 02:30:00", "2012-10-07 02:30:00", "2013-01-01 12:00:00"]  # twice, never, once
    df = spark.createDataFrame([(w,) for w in walls], "w string").select(local_to_utc(F.col("w").cast("timestamp_ntz"), "Australia/Sydney").alias("u"))
    assert [str(r.u) for r in df.collect()] == ["None", "None", "2013-01-01 01:00:00"]


def test_solar_homes(spark, tmp_path):
    slots = [f"{m // 60}:{m % 60:02d}" for m in range(30, 1440, 30)] + ["0:00"]
    head = "Customer,Generator Capacity,Postcode,Consumption Category,date," + ",".join(slots) + ",Row Quality"
    day = lambda c, ch, d, first: f"{c},1.0,2000,{ch},{d},{first}," + ",".join(["0.5"] * 47) + ","
    text = ["a title line", head, day(1, "GC", "1/07/2012", "1.0"), day(1, "CL", "1-Jul-12", ""), day(1, "GG", "01/07/2012", "0.25"), day(2, "GC", "2012-07-01", "2.0")]
    (tmp_path / "a.csv").write_text("\n".join(text))
    got = rows(datasets.solar_homes(spark, str(tmp_path / "a.csv")))
    assert len(got) == 3 * 48 and got["load", "c001", "2012-06-30 14:00:00"] is None
    assert got["load", "c001", "2012-06-30 14:30:00"] == 2.0 and got["pv", "c001", "2012-06-30 14:00:00"] == 0.5 and got["load", "c002", "2012-06-30 14:00:00"] == 4.0
    (tmp_path / "b.csv").write_text("x\n" + head.replace("0:30,", "") + "\n")
    with pytest.raises(datasets.DatasetError):
        datasets.solar_homes(spark, str(tmp_path / "b.csv"))


def test_smart_meter(spark, tmp_path):
    text = "LCLid,stdorToU,DateTime,KWH/hh (per half hour) ,Acorn,Acorn_grouped\nM1,Std,2013-01-01 00:00:00.0000000, 0.5 ,A,B\nM1,Std,2013-01-01 00:00:00.0000000, 0.5 ,A,B\nM1,Std,2013-01-01 00:30:00.0000000,Null,A,B\nM2,ToU,2013-01-01 00:00:00.0000000,1,A,B\nM3,Std,2014-01-01 00:00:00.0000000,1,A,B\n"
    (tmp_path / "m.csv").write_text(text)
    assert rows(datasets.smart_meter(spark, str(tmp_path / "m.csv"), end="2013-06-01", first=1)) == {("load", "M1", "2013-01-01 00:00:00"): 1.0, ("load", "M1", "2013-01-01 00:30:00"): None}


def test_json_apis(spark, tmp_path):
    doc = {"properties": {"parameter": {"ALLSKY_SFC_SW_DWN": {"2024010100": 5.0, "2024010101": -999.0}, "T2M": {"2024010100": 20.0}}}, "header": {"fill_value": -999.0, "time_standard": "UTC"}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    got = rows(datasets.hourly_map_api(spark, str(tmp_path / "a.json")))
    assert got["irradiance", "ALLSKY_SFC_SW_DWN", "2024-01-01 00:00:00"] == 5 and got["irradiance", "ALLSKY_SFC_SW_DWN", "2024-01-01 01:00:00"] is None and len(got) == 3
    doc["header"]["time_standard"] = "LST"
    (tmp_path / "b.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="not in UTC"):
        datasets.hourly_map_api(spark, str(tmp_path / "b.json")).collect()
    doc = {"inputs": {"pv_module": {"peak_power": 2.0}}, "outputs": {"hourly": [{"time": "20200101:0010", "P": 500.0, "T2m": 25.0}]}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert rows(datasets.hourly_record_api(spark, str(tmp_path / "c.json"))) == {("pv", "pv", "2020-01-01 00:00:00"): 0.25, ("temperature", "temperature", "2020-01-01 00:00:00"): 25.0}


def test_profile_table_resolves_repeated_hours(spark, tmp_path):
    walls = ["30.10.2016 01:45", "30.10.2016 02:00", "30.10.2016 02:00", "30.10.2016 03:00", "27.03.2016 02:30"]
    (tmp_path / "p.csv").write_text("time;H0_pload;PV1\n" + "\n".join(f"{w};{i};0,5" for i, w in enumerate(walls)))
    got = rows(datasets.profile_table(spark, str(tmp_path / "p.csv")))
    loads = sorted((k[2], v) for k, v in got.items() if k[0] == "load")
    assert loads == [("2016-10-29 23:45:00", 0), ("2016-10-30 00:00:00", 1), ("2016-10-30 01:00:00", 2), ("2016-10-30 02:00:00", 3)]


def test_pv_fleet(spark, tmp_path):
    at = lambda h: dt.datetime(2020, 6, 1, h)
    data = [(1, at(10), 500.0), (1, at(11), -1.0), (1, at(12), 5000.0), (1, at(13), 400.0), (2, at(10), 300.0), (3, at(10), 300.0)]
    df = spark.createDataFrame(data, "ss_id long, datetime_GMT timestamp_ntz, generation_Wh double")
    df.withColumns({"year": F.year("datetime_GMT"), "month": F.month("datetime_GMT")}).write.partitionBy("year", "month").parquet(str(tmp_path / "data"))
    (tmp_path / "metadata.csv").write_text("ss_id,kWp\n1,2.0\n2,2.0\n3,2.0\n")
    (tmp_path / "bad_data.csv").write_text("ss_id,start_datetime_GMT,end_datetime_GMT\n1,2020-06-01 13:00:00,2020-06-01 14:00:00\n2,2020-05-01 00:00:00,\n")
    assert rows(datasets.pv_fleet(spark, str(tmp_path), [1, 2], "2020-06-01", "2020-06-02")) == {("pv", "1", "2020-06-01 09:30:00"): 1.0}


@pytest.mark.parametrize("official", [True, False])
def test_weather_station(spark, tmp_path, official):
    head = "Data;Hora UTC;PRECIPITAÇÃO TOTAL, HORÁRIO (mm);RADIACAO GLOBAL (Kj/m²);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);UMIDADE;"
    lines = ["REGIAO:;S", "UF:;SC", head, "2024/01/01;0100 UTC;0;360,0;22,5;80;", "2024/01/01;0200 UTC;0;-9999;;80;"]
    if official:
        (tmp_path / "w.csv").write_bytes("\n".join(lines).encode("latin-1"))
    else:
        (tmp_path / "w.csv").write_text("\n".join(",".join(c.replace(",", ".") for c in x.split(";")) for x in lines[2:]))
    got = {(k, t): v for (k, _, t), v in rows(datasets.load(spark, "weather_station", str(tmp_path / "w.csv"))).items()}
    assert got["irradiance", "2024-01-01 00:00:00"] == pytest.approx(100.0) and got["temperature", "2024-01-01 00:00:00"] == 22.5
    assert got["irradiance", "2024-01-01 01:00:00"] is None and len(got) == 4


def test_quality_rules(spark):
    hours = [dt.datetime(2024, m, d, h) for m in (1, 2, 3) for d in range(1, 6) for h in range(24)]
    value = lambda t: max(0.0, 600 * (1 - abs(t.hour + 0.5 - 12) / 6))
    df = spark.createDataFrame([("good", t, value(t)) for t in hours] + [("late", t, value(t - dt.timedelta(hours=2))) for t in hours], "series_id string, ts_utc timestamp_ntz, value double")
    assert {r.series_id: r.aligned for r in quality.alignment(df, 0.0, 60).collect()} == {"good": True, "late": False}
    checked = quality.check_irradiance(spark.createDataFrame([("a", hours[0], 9.0), ("a", hours[12], 5000.0), ("a", hours[11], 300.0), ("a", hours[13], None)], "series_id string, ts_utc timestamp_ntz, value double"), 0.0, 0.0)
    assert [r.value for r in checked.orderBy("ts_utc").collect()] == [0.0, 300.0, None, None]
    peaks = spark.createDataFrame([("good", 1000.0), ("late", 1000.0)], "series_id string, kwp double")
    assert [r.series_id for r in quality.night_faulty(df, peaks, 0.0, 0.0).collect()] == ["late"]
    twice = df.filter("series_id = 'good'").limit(2)
    assert tuple(quality.duplicate_census(twice.unionByName(twice)).first()) == (4, 4)
    assert quality.completeness(df, 0.9).count() == 2
