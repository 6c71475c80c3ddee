import datetime as dt
import json
import math
import random
import uuid
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import allocation
from gridloom.operators import study_series as S
from gridloom.serving import marts, results
from gridloom.sources import layers
from gridloom.sources.datasets import DatasetError

NORTH, SOUTH = S.Site(52.0, 5.0, 1.0, "Europe/Amsterdam"), S.Site(-30.0, -51.0, -3.0)


def frame(spark, df, schema):
    return spark.createDataFrame([tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df], schema)


def homes(spark, start="2019-01-01", days=380, n=2, seed=5):
    """Hourly loads with holes, and what they sum to by hand."""
    chance = random.Random(seed)
    at = pd.date_range(start, periods=days * 24, freq="h")
    rows = [(f"h{k}", t.to_pydatetime(), 1 + k + math.sin(t.hour / 24 * 2 * math.pi) + t.dayofyear / 300 + t.weekday() / 7) for k in range(n) for t in at]
    rows = [(a, t, float("nan") if chance.random() < 0.01 else v) for a, t, v in rows]
    return frame(spark, rows, "series_id string, ts_utc timestamp_ntz, value double"), pd.DataFrame(rows, columns=["id", "ts", "value"])


def sunny(spark, start="2019-01-01", days=380):
    at = pd.date_range(start, periods=days * 48, freq="30min")
    rows = [(k, t.to_pydatetime(), max(0.0, math.sin((t.hour + t.minute / 60 - 6) / 12 * math.pi)) * (0.4 + 0.1 * k) * (1 if t.day % 9 else 1.5)) for k in range(2) for t in at]
    rows = [(f"p{k}", t, v) for k, t, v in rows]
    return frame(spark, rows, "series_id string, ts_utc timestamp_ntz, value double"), pd.DataFrame(rows, columns=["id", "ts", "value"])


def test_built_series_against_pandas(spark):
    load_rows, load_pd = homes(spark)
    pv_rows, pv_pd = sunny(spark)
    kwp = spark.createDataFrame([("p0", 3.0), ("p1", 5.0)], "series_id string, kwp double")
    load, pv = S.Source("homes", load_rows, 3600, "load", NORTH), S.Source("fleet", pv_rows, 1800, "pv", NORTH, kwp)
    made, manifest = S.build_series(load, pv, SOUTH, "2024-03-05", 10, steps_per_day=48, peak_load_mult=0.8)
    got = made.orderBy("step").toPandas()

    total = load_pd.groupby("ts").value.mean() * 2
    total = total.reindex(pd.date_range(total.index[0], total.index[-1], freq="h"))
    half = total.reindex(pd.date_range(total.index[0], total.index[-1] + pd.Timedelta("30min"), freq="30min"), method="ffill", limit=1)
    wall = half.copy()
    wall.index = half.index.tz_localize("UTC").tz_convert("Europe/Amsterdam").tz_localize(None)
    wall = wall.groupby(level=0).mean()
    begin = pd.Timestamp(manifest["load.window"][0])
    want = dt.date(2024, 3, 5) - dt.timedelta(182)
    assert abs((begin.date().replace(year=want.year) - want).days) <= 3 and begin.weekday() == dt.date(2024, 3, 5).weekday()
    part = wall.reindex(pd.date_range(begin, periods=480, freq="30min"))
    for t in part.index[part.isna()]:
        near = wall[(abs(wall.index.normalize() - t.normalize()) <= pd.Timedelta("7D")) & (wall.index.time == t.time())]
        part[t] = near.median()
    assert np.allclose(got.load_mult, part.to_numpy() / wall.max() * 0.8, atol=1e-9)

    mean = (pv_pd[pv_pd.id == "p0"].set_index("ts").value * 3 + pv_pd[pv_pd.id == "p1"].set_index("ts").value * 5) / 8
    mean.index = mean.index + pd.Timedelta("1h")
    p0 = pd.Timestamp(manifest["pv.window"][0])
    want_pv = mean.reindex(pd.date_range(p0, periods=480, freq="30min")).clip(0, 1)
    assert np.allclose(got.pv_mult, want_pv.where(want_pv >= 1e-4, 0.0).to_numpy(), atol=1e-9)
    assert list(got.local_time) == list(pd.date_range("2024-03-05", periods=480, freq="30min"))
    assert manifest["load.clock"] == "wall" and manifest["load.shift_days"] == 182
    assert len(manifest["warnings"]) == 2  # far away, and with its own standard time
    found = manifest["diagnostics"]
    day = got.pv_mult > 0
    assert found["daylight_steps"] == day.sum() and found["corr_load_pv_daylight"] == pytest.approx(np.corrcoef(got.load_mult[day], got.pv_mult[day])[0, 1])
    assert found["load_mean_peak_hour"] == got.groupby(got.local_time.dt.hour).load_mult.mean().idxmax()

    path = f"/tmp/series-{uuid.uuid4().hex}"
    S.save_series(made, manifest, path)
    again, read = S.load_series(spark, path)
    assert read == json.loads(json.dumps(manifest)) and again.count() == 480
    bad = f"/tmp/series-{uuid.uuid4().hex}"
    S.save_series(made.withColumn("pv_mult", F.when(F.col("step") == 7, F.col("pv_mult") + 1e-12).otherwise(F.col("pv_mult"))), manifest, bad)
    with pytest.raises(S.SeriesError, match="values"):
        S.load_series(spark, bad)
    worse = f"/tmp/series-{uuid.uuid4().hex}"
    S.save_series(made, manifest | {"days": 11}, worse)
    with pytest.raises(S.SeriesError, match="manifest"):
        S.load_series(spark, worse)


def test_clock_averages_the_repeated_hour_and_fills_the_skipped_one_only(spark):
    at = pd.date_range("2021-03-27 23:00", periods=6, freq="h")
    spring = S.to_clock(frame(spark, [(t.to_pydatetime(), v) for t, v in zip(at, [1.0, 2.0, 4.0, float("nan"), 6.0, 7.0], strict=True)], "ts timestamp_ntz, value double"), 3600, "Europe/Amsterdam")
    got = {r.ts: r.value for r in spring.collect()}
    assert len(got) == 24 and got[dt.datetime(2021, 3, 28, 1)] == 2.0 and got[dt.datetime(2021, 3, 28, 2)] == pytest.approx(3.0)
    assert got[dt.datetime(2021, 3, 28, 3)] == 4.0 and got[dt.datetime(2021, 3, 28, 4)] is None and got[dt.datetime(2021, 3, 28, 20)] is None
    at = pd.date_range("2021-10-30 23:00", periods=4, freq="h")
    autumn = S.to_clock(frame(spark, [(t.to_pydatetime(), float(k)) for k, t in enumerate(at)], "ts timestamp_ntz, value double"), 3600, "Europe/Amsterdam")
    assert {r.ts: r.value for r in autumn.collect()}[dt.datetime(2021, 10, 31, 2)] == 1.5
    none = frame(spark, [], "ts timestamp_ntz, value double")
    assert S.to_clock(none, 3600, "Europe/Amsterdam").count() == 0


def test_window_start():
    d = dt.date
    assert S.window_start(d(2018, 6, 1), d(2020, 5, 31), d(2024, 3, 1), 30) == d(2019, 3, 1)
    assert S.window_start(d(2019, 1, 1), d(2019, 12, 31), d(2024, 2, 29), 7) == d(2019, 2, 28)
    moved = S.window_start(d(2019, 1, 1), d(2019, 12, 31), d(2024, 5, 1), 7, weekday=True)
    assert moved.weekday() == d(2024, 5, 1).weekday() and abs((moved - d(2019, 5, 1)).days) <= 3
    # the nearest such day is before the first, so the one after is taken
    edge = S.window_start(d(2019, 5, 1), d(2019, 12, 31), d(2022, 5, 1), 7, weekday=True)
    assert edge == d(2019, 5, 5)
    assert S.window_start(d(2019, 1, 1), d(2019, 1, 31), d(2024, 5, 1), 31, pinned=d(2019, 1, 1)) == d(2019, 1, 1)
    for wrong in ({"pinned": d(2019, 1, 2)}, {}):
        with pytest.raises(S.SeriesError):
            S.window_start(d(2019, 1, 1), d(2019, 1, 31), d(2024, 5, 1), 31, **wrong)
    assert (S.season_shift(NORTH, SOUTH), S.season_shift(NORTH, NORTH), S.season_shift(None, SOUTH), S.season_shift(NORTH, SOUTH, 3)) == (182, 0, 0, 3)


def test_wrong_requests_fail(spark):
    rows, _ = homes(spark, days=20, n=2)
    load = S.Source("homes", rows, 3600)
    with pytest.raises(S.SeriesError, match="n_series"):
        S.load_total(load, 3)
    assert S.load_total(load, 1)[1] == 1
    with pytest.raises(S.SeriesError, match="not PV"):
        S.pv_mean(load)
    with pytest.raises(S.SeriesError, match="multiples"):
        S.resample(S.load_total(load)[0], 3600, 5400)
    coarse = S.resample(S.load_total(load)[0], 3600, 7200)
    assert coarse.count() == 240
    light = spark.createDataFrame([("irradiance", dt.datetime(2020, 1, 1), 500.0), ("temperature", dt.datetime(2020, 1, 1), 30.0), ("irradiance", dt.datetime(2020, 1, 1, 1), 500.0), ("temperature", dt.datetime(2020, 1, 1, 2), 9.0)], "kind string, ts_utc timestamp_ntz, value double")
    got = {r.ts.hour: r.value for r in S.pv_mean(S.Source("sky", light, 3600, "irradiance")).collect()}
    one = lambda air: 0.5 * (1 - 0.0037 * (air + 25 / 800 * 500 - 25)) * 0.86
    assert got[0] == pytest.approx(one(30)) and got[1] == pytest.approx(one(20)) and got[2] is None


def test_envelope_store_and_compare(spark):
    rows = [("n1", "qsts", "r1", 1.25, True, None, True, 40), ("n1", "qsts", "r2", float("inf"), False, None, True, 40), ("n1", "stochastic", "r3", 2.0, True, "no convergence", True, 40), ("n2", "qsts", "r4", 2.0, True, None, False, 40), ("n2", "qsts", "r5", 2.0, True, None, None, 0)]
    df = spark.createDataFrame(rows, "network string, method string, run_id string, lambda_max double, bounded boolean, error string, baseline_ok boolean, daylight_steps long").withColumns({"run_timestamp": F.lit("2024-01-01").cast("timestamp_ntz"), "existing_pv": F.lit("keep")})
    path = f"/tmp/results-{uuid.uuid4().hex}"
    made = results.envelope(df, ["lambda_max", "bounded"], ["existing_pv"])
    results.write_results(made.filter("network = 'n1'"), path)
    results.write_results(made.filter("network = 'n2'"), path)
    back = spark.read.parquet(path)
    staged = {r.run_id: r for r in marts.stage_results(back).collect()}
    assert {k: r.status for k, r in staged.items()} == {"r1": "ok", "r2": "ok", "r3": "error", "r4": "baseline_infeasible", "r5": "no_daylight"}
    assert [k for k, r in sorted(staged.items()) if r.is_comparable] == ["r1"] and staged["r2"].lambda_max is None and staged["r1"].existing_pv == "keep"
    assert staged["r3"].error == "no convergence" and staged["r3"].lambda_max is None

    cells = spark.createDataFrame([("c1", 0, "n1", "s.parquet", None, None, None, 15, None, 2.0), ("c2", 3, "n2", None, "2020-01-01", 7, True, None, "keep", 1.0), ("c3", 0, "n2", None, "2020-01-01", 7, True, None, "keep", 1.0)], "cell string, returncode int, network string, qsts_series string, qsts_start string, qsts_days int, qsts_network_profiles boolean, block_average_min int, existing_pv string, seconds double")
    found = made.filter("run_id in ('r1', 'r4')").withColumn("cell", F.when(F.col("run_id") == "r1", "c1").otherwise("c3"))
    flat = {r.cell: r for r in results.flatten(cells, found).collect()}
    assert (flat["c1"].series_key, flat["c1"].lambda_max, flat["c1"].existing_pv) == ("s.parquet", 1.25, "remove")
    assert (flat["c2"].method, flat["c2"].status, flat["c2"].series_key) == ("-", "rc=3", None)
    assert (flat["c3"].status, flat["c3"].series_key) == ("baseline_infeasible", "n2|profiles:2020-01-01+7d")

    schema = "run string, status string, bounded boolean, lambda_max double"
    a = spark.createDataFrame([("same", "ok", True, 1.0), ("far", "ok", True, 1.0), ("censored", "ok", False, 1.0), ("turned", "ok", True, 1.0), ("none", "error", None, None), ("half", "ok", True, 1.0), ("left", "ok", True, 1.0)], schema)
    b = spark.createDataFrame([("same", "ok", True, 1.01), ("far", "ok", True, 1.02), ("censored", "ok", False, 9.0), ("turned", "ok", False, 1.0), ("none", "error", False, None), ("half", "ok", True, None), ("right", "ok", True, 1.0)], schema)
    c = results.compare_runs(a, b, ["run"], 0.01)
    assert {r.run: r.verdict for r in c.collect()} == {"same": "ok", "far": "different", "censored": "ok", "turned": "different", "none": "ok", "half": "different", "left": "only_a", "right": "only_b"}
    assert results.exit_status(c) == 1 and results.exit_status(c.filter("run = 'same'")) == 0


def test_layers_archives_seeds_and_criteria(spark, tmp_path):
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg" / "things.CSV").write_text("﻿cod;Name ;Shape\n 1;a,b ;x\n2;;y\n", encoding="utf-8")
    spark.createDataFrame([(1, 2.5)], "k int, v double").toPandas().to_parquet(tmp_path / "reg" / "Other.parquet")
    need = {"Things": ["COD", "NAME"], "other": ["K"], "third": ["X"]}
    report = {r.layer: r for r in layers.inspect(spark, str(tmp_path / "reg"), need, ["fourth"]).collect()}
    assert report["Things"].n_rows == 2 and report["Things"].lacking == [] and report["third"].path is None and not report["third"].ready and not report["fourth"].needed and report["fourth"].ready
    with pytest.raises(DatasetError, match="third is not there"):
        layers.read_layers(spark, str(tmp_path / "reg"), need, [])
    with pytest.raises(DatasetError, match="lacks ZONE"):
        layers.read_layers(spark, str(tmp_path / "reg"), {"things": ["ZONE"]}, [])
    got = layers.read_layers(spark, str(tmp_path / "reg"), {"things": ["cod"]}, ["other", "fourth"])
    assert got["things"].columns == ["COD", "NAME", "SHAPE"] and sorted(map(tuple, got["things"].collect())) == [("1", "a,b", "x"), ("2", "", "y")]
    assert got["other"].collect()[0].V == "2.5"

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.csv", "p\r\nq\n" + "r\n" * 10_001)
        z.writestr("two.CSV", "s")
        z.writestr("note.txt", "t")
    lines = layers.archive_lines(spark, str(tmp_path / "a.zip"))
    assert lines.count() == 10_004
    assert [(r.member, r.line) for r in lines.filter("line_no < 2").orderBy("member", "line_no").collect()] == [("two.CSV", "s"), ("x/one.csv", "p"), ("x/one.csv", "q")]
    assert layers.archive_lines(spark, str(tmp_path / "a.zip"), "two").count() == 1

    (tmp_path / "limits.csv").write_text("network,v_min_pu,v_max_pu\nn1,0.9,1.1\nn2,0.95,1.05\n")
    assert layers.read_limits(spark, str(tmp_path / "limits.csv")).count() == 2
    (tmp_path / "wrong.csv").write_text("network,v_min_pu,v_max_pu\nn1,0.9,1.1\nn1,0.95,1.05\n")
    with pytest.raises(DatasetError):
        layers.read_limits(spark, str(tmp_path / "wrong.csv"))
    layers.write_scope(spark.createDataFrame([("b", 2), ("a", 10), ("a", 9), ("a", 9)], "network string, bus_id int"), str(tmp_path / "scope"))
    assert spark.read.text(str(tmp_path / "scope")).count() >= 4
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "scope"), header=True, schema="network string, bus_id int").collect())) == [("a", 9), ("a", 10), ("b", 2)]

    bands = dict(zip(("adequate_lo_pu", "adequate_hi_pu", "critical_lo_pu", "critical_hi_pu", "upper_precarious_max", "upper_critical_max", "lower_precarious_max", "lower_critical_max"), (0.9, 1.1, 0.85, 1.2, 0.03, 0.01, 0.04, 0.02), strict=True))
    for name, found in (("one.json", {"name": "x", **bands}), ("same.json", [{"name": "x", **bands}, {"name": "y", **bands, "window_days": 1}]), ("other.json", {"name": "x", **bands, "thermal_max": 0.5}), ("odd.json", {"name": "z", **bands, "colour": 1})):
        (tmp_path / name).write_text(json.dumps(found, indent=1))
    known = layers.load_criteria(spark, str(tmp_path / "one.json"))
    assert known["x"].allowances() == {"precarious": 0.03, "critical": 0.01, "thermal": 0.0}
    assert sorted(layers.load_criteria(spark, str(tmp_path / "same.json"), known)) == ["x", "y"]
    for name, why in (("other.json", "other numbers"), ("odd.json", "colour")):
        with pytest.raises(DatasetError, match=why):
            layers.load_criteria(spark, str(tmp_path / name), known)


def test_allocation(spark):
    loads = spark.createDataFrame([("n", 1, 10, 2.0, 1.0), ("n", 2, 10, 3.0, 1.0), ("n", 3, 11, 0.5, 0.1)], "network string, load_id int, bus_id int, p_mw double, q_mvar double")
    basis = allocation.proportional_to_load(loads)
    scales = spark.createDataFrame([("n", 0.5, 0.8), ("n", 2.0, 1.0)], "network string, lambda double, pv_mult double")
    assert {(r.bus_id, r["lambda"]): r.p_mw for r in allocation.pv_at(basis, scales).collect()} == pytest.approx({(10, 0.5): 2.0, (10, 2.0): 10.0, (11, 0.5): 0.2, (11, 2.0): 1.0})
    assert allocation.scale_loads(loads, 2.0).agg(F.sum("p_mw"), F.sum("q_mvar")).first() == (11.0, 4.2)
    with pytest.raises(ValueError):
        allocation.scale_loads(loads, 0)
    m = spark.createDataFrame([("n", 1, 0.0), ("n", 2, 2.0), ("n", 3, 1.0)], "network string, load_id int, mult double")
    assert allocation.multiply_loads(loads, m).agg(F.sum("p_mw")).first()[0] == 6.5
    with pytest.raises(Exception, match="load 3"):
        allocation.multiply_loads(loads, m.filter("load_id < 3")).collect()
