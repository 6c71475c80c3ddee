"""Assertions with a fault each, the contract, cells still to run, derived protocols, the quality gate."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridloom.operators import hosting, quality_gate, quantiles, studies, violations
from gridloom.operators.study_series import SeriesError, Site, Source, build_series
from gridloom.serving import assertions, contract, experiments

T = dt.datetime(2024, 1, 1)
RESULTS = (
    "method string, status string, is_comparable boolean, lambda_max double, lambda_fail double, criterion_framework string, total_pv_mw_comparable double, total_pv_mw_reported double, "
    "hc_alpha double, load_scale double, hc_lambda_ci_low double, hc_lambda_ci_high double"
)
GOOD = {
    "results": [("deterministic", "ok", True, 1.0, 2.0, "f", 1.0, 1.0, None, 0.25, None, None), ("stochastic", "ok", True, 1.0, None, "f", 1.0, 1.0, 0.1, None, 0.5, 1.5), ("qsts", "ok", True, 1.0, 2.0, "f", 1.0, 1.0, None, None, None, None),
                ("stochastic", "ok", False, 1.0, None, "f", None, 1.0, 0.1, None, None, None), ("qsts", "baseline_infeasible", False, None, None, "f", None, None, None, None, None, None)],
    "voltage": [("case14", 3, T, 1.0, True, False, 0.9), ("case14", 0, T, 1.0, False, False, 0.9), ("b", 1, T, 1.0, True, False, 0.9)],
    "lines": [(0.0,)], "summary": [(5.0, 7.0, -2.0)], "limits": [("case14",), ("b",)], "scope": [("case14", 3), ("b", 1)],
}
SCHEMAS = {
    "results": RESULTS, "voltage": "network string, bus_id long, event_timestamp timestamp, voltage_pu double, in_scope boolean, is_violation boolean, v_min_pu double", "lines": "loading_percent double",
    "summary": "total_generation_mw double, total_load_mw double, power_balance_mw double", "limits": "network string", "scope": "network string, bus_id long",
}
FAULTS = {
    "bracket_is_ordered": ("results", ("qsts", "ok", True, 2.0, 2.0, "f", 1.0, 1.0, None, None, None, None)), "comparable_rows_are_complete": ("results", ("qsts", "ok", True, 1.0, 2.0, None, 1.0, 1.0, None, None, None, None)),
    "capacity_is_not_negative": ("results", ("qsts", "ok", False, 1.0, 2.0, "f", None, -1.0, None, None, None, None)), "stochastic_rows_have_interval": ("results", ("stochastic", "ok", True, 1.0, None, "f", 1.0, 1.0, 0.1, None, 0.5, None)),
    "methods_are_known": ("results", ("guess", "ok", False, 1.0, 2.0, "f", 1.0, 1.0, None, None, None, None)), "statuses_are_known": ("results", ("qsts", "lost", False, 1.0, 2.0, "f", 1.0, 1.0, None, None, None, None)),
    "loading_is_not_negative": ("lines", (-0.1,)), "power_balance_reconciles": ("summary", (5.0, 7.0, -2.01)), "out_of_scope_never_violates": ("voltage", ("b", 1, T, 1.0, False, True, 0.9)),
    "voltage_is_physical": ("voltage", ("b", 1, T, 1.21, True, False, 0.9)), "keys_are_not_null": ("voltage", ("b", None, T, 1.0, True, False, 0.9)),
    "networks_have_limits": ("limits", None), "networks_have_scope": ("scope", None), "scope_keys_are_unique": ("scope", ("b", 1)), "limits_are_unique": ("limits", ("b",)),
}


def tables(spark, fault=None):
    made = {}
    for name, rows in GOOD.items():
        some = list(rows)
        if fault and FAULTS[fault][0] == name:
            some = some[:-1] if FAULTS[fault][1] is None else [*some, FAULTS[fault][1]]
        made[name] = spark.createDataFrame(some, SCHEMAS[name])
    return made


def test_assertions_find_their_faults_and_no_others(spark):
    assert {r.n for r in assertions.counts(tables(spark)).collect()} == {0} and len(FAULTS) == 15
    for fault in FAULTS:
        assert {r.name: r.n for r in assertions.counts(tables(spark, fault)).filter("n > 0").collect()} == {fault: 1}


def test_contract(spark, tmp_path):
    def found(**changed):
        some, watched = tables(spark) | changed, contract.Contract()
        jobs = {"bronze": some["lines"], "results": some["results"], "voltage": some["voltage"], "daily": some["summary"]} | {k: v for k, v in changed.items() if k in ("bronze", "daily")}
        for name, table in jobs.items():
            watched.watch(name, table).write.mode("overwrite").format("noop").save()
        return {name for name, (holds, _) in watched.checks().items() if not holds}

    good = tables(spark)
    assert found() == set()
    assert found(bronze=good["lines"].limit(0)) == {"telemetry is landed"} and found(daily=good["summary"].limit(0)) == {"daily figures are there"}
    assert found(results=good["results"].filter("method <> 'qsts' or status <> 'ok'")) == {"every method has a comparable row"}
    assert found(results=good["results"].withColumn("total_pv_mw_comparable", F.lit(1.0))) == {"an infeasible baseline is recorded and never a capacity"}
    assert found(results=good["results"].filter("status <> 'baseline_infeasible'")) == {"an infeasible baseline is recorded and never a capacity"}
    assert found(results=good["results"].withColumn("total_pv_mw_comparable", F.when(F.col("is_comparable"), float("inf")))) == {"comparable capacities are positive and finite"}
    assert found(results=good["results"].withColumn("hc_lambda_ci_low", F.lit(None).cast("double"))) == {"stochastic rows are comparable only with an interval"}
    assert found(voltage=good["voltage"].filter("network = 'b'")) == {"every simulated network has voltages"}
    assert found(voltage=good["voltage"].withColumn("v_min_pu", F.lit(None).cast("double"))) == {"every voltage has limits"}
    assert found(voltage=good["voltage"].withColumn("is_violation", F.col("bus_id") == 0)) == {"held buses are out of scope and never flagged"}
    with pytest.raises(ValueError, match="not watched"):
        contract.Contract().checks()


def test_cells(spark):
    spec = {"b": [1, {"y": 2.0, "x": None}], "a": "é"}
    turned = '{"a": "é",   "b": [1, {"x": null, "y": 2.0}]}'
    other = json.dumps(spec | {"b": [1, {"y": 3.0, "x": None}]})
    cells = spark.createDataFrame([(i, json.dumps(spec)) for i in ("new", "done", "failed", "changed", "again", "broken")], "id string, spec string")
    runs = [("done", turned, 0, "1"), ("failed", turned, 1, "1"), ("changed", other, 0, "1"), ("again", turned, 1, "1"), ("again", turned, 0, "2"), ("broken", "{", 0, "1"), ("gone", turned, 0, "1")]
    manifests = spark.createDataFrame(runs, "id string, cell string, returncode int, started string")
    states = {r.id: (r.state, r.clean) for r in experiments.cell_states(cells, manifests).collect()}
    assert states == {"new": ("new", False), "done": ("done", False), "failed": ("failed", True), "changed": ("changed", True), "again": ("done", False), "broken": ("changed", True)}
    # a changed argument runs one cell again
    moved = cells.withColumn("spec", F.when(F.col("id") == "done", other).otherwise(F.col("spec")))
    assert {r.id for r in experiments.pending(moved, manifests).collect()} == {"new", "failed", "changed", "broken", "done"}
    with pytest.raises(Exception, match="no specification: cell x"):
        experiments.cell_states(spark.createDataFrame([("x", "{")], "id string, spec string"), manifests).collect()


def test_derived_protocol(spark):
    runs = [
        ("a", ["--methods", "qsts", "--qsts-criterion", "m8"], 90), ("b", ["--qsts-criterion", "m8", "-v"], 90), ("c", ["--methods", "deterministic", "stochastic", "--qsts-criterion", "m8"], 90),
        ("d", ["--qsts-criterion", "zero_tolerance", "--methods", "qsts"], 90), ("e", [], 90), ("f", ["--methods", "qsts", "--qsts-criterion", "m8"], 3), ("g", ["--qsts-criterion"], 9), ("h", ["-v", "--qsts-criterion", "m8", "--methods", "qsts"], 50),
    ]
    df = spark.createDataFrame([("p", *r) for r in runs], "protocol string, run string, args array<string>, estimate_min long")
    got = {r.run: r for r in experiments.derived_protocol(df, "cpu").collect()}
    more = ["--qsts-backend", "torch", "--device", "cpu"]
    faster = {"a": 4, "b": 90, "f": 1, "h": 2}  # only runs that do nothing else get a new estimate; halves go to the even number
    for run, args, minutes in runs:
        assert (got[run].args, got[run].backend, got[run].estimate_min) == ((args + more, "torch", faster[run]) if run in faster else (args, "pandapower", minutes))
    assert len({r.source_digest for r in got.values()}) == 1
    other = experiments.derived_protocol(df.withColumn("estimate_min", F.col("estimate_min") + 1), "cpu").first().source_digest
    assert other != got["a"].source_digest


def series_rows(spark, rows):
    return spark.createDataFrame(rows, "series_id string, ts_utc timestamp_ntz, value double, kind string")


def test_quality_gate(spark):
    at = lambda h: T + dt.timedelta(hours=h)
    rows = [("good", at(h), float(1 + h % 5), "load") for h in range(48)]
    rows += [("holes", at(h), None if h == 7 else 1.0 + h, "load") for h in range(48) if h != 9]
    rows += [("none", at(h), None, "load") for h in range(5)] + [("twice", at(1), 1.0, "load"), ("twice", at(1), 1.0, "load"), ("twice", at(2), 1.0, "load"), ("twice", at(2), 2.0, "load")]
    rows += [("low", at(0), -1.0, "load"), ("low", at(1), 2.0, "load")] + [("flat", at(h), 3.0 if h < 20 else float(h), "load") for h in range(30)] + [("flat", at(h), 0.0, "load") for h in range(30, 60)]
    issues = quality_gate.basic(series_rows(spark, rows), 3600)
    found = {(r.series_id, r.code): r.n for r in issues.collect()}
    assert found == {("holes", "gaps"): 2, ("none", "gaps"): 5, ("none", "no_values"): 1, ("twice", "repeated_stamps"): 2, ("twice", "conflicting_stamps"): 1, ("low", "negative"): 1, ("flat", "flat"): 20}
    with pytest.raises(quality_gate.QualityError, match="homes: conflicting_stamps in 1 series; no_values in 1 series"):
        quality_gate.passed(issues, "homes")
    assert {r["code"] for r in quality_gate.passed(issues, "homes", ("no_values", "conflicting_stamps"))} == {c for _, c in found}
    assert {r.series_id for r in quality_gate.good_series(series_rows(spark, rows), issues, ("no_values",)).select("series_id").distinct().collect()} == {"good", "holes", "none", "low", "flat"}


def test_quality_rules_of_the_sun(spark):
    hours = [dt.datetime(2024, m, d, h) for m in (1, 2, 3) for d in range(1, 6) for h in range(24)]
    value = lambda t: max(0.0, 600 * (1 - abs(t.hour + 0.5 - 12) / 6))
    rows = [("good", t, value(t)) for t in hours] + [("late", t, value(t - dt.timedelta(hours=2))) for t in hours] + [("wild", t, 9000.0 if t.hour == 12 else value(t)) for t in hours]
    df = spark.createDataFrame(rows, "series_id string, ts_utc timestamp_ntz, value double")
    found = {(r.series_id, r.code): r.n for r in quality_gate.irradiance(df, 0.0, 0.0, 60).filter("code <> 'rare'").collect()}
    assert found["wild", "impossible"] == 15 and found["late", "misaligned"] == 1 and not [k for k in found if k[0] == "good"]
    peaks = spark.createDataFrame([("good", 1000.0), ("late", 1000.0)], "series_id string, kwp double")
    assert [(r.series_id, r.severity) for r in quality_gate.fleet(df, peaks, 0.0, 0.0, 60).collect()] == [("late", "error")]


def test_a_study_refuses_faulty_sources(spark):
    hours = [dt.datetime(2023, 6, 1) + dt.timedelta(hours=h) for h in range(24 * 20)]
    load = series_rows(spark, [(f"h{k}", t, 1.0 + (t.hour + k) % 7, "load") for k in range(2) for t in hours] + [("h0", hours[0], 99.0, "load")])
    sun = series_rows(spark, [("pv", t, max(0.0, 1 - abs(t.hour - 12) / 6), "pv") for t in hours])
    site = Site(52.0, 5.0, 0.0)
    source = lambda **more: Source("homes", load, 3600, issues=quality_gate.basic(load, 3600), **more)
    pv = Source("sun", sun, 3600, "pv", issues=quality_gate.basic(sun, 3600))
    with pytest.raises(SeriesError, match="homes: conflicting_stamps in 1 series"):
        build_series(source(), pv, site, "2024-06-05", 3, 24)
    made, manifest = build_series(source(allow=("conflicting_stamps",)), pv, site, "2024-06-05", 3, 24)
    assert made.count() == 72 and {r["code"] for r in manifest["load.issues"]} == {"conflicting_stamps", "repeated_stamps"} and manifest["pv.issues"] == []
    assert any("conflicting_stamps" in w for w in manifest["warnings"])


def test_quantiles_of_skewed_groups_and_null_keys(spark):
    inf = float("inf")
    rows = [(None, "x", float(v)) for v in range(1, 200)] + [(1, None, v) for v in (1e-9, 2e-9, 3e-9, 1e12, inf)] + [(2, "y", v * 1e-6) for v in range(5000)] + [(2, "y", 1e15), (2, "y", -inf)] + [(3, "z", None)] + [(4, "w", 5.0)] * 300
    df = spark.createDataFrame(rows, "a int, b string, v double").repartition(3)
    one = {(r.a, r.b): (r.q, r.top) for r in quantiles.null_safe_join(quantiles.quantile_type1(df, ["a", "b"], "v", 0.5, "q"), quantiles.quantile_type1(df, ["a", "b"], "v", 1.0, "top"), ["a", "b"]).collect()}
    assert one == {(None, "x"): (100.0, 199.0), (1, None): (3e-9, inf), (2, "y"): (2499 * 1e-6, 1e15), (3, "z"): (None, None), (4, "w"): (5.0, 5.0)}
    ends = {r.a: (r.n, r.lo, r.hi) for r in quantiles.quantile_interval(df, ["a"], "v", 0.1, 0.95).collect()}
    low, high = quantiles.confidence_ranks(199, 0.1, 0.95)
    assert ends[None] == (199, float(low), float(high)) and ends[3] == (0, None, None)
    found = df.selectExpr("a", "v as lambda_max", "true as bounded")
    assert {r.a for r in studies.stochastic(found, ["a"]).collect()} == {None, 1, 2, 3, 4}


def test_binding_labels(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("p", "bus", 1, 1.15, 1.0), ("p", "line", 4, 120.14, 1.0), ("p", "trafo", 0, 90.0, -0.5), ("p", "bus", 2, 0.80, 1.0), ("q", "line", 9, 130.0, 1.0), ("q", "line", 2, 130.0, 1.0), ("q", "trafo", 1, 104.0, 1.0), ("q", "bus", 3, 1.0, 1.0),
        ("r", "bus", 8, nan, 1.0), ("r", "bus", 7, inf, 1.0), ("r", "line", 1, 900.0, 1.0), ("s", "line", 1, inf, 1.0), ("s", "bus", 1, 1.0, 1.0), ("t", "bus", 1, 0.5, 1.0),
    ]
    df = spark.createDataFrame(rows, "k string, element string, element_id long, value double, power double").withColumns({"lo": F.lit(0.9), "hi": F.lit(1.1), "converged": F.col("k") != "t"})
    got = {r.k: (r.binding, r.n_violations, r.n_reverse) for r in violations.binding(df, ["k"], trafo_percent=80.0).collect()}
    assert got == {
        "p": ("line_loading@line_4 (120.1%)", 4, 1), "q": ("line_loading@line_2 (130.0%)", 3, 0),
        "r": ("isolated@bus_7 (not energized)", 3, 0), "s": (None, 0, 0), "t": ("power_flow_non_convergence", 1, 0),
    }
    words = spark.createDataFrame([("a", "bus 1", 1.3), ("a", "line 3", 1.3), ("a", "bus 0", 1.0), ("b", "x", None)], "k string, label string, v double").selectExpr("*", "0.9D as lo", "1.1D as hi")
    assert {r.k: r.label for r in violations.worst(words, ["k"], "label", "v", "lo", "hi").collect()} == {"a": "bus 1", "b": "x"}


def test_critical_point(spark):
    rows = [("a", i, load, pv) for i, (load, pv) in enumerate([(3.0, 0.0), (2.0, 0.95), (2.0, 1.0), (2.0, 1.0), (1.0, 0.5), (0.5, 0.45)])]
    df = spark.createDataFrame(rows, "k string, step int, load_mult double, pv_mult double")
    assert tuple(hosting.critical_point(df, ["k"]).first()) == ("a", 2, 2.0, 1.0)
    assert tuple(hosting.critical_point(df, ["k"], pv_fraction=0.4).first())[1] == 5
    assert tuple(hosting.critical_point(df, ["k"], "max_pv_to_load").first())[1] == 5
    for bad in ({"rule": "best"}, {"pv_fraction": 0.0}):
        with pytest.raises(ValueError):
            hosting.critical_point(df, ["k"], **bad)
    for rule in ("min_load_high_pv", "max_pv_to_load"):
        with pytest.raises(Exception, match="no PV output"):
            hosting.critical_point(df.withColumn("pv_mult", F.lit(0.0)), ["k"], rule).collect()


def test_staged_results_are_dealt_out_by_size(spark, monkeypatch):
    import glob
    import re

    from conftest import DATA

    from gridloom.plans import served

    monkeypatch.setattr(served, "_STAGED", {})
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = served.results(spark, DATA)
    finally:
        for k in small:
            spark.conf.unset(k)
    (path,) = served._STAGED.values()
    tasks = {re.search(r"part-(\d+)", f)[1] for f in glob.glob(path.removeprefix("file:") + "/*/*/part-*")}
    assert len(tasks) > 1 and rows.count() == spark.read.parquet(f"{DATA}/orders.parquet").count()


def test_small_and_large_groups_have_the_same_quantiles(spark):
    rows = [(k, float(v * 37 % 101)) for k in (None, 1, 2) for v in range(60 if k else 9)] + [(3, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    ranks = spark.createDataFrame([(k, n, r) for k in (None, 1, 2, 3) for n, r in (("a", 1), ("b", 9))], "k int, name string, rank long")
    want = {(k, n, sorted(v for j, v in rows if j == k)[r - 1]) for k in (None, 1, 2) for n, r in (("a", 1), ("b", 9))}
    for whole in (0, 10, 1000):
        assert {tuple(r) for r in quantiles.values_at(df, ["k"], "v", ranks, whole).collect()} == want
