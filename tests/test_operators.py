import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA

from gridloom.operators import aggregates, hosting, network, quantiles, relational, series, violations
from gridloom.serving import assertions
from gridloom.sources import bronze
from gridloom.streaming import marts


def brute_sweep(events, n, cap, allowed, priority):
    """The first threshold at which a kind has more events than its allowance; kinds in the order of ``priority``."""
    for theta in sorted({t for t, _ in events}):
        for kind in priority:
            count = lambda limit, kind=kind: sum(k == kind and t <= limit for t, k in events)
            if count(theta) > max(math.floor(allowed[kind] * n + 1e-9), count(0)):
                return theta, True, kind
    return cap, False, None


def test_weekly_sweep_against_brute_force(spark):
    allowed, priority, n, cap = {"precarious": 0.04, "critical": 0.01, "thermal": 0.0}, ["critical", "thermal", "precarious"], 500, 7.5
    chance = random.Random(11)
    weeks = {}
    for win in range(40):
        kinds = [chance.choice(["precarious"] * 6 + ["critical"] * 2 + ["thermal"] * (win % 2)) for _ in range(win * 2)]
        weeks[win] = [(max(0.0, chance.randint(-3, 12) / 4), k) for k in kinds]  # many ties, some at 0
    e = spark.createDataFrame([(w, *x) for w, some in weeks.items() for x in some], "win long, theta double, kind string")
    w = spark.createDataFrame([(k, n, cap) for k in weeks], "win long, n_readings long, cap double")
    got = {r.win: (r.capacity, r.bounded, r.binding) for r in hosting.weekly_sweep(e, w, allowed, priority).collect()}
    assert got == {k: brute_sweep(some, n, cap, allowed, priority) for k, some in weeks.items()}
    assert {x[2] for x in got.values()} == {"precarious", "critical", "thermal", None}


def test_confidence_ranks():
    def plain(n, q, confidence):
        below = [sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k + 1)) for k in range(n + 1)]
        low = [k + 1 for k in range(n + 1) if below[k] <= (1 - confidence) / 2]
        high = [k + 1 for k in range(n) if below[k] >= 1 - (1 - confidence) / 2]
        return max(low, default=None), min(high, default=None)

    for n in [*range(1, 90), 300]:
        for q, confidence in ((0.1, 0.95), (0.5, 0.9), (0.97, 0.99)):
            assert quantiles.confidence_ranks(n, q, confidence) == plain(n, q, confidence), (n, q)
    low, high = quantiles.confidence_ranks(10**9, 0.1, 0.95)
    assert 0 < 10**8 - low < 20_000 and 0 < high - 10**8 < 20_000  # 1.96 standard deviations of 9487


def test_order_statistics(spark):
    chance = random.Random(2)
    groups = {"one": [3.0], "ties": [1.0] * 50 + [2.0] * 51, "wide": [chance.lognormvariate(0, 9) for _ in range(700)], "none": [None, None]}
    df = spark.createDataFrame([(k, v) for k, some in groups.items() for v in some] + [("wide", None)], "k string, v double").repartition(5)
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], "v", {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()}
    for k in ("one", "ties", "wide"):
        assert [got[k].p0, got[k].p10, got[k].p50, got[k].p100] == pytest.approx(np.percentile(groups[k], [0, 10, 50, 100]).tolist())
    assert got["none"].p50 is None
    first = {r.k: r.q for r in quantiles.quantile_type1(df, ["k"], "v", 0.1, "q").collect()}
    assert first == {k: sorted(some)[max(0, math.ceil(0.1 * len(some)) - 1)] if k != "none" else None for k, some in groups.items()}
    ends = {r.k: (r.n, r.lo, r.hi) for r in quantiles.quantile_interval(df, ["k"], "v", 0.1, 0.95).collect()}
    low, high = quantiles.confidence_ranks(700, 0.1, 0.95)
    assert ends["wide"] == (700, sorted(groups["wide"])[low - 1], sorted(groups["wide"])[high - 1]) and ends["one"] == (1, None, None) and ends["none"][1:] == (None, None)


def test_daily_totals_are_unpivoted(spark):
    from gridloom.plans import catalogue

    made = catalogue.map_unpivot_explode(spark, DATA)
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert made.columns == ["user_id", "day", "event_type", "total"]
    assert made.count() == events.selectExpr("user_id", "date_trunc('day', ts)", "event_type").distinct().count()
    assert made.agg(F.sum("total")).first()[0] == pytest.approx(events.agg(F.sum("value")).first()[0], abs=0.1)


def test_blocks_hold_every_event(spark):
    from gridloom.plans import catalogue

    made = catalogue.block_average(spark, DATA)
    assert made.columns == ["event_type", "event_id", "value"] and made.count() == spark.read.parquet(f"{DATA}/events.parquet").count()
    keyed = [(k, i) for k in ("a", "b", None) for i in (*range(-7, 40, 3), 10**12)] + [("a", None)]
    df = spark.createDataFrame(keyed, "k string, i long").repartition(3)
    got = {(r.k, r.i): r.step for r in series.numbered(df, "k", "i", "step", 10).collect()}
    own = {k: sorted((i for j, i in keyed if j == k), key=lambda i: (i is None, i)) for k in ("a", "b", None)}
    assert got == {(k, i): n for k, ids in own.items() for n, i in enumerate(ids)}


def test_violations(spark):
    nan = float("nan")
    rows = [("bus", 1.2, "overvoltage"), ("bus", 0.8, "undervoltage"), ("bus", 1.0, None), ("bus", nan, "isolated"), ("line", 100.0, None), ("trafo", 100.5, "overload"), ("line", nan, None)]
    df = spark.createDataFrame([(e, v, 0.9, 1.1, want) for e, v, want in rows], "element string, value double, lo double, hi double, want string")
    assert violations.flags(df).filter("not (violation <=> want)").count() == 0
    top = violations.worst(spark.createDataFrame([("a", 1, 1.0), ("a", 2, nan), ("a", 3, 9.0), ("b", 1, 1.2), ("b", 2, 1.2)], "k string, i long, v double").selectExpr("*", "0.9D as lo", "1.1D as hi"), ["k"], "i", "v", "lo", "hi")
    assert {(r.k, r.i) for r in top.collect()} == {("a", 2), ("b", 1)}
    steps = spark.createDataFrame([(1, 1.03, 50.0, 0.0, True), (2, 1.06, 50.0, 0.0, True), (3, 1.0, 120.0, 130.0, True), (4, 1.0, 140.0, 130.0, True), (5, nan, nan, 0.0, False)], "step long, v_max double, loading double, base_loading double, converged boolean").withColumn("rating", F.lit(100.0))
    assert sorted((r.step, r.kind) for r in violations.classify(steps, 1.02, 1.05).collect()) == [(1, "precarious"), (2, "critical"), (4, "thermal"), (5, "critical"), (5, "precarious"), (5, "thermal")]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("a", 2, 5.0), ("a", 2, 5.0), ("b", 1, None), ("b", 1, 3.0), ("b", 2, None)], "k string, t long, v double")
    got = {(r.k, r.t): (r.v, r.n, r.conflict) for r in aggregates.collapse_repeats(df, ["k", "t"], "v").collect()}
    assert got == {("a", 1): (3.0, 2, True), ("a", 2): (5.0, 2, False), ("b", 1): (3.0, 2, True), ("b", 2): (None, 1, False)}
    assert {r.k: r.total for r in aggregates.complete_sum(df, ["k"], F.col("v")).collect()} == {"a": 16.0, "b": None}
    light = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, 3.0), ("a", 9.0, 0.0), ("b", 1.0, 1.0), ("b", 2.0, 5.0)], "k string, x double, y double")
    assert {r.k: r.r for r in aggregates.daylight_correlation(light, "k", "x", "y").collect()} == {"a": pytest.approx(1.0), "b": None}


def test_local_hours(spark):
    """New York 2024: the hour after 1:59 on 10 March is skipped, that from 1:00 on 3 November comes twice."""
    rows = [("s", f"2024-03-10 {h:02d}:00:00", float(h)) for h in (5, 6, 7, 8)] + [("f", f"2024-11-03 {h:02d}:00:00", float(h)) for h in (4, 5, 6, 7)]
    df = spark.createDataFrame(rows, "k string, t string, v double").selectExpr("k", "cast(t as timestamp_ntz) as t", "v")
    got = [(r.k, r.wall.hour, r.n, r.v) for r in aggregates.local_hours(df, "k", "t", "v", "America/New_York").orderBy("k", "wall").collect()]
    assert got == [("f", 0, 1, 4.0), ("f", 1, 2, 5.5), ("f", 2, 1, 7.0), ("s", 0, 1, 5.0), ("s", 1, 1, 6.0), ("s", 2, 0, 6.5), ("s", 3, 1, 7.0), ("s", 4, 1, 8.0)]


def test_series_subset_and_linear_upsampling(spark):
    df = spark.createDataFrame([("a", f"2024-01-01 {h:02d}:00:00", v) for h, v in ((0, 0.0), (1, 4.0), (2, 8.0), (4, 2.0))], "k string, t string, v double").selectExpr("k", "cast(t as timestamp_ntz) as t", "v")
    with pytest.raises(KeyError, match="z"):
        series.subset(df, "k", ["a", "z"])
    r = series.describe(series.subset(df, "k", ["a"]), "k", "t", 3600).first()
    assert (r.n_series, r.n_steps, str(r.start), str(r.end)) == (1, 4, "2024-01-01 00:00:00", "2024-01-01 05:00:00")
    got = [r.v for r in series.upsample_linear(df, "k", "t", "v", 3600, 4).orderBy("t").collect()]
    assert got == [0.0, 0.0, 0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.0, 8.0, 2.0, 2.0, 2.0, 2.0]  # by eighths to the midpoints; held at ends and gaps


def test_reachability_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1500)] + [(3000, 3001)], "a long, b long")
    got = {r.node for r in network.reachable(edges, spark.createDataFrame([(700,), (9000,)], "node long")).collect()}
    assert got == {*range(1501), 9000}


def test_within_spans(spark):
    points = spark.createDataFrame([(i,) for i in range(40)], "step long")
    spans = spark.createDataFrame([("a", 3, 20), ("b", 9, 1), ("c", 10, 0), ("d", 38, 9)], "name string, s long, n long")
    got = sorted((r.step, r.name) for r in relational.within_spans(points, spans, "step", "s", "n", 7).collect())
    assert got == sorted((i, n) for i in range(40) for n, s, k in (("a", 3, 20), ("b", 9, 1), ("d", 38, 9)) if s <= i < s + k)


def test_assertions_find_each_fault(spark):
    when = "timestamp_ntz'2024-01-01 00:00:00'"
    facts = spark.sql(f"""select * from values ('n', 1L, {when}, 1.0D, true, false), ('u', 1L, {when}, 0.7D, true, true), ('n', 2L, {when}, 1.0D, false, true), ('n', null, {when}, 1.0D, true, false)
        as t(network, bus_id, event_timestamp, voltage_pu, in_scope, is_violation)""")
    results = spark.sql("""select * from values
        (true, 'qsts', 'ok', 'f', 1.0D, 1.0D, 2.0D, 1.0D, null, null, null, null),
        (true, 'deterministic', 'ok', 'f', 1.0D, 1.0D, 1.0D, 2.0D, null, null, null, null),
        (true, 'stochastic', 'ok', 'f', 1.0D, 1.0D, 1.0D, null, 0.1D, null, 0.5D, null),
        (false, 'guess', 'ok', null, null, -1.0D, null, null, null, null, null, null),
        (false, 'qsts', 'odd', null, null, null, null, null, null, null, null, null)
        as t(is_comparable, method, status, criterion_framework, total_pv_mw_comparable, total_pv_mw_reported, lambda_max, lambda_fail, hc_alpha, load_scale, hc_lambda_ci_low, hc_lambda_ci_high)""")
    summary = spark.sql("select * from values (1.0D, 3.0D, 2.0D), (1.1D, 3.0D, 2.0D) as t(power_balance_mw, total_generation_mw, total_load_mw)")
    lines = spark.sql("select * from values (-1.0D), (5.0D) as t(loading_percent)")
    limits = spark.createDataFrame([("n",), ("n",)], "network string")
    scope = spark.createDataFrame([("n", 1), ("n", 1)], "network string, bus_id long")
    checks = assertions.assertions(summary, facts, lines, results, limits, scope)
    assert len(checks) == 15 and {name: rows.count() for name, rows in checks.items()} == dict.fromkeys(checks, 1)
    none = {name: rows for name, rows in assertions.assertions(summary.limit(0), facts.limit(0), lines.limit(0), results.limit(0), limits.limit(0), scope.limit(0)).items()}
    assert assertions.failures(none) == [] and len(assertions.failures(checks)) == 15


def test_reachability_handles_cycles_and_islands(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9), (4, 4)], "a long, b long")
    got = {r.node: r.depth for r in network.levels(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_series_gaps(spark):
    rows = [("a", f"2024-01-01 {h:02d}:00:00", float(h)) for h in (0, 1, 4, 8)]
    df = spark.createDataFrame(rows, "k string, t string, v double").selectExpr("k", "cast(t as timestamp_ntz) as t", "v")
    full = series.regularize(df, "k", "t", "v", 3600)
    assert full.count() == 9
    got = [(r.v, r.filled) for r in series.interpolate_short(full, "k", "t", "v", 2, 3600).orderBy("t").collect()]
    assert got == [(0, False), (1, False), (2, True), (3, True), (4, False), (None, False), (None, False), (None, False), (8, False)]


def test_insert_if_absent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "q"), (3, "p")], "k long, v string")
    assert sorted(map(tuple, relational.insert_if_absent(a, b, ["k"]).collect())) == [(1, "x"), (2, "y"), (3, "p")]


PAYLOADS = [
    {"timestamp": "2024-01-01T00:00:00Z", "step": 0, "network": "n", "bus_voltage_pu": {"1": 1.1, "2": 1.0}, "line_loading_percent": {"l": 100.0}, "gen_power_mw": {}, "total_load_mw": 2.0, "total_generation_mw": 3.0},
    {"timestamp": "2024-01-01T01:00:00Z", "step": 1, "network": "u", "bus_voltage_pu": {"1": 1.2}, "line_loading_percent": {"l": 101.0}, "active_contingencies": ["x"]},
]


def test_bronze_to_facts(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, PAYLOADS)) + "\nnot json\n")
    bronze.write_bronze(bronze.bronze_rows(bronze.jsonl_messages(spark, str(tmp_path / "in.jsonl"))), str(tmp_path / "lake"))
    stage = bronze.staged(bronze.read_bronze(spark, str(tmp_path / "lake")))
    assert stage.filter("is_corrupt").count() == 1
    for name in ("second.jsonl", "third.jsonl"):  # landed one after the other, and one of them twice
        (tmp_path / name).write_text("\n".join(json.dumps(PAYLOADS[0] | {"step": 10 + k + len(name)}) for k in range(3)))
        bronze.write_bronze(bronze.bronze_rows(bronze.jsonl_messages(spark, str(tmp_path / name))), str(tmp_path / "lake"))
    bronze.write_bronze(bronze.bronze_rows(bronze.jsonl_messages(spark, str(tmp_path / name))), str(tmp_path / "lake"))
    assert bronze.staged(bronze.read_bronze(spark, str(tmp_path / "lake"))).count() == 9
    limits = spark.createDataFrame([("n", 0.95, 1.05)], "network string, v_min_pu double, v_max_pu double")
    scope = spark.createDataFrame([("n", 1), ("u", 1)], "network string, bus_id int")
    facts = bronze.bus_voltage(stage, limits, scope)
    assert {(r.network, r.bus_id): r.is_violation for r in facts.collect()} == {("n", 1): True, ("n", 2): False, ("u", 1): None}
    assert {r.network: r.is_overloaded for r in bronze.line_loading(stage).collect()} == {"n": False, "u": True}
    assert bronze.generator_power(stage).count() == 0
    assert bronze.voltage_quality_hourly(facts).count() == 3


def test_stream_lands_once(spark, tmp_path):
    rows = [("t", b"1", b'{"a": 1}', 0, i // 2) for i in range(6)]
    df = spark.createDataFrame(rows, "topic string, key binary, value binary, partition int, offset bigint").selectExpr("*", "timestamp'2024-01-01 00:00:00' as timestamp")
    df.write.parquet(str(tmp_path / "src"))
    q = marts.land(marts.message_stream(spark, "parquet", path=str(tmp_path / "src")), str(tmp_path / "lake"), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    assert bronze.read_bronze(spark, str(tmp_path / "lake")).count() == 3


def test_runs_by_chunk_equal_runs(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), k, r.choice([1.0, 1.0, 1.0, 2.0, None])) for k in range(3000)] + [("c", k, 5.0) for k in range(200)] + [("d", 0, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    plain = {(x.k, x.t): x.run for x in series.runs(df, "k", ["t"], "v").collect()}
    for size in (1, 7, 100, 10_000):
        assert {(x.k, x.t): x.run for x in series.runs_by_chunk(df, "k", ["t"], "v", F.floor(F.col("t") / size)).collect()} == plain


def test_gaps_are_filled_alike_in_lots_of_any_size(spark):
    import datetime as dt

    r, at = random.Random(8), lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    rows = [(s, at(k), float(r.randint(0, 9))) for s in ("a", "b") for k in range(400) if r.random() < 0.6 or k in (0, 399)] + [("c", at(5), 1.0), ("c", at(5), 3.0), ("c", None, 1.0), ("d", at(0), None)]
    grid = series.regularize(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), "k", "ts", "v", 3600)
    got = {(x.k, x.ts): x.v for x in grid.collect()}
    assert len(got) == 802 and got["c", at(5)] == 2.0
    want = {}
    for s in "ab":
        known = [k for k in range(400) if got[s, at(k)] is not None]
        for a, b in zip(known, known[1:]):
            for k in range(a + 1, b):
                if b - a - 1 <= 2:
                    want[s, at(k)] = got[s, at(a)] + (got[s, at(b)] - got[s, at(a)]) * (k - a) / (b - a)
    for lot in (1, 2, 5, 50, 10_000):
        filled = series.interpolate_short(grid, "k", "ts", "v", 2, 3600, lot).collect()
        assert len(filled) == 802 and {(x.k, x.ts): x.v for x in filled if x.filled} == pytest.approx(want)
    long = series.regularize(spark.createDataFrame([("z", at(0), 1.0), ("z", at(25_000), 2.0)], "k string, ts timestamp_ntz, v double"), "k", "ts", "v", 3600)
    assert long.count() == 25_001 and long.filter("v is not null").count() == 2


def test_waves_reach_each_node_at_its_least_depth(spark):
    r = random.Random(12)
    pairs = [(k, k + 1) for k in range(30)] + [(r.randrange(31, 80), r.randrange(31, 80)) for _ in range(60)] + [(3, 40), (90, 91)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    depth, todo = {0: 0, 77: 0}, [0, 77]
    for n in todo:
        for m in near.get(n, ()):
            if m not in depth:
                depth[m] = depth[n] + 1
                todo.append(m)
    edges, roots = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(0,), (77,), (0,)], "node long")
    got = network.levels(edges, roots).collect()
    assert {x.node: x.depth for x in got} == depth and len(got) == len(depth)
