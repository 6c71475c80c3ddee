"""Feeder conversion and study summaries, on a feeder made for these tests; expected values are worked out by hand below."""

import math

import pytest

from gridloom.operators import feeder, studies


def table(spark, columns, text):
    """Rows of strings out of lines of words; ``-`` is an empty string."""
    rows = [["" if w == "-" else w for w in line.split()] for line in text.strip().splitlines()]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


SEGMENT = "COD_ID PAC_1 PAC_2 TIP_CND COMP UNI_TR_MT"

#: Ring n0-n1-n2, a branch n2-n3-n4 with a service drop to n5, a loop onto itself, an island z1-z2.
SEGMENTS = """
ring1 n0 n1 thick 120 mill
ring2 n1 n2 thick 45 mill
ring3 n2 n0 thin 200 mill
arm1 n2 n3 thin - mill
knot n3 n3 thick 3 mill
isle z1 z2 thick 10 mill
arm2 n3 n4 unheard 33 mill
lane k9 k8 thin 75 ford
"""

#: Customer, node, phases, transformer, curve, energy of each month.
CUSTOMERS = """
bakery n1 ABC mill week 620
flat n2 A mill week 180
garage n5 BC mill - 310
hut z2 C mill - 40
lost q B mill - 12
farm k8 - ford week 95
"""


@pytest.fixture(scope="module")
def layers(spark):
    people = [line.split() for line in CUSTOMERS.strip().splitlines()]
    monthly = "\n".join(" ".join([*p[:5], *[p[5] + ",0"] * 12]) for p in people)
    return {
        "transformers": table(spark, "COD_ID PAC_1 PAC_2 POT_NOM PER_FER PER_TOT", "mill g1 n0 112,5 410 1910\nford g2 k9 30 150 150"),
        "conductors": table(spark, "COD_ID R1 X1 CNOM", "thick 0,32 0,08 210\nthin 1.9 0.09 65"),
        "segments": table(spark, SEGMENT, SEGMENTS),
        "drops": table(spark, SEGMENT, "drop n4 n5 thin 8 mill"),
        "consumers": table(spark, "COD_ID PAC FAS_CON UNI_TR_MT TIP_CC " + " ".join(feeder.MONTHS), monthly),
        "curves": table(spark, "COD_ID TIP_DIA " + " ".join(feeder.CURVE), " ".join(["week", "DU", *["2,0"] * 24, *["1.0"] * 72])),
        "generators": table(spark, "COD_ID PAC UNI_TR_MT POT_INST", "roof n2 mill 4,5"),
    }


def test_list_transformers(layers):
    got = feeder.list_transformers(layers["transformers"], layers["segments"], layers["consumers"], layers["generators"]).collect()
    assert [(r.transformer_id, r.consumers, r.lv_segments, r.generators) for r in got] == [("mill", 5, 7, 1), ("ford", 1, 1, 0)]
    assert [r.annual_mwh for r in got] == pytest.approx([13.944, 1.14])


def test_impedance_sources(spark, layers):
    plate = table(spark, "COD_ID UNI_TR_MT R XHL", "e1 mill 1,2 3,5")
    got = {r.transformer_id: r for r in feeder.impedance(layers["transformers"], plate).collect()}
    assert (got["mill"].vkr_percent, got["mill"].vk_percent, got["mill"].source) == (1.2, pytest.approx(3.7), "equipment")
    assert got["ford"].vkr_percent is None and "vkr_percent" in got["ford"].error
    losses = {r.transformer_id: r for r in feeder.impedance(layers["transformers"], None, vk_percent=4.0, vkr_percent=1.5).collect()}
    assert losses["mill"].vkr_percent == pytest.approx(4 / 3) and losses["mill"].source == "copper losses"  # 1500 W of 112.5 kVA
    assert losses["ford"].vkr_percent == 1.5 and losses["ford"].error is None
    assert "below" in feeder.impedance(layers["transformers"], None, vk_percent=1.0).filter("transformer_id = 'mill'").first().error


def test_feeders(layers):
    edges = feeder.branches(layers["segments"], layers["drops"], layers["conductors"], default=(1.0, 0.1, 50.0))
    roots = layers["transformers"].selectExpr("COD_ID as transformer_id", "PAC_2 as node")
    nodes = feeder.connected(edges, roots)
    assert {(r.node, r.parent, r.depth) for r in nodes.filter("transformer_id = 'mill'").collect()} == {
        ("n0", None, 0), ("n1", "n0", 1), ("n2", "n0", 1), ("n3", "n2", 2), ("n4", "n3", 3), ("n5", "n4", 4),
    }
    rows = feeder.loads(layers["consumers"], layers["curves"], nodes, load_factor=0.5)
    peak = {r.load_id: r.p_mw for r in rows.collect()}
    # the curve's mean is 1.25 of a peak of 2
    assert peak == pytest.approx({k: kwh * 12 / 8760 / factor / 1000 for k, kwh, factor in (("bakery", 620, 0.625), ("flat", 180, 0.625), ("garage", 310, 0.5), ("hut", 40, 0.5), ("lost", 12, 0.5), ("farm", 95, 0.625))})
    loops = layers["segments"].filter("PAC_1 = PAC_2")
    found = {r.transformer_id: r for r in feeder.report(edges, nodes, rows, loops, max_dropped=0.06).collect()}
    r = found["mill"]
    assert (r.lines, r.buses, r.loops, r.self_loops, r.islanded_nodes, r.default_conductors) == (6, 6, 1, 1, 2, 1)
    assert (r.loads, r.consumers_not_in_network, r.load_factor_from_curve, r.loads_1_phase, r.loads_2_phase, r.loads_3_phase) == (3, 2, 2, 1, 1, 1)
    assert r.dropped_share == pytest.approx(104 / 2004) and r.error is None  # 52 kWh at 0.5, of 992 + 288 + 620 + 104
    assert (found["ford"].lines, found["ford"].loads_3_phase, found["ford"].error) == (1, 1, None)
    assert "too much load" in feeder.report(edges, nodes, rows, loops).filter("transformer_id = 'mill'").first().error
    lengths = {r.branch_id: (r.length_km, r.r_ohm_per_km) for r in edges.collect()}
    assert lengths["arm1"] == (feeder.SHORTEST_KM, 1.9) and lengths["arm2"] == (pytest.approx(0.033), 1.0) and "knot" not in lengths
    bare = feeder.branches(layers["segments"], None, layers["conductors"])
    assert "conductor" in feeder.report(bare, feeder.connected(bare, roots), rows, loops).filter("transformer_id = 'mill'").first().error
    assert "load_factor" in feeder.report(edges, nodes, feeder.loads(layers["consumers"], None, nodes), loops).filter("transformer_id = 'mill'").first().error


def test_phase_shares(spark):
    df = spark.createDataFrame([(1.0, -4.0, 3.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    got = feeder.phase_shares(df, "a", "b", "c").collect()
    assert (got[0].share_a, got[0].dominant, got[0].balanced) == (0.125, "b", 0.0) and got[1].share_c == pytest.approx(1 / 3)


def test_scope_and_risk_order(spark):
    buses = spark.createDataFrame([("g", i, 0.4 if i < 5 else 20.0, i != 3) for i in range(7)], "network string, bus_id long, vn_kv double, in_service boolean")
    some = lambda *ids: spark.createDataFrame([("g", i) for i in ids], "network string, bus_id long")
    assert {r.bus_id for r in feeder.voltage_scope(buses, some(0), some(2), 0.4).collect()} == {1, 4}
    steps = spark.createDataFrame([("r", 0, 2.0, 1.0), ("r", 1, 1.0, 1.0), ("r", 2, 2.0, 2.0), ("r", 3, 1.0, 0.0)], "run string, step long, load_mult double, pv_mult double")
    assert [r.step for r in feeder.risk_order(steps, ["run"]).orderBy("risk_rank").collect()] == [1, 2, 0, 3]


def test_annual(spark):
    weeks = spark.createDataFrame([(1, 2.5, True), (2, 1.5, True), (3, 9.0, False), (4, 1.5, True)], "win long, capacity double, bounded boolean")
    year = studies.annual(weeks).first()
    assert (year.capacity, year.critical_window, year.p50, year.censored) == (1.5, 2, 1.5, 1)


def test_stochastic(spark):
    rows = [("a", float(i * 37 % 101), i % 10 > 0) for i in range(101)] + [("b", 5.0, True)] * 3
    got = {r.study: r for r in studies.stochastic(spark.createDataFrame(rows, "study string, lambda_max double, bounded boolean"), ["study"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["lambda"], a.scenarios, a.censored) == (10.0, 101, 11) and a.ci_low < 10 < a.ci_high  # the eleventh of 0..100
    assert (b["lambda"], b.ci_low) == (5.0, None)
    p = {r["lambda"]: r.p for r in studies.violation_probability(spark.createDataFrame(rows[:101], "study string, lambda_max double, bounded boolean"), [0.0, 50.0, math.inf]).collect()}
    assert p == {0.0: 0.0, 50.0: pytest.approx(50 / 101), math.inf: 1.0}


def test_annual_energy_reads_each_month_once(spark):
    cells = [["", "x", "-1", "10,5", "2.5"], [None] * 5, ["-3"] * 5, [" 4 "] * 5]
    df = spark.createDataFrame([tuple(c) for c in cells], ", ".join(f"{m} string" for m in feeder.MONTHS[:5]))
    made = df.select(feeder.annual_kwh(df).alias("kwh"))
    assert [r.kwh for r in made.collect()] == [78.0, 0.0, 0.0, 48.0]
    assert made._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].count("ENE_03") == 1


def test_layers_are_written_compressed(spark, monkeypatch):
    import glob

    from conftest import DATA

    from gridloom.plans import feeders

    monkeypatch.setattr(feeders, "_WRITTEN", {})
    monkeypatch.setattr(feeders, "ROWS_PER_FILE", 1000)
    found = feeders._layers(spark, DATA)
    files = glob.glob(found["__path"].removeprefix("file:") + "/UCBT_tab.csv/*.csv.gz")
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert len(files) >= n / 1000 and found["UCBT_tab"].count() == n
