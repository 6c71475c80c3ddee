"""Network documents, their registry, and series from their own profiles."""

import hashlib
import json

import pytest

from gridloom.operators import allocation
from gridloom.sources import networks
from gridloom.sources.datasets import DatasetError


def frame(columns, index, data):
    return {"_module": "pandas.core.frame", "_class": "DataFrame", "_object": json.dumps({"columns": columns, "index": index, "data": data}), "orient": "split"}


def document(name="town", **tables):
    made = {
        "bus": frame(["name", "vn_kv", "type", "in_service"], [0, 1, 2, 5, 7], [["mv", 20.0, "b", True], ["lv", 0.4, "b", True], [None, 0.4, "b", True], ["off", 0.4, "b", False], ["gen", 0.4, "b", True]]),
        "load": frame(["p_mw", "bus", "q_mvar", "in_service", "profile"], [0, 3], [[0.01, 1, 0.002, True, "H0"], [0.02, 1, None, True, "G1"]]),
        "sgen": frame(["bus", "p_mw", "type", "profile"], [0], [[2, 0.005, "PV", "PV1"]]),
        "gen": frame(["bus", "p_mw", "in_service"], [0, 1], [[7, 0.1, True], [2, 0.1, False]]),
        "ext_grid": frame(["bus", "vm_pu"], [0], [[0, 1.02]]),
        "line": frame(["name", "from_bus", "to_bus", "length_km", "std_type"], [0], [["a", 1, 2, 0.1, "NAYY 4x50 \"x\""]]),
    } | tables
    return json.dumps({"_module": "m", "_class": "net", "_object": {"name": name, "version": "3.0", "f_hz": 50.0, **made}})


@pytest.fixture
def folder(tmp_path):
    text = document()
    (tmp_path / "town.json").write_text(text)
    about = {"country": "Somewhere", "kind": "real", "default_framework": "own", "voltage_levels_kv": [0.4], "network_sha256": hashlib.sha256(text.encode()).hexdigest(), "more": {"a": 1}}
    (tmp_path / "town.json.meta.json").write_text(json.dumps(about))
    (tmp_path / "bare.json").write_text(document("x"))
    return str(tmp_path)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_files_become_tables(spark, folder):
    docs = networks.network_files(spark, folder)
    assert {(r.network, r.source) for r in docs.collect()} == {("town", "file:" + hashlib.sha256(document().encode()).hexdigest()), ("bare", "file:" + hashlib.sha256(document("x").encode()).hexdigest())}
    found = networks.tables(docs.filter("network = 'town'"))
    assert rows(found["bus"], "bus_id", "name", "vn_kv", "in_service") == [(0, "mv", 20.0, True), (1, "lv", 0.4, True), (2, None, 0.4, True), (5, "off", 0.4, False), (7, "gen", 0.4, True)]
    assert rows(found["load"], "load_id", "bus", "p_mw", "q_mvar") == [(0, 1, 0.01, 0.002), (3, 1, 0.02, None)]
    assert rows(found["line"], "from_bus", "to_bus", "r_ohm_per_km") == [(1, 2, None)] and found["trafo"].count() == 0
    assert found["sgen"].count() == 0 and networks.tables(docs, "keep")["sgen"].count() == 2
    with pytest.raises(DatasetError):
        networks.tables(docs, "some")
    assert rows(allocation.proportional_to_load(networks.loads_of(found)), "network", "bus_id", "base_mw") == [("town", 1, 0.03)]


def test_registry_guesses_nothing(spark, folder):
    docs, about = networks.network_files(spark, folder), networks.sidecars(spark, folder)
    found = {r.network: r for r in networks.registry(docs, about).collect()}
    assert found["town"].problem is None and found["town"].country == "Somewhere" and list(found["town"].levels) == [0.4]
    assert "framework" in found["bare"].problem
    with pytest.raises(DatasetError, match="bare: no framework"):
        networks.registered(networks.registry(docs, about))
    given = spark.createDataFrame([("bare", "own", [20.0, 0.4]), ("town", "other", None)], "network string, framework string, levels array<double>")
    both = networks.registered(networks.registry(docs, about, given, frameworks=["own", "other"]))
    assert rows(both, "network", "framework", "country") == [("bare", "own", "unknown"), ("town", "other", "Somewhere")]
    assert {r.problem for r in networks.registry(docs, about, given, frameworks=["own"]).collect()} == {None, "unknown framework"}
    assert {r.network: r.problem for r in networks.registry(docs, about, given, reserved=["town"]).collect()}["town"] == "the name is reserved"
    assert {r.problem for r in networks.registry(docs.unionByName(docs), about, given).collect()} == {"two documents claim the name"}
    with open(f"{folder}/town.json", "a") as f:
        f.write(" ")
    assert {r.network: r.problem for r in networks.registry(networks.network_files(spark, folder), about, given).collect()}["town"] == "the sidecar is another file's"


def test_scope(spark, folder):
    docs = networks.network_files(spark, folder)
    given = spark.createDataFrame([("town", [0.4]), ("bare", [110.0])], "network string, levels array<double>")
    scope = networks.voltage_scope(networks.tables(docs), given)
    assert rows(scope, "network", "bus_id") == [("town", 1), ("town", 2)]  # not off, not held, no other level
    assert [r.network for r in networks.without_scope(given, scope).collect()] == ["bare"]


def test_unreadable_documents_fail(spark, tmp_path):
    for i, text in enumerate(["{", "{}", document(bus={"_object": "no json"}), " "]):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match="no readable table of buses"):
            networks.element(networks.network_files(spark, str(tmp_path / f"{i}.json")), "bus").collect()
    (tmp_path / "empty.json").write_text(document(bus=frame(["vn_kv"], [], [])))
    assert networks.element(networks.network_files(spark, str(tmp_path / "empty.json")), "bus").count() == 0


def test_documents_round_trip(spark, folder):
    found = networks.tables(networks.network_files(spark, folder), "keep")
    texts = networks.documents_of(found)
    again = networks.tables(texts.selectExpr("network", "text", "'' as path"), "keep")
    for kind in networks.ELEMENTS:
        assert rows(found[kind], "*") == rows(again[kind], "*")
    inner = json.loads(json.loads(texts.filter("network = 'town'").first().text)["_object"]["load"]["_object"])
    assert inner["index"] == [0, 3] and inner["data"][0][inner["columns"].index("p_mw")] == 0.01  # numbers, not texts


def test_own_series_equal_numpy(spark, tmp_path):
    import numpy as np

    steps, rng = networks.STEPS, np.random.default_rng(3)
    values = {n: rng.random(steps) for n in ("H0_pload", "G1_pload", "PV1", "PV2")}
    values["PV1"][:30] = -0.1
    start = np.datetime64("2016-06-01T00:00:00")
    table = [("load" if n.endswith("_pload") else "pv", n, (start + np.timedelta64(15 * k, "m")).item(), float(v)) for n, some in values.items() for k, v in enumerate(some)]
    profiles = spark.createDataFrame(table, "kind string, series_id string, ts_utc timestamp_ntz, value double")
    (tmp_path / "own.json").write_text(document())
    (tmp_path / "none.json").write_text(document(sgen=frame(["bus", "p_mw", "type", "profile"], [], [])))
    found = networks.tables(networks.network_files(spark, str(tmp_path)), "keep")
    got = networks.own_series(found, profiles, "2016-06-01", 1).orderBy("network", "ts").collect()
    load = (0.01 * values["H0_pload"] + 0.02 * values["G1_pload"]) / 0.03
    sun = lambda v: np.where(np.clip(v, 0, 1) < 1e-4, 0, np.clip(v, 0, 1))
    want = {"own": sun(values["PV1"]), "none": sun((values["PV1"] + values["PV2"]) / 2)}
    for name, pv in want.items():
        some = [r for r in got if r.network == name]
        assert np.allclose([r.load_mult for r in some], load) and np.allclose([r.pv_mult for r in some], pv) and len(some) == steps
    mult = networks.load_multipliers(found, profiles)
    assert mult.count() == 2 * 2 * steps
    with pytest.raises(Exception, match="profile without a whole window: (H0|G1)_pload"):
        networks.own_series(found, profiles, "2016-06-01", 2).collect()


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_of_networks_are_not_shuffled(spark, folder):
    """A network's weights meet the steps where they lie: what is dealt out has a row a network or a profile's step."""
    table = [(k, n, f"2016-06-01 {q // 4:02d}:{q % 4 * 15:02d}:00", float(q)) for k, n in (("load", "H0_pload"), ("load", "G1_pload"), ("pv", "PV1")) for q in range(networks.STEPS)]
    profiles = spark.createDataFrame(table, "kind string, series_id string, t string, value double").selectExpr("kind", "series_id", "cast(t as timestamp_ntz) as ts_utc", "value")
    made = networks.own_series(networks.tables(networks.network_files(spark, folder), "keep"), profiles, "2016-06-01", 1)
    dealt = [line for line in planned(made).splitlines() if "Exchange hashpartitioning(network" in line]
    assert dealt and not [line for line in dealt if "ts" in line.split("hashpartitioning(")[1].split(")")[0]]
    assert made.count() == 2 * networks.STEPS


def test_documents_meet_by_one_shuffle(spark, folder):
    found = {k: df.localCheckpoint() for k, df in networks.tables(networks.network_files(spark, folder), "keep").items()}
    assert planned(networks.documents_of(found)).count("Exchange hashpartitioning") == 1
