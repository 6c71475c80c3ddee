"""Network files as element tables, their registry, and series from their own profiles.

A network document is JSON: an object a kind of element, whose table is a string
of JSON again, split into ``columns``, ``index`` and ``data``.  It comes as a file
of its own or as a line of a file.  Both levels are parsed by column expressions,
a document a row, so any number of networks is one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import normalise_pv
from .datasets import DatasetError

#: Names of the element tables and of the columns read from them.
ELEMENTS: dict[str, dict[str, str]] = {
    "bus": {"name": "string", "vn_kv": "double", "in_service": "boolean"},
    "load": {"name": "string", "bus": "long", "p_mw": "double", "q_mvar": "double", "in_service": "boolean", "profile": "string"},
    "sgen": {"name": "string", "bus": "long", "p_mw": "double", "type": "string", "in_service": "boolean", "profile": "string"},
    "gen": {"name": "string", "bus": "long", "p_mw": "double", "vm_pu": "double", "in_service": "boolean"},
    "ext_grid": {"name": "string", "bus": "long", "vm_pu": "double", "in_service": "boolean"},
    "line": {"name": "string", "from_bus": "long", "to_bus": "long", "length_km": "double", "r_ohm_per_km": "double", "x_ohm_per_km": "double", "max_i_ka": "double", "in_service": "boolean"},
    "trafo": {"name": "string", "hv_bus": "long", "lv_bus": "long", "sn_mva": "double", "vk_percent": "double", "vkr_percent": "double", "in_service": "boolean"},
}
SIDECAR = "country string, kind string, description string, citation string, default_framework string, voltage_levels_kv array<double>, network_sha256 string"
_SPLIT = "columns array<string>, index array<string>, data array<array<string>>"
_META = ".meta.json"
#: Steps of a day in the profiles, and the least load.
STEPS, LEAST_LOAD = 96, 1e-6


def network_files(spark: SparkSession, path: str) -> DataFrame:
    """``network`` (the file's stem), ``path``, ``source`` (``file:`` and the SHA-256 of the bytes) and ``text`` of every network file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).filter(~F.endswith("path", F.lit(_META)))
    return files.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("network"), "path", F.concat(F.lit("file:"), F.sha2("content", 256)).alias("source"), F.decode("content", "UTF-8").alias("text"))


def network_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files that hold a document a line; a network is known by its own name."""
    lines = spark.read.text(path)
    name = F.get_json_object("value", "$._object.name")
    return lines.select(name.alias("network"), F.col("_metadata.file_path").alias("path"), F.concat(F.lit("file:"), F.sha2(F.col("value").cast("binary"), 256)).alias("source"), F.col("value").alias("text"))


def element(documents: DataFrame, kind: str) -> DataFrame:
    """``network``, ``<kind>_id`` and the typed columns of one kind of element; columns that a file lacks are null.

    A document without a readable table of buses fails the job; a file without a
    single byte is none, as Spark lists no such files.
    """
    outer = F.from_json("text", f"_object struct<{kind}: struct<_object: string>>")
    table = F.from_json(outer["_object"][kind]["_object"], _SPLIT)
    if kind == "bus":
        wrong = F.concat(F.lit("no readable table of buses in network "), F.coalesce("network", "path"))
        table = F.coalesce(F.when(table["data"].isNotNull(), table), F.from_json(F.raise_error(wrong).cast("string"), _SPLIT))
    rows = documents.select("network", table.alias("t")).select("network", F.col("t.columns").alias("names"), F.explode(F.arrays_zip(F.col("t.index").alias("i"), F.col("t.data").alias("row"))).alias("x"))
    text = lambda c: F.get("x.row", F.array_position("names", c).cast("int") - 1)
    typed = {"long": lambda c: text(c).try_cast("double").cast("long"), "double": lambda c: text(c).try_cast("double"), "boolean": lambda c: text(c).try_cast("boolean"), "string": text}
    return rows.select("network", F.col("x.i").try_cast("long").alias(f"{kind}_id"), *(typed[t](c).alias(c) for c, t in ELEMENTS[kind].items()))


def tables(documents: DataFrame, existing_pv: str = "remove") -> dict[str, DataFrame]:
    """All element tables; ``existing_pv`` says whether units that a network ships with stay (``keep``) or go (``remove``)."""
    if existing_pv not in ("keep", "remove"):
        raise DatasetError("existing_pv is keep or remove")
    found = {kind: element(documents, kind) for kind in ELEMENTS}
    if existing_pv == "remove":
        found["sgen"] = found["sgen"].filter(F.lit(False))
    return found


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """What the files beside networks say of them, by the network file's ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{_META}").load(path)
    return files.select(F.expr(f"left(path, length(path) - {len(_META)})").alias("path"), F.from_json(F.decode("content", "UTF-8"), SIDECAR).alias("m")).select("path", "m.*")


def registry(documents: DataFrame, about: DataFrame, given: DataFrame | None = None, frameworks: list[str] | None = None, reserved: list[str] | None = None) -> DataFrame:
    """A row a network: where it comes from, the framework and voltage levels that judge it, and ``problem`` (null if none).

    ``about``: sidecars by ``path``.  ``given``: ``network``, ``framework``,
    ``levels`` that win over these.  Nothing is guessed: a network for which
    neither names framework and levels has a problem, as has one that a reserved
    name or a second document claims, or whose bytes its sidecar does not know.
    """
    given = given if given is not None else documents.sparkSession.createDataFrame([], "network string, framework string, levels array<double>")
    both = documents.select("network", "path", "source").join(about, "path", "left").join(given.select("network", "framework", "levels"), "network", "left")
    twice = documents.groupBy("network").agg(F.count("*").alias("documents"))
    framework, levels = F.coalesce("framework", "default_framework"), F.coalesce("levels", "voltage_levels_kv")
    unknown = ~framework.isin(frameworks) if frameworks else F.lit(False)
    problem = F.when(F.col("network").isin(reserved or []), "the name is reserved").when(F.col("documents") > 1, "two documents claim the name")
    problem = problem.when(framework.isNull() | (F.coalesce(F.size(levels), F.lit(0)) < 1), "no framework or voltage level is known").when(unknown, "unknown framework")
    problem = problem.when(F.concat(F.lit("file:"), "network_sha256") != F.col("source"), "the sidecar is another file's")
    word = lambda c, other: F.coalesce(c, F.lit(other)).alias(c)
    made = both.join(twice, "network").select("network", "source", framework.alias("framework"), levels.alias("levels"), word("country", "unknown"), word("kind", "custom"), word("description", ""), word("citation", ""), problem.alias("problem"))
    return made


def registered(networks: DataFrame, shown: int = 20) -> DataFrame:
    """``networks`` if none has a problem; else an error that names the first ``shown``."""
    wrong = networks.filter("problem is not null").orderBy("network").limit(shown).collect()
    if wrong:
        raise DatasetError("; ".join(f"{r.network}: {r.problem}" for r in wrong))
    return networks.drop("problem")


def voltage_scope(found: dict[str, DataFrame], networks: DataFrame) -> DataFrame:
    """``network, bus_id``: in-service buses at a voltage level of their network that neither source nor running generator holds."""
    levels = networks.select("network", F.explode("levels").alias("level"))
    near = F.abs(F.col("vn_kv") - F.col("level")) <= 1e-6 * F.greatest(F.abs("vn_kv"), F.abs("level"))
    at = found["bus"].filter("in_service").join(levels, "network").filter(near).select("network", "bus_id").distinct()
    held = found["ext_grid"].select("network", F.col("bus").alias("bus_id")).unionByName(found["gen"].filter("in_service").select("network", F.col("bus").alias("bus_id")))
    return at.join(held, ["network", "bus_id"], "left_anti")


def without_scope(networks: DataFrame, scope: DataFrame) -> DataFrame:
    """Networks of which no bus is in scope; a study of them has nothing to judge."""
    return networks.select("network").join(scope.select("network"), "network", "left_anti")


def loads_of(found: dict[str, DataFrame]) -> DataFrame:
    """``network, load_id, bus_id, p_mw, q_mvar, profile`` as allocation takes them."""
    return found["load"].select("network", "load_id", F.col("bus").alias("bus_id"), "p_mw", F.coalesce("q_mvar", F.lit(0.0)).alias("q_mvar"), "profile")


def documents_of(found: dict[str, DataFrame]) -> DataFrame:
    """``network``, ``text``: a document a network out of element tables, rows by id; a network's elements meet in one row, as in its file, by one shuffle."""
    parts, heads = [], {}
    for kind, columns in ELEMENTS.items():
        if kind not in found:
            continue
        names = [c for c in columns if c in found[kind].columns]
        cells = F.to_json(F.array(*(F.col(c).cast("variant") for c in names)))
        parts.append(found[kind].select("network", F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("i"), cells.alias("row")))
        heads[kind] = '{"columns":["' + '","'.join(names) + '"],"index":'
    rows = reduce(DataFrame.unionByName, parts).repartition("network")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("i", "row"))))
    met = rows.groupBy("network").agg(*(of(kind).alias(kind) for kind in heads))
    join = lambda kind, f: F.concat(F.lit("["), F.array_join(F.transform(kind, f), ","), F.lit("]"))
    text = lambda kind: F.concat(F.lit(heads[kind]), join(kind, lambda s: s["i"].cast("string")), F.lit(',"data":'), join(kind, lambda s: s["row"]), F.lit("}"))
    inner = [F.when(F.size(kind) > 0, F.struct(F.lit("DataFrame").alias("_class"), text(kind).alias("_object"))).alias(kind) for kind in heads]
    return met.select("network", F.to_json(F.struct(F.lit("network").alias("_class"), F.struct(F.col("network").alias("name"), *inner).alias("_object"))).alias("text"))


def own_series(found: dict[str, DataFrame], profiles: DataFrame, start: str, days: int) -> DataFrame:
    """``network, ts, load_mult, pv_mult`` of ``days`` from ``start`` by the networks' own profiles (``kind, series_id, ts_utc, value``).

    Loads: each profile weighted by the load that follows it.  PV: each profile by
    the capacity of the units that follow it, or the mean of all PV profiles where
    a network has none.  A profile that a load names and no row has, or a window
    that is not all there, fails the job.  A network's weights are one row, which
    meets every step of the window; steps of networks are never shuffled.
    """
    begin = F.lit(start).cast("timestamp_ntz")
    inside = profiles.filter((F.col("ts_utc") >= begin) & (F.col("ts_utc") < begin + F.make_dt_interval(days=F.lit(days))))
    complete = inside.groupBy("kind", "series_id").agg(F.count("value").alias("n"))
    load_name = F.concat("profile", F.lit("_pload")).alias("series_id")
    weights = found["load"].groupBy("network", load_name).agg(F.sum("p_mw").alias("w"))
    checked = weights.join(F.broadcast(complete.filter("kind = 'load'")), "series_id", "left")  # a row a profile
    fails = F.when(F.coalesce("n", F.lit(0)) == days * STEPS, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("profile without a whole window: "), F.coalesce("series_id", F.lit("none")))).cast("double"))
    listed = lambda name: F.array_sort(F.collect_list(F.struct("series_id", "w"))).alias(name)
    loads = checked.select("network", "series_id", fails.alias("w")).filter("network is not null").groupBy("network").agg(F.sum("w").alias("all"), listed("loads"))
    units = found["sgen"].filter(F.upper("type").contains("PV")).groupBy("network", F.col("profile").alias("series_id")).agg(F.sum("p_mw").alias("w"))
    units = units.join(F.broadcast(complete.filter("kind = 'pv'").select("series_id")), "series_id", "left_semi").groupBy("network").agg(listed("units"))
    # sums and rows of each profile at each step; all steps are at most ``days * STEPS`` rows of a map each
    at = inside.filter("series_id is not null").groupBy("kind", "series_id", "ts_utc").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    by_kind = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("series_id", F.struct("s", "n")))))
    mean = inside.filter("kind = 'pv'").groupBy("ts_utc").agg(F.avg("value").alias("mean"), F.lit(True).alias("sunny"))
    steps = at.groupBy("ts_utc").agg(by_kind("load").alias("load_at"), by_kind("pv").alias("pv_at")).join(mean, "ts_utc", "left")
    networks_ = loads.join(units, "network", "left")
    partitions = int(found["load"].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # networks are few bytes and their steps many rows, so they are dealt out by number, not by size
    met = networks_.repartition(partitions, "network").crossJoin(F.broadcast(steps))

    def total(weights_: str, at_: str, field: str) -> Column:
        term = lambda x: x["w"] * F.col(at_)[x["series_id"]][field]
        return F.aggregate(F.filter(F.transform(weights_, term), lambda v: v.isNotNull()), F.lit(None).cast("double"), lambda a, v: F.coalesce(a, F.lit(0.0)) + v)

    own = F.when(F.col("units").isNull(), F.col("mean")).otherwise(F.col("pv_sum") / F.col("pv_all"))
    there = F.exists("loads", lambda x: F.map_contains_key("load_at", x["series_id"])) & F.when(F.col("units").isNull(), F.col("sunny")).otherwise(F.exists("units", lambda x: F.map_contains_key("pv_at", x["series_id"])))
    sums = met.filter(there).select("network", F.col("ts_utc").alias("ts"), "all", "units", "mean", total("loads", "load_at", "s").alias("s"), total("units", "pv_at", "s").alias("pv_sum"), total("units", "pv_at", "n").alias("pv_all"))
    return sums.select("network", "ts", F.greatest(F.col("s") / F.col("all"), F.lit(LEAST_LOAD)).alias("load_mult"), own.alias("pv")).select("network", "ts", "load_mult", normalise_pv(F.col("pv")).alias("pv_mult"))


def load_multipliers(found: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """``network, load_id, ts, mult``: each load's own profile, as rows instead of a matrix."""
    named = found["load"].select("network", "load_id", F.concat("profile", F.lit("_pload")).alias("series_id"))
    return named.join(profiles.filter("kind = 'load'"), "series_id").select("network", "load_id", F.col("ts_utc").alias("ts"), F.col("value").alias("mult"))
