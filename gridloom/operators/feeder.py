"""Low-voltage feeders out of an asset register's layers, for all transformers at once.

Layers hold strings, as their exports do.  Everything is keyed by transformer, so
a country's feeders are one job; trouble is a row of the report, not an exception.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import number
from ..session import shared_folder
from . import network

HOURS_PER_YEAR = 8760.0
MONTHS = [f"ENE_{m:02d}" for m in range(1, 13)]
CURVE = [f"POT_{q:02d}" for q in range(1, 97)]
#: Length in km that stands for none.
SHORTEST_KM = 1e-4


def annual_kwh(df: DataFrame) -> Column:
    """Energy of a year; months without a value, or below 0, count as the mean of the others."""
    # one pass over one array: as terms of their own, or named thrice, twelve parsed columns make a method that the JVM does not compile
    months = F.transform(F.array(*(F.col(c).cast("string") for c in MONTHS if c in df.columns)), number)
    add = lambda a, v: F.when(v >= 0, F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a)
    mean = lambda a: F.when(a["n"] > 0, a["s"] / a["n"] * 12).otherwise(0.0)
    return F.aggregate(months, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), add, mean)


def curve_load_factors(curves: DataFrame) -> DataFrame:
    """``code, load_factor``: mean over peak of each typical curve, all its day types together."""
    values = curves.select(F.col("COD_ID").alias("code"), F.explode(F.array(*(number(F.col(c)) for c in CURVE if c in curves.columns))).alias("v")).filter("v is not null")
    return values.groupBy("code").agg((F.avg("v") / F.max("v")).alias("load_factor"), F.max("v").alias("peak")).filter("peak > 0").drop("peak")


def phases(code: Column) -> Column:
    """Number of phases that a code names; three where it names none."""
    n = F.size(F.array_distinct(F.filter(F.split(F.upper(F.coalesce(code, F.lit(""))), ""), lambda c: c.isin("A", "B", "C"))))
    return F.when(n > 0, n).otherwise(3)


def list_transformers(transformers: DataFrame, segments: DataFrame, consumers: DataFrame, generators: DataFrame | None = None) -> DataFrame:
    """Size of each transformer and what hangs on it, largest first."""
    link = F.col("UNI_TR_MT").alias("transformer_id")
    seg = segments.groupBy(link).agg(F.count("*").alias("lv_segments"), (F.sum(number(F.col("COMP"))) / 1000).alias("lv_length_km"))
    con = consumers.groupBy(link).agg(F.count("*").alias("consumers"), (F.sum(annual_kwh(consumers)) / 1000).alias("annual_mwh"))
    out = transformers.select(F.col("COD_ID").alias("transformer_id"), number(F.col("POT_NOM")).alias("rated_kva")).join(seg, "transformer_id", "left").join(con, "transformer_id", "left")
    if generators is not None:
        out = out.join(generators.groupBy(link).agg(F.count("*").alias("generators")), "transformer_id", "left")
    else:
        out = out.withColumn("generators", F.lit(0))
    return out.na.fill(0).orderBy(F.desc("consumers"), F.desc("lv_segments"), "transformer_id")


def impedance(transformers: DataFrame, equipment: DataFrame | None = None, vk_percent: float | None = None, vkr_percent: float | None = None) -> DataFrame:
    """Short-circuit voltages: the equipment layer's, else copper losses and the options; ``error`` says what is missing."""
    own = transformers.dropDuplicates(["COD_ID"]).select(F.col("COD_ID").alias("transformer_id"), number(F.col("POT_NOM")).alias("kva"), number(F.col("PER_FER")).alias("iron"), number(F.col("PER_TOT")).alias("total"))
    if equipment is None:
        joined = own.withColumns({"r": F.lit(None).cast("double"), "x": F.lit(None).cast("double")})
    else:
        first = equipment.groupBy(F.col("UNI_TR_MT").alias("transformer_id")).agg(F.min(F.struct(number(F.col("R")).alias("r"), number(F.col("XHL")).alias("x"))).alias("e"))
        joined = own.join(first.select("transformer_id", "e.r", "e.x"), "transformer_id", "left")
    measured = F.col("r").isNotNull() & (F.col("x") > 0)
    copper = F.when(F.col("total") > F.col("iron"), (F.col("total") - F.col("iron")) / (F.col("kva") * 1000) * 100)
    option = lambda v: F.lit(v).cast("double")
    made = joined.withColumns({
        "vkr_percent": F.when(measured, F.col("r")).otherwise(F.coalesce(copper, option(vkr_percent))),
        "vk_percent": F.when(measured, F.hypot("r", "x")).otherwise(option(vk_percent)),
        "source": F.when(measured, "equipment").when(copper.isNotNull(), "copper losses").otherwise("options"),
        "iron_kw": F.greatest(F.coalesce(F.col("iron"), F.lit(0.0)), F.lit(0.0)) / 1000,
    })
    error = F.when(~F.coalesce(F.col("kva") > 0, F.lit(False)), "invalid rated power").when(F.col("vkr_percent").isNull(), "no resistance: pass vkr_percent")
    error = error.when(F.col("vk_percent").isNull(), "no short-circuit voltage: pass vk_percent").when(F.col("vkr_percent") >= F.col("vk_percent"), "vkr_percent must be below vk_percent")
    return made.withColumn("error", error).select("transformer_id", "kva", "vk_percent", "vkr_percent", "iron_kw", "source", "error")


def branches(segments: DataFrame, drops: DataFrame | None, conductors: DataFrame, default: tuple[float, float, float] | None = None) -> DataFrame:
    """Segments and service drops with lengths and conductor data; self-loops are gone, ``r_ohm_per_km`` is null without usable data."""
    columns = ["UNI_TR_MT", "COD_ID", "PAC_1", "PAC_2", "TIP_CND", "COMP"]
    all_ = segments.select(*columns, F.lit("segment").alias("kind"))
    if drops is not None and set(columns) <= set(drops.columns):
        all_ = all_.unionByName(drops.select(*columns, F.lit("service_drop").alias("kind")))
    catalogue = conductors.groupBy(F.col("COD_ID").alias("TIP_CND")).agg(F.min(F.struct(number(F.col("R1")).alias("r"), number(F.col("X1")).alias("x"), number(F.col("CNOM")).alias("amps"))).alias("c"))
    joined = all_.filter("PAC_1 <> PAC_2").join(catalogue, "TIP_CND", "left")
    usable = (F.col("c.r") > 0) & (F.col("c.amps") > 0) & F.col("c.x").isNotNull()
    pick = lambda f, i: F.when(usable, F.col(f"c.{f}")).otherwise(F.lit(default[i] if default else None).cast("double"))
    km = number(F.col("COMP")) / 1000
    return joined.select(
        F.col("UNI_TR_MT").alias("transformer_id"), F.col("COD_ID").alias("branch_id"), F.col("PAC_1").alias("a"), F.col("PAC_2").alias("b"), "kind", F.when(km > 0, km).otherwise(SHORTEST_KM).alias("length_km"),
        pick("r", 0).alias("r_ohm_per_km"), pick("x", 1).alias("x_ohm_per_km"), pick("amps", 2).alias("amps"), (~F.coalesce(usable, F.lit(False))).alias("is_default"),
    )


def connected(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``transformer_id, node, parent, depth``: what each transformer's secondary node reaches, and by which node (the smallest).

    The feeders of all transformers go on together, several levels a job.
    """
    ends = edges.select("transformer_id", "a", "b").unionByName(edges.select("transformer_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    shared_folder(edges.sparkSession)
    both = ends.checkpoint()

    def step(level: DataFrame) -> DataFrame:
        near = both.join(level.select("transformer_id", F.col("node").alias("a")), ["transformer_id", "a"])
        return near.groupBy("transformer_id", F.col("b").alias("node")).agg(F.min("a").alias("parent"))

    start = roots.select("transformer_id", "node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    return network.waves(start, ["transformer_id", "node"], step)


def loads(consumers: DataFrame, curves: DataFrame | None, nodes: DataFrame, load_factor: float | None = None, power_factor: float = 0.92) -> DataFrame:
    """Peak loads: energy over hours and load factor, the curve's or the option; ``attached`` says whether the node is reached."""
    con = consumers.withColumn("kwh", annual_kwh(consumers)).filter("kwh > 0").select(F.col("UNI_TR_MT").alias("transformer_id"), F.col("COD_ID").alias("load_id"), F.col("PAC").alias("node"), "kwh", phases(F.col("FAS_CON")).alias("phases"), F.col("TIP_CC").alias("code"))
    factor = F.lit(load_factor).cast("double")
    if curves is not None:
        con = con.join(curve_load_factors(curves).withColumnRenamed("load_factor", "own"), "code", "left")
        factor = F.coalesce("own", factor)
    else:
        con = con.withColumn("own", F.lit(None).cast("double"))
    mw = F.col("kwh") / HOURS_PER_YEAR / factor / 1000
    reached = nodes.select("transformer_id", "node", F.lit(True).alias("hit"))
    con = con.withColumns({"p_mw": mw, "from_curve": F.col("own").isNotNull()}).join(reached, ["transformer_id", "node"], "left")
    return con.select("transformer_id", "load_id", "node", "phases", "p_mw", (F.col("p_mw") * math.tan(math.acos(power_factor))).alias("q_mvar"), "from_curve", F.col("hit").isNotNull().alias("attached"))


def report(edges: DataFrame, nodes: DataFrame, load_rows: DataFrame, self_loops: DataFrame, max_dropped: float = 0.05) -> DataFrame:
    """Counts and the first error of each transformer's feeder."""
    key = ["transformer_id"]
    kept = edges.join(nodes.select("transformer_id", F.col("node").alias("a")), [*key, "a"], "left_semi")
    lines = kept.groupBy(*key).agg(F.count("*").alias("lines"), F.count_if("is_default").alias("default_conductors"), F.count_if(F.col("r_ohm_per_km").isNull()).alias("no_conductor"))
    ends = edges.select("transformer_id", F.explode(F.array("a", "b")).alias("node")).distinct().groupBy(*key).agg(F.count("*").alias("ends"))
    reached = nodes.groupBy(*key).agg(F.count("*").alias("buses"))
    on = load_rows.groupBy(*key).agg(
        F.count_if("attached").alias("loads"), F.count_if(~F.col("attached")).alias("consumers_not_in_network"), F.count_if(F.col("attached") & F.col("from_curve")).alias("load_factor_from_curve"),
        *(F.count_if(F.col("attached") & (F.col("phases") == n)).alias(f"loads_{n}_phase") for n in (1, 2, 3)), F.count_if(F.col("p_mw").isNull()).alias("no_load_factor"),
        F.coalesce(F.sum(F.when(~F.col("attached"), F.col("p_mw"))) / F.sum("p_mw"), F.lit(0.0)).alias("dropped_share"),
    )
    loops = self_loops.groupBy(F.col("UNI_TR_MT").alias("transformer_id")).agg(F.count("*").alias("self_loops"))
    out = reached.join(lines, key, "left").join(ends, key, "left").join(on, key, "left").join(loops, key, "left").na.fill(0)
    error = F.when(F.col("lines") == 0, "no segment is connected").when(F.col("no_conductor") > 0, "branches without conductor data").when(F.col("loads") + F.col("consumers_not_in_network") == 0, "no consumer with energy")
    error = error.when(F.col("no_load_factor") > 0, "consumers without a load curve: pass load_factor").when(F.col("dropped_share") > max_dropped, "too much load is not in the network")
    return out.withColumns({"islanded_nodes": F.greatest(F.col("ends") - F.col("buses"), F.lit(0)), "loops": F.greatest(F.col("lines") - (F.col("buses") - 1), F.lit(0)), "error": error}).drop("ends")


def phase_shares(customers: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Shares of three phases' loads (a third each without load), the dominant phase and the balanced equivalent."""
    total = F.abs(a) + F.abs(b) + F.abs(c)
    share = lambda p: F.coalesce(F.abs(p) / F.nullif(total, F.lit(0.0)), F.lit(1 / 3))
    top = F.greatest(F.abs(a), F.abs(b), F.abs(c))
    dominant = F.when(F.abs(a) == top, "a").when(F.abs(b) == top, "b").otherwise("c")
    return customers.withColumns({"share_a": share(a), "share_b": share(b), "share_c": share(c), "dominant": dominant, "balanced": (F.col(a) + F.col(b) + F.col(c)) / 3})


def voltage_scope(buses: DataFrame, slack: DataFrame, generators: DataFrame, level_kv: float) -> DataFrame:
    """In-service buses of a voltage level that neither the source nor a generator holds."""
    near = F.abs(F.col("vn_kv") - level_kv) <= 1e-6 * F.greatest(F.abs("vn_kv"), F.lit(level_kv))
    return buses.filter(F.col("in_service") & near).join(slack, ["network", "bus_id"], "left_anti").join(generators, ["network", "bus_id"], "left_anti")


def risk_order(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of the steps by PV over load, the most risky first."""
    return steps.withColumn("risk_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.col("pv_mult") / F.col("load_mult")), "step")))
