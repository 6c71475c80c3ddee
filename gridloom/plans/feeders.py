"""Queries over register layers: Spark writes them as files out of the driver's tables, and the conversion reads these."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocation, feeder, studies
from ..session import shared_folder
from ..sources import layers
from .catalogue import query, read

#: Where a session's layers lie, written once for each folder of tables.
_WRITTEN: dict[tuple[str, str], str] = {}

#: Rows of a layer's file.
ROWS_PER_FILE = 500_000

_TEXT = lambda c: c.cast("string")


def _layers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A transformer a supplier; its parts, folded into 64, are the nodes of a binary tree of which some branches are missing; order lines are consumers."""
    key = (spark.sparkContext.applicationId, d)
    if key in _WRITTEN:
        return layers.read_layers(spark, _WRITTEN[key]) | {"__path": _WRITTEN[key]}
    path = f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}"
    s = F.col("s_suppkey")
    of = lambda k: F.concat(F.lit("T"), _TEXT(k))
    node = lambda k, n: F.concat(of(k), F.lit("n"), _TEXT(n))
    suppliers, lines = read(spark, d, "supplier"), read(spark, d, "lineitem")
    total = F.when(s % 4 == 0, "").otherwise(_TEXT(50 + s % 3 + 200 * (s % 5 + 1)))
    made = {
        "UNTRMT": suppliers.select(of(s).alias("COD_ID"), F.concat(F.lit("M"), _TEXT(s)).alias("PAC_1"), node(s, F.lit(0)).alias("PAC_2"), F.when(s % 11 == 0, "").otherwise(_TEXT(15 * (s % 5 + 1))).alias("POT_NOM"), _TEXT(50 + s % 3).alias("PER_FER"), total.alias("PER_TOT")),
        "EQTRMT": suppliers.filter(s % 2 == 0).select(F.concat(F.lit("Q"), _TEXT(s)).alias("COD_ID"), of(s).alias("UNI_TR_MT"), F.lit("1,0").alias("R"), F.lit("3.5").alias("XHL")),
        "SEGCON": read(spark, d, "nation").filter("n_nationkey < 4").select(F.concat(F.lit("C"), _TEXT(F.col("n_nationkey"))).alias("COD_ID"), F.when(F.col("n_nationkey") == 3, "").otherwise("0.4").alias("R1"), F.lit("0.08").alias("X1"), F.lit("100").alias("CNOM")),
    }
    k, n = F.col("l_suppkey"), F.col("l_partkey") % 64
    edge = lines.select(k.alias("k"), n.alias("n")).distinct()
    up = F.when(F.col("n") == 0, 0).otherwise(F.floor((F.col("n") - 1) / 2))
    made["SSDBT"] = edge.select(
        F.concat(F.lit("E"), _TEXT(F.col("n"))).alias("COD_ID"), node(F.col("k"), up).alias("PAC_1"), node(F.col("k"), F.col("n")).alias("PAC_2"), F.concat(F.lit("C"), _TEXT(F.col("n") % 4)).alias("TIP_CND"),
        _TEXT(F.col("n") % 13 * 10).alias("COMP"), of(F.col("k")).alias("UNI_TR_MT"),
    )
    line = F.col("l_linenumber")
    phase = F.when(line % 4 == 0, "ABCN").when(line % 4 == 1, "A").when(line % 4 == 2, "BC").otherwise("")
    months = [F.lit("").alias(m) if m == "ENE_11" else F.lit("-1").alias(m) if m == "ENE_12" else _TEXT(F.col("l_quantity")).alias(m) for m in feeder.MONTHS]
    made["UCBT_tab"] = lines.select(
        F.concat(F.lit("L"), _TEXT(F.col("l_orderkey") * 8 + line)).alias("COD_ID"), F.when(line == 7, "nowhere").otherwise(node(k, n)).alias("PAC"), of(k).alias("UNI_TR_MT"), phase.alias("FAS_CON"), F.concat(F.lit("K"), _TEXT(line % 3)).alias("TIP_CC"), *months,
    )
    made["UGBT_tab"] = lines.filter("l_returnflag = 'R' and l_linenumber = 1").select(F.concat(F.lit("G"), _TEXT(F.col("l_orderkey"))).alias("COD_ID"), node(k, n).alias("PAC"), of(k).alias("UNI_TR_MT"), F.lit("5").alias("POT_INST"))
    o = F.col("o_orderkey")
    points = [_TEXT(F.round(F.avg(F.when(o % 96 == q, F.col("o_totalprice"))), 3)).alias(c) for q, c in enumerate(feeder.CURVE)]
    made["CRVCRG"] = read(spark, d, "orders").groupBy(F.concat(F.lit("K"), _TEXT(F.floor(o / 96) % 2)).alias("COD_ID")).agg(*points)
    for name, rows in made.items():
        # compressed files are read whole, so each holds few rows
        rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).csv(f"{path}/{name}.csv", header=True, sep=";" if name in ("SSDBT", "EQTRMT") else ",", compression="gzip")
    _WRITTEN[key] = path
    return layers.read_layers(spark, path) | {"__path": path}


_LAYER_SQL = """edge as (select distinct l_suppkey as k, l_partkey % 64 as n from lineitem),
consumer as (select l_suppkey as k, l_partkey % 64 as n, l_linenumber as ln, 12 * l_quantity as kwh from lineitem)"""
_REACH = """reach(k, n, parent, depth) as (select s_suppkey, 0::bigint, null::bigint, 0 from supplier union all select e.k, e.n, r.n, r.depth + 1 from reach r join edge e on e.k = r.k and e.n > 0 and (e.n - 1) // 2 = r.n)"""


@query(f"""with {_LAYER_SQL} select 'T' || s_suppkey as transformer_id, case when s_suppkey % 11 = 0 then 0 else 15.0 * (s_suppkey % 5 + 1) end::double as rated_kva, coalesce(segs, 0) as lv_segments, round(coalesce(km, 0), 6)::double as lv_length_km,
coalesce(cons, 0) as consumers, round(coalesce(mwh, 0), 6)::double as annual_mwh, coalesce(gens, 0) as generators from supplier left join (select k, count(*) as segs, sum(n % 13 * 10) / 1000.0 as km from edge group by 1) e on e.k = s_suppkey
left join (select k, count(*) as cons, sum(kwh) / 1000 as mwh from consumer group by 1) c on c.k = s_suppkey left join (select l_suppkey as k, count(*) as gens from lineitem where l_returnflag = 'R' and l_linenumber = 1 group by 1) g on g.k = s_suppkey""")
def feeder_transformers(spark, d):
    found = _layers(spark, d)
    made = feeder.list_transformers(found["UNTRMT"], found["SSDBT"], found["UCBT_tab"], found["UGBT_tab"])
    return made.withColumns({c: F.round(c, 6) for c in ("lv_length_km", "annual_mwh")})


@query("""with t as (select s_suppkey as s, case when s_suppkey % 11 <> 0 then 15.0::double * (s_suppkey % 5 + 1) end as kva, (50 + s_suppkey % 3)::double as iron, case when s_suppkey % 4 <> 0 then 50 + s_suppkey % 3 + 200.0::double * (s_suppkey % 5 + 1) end as total from supplier),
m as (select *, case when s % 2 = 0 then 1.0::double else coalesce((total - iron) / (kva * 1000) * 100, 1.5::double) end as vkr, case when s % 2 = 0 then sqrt(1.0::double + 3.5::double * 3.5::double) else 1.4::double end as vk from t)
select 'T' || s as transformer_id, kva, round(vk, 9) as vk_percent, round(vkr, 9) as vkr_percent, case when s % 2 = 0 then 'equipment' when (total - iron) / kva is not null then 'copper losses' else 'options' end as source,
case when kva is null then 'invalid rated power' when vkr >= vk then 'vkr_percent must be below vk_percent' end as error from m""")
def feeder_impedances(spark, d):
    found = _layers(spark, d)
    made = feeder.impedance(found["UNTRMT"], found["EQTRMT"], vk_percent=1.4, vkr_percent=1.5).drop("iron_kw")
    return made.withColumns({c: F.round(c, 9) for c in ("vk_percent", "vkr_percent")})


def _roots(found: dict[str, DataFrame]) -> DataFrame:
    return found["UNTRMT"].select(F.col("COD_ID").alias("transformer_id"), F.col("PAC_2").alias("node"))


def _branches(found: dict[str, DataFrame]) -> DataFrame:
    return feeder.branches(found["SSDBT"], None, found["SEGCON"], default=(1.0, 0.1, 50.0))


@query(f"with recursive {_LAYER_SQL}, {_REACH} select 'T' || k as transformer_id, 'T' || k || 'n' || n as node, 'T' || k || 'n' || parent as parent, depth from reach")
def feeder_reach(spark, d):
    """What each transformer's secondary side reaches, by which node and how far."""
    found = _layers(spark, d)
    return feeder.connected(_branches(found), _roots(found))


_CURVE_SQL = """point as (select o_orderkey // 96 % 2 as c, o_orderkey % 96 as q, round(avg(o_totalprice), 3) as v from orders group by all), curve as (select 'K' || c as code, avg(v) / max(v) as f from point group by 1)"""


@query(f"""with recursive {_LAYER_SQL}, {_REACH}, {_CURVE_SQL},
l as (select c.*, kwh / 8760.0 / coalesce(f, 0.5) / 1000 as mw, f is not null as from_curve, r.n is not null and ln <> 7 as attached, case ln % 4 when 1 then 1 when 2 then 2 else 3 end as ph from consumer c left join curve on code = 'K' || (ln % 3) left join reach r on r.k = c.k and r.n = c.n),
b as (select k, count(*) as buses from reach group by 1), ends as (select k, count(*) as n from (select k, n from edge where n > 0 union select k, (n - 1) // 2 from edge where n > 0) group by 1),
e as (select e.k, count(*) as lines, count(*) filter (e.n % 4 = 3) as dflt from edge e join reach r on r.k = e.k and r.n = (e.n - 1) // 2 where e.n > 0 group by 1), s as (select k, count(*) as self_loops from edge where n = 0 group by 1),
g as (select k, count(*) filter (attached) as loads, count(*) filter (not attached) as away, count(*) filter (attached and from_curve) as curved, count(*) filter (attached and ph = 1) as p1, count(*) filter (attached and ph = 2) as p2, count(*) filter (attached and ph = 3) as p3, coalesce(sum(mw) filter (not attached) / sum(mw), 0) as dropped from l group by 1)
select 'T' || b.k as transformer_id, buses, coalesce(lines, 0) as lines, coalesce(dflt, 0) as default_conductors, 0::bigint as no_conductor, coalesce(loads, 0) as loads, coalesce(away, 0) as consumers_not_in_network, coalesce(curved, 0) as load_factor_from_curve, coalesce(p1, 0) as loads_1_phase, coalesce(p2, 0) as loads_2_phase,
coalesce(p3, 0) as loads_3_phase, 0::bigint as no_load_factor, round(coalesce(dropped, 0), 9) as dropped_share, coalesce(self_loops, 0) as self_loops, greatest(coalesce(ends.n, 0) - buses, 0) as islanded_nodes, greatest(coalesce(lines, 0) - (buses - 1), 0) as loops,
case when coalesce(lines, 0) = 0 then 'no segment is connected' when coalesce(loads, 0) + coalesce(away, 0) = 0 then 'no consumer with energy' when dropped > 0.4 then 'too much load is not in the network' end as error
from b left join e using (k) left join ends using (k) left join s using (k) left join g using (k)""")
def feeder_report(spark, d):
    """Every feeder converted, and what of it is wrong."""
    found = _layers(spark, d)
    edges = _branches(found)
    nodes = feeder.connected(edges, _roots(found))
    rows = feeder.loads(found["UCBT_tab"], found["CRVCRG"], nodes, load_factor=0.5)
    made = feeder.report(edges, nodes, rows, found["SSDBT"].filter("PAC_1 = PAC_2"), max_dropped=0.4)
    return made.withColumn("dropped_share", F.round("dropped_share", 9))


@query("""select * from (values ('SSDBT', true), ('UNTRMT', true), ('SEGCON', true), ('UCBT_tab', true), ('RAMLIG', false), ('EQTRMT', false), ('UGBT_tab', false), ('CRVCRG', false), ('MORE', true)) v(layer, needed)
join (select 'SSDBT' as layer, count(*) as n_rows from (select distinct l_suppkey, l_partkey % 64 from lineitem) union all select 'UNTRMT', count(*) from supplier union all select 'SEGCON', count(*) from nation where n_nationkey < 4 union all select 'UCBT_tab', count(*) from lineitem
union all select 'RAMLIG', 0 union all select 'EQTRMT', count(*) from supplier where s_suppkey % 2 = 0 union all select 'UGBT_tab', count(*) from lineitem where l_returnflag = 'R' and l_linenumber = 1 union all select 'CRVCRG', count(distinct o_orderkey // 96 % 2) from orders union all select 'MORE', 0) using (layer)
join (select unnest(['SSDBT', 'UNTRMT', 'SEGCON', 'UCBT_tab', 'RAMLIG', 'EQTRMT', 'UGBT_tab', 'CRVCRG', 'MORE']) as layer, unnest([true, false, true, true, true, true, true, true, false]) as ready) using (layer)""")
def layer_inspection(spark, d):
    """All layers by one job; one lacks a column that is asked for, one is not there."""
    need = dict(layers.REQUIRED) | {"UNTRMT": [*layers.REQUIRED["UNTRMT"], "TEN_LIN_SE"], "MORE": []}
    return layers.inspect(spark, _layers(spark, d)["__path"], need).select("layer", "needed", "n_rows", "ready")


# --- loads, phases, orders of risk, summaries ------------------------------------------------------------------------


@query("""select l_suppkey % 7 as network, l_partkey as load_id, round(sum(l_quantity) * 0.5 * (l_partkey % 3), 6) as p_mw, round(sum(l_quantity) / 10 * 0.5 * (l_partkey % 3), 6) as q_mvar from lineitem group by 1, 2""")
def loads_scaled(spark, d):
    """Loads times a scale and their own multipliers."""
    p = F.sum("l_quantity")
    loads = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("network"), F.col("l_partkey").alias("load_id")).agg(p.alias("p_mw"), (p / 10).alias("q_mvar"))
    own = loads.select("network", "load_id", (F.col("load_id") % 3).cast("double").alias("mult"))
    return allocation.multiply_loads(allocation.scale_loads(loads, 0.5), own).withColumns({c: F.round(c, 6) for c in ("p_mw", "q_mvar")})


@query("""with p as (select l_suppkey as customer, sum(case when l_linenumber % 3 = 0 and l_suppkey % 10 > 0 then l_quantity else 0 end) as a, sum(case when l_linenumber % 3 = 1 and l_suppkey % 10 > 0 then -l_quantity else 0 end) as b, sum(case when l_linenumber % 3 = 2 and l_suppkey % 10 > 0 then l_quantity else 0 end) as c from lineitem group by 1)
select customer, round(coalesce(abs(a) / nullif(abs(a) + abs(b) + abs(c), 0), 1 / 3), 9) as share_a, round(coalesce(abs(b) / nullif(abs(a) + abs(b) + abs(c), 0), 1 / 3), 9) as share_b, round(coalesce(abs(c) / nullif(abs(a) + abs(b) + abs(c), 0), 1 / 3), 9) as share_c,
case when abs(a) >= abs(b) and abs(a) >= abs(c) then 'a' when abs(b) >= abs(c) then 'b' else 'c' end as dominant, round((a + b + c) / 3, 9) as balanced from p""")
def phase_loads(spark, d):
    """Customers' loads by phase: shares, the dominant phase, the balanced equivalent; some have none."""
    line, on = F.col("l_linenumber") % 3, F.col("l_suppkey") % 10 > 0
    of = lambda k, sign: F.sum(F.when((line == k) & on, sign * F.col("l_quantity")).otherwise(0.0))
    p = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("customer")).agg(of(0, 1).alias("a"), of(1, -1).alias("b"), of(2, 1).alias("c"))
    made = feeder.phase_shares(p, "a", "b", "c")
    return made.select("customer", *(F.round(f"share_{x}", 9).alias(f"share_{x}") for x in "abc"), "dominant", F.round("balanced", 9).alias("balanced"))


@query("""with s as (select event_type, date_trunc('hour', ts) as step, round(avg(value) + 1, 6) as load_mult, round(avg(user_id % 50) / 50, 6) as pv_mult from events group by all)
select event_type, step, row_number() over (partition by event_type order by pv_mult / load_mult desc, step)::int as risk_rank from s""")
def risk_ranks(spark, d):
    from .studies import _steps

    return feeder.risk_order(_steps(spark, d), ["event_type"]).select("event_type", "step", "risk_rank")


@query("""with w as (select o_custkey % 52 as win, min(o_totalprice) / 1e5 as capacity, o_custkey % 52 % 4 <> 3 as bounded from orders group by 1, 3), b as (select * from w where bounded)
select round((select min(capacity) from b), 9) as capacity, (select win from b order by capacity, win limit 1) as critical_window, round((select quantile_cont(capacity, 0.1) from b), 9) as p10, round((select quantile_cont(capacity, 0.5) from b), 9) as p50, round((select quantile_cont(capacity, 0.9) from b), 9) as p90, (select count(*) from w where not bounded) as censored""")
def annual_capacity(spark, d):
    """The year's capacity out of its weeks, those without an end left out of the spread."""
    win = F.col("o_custkey") % 52
    weeks = read(spark, d, "orders").groupBy(win.alias("win")).agg((F.min("o_totalprice") / 1e5).alias("capacity")).withColumn("bounded", F.col("win") % 4 != 3)
    made = studies.annual(weeks)
    return made.withColumns({c: F.round(c, 9) for c in ("capacity", "p10", "p50", "p90")})


@query("""with x as (select case when l_suppkey % 9 <> 0 then l_suppkey % 9 end as study, l_extendedprice as v, l_linenumber <> 7 as bounded from lineitem)
select study, count(*) filter (not bounded) as censored, count(*) as scenarios, quantile_disc(v, 0.1) as "lambda" from x group by 1""")
def stochastic_studies(spark, d):
    """Capacities of many scenarios by study, one study without a name; the interval's ends have their own query."""
    x = read(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey") % 9).alias("study"), F.col("l_extendedprice").alias("lambda_max"), (F.col("l_linenumber") != 7).alias("bounded"))
    return studies.stochastic(x, ["study"]).select("study", "censored", "scenarios", "lambda")


@query("""select "lambda", round(avg((l_extendedprice < "lambda")::int), 9) as p from lineitem, (values (5000.0::double), (20000.0::double), (60000.0::double)) v("lambda") group by 1""")
def violation_curve(spark, d):
    made = studies.violation_probability(read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("lambda_max")), [5000.0, 20000.0, 60000.0])
    return made.withColumn("p", F.round("p", 9))
