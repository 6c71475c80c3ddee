"""PV and load states of networks as columns: a basis by bus, PV at a scale, loads at a multiplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def proportional_to_load(loads: DataFrame) -> DataFrame:
    """``network, bus_id, base_mw``: the loads (``p_mw``) of each bus together."""
    return loads.groupBy("network", "bus_id").agg(F.sum("p_mw").alias("base_mw"))


def pv_at(basis: DataFrame, scales: DataFrame) -> DataFrame:
    """``network, bus_id, lambda, p_mw, q_mvar`` at each of a network's scales (``network``, ``lambda``, ``pv_mult``); unity power factor."""
    return basis.join(scales, "network").select("network", "bus_id", "lambda", (F.col("base_mw") * F.col("lambda") * F.col("pv_mult")).alias("p_mw"), F.lit(0.0).alias("q_mvar"))


def scale_loads(loads: DataFrame, scale: float) -> DataFrame:
    """Active and reactive power times ``scale``; the power factor stays."""
    if scale <= 0:
        raise ValueError(f"a load scale must be positive, not {scale}")
    return loads.withColumns({c: F.col(c) * scale for c in ("p_mw", "q_mvar")})


def multiply_loads(loads: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Each load (``network, load_id``) times its own ``mult``; a load without one, or one below 0, fails the job."""
    m = F.col("mult")
    checked = F.when(m >= 0, m).otherwise(F.raise_error(F.concat(F.lit("no multiplier of 0 or more for load "), F.col("load_id").cast("string"))).cast("double"))
    return loads.join(multipliers, ["network", "load_id"], "left").withColumns({c: F.col(c) * checked for c in ("p_mw", "q_mvar")}).drop("mult")
