"""The end-to-end contract of a loaded warehouse, checked on the way.

Each table carries an ``Observation`` while it is written or counted, so all nine
checks take the pass that the tables take anyway.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .assertions import METHODS

#: The network of which these buses are held by the source and generators, and the networks that are simulated at least.
HELD_NETWORK, HELD_BUSES, LEAST_NETWORKS = "case14", (0, 1, 2, 5, 7), 2


def _n(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def _measures(method_names=METHODS) -> dict[str, dict[str, Column]]:
    """What is observed of each table, by name."""
    power, status = F.col("total_pv_mw_comparable"), F.col("status")
    finite = (power > 0) & (power < float("inf"))
    open_ = F.col("hc_lambda_ci_low").isNull() & (F.col("method") == "stochastic")
    held = (F.col("network") == HELD_NETWORK) & F.col("bus_id").isin(*HELD_BUSES)
    return {
        "bronze": {"rows": F.count("*")},
        "results": {
            **{f"comparable_{m}": _n(F.col("is_comparable") & (F.col("method") == m)) for m in method_names},
            "infeasible": _n(status == "baseline_infeasible"), "infeasible_shown": _n((status == "baseline_infeasible") & power.isNotNull()),
            "not_positive": _n(F.col("is_comparable") & ~F.coalesce(finite, F.lit(False))),
            "open_comparable": _n(open_ & F.col("is_comparable")), "open_gated": _n(open_ & ~F.col("is_comparable") & (status == "ok")),
        },
        # of the networks only "fewer than two" is asked for: the smallest and the largest name say that
        "voltage": {"first": F.min("network"), "last": F.max("network"), "no_limits": _n(F.col("v_min_pu").isNull()), "held_in_scope": _n(held & F.col("in_scope")), "held_flagged": _n(held & F.col("is_violation"))},
        "daily": {"rows": F.count("*")},
    }


@dataclass
class Contract:
    """``watch`` each of the tables ``bronze``, ``results``, ``voltage`` and ``daily``, use what it returns once, then ask for ``checks``."""

    methods: tuple[str, ...] = METHODS
    seen: dict[str, Observation] = field(default_factory=dict)

    def watch(self, name: str, table: DataFrame) -> DataFrame:
        self.seen[name] = Observation(name)
        return table.observe(self.seen[name], *(c.alias(n) for n, c in _measures(self.methods)[name].items()))

    def checks(self) -> dict[str, tuple[bool, str]]:
        """By check: whether it holds, and the figures that say so."""
        missing = sorted(set(_measures()) - set(self.seen))
        if missing:
            raise ValueError(f"not watched: {', '.join(missing)}")
        b, r, v, d = (self.seen[n].get for n in ("bronze", "results", "voltage", "daily"))
        several = v["first"] != v["last"] if LEAST_NETWORKS == 2 else None
        absent = [m for m in self.methods if not r[f"comparable_{m}"]]
        return {
            "telemetry is landed": (b["rows"] > 0, f"{b['rows']} rows"),
            "every method has a comparable row": (not absent, f"without: {', '.join(absent) or 'none'}"),
            "an infeasible baseline is recorded and never a capacity": (r["infeasible"] >= 1 and r["infeasible_shown"] == 0, f"{r['infeasible']} recorded, {r['infeasible_shown']} shown"),
            "comparable capacities are positive and finite": (r["not_positive"] == 0, f"{r['not_positive']} are not"),
            "stochastic rows are comparable only with an interval": (r["open_comparable"] == 0 and r["open_gated"] >= 1, f"{r['open_comparable']} without one, {r['open_gated']} held back"),
            "every simulated network has voltages": (bool(several), f"{v['first']} to {v['last']}"),
            "every voltage has limits": (v["no_limits"] == 0, f"{v['no_limits']} have none"),
            "held buses are out of scope and never flagged": (v["held_in_scope"] == 0 and v["held_flagged"] == 0, f"{v['held_in_scope']} in scope, {v['held_flagged']} flagged"),
            "daily figures are there": (d["rows"] > 0, f"{d['rows']} rows"),
        }


def report(spark: SparkSession, checks: dict[str, tuple[bool, str]]) -> DataFrame:
    """``check, holds, figures``: nine rows."""
    return spark.createDataFrame([(name, *found) for name, found in checks.items()], "check string, holds boolean, figures string")


def chunked_by_day(spark: SparkSession, *paths: str) -> list[str]:
    """Of the tables' folders those that are not in chunks of days."""
    return [p for p in paths if "day" not in spark.read.parquet(p).columns]
