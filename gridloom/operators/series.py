"""Time-series operators over long tables (series key, timestamp, value).

Every one is a shuffle on the series key at most; windows are partitioned by
series.  Regular grids come from ``sequence``, so their size follows the span of
each series, not of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import null_safe_join


#: Steps of a series that a row or a window holds at once.
LOT = 10_000


def _unix(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts))


def regularize(df: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """Drop null stamps, average repeated ones, drop those off the grid of the first, and complete the grid."""
    clean = df.filter(F.col(ts).isNotNull()).groupBy(key, ts).agg(F.avg(value).alias(value))
    span = clean.groupBy(key).agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"))
    steps = F.floor((_unix("__last") - _unix("__first")) / seconds)
    # lots of steps become rows before steps do, so no row holds a whole series' grid
    lots = span.select(key, "__first", steps.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), steps, F.lit(LOT).cast("long"))).alias("__lot"))
    places = lots.select(key, "__first", F.explode(F.sequence(F.col("__lot"), F.least(F.col("__lot") + LOT - 1, F.col("__n")))).alias("__k"))
    step = F.make_dt_interval(secs=(F.col("__k") * seconds).cast("decimal(18,6)"))
    return places.select(key, (F.col("__first") + step).alias(ts)).join(clean, [key, ts], "left")


def interpolate_short(df: DataFrame, key: str, ts: str, value: str, longest: int, seconds: int, lot: int = LOT) -> DataFrame:
    """Fill inner runs of at most ``longest`` nulls of a regular grid on a straight line in time; adds ``filled``.

    A window is a lot of ``lot`` steps with the ``longest + 1`` steps on either
    side that can matter to it, so a long series is many tasks'.
    """
    width, near = lot * seconds, (longest + 1) * seconds
    own = F.floor(_unix(ts) / width)
    # lots may be shorter than what a gap reaches over, so a row can matter to several
    first, last = F.floor((_unix(ts) - near) / width), F.floor((_unix(ts) + near) / width)
    spread = df.withColumn("__own", own).withColumn("__lot", F.explode(F.sequence(first, last)))
    cut = [key, "__lot"]
    w = Window.partitionBy(*cut).orderBy(ts)
    # a frame that runs to the end is evaluated anew for each row, so the next value is the last one in descending order
    up, down = (v.rowsBetween(Window.unboundedPreceding, 0) for v in (w, Window.partitionBy(*cut).orderBy(F.desc(ts))))
    known = F.when(F.col(value).isNotNull(), F.struct(_unix(ts).alias("t"), F.col(value).alias("v"), F.row_number().over(w).alias("n")))
    around = spread.withColumn("__k", known).withColumns({"__a": F.last("__k", True).over(up), "__b": F.last("__k", True).over(down)})
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (_unix(ts) - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t"))
    short = F.col(value).isNull() & (F.col("__b.n") - F.col("__a.n") - 1 <= longest)
    own_rows = around.withColumn("filled", F.coalesce(short, F.lit(False))).filter("__lot = __own")
    return own_rows.withColumn(value, F.when(F.col("filled"), line).otherwise(F.col(value))).drop("__k", "__a", "__b", "__own", "__lot")


def runs(df: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Number the runs of equal values (nulls are equal) as ``run``."""
    w = Window.partitionBy(key).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("__new", change.cast("int")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def runs_by_chunk(df: DataFrame, key: str, order: list, value: str, chunk: Column) -> DataFrame:
    """:func:`runs` of long series, a chunk a window.

    ``chunk`` never falls as the order rises (a day of the stamp, say).  Runs are
    numbered within chunks; a row a chunk then tells how many there were before,
    and whether the first one goes on from the chunk before.
    """
    chunked = df.withColumn("__c", chunk)
    w = Window.partitionBy(key, "__c").orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) & (F.row_number().over(w) > 1)
    inner = chunked.withColumn("__new", change.cast("int")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    place = F.struct(*order)
    ends = chunked.groupBy(key, "__c").agg(F.min_by(F.struct(value), place).alias("__first"), F.max_by(F.struct(value), place).alias("__last"))
    about = null_safe_join(ends, inner.groupBy(key, "__c").agg((F.max("run") + 1).alias("__runs")), [key, "__c"])
    by_chunk = Window.partitionBy(key).orderBy("__c")
    goes_on = F.col("__first").eqNullSafe(F.lag("__last").over(by_chunk)) & (F.row_number().over(by_chunk) > 1)
    before = F.coalesce(F.sum("__own").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = about.withColumn("__joins", goes_on.cast("int")).withColumn("__own", F.col("__runs") - F.col("__joins"))
    offsets = counted.withColumn("__before", before - F.col("__joins") + 1).select(key, "__c", "__before")
    return null_safe_join(inner, offsets, [key, "__c"]).withColumn("run", F.col("run") + F.col("__before")).drop("__before", "__c")


def resample_mean(df: DataFrame, key: str, ts: str, value: str, seconds: int, least: int) -> DataFrame:
    """Means of bins aligned to the epoch; null where fewer than ``least`` values are present."""
    bin_ = F.timestamp_seconds(F.floor(_unix(ts) / seconds) * seconds).cast("timestamp_ntz")
    return df.groupBy(key, bin_.alias(ts)).agg(F.count(value).alias("n"), F.when(F.count(value) >= least, F.avg(value)).alias(value))


def hold(df: DataFrame, key: str, ts: str, value: str, rows: int) -> DataFrame:
    """Carry the last value forward over at most ``rows - 1`` rows."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(-(rows - 1), 0)
    return df.withColumn(value, F.last(value, True).over(w))


def climatology(df: DataFrame, key: str, ts: str, value: str, days: int) -> DataFrame:
    """Fill nulls with the median of the same time of day within ``days``; only missing rows are joined."""
    tod = F.date_format(ts, "HH:mm:ss")
    missing = df.filter(F.col(value).isNull()).select(key, F.col(ts).alias("__ts"), tod.alias("__tod"))
    near = df.filter(F.col(value).isNotNull()).select(key, ts, value, tod.alias("__tod"))
    close = F.abs(F.datediff(F.col(ts), F.col("__ts"))) <= days
    fill = missing.join(near, [key, "__tod"]).filter(close).groupBy(key, "__ts").agg(F.median(value).alias("__fill"))
    joined = df.join(fill.withColumnRenamed("__ts", ts), [key, ts], "left")
    return joined.withColumns({"filled": F.col(value).isNull() & F.col("__fill").isNotNull(), value: F.coalesce(value, "__fill")}).drop("__fill")


def numbered(df: DataFrame, key: str, order: str, name: str, width: int = LOT) -> DataFrame:
    """Adds ``name``: each row's place (from 0) in its series by a whole number, nulls last.

    Rows are numbered within ranges of ``width`` numbers; a series meets only as the sizes of its ranges.
    """
    placed = df.withColumn("__range", F.floor(F.col(order) / width))
    within = F.row_number().over(Window.partitionBy(key, "__range").orderBy(F.asc_nulls_last(order))) - 1
    earlier = Window.partitionBy(key).orderBy(F.asc_nulls_last("__range")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(key, "__range").agg(F.count("*").alias("__n")).select(key, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return null_safe_join(placed.withColumn("__in", within), sizes, [key, "__range"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__range", "__in", "__before")


def block_average(df: DataFrame, key: str, step: str, value: str, size: int) -> DataFrame:
    """Mean of each full block of ``size`` steps at every step; a trailing partial block stays as it is."""
    w = Window.partitionBy(key, F.floor(F.col(step) / size))
    return df.withColumn(value, F.when(F.count("*").over(w) == size, F.avg(value).over(w)).otherwise(F.col(value)))


def subset(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """The rows of the wanted series; a series that the table does not have is an error."""
    own = df.filter(F.col(key).isin(wanted))
    missing = sorted(set(wanted) - {r[0] for r in own.select(key).distinct().collect()})  # at most the wanted ones
    if missing:
        raise KeyError(f"unknown series: {', '.join(missing)}")
    return own


def describe(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """``n_series``, ``n_steps``, ``start`` and ``end`` (exclusive) of a table of series."""
    end = (F.max(ts) + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))).alias("end")
    return df.agg(F.count_distinct(key).alias("n_series"), F.count_distinct(ts).alias("n_steps"), F.min(ts).alias("start"), end)


#: The share of the peak below which a load is raised, and the output below which PV is none.
LEAST_LOAD, LEAST_PV = 1e-3, 1e-4


def normalise_load(df: DataFrame, key: str, value: str) -> DataFrame:
    """Loads as shares of each series' peak; those that are not positive become ``LEAST_LOAD``."""
    peak = df.groupBy(key).agg(F.max(value).alias("__peak"))
    share = F.when(F.col(value) > 0, F.col(value) / F.col("__peak")).otherwise(LEAST_LOAD)
    return df.join(peak, key).withColumn(value, F.when(F.col(value).isNotNull() & (F.col("__peak") > 0), share)).drop("__peak")


def normalise_pv(value: Column) -> Column:
    """PV output clipped to 0..1; traces below ``LEAST_PV`` are none."""
    clipped = F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))
    return F.when(clipped < LEAST_PV, 0.0).otherwise(clipped)


def upsample_linear(df: DataFrame, key: str, ts: str, value: str, seconds: int, factor: int) -> DataFrame:
    """A regular series on a grid ``factor`` times finer: straight lines between the midpoints of its intervals.

    Before the first and after the last midpoint, and next to gaps, values are held.
    """
    w = Window.partitionBy(key).orderBy(ts)
    near = lambda v, at: F.when(F.abs(F.unix_timestamp(ts) - F.unix_timestamp(at)) == seconds, v)
    both = df.withColumns({"__a": near(F.lag(value).over(w), F.lag(ts).over(w)), "__b": near(F.lead(value).over(w), F.lead(ts).over(w))})
    rows = both.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    place = (F.col("__k") + 0.5) / factor - 0.5
    other = F.coalesce(F.when(place < 0, F.col("__a")).otherwise(F.col("__b")), F.col(value))
    fine = F.timestamp_seconds(F.unix_timestamp(ts) + F.col("__k") * F.lit(seconds / factor)).cast("timestamp_ntz")
    return rows.select(key, fine.alias(ts), (F.col(value) + (other - F.col(value)) * F.abs(place)).alias(value))
