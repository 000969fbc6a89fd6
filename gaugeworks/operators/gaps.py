"""Filling missing cells and putting series on a regular clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import epoch
from gaugeworks.functions.columns import flag
from gaugeworks.operators.slices import with_carry


def _brackets(df: DataFrame, columns: Sequence[str], sensor: Sequence[str], order: Sequence[str], budget: int | None) -> DataFrame:
    known = {c: F.when(F.col(c).isNotNull(), F.struct(epoch(order[0]).alias("t"), F.col(c).cast("double").alias("v"))) for c in columns}
    return with_carry(df, sensor, order, known, budget)


def interpolate_linear(df: DataFrame, columns: Sequence[str], sensor: Sequence[str], order: Sequence[str],
                       max_gap_seconds: int | None = 3600, budget: int | None = None) -> DataFrame:
    """Fill NULL cells on the line between the two nearest readings of the sensor if they are close enough in time."""
    if max_gap_seconds is not None and max_gap_seconds <= 0:
        raise ValueError("max_gap_seconds must be positive")
    out = _brackets(df, columns, sensor, order, budget)
    t = epoch(order[0])
    for c in columns:
        a, b = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        gap = b["t"] - a["t"]
        fill = flag(F.col(c).isNull() & (gap > 0) & ((gap <= max_gap_seconds) if max_gap_seconds else F.lit(True)))
        line = a["v"] + F.try_divide((t - a["t"]).cast("double"), gap.cast("double")) * (b["v"] - a["v"])
        out = out.withColumns({f"{c}_imputed": fill, c: F.when(fill, line).otherwise(F.col(c))})
    return out.drop(*[f"{p}_{c}" for c in columns for p in ("_prev", "_next")])


def fill_forward(df: DataFrame, columns: Sequence[str], sensor: Sequence[str], order: Sequence[str],
                 max_gap_hours: float = 6, budget: int | None = None) -> DataFrame:
    """Carry the last reading forward for a limited time into ``<c>_filled``."""
    out = _brackets(df, columns, sensor, order, budget)
    for c in columns:
        last = F.col(f"_prev_{c}")
        near = (epoch(order[0]) - last["t"]) / 3600 <= max_gap_hours
        filled = F.when(F.col(c).isNull() & flag(near), last["v"]).otherwise(F.col(c))
        out = out.withColumns({f"{c}_filled": filled, f"{c}_interpolated": F.col(c).isNull() & filled.isNotNull()})
    return out.drop(*[f"{p}_{c}" for c in columns for p in ("_prev", "_next")])


def fill_calendar(daily: DataFrame, day: str, by: Sequence[str] = ()) -> DataFrame:
    """Every calendar day between the first and last, missing days with NULLs. Input: one row per group and day."""
    ends = daily.groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_z")).filter(F.col("_a").isNotNull())
    days = ends.select(*by, F.explode(F.sequence("_a", "_z", F.expr("interval 1 day"))).alias(day))
    return days.join(daily, [*by, day], "left")


def resample(means: DataFrame, time: str, value: str, start: str, end: str, step_minutes: int = 5) -> DataFrame:
    """Regular clock from ``start`` to ``end`` inclusive with linear interpolation in time.

    ``means`` has one row per timestamp. Clock points before the first reading are dropped, those after the last one
    keep its value. Only readings that fall on clock points take part. The clock is cut into days; each day needs
    just its own points and the nearest values outside, which are found on one row per day.
    """
    spark = means.sparkSession
    ends = spark.range(1).select(F.lit(start).cast("timestamp").alias("a"), F.lit(end).cast("timestamp").alias("z"))
    clock = ends.select(F.explode(F.sequence(F.date_trunc("day", "a"), F.date_trunc("day", "z"), F.expr("interval 1 day"))).alias("_d"), "a", "z")
    clock = clock.select("_d", F.explode(F.sequence(
        F.greatest("_d", "a"), F.least(F.col("_d") + F.expr("interval 1 day") - F.expr("interval 1 second"), F.col("z")),
        F.expr(f"interval {step_minutes} minutes"))).alias(time))
    readings = means.select(F.col(time).cast("timestamp").alias(time), F.col(value).cast("double").alias(value))
    grid = clock.join(readings, time, "left").withColumn(
        "_k", F.when(F.col(value).isNotNull(), F.struct(epoch(time).alias("t"), F.col(value).alias("v"))))
    edges = grid.groupBy("_d").agg(F.max("_k").alias("_tail"), F.min("_k").alias("_head"))
    days = Window.orderBy("_d")  # one row per day
    edges = edges.select("_d", F.last("_tail", True).over(days.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
                         F.first("_head", True).over(days.rowsBetween(1, Window.unboundedFollowing)).alias("_out"))
    w = Window.partitionBy("_d").orderBy(time)
    out = grid.withColumns({
        "_p": F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.first("_k", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    }).join(edges, "_d").withColumns({"_p": F.coalesce("_p", "_in"), "_n": F.coalesce("_n", "_out")})
    a, b, t = F.col("_p"), F.col("_n"), epoch(time)
    line = F.when(b.isNull(), a["v"]).when(a["t"] == b["t"], a["v"]).otherwise(
        a["v"] + F.try_divide((t - a["t"]).cast("double"), (b["t"] - a["t"]).cast("double")) * (b["v"] - a["v"]))
    return out.filter(a.isNotNull()).select(time, line.alias(value))
