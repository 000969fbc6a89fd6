"""Ordered per-series windows that stay balanced when one series holds most of the rows.

A plain ``Window.partitionBy(sensor).orderBy(time)`` puts a whole sensor into one task. Here series above a row
budget are cut into time slices of about equal depth, and each slice is given the few neighbouring rows (a halo)
that its frames reach into. Results are identical to the uncut window. Series within the budget are not cut, so
ordinary data pays for one small counting job and nothing else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import DAY_SECONDS, epoch, epoch_micros
from gaugeworks.session import keep

ROW_BUDGET = 4_000_000
"""Rows one task may hold of one series."""

BROADCAST_KEYS = 20_000
"""Most oversized series that are still replicated to every task; beyond it they are joined by shuffle."""

MANY_CUTS = 64
"""Cuts of a series among which a row is still looked up one by one."""

SMALL, TIMELESS = -2, -1
"""Slices of series that are not cut, and of the rows without a time in those that are: they come before slice 0."""

DENSE_ROWS = 2_000
"""Rows of a series from which elapsed-time frames are put together from time buckets instead of being gone through anew for each row."""


def row_budget(df: DataFrame, given: int | None) -> int:
    if given is not None:
        return given
    return int(df.sparkSession.conf.get("spark.gaugeworks.rowBudget", str(ROW_BUDGET)))


def oversized_keys(df: DataFrame, keys: Sequence[str], budget: int, *extra: Column) -> tuple[DataFrame, int, int]:
    """Keys with more rows than the budget, how many there are, and the largest size."""
    big = df.groupBy(*keys).agg(F.count("*").alias("_n"), *extra).filter(F.col("_n") > budget)
    found = big.agg(F.count("*").alias("k"), F.max("_n").alias("n")).first()
    return big.drop("_n"), int(found["k"]), int(found["n"] or 0)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, rows: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``checked_join`` on columns in which NULL is a key like any other; the left side's columns stay."""
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"_of_{c}"]) for c in on])
    return left.join(F.broadcast(named) if rows <= limit else named, same, how).drop(*[f"_of_{c}" for c in on])


def checked_join(left: DataFrame, right: DataFrame, on, how: str, rows: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Replicate the right side only when its counted size is small; otherwise shuffle, where AQE splits skew."""
    return left.join(F.broadcast(right) if rows <= limit else right, on, how)


@dataclass
class Sliced:
    """Rows with a ``_slice`` number; ``cut`` tells whether any series was really cut."""

    frame: DataFrame
    keys: list[str]
    cut: bool
    n_big: int = 0

    def window(self, *order: Column | str) -> WindowSpec:
        parts = [*self.keys, "_slice"] if self.cut else self.keys
        return Window.partitionBy(*parts).orderBy(*order)

    def own(self, df: DataFrame) -> DataFrame:
        """Drop the halo rows and helper columns."""
        out = df.filter(F.col("_own")) if "_own" in df.columns else df
        return out.drop("_own", "_slice")


def _slices_by_rank(df: DataFrame, keys: list[str], time: str, big: DataFrame, n_big: int, budget: int) -> DataFrame:
    """Rows with a ``_slice`` of about ``budget`` rows each, at the same cost for any number of slices.

    Rows of oversized series are dealt to tasks by ranges of (keys, time), and each task counts its rows off within a series.
    """
    t = epoch_micros(time)
    marked = checked_join(df, big.withColumn("_big", F.lit(True)), keys, "left", n_big)
    # stored, since the ranges come from a sample and must not be drawn twice; small series and rows without a time stay out of them
    rows = keep(marked)
    timed = rows.filter(F.col("_big") & t.isNotNull()).drop("_big")
    others = rows.filter(F.col("_big").isNull() | t.isNull()).withColumn("_slice", F.when(F.col("_big").isNull(), SMALL).otherwise(TIMELESS).cast("long")).drop("_big")
    tasks = max(2, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), timed.count() // max(1, budget)))
    dealt = keep(timed.withColumn("_at", t).repartitionByRange(tasks, *keys, "_at").withColumn("_part", F.spark_partition_id()))
    ahead = F.rank().over(Window.partitionBy(*keys, "_part").orderBy("_at")) - 1  # equal times share a rank
    number = F.col("_part").cast("long") * (1 << 32) + F.floor(ahead / budget)
    return keep(dealt.withColumn("_slice", number).drop("_at", "_part").unionByName(others))


def slice_series(df: DataFrame, keys: Sequence[str], time: str, budget: int | None = None) -> Sliced:
    """Give rows of oversized series a slice number by time; equal times always share a slice.

    The cuts are quantiles of the row times from a mergeable sketch, so slices hold about ``budget`` rows however the times are
    spread, and a single far date shifts nothing. Where cuts are many, looking a row up among them would cost as much as
    there are, and slices are counted off in time order instead. Where exactly a cut falls does not show in any result. Rows without a time
    form a slice of their own before all others, as they come first in an uncut window.
    """
    keys = list(keys)
    budget = row_budget(df, budget)
    t = epoch_micros(time)
    big, n_big, largest = oversized_keys(df, keys, budget)
    if n_big == 0:
        return Sliced(df, keys, False)
    parts = -(-largest // budget)
    if parts > MANY_CUTS:
        return Sliced(_slices_by_rank(df, keys, time, big, n_big, budget), keys, True, n_big)
    points = [i / parts for i in range(1, parts)]
    cuts = (checked_join(df.select(*keys, time), big, keys, "inner", n_big).groupBy(*keys)
            .agg(F.array_distinct(F.coalesce(F.percentile_approx(t, points, 20 * parts), F.array().cast("array<bigint>"))).alias("_cuts")))
    placed = checked_join(df, cuts, keys, "left", n_big * parts)
    number = F.size(F.filter("_cuts", lambda c: c < t))
    # The sliced rows feed several branches (halo, slice numbers, windows): they are written once.
    sliced = keep(placed.withColumn("_slice", F.when(F.col("_cuts").isNull(), SMALL).when(t.isNull(), TIMELESS).otherwise(number)).drop("_cuts"))
    return Sliced(sliced, keys, True, n_big)


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0,
              budget: int | None = None) -> Sliced:
    """Slices whose rows are preceded by the last ``before`` and followed by the first ``after`` rows outside.

    ``order`` starts with the time column. Windows over ``Sliced.window(*order)`` with row frames that reach at most
    that far give the same values as over the uncut series; ``Sliced.own`` then removes the halo.
    """
    s = slice_series(df, keys, order[0], budget)
    if not s.cut:
        return s
    parts = [*s.keys, "_slice"]
    cut_rows = s.frame.filter(F.col("_slice") > SMALL)
    numbered = cut_rows.groupBy(*parts).agg(F.count("*").alias("_rows")).withColumn(
        "_ordinal", F.row_number().over(Window.partitionBy(*s.keys).orderBy("_slice"))).select(*parts, "_ordinal")
    targets = numbered.withColumnRenamed("_slice", "_target")

    def edge(count: int, forward: bool) -> DataFrame:
        """Edge rows of each slice, offered to the next (or previous) slices and trimmed to ``count`` per slice."""
        nearest = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
        rim = (
            cut_rows.withColumn("_k", F.row_number().over(Window.partitionBy(*parts).orderBy(*nearest)))
            .filter(F.col("_k") <= count).drop("_k")
            .join(numbered, parts, "inner")
        )
        step = 1 if forward else -1
        reach = F.sequence(F.lit(1), F.lit(count))
        offered = (
            rim.withColumn("_ordinal", F.explode(F.transform(reach, lambda i: (F.col("_ordinal") + step * i).cast("int"))))
            .join(targets, [*s.keys, "_ordinal"], "inner")
        )
        trim = Window.partitionBy(*s.keys, "_target").orderBy(*nearest)
        return (
            offered.withColumn("_k", F.row_number().over(trim)).filter(F.col("_k") <= count)
            .withColumn("_slice", F.col("_target")).drop("_k", "_target", "_ordinal")
            .withColumn("_own", F.lit(False))
        )

    frame = s.frame.withColumn("_own", F.lit(True))
    if before:
        frame = frame.unionByName(edge(before, True))
    if after:
        frame = frame.unionByName(edge(after, False))
    return Sliced(frame, s.keys, True, s.n_big)


def with_carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column],
               budget: int | None = None) -> DataFrame:
    """For each named value: ``_prev_<name>`` / ``_next_<name>``, the nearest non-NULL value at or around the row.

    Unbounded "last/first non-null" frames reach arbitrarily far, so cut series carry one value per slice across
    the slice borders instead of a halo of rows.
    """
    s = slice_series(df, keys, order[0], budget)
    frame = s.frame.withColumns({f"_v_{n}": c for n, c in values.items()})
    w = s.window(*order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # backwards in time: a frame that only grows is carried along, one that ends at the last row is gone through for every row
    ahead = s.window(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    inner = frame.withColumns({f"_prev_{n}": F.last(f"_v_{n}", ignorenulls=True).over(back) for n in values})
    inner = inner.withColumns({f"_next_{n}": F.last(f"_v_{n}", ignorenulls=True).over(ahead) for n in values})
    if not s.cut:
        return inner.drop(*[f"_v_{n}" for n in values])
    parts = [*s.keys, "_slice"]
    rank = F.struct(*[F.col(c) for c in order])
    edges = frame.filter(F.col("_slice") > SMALL).groupBy(*parts).agg(*[
        e for n in values for e in (
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_tail_{n}"),
            F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_head_{n}"))
    ])
    by_slice, from_end = (Window.partitionBy(*s.keys).orderBy(o) for o in ("_slice", F.desc("_slice")))
    carried = edges.select(*parts, *[
        e for n in values for e in (
            F.last(f"_tail_{n}", ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_in_{n}"),
            F.last(f"_head_{n}", ignorenulls=True).over(from_end.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_out_{n}"))
    ])
    out = inner.join(carried, parts, "left")
    out = out.withColumns({
        **{f"_prev_{n}": F.coalesce(f"_prev_{n}", f"_in_{n}") for n in values},
        **{f"_next_{n}": F.coalesce(f"_next_{n}", f"_out_{n}") for n in values},
    })
    return out.drop("_slice", *[f"{p}_{n}" for n in values for p in ("_v", "_in", "_out")])


def _spread(total: Column, squares: Column, n: Column, low: Column, high: Column) -> Column:
    """Sample standard deviation from centred sums; exactly 0 for a constant window, NULL below two values."""
    var = F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1))
    return F.when(n < 2, F.lit(None)).when(low == high, F.lit(0.0)).otherwise(F.sqrt(var))


#: Units of time, in seconds, of which elapsed frames are put together; each holds a bounded number of the one before.
UNITS = (1, 60, 3600, DAY_SECONDS)
_FIELDS = {"n": F.sum, "s": F.sum, "q": F.sum, "l": F.min, "h": F.max}


def _combined(values: Sequence[str], *tags: str) -> dict[str, Column]:
    """Field by field, what the tagged parts hold together; a part that holds nothing counts for nothing."""
    out: dict[str, Column] = {}
    for v in values:
        for f in _FIELDS:
            parts = [F.col(f"_{t}_{f}_{v}") for t in tags]
            out[f"{f}_{v}"] = {"l": F.least, "h": F.greatest}[f](*parts) if f in "lh" else sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return out


def _around(units: DataFrame, values: Sequence[str], ratio: int, shifts: Mapping[int, int], inclusive: bool) -> DataFrame:
    """For each unit (_k, _u): ``_own_…`` of the units before it in its parent of ``ratio`` units, and for each frame ``_edge<d>_…`` of the
    units after the same place in the parent in which the frame starts (with that place itself if ``inclusive``).

    Each unit also appears, moved ahead by a frame's length, in the parent whose frames begin in its own, so a parent has a bounded
    number of rows whatever the number of readings.
    """
    moved = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(by).cast("long").alias("by")) for d, by in {0: 0, **shifts}.items()])
    everyone = units.withColumn("_m", F.explode(moved)).withColumn("_u", F.col("_u") + F.col("_m.by")).withColumn("_p", F.floor(F.col("_u") / ratio))
    before = Window.partitionBy("_k", "_p").orderBy("_u").rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_k", "_p").orderBy(F.desc("_u")).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    cols = {f"_{tag}_{f}_{v}": fn(F.when(F.col("_m.d") == d, F.col(f"{f}_{v}"))).over(w)
            for tag, d, w in [("own", 0, before), *((f"edge{d}", d, after) for d in shifts)] for v in values for f, fn in _FIELDS.items()}
    return everyone.withColumns(cols).filter(F.col("_m.d") == 0).select("_k", "_u", "_p", *cols)


def _frames(seconds: DataFrame, values: Sequence[str], days: Sequence[int]) -> DataFrame:
    """For each second with readings (_k, _u; a stored table): ``full<d>_<field>_<value>`` over the ``d`` days before it.

    A frame is, unit by unit, what comes before in the own minute, hour and day, whole days, and the rest of the day,
    hour and minute in which it starts.
    """
    levels = [seconds]
    for small, large in zip(UNITS, UNITS[1:]):  # noqa: B905
        ratio = large // small
        levels.append(levels[-1].groupBy("_k", F.floor(F.col("_u") / ratio).alias("_u")).agg(
            *[fn(f"{f}_{v}").alias(f"{f}_{v}") for v in values for f, fn in _FIELDS.items()]))
    whole = {f"_full{d}_{f}_{v}": fn(f"{f}_{v}").over(Window.partitionBy("_k").orderBy("_u").rangeBetween(-(d - 1), -1))
             for d in days for v in values for f, fn in _FIELDS.items()}
    known = levels[-1].select("_k", "_u", *[c.alias(n) for n, c in whole.items()])
    for unit, large, level in reversed(list(zip(UNITS, UNITS[1:], levels))):  # noqa: B905
        near = _around(level, values, large // unit, {d: d * DAY_SECONDS // unit for d in days}, unit == UNITS[0])
        both = near.join(known.withColumnRenamed("_u", "_p"), ["_k", "_p"], "left")
        known = both.select("_k", "_u", *[c.alias(f"_full{d}_{n}") for d in days for n, c in _combined(values, "own", f"edge{d}", f"full{d}").items()])
    return known


def elapsed_stats(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], days: Sequence[int], budget: int | None = None) -> DataFrame:
    """Count, mean, sample std, min and max over the prior ``days`` of elapsed time, current timestamp excluded.

    Rows without a time have each other, the row itself included, as their frame; a NULL key is a series like any other.
    Short series use a range frame, which Spark goes through anew for every row. If any series has more than
    ``DENSE_ROWS`` rows (or than the budget), readings are first summed by second, in each task before they are shuffled, and every
    frame is put together from seconds, minutes, hours and days; no task holds more than a day's units of a series, or its days.
    """
    keys = list(keys)
    _, n_big, _ = oversized_keys(df, keys, min(row_budget(df, budget), DENSE_ROWS))
    base = df.withColumn("_e", epoch(time))
    if n_big == 0:
        out = base
        for d in days:
            w = Window.partitionBy(*keys).orderBy("_e").rangeBetween(-d * DAY_SECONDS, -1)
            out = out.withColumns({
                f"{v}_prior_{d}d_{label}": fn(v).over(w) for v in values
                for label, fn in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
            })
        return out.drop("_e")

    centres = df.agg(*[F.avg(v).alias(v) for v in values]).first()
    rows = base.withColumn("_k", F.struct(*keys) if keys else F.struct(F.lit(0)))  # equal where fields are equal or both NULL
    shifted = rows.withColumns({f"_x_{v}": F.col(v).cast("double") - F.lit(float(centres[v] or 0.0)) for v in values})
    seconds = keep(shifted.groupBy("_k", F.col("_e").alias("_u")).agg(*[
        e for v in values for e in (
            F.count(f"_x_{v}").alias(f"n_{v}"), F.sum(f"_x_{v}").alias(f"s_{v}"), F.sum(F.col(f"_x_{v}") * F.col(f"_x_{v}")).alias(f"q_{v}"),
            F.min(f"_x_{v}").alias(f"l_{v}"), F.max(f"_x_{v}").alias(f"h_{v}"))]))
    timeless = seconds.filter(F.col("_u").isNull()).select("_k", "_u", *[F.col(f"{f}_{v}").alias(f"_full{d}_{f}_{v}") for d in days for v in values for f in _FIELDS])
    found = _frames(seconds.filter(F.col("_u").isNotNull()), values, days).unionByName(timeless).withColumnRenamed("_k", "_of")
    out = rows.join(found, (F.col("_k") == F.col("_of")) & F.col("_e").eqNullSafe(F.col("_u")), "left")
    final: dict[str, Column] = {}
    for v in values:
        for d in days:
            n, s, q, low, high = (F.col(f"_full{d}_{f}_{v}") for f in _FIELDS)
            n, centre, name = F.coalesce(n, F.lit(0)).cast("long"), F.lit(float(centres[v] or 0.0)), f"{v}_prior_{d}d"
            final |= {f"{name}_count": n, f"{name}_mean": F.when(n > 0, centre + F.try_divide(s, n)),
                      f"{name}_std": F.when(n > 1, _spread(s, q, F.nullif(n, F.lit(0)), low, high)),
                      f"{name}_min": centre + low, f"{name}_max": centre + high}
    return out.select(*df.columns, *[c.alias(n) for n, c in final.items()])
