"""Trends, decompositions, correlations and cycles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import DAY_SECONDS, epoch
from gaugeworks.functions.columns import flag, pearson, ratio
from gaugeworks.operators.fourier import bin_powers
from gaugeworks.operators.gaps import fill_calendar
from gaugeworks.operators.quantiles import value_ranks
from gaugeworks.operators.slices import with_halo
from gaugeworks.session import keep


def _slope(value: Column, x: Column) -> Column:
    """Least-squares slope over rows with a value, NULL below three of them or without spread in x."""
    at = F.when(value.isNotNull(), x.cast("double"))
    enough = (F.count(value) >= 3) & (F.count_distinct(at) >= 2)
    return F.when(enough, F.try_divide(F.covar_pop(at, value), F.nullif(F.var_pop(at), F.lit(0.0))))


def _r2(value: Column, x: Column) -> Column:
    r = pearson(x.cast("double"), value)
    return F.when(F.count(value) >= 3, r * r)


def linear_trend(daily: DataFrame, by: Sequence[str], value: str, day: str = "day") -> DataFrame:
    """Slope per day and fit over all days, the slope of the last 30 days, and last week minus the week before.

    The input has one row per group and day, so the last day can be attached with a window over days.
    """
    last = F.max(F.when(F.col(value).isNotNull(), F.col(day))).over(Window.partitionBy(*by))
    rows = daily.withColumn("_age", F.datediff(last, day)).withColumn("_x", F.unix_date(day))
    v, x, age = F.col(value), F.col("_x"), F.col("_age")
    month = F.when(age < 30, v)
    week, before = F.when(age < 7, v), F.when((age >= 7) & (age < 14), v)
    return rows.groupBy(*by).agg(
        F.count(v).alias("days"), _slope(v, x).alias("slope_per_day"), _r2(v, x).alias("r_squared"),
        _slope(month, x).alias("recent_30d_slope"), F.count(month).alias("recent_30d_observed_days"),
        F.when((F.count(week) == 7) & (F.count(before) == 7), F.avg(week) - F.avg(before)).alias("last_7d_minus_previous_7d"))


def trend_summary(daily: DataFrame, by: Sequence[str], value: str, day: str = "day", span: int = 30) -> DataFrame:
    """Slope, fit and the means of the first and last calendar days of a series."""
    rows = daily.filter(F.col(value).isNotNull())
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"_a": F.datediff(day, F.min(day).over(w)), "_z": F.datediff(F.max(day).over(w), day)})
    v, x = F.col(value), F.col("_a")
    slope = F.try_divide(F.covar_pop(x.cast("double"), v), F.nullif(F.var_pop(x.cast("double")), F.lit(0.0)))
    r = pearson(x, v)
    return rows.groupBy(*by).agg(
        F.count("*").alias("observed_days"), slope.alias("slope_per_day"), (r * r).alias("r_squared"),
        F.avg(F.when(F.col("_a") < span, v)).alias("first_days_mean"), F.avg(F.when(F.col("_z") < span, v)).alias("last_days_mean"))


def per_sensor_trends(df: DataFrame, sensor: str, value: str, time: str = "timestamp") -> DataFrame:
    """Slope per day and fit for every sensor in one partial aggregate."""
    x = epoch(time) / DAY_SECONDS
    spread = F.var_pop(x)
    ok = (F.count("*") >= 3) & (spread > 0)
    r = pearson(x, value)
    return df.groupBy(sensor).agg(
        F.count("*").alias("observations"), (F.max(x) - F.min(x)).alias("span_days"),
        F.when(ok, F.try_divide(F.covar_pop(x, F.col(value).cast("double")), F.nullif(spread, F.lit(0.0)))).alias("slope_per_day"),
        F.when(F.count("*") >= 3, r * r).alias("r_squared"))


def step_trends(df: DataFrame, value: str, sensor: str, order: Sequence[str] = ("timestamp",), period: int = 6,
                budget: int | None = None) -> DataFrame:
    """Direction and strength of change against the reading ``period`` observations earlier."""
    s = with_halo(df, [sensor], order, before=period, budget=budget)
    w = s.window(*order)
    before, v = F.lag(value, period).over(w), F.col(value)
    wobble = F.stddev_samp(value).over(w.rowsBetween(-period, 0)) + F.lit(0.001)
    out = s.frame.withColumns({f"{value}_trend_reference": before, "_wobble": wobble})
    ref = F.col(f"{value}_trend_reference")
    out = out.withColumns({
        f"{value}_trend_direction": F.coalesce(F.signum(v - ref).cast("int"), F.lit(0)),
        f"{value}_trend_strength": F.when(ref.isNotNull(), ratio(F.abs(v - ref), "_wobble"))})
    return s.own(out.drop("_wobble"))


def step_trend_summary(trends: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return trends.groupBy(*by).agg(F.avg(f"{value}_trend_direction").alias("avg_trend_direction"),
                                   F.avg(f"{value}_trend_strength").alias("avg_trend_strength"))


def pattern_anomalies(df: DataFrame, value: str, order: Sequence[str] = ("timestamp",), budget: int | None = None) -> DataFrame:
    """Distance to centred means of the same hour (15 rows) and same weekday hour (9 rows); beyond 2 std is flagged.

    Both windows look at later rows too, so the flags describe history and are not usable as live alerts. Only
    24 and 168 groups exist, so at scale every group is cut into slices.
    """
    time = order[0]
    rows = df.withColumns({"hour": F.hour(time), "day_of_week": F.dayofweek(time)})
    for label, keys, reach in (("daily", ["hour"], 7), ("weekly", ["day_of_week", "hour"], 4)):
        s = with_halo(rows, keys, order, before=reach, after=reach, budget=budget)
        expected = F.avg(value).over(s.window(*order).rowsBetween(-reach, reach))
        rows = s.own(s.frame.withColumn(f"{value}_expected_{label}", expected)).withColumn(
            f"{value}_deviation_{label}", F.abs(F.col(value) - F.col(f"{value}_expected_{label}")))
    std = rows.agg(*[F.stddev_samp(f"{value}_deviation_{x}").alias(x) for x in ("daily", "weekly")]).first()
    if std["daily"] is None or std["weekly"] is None:
        return rows
    return rows.withColumns({f"{value}_anomaly_{x}": flag(F.col(f"{value}_deviation_{x}") > 2 * std[x]) for x in ("daily", "weekly")})


def weekly_decomposition(daily: DataFrame, by: Sequence[str], value: str, day: str = "day", minimum_days: int = 28) -> DataFrame:
    """Centred 7-day trend, centred weekday effect and residual for gap-free series that are long enough.

    ``by`` names the series; windows run over days of one series, never over raw rows.
    """
    series = fill_calendar(daily.select(*by, day, value), day, by)
    whole = Window.partitionBy(*by)
    series = series.withColumns({"_n": F.count("*").over(whole), "_ok": F.count(value).over(whole)})
    series = series.filter((F.col("_n") >= minimum_days) & (F.col("_ok") == F.col("_n"))).drop("_n", "_ok")
    around = whole.orderBy(day).rowsBetween(-3, 3)
    out = series.withColumn("trend", F.when(F.count(value).over(around) == 7, F.avg(value).over(around)))
    out = out.withColumn("_weekday", F.weekday(day)).withColumn(
        "_effect", F.avg(F.col(value) - F.col("trend")).over(Window.partitionBy(*by, "_weekday")))
    # the mean of the seven weekday effects: each day counts with one over its weekday's number of days
    share = 1 / F.count("*").over(Window.partitionBy(*by, "_weekday"))
    out = out.withColumn("_share", share).withColumn("_level", F.sum(F.col("_effect") * F.col("_share")).over(whole) / F.sum("_share").over(whole))
    out = out.withColumn("weekly_component", F.col("_effect") - F.col("_level"))
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("weekly_component")).select(
        *by, day, F.col(value).alias("observed"), "trend", "weekly_component", "residual")


def prior_weekday_deviation(daily: DataFrame, by: Sequence[str], value: str, day: str = "day", history: int = 8, minimum: int = 4) -> DataFrame:
    """Distance of a day from the previous same weekdays in their standard deviations; NULL flag where not assessed."""
    series = fill_calendar(daily.select(*by, day, value), day, by)
    past = Window.partitionBy(*by, F.weekday(day)).orderBy(day).rowsBetween(-history, -1)
    n = F.count(value).over(past)
    out = series.withColumns({
        "history_n": n, "expected": F.when(n >= minimum, F.avg(value).over(past)),
        "prior_std": F.when(n >= minimum, F.stddev_samp(value).over(past))})
    ok = flag(F.col(value).isNotNull() & F.col("expected").isNotNull() & (F.col("prior_std") > 0))
    z = F.when(ok, ratio(F.abs(F.col(value) - F.col("expected")), "prior_std"))
    return out.withColumns({"assessed": ok, "absolute_z": z, "review_flag": F.when(ok, z > 3)})


def prior_median_flags(daily: DataFrame, by: Sequence[str], value: str, day: str = "day", history: int = 28, threshold: float = 3.5) -> DataFrame:
    """Review score of a day against the median and MAD of the full ``history`` days before it."""
    series = fill_calendar(daily.select(*by, day, value), day, by)
    past = Window.partitionBy(*by).orderBy(day).rowsBetween(-history, -1)
    v = F.col(value).cast("double")
    out = series.withColumn("_past", F.when(F.count(value).over(past) == history, F.sort_array(F.collect_list(v).over(past))))
    out = out.withColumn("_past", F.when(v.isNotNull(), F.col("_past")))

    def middle(a: Column) -> Column:
        return (F.element_at(a, history // 2) + F.element_at(a, history // 2 + 1)) / 2 if history % 2 == 0 else F.element_at(a, history // 2 + 1)

    out = out.withColumn("prior_median", middle(F.col("_past")))
    out = out.withColumn("prior_mad", middle(F.sort_array(F.transform("_past", lambda x: F.abs(x - F.col("prior_median"))))))
    # Fixed value: 0.67448975 puts the MAD on the scale of a standard deviation.
    score = F.when(F.col("prior_mad") > 0, 0.67448975 * ratio(v - F.col("prior_median"), "prior_mad"))
    return out.drop("_past").withColumn("review_score", score).withColumns({
        "assessed": F.col("review_score").isNotNull(), "review_flag": flag(F.abs("review_score") > threshold)})


def _pair_rows(one: DataFrame, pairs: Sequence[tuple[str, str]], fields: Sequence[str]) -> DataFrame:
    """One wide row of per-pair statistics as one line per pair."""
    cells = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), *[F.col(f"p{i}_{f}").alias(f) for f in fields])
             for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def daily_pair_correlations(panel: DataFrame, columns: Sequence[str], day: str = "day", minimum: int = 14) -> DataFrame:
    """Pearson r of levels and of day-to-day changes for every pair of columns of a daily panel (one row per day).

    Changes span consecutive pair days only. All pairs share one aggregate.
    """
    pairs = list(combinations(columns, 2))
    w = Window.orderBy(day)
    out = {}
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        out |= {f"p{i}_day": F.when(both, F.col(day)), f"p{i}_a": F.when(both, F.col(a)), f"p{i}_b": F.when(both, F.col(b))}
    rows = panel.select(day, *[c.alias(n) for n, c in out.items()])
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    diffs = {}
    for i in range(len(pairs)):
        near = F.datediff(f"p{i}_day", F.last(f"p{i}_day", True).over(past)) == 1
        for side in ("a", "b"):
            diffs[f"p{i}_d{side}"] = F.when(near, F.col(f"p{i}_{side}") - F.last(f"p{i}_{side}", True).over(past))
    rows = rows.withColumns(diffs)

    def guarded(n: int, x: str, y: str) -> Column:
        varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when((F.count(x) >= n) & varied, pearson(x, y))

    aggs = []
    for i in range(len(pairs)):
        aggs += [F.count(f"p{i}_a").alias(f"p{i}_overlap_days"), F.min(f"p{i}_day").alias(f"p{i}_start"), F.max(f"p{i}_day").alias(f"p{i}_end"),
                 guarded(minimum, f"p{i}_a", f"p{i}_b").alias(f"p{i}_pearson_daily_means"), F.count(f"p{i}_da").alias(f"p{i}_difference_pairs"),
                 guarded(minimum, f"p{i}_da", f"p{i}_db").alias(f"p{i}_pearson_daily_changes")]
    return _pair_rows(rows.agg(*aggs), pairs, ("overlap_days", "start", "end", "pearson_daily_means", "difference_pairs", "pearson_daily_changes"))


def hourly_pair_correlations(panel: DataFrame, columns: Sequence[str], hour: str = "hour_timestamp", minimum_hours: int = 48, minimum_dates: int = 14) -> DataFrame:
    """Pearson r for every pair of columns of an hourly panel with enough shared hours on enough dates."""
    pairs = list(combinations(columns, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y, t = F.when(both, F.col(a)), F.when(both, F.col(b)), F.when(both, F.col(hour))
        valid = (F.count(x) >= minimum_hours) & (F.count_distinct(F.to_date(t)) >= minimum_dates) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        aggs += [F.count(x).alias(f"p{i}_overlap_hours"), F.count_distinct(F.to_date(t)).alias(f"p{i}_overlap_dates"),
                 F.when(valid, pearson(x, y)).alias(f"p{i}_pearson"),
                 F.when(valid, "descriptive_association").otherwise("insufficient_overlap_or_constant").alias(f"p{i}_status")]
    return _pair_rows(panel.agg(*aggs), pairs, ("overlap_hours", "overlap_dates", "pearson", "status"))


def all_pair_correlations(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r over pairwise complete rows for all pairs in one aggregate, with strength and rank by size."""
    pairs = list(combinations(columns, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.count(F.when(both, 1)).alias(f"p{i}_records"), F.when(F.count(F.when(both, 1)) > 1, pearson(a, b)).alias(f"p{i}_r")]
    out = _pair_rows(table.agg(*aggs), pairs, ("records", "r"))
    size = F.abs("r")
    strength = F.when(size > 0.7, "Strong").when(size > 0.5, "Moderate").when(F.col("r").isNotNull(), "Weak")
    place = F.row_number().over(Window.orderBy(F.abs("r").desc_nulls_last(), "left", "right"))  # one row per pair
    return out.withColumns({"strength": strength, "place": place})


def rank_correlation(df: DataFrame, x: str, y: str, budget: int | None = None) -> DataFrame:
    """Pearson r and the Pearson r of average ranks over rows where both are present."""
    # stored: ranks are joined back by value, and means worked out a second time could differ in their last digit
    rows = keep(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y))
    rx = value_ranks(rows, x, budget).select(x, F.col("average_rank").alias("_rx"))
    ry = value_ranks(rows, y, budget).select(y, F.col("average_rank").alias("_ry"))
    # equal (x, y) pairs are counted before the ranks are attached
    pairs = rows.groupBy(x, y).agg(F.count("*").alias("_w")).join(rx, x).join(ry, y)

    def weighted(a: str, b: str) -> Column:
        w, n = F.col("_w"), F.sum("_w")
        ma, mb = F.sum(w * F.col(a)) / n, F.sum(w * F.col(b)) / n
        cov = F.sum(w * F.col(a) * F.col(b)) / n - ma * mb
        va = F.sum(w * F.col(a) * F.col(a)) / n - ma * ma
        vb = F.sum(w * F.col(b) * F.col(b)) / n - mb * mb
        return F.try_divide(cov, F.nullif(F.sqrt(va) * F.sqrt(vb), F.lit(0.0)))

    total = rows.count()
    centred = pairs.withColumns({"_rx": F.col("_rx") - F.lit((total + 1) / 2), "_ry": F.col("_ry") - F.lit((total + 1) / 2)})
    means = rows.agg(F.avg(x).alias("x"), F.avg(y).alias("y")).first()
    centred = centred.withColumns({"_x": F.col(x) - F.lit(means["x"]), "_y": F.col(y) - F.lit(means["y"])})
    return centred.agg(F.sum("_w").alias("observations"), weighted("_x", "_y").alias("pearson"), weighted("_rx", "_ry").alias("spearman"))


def _power(value: Column, index: Column, bin_: Column, n: Column) -> Column:
    angle = 2 * math.pi * ((bin_ * index) % n) / n
    return F.pow(F.sum(value * F.cos(angle)), 2) + F.pow(F.sum(value * F.sin(angle)), 2)


def nearest_bin(n: int, period: float) -> int:
    """Frequency bin (from 1) whose period n/bin is closest; the lower bin wins a tie."""
    near = {b for b in (int(n / period), int(n / period) + 1) if 1 <= b <= n // 2}
    return min(sorted(near or {1}), key=lambda b: abs(n / b - period))


def target_cycles(series: DataFrame, value: str, index: str, step_hours: float, targets: Sequence[float] = (12.0, 8.0, 24.0)) -> DataFrame:
    """Spectral power at the bins nearest to the target periods of an evenly spaced series; index counts from 0.

    Each wanted bin is two sums over the series, so the whole spectrum is never formed.
    """
    n, mean = series.agg(F.count("*"), F.avg(value)).first()
    bins = [nearest_bin(n, t / step_hours) for t in targets]
    centred = F.col(value) - F.lit(mean)
    one = series.agg(*[_power(centred, F.col(index), F.lit(b), F.lit(n)).alias(f"b{i}") for i, b in enumerate(bins)])
    cells = [F.struct(F.lit(float(t)).alias("target_hours"), F.lit(n * step_hours / b).alias("period_hours"), F.col(f"b{i}").alias("power"))
             for i, (t, b) in enumerate(zip(targets, bins))]
    out = one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    top = F.max("power").over(Window.partitionBy())
    return out.withColumns({"amplitude": F.sqrt("power"), "relative_strength": F.when(top > 0, 100 * ratio("power", top)).otherwise(0.0)})


def spectrum(series: DataFrame, value: str, index: str, shortest: float | None = None, longest: float | None = None, step: float = 1.0) -> DataFrame:
    """Power of every bin (DC included) between two periods of an evenly spaced series of any length."""
    n, mean = series.agg(F.count("*"), F.avg(value)).first()
    first = 0 if longest is None else max(1, math.ceil(n * step / longest - 1e-9))
    last = n // 2 if shortest is None else min(n // 2, math.floor(n * step / shortest + 1e-9))
    rows = series.select((F.col(value) - F.lit(mean)).alias("v"), F.col(index).alias("i"))
    out = bin_powers(rows, "v", "i", n).filter(F.col("bin").between(first, last))
    return out.withColumns({"period": F.try_divide(F.lit(n * step), F.col("bin").cast("double")), "amplitude": F.sqrt("power")})


def cycle_rank(series: DataFrame, value: str, index: str, period: float = 7.0) -> DataFrame:
    """Place of the cycle nearest in frequency to ``period`` among all bins of a daily series."""
    n = series.count()
    target = min(range(n // 2 + 1), key=lambda b: (abs(b / n - 1 / period), b))
    power = spectrum(series, value, index)
    mine = F.max(F.when(F.col("bin") == target, F.col("power"))).over(Window.partitionBy())  # one row per bin
    return power.withColumn("_mine", mine).agg(
        F.max(F.when(F.col("bin") == target, F.col("period"))).alias("period_days"),
        (F.count(F.when(F.col("power") > F.col("_mine"), 1)) + 1).alias("cycle_rank"), F.count("*").alias("n_bins"))


def top_cycles(series: DataFrame, value: str, index: str, k: int = 20, shortest: float = 2, longest: float = 168, step: float = 1.0) -> DataFrame:
    """The k largest amplitudes among cycles between two periods."""
    out = spectrum(series, value, index, shortest, longest, step).orderBy(F.desc("amplitude"), "bin").limit(k)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("amplitude"), "bin")))
