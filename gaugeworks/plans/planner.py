"""Suitability scores and period picks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.columns import ratio, sums_of, weighted_mean

# The published factor weights.
WEIGHTS = {"capacity": 0.30, "fiscal": 0.30, "air_quality": 0.10, "weather": 0.10, "energy": 0.20}


def adjusted_weights(adjustment: float, weights: Mapping[str, float] = WEIGHTS, moved: str = "capacity") -> dict[str, float]:
    """Add percentage points to one factor and shrink the rest in proportion."""
    new = weights[moved] + adjustment / 100
    if not 0 <= new <= 1:
        raise ValueError("the adjusted weight must stay between zero and one")
    rest = (1 - new) / (1 - weights[moved])
    return {k: new if k == moved else w * rest for k, w in weights.items()}


def reweight(scores: DataFrame, adjustment: float, label: str = "month", stored: str = "suitability") -> DataFrame:
    """Adjusted score, contributions and rank. Zero adjustment returns the stored total; a NULL factor gives NULL."""
    weights = adjusted_weights(adjustment)
    total = F.col(stored) if adjustment == 0 else sums_of([F.col(f) * F.lit(w) for f, w in weights.items()])
    out = scores.withColumns({"adjusted_score": total, **{f"{f}_contribution": F.col(f) * F.lit(w) for f, w in weights.items()}})
    order = Window.orderBy(F.col("adjusted_score").desc_nulls_last(), label)  # one row per calendar period
    return out.withColumn("place", F.row_number().over(order))


def score_violations(scores: DataFrame, start: str = "start_date", end: str | None = None) -> DataFrame:
    """Counts of score rows that break the export rules, in one pass over the rows."""
    factors = [*WEIGHTS, "suitability"]
    outside = sums_of([F.count(F.when(F.col(f).isNotNull() & ~F.col(f).between(0, 100), 1)) for f in factors])
    aggs = [outside.alias("scores_out_of_range"), (F.count("*") - F.countDistinct(start)).alias("duplicate_dates")]
    if end:
        week = (F.datediff(end, start) == 6) & (F.weekday(start) == 0)
        aggs.append(F.count(F.when(~week, 1)).alias("not_full_weeks"))
    return scores.agg(*aggs)


def best_periods(scores: DataFrame, start: str, score: str) -> DataFrame:
    """The best period within each month and, in a row without a month, overall; ties go to the earlier period."""
    best = F.max_by(start, F.struct(F.col(score), F.negative(F.unix_date(F.col(start)))))
    months = scores.filter(F.col(score).isNotNull()).withColumn("month", F.date_format(start, "yyyy-MM")).rollup("month")
    return months.agg(best.alias("best_start"), F.max(score).alias("best_score"))


def peak_and_low(monthly: DataFrame, value: str, label: str = "month") -> DataFrame:
    """Leading and lowest month, the runner-up and its gap."""
    down = Window.orderBy(F.desc(value), label)  # one row per calendar month
    ranked = monthly.filter(F.col(value).isNotNull()).select(label, value, F.row_number().over(down).alias("p"))
    return ranked.agg(
        F.min_by(label, "p").alias("peak_month"), F.max(value).alias("peak_value"),
        F.min_by(label, F.struct(value, label)).alias("low_month"), F.min(value).alias("low_value"),
        F.max(F.when(F.col("p") == 2, F.col(label))).alias("runner_up"),
        (F.max(value) - F.max(F.when(F.col("p") == 2, F.col(value)))).alias("gap_to_runner_up"))


def rise_to_peak(monthly: DataFrame, value: str, label: str = "month") -> DataFrame:
    """Percent rise from the first month to the peak, and fall from the peak to the last month."""
    first, last = F.min_by(value, label), F.max_by(value, label)
    return monthly.agg(
        F.max_by(label, value).alias("peak_month"),
        (100 * ratio(F.max(value) - first, first)).alias("rise_pct"),
        (100 * ratio(F.max(value) - last, F.max(value))).alias("fall_pct"))


def weighted_range(daily: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """Observation-weighted mean of long daily facts over a half-open date range."""
    inside = (F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(end).cast("date"))
    return daily.filter(inside).groupBy("dataset", "metric").agg(
        weighted_mean("mean", "observations").alias("mean"), F.sum("observations").alias("observations"),
        F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"))
