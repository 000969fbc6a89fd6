"""Air and weather questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import time_range
from gaugeworks.functions.columns import any_of, count_true, share_true, weighted_mean
from gaugeworks.operators.quantiles import quantile_values

TIME = "timestamp"


def year_range(year: int) -> tuple[str, str]:
    if not 1900 <= year <= 2100:
        raise ValueError("year must be between 1900 and 2100")
    return f"{year}-01-01", f"{year + 1}-01-01"


def monthly_environment(air: DataFrame, weather: DataFrame, year: int) -> DataFrame:
    """PM2.5 and temperature per month of a year; a month present in either table is kept."""
    span = time_range(TIME, year_range(year))
    a = air.filter(span).groupBy(F.month(TIME).alias("month")).agg(
        F.avg("pm25").alias("average_pm25"), F.count("*").alias("air_readings"))
    w = weather.filter(span).groupBy(F.month(TIME).alias("month")).agg(
        F.avg("temperature").alias("average_temperature"), F.count("*").alias("weather_readings"))
    return a.join(w, "month", "full_outer")


def annual_means(monthly: DataFrame) -> DataFrame:
    """Reading-weighted year means of the months that have a value."""
    return monthly.agg(
        weighted_mean("average_pm25", "air_readings").alias("annual_pm25"),
        weighted_mean("average_temperature", "weather_readings").alias("annual_temperature"))


def month_comparison(monthly: DataFrame, first: int, second: int, measures: Sequence[str]) -> DataFrame:
    """Second month against the first: "lower", "higher", or "unavailable" where either is missing."""
    picked = monthly.filter(F.col("month").isin(first, second))
    parts = []
    for m in measures:
        parts += [F.max(F.when(F.col("month") == first, F.col(m))).alias(f"{m}_first"),
                  F.max(F.when(F.col("month") == second, F.col(m))).alias(f"{m}_second")]
    one = picked.agg(*parts)
    for m in measures:
        a, b = F.col(f"{m}_first"), F.col(f"{m}_second")
        one = one.withColumn(f"{m}_direction", F.when(a.isNull() | b.isNull(), "unavailable").when(b < a, "lower").otherwise("higher"))
    return one


def monitor_status(air: DataFrame, pollutants: Sequence[str], year: int, level: float = 0.9) -> DataFrame:
    """Readings of one year with any pollutant at or above its all-history quantile."""
    limits = quantile_values(air, {p: (p, level) for p in pollutants})
    over = any_of([F.col(p) >= F.lit(limits[p]) for p in pollutants])
    return air.filter(time_range(TIME, year_range(year))).agg(
        F.count("*").alias("total"), (F.count("*") - count_true(over)).alias("normal"), count_true(over).alias("monitor"))


def matching_dates(readings: DataFrame, ranges: Sequence[tuple[str, str]], means: Mapping[str, str], rain: str | None = None) -> DataFrame:
    """Per-year, per-day history of the same calendar dates."""
    aggs = [F.count("*").alias("readings"), *[F.avg(c).alias(n) for n, c in means.items()]]
    if rain:
        aggs.append(share_true(F.col(rain) > 0).alias("percent_readings_with_precipitation"))
    return readings.filter(time_range(TIME, *ranges)).groupBy(
        F.year(TIME).alias("year"), F.dayofmonth(TIME).alias("day")).agg(*aggs)


def across_years(history: DataFrame, value: str, out: str) -> DataFrame:
    return history.groupBy("day").agg(F.avg(value).alias(out), F.count("*").alias("years"))


def project_points(samples: DataFrame, years: Sequence[int], expected: DataFrame | None = None) -> DataFrame:
    """Mean, min and max per (day, location) over the years; fails where a year is missing or doubled.

    ``expected`` optionally lists the (day, location) pairs that must be present.
    """
    if not years:
        raise ValueError("at least one historical year is required")
    wanted = F.array(*[F.lit(int(y)) for y in sorted(years)])
    out = samples.groupBy("day", "location").agg(
        F.array_sort(F.collect_list("year")).alias("_years"),  # one sample per year and point
        *[f(c).alias(f"{c}_{n}") for c in ("temperature_f", "precipitation_mm")
          for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    if expected is not None:
        out = expected.select("day", "location").join(out, ["day", "location"], "left")
    bad = F.col("_years").isNull() | (F.col("_years") != wanted)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("incomplete historical coverage for "), F.col("location").cast("string"))).cast("int"))
    return out.withColumn("history_years", F.coalesce(checked, F.size("_years"))).drop("_years")
