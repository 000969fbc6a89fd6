"""Hourly, weekly and monthly profiles and other grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import is_weekend, month_key, weekday_name
from gaugeworks.functions.columns import count_true, ratio

CALENDAR_KEYS = {
    "hour": lambda t: F.hour(t),
    "day_of_week": lambda t: F.dayofweek(t),
    "day_name": lambda t: weekday_name(t),
    "is_weekend": lambda t: is_weekend(t),
    "month": lambda t: F.month(t),
    "year": lambda t: F.year(t),
    "year_month": lambda t: month_key(t),
    "hour_timestamp": lambda t: F.date_trunc("hour", t),
    "day": lambda t: F.to_date(t),
}


def calendar_keys(time: str, parts: Sequence[str]) -> list[Column]:
    return [CALENDAR_KEYS[p](F.col(time)).alias(p) for p in parts]


def profile(df: DataFrame, value: str, time: str, *parts: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample std, min, max and count of a value per calendar part."""
    return df.groupBy(*by, *calendar_keys(time, parts)).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("minimum"),
        F.max(value).alias("maximum"), F.count(value).alias("readings"))


def hourly_means(df: DataFrame, time: str, means: Mapping[str, str | Column], count_as: str | None = None) -> DataFrame:
    """Per-hour means under given names, with an optional reading count."""
    aggs = [F.avg(c).alias(n) for n, c in means.items()]
    if count_as:
        aggs.append(F.count("*").alias(count_as))
    return df.groupBy(*calendar_keys(time, ["hour_timestamp"])).agg(*aggs)


def outer_hourly(tables: Sequence[DataFrame]) -> DataFrame:
    """Full outer join of hourly aggregates plus calendar columns."""
    joined = reduce(lambda a, b: a.join(b, "hour_timestamp", "full_outer"), tables)
    ts = F.col("hour_timestamp")
    return joined.withColumns({"hour": F.hour(ts), "day_of_week": F.dayofweek(ts), "is_weekend": is_weekend(ts)})


def with_share(counts: DataFrame, count: str = "readings", out: str = "share_pct") -> DataFrame:
    """Share of the grand total; the input is already one row per group."""
    return counts.withColumn(out, 100 * ratio(count, F.sum(count).over(Window.partitionBy())))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5, max_distinct: int = 20) -> DataFrame:
    """The k most frequent values of every column with fewer than ``max_distinct`` values, in one pass.

    All columns are melted to (column, value) and counted with map-side partial sums; only counts are ranked.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counted = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("readings"))
    # at most max_distinct groups of a column matter; ranks run on the counts
    sizes = counted.groupBy("column").agg(F.count("*").alias("distinct_values")).filter(F.col("distinct_values") < max_distinct)
    kept = counted.join(F.broadcast(sizes), "column")  # one row per column of the table
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("readings"), F.asc_nulls_first("value")))
    return kept.withColumn("place", place).filter(F.col("place") <= k).drop("distinct_values")


def summary_table(df: DataFrame, columns: Sequence[str], budget: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per column in long form."""
    from gaugeworks.operators.quantiles import exact_quantiles

    long = melt(df, [], columns)
    moments = long.groupBy("metric").agg(
        F.count("value").alias("readings"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    quartiles = exact_quantiles(long, ["metric"], {"q25": ("value", .25), "median": ("value", .5), "q75": ("value", .75)}, budget=budget)
    return moments.join(quartiles, "metric")


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), name, value)


def spread(df: DataFrame, ids: Sequence[str], name: str, values: Sequence[str], value: str) -> DataFrame:
    """Long to wide for a known list of names (no extra pass to discover them)."""
    return df.groupBy(*ids).pivot(name, list(values)).agg(F.first(value))


def extremes(df: DataFrame, value: str, label: str, k: int) -> DataFrame:
    """The k lowest and k highest rows with their place; ties go to the smaller label."""
    low = df.orderBy(F.asc(value), F.asc(label)).limit(k).withColumn("side", F.lit("lowest"))
    high = df.orderBy(F.desc(value), F.asc(label)).limit(k).withColumn("side", F.lit("highest"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(
        F.when(F.col("side") == "lowest", F.col(value)).otherwise(-F.col(value)), label))
    return low.unionByName(high).withColumn("place", place)


def two_level_sum(df: DataFrame, sensor: str, columns: Mapping[str, str]) -> DataFrame:
    """Mean per sensor, then the sum of those means: a city total that does not depend on reporting frequency."""
    per = df.groupBy(sensor).agg(*[F.avg(c).alias(n) for n, c in columns.items()])
    return per.agg(*[F.sum(n).alias(n) for n in columns])


def high_share(level: str = "congestion_level", high: str = "high") -> Column:
    return 100 * ratio(count_true(F.col(level) == high), F.count("*"))
