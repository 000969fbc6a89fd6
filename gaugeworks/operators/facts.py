"""Daily facts: one row per dataset, metric and day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published metrics of each dataset.
METRICS = {
    "traffic": ("vehicle_count", "avg_speed"), "air_quality": ("pm25", "pm10", "no2", "co"),
    "weather": ("temperature", "humidity", "wind_speed", "precipitation"),
    "energy": ("power_consumption", "voltage", "current", "power_factor"),
    "occupancy": ("available_rooms", "occupied_rooms", "guests"), "fiscal": ("revenue", "expense", "net_per_observation"),
}

#: A number between 1e-3 and 1e7 as a decimal: all digits that tell it from other doubles, and room for 10^12 of them.
EXACT = "decimal(38,19)"
#: Decades of a size class; class 0 are the numbers that Spark writes without an exponent.
DECADES = 10


def _without_exponent(value: Column) -> Column:
    """Whether Spark writes a double without an exponent; told from the number, as writing each one out is slow."""
    size = F.abs(value)
    return (size == 0) | ((size >= 1e-3) & (size < 1e7))


def size_class(value: Column) -> Column:
    """Which ten decades a double is in; NULL for one that is not finite."""
    power = F.substring_index(value.cast("string"), "E", -1).try_cast("int")
    return F.when(_without_exponent(value), 0).when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.floor((power + 3) / DECADES).cast("int"))


def exact_part(value: Column) -> Column:
    """A finite double over 10^(DECADES * its class), as an exact decimal of its written digits."""
    text = value.cast("string")
    power = F.substring_index(text, "E", -1).try_cast("int") - DECADES * size_class(value)
    moved = F.concat(F.substring_index(text, "E", 1), F.lit("E"), power.cast("string"))
    return F.when(_without_exponent(value), value.try_cast(EXACT)).otherwise(moved.try_cast(EXACT))


def total_of(parts: Column) -> Column:
    """The double that sums of exact parts, an array of (class, sum), stand for; they are added from the largest class down."""
    def double(p: Column) -> Column:
        return F.concat(p["sum"].cast("string"), F.lit("E"), (p["class"] * DECADES).cast("string")).try_cast("double")
    return F.aggregate(F.reverse(F.array_sort(parts)), F.lit(0.0), lambda total, p: total + double(p))


def daily_facts(df: DataFrame, dataset: str, sensor: str, metrics: Sequence[str], time: str = "timestamp") -> DataFrame:
    """Observations, distinct sensors, mean, min and max of each metric per day, in long form.

    Readings are summed per (day, metric) in each task, so that what is shuffled for the sums does not grow with the readings; sensors are
    counted once for all metrics from distinct (day, sensor), the only shuffle that does. Sums
    are exact decimals, one for each ten decades of size, and are turned into a double once at the end, so that a mean, and with it
    a published digest, does not depend on how rows were partitioned or which came first, and large readings that cancel leave
    small ones whole; zeros lose their sign. The mean is kept between the smallest and the largest reading, as rounding alone could take it out. A day
    with a reading that is not finite has mean NaN.
    """
    lines = df.select(F.to_date(time).alias("day"), F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.when(F.col(m) == 0, 0.0).otherwise(F.col(m).cast("double")).alias("v")) for m in metrics])).alias("m"))
    lines = lines.select("day", "m.metric", F.col("m.v").alias("v"), size_class(F.col("m.v")).alias("class"))
    per = lines.groupBy("day", "metric", "class").agg(
        F.count("*").alias("n"), F.count("v").alias("c"), F.sum(exact_part(F.col("v"))).alias("sum"), F.min("v").alias("low"), F.max("v").alias("high"))
    stats = per.groupBy("day", "metric").agg(
        F.sum("n").alias("observations"), F.sum("c").alias("c"), F.count(F.when(F.col("class").isNull() & (F.col("c") > 0), 1)).alias("odd"),
        F.min("low").alias("minimum"), F.max("high").alias("maximum"))
    seen = df.select(F.to_date(time).alias("_seen"), F.col(sensor).alias("_sensor")).groupBy("_seen").agg(F.count_distinct("_sensor").alias("sensors"))
    stats = stats.join(seen, F.col("day").eqNullSafe(F.col("_seen"))).drop("_seen")
    sums = per.filter(F.col("class").isNotNull()).select("day", "metric", "class", "sum")
    sums = sums.groupBy("day", "metric").agg(F.collect_list(F.struct("class", "sum")).alias("parts"))  # a few dozen classes at most
    sums = sums.select(F.col("day").alias("_day"), F.col("metric").alias("_metric"), "parts")
    mean = F.greatest("minimum", F.least("maximum", F.try_divide(total_of(F.col("parts")), F.col("c").cast("double"))))
    both = stats.join(sums, F.col("day").eqNullSafe(F.col("_day")) & (F.col("metric") == F.col("_metric")), "left")
    mean = F.when(F.col("odd") > 0, float("nan")).when(F.col("c") > 0, mean)
    return both.select(F.lit(dataset).alias("dataset"), "metric", "day", "observations", "sensors", mean.alias("mean"), "minimum", "maximum")


def facts_of(tables: Mapping[str, DataFrame], sensors: Mapping[str, str], metrics: Mapping[str, Sequence[str]] = METRICS) -> DataFrame:
    """Facts of several datasets in one table."""
    return reduce(DataFrame.unionByName, [daily_facts(t, name, sensors[name], metrics[name]) for name, t in tables.items()])


def readings_panel(df: DataFrame, sensor: str, measures: Sequence[str], time: str = "timestamp") -> DataFrame:
    """Wide daily panel: observations, sensors and mean of each measure."""
    per = df.groupBy(F.to_date(time).alias("day"), sensor).agg(F.count("*").alias("_n"), *[
        e for m in measures for e in (F.count(m).alias(f"_c_{m}"), F.sum(m).alias(f"_s_{m}"))])
    return per.groupBy("day").agg(F.sum("_n").alias("observations"), F.count(sensor).alias("sensors"), *[
        F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_c_{m}").cast("double")).alias(m) for m in measures])
