"""Traffic questions: DataFrame in, DataFrame out; ``month=None`` means all months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import in_month, iso_weekday, time_range
from gaugeworks.functions.columns import band, count_true, ratio
from gaugeworks.operators.profiles import high_share, with_share
from gaugeworks.operators.quantiles import value_ranks

COUNT, SPEED, LEVEL, TIME = "vehicle_count", "avg_speed", "congestion_level", "timestamp"


def has_month_data(traffic: DataFrame, month: int) -> bool:
    return not traffic.filter(in_month(TIME, month)).limit(1).isEmpty()


def months_with_data(df: DataFrame, months: DataFrame) -> DataFrame:
    """``has_data`` for each different ``month`` asked for, in one scan of the readings."""
    present = df.select(F.month(TIME).alias("month")).distinct().withColumn("has_data", F.lit(True))
    return months.select("month").distinct().join(present, "month", "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))


def _by_hour(traffic: DataFrame) -> DataFrame:
    """Hourly sums from which both the overall means and the peak hour follow in one scan."""
    return traffic.groupBy(F.hour(TIME).alias("hour")).agg(
        F.count("*").alias("n"), F.sum(COUNT).alias("sum_count"), F.count(COUNT).alias("n_count"),
        F.sum(SPEED).alias("sum_speed"), F.count(SPEED).alias("n_speed"),
        count_true(F.col(LEVEL) == "high").alias("n_high"))


def _peak() -> list[Column]:
    mean = ratio("sum_count", "n_count")
    best = F.max(F.when(F.col("n_count") > 0, F.struct(mean.alias("m"), (-F.col("hour")).alias("h"))))
    return [(-best["h"]).alias("peak_hour"), best["m"].alias("peak_hour_average_vehicle_count")]


def mobility_summary(traffic: DataFrame, month: int | None = None) -> DataFrame:
    hourly = _by_hour(traffic.filter(in_month(TIME, month)))
    return hourly.agg(
        ratio(F.sum("sum_count"), F.sum("n_count")).alias("average_vehicle_count"),
        ratio(F.sum("sum_speed"), F.sum("n_speed")).alias("average_speed_kmh"),
        (100 * ratio(F.sum("n_high"), F.sum("n"))).alias("high_congestion_percent"),
        *_peak())


def hourly_traffic(traffic: DataFrame, month: int | None = None) -> DataFrame:
    return traffic.filter(in_month(TIME, month)).groupBy(F.hour(TIME).alias("hour")).agg(
        F.avg(COUNT).alias("average_vehicle_count"), F.avg(SPEED).alias("average_speed_kmh"),
        F.count("*").alias("observation_count")).orderBy("hour")


def congestion_breakdown(traffic: DataFrame, month: int | None = None) -> DataFrame:
    counts = traffic.filter(in_month(TIME, month)).groupBy(LEVEL).agg(F.count("*").alias("observation_count"))
    place = F.when(F.col(LEVEL) == "high", 1).when(F.col(LEVEL) == "medium", 2).when(F.col(LEVEL) == "low", 3).otherwise(4)
    return with_share(counts, "observation_count", "percentage").orderBy(place)


def road_type_summary(traffic: DataFrame, month: int | None = None) -> DataFrame:
    return traffic.filter(in_month(TIME, month)).groupBy("road_type").agg(
        F.count("*").alias("observation_count"), F.avg(COUNT).alias("average_vehicle_count"),
        F.avg(SPEED).alias("average_speed_kmh"), high_share().alias("high_congestion_percent"),
    ).orderBy(F.desc("average_vehicle_count"))


def sensor_summary(traffic: DataFrame, month: int | None = None) -> DataFrame:
    return traffic.filter(in_month(TIME, month)).groupBy("sensor_id").agg(
        F.count("*").alias("observation_count"), F.avg("location_lat").alias("latitude"),
        F.avg("location_lon").alias("longitude"), F.avg(COUNT).alias("average_vehicle_count"),
        F.avg(SPEED).alias("average_speed_kmh"), high_share().alias("high_congestion_percent"))


def mobility_outlook(traffic: DataFrame, summary_range: tuple[str, str], month: int, first_weekday: int = 2,
                     last_weekday: int = 4) -> DataFrame:
    """Event-season baseline: the summary covers one dated range, the peak hour any year's month; Mon = 0.

    Both come from one scan: hourly sums are kept apart by which of the two filters a reading meets.
    """
    ranged, monthly = time_range(TIME, summary_range), in_month(TIME, month)
    rows = traffic.filter(iso_weekday(TIME).between(first_weekday, last_weekday) & (ranged | monthly))
    hourly = rows.groupBy(F.hour(TIME).alias("hour")).agg(
        F.sum(F.when(ranged, F.col(COUNT))).alias("c"), F.count(F.when(ranged, F.col(COUNT))).alias("nc"),
        F.sum(F.when(ranged, F.col(SPEED))).alias("s"), F.count(F.when(ranged, F.col(SPEED))).alias("ns"),
        count_true(ranged & (F.col(LEVEL) == "high")).alias("high"), count_true(ranged).alias("n"),
        F.sum(F.when(monthly, F.col(COUNT))).alias("sum_count"), F.count(F.when(monthly, F.col(COUNT))).alias("n_count"))
    return hourly.agg(
        ratio(F.sum("c"), F.sum("nc")).alias("average_vehicle_count"), ratio(F.sum("s"), F.sum("ns")).alias("average_speed_kmh"),
        (100 * ratio(F.sum("high"), F.sum("n"))).alias("high_congestion_percent"), *_peak(),
    ).withColumn("mobility_outlook", band("high_congestion_percent", (30, 40), ("Lower", "Moderate", "Elevated"), inclusive=False))


def transport_risk(sensors: DataFrame, k: int = 25) -> DataFrame:
    """The k most exposed sensors by weighted percent ranks of congestion, volume and slowness.

    The three measures are ranked together in long form, so the sensor summary is worked out twice, not six times.
    """
    slow = (-F.col("average_speed_kmh")).cast("double")
    measures = {"congestion_risk": F.col("high_congestion_percent").cast("double"), "volume_risk": F.col("average_vehicle_count").cast("double"), "speed_risk": slow}
    long = sensors.select("sensor_id", *[c.alias(n) for n, c in measures.items()]).unpivot(["sensor_id"], list(measures), "risk", "value")
    ranks = value_ranks(long, "value", by=["risk"])
    totals = ranks.groupBy("risk").agg(F.sum("copies").alias("_total"))
    shares = long.join(ranks, ["risk", "value"]).join(F.broadcast(totals), "risk")  # three rows
    wide = shares.groupBy("sensor_id").pivot("risk", list(measures)).agg(F.first(F.col("average_rank") / F.col("_total")))
    score = 100 * (0.5 * F.col("congestion_risk") + 0.3 * F.col("volume_risk") + 0.2 * F.col("speed_risk"))
    top = wide.withColumn("convention_risk_score", score).orderBy(F.desc("convention_risk_score"), "sensor_id").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("convention_risk_score"), "sensor_id"))  # k rows
    return top.withColumn("risk_rank", place)


def monthly_congestion(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy(F.date_format(TIME, "yyyy-MM").alias("month")).agg(
        F.avg(COUNT).alias("avg_vehicle_count"), high_share().alias("pct_high_congestion")).orderBy("month")


def added_vehicles(parameters: DataFrame) -> DataFrame:
    """Vehicles per day = attendees / days / attendees per vehicle."""
    per_day = ratio("attendees", "days")
    return parameters.withColumns({"attendees_per_day": per_day, "added_vehicles_per_day": ratio(per_day, "attendees_per_vehicle")})


