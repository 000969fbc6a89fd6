"""Room and energy capacity questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import iso_weekday, month_key, weekday_name
from gaugeworks.functions.columns import occupancy_rate, ratio

TIME = "timestamp"


def hourly_occupancy_weather(occupancy: DataFrame, weather: DataFrame, bucket: Column) -> DataFrame:
    """Inner join of bucketed means; the bucket expression applies to both tables' time column."""
    o = occupancy.groupBy(bucket.alias("bucket")).agg(
        F.avg(occupancy_rate()).alias("avg_occupancy_rate"), F.avg("guests").alias("avg_guests"),
        F.count("*").alias("occupancy_readings"))
    w = weather.groupBy(bucket.alias("bucket")).agg(
        F.avg("temperature").alias("avg_temperature"), F.avg("precipitation").alias("avg_precipitation"),
        F.count("*").alias("weather_readings"))
    return o.join(w, "bucket", "inner")


def rain_split(joined: DataFrame) -> DataFrame:
    kind = F.when(F.col("avg_precipitation") > 0, "rain").otherwise("no_rain")
    return joined.groupBy(kind.alias("precip_bucket")).agg(
        F.avg("avg_occupancy_rate").alias("avg_occupancy_rate"), F.count("*").alias("hour_count"))


def monthly_capacity(occupancy: DataFrame) -> DataFrame:
    rate = F.avg(occupancy_rate())
    return occupancy.groupBy(month_key(TIME).alias("month")).agg(
        F.count("*").alias("readings"), F.avg("available_rooms").alias("avg_available_rooms"),
        F.avg("occupied_rooms").alias("avg_occupied_rooms"), rate.alias("avg_occupancy_rate"),
    ).withColumns({
        "headroom_pct": 100 * (1 - F.col("avg_occupancy_rate")),
        "avg_available_capacity_rooms": F.col("avg_available_rooms") - F.col("avg_occupied_rooms"),
    })


def monthly_load(energy: DataFrame) -> DataFrame:
    return energy.groupBy(month_key(TIME).alias("month")).agg(
        F.count("*").alias("readings"), F.avg("power_consumption").alias("avg_power_kw"),
        F.stddev_samp("power_consumption").alias("std_power_kw"), F.max("power_consumption").alias("max_power_kw"))


def ranked_months(capacity: DataFrame, load: DataFrame, confident_only: bool = True) -> DataFrame:
    """Months by headroom. A month with an energy signal is of high confidence, one without of moderate."""
    joined = capacity.select("month", "headroom_pct").join(
        load.select("month", "avg_power_kw", "max_power_kw"), "month", "inner" if confident_only else "left")
    label = F.when(F.col("avg_power_kw").isNotNull(), "High").otherwise("Moderate")
    place = F.row_number().over(Window.orderBy(F.desc("headroom_pct"), "month"))  # one row per calendar month
    return joined.withColumn("confidence", label).withColumn("place", place)


def city_capacity(occupancy: DataFrame) -> DataFrame:
    per = occupancy.groupBy("sensor_id").agg(
        F.avg("available_rooms").alias("c"), F.avg("occupied_rooms").alias("o"), F.avg("guests").alias("g"))
    return per.agg(
        F.sum("c").alias("total_capacity_rooms"), F.sum("o").alias("total_occupied_rooms"), F.sum("g").alias("total_guests"),
        ratio(F.sum("g"), F.sum("o")).alias("guests_per_occupied_room"))


def event_day_split(occupancy: DataFrame, weekdays: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Occupancy on the event's weekdays (Mon = 0) against all others."""
    group = F.when(iso_weekday(TIME).isin(*weekdays), "Event days").otherwise("Other")
    return occupancy.groupBy(group.alias("day_group")).agg(
        F.avg(occupancy_rate()).alias("avg_occupancy_rate"), F.count("*").alias("readings"))


def weekday_occupancy(occupancy: DataFrame) -> DataFrame:
    return occupancy.groupBy(F.dayofweek(TIME).alias("day_of_week"), weekday_name(TIME).alias("day_name")).agg(
        F.avg(occupancy_rate()).alias("avg_occupancy_rate"))


def load_by_year(energy: DataFrame, month: int) -> DataFrame:
    return energy.filter(F.month(TIME) == month).groupBy(F.year(TIME).alias("year")).agg(
        F.avg("power_consumption").alias("avg_power_kw"), F.max("power_consumption").alias("max_power_kw"))


def capacity_impact(occupancy: DataFrame, attendees: float, weekdays: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Share of the event days' free rooms an event of that size would take.

    Sensor means and both day-group rates are partial sums of the same scan.
    """
    event = iso_weekday(TIME).isin(*weekdays)
    rate = occupancy_rate()
    per = occupancy.groupBy("sensor_id").agg(
        F.avg("available_rooms").alias("c"), F.avg("occupied_rooms").alias("o"), F.avg("guests").alias("g"),
        *[e for n, when in (("e", event), ("t", ~event)) for e in (F.sum(F.when(when, rate)).alias(f"s{n}"), F.count(F.when(when, rate)).alias(f"n{n}"))])
    one = per.agg(F.sum("c").alias("total_capacity_rooms"), ratio(F.sum("g"), F.sum("o")).alias("guests_per_occupied_room"),
                  ratio(F.sum("se"), F.sum("ne")).alias("event_days_rate"), ratio(F.sum("st"), F.sum("nt")).alias("other_rate"))
    occupied = F.col("event_days_rate") * F.col("total_capacity_rooms")
    needed = ratio(F.lit(float(attendees)), "guests_per_occupied_room")
    free = F.col("total_capacity_rooms") - occupied
    return one.select(
        "total_capacity_rooms", "guests_per_occupied_room", "event_days_rate", "other_rate",
        free.alias("event_days_headroom_rooms"), needed.alias("rooms_needed"),
        ratio(needed, free).alias("pct_headroom_used"),
        ratio(occupied + needed, "total_capacity_rooms").alias("post_event_rate"))


def headroom_position(capacity: DataFrame, load: DataFrame, month: str) -> DataFrame:
    """Where the event month stands in the headroom ranking, which months are looser, and the peak energy month."""
    place = F.row_number().over(Window.orderBy(F.desc("headroom_pct"), "month"))  # one row per calendar month
    ranked = capacity.select("month", "headroom_pct").withColumn("place", place)
    chosen = F.max(F.when(F.col("month") == month, F.col("place"))).over(Window.partitionBy())
    looser = F.col("place") < F.col("_at")
    both = ranked.withColumn("_at", chosen).join(load.select("month", "max_power_kw"), "month", "full_outer")
    listed = F.array_sort(F.collect_list(F.when(looser, F.struct("place", "month"))))
    return both.agg(
        F.max("_at").alias("event_month_place"), F.max(F.when(F.col("month") == month, F.col("headroom_pct"))).alias("event_month_headroom"),
        F.count(F.when(looser, 1)).alias("looser_months"), F.concat_ws(",", F.transform(listed, lambda s: s["month"])).alias("looser_month_list"),
        F.max_by("month", F.when(F.col("max_power_kw").isNotNull(), F.struct("max_power_kw", "month"))).alias("peak_energy_month"))
