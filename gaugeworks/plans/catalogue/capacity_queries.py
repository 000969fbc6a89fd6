"""Room, energy and suitability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.calendar import remaining_month_days
from gaugeworks.operators import profiles as P
from gaugeworks.plans import capacity as C
from gaugeworks.plans import planner as PL
from gaugeworks.plans import tables as T
from gaugeworks.plans.registry import near, num, query, reported, whole

RATE = "occupied_rooms / nullif(available_rooms, 0)"
CAPACITY = f"""capacity AS (SELECT strftime("timestamp", '%Y-%m') AS month, count(*) AS readings, avg(available_rooms) AS a, avg(occupied_rooms) AS o,
  avg({RATE}) AS r FROM occupancy GROUP BY 1)"""
LOAD = """loads AS (SELECT strftime("timestamp", '%Y-%m') AS month, count(*) AS readings, avg(power_consumption) AS avg_power_kw,
  stddev_samp(power_consumption) AS std_power_kw, max(power_consumption) AS max_power_kw FROM energy GROUP BY 1)"""
WEATHER_SQL = """weather AS (SELECT o_orderdate AS "timestamp", o_totalprice / 10000 AS temperature,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN o_totalprice / 1000 ELSE 0 END AS precipitation,
  o_custkey / 10.0 AS wind_speed FROM orders)"""


def weather(spark, folder):
    price = F.col("o_totalprice")
    return T.table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("timestamp"), (price / 10000).alias("temperature"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), price / 1000).otherwise(0.0).alias("precipitation"),
        (F.col("o_custkey") / 10).alias("wind_speed"))


JOINED = f"""o AS (SELECT date_trunc('hour', "timestamp") AS bucket, avg({RATE}) AS avg_occupancy_rate, avg(guests) AS avg_guests, count(*) AS occupancy_readings FROM occupancy GROUP BY 1),
w AS (SELECT date_trunc('hour', "timestamp") AS bucket, avg(temperature) AS avg_temperature, avg(precipitation) AS avg_precipitation, count(*) AS weather_readings FROM weather GROUP BY 1),
j AS (SELECT * FROM o JOIN w USING (bucket))"""


def joined(spark, folder):
    return C.hourly_occupancy_weather(T.occupancy(spark, folder), weather(spark, folder), F.date_trunc("hour", "timestamp"))


@query("hourly_join_inner", f"""WITH {T.OCCUPANCY_SQL}, {WEATHER_SQL}, {JOINED}
SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, {num("avg_occupancy_rate", "avg_occupancy_rate")}, {num("avg_guests", "avg_guests")},
  {num("avg_temperature", "avg_temperature")}, {num("avg_precipitation", "avg_precipitation")}, occupancy_readings, weather_readings FROM j""")
def hourly_join_inner(spark, folder):
    return reported(joined(spark, folder))


@query("rain_bucket", f"""WITH {T.OCCUPANCY_SQL}, {WEATHER_SQL}, {JOINED}
SELECT CASE WHEN avg_precipitation > 0 THEN 'rain' ELSE 'no_rain' END AS precip_bucket, {num("avg(avg_occupancy_rate)", "avg_occupancy_rate")},
  count(*) AS hour_count FROM j GROUP BY 1""")
def rain_bucket(spark, folder):
    return reported(C.rain_split(joined(spark, folder)))


OUTER = f"""a AS (SELECT date_trunc('hour', "timestamp") AS h, avg(vehicle_count) AS avg_vehicle_count, avg(avg_speed) AS avg_traffic_speed, count(*) AS traffic_readings FROM traffic GROUP BY 1),
b AS (SELECT date_trunc('hour', "timestamp") AS h, avg({RATE}) AS avg_occupancy_rate, avg(guests) AS avg_guests, count(*) AS occupancy_readings FROM occupancy GROUP BY 1),
c AS (SELECT date_trunc('hour', "timestamp") AS h, avg(power_consumption) AS avg_power_consumption, count(*) AS energy_readings FROM energy GROUP BY 1),
d AS (SELECT date_trunc('hour', "timestamp") AS h, avg(revenue) AS avg_revenue, avg(expense) AS avg_expense, count(*) AS fiscal_readings FROM fiscal GROUP BY 1),
wx AS (SELECT date_trunc('hour', "timestamp") AS h, avg(temperature) AS avg_temperature, avg(precipitation) AS avg_precipitation, count(*) AS weather_readings FROM weather GROUP BY 1),
aq AS (SELECT date_trunc('hour', "timestamp") AS h, avg(pm25) AS avg_pm25, avg(no2) AS avg_no2, count(*) AS air_readings FROM air_quality GROUP BY 1),
j AS (SELECT * FROM a FULL JOIN b USING (h) FULL JOIN c USING (h) FULL JOIN d USING (h) FULL JOIN wx USING (h) FULL JOIN aq USING (h))"""
SIX_TABLES = f"{T.TRAFFIC_SQL}, {T.OCCUPANCY_SQL}, {T.ENERGY_SQL}, {T.FISCAL_SQL}, {T.WEATHER_SQL}, {T.AIR_QUALITY_SQL}"


def outer_table(spark, folder):
    return P.outer_hourly([
        P.hourly_means(T.traffic(spark, folder), "timestamp", {"avg_vehicle_count": "vehicle_count", "avg_traffic_speed": "avg_speed"}, "traffic_readings"),
        P.hourly_means(T.occupancy(spark, folder), "timestamp", {
            "avg_occupancy_rate": F.try_divide("occupied_rooms", "available_rooms"), "avg_guests": "guests"}, "occupancy_readings"),
        P.hourly_means(T.energy(spark, folder), "timestamp", {"avg_power_consumption": "power_consumption"}, "energy_readings"),
        P.hourly_means(T.fiscal(spark, folder), "timestamp", {"avg_revenue": "revenue", "avg_expense": "expense"}, "fiscal_readings"),
        P.hourly_means(T.weather(spark, folder), "timestamp", {"avg_temperature": "temperature", "avg_precipitation": "precipitation"}, "weather_readings"),
        P.hourly_means(T.air_quality(spark, folder), "timestamp", {"avg_pm25": "pm25", "avg_no2": "no2"}, "air_readings"),
    ])


@query("hourly_full_outer", f"""WITH {SIX_TABLES}, {OUTER}
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour_timestamp, {num("avg_vehicle_count", "avg_vehicle_count")}, {num("avg_traffic_speed", "avg_traffic_speed")}, traffic_readings,
  {num("avg_occupancy_rate", "avg_occupancy_rate")}, {num("avg_guests", "avg_guests")}, occupancy_readings, {num("avg_power_consumption", "avg_power_consumption")}, energy_readings,
  {num("avg_revenue", "avg_revenue")}, {num("avg_expense", "avg_expense")}, fiscal_readings,
  {num("avg_temperature", "avg_temperature")}, {num("avg_precipitation", "avg_precipitation")}, weather_readings, {num("avg_pm25", "avg_pm25")}, {num("avg_no2", "avg_no2")}, air_readings,
  hour(h) AS hour, dayofweek(h) + 1 AS day_of_week, dayofweek(h) IN (0, 6) AS is_weekend FROM j""")
def hourly_full_outer(spark, folder):
    return reported(outer_table(spark, folder))


@query("monthly_capacity", f"""WITH {T.OCCUPANCY_SQL}, {CAPACITY}
SELECT month, readings, {num("a", "avg_available_rooms")}, {num("o", "avg_occupied_rooms")}, {num("r", "avg_occupancy_rate")},
  {num("100 * (1 - r)", "headroom_pct")}, {num("a - o", "avg_available_capacity_rooms")} FROM capacity""")
def monthly_capacity(spark, folder):
    return reported(C.monthly_capacity(T.occupancy(spark, folder)))


@query("monthly_load", f"""WITH {T.ENERGY_SQL}, {LOAD}
SELECT month, readings, {num("avg_power_kw", "avg_power_kw")}, {num("std_power_kw", "std_power_kw")}, {num("max_power_kw", "max_power_kw")} FROM loads""")
def monthly_load(spark, folder):
    return reported(C.monthly_load(T.energy(spark, folder)))


@query("ranked_months", f"""WITH {T.OCCUPANCY_SQL}, {T.ENERGY_SQL}, {CAPACITY}, {LOAD}
SELECT month, {num("100 * (1 - r)", "headroom_pct")}, {num("avg_power_kw", "avg_power_kw")}, {num("max_power_kw", "max_power_kw")}, 'High' AS confidence,
  row_number() OVER (ORDER BY 1 - r DESC, month) AS place FROM capacity JOIN loads USING (month)""")
def ranked_months(spark, folder):
    return reported(C.ranked_months(C.monthly_capacity(T.occupancy(spark, folder)), C.monthly_load(T.energy(spark, folder))))


@query("confidence_left_join", f"""WITH {T.OCCUPANCY_SQL}, {T.ENERGY_SQL}, {CAPACITY}, {LOAD}
SELECT month, {num("100 * (1 - r)", "headroom_pct")}, {num("avg_power_kw", "avg_power_kw")}, {num("max_power_kw", "max_power_kw")},
  CASE WHEN avg_power_kw IS NOT NULL THEN 'High' ELSE 'Moderate' END AS confidence,
  row_number() OVER (ORDER BY 1 - r DESC, month) AS place FROM capacity LEFT JOIN loads USING (month)""")
def confidence_left_join(spark, folder):
    return reported(C.ranked_months(C.monthly_capacity(T.occupancy(spark, folder)), C.monthly_load(T.energy(spark, folder)), False))


CITY = """per AS (SELECT sensor_id, avg(available_rooms) AS c, avg(occupied_rooms) AS o, avg(guests) AS g FROM occupancy GROUP BY 1),
totals AS (SELECT sum(c) AS c, sum(o) AS o, sum(g) AS g, sum(g) / nullif(sum(o), 0) AS per_room FROM per)"""
SPLIT = f"""days AS (SELECT CASE WHEN isodow("timestamp") IN (2, 3, 4) THEN 'Event days' ELSE 'Other' END AS day_group, avg({RATE}) AS r, count(*) AS n FROM occupancy GROUP BY 1)"""


@query("city_capacity", f"""WITH {T.OCCUPANCY_SQL}, {CITY}
SELECT {num("c", "total_capacity_rooms")}, {num("o", "total_occupied_rooms")}, {num("g", "total_guests")}, {num("per_room", "guests_per_occupied_room")} FROM totals""")
def city_capacity(spark, folder):
    return reported(C.city_capacity(T.occupancy(spark, folder)))


@query("event_day_split", f"""WITH {T.OCCUPANCY_SQL}, {SPLIT} SELECT day_group, {num("r", "avg_occupancy_rate")}, n AS readings FROM days""")
def event_day_split(spark, folder):
    return reported(C.event_day_split(T.occupancy(spark, folder)))


@query("weekday_occupancy", f"""WITH {T.OCCUPANCY_SQL}
SELECT dayofweek("timestamp") + 1 AS day_of_week, strftime("timestamp", '%a') AS day_name, {num(f"avg({RATE})", "avg_occupancy_rate")} FROM occupancy GROUP BY 1, 2""")
def weekday_occupancy(spark, folder):
    return reported(C.weekday_occupancy(T.occupancy(spark, folder)))


@query("load_by_year", f"""WITH {T.ENERGY_SQL}
SELECT year("timestamp") AS year, {num("avg(power_consumption)", "avg_power_kw")}, {num("max(power_consumption)", "max_power_kw")} FROM energy WHERE month("timestamp") = 4 GROUP BY 1""")
def load_by_year(spark, folder):
    return reported(C.load_by_year(T.energy(spark, folder), 4))


@query("capacity_impact", f"""WITH {T.OCCUPANCY_SQL}, {CITY}, {SPLIT}, x AS (
  SELECT c, per_room, (SELECT r FROM days WHERE day_group = 'Event days') AS e, (SELECT r FROM days WHERE day_group = 'Other') AS t FROM totals)
SELECT {num("c", "total_capacity_rooms")}, {num("per_room", "guests_per_occupied_room")}, {num("e", "event_days_rate")}, {num("t", "other_rate")},
  {num("c - e * c", "event_days_headroom_rooms")}, {num("15000 / per_room", "rooms_needed")}, {num("15000 / per_room / (c - e * c)", "pct_headroom_used")},
  {num("(e * c + 15000 / per_room) / c", "post_event_rate")} FROM x""")
def capacity_impact(spark, folder):
    return reported(C.capacity_impact(T.occupancy(spark, folder), 15000))


@query("headroom_position", f"""WITH {T.OCCUPANCY_SQL}, {T.ENERGY_SQL}, {CAPACITY}, {LOAD}, r AS (
  SELECT month, 100 * (1 - r) AS h, row_number() OVER (ORDER BY 1 - r DESC, month) AS place FROM capacity),
e AS (SELECT * FROM r WHERE month = '1998-11')
SELECT (SELECT place FROM e) AS event_month_place, {num("(SELECT h FROM e)", "event_month_headroom")},
  (SELECT count(*) FROM r, e WHERE r.place < e.place) AS looser_months,
  (SELECT coalesce(string_agg(r.month, ',' ORDER BY r.place), '') FROM r, e WHERE r.place < e.place) AS looser_month_list,
  (SELECT month FROM loads ORDER BY max_power_kw DESC, month DESC LIMIT 1) AS peak_energy_month""")
def headroom_position(spark, folder):
    return reported(C.headroom_position(C.monthly_capacity(T.occupancy(spark, folder)), C.monthly_load(T.energy(spark, folder)), "1998-11"))


MONTH_FISCAL = """mf AS (SELECT strftime("timestamp", '%Y-%m') AS month, avg(revenue) AS revenue FROM fiscal GROUP BY 1)"""


def month_fiscal(spark, folder):
    return T.fiscal(spark, folder).groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(F.avg("revenue").alias("revenue"))


@query("peak_low_month", f"""WITH {T.FISCAL_SQL}, {MONTH_FISCAL}, r AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, month) AS p FROM mf)
SELECT (SELECT month FROM r WHERE p = 1) AS peak_month, {num("max(revenue)", "peak_value")},
  (SELECT month FROM r ORDER BY revenue, month LIMIT 1) AS low_month, {num("min(revenue)", "low_value")},
  (SELECT month FROM r WHERE p = 2) AS runner_up, {near("max(revenue) - max(revenue) FILTER (WHERE p = 2)", "gap_to_runner_up")} FROM r""")
def peak_low_month(spark, folder):
    return reported(PL.peak_and_low(month_fiscal(spark, folder), "revenue"), "gap_to_runner_up")


@query("revenue_rise", f"""WITH {T.FISCAL_SQL}, {MONTH_FISCAL}, x AS (SELECT max(revenue) AS hi, arg_min(revenue, month) AS f, arg_max(revenue, month) AS l, arg_max(month, revenue) AS peak_month FROM mf)
SELECT peak_month, {num("100 * (hi - f) / f", "rise_pct")}, {num("100 * (hi - l) / hi", "fall_pct")} FROM x""")
def revenue_rise(spark, folder):
    return reported(PL.rise_to_peak(month_fiscal(spark, folder), "revenue"))


SCORES = f"""scores AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, avg(l_discount) * 1000 AS capacity, avg(l_quantity) AS fiscal, avg(l_tax) * 1000 AS air_quality,
  CASE WHEN count(*) % 3 = 0 THEN NULL ELSE avg(l_linenumber) * 20 END AS weather, avg(l_quantity * l_discount) * 50 AS energy FROM lineitem GROUP BY 1),
s AS (SELECT *, 0.3 * capacity + 0.3 * fiscal + 0.1 * air_quality + 0.1 * weather + 0.2 * energy AS suitability FROM scores)"""


def scores(spark, folder):
    s = T.table(spark, folder, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        (F.avg("l_discount") * 1000).alias("capacity"), F.avg("l_quantity").alias("fiscal"), (F.avg("l_tax") * 1000).alias("air_quality"),
        F.when(F.count("*") % 3 != 0, F.avg("l_linenumber") * 20).alias("weather"), (F.avg(F.col("l_quantity") * F.col("l_discount")) * 50).alias("energy"))
    return s.withColumn("suitability", sum((F.col(f) * w for f, w in PL.WEIGHTS.items()), F.lit(0.0)))


@query("suitability_reweight", f"""WITH {SCORES}, a AS (SELECT *, 0.4 * capacity AS c1, 0.3 * 0.6 / 0.7 * fiscal AS c2, 0.1 * 0.6 / 0.7 * air_quality AS c3,
  0.1 * 0.6 / 0.7 * weather AS c4, 0.2 * 0.6 / 0.7 * energy AS c5 FROM s), t AS (SELECT *, c1 + c2 + c3 + c4 + c5 AS score FROM a)
SELECT month, {num("suitability", "suitability")}, {num("score", "adjusted_score")}, {num("c1", "capacity_contribution")}, {num("c2", "fiscal_contribution")},
  {num("c3", "air_quality_contribution")}, {num("c4", "weather_contribution")}, {num("c5", "energy_contribution")},
  row_number() OVER (ORDER BY score DESC NULLS LAST, month) AS place FROM t""")
def suitability_reweight(spark, folder):
    return reported(PL.reweight(scores(spark, folder), 10).drop(*PL.WEIGHTS))


@query("score_checks", f"""WITH {SCORES}, u AS (SELECT CASE WHEN v IS NOT NULL AND NOT (v BETWEEN 0 AND 100) THEN 1 ELSE 0 END AS bad
  FROM s UNPIVOT (v FOR f IN (capacity, fiscal, air_quality, weather, energy, suitability)))
SELECT CAST((SELECT sum(bad) FROM u) AS BIGINT) AS scores_out_of_range, (SELECT count(*) - count(DISTINCT month) FROM s) AS duplicate_dates""")
def score_checks(spark, folder):
    return reported(PL.score_violations(scores(spark, folder), "month"))


@query("best_period", f"""WITH w AS (SELECT date_trunc('week', l_shipdate) AS start, avg(l_quantity) AS score FROM lineitem GROUP BY 1),
r AS (SELECT *, strftime(start, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(start, '%Y-%m') ORDER BY score DESC, start) AS k FROM w)
SELECT month, strftime(start, '%Y-%m-%d') AS best_start, {num("score", "best_score")} FROM r WHERE k = 1
UNION ALL SELECT NULL, strftime(start, '%Y-%m-%d'), {num("score", "best_score")} FROM (SELECT * FROM w ORDER BY score DESC, start LIMIT 1)""")
def best_period(spark, folder):
    w = T.table(spark, folder, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("start")).agg(F.avg("l_quantity").alias("score"))
    return reported(PL.best_periods(w, "start", "score"))


@query("same_month_duration", """SELECT strftime(d, '%Y-%m-%d') AS day, CAST(least(7, day(last_day(d)) - day(d) + 1) AS BIGINT) AS longest FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)""")
def same_month_duration(spark, folder):
    days = T.table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return reported(days.withColumn("longest", remaining_month_days("day")))
