"""Air and weather queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.columns import aqi_category, precipitation_band, temperature_band, weather_condition
from gaugeworks.plans import environment as E
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalogue.capacity_queries import WEATHER_SQL, weather
from gaugeworks.plans.registry import num, query, reported

AIR_SQL = """air AS (SELECT l_shipdate AS "timestamp", l_quantity AS pm25, l_quantity * l_linenumber AS pm10, l_extendedprice / 1000 AS no2, l_tax * 100 AS co FROM lineitem)"""
POLLUTANTS = ("pm25", "pm10", "no2", "co")


def air(spark, folder):
    return T.table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("pm25"),
        (F.col("l_quantity") * F.col("l_linenumber")).alias("pm10"), (F.col("l_extendedprice") / 1000).alias("no2"), (F.col("l_tax") * 100).alias("co"))


MONTHLY = """m AS (SELECT * FROM
 (SELECT month("timestamp") AS month, avg(pm25) AS average_pm25, count(*) AS air_readings FROM air WHERE "timestamp" >= TIMESTAMP '2001-01-01' AND "timestamp" < TIMESTAMP '2002-01-01' GROUP BY 1)
 FULL JOIN
 (SELECT month("timestamp") AS month, avg(temperature) AS average_temperature, count(*) AS weather_readings FROM weather WHERE "timestamp" >= TIMESTAMP '2001-01-01' AND "timestamp" < TIMESTAMP '2002-01-01' GROUP BY 1)
 USING (month))"""


def monthly(spark, folder):
    return E.monthly_environment(air(spark, folder), weather(spark, folder), 2001)


@query("monthly_full_outer", f"""WITH {AIR_SQL}, {WEATHER_SQL}, {MONTHLY}
SELECT month, {num("average_pm25", "average_pm25")}, air_readings, {num("average_temperature", "average_temperature")}, weather_readings FROM m""")
def monthly_full_outer(spark, folder):
    return reported(monthly(spark, folder))


@query("annual_weighted_mean", f"""WITH {AIR_SQL}, {WEATHER_SQL}, {MONTHLY}
SELECT {num("sum(average_pm25 * air_readings) / sum(air_readings)", "annual_pm25")},
  {num("sum(average_temperature * weather_readings) / sum(weather_readings)", "annual_temperature")} FROM m""")
def annual_weighted_mean(spark, folder):
    return reported(E.annual_means(monthly(spark, folder)))


@query("month_comparison", f"""WITH {AIR_SQL}, {WEATHER_SQL}, {MONTHLY}, x AS (SELECT
  (SELECT average_pm25 FROM m WHERE month = 7) AS p7, (SELECT average_pm25 FROM m WHERE month = 9) AS p9,
  (SELECT average_temperature FROM m WHERE month = 7) AS t7, (SELECT average_temperature FROM m WHERE month = 9) AS t9)
SELECT {num("p7", "average_pm25_first")}, {num("p9", "average_pm25_second")}, {num("t7", "average_temperature_first")}, {num("t9", "average_temperature_second")},
  CASE WHEN p7 IS NULL OR p9 IS NULL THEN 'unavailable' WHEN p9 < p7 THEN 'lower' ELSE 'higher' END AS average_pm25_direction,
  CASE WHEN t7 IS NULL OR t9 IS NULL THEN 'unavailable' WHEN t9 < t7 THEN 'lower' ELSE 'higher' END AS average_temperature_direction FROM x""")
def month_comparison(spark, folder):
    return reported(E.month_comparison(monthly(spark, folder), 7, 9, ["average_pm25", "average_temperature"]))


@query("p90_monitor_status", f"""WITH {AIR_SQL}, t AS (SELECT quantile_cont(pm25, 0.9) AS a, quantile_cont(pm10, 0.9) AS b, quantile_cont(no2, 0.9) AS c, quantile_cont(co, 0.9) AS d FROM air)
SELECT count(*) AS total, count(*) - count(*) FILTER (WHERE pm25 >= a OR pm10 >= b OR no2 >= c OR co >= d) AS normal,
  count(*) FILTER (WHERE pm25 >= a OR pm10 >= b OR no2 >= c OR co >= d) AS monitor
FROM air, t WHERE "timestamp" >= TIMESTAMP '1998-01-01' AND "timestamp" < TIMESTAMP '1999-01-01'""")
def p90_monitor_status(spark, folder):
    return reported(E.monitor_status(air(spark, folder), POLLUTANTS, 1998))


RANGES = [(f"{y}-11-03", f"{y}-11-06") for y in range(1995, 2001)]
IN_RANGES = " OR ".join(f"""("timestamp" >= TIMESTAMP '{a}' AND "timestamp" < TIMESTAMP '{b}')""" for a, b in RANGES)


@query("matching_dates_weather", f"""WITH {WEATHER_SQL}
SELECT year("timestamp") AS year, day("timestamp") AS day, count(*) AS readings, {num("avg(temperature)", "average_temperature")}, {num("avg(wind_speed)", "average_wind_speed")},
  {num("avg(precipitation)", "average_precipitation")}, {num("100.0 * avg(CASE WHEN precipitation > 0 THEN 1 ELSE 0 END)", "percent_readings_with_precipitation")}
FROM weather WHERE {IN_RANGES} GROUP BY 1, 2""")
def matching_dates_weather(spark, folder):
    return reported(E.matching_dates(weather(spark, folder), RANGES, {
        "average_temperature": "temperature", "average_wind_speed": "wind_speed", "average_precipitation": "precipitation"}, "precipitation"))


AIR_HISTORY = f"""h AS (SELECT year("timestamp") AS year, day("timestamp") AS day, count(*) AS readings, {", ".join(f"avg({p}) AS average_{p}" for p in POLLUTANTS)}
FROM air WHERE {IN_RANGES} GROUP BY 1, 2)"""


@query("matching_dates_air", f"""WITH {AIR_SQL}, {AIR_HISTORY} SELECT year, day, readings, {", ".join(num(f"average_{p}", f"average_{p}") for p in POLLUTANTS)} FROM h""")
def matching_dates_air(spark, folder):
    return reported(E.matching_dates(air(spark, folder), RANGES, {f"average_{p}": p for p in POLLUTANTS}))


@query("matching_dates_across_years", f"""WITH {AIR_SQL}, {AIR_HISTORY} SELECT day, {num("avg(average_pm25)", "average_pm25")}, count(*) AS years FROM h GROUP BY 1""")
def matching_dates_across_years(spark, folder):
    history = E.matching_dates(air(spark, folder), RANGES, {f"average_{p}": p for p in POLLUTANTS})
    return reported(E.across_years(history, "average_pm25", "average_pm25"))


SAMPLES = """samples AS (SELECT 1996 + l_orderkey % 5 AS year, month(l_shipdate) AS day, l_returnflag AS location, avg(l_quantity) AS temperature_f, avg(l_discount) * 100 AS precipitation_mm
  FROM lineitem GROUP BY 1, 2, 3)"""


@query("projection_by_point", f"""WITH {SAMPLES} SELECT day, location, {", ".join(num(f"{f}({c})", f"{c}_{n}") for c in ("temperature_f", "precipitation_mm") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))},
  count(*) AS history_years FROM samples GROUP BY 1, 2""")
def projection_by_point(spark, folder):
    samples = (T.table(spark, folder, "lineitem")
               .groupBy((1996 + F.col("l_orderkey") % 5).alias("year"), F.month("l_shipdate").alias("day"), F.col("l_returnflag").alias("location"))
               .agg(F.avg("l_quantity").alias("temperature_f"), (F.avg("l_discount") * 100).alias("precipitation_mm")))
    return reported(E.project_points(samples, range(1996, 2001)))


@query("band_classes", """SELECT event_id, CASE WHEN value <= 50 THEN 'Good' WHEN value <= 100 THEN 'Moderate' WHEN value <= 150 THEN 'Unhealthy for sensitive groups'
   WHEN value <= 200 THEN 'Unhealthy' WHEN value <= 300 THEN 'Very unhealthy' ELSE 'Hazardous' END AS aqi_category,
  CASE WHEN k < 50 THEN 'below 50' WHEN k < 60 THEN '50 to 60' WHEN k < 70 THEN '60 to 70' WHEN k < 80 THEN '70 to 80' ELSE '80 and above' END AS temperature_band,
  CASE WHEN value < 0.1 THEN 'below 0.1' WHEN value < 1 THEN '0.1 to 1' WHEN value < 5 THEN '1 to 5' WHEN value < 10 THEN '5 to 10' ELSE '10 and above' END AS precipitation_band,
  CASE WHEN k >= 95 THEN 'Thunderstorm' WHEN k IN (71, 73, 75, 77, 85, 86) THEN 'Snow' WHEN k BETWEEN 51 AND 82 THEN 'Rain or showers' WHEN k IN (1, 2, 3, 45, 48) THEN 'Cloudy or partly cloudy'
   WHEN k = 0 THEN 'Clear' ELSE 'Conditions unavailable' END AS condition
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def band_classes(spark, folder):
    return reported(T.traffic(spark, folder).select(
        "event_id", aqi_category("vehicle_count").alias("aqi_category"), temperature_band("avg_speed").alias("temperature_band"),
        precipitation_band("vehicle_count").alias("precipitation_band"), weather_condition("avg_speed").alias("condition")))
