"""Traffic serving queries and calendar profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.columns import add_traffic_flags
from gaugeworks.operators import profiles as P
from gaugeworks.plans import mobility as M
from gaugeworks.plans import tables as T
from gaugeworks.plans.registry import num, query, reported, whole

HIGH = "100.0 * count(*) FILTER (WHERE congestion_level = 'high') / count(*)"


@query("congestion_breakdown", f"""WITH {T.TRAFFIC_SQL}
SELECT congestion_level, count(*) AS observation_count, {num("100.0 * count(*) / sum(count(*)) OVER ()", "percentage")}
FROM traffic GROUP BY 1""")
def congestion_breakdown(spark, folder):
    return reported(M.congestion_breakdown(T.traffic(spark, folder)))


@query("mobility_summary", f"""WITH {T.TRAFFIC_SQL}, h AS (
  SELECT hour("timestamp") AS hour, avg(vehicle_count) AS m FROM traffic GROUP BY 1)
SELECT {num("avg(vehicle_count)", "average_vehicle_count")}, {num("avg(avg_speed)", "average_speed_kmh")}, {num(HIGH, "high_congestion_percent")},
  (SELECT hour FROM h ORDER BY m DESC, hour LIMIT 1) AS peak_hour,
  {num("(SELECT max(m) FROM h)", "peak_hour_average_vehicle_count")}
FROM traffic""")
def mobility_summary(spark, folder):
    return reported(M.mobility_summary(T.traffic(spark, folder)))


@query("mobility_summary_month", f"""WITH {T.TRAFFIC_SQL}, m1 AS (SELECT * FROM traffic WHERE month("timestamp") = 1), h AS (
  SELECT hour("timestamp") AS hour, avg(vehicle_count) AS m FROM m1 GROUP BY 1)
SELECT {num("avg(vehicle_count)", "average_vehicle_count")}, {num("avg(avg_speed)", "average_speed_kmh")}, {num(HIGH, "high_congestion_percent")},
  (SELECT hour FROM h ORDER BY m DESC, hour LIMIT 1) AS peak_hour,
  {num("(SELECT max(m) FROM h)", "peak_hour_average_vehicle_count")}
FROM m1""")
def mobility_summary_month(spark, folder):
    return reported(M.mobility_summary(T.traffic(spark, folder), 1))


@query("hourly_traffic", f"""WITH {T.TRAFFIC_SQL}
SELECT hour("timestamp") AS hour, {num("avg(vehicle_count)", "average_vehicle_count")}, {num("avg(avg_speed)", "average_speed_kmh")},
  count(*) AS observation_count FROM traffic GROUP BY 1""")
def hourly_traffic(spark, folder):
    return reported(M.hourly_traffic(T.traffic(spark, folder)))


@query("road_type_summary", f"""WITH {T.TRAFFIC_SQL}
SELECT road_type, count(*) AS observation_count, {num("avg(vehicle_count)", "average_vehicle_count")}, {num("avg(avg_speed)", "average_speed_kmh")},
  {num(HIGH, "high_congestion_percent")} FROM traffic GROUP BY 1""")
def road_type_summary(spark, folder):
    return reported(M.road_type_summary(T.traffic(spark, folder)))


SENSOR_SUMMARY = f"""sensors AS (SELECT sensor_id, count(*) AS observation_count, avg(location_lat) AS latitude, avg(location_lon) AS longitude,
  avg(vehicle_count) AS average_vehicle_count, avg(avg_speed) AS average_speed_kmh, {HIGH} AS high_congestion_percent
  FROM traffic GROUP BY 1)"""


@query("sensor_summary", f"""WITH {T.TRAFFIC_SQL}, {SENSOR_SUMMARY}
SELECT sensor_id, observation_count, {num("latitude", "latitude")}, {num("longitude", "longitude")}, {num("average_vehicle_count", "average_vehicle_count")},
  {num("average_speed_kmh", "average_speed_kmh")}, {num("high_congestion_percent", "high_congestion_percent")} FROM sensors""")
def sensor_summary(spark, folder):
    return reported(M.sensor_summary(T.traffic(spark, folder)))


@query("mobility_outlook", f"""WITH {T.TRAFFIC_SQL}, d AS (SELECT * FROM traffic WHERE isodow("timestamp") BETWEEN 3 AND 5),
h AS (SELECT hour("timestamp") AS hour, avg(vehicle_count) AS m FROM d WHERE month("timestamp") = 1 GROUP BY 1),
s AS (SELECT avg(vehicle_count) AS a, avg(avg_speed) AS b, {HIGH} AS c FROM d
      WHERE "timestamp" >= TIMESTAMP '2024-01-08' AND "timestamp" < TIMESTAMP '2024-01-29')
SELECT {num("a", "average_vehicle_count")}, {num("b", "average_speed_kmh")}, {num("c", "high_congestion_percent")},
  (SELECT hour FROM h ORDER BY m DESC, hour LIMIT 1) AS peak_hour, {num("(SELECT max(m) FROM h)", "peak_hour_average_vehicle_count")},
  CASE WHEN c < 30 THEN 'Lower' WHEN c < 40 THEN 'Moderate' ELSE 'Elevated' END AS mobility_outlook FROM s""")
def mobility_outlook(spark, folder):
    return reported(M.mobility_outlook(T.traffic(spark, folder), ("2024-01-08", "2024-01-29"), 1))


@query("risk_areas", f"""WITH {T.TRAFFIC_SQL}, {SENSOR_SUMMARY}, s AS (
  SELECT sensor_id, CAST(high_congestion_percent AS FLOAT) AS c, CAST(average_vehicle_count AS FLOAT) AS v, CAST(average_speed_kmh AS FLOAT) AS p FROM sensors),
r AS (SELECT sensor_id,
  (rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0) / count(*) OVER () AS congestion_risk,
  (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER () AS volume_risk,
  (rank() OVER (ORDER BY -p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER () AS speed_risk FROM s),
t AS (SELECT *, CAST(100 * (0.5 * congestion_risk + 0.3 * volume_risk + 0.2 * speed_risk) AS FLOAT) AS score FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, sensor_id) AS risk_rank FROM t)
SELECT sensor_id, {num("congestion_risk", "congestion_risk")}, {num("volume_risk", "volume_risk")}, {num("speed_risk", "speed_risk")},
  CAST(score AS DOUBLE) AS convention_risk_score, risk_rank FROM o WHERE risk_rank <= 25""")
def risk_areas(spark, folder):
    # means are taken in single precision so that equal means tie whatever the order of addition
    s = M.sensor_summary(T.traffic(spark, folder))
    s = s.withColumns({c: F.col(c).cast("float") for c in ("high_congestion_percent", "average_vehicle_count", "average_speed_kmh")})
    return reported(M.transport_risk(s).select("sensor_id", "congestion_risk", "volume_risk", "speed_risk", "convention_risk_score", "risk_rank"))


def _profile_sql(part: str, expr: str) -> str:
    return f"""WITH {T.TRAFFIC_SQL}
SELECT {expr} AS {part}, {num("avg(vehicle_count)", "mean")}, {num("stddev_samp(vehicle_count)", "std")}, {num("min(vehicle_count)", "minimum")},
  {num("max(vehicle_count)", "maximum")}, count(vehicle_count) AS readings FROM traffic GROUP BY 1"""


@query("hour_profile", _profile_sql("hour", 'hour("timestamp")'))
def hour_profile(spark, folder):
    return reported(P.profile(T.traffic(spark, folder), "vehicle_count", "timestamp", "hour"))


@query("weekday_profile", f"""WITH {T.TRAFFIC_SQL}
SELECT dayofweek("timestamp") + 1 AS day_of_week, strftime("timestamp", '%a') AS day_name, {num("avg(vehicle_count)", "mean")},
  {num("stddev_samp(vehicle_count)", "std")}, {num("min(vehicle_count)", "minimum")}, {num("max(vehicle_count)", "maximum")},
  count(vehicle_count) AS readings FROM traffic GROUP BY 1, 2""")
def weekday_profile(spark, folder):
    return reported(P.profile(T.traffic(spark, folder), "vehicle_count", "timestamp", "day_of_week", "day_name"))


@query("weekend_profile", _profile_sql("is_weekend", 'dayofweek("timestamp") IN (0, 6)'))
def weekend_profile(spark, folder):
    return reported(P.profile(T.traffic(spark, folder), "vehicle_count", "timestamp", "is_weekend"))


@query("month_profile", f"""WITH {T.ENERGY_SQL}
SELECT strftime("timestamp", '%Y-%m') AS year_month, {num("avg(power_consumption)", "mean")}, {num("stddev_samp(power_consumption)", "std")},
  {num("min(power_consumption)", "minimum")}, {num("max(power_consumption)", "maximum")}, count(power_consumption) AS readings FROM energy GROUP BY 1""")
def month_profile(spark, folder):
    return reported(P.profile(T.energy(spark, folder), "power_consumption", "timestamp", "year_month"))


@query("peak_offpeak_hours", f"""WITH {T.TRAFFIC_SQL}, h AS (SELECT hour("timestamp") AS hour, avg(vehicle_count) AS m FROM traffic GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY m, hour) AS lo, row_number() OVER (ORDER BY m DESC, hour) AS hi FROM h)
SELECT hour, {num("m", "mean")}, 'lowest' AS side, lo AS place FROM r WHERE lo <= 3
UNION ALL SELECT hour, {num("m", "mean")}, 'highest', hi FROM r WHERE hi <= 3""")
def peak_offpeak_hours(spark, folder):
    hourly = P.profile(T.traffic(spark, folder), "vehicle_count", "timestamp", "hour").select("hour", "mean")
    return reported(P.extremes(hourly, "mean", "hour", 3))


@query("monthly_congestion", f"""WITH {T.TRAFFIC_SQL}
SELECT strftime("timestamp", '%Y-%m') AS month, {num("avg(vehicle_count)", "avg_vehicle_count")}, {num(HIGH, "pct_high_congestion")} FROM traffic GROUP BY 1""")
def monthly_congestion(spark, folder):
    return reported(M.monthly_congestion(T.traffic(spark, folder)))


@query("traffic_flags", f"""WITH {T.TRAFFIC_SQL}
SELECT event_id, avg_speed * 2 - 20 < 0 OR avg_speed * 2 - 20 > 120 AS speed_anomaly, vehicle_count - 5 < 0 AS count_anomaly FROM traffic""")
def traffic_flags(spark, folder):
    shifted = T.traffic(spark, folder).withColumns({"avg_speed": F.col("avg_speed") * 2 - 20, "vehicle_count": F.col("vehicle_count") - 5})
    return reported(add_traffic_flags(shifted).select("event_id", "speed_anomaly", "count_anomaly"))


@query("vehicle_estimate", f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) * 10 AS attendees, count(DISTINCT o_orderdate) AS days,
  {num("count(*) * 10.0 / count(DISTINCT o_orderdate)", "attendees_per_day")},
  {num("count(*) * 10.0 / count(DISTINCT o_orderdate) / 2.0", "added_vehicles_per_day")}
FROM orders GROUP BY 1""")
def vehicle_estimate(spark, folder):
    p = T.energy(spark, folder).groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
        (F.count("*") * 10).alias("attendees"), F.countDistinct("timestamp").alias("days")).withColumn("attendees_per_vehicle", F.lit(2.0))
    return reported(M.added_vehicles(p).drop("attendees_per_vehicle"))


@query("has_month_data", """SELECT m AS month, exists(SELECT 1 FROM orders WHERE month(o_orderdate) = m) AS has_data FROM (SELECT DISTINCT month(ts) AS m FROM events)""")
def has_month_data(spark, folder):
    months = T.traffic(spark, folder).select(F.month("timestamp").alias("month"))
    return reported(M.months_with_data(T.energy(spark, folder), months))
