"""The given tables seen in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import pin_utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def traffic(spark: SparkSession, folder: str) -> DataFrame:
    """Sensor readings: users are sensors, event types are road types."""
    k = F.get_json_object("props", "$.k").cast("double")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("sensor_id"), F.col("ts").alias("timestamp"),
        F.col("value").alias("vehicle_count"), k.alias("avg_speed"),
        F.when(kind == "error", "high").when(kind == "click", "medium").otherwise("low").alias("congestion_level"),
        kind.alias("road_type"), (k / 10).alias("location_lat"), ((k * 7) % 100 / 10).alias("location_lon"),
    )


TRAFFIC_SQL = """traffic AS (
  SELECT event_id, user_id AS sensor_id, ts AS "timestamp", value AS vehicle_count, k AS avg_speed,
         CASE WHEN event_type = 'error' THEN 'high' WHEN event_type = 'click' THEN 'medium' ELSE 'low' END AS congestion_level,
         event_type AS road_type, k / 10 AS location_lat, ((k * 7) % 100) / 10 AS location_lon
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""


def occupancy(spark: SparkSession, folder: str) -> DataFrame:
    """Room readings: suppliers are sensors, the quantity is the room stock, the undiscounted part is occupied."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("sensor_id"), F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("available_rooms"),
        (F.col("l_quantity") * (1 - F.col("l_discount") * 5)).alias("occupied_rooms"),
        (F.col("l_quantity") * F.col("l_linenumber")).alias("guests"),
    )


OCCUPANCY_SQL = """occupancy AS (
  SELECT l_suppkey AS sensor_id, l_shipdate AS "timestamp", l_quantity AS available_rooms,
         l_quantity * (1 - l_discount * 5) AS occupied_rooms, l_quantity * l_linenumber AS guests FROM lineitem)"""


def fiscal(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue and expense readings by ship date; suppliers are sensors."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("sensor_id"), F.col("l_shipdate").alias("timestamp"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("expense"),
    )


FISCAL_SQL = """fiscal AS (
  SELECT l_suppkey AS sensor_id, l_shipdate AS "timestamp", l_extendedprice * (1 - l_discount) AS revenue,
         l_extendedprice * l_tax AS expense FROM lineitem)"""


def energy(spark: SparkSession, folder: str) -> DataFrame:
    """Load readings by order date; customers are meters, priorities are building types."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("reading_id"), F.col("o_custkey").alias("meter_id"),
        F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("building_type"),
        F.col("o_totalprice").alias("power_consumption"),
    )


ENERGY_SQL = """energy AS (
  SELECT o_orderkey AS reading_id, o_custkey AS meter_id, o_orderdate AS "timestamp", o_orderpriority AS building_type,
         o_totalprice AS power_consumption FROM orders)"""


def full_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Load readings with all published metrics, worked out from the order's price and keys."""
    price, place = F.col("power_consumption"), F.col("reading_id") % 7
    return energy(spark, folder).select("*", (220 + place).cast("double").alias("voltage"), (price / (220 + place)).alias("current"), (1 / (1 + place)).alias("power_factor"))


FULL_ENERGY_SQL = """full_energy AS (
  SELECT *, CAST(220 + reading_id % 7 AS DOUBLE) AS voltage, power_consumption / (220 + reading_id % 7) AS current, CAST(1 AS DOUBLE) / (1 + reading_id % 7) AS power_factor FROM energy)"""


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """Weather readings by ship date; parts are stations."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("station_id"), F.col("l_shipdate").alias("timestamp"),
        (F.col("l_quantity") - 15).cast("double").alias("temperature"), (F.col("l_discount") * 1000).cast("double").alias("humidity"),
        (F.col("l_quantity") / 3).cast("double").alias("wind_speed"), (F.col("l_tax") * 100).cast("double").alias("precipitation"))


WEATHER_SQL = """weather AS (
  SELECT l_partkey AS station_id, l_shipdate AS "timestamp", CAST(l_quantity - 15 AS DOUBLE) AS temperature, CAST(l_discount * 1000 AS DOUBLE) AS humidity,
         CAST(l_quantity / 3 AS DOUBLE) AS wind_speed, CAST(l_tax * 100 AS DOUBLE) AS precipitation FROM lineitem)"""


def air_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Pollutant readings of all events; users are monitors."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("monitor_id"), F.col("ts").alias("timestamp"), (k / 3).alias("pm25"), k.alias("pm10"), F.col("value").cast("double").alias("no2"), (k / 1000).alias("co"))


AIR_QUALITY_SQL = """air_quality AS (
  SELECT user_id AS monitor_id, ts AS "timestamp", k / 3 AS pm25, k AS pm10, CAST(value AS DOUBLE) AS no2, k / 1000 AS co
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""


def six(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All six datasets with their published metrics, and the sensor column of each."""
    money = fiscal(spark, folder).withColumn("net_per_observation", F.col("revenue") - F.col("expense"))
    tables = {"traffic": traffic(spark, folder), "air_quality": air_quality(spark, folder), "weather": weather(spark, folder), "energy": full_energy(spark, folder),
              "occupancy": occupancy(spark, folder), "fiscal": money}
    return tables, {"traffic": "sensor_id", "air_quality": "monitor_id", "weather": "station_id", "energy": "meter_id", "occupancy": "sensor_id", "fiscal": "sensor_id"}


def six_facts_sql(metrics) -> str:
    """Daily facts of all six datasets: dataset, metric, d, observations, sensors, mean, minimum, maximum."""
    sensors = {"air_quality": "monitor_id", "weather": "station_id", "energy": "meter_id"}
    own = {"energy": "full_energy", "fiscal": "(SELECT *, revenue - expense AS net_per_observation FROM fiscal)"}
    lines = " UNION ALL ".join(
        f"""SELECT '{d}' AS dataset, '{m}' AS metric, CAST("timestamp" AS DATE) AS d, count(*) AS observations, count(DISTINCT {sensors.get(d, "sensor_id")}) AS sensors,
        avg({m}) AS mean, min({m}) AS minimum, max({m}) AS maximum FROM {own.get(d, d)} GROUP BY 3""" for d, ms in metrics.items() for m in ms)
    return f"{TRAFFIC_SQL}, {AIR_QUALITY_SQL}, {WEATHER_SQL}, {ENERGY_SQL}, {FULL_ENERGY_SQL}, {OCCUPANCY_SQL}, {FISCAL_SQL}, six AS ({lines})"


def dirty_traffic(spark: SparkSession, folder: str) -> DataFrame:
    """All events as raw traffic text with defects worked in at fixed places: blanks, bad times, impossible values,
    copies, copies that differ only in spacing, and conflicting readings of one key."""
    m = F.col("event_id") % 50
    e = table(spark, folder, "events").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(m.isin(9, 10, 11), 2).otherwise(1))))
    k = F.get_json_object("props", "$.k").cast("double")
    name = F.concat(F.lit(" u"), F.col("user_id").cast("string"))
    kind = F.col("event_type")
    level = F.when(kind == "error", "high").when(kind == "click", "medium").otherwise("low")
    twin = F.col("copy") == 2
    return e.select(
        F.when(m == 1, "  ").when((m == 10) & twin, F.concat(name, F.lit("  "))).otherwise(name).alias("sensor_id"),
        F.when(m == 2, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(m == 3, 95.0).otherwise(k / 10).alias("location_lat"), (k / 5).alias("location_lon"),
        F.when(m == 4, -F.col("value")).when((m == 11) & twin, F.col("value") + 1).otherwise(F.col("value")).alias("vehicle_count"),
        F.when(m == 5, float("inf")).when(m != 6, k).alias("avg_speed"),
        F.when(m == 7, "impossible").when(m == 8, " HIGH ").otherwise(level).alias("congestion_level"),
        kind.alias("road_type"),
    )


DIRTY_SQL = """dirty AS (
  SELECT CASE WHEN m = 1 THEN '  ' WHEN m = 10 AND copy = 2 THEN name || '  ' ELSE name END AS sensor_id,
    CASE WHEN m = 2 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "timestamp",
    CASE WHEN m = 3 THEN 95.0 ELSE k / 10 END AS location_lat, k / 5 AS location_lon,
    CASE WHEN m = 4 THEN -value WHEN m = 11 AND copy = 2 THEN value + 1 ELSE value END AS vehicle_count,
    CASE WHEN m = 5 THEN CAST('Infinity' AS DOUBLE) WHEN m <> 6 THEN k END AS avg_speed,
    CASE WHEN m = 7 THEN 'impossible' WHEN m = 8 THEN ' HIGH ' WHEN event_type = 'error' THEN 'high' WHEN event_type = 'click' THEN 'medium' ELSE 'low' END AS congestion_level,
    event_type AS road_type
  FROM (SELECT *, event_id % 50 AS m, ' u' || CAST(user_id AS VARCHAR) AS name, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
               unnest(CASE WHEN event_id % 50 IN (9, 10, 11) THEN [1, 2] ELSE [1] END) AS copy FROM events))"""
