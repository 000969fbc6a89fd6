"""Zone, distance and spatial association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import spatial as S
from gaugeworks.plans import tables as T
from gaugeworks.plans.registry import day, near, num, query, reported

GRID = """zones AS (SELECT n_nationkey AS zone_id, n_name AS zone_name, 'r' || n_regionkey AS zone_type, (n_nationkey % 5) * 1.8 AS lat_min, (n_nationkey % 5) * 1.8 + 1.8 AS lat_max,
  floor(n_nationkey / 5) * 1.8 AS lon_min, floor(n_nationkey / 5) * 1.8 + 1.8 AS lon_max, n_nationkey * 10 AS population FROM nation)"""
PATCHES = """zones AS (SELECT s_suppkey AS zone_id, s_name AS zone_name, 'patch' AS zone_type, (s_suppkey * 13 % 97) / 10 AS lat_min, (s_suppkey * 13 % 97) / 10 + 0.4 AS lat_max,
  (s_suppkey * 29 % 89) / 10 AS lon_min, (s_suppkey * 29 % 89) / 10 + 0.3 AS lon_max FROM supplier)"""
HITS = "location_lat BETWEEN lat_min AND lat_max AND location_lon BETWEEN lon_min AND lon_max"


def grid(spark, folder):
    n = F.col("n_nationkey")
    row, column = (n % 5) * F.lit(1.8), F.floor(n / 5) * F.lit(1.8)
    return T.table(spark, folder, "nation").select(
        n.alias("zone_id"), F.col("n_name").alias("zone_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("zone_type"),
        row.alias("lat_min"), (row + 1.8).alias("lat_max"), column.alias("lon_min"), (column + 1.8).alias("lon_max"), (n * 10).alias("population"))


def patches(spark, folder):
    s = F.col("s_suppkey")
    y, x = s * 13 % 97 / 10, s * 29 % 89 / 10
    return T.table(spark, folder, "supplier").select(
        s.alias("zone_id"), F.col("s_name").alias("zone_name"), F.lit("patch").alias("zone_type"), y.alias("lat_min"), (y + 0.4).alias("lat_max"), x.alias("lon_min"), (x + 0.3).alias("lon_max"))


LOWEST = f"""m AS (SELECT event_id, min(zone_id) AS zone_id, count(*) AS zone_match_count FROM traffic JOIN zones ON {HITS} GROUP BY 1)"""


@query("zone_join_lowest", f"""WITH {T.TRAFFIC_SQL}, {GRID}, {LOWEST}
SELECT event_id, coalesce(zone_match_count, 0) AS zone_match_count, CAST(zone_id AS BIGINT) AS zone_id, zone_name, zone_type FROM traffic LEFT JOIN m USING (event_id) LEFT JOIN zones USING (zone_id)""")
def zone_join_lowest(spark, folder):
    m = S.map_to_zones(T.traffic(spark, folder), grid(spark, folder), ["event_id"], 0.5)
    return reported(m.select("event_id", "zone_match_count", "zone_id", "zone_name", "zone_type"))


@query("zone_join_shuffled", f"""WITH {T.TRAFFIC_SQL}, {PATCHES}, {LOWEST}
SELECT event_id, coalesce(zone_match_count, 0) AS zone_match_count, zone_id, zone_name FROM traffic LEFT JOIN m USING (event_id) LEFT JOIN zones USING (zone_id)""")
def zone_join_shuffled(spark, folder):
    """The plan used when the zone cells are too many to replicate."""
    m = S.map_to_zones(T.traffic(spark, folder), patches(spark, folder), ["event_id"], 0.25, broadcast_bins=0)
    return reported(m.select("event_id", "zone_match_count", "zone_id", "zone_name"))


@query("zone_join_all", f"""WITH {T.TRAFFIC_SQL}, {PATCHES} SELECT event_id, zone_id, zone_name FROM traffic LEFT JOIN zones ON {HITS}""")
def zone_join_all(spark, folder):
    m = S.map_to_zones(T.traffic(spark, folder), patches(spark, folder), ["event_id"], 0.25, ties="all")
    return reported(m.select("event_id", "zone_id", "zone_name"))


@query("zone_day_aggregate", f"""WITH {T.TRAFFIC_SQL}, {GRID}, {LOWEST}, j AS (SELECT * FROM traffic LEFT JOIN m USING (event_id) LEFT JOIN zones USING (zone_id))
SELECT CAST(zone_id AS BIGINT) AS zone_id, zone_name, zone_type, {day('CAST("timestamp" AS DATE)', "day")}, count(*) AS observations, count(DISTINCT sensor_id) AS sensors, {num("avg(vehicle_count)", "mean_count")},
  {num("avg(avg_speed)", "mean_speed")}, count(*) FILTER (WHERE coalesce(zone_match_count, 0) > 1) AS ambiguous_zone_readings FROM j GROUP BY 1, 2, 3, 4""")
def zone_day_aggregate(spark, folder):
    m = S.map_to_zones(T.traffic(spark, folder), grid(spark, folder), ["event_id"], 0.5)
    return reported(S.zone_day_totals(m, "sensor_id", "vehicle_count", "avg_speed"))


@query("location_stability", f"""WITH {T.TRAFFIC_SQL}, s AS (SELECT sensor_id, count(DISTINCT (location_lat, location_lon)) AS c FROM traffic GROUP BY 1)
SELECT count(*) AS sensors, count(*) FILTER (WHERE c = 1) AS stable_location_sensors, count(*) FILTER (WHERE c > 1) AS changing_location_sensors FROM s""")
def location_stability(spark, folder):
    return reported(S.location_stability(T.traffic(spark, folder), "sensor_id"))


SITES = """sites AS (SELECT s_suppkey AS k, s_acctbal / 5000 AS y, (s_suppkey * 37 % 101) / 50 AS x FROM supplier)"""
KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin((radians(b.x) - radians(a.x)) / 2), 2))))"
NEAR = f"""pairs AS (SELECT a.k AS sensor1, b.k AS sensor2, {KM} AS km FROM sites a JOIN sites b ON a.k < b.k WHERE {KM} <= 25)"""


def sites(spark, folder):
    s = F.col("s_suppkey")
    return T.table(spark, folder, "supplier").select(s.alias("k"), (F.col("s_acctbal") / 5000).alias("location_lat"), (s * 37 % 101 / 50).alias("location_lon"))


@query("near_pairs", f"""WITH {SITES}, {NEAR} SELECT sensor1, sensor2, {num("km", "distance_km")} FROM pairs""")
def near_pairs(spark, folder):
    return reported(S.near_pairs(sites(spark, folder), "k", 25))


def _corr_sql(at: str, minimum: int) -> str:
    return f"""WITH {SITES}, {NEAR}, r AS (SELECT l_suppkey AS s, {at} AS t, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT sensor1, sensor2, count(*) AS n, CASE WHEN count(*) >= {minimum} AND min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN corr(a.v, b.v) END AS p
  FROM pairs JOIN r a ON a.s = sensor1 JOIN r b ON b.s = sensor2 AND b.t = a.t GROUP BY 1, 2)
SELECT sensor1, sensor2, {num("km", "distance_km")}, coalesce(n, 0) AS paired_observations, {near("p", "pearson")},
  CASE WHEN p IS NOT NULL THEN 'descriptive_association' ELSE 'insufficient_overlap_or_constant' END AS status FROM pairs LEFT JOIN c USING (sensor1, sensor2)"""


def readings(spark, folder):
    """Ship-day readings of suppliers at the suppliers' fixed places."""
    lines = T.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("timestamp"), "l_quantity")
    return S.checked_join(lines, sites(spark, folder), ["k"], "inner", T.table(spark, folder, "supplier").count())


@query("spatial_corr", _corr_sql("l_shipdate", 60))
def spatial_corr(spark, folder):
    return reported(S.spatial_correlation(readings(spark, folder), "k", "l_quantity", 25, 60), "pearson")


@query("spatial_corr_hour_of_day", _corr_sql("hour(l_shipdate + to_hours(l_partkey % 24))", 2))
def spatial_corr_hour_of_day(spark, folder):
    r = S.checked_join(T.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("k"), (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_partkey").cast("int") % 24)).alias("timestamp"), "l_quantity"),
        sites(spark, folder), ["k"], "inner", T.table(spark, folder, "supplier").count())
    return reported(S.spatial_correlation(r, "k", "l_quantity", 25, 2, align="hour_of_day"), "pearson")
