"""Cleaning, gap filling, lineage and digest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.calendar import standardize_time
from gaugeworks.functions.columns import add_occupancy_rate, row_fingerprint
from gaugeworks.operators import cleaning as CL
from gaugeworks.operators import gaps as G
from gaugeworks.operators import outliers as O
from gaugeworks.operators import quality as Q
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalogue.quality_queries import READ, holes
from gaugeworks.plans.registry import moment, num, query, reported

CLEAN = """n AS (SELECT nullif(trim(sensor_id), '') AS sensor_id, try_cast(nullif(trim("timestamp"), '') AS TIMESTAMP) AS ts, location_lat, location_lon,
  CASE WHEN isfinite(vehicle_count) THEN vehicle_count END AS vehicle_count, CASE WHEN isfinite(avg_speed) THEN avg_speed END AS avg_speed,
  lower(nullif(trim(congestion_level), '')) AS congestion_level, nullif(trim(road_type), '') AS road_type FROM dirty),
q AS (SELECT *, concat_ws(';', CASE WHEN sensor_id IS NULL THEN 'missing:sensor_id' END, CASE WHEN ts IS NULL THEN 'missing:timestamp' END,
  CASE WHEN location_lat IS NULL THEN 'missing:location_lat' END, CASE WHEN location_lon IS NULL THEN 'missing:location_lon' END,
  CASE WHEN vehicle_count IS NULL THEN 'missing:vehicle_count' END, CASE WHEN avg_speed IS NULL THEN 'missing:avg_speed' END,
  CASE WHEN congestion_level IS NULL THEN 'missing:congestion_level' END, CASE WHEN road_type IS NULL THEN 'missing:road_type' END,
  CASE WHEN location_lat < -90 OR location_lat > 90 THEN 'range:location_lat' END, CASE WHEN location_lon < -180 OR location_lon > 180 THEN 'range:location_lon' END,
  CASE WHEN vehicle_count < 0 THEN 'range:vehicle_count' END, CASE WHEN avg_speed < 0 THEN 'range:avg_speed' END,
  CASE WHEN congestion_level NOT IN ('low', 'medium', 'high') THEN 'category:congestion_level' END) AS reasons FROM n),
d AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, ts, location_lat, location_lon, vehicle_count, avg_speed, congestion_level, road_type) AS k FROM q WHERE reasons = ''),
u AS (SELECT *, count(*) OVER (PARTITION BY sensor_id, ts) AS c FROM d WHERE k = 1)"""


@query("clean_accepted", f"""WITH {T.DIRTY_SQL}, {CLEAN} SELECT sensor_id, {moment("ts", '"timestamp"')}, {num("location_lat", "location_lat")}, {num("location_lon", "location_lon")},
  {num("vehicle_count", "vehicle_count")}, {num("avg_speed", "avg_speed")}, congestion_level, road_type FROM u WHERE c = 1""")
def clean_accepted(spark, folder):
    return reported(CL.clean(T.dirty_traffic(spark, folder), "traffic")[0])


@query("clean_quarantine", f"""WITH {T.DIRTY_SQL}, {CLEAN} SELECT reasons AS _reasons, count(*) AS rows FROM q WHERE reasons <> '' GROUP BY 1
UNION ALL SELECT 'exact_duplicate', count(*) FROM d WHERE k > 1 UNION ALL SELECT 'conflicting_primary_key', count(*) FROM u WHERE c > 1""")
def clean_quarantine(spark, folder):
    return reported(CL.quarantine_counts(CL.clean(T.dirty_traffic(spark, folder), "traffic")[1]))


@query("clean_quarantine_rows", f"""WITH {T.DIRTY_SQL}, {CLEAN} SELECT sensor_id, {moment("ts", '"timestamp"')}, road_type, reasons AS _reasons FROM q WHERE reasons <> ''
UNION ALL SELECT sensor_id, {moment("ts", "x")}, road_type, 'exact_duplicate' FROM d WHERE k > 1
UNION ALL SELECT sensor_id, {moment("ts", "x")}, road_type, 'conflicting_primary_key' FROM u WHERE c > 1""")
def clean_quarantine_rows(spark, folder):
    rows = CL.expand_copies(CL.clean(T.dirty_traffic(spark, folder), "traffic")[1])
    return reported(rows.select("sensor_id", "timestamp", "road_type", "_reasons"))


@query("row_fingerprint", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS fingerprint FROM events""")
def row_fingerprints(spark, folder):
    e = T.table(spark, folder, "events").select("event_id", "event_type", "user_id")
    return reported(e.select("event_id", row_fingerprint(e.columns).alias("fingerprint")))


@query("table_digest", """WITH h AS (SELECT CAST('0x' || substr(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 15) AS BIGINT) AS b FROM events)
SELECT count(*) AS rows, bit_xor(b) AS xor_bits, CAST(sum(CAST(b AS HUGEINT)) AS VARCHAR) AS sum_bits FROM h""")
def table_digest(spark, folder):
    return reported(CL.table_digest(T.table(spark, folder, "events").select("event_id", "event_type", "user_id")))


BRACKETS = """k AS (SELECT *, last_value(CASE WHEN vehicle_count IS NOT NULL THEN e END IGNORE NULLS) OVER p AS pt, last_value(vehicle_count IGNORE NULLS) OVER p AS pv,
  first_value(CASE WHEN vehicle_count IS NOT NULL THEN e END IGNORE NULLS) OVER n AS nt, first_value(vehicle_count IGNORE NULLS) OVER n AS nv FROM r
  WINDOW p AS (PARTITION BY sensor_id ORDER BY "timestamp", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY sensor_id ORDER BY "timestamp", event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@query("interpolate_linear", f"""WITH {T.TRAFFIC_SQL}, {READ}, {BRACKETS}, f AS (SELECT *, coalesce(vehicle_count IS NULL AND nt - pt > 0 AND nt - pt <= 43200, false) AS fill FROM k)
SELECT event_id, sensor_id, fill AS vehicle_count_imputed, {num("CASE WHEN fill THEN pv + CAST(e - pt AS DOUBLE) / (nt - pt) * (nv - pv) ELSE vehicle_count END", "vehicle_count")} FROM f""")
def interpolate_linear(spark, folder):
    d = G.interpolate_linear(holes(spark, folder), ["vehicle_count"], ["sensor_id"], ["timestamp", "event_id"], 43200)
    return reported(d.select("event_id", "sensor_id", "vehicle_count_imputed", "vehicle_count"))


@query("fill_locf", f"""WITH {T.TRAFFIC_SQL}, {READ}, {BRACKETS}, f AS (SELECT *, CASE WHEN vehicle_count IS NULL AND (e - pt) / 3600.0 <= 6 THEN pv ELSE vehicle_count END AS filled FROM k)
SELECT event_id, sensor_id, {num("filled", "vehicle_count_filled")}, vehicle_count IS NULL AND filled IS NOT NULL AS vehicle_count_interpolated FROM f""")
def fill_locf(spark, folder):
    d = G.fill_forward(holes(spark, folder), ["vehicle_count"], ["sensor_id"], ["timestamp", "event_id"], 6)
    return reported(d.select("event_id", "sensor_id", "vehicle_count_filled", "vehicle_count_interpolated"))


RESAMPLED = """m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t, avg(value) AS v FROM events GROUP BY 1),
c AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 23:45:00', INTERVAL 15 MINUTE)) AS t),
g AS (SELECT c.t, v, epoch(c.t) AS e, last_value(CASE WHEN v IS NOT NULL THEN epoch(c.t) END IGNORE NULLS) OVER p AS pt, last_value(v IGNORE NULLS) OVER p AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN epoch(c.t) END IGNORE NULLS) OVER n AS nt, first_value(v IGNORE NULLS) OVER n AS nv FROM c LEFT JOIN m ON m.t = c.t
  WINDOW p AS (ORDER BY c.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY c.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT t, CASE WHEN nv IS NULL OR nt = pt THEN pv ELSE pv + (e - pt) / (nt - pt) * (nv - pv) END AS v FROM g WHERE pv IS NOT NULL)"""


def resampled(spark, folder):
    means = T.table(spark, folder, "events").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("v"))
    return G.resample(means, "t", "v", "2024-01-01 00:00:00", "2024-01-31 23:45:00", 15)


@query("resample_regular", f"""WITH {RESAMPLED} SELECT {moment("t", "t")}, {num("v", "v")} FROM s""")
def resample_regular(spark, folder):
    return reported(resampled(spark, folder))


@query("calendar_gap_fill", """WITH d AS (SELECT l_linenumber, l_returnflag, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT l_linenumber, l_returnflag, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1, 2)
SELECT l_linenumber, l_returnflag, strftime(c.day, '%Y-%m-%d') AS day, n FROM c LEFT JOIN d USING (l_linenumber, l_returnflag, day)""")
def calendar_gap_fill(spark, folder):
    by = ["l_linenumber", "l_returnflag"]
    d = T.table(spark, folder, "lineitem").groupBy(*by, F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    return reported(G.fill_calendar(d, "day", by))


@query("calendar_columns", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, dayofweek(ts) + 1 AS day_of_week, dayofweek(ts) IN (0, 6) AS is_weekend FROM events""")
def calendar_columns(spark, folder):
    return reported(standardize_time(T.table(spark, folder, "events").select("event_id", F.col("ts").cast("string").alias("ts")), "ts"))


@query("occupancy_ratio", f"""SELECT l_orderkey, l_linenumber, l_partkey, {num("l_quantity * (1 - l_discount) / CASE WHEN l_quantity > 2 THEN l_quantity END", "occupancy_rate")} FROM lineitem""")
def occupancy_ratio(spark, folder):
    d = T.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 2, F.col("l_quantity")).otherwise(0.0).alias("available_rooms"),
                                                  (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("occupied_rooms"))
    return reported(add_occupancy_rate(d).drop("available_rooms", "occupied_rooms"))


@query("lineage_columns", f"""WITH {T.TRAFFIC_SQL}, {READ} SELECT event_id, '["outlier_detection", "interpolation"]' AS transformations_applied,
  {num("((vehicle_count IS NOT NULL)::INT + (avg_speed IS NOT NULL)::INT) / 2.0", "row_completeness_score")}, coalesce(avg_speed < 0 OR avg_speed > 120, false) OR coalesce(vehicle_count < 0, false) AS has_outliers,
  false AS has_interpolated_values, {num("(SELECT 1 - (2 * count(*) - count(vehicle_count) - count(avg_speed)) / (2.0 * count(*)) FROM r)", "data_quality_score")}, 'run-1' AS _run_id FROM r""")
def lineage_columns(spark, folder):
    d = holes(spark, folder)
    d = Q.add_lineage(O.domain_flags(d, "traffic"), ["outlier_detection", "interpolation"], Q.quality_score(d), {"_run_id": "run-1"})
    return reported(d.select("event_id", "transformations_applied", "row_completeness_score", "has_outliers", "has_interpolated_values", "data_quality_score", "_run_id"))
