"""Alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import anomaly as A
from gaugeworks.operators.features import split_part, time_boundaries
from gaugeworks.plans import tables as T
from gaugeworks.plans.registry import day, num, query, reported
from gaugeworks.session import keep, new_folder

COLUMNS = ("vehicle_count", "avg_speed")


def parted(spark, folder):
    """Readings with their chronological part, written once: bounds, clusters, threshold and scores all read them."""
    r = T.traffic(spark, folder).select("event_id", "sensor_id", "timestamp", *COLUMNS)
    return keep(r.withColumn("part", split_part("timestamp", time_boundaries(r))))


def part_of(rows, part):
    return rows.filter(F.col("part") == part)


def scored(spark, folder):
    """Test-part readings with distance, reasons and ids."""
    rows = parted(spark, folder)
    detector = A.fit_detector(part_of(rows, "train"), part_of(rows, "validation"), COLUMNS)
    return A.judge(detector, A.score(detector, part_of(rows, "test")), "traffic", "sensor_id", "run-1")


PARTS = """t AS (SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS e FROM traffic), b AS (SELECT CAST(floor(min(e) + 0.6 * (max(e) - min(e))) AS BIGINT) AS b1, CAST(floor(min(e) + 0.8 * (max(e) - min(e))) AS BIGINT) AS b2 FROM t),
p AS (SELECT t.*, CASE WHEN e < b1 THEN 'train' WHEN e < b2 THEN 'validation' ELSE 'test' END AS part FROM t, b)"""


@query("anomaly_scores")
def anomaly_scores(spark, folder):
    return reported(scored(spark, folder).select("event_id", "cluster", "distance_squared", "is_alert", "severity"))


@query("anomaly_score_checks", f"""WITH {T.TRAFFIC_SQL}, {PARTS}
SELECT count(*) AS readings, 0 AS negative_or_missing, 0 AS unknown_cluster, 0 AS flag_without_reason, 0 AS repeated_ids, true AS above_threshold_is_flagged FROM p WHERE part = 'test'""")
def anomaly_score_checks(spark, folder):
    """What must hold for scores whatever the clusters are."""
    rows = parted(spark, folder)
    detector = A.fit_detector(part_of(rows, "train"), part_of(rows, "validation"), COLUMNS)
    s = A.judge(detector, A.score(detector, part_of(rows, "test")), "traffic", "sensor_id", "run-1")
    ids = s.groupBy("alert_id", "sensor_id", "timestamp").agg(F.count("*").alias("n")).groupBy("alert_id").agg(F.count("*").alias("of")).filter("of > 1").count()
    return reported(s.agg(
        F.count("*").alias("readings"), F.count(F.when(F.coalesce(F.col("distance_squared") < 0, F.lit(True)), 1)).alias("negative_or_missing"),
        F.count(F.when(~F.coalesce(F.col("cluster").between(0, len(detector.centres) - 1), F.lit(False)), 1)).alias("unknown_cluster"),
        F.count(F.when(F.col("is_alert") != (F.col("alert_reasons") != ""), 1)).alias("flag_without_reason"), F.lit(ids).cast("long").alias("repeated_ids"),
        F.bool_and(F.col("is_alert") | (F.col("distance_squared") <= detector.threshold)).alias("above_threshold_is_flagged")))


@query("alerts")
def alerts(spark, folder):
    return reported(A.alert_records(scored(spark, folder), "traffic", "sensor_id"))


@query("alert_daily")
def alert_daily(spark, folder):
    return reported(A.alert_daily(scored(spark, folder)))


@query("anomaly_model_reload", f"""WITH {T.TRAFFIC_SQL}, {PARTS} SELECT part, count(*) AS rows, true AS reload_matches FROM p GROUP BY part""")
def anomaly_model_reload(spark, folder):
    rows = parted(spark, folder)
    detector, path = A.fit_detector(part_of(rows, "train"), part_of(rows, "validation"), COLUMNS), new_folder(spark, "detector")
    A.save_detector(detector, spark, path)
    apart = A.largest_difference(detector, A.load_detector(spark, path), part_of(rows, "test"))
    return rows.groupBy("part").agg(F.count("*").alias("rows")).withColumn("reload_matches", F.lit(apart is not None and apart <= 1e-9))


ZSCORE = f"""t AS (SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS e FROM traffic), b AS (SELECT CAST(floor(min(e) + 0.6 * (max(e) - min(e))) AS BIGINT) AS b1, CAST(floor(min(e) + 0.8 * (max(e) - min(e))) AS BIGINT) AS b2 FROM t),
s AS (SELECT avg(vehicle_count) AS m1, stddev_pop(vehicle_count) AS s1, avg(avg_speed) AS m2, stddev_pop(avg_speed) AS s2 FROM t, b WHERE e < b1),
a AS (SELECT *, concat_ws(';', CASE WHEN abs((vehicle_count - m1) / s1) > 3 THEN 'zscore:vehicle_count' END, CASE WHEN abs((avg_speed - m2) / s2) > 3 THEN 'zscore:avg_speed' END) AS reasons FROM t, b, s WHERE e >= b2)"""


def zscore(spark, folder):
    """Alerts by the z-score rule alone (the distance rule is off)."""
    rows = parted(spark, folder)
    return A.judge(A.measure(part_of(rows, "train"), COLUMNS), part_of(rows, "test"), "traffic", "sensor_id", "run-1")


@query("zscore_alerts", f"""WITH {T.TRAFFIC_SQL}, {ZSCORE} SELECT sha256('run-1|traffic|' || sensor_id || '|' || CAST("timestamp" AS VARCHAR)) AS alert_id, 'traffic' AS dataset, CAST(sensor_id AS VARCHAR) AS sensor_id,
  CAST("timestamp" AS VARCHAR) AS observed_at, reasons, 'run-1' AS model_id, 'review' AS severity FROM a WHERE reasons <> ''""")
def zscore_alerts(spark, folder):
    return reported(A.alert_records(zscore(spark, folder), "traffic", "sensor_id"))


@query("zscore_alert_daily", f"""WITH {T.TRAFFIC_SQL}, {ZSCORE} SELECT {day('CAST("timestamp" AS DATE)', "day")}, count(*) FILTER (WHERE reasons <> '') AS alerts, count(*) AS observations,
  {num("avg(CASE WHEN reasons <> '' THEN 1.0 ELSE 0.0 END)", "alert_rate")} FROM a GROUP BY 1""")
def zscore_alert_daily(spark, folder):
    return reported(A.alert_daily(zscore(spark, folder)))


