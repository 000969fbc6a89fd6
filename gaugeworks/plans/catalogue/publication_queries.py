"""Publication, retention and replay queries; each works in a fresh store below the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import forecast as FC
from gaugeworks.operators.anomaly import alert_records
from gaugeworks.operators.facts import METRICS, daily_facts, facts_of
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalogue.anomaly_queries import ZSCORE, zscore
from gaugeworks.plans.catalogue.feature_queries import FACTS
from gaugeworks.plans.catalogue.forecast_queries import RADIUS, banded
from gaugeworks.plans.registry import day, num, query, reported
from gaugeworks.session import keep, new_folder
from gaugeworks.sources.writers import insert_new
from gaugeworks.streaming import publish as PB
from gaugeworks.streaming import replay as RP

ONLY_TRAFFIC = {"traffic": ("vehicle_count", "avg_speed")}


def facts(spark, folder):
    return daily_facts(T.traffic(spark, folder), "traffic", "sensor_id", ["vehicle_count", "avg_speed"])


def alerts(spark, folder):
    return alert_records(zscore(spark, folder), "traffic", "sensor_id")


def published(spark, folder):
    root = new_folder(spark, "store")
    status = PB.publish(facts(spark, folder), alerts(spark, folder), root, "run-1", metrics=ONLY_TRAFFIC)
    return root, status


FACT_LINES = f"""SELECT 'traffic' AS dataset, {day("d", "day")}, 'vehicle_count' AS metric, observations, sensors, {num("vc", "mean")}, {num("vl", "minimum")}, {num("vh", "maximum")}, 'run-1' AS run_id FROM f
UNION ALL SELECT 'traffic', {day("d", "day")}, 'avg_speed', observations, sensors, {num("sc", "mean")}, {num("sl", "minimum")}, {num("sh", "maximum")}, 'run-1' FROM f"""


@query("published_facts", f"WITH {T.TRAFFIC_SQL}, {FACTS} {FACT_LINES}")
def published_facts(spark, folder):
    return reported(PB.read_published(spark, published(spark, folder)[0])[0])


@query("published_alerts", f"""WITH {T.TRAFFIC_SQL}, {ZSCORE} SELECT sha256('run-1|traffic|' || sensor_id || '|' || CAST("timestamp" AS VARCHAR)) AS alert_id, CAST(sensor_id AS VARCHAR) AS sensor_id, reasons, 'run-1' AS run_id FROM a WHERE reasons <> ''""")
def published_alerts(spark, folder):
    return reported(PB.read_published(spark, published(spark, folder)[0])[1].select("alert_id", "sensor_id", "reasons", "run_id"))


@query("saved_alerts_checked", f"""WITH {T.TRAFFIC_SQL}, {ZSCORE} SELECT sha256('run-1|traffic|' || sensor_id || '|' || CAST("timestamp" AS VARCHAR)) AS alert_id, 'traffic' AS dataset, CAST(sensor_id AS VARCHAR) AS sensor_id,
  CAST("timestamp" AS VARCHAR) AS observed_at, reasons, 'run-1' AS model_id, 'review' AS severity FROM a WHERE reasons <> ''""")
def saved_alerts_checked(spark, folder):
    """Alerts saved with the run they come from, read back and checked before they take the published shape."""
    saved = keep(zscore(spark, folder).filter("is_alert").withColumn("source_run", F.lit("run-1")))
    return reported(PB.checked_alerts(saved, saved.count(), "source_run", "run-1", "sensor_id", "traffic"))


@query("publish_snapshot", f"""WITH {T.TRAFFIC_SQL}, {FACTS}, {ZSCORE} SELECT 'published' AS status, 'run-1' AS run_id, 2 * (SELECT count(*) FROM f) AS fact_rows, (SELECT count(*) FROM a WHERE reasons <> '') AS alert_rows""")
def publish_snapshot(spark, folder):
    root, status = published(spark, folder)
    f, a = PB.read_published(spark, root)
    both = f.select("run_id", F.lit("fact").alias("kind")).unionByName(a.select("run_id", F.lit("alert").alias("kind")))
    return reported(both.agg(F.lit(status["status"]).alias("status"), F.max("run_id").alias("run_id"), F.count(F.when(F.col("kind") == "fact", 1)).alias("fact_rows"),
                             F.count(F.when(F.col("kind") == "alert", 1)).alias("alert_rows")))


@query("publish_six_datasets", f"""WITH {T.six_facts_sql(METRICS)}
SELECT 'unchanged' AS status, 'run-6' AS run_id, dataset, metric, count(*) AS days, CAST(sum(observations) AS BIGINT) AS observations, {num("min(minimum)", "minimum")}, {num("max(maximum)", "maximum")},
  {num("sum(mean * observations) / sum(observations)", "mean")} FROM six GROUP BY dataset, metric""")
def publish_six_datasets(spark, folder):
    """A snapshot of all six datasets, published, and published again from rows in another order: each task's rows by a hash of their reading."""
    tables, sensors = T.six(spark, folder)
    root = new_folder(spark, "store")
    PB.publish(facts_of(tables, sensors), alerts(spark, folder), root, "run-6")
    again = {name: t.sortWithinPartitions(F.xxhash64(sensors[name], "timestamp", METRICS[name][0])) for name, t in tables.items()}
    status = PB.publish(facts_of(again, sensors), alerts(spark, folder), root, "run-6")
    f, _ = PB.read_published(spark, root)
    f = f.groupBy("run_id", "dataset", "metric").agg(
        F.count("*").alias("days"), F.sum("observations").alias("observations"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        (F.sum(F.col("mean") * F.col("observations")) / F.sum("observations")).alias("mean"))
    return reported(f.withColumn("status", F.lit(status["status"])))


@query("publish_retry", f"""WITH {T.TRAFFIC_SQL}, {FACTS} SELECT 'unchanged' AS status, CAST(1 AS BIGINT) AS ledger_lines, 2 * (SELECT count(*) FROM f) AS fact_rows, true AS changed_content_refused""")
def publish_retry(spark, folder):
    root, _ = published(spark, folder)
    again = PB.publish(facts(spark, folder), alerts(spark, folder), root, "run-1", metrics=ONLY_TRAFFIC)
    try:
        PB.publish(facts(spark, folder).withColumn("maximum", F.col("maximum") + 1), alerts(spark, folder), root, "run-1", metrics=ONLY_TRAFFIC)
        refused = False
    except ValueError:
        refused = True
    f, _ = PB.read_published(spark, root)
    both = f.select(F.lit("fact").alias("kind")).unionByName(PB.ledger(spark, root).select(F.lit("line").alias("kind")))
    return reported(both.agg(F.lit(again["status"]).alias("status"), F.count(F.when(F.col("kind") == "fact", 1)).alias("fact_rows"),
                             F.count(F.when(F.col("kind") == "line", 1)).alias("ledger_lines"), F.lit(refused).alias("changed_content_refused")))


@query("dim_dates", f"""SELECT {day("d", "day")}, year(d) AS year, month(d) AS month, isodow(d) - 1 AS weekday FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)""")
def dim_dates(spark, folder):
    root, _ = published(spark, folder)
    PB.add_dimensions(facts(spark, folder), root)  # a second time adds nothing
    return reported(spark.read.parquet(f"{root}/dim_date"))


@query("snapshot_checks", f"""WITH {T.TRAFFIC_SQL}, {FACTS} SELECT CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS missing_day, CAST(0 AS BIGINT) AS nonfinite,
  2 * (SELECT count(*) FROM f WHERE day(d) = 3) AS bounds, 2 * (SELECT count(*) FROM f WHERE day(d) = 5) AS counts, CAST(0 AS BIGINT) AS unknown_metric, CAST(18 AS BIGINT) AS missing_metric""")
def snapshot_checks(spark, folder):
    """Rule counts over facts with two kinds of damage worked in, checked against the full metric list."""
    f = facts(spark, folder)
    f = f.withColumns({"minimum": F.when(F.dayofmonth("day") == 3, F.col("maximum") + 1).otherwise(F.col("minimum")),
                       "sensors": F.when(F.dayofmonth("day") == 5, F.col("observations") + 1).otherwise(F.col("sensors"))})
    return reported(PB.fact_violations(f))


@query("retention", """SELECT 'run-1' AS run_id""")
def retention(spark, folder):
    """Two runs are published; a year later only the older one may go."""
    root, _ = published(spark, folder)
    PB.publish(facts(spark, folder).withColumn("observations", F.col("observations") + 1), alerts(spark, folder), root, "run-2", metrics=ONLY_TRAFFIC)
    return PB.retention_candidates(spark, root, 90, now="2100-01-01 00:00:00")


@query("lineage_chain", """SELECT 'b-' || max(strftime(o_orderdate, '%Y-%m')) AS run_id FROM orders WHERE month(o_orderdate) % 3 = 1""")
def lineage_chain(spark, folder):
    """Monthly runs of two stages; every third month's record still fits its parent."""
    months = T.table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m"), F.month("o_orderdate").alias("k")).agg(F.count("*").cast("string").alias("digest"))
    base = [F.lit("complete").alias("status"), F.lit("flag").alias("outlier_policy"), "digest"]
    a = months.select(F.concat(F.lit("a-"), "m").alias("run_id"), F.lit("a").alias("stage"), *base, F.lit(None).cast("string").alias("a_run"), F.lit(None).cast("string").alias("a_digest"))
    b = months.select(F.concat(F.lit("b-"), "m").alias("run_id"), F.lit("b").alias("stage"), *base, F.concat(F.lit("a-"), "m").alias("a_run"),
                      F.when(F.col("k") % 3 == 1, F.col("digest")).otherwise("changed").alias("a_digest"))
    return PB.latest_complete_run(keep(a.unionByName(b)), ["a"]).select("run_id")


@query("forecast_publish", f"""WITH {RADIUS} SELECT 'published' AS first_status, 'unchanged' AS second_status, count(*) + 2 AS prediction_rows FROM band WHERE model = 'trailing_7d'""")
def forecast_publish(spark, folder):
    rows = banded(spark, folder).filter("model = 'trailing_7d'")
    test = rows.select(F.lit("test").alias("kind"), "target", F.col("day").alias("target_day"), F.date_sub("day", 1).alias("origin_day"), "actual", "prediction", "lower", "upper")
    last = rows.groupBy("target").agg(F.max("day").alias("origin_day"), F.max_by("prediction", "day").alias("prediction"), F.max_by("lower", "day").alias("lower"), F.max_by("upper", "day").alias("upper"))
    ahead = last.select(F.lit("next_day").alias("kind"), "target", F.date_add("origin_day", 1).alias("target_day"), "origin_day", F.lit(None).cast("double").alias("actual"), "prediction", "lower", "upper")
    lines, root = keep(test.unionByName(ahead)), new_folder(spark, "store")
    first, second = PB.publish_forecast(lines, root, "f-1"), PB.publish_forecast(lines, root, "f-1")
    stored = spark.read.parquet(f"{root}/predictions")
    return reported(stored.agg(F.lit(first["status"]).alias("first_status"), F.lit(second["status"]).alias("second_status"), F.count("*").alias("prediction_rows")))


@query("insert_new_only", """WITH k AS (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem), h AS (SELECT * FROM k WHERE l_suppkey % 2 = 0)
SELECT (SELECT count(*) FROM k) AS source_rows, (SELECT count(*) FROM h) AS before_rows, (SELECT count(*) FROM k) AS after_rows, (SELECT count(*) FROM k) - (SELECT count(*) FROM h) AS inserted_rows, (SELECT count(*) FROM k) AS stored_rows""")
def insert_new_only(spark, folder):
    daily = T.fiscal(spark, folder).groupBy("sensor_id", "timestamp").agg(F.avg("revenue").alias("revenue"), F.avg("expense").alias("expense"))
    daily = keep(daily.withColumns({"location_lat": F.lit(40.0), "location_lon": F.lit(-73.0)}))
    path = new_folder(spark, "fiscal")
    insert_new(daily.filter(F.col("sensor_id") % 2 == 0), path, "fiscal")
    r = insert_new(daily, path, "fiscal")
    return reported(spark.read.parquet(path).agg(F.lit(r.source_rows).alias("source_rows"), F.lit(r.before_rows).alias("before_rows"), F.lit(r.after_rows).alias("after_rows"),
                                                 F.lit(r.inserted_rows).alias("inserted_rows"), F.count("*").alias("stored_rows")))


def streamed(spark, folder, times: int = 1):
    store, files = new_folder(spark, "stream"), new_folder(spark, "replay")
    RP.write_replay_files(alerts(spark, folder), files, 10)
    for _ in range(times):
        RP.replay(spark, files, store, "run-1", new_folder(spark, "checkpoint"))
    return store


STREAM_SQL = f"""WITH {T.TRAFFIC_SQL}, {ZSCORE} SELECT sha256('run-1|traffic|' || sensor_id || '|' || CAST("timestamp" AS VARCHAR)) AS alert_id, 'traffic' AS dataset, CAST(sensor_id AS VARCHAR) AS sensor_id, reasons FROM a WHERE reasons <> ''"""


@query("replay_alerts", STREAM_SQL)
def replay_alerts(spark, folder):
    return reported(RP.stored_alerts(spark, streamed(spark, folder)).select("alert_id", "dataset", "sensor_id", "reasons"))


@query("replay_twice", STREAM_SQL)
def replay_twice(spark, folder):
    """A second replay from a new checkpoint stores nothing more."""
    return reported(RP.stored_alerts(spark, streamed(spark, folder, 2)).select("alert_id", "dataset", "sensor_id", "reasons"))


@query("replay_outbox", f"""WITH {T.TRAFFIC_SQL}, {ZSCORE} SELECT sha256('run-1|traffic|' || sensor_id || '|' || CAST("timestamp" AS VARCHAR)) AS event_id, 'pending' AS delivery_status FROM a WHERE reasons <> ''""")
def replay_outbox(spark, folder):
    return reported(RP.outbox(spark, streamed(spark, folder)).select("event_id", "delivery_status"))
