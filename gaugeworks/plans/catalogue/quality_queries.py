"""Contract, profile, diagnostic and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import contracts as K
from gaugeworks.operators import outliers as O
from gaugeworks.operators import profiles as P
from gaugeworks.operators import quality as Q
from gaugeworks.functions.columns import is_finite
from gaugeworks.plans import tables as T
from gaugeworks.plans.registry import moment, near, num, query, reported, whole

TEXT = ("sensor_id", "timestamp", "congestion_level", "road_type")
NUMBERS = ("location_lat", "location_lon", "vehicle_count", "avg_speed")
_TS = 'try_cast("timestamp" AS TIMESTAMP)'


def _line(check: str, column: str, condition: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{column}' AS \"column\", count(*) FILTER (WHERE {condition}) AS violations FROM dirty"


REPORT = [_line("rows", "all", "true")]
REPORT += [_line("null", c, f'"{c}" IS NULL') for c in K.CONTRACTS["traffic"].required]
REPORT += [_line("range", "location_lat", "location_lat < -90 OR location_lat > 90"), _line("range", "location_lon", "location_lon < -180 OR location_lon > 180"),
           _line("range", "vehicle_count", "vehicle_count < 0"), _line("range", "avg_speed", "avg_speed < 0"),
           _line("value", "congestion_level", "congestion_level NOT IN ('low', 'medium', 'high')"),
           _line("timestamp", "timestamp", f'"timestamp" IS NOT NULL AND {_TS} IS NULL'),
           "SELECT 'duplicate', 'key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM dirty GROUP BY sensor_id, \"timestamp\")"]
EXTRA = [_line("nonfinite", c, f"{c} IS NOT NULL AND NOT isfinite({c})") for c in NUMBERS] + [_line("blank", c, f"trim(\"{c}\") = ''") for c in TEXT]


@query("contract_report", f"WITH {T.DIRTY_SQL} " + " UNION ALL ".join(REPORT))
def contract_report(spark, folder):
    return reported(K.contract_report(T.dirty_traffic(spark, folder), "traffic"))


@query("profile_extended", f"WITH {T.DIRTY_SQL} " + " UNION ALL ".join(REPORT + EXTRA))
def profile_extended(spark, folder):
    d = T.dirty_traffic(spark, folder)
    return reported(K.contract_report(d, "traffic", K.extended_checks(d)))


@query("cross_field_report", f"""WITH {T.OCCUPANCY_SQL} SELECT 'cross_field' AS "check", 'occupied_vs_available_rooms' AS "column",
  count(*) FILTER (WHERE occupied_rooms * 1.5 > available_rooms) AS violations FROM occupancy""")
def cross_field_report(spark, folder):
    o = T.occupancy(spark, folder).withColumns({"occupied_rooms": F.col("occupied_rooms") * 1.5, "location_lat": F.lit(0.0), "location_lon": F.lit(0.0)})
    return reported(K.contract_report(o, "occupancy").filter(F.col("check") == "cross_field"))


@query("cardinality", f"WITH {T.DIRTY_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT \"{c}\") AS distinct_values FROM dirty" for c in TEXT))
def cardinality(spark, folder):
    return reported(Q.cardinality(T.dirty_traffic(spark, folder), TEXT))


@query("quality_flags", f"""WITH {T.DIRTY_SQL} SELECT "timestamp", road_type,
  sensor_id IS NULL OR "timestamp" IS NULL OR location_lat IS NULL OR location_lon IS NULL OR vehicle_count IS NULL OR avg_speed IS NULL OR congestion_level IS NULL OR road_type IS NULL AS has_missing_values,
  coalesce(isfinite(location_lat) AND location_lat BETWEEN -90 AND 90, false) AS valid_location_lat,
  coalesce(isfinite(location_lon) AND location_lon BETWEEN -180 AND 180, false) AS valid_location_lon,
  coalesce(isfinite(vehicle_count) AND vehicle_count >= 0, false) AS valid_vehicle_count,
  coalesce(isfinite(avg_speed) AND avg_speed BETWEEN 0 AND 90, false) AS valid_avg_speed FROM dirty""")
def quality_flags(spark, folder):
    d = Q.quality_flags(T.dirty_traffic(spark, folder), "traffic", {"avg_speed": (0, 90)})
    return reported(d.drop("sensor_id", *NUMBERS, "congestion_level"))


def _column_profile(c: str, numeric: bool) -> str:
    v = f"var_samp({c})" if numeric and c not in ("location_lat", "location_lon") else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS missing, 100.0 * (count(*) - count("{c}")) / count(*) AS missing_pct, {v} AS variance FROM d"""


@query("profile_numeric", f"""WITH {T.DIRTY_SQL}, d AS (SELECT * REPLACE (CASE WHEN isfinite(avg_speed) THEN avg_speed END AS avg_speed, nullif(trim(sensor_id), '') AS sensor_id,
  CASE WHEN congestion_level = 'low' THEN NULL ELSE congestion_level END AS congestion_level, location_lat * 0 AS location_lat) FROM dirty),
p AS ({" UNION ALL ".join(_column_profile(c, c in NUMBERS) for c in ("sensor_id", "timestamp", *NUMBERS, "congestion_level", "road_type"))})
SELECT "column", missing, {num("missing_pct", "missing_pct")}, {num("variance", "variance")},
  CASE WHEN missing_pct > 5 THEN 'high_missing' WHEN variance < 0.001 THEN 'low_variance' END AS issue FROM p""")
def profile_numeric(spark, folder):
    d = T.dirty_traffic(spark, folder)
    d = d.withColumns({"avg_speed": F.when(is_finite("avg_speed"), F.col("avg_speed")), "sensor_id": F.nullif(F.trim("sensor_id"), F.lit("")),
                       "congestion_level": F.when(F.col("congestion_level") != "low", F.col("congestion_level")), "location_lat": F.col("location_lat") * 0})
    return reported(Q.table_profile(d))


@query("profile_freshness", f"""WITH {T.ENERGY_SQL} SELECT c AS "column", {num("(SELECT date_diff('second', max(\"timestamp\"), TIMESTAMP '2030-01-01') / 3600.0 FROM energy)", "hours_old")}
FROM (SELECT unnest(['reading_id', 'meter_id', 'timestamp', 'building_type', 'power_consumption']) AS c)""")
def profile_freshness(spark, folder):
    profile = Q.table_profile(T.energy(spark, folder), "timestamp", as_of=F.lit("2030-01-01").cast("timestamp_ntz"))
    return reported(profile.select("column", "hours_old"))


@query("sensor_intervals", f"""WITH {T.OCCUPANCY_SQL}, m AS (SELECT DISTINCT sensor_id, "timestamp" AS t FROM occupancy WHERE sensor_id IS NOT NULL AND "timestamp" IS NOT NULL),
w AS (SELECT sensor_id, date_diff('second', lag(t) OVER (PARTITION BY sensor_id ORDER BY t), t) AS wait FROM m)
SELECT sensor_id, count(wait) AS observed_intervals, {num("max(wait)", "max_interval_seconds")}, {num("quantile_cont(wait, 0.5)", "median_interval_seconds")} FROM w GROUP BY 1""")
def sensor_intervals(spark, folder):
    out = Q.reporting_intervals(T.occupancy(spark, folder), "sensor_id", "timestamp")
    return reported(out.withColumns({c: F.col(c).cast("double") for c in ("max_interval_seconds", "median_interval_seconds")}))


@query("duplicate_rows", f"""WITH {T.DIRTY_SQL}, g AS (SELECT count(*) AS n FROM dirty GROUP BY ALL HAVING true)
SELECT (SELECT count(*) FROM dirty) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS distinct_rows,
  (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates""")
def duplicate_rows(spark, folder):
    return reported(Q.duplicate_rows(T.dirty_traffic(spark, folder)))


@query("top_values", f"""WITH {T.DIRTY_SQL}, p AS (SELECT 'congestion_level' AS "column", congestion_level AS value FROM dirty UNION ALL SELECT 'road_type', road_type FROM dirty
  UNION ALL SELECT 'sensor_id', sensor_id FROM dirty),
c AS (SELECT "column", value, count(*) AS readings, count(*) OVER (PARTITION BY "column") AS d FROM p GROUP BY 1, 2)
SELECT "column", value, readings, row_number() OVER (PARTITION BY "column" ORDER BY readings DESC, value) AS place FROM c WHERE d < 20 QUALIFY place <= 5""")
def top_values(spark, folder):
    return reported(P.top_values(T.dirty_traffic(spark, folder), ["congestion_level", "road_type", "sensor_id"]))


def _summary(c: str, sql: str) -> str:
    return f"""SELECT '{c}' AS metric, count({sql}) AS readings, {num(f"avg({sql})", "mean")}, {num(f"stddev_samp({sql})", "std")}, {num(f"min({sql})", "minimum")},
  {num(f"max({sql})", "maximum")}, {num(f"quantile_cont({sql}, 0.25)", "q25")}, {num(f"quantile_cont({sql}, 0.5)", "median")}, {num(f"quantile_cont({sql}, 0.75)", "q75")} FROM lineitem"""


@query("summary_table", " UNION ALL ".join(_summary(c, c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def summary_table(spark, folder):
    return reported(P.summary_table(T.table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("coverage", f"""WITH {T.TRAFFIC_SQL}, g AS (SELECT (epoch_s - lag(epoch_s) OVER (PARTITION BY sensor_id ORDER BY "timestamp")) / 3600.0 AS gap
  FROM (SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS epoch_s FROM traffic))
SELECT (SELECT count(*) FROM traffic) AS rows, (SELECT {moment('min("timestamp")', "s").replace(" AS s", "")} FROM traffic) AS start,
  (SELECT {moment('max("timestamp")', "s").replace(" AS s", "")} FROM traffic) AS "end", (SELECT count(DISTINCT sensor_id) FROM traffic) AS sensors,
  {num("quantile_cont(gap, 0.5)", "median_gap_hours")}, {num("quantile_cont(gap, 0.95)", "p95_gap_hours")} FROM g""")
def coverage(spark, folder):
    return reported(Q.coverage(T.traffic(spark, folder), "sensor_id"))


@query("availability", f"""WITH {T.DIRTY_SQL} SELECT 'avg_speed' AS feature, count(*) AS rows, count(*) - count(avg_speed) AS null_rows, {num("1.0 * count(avg_speed) / count(*)", "available_fraction")} FROM dirty
UNION ALL SELECT 'sensor_id', count(*), count(*) - count(sensor_id), {num("1.0 * count(sensor_id) / count(*)", "x")} FROM dirty""")
def availability(spark, folder):
    return reported(Q.availability(T.dirty_traffic(spark, folder), ["avg_speed", "sensor_id"]))


@query("publication_guard", f"""WITH {T.DIRTY_SQL} SELECT 'sensor_id' AS "column", count(*) FILTER (WHERE sensor_id IS NULL OR trim(sensor_id) = '') AS violations FROM dirty
UNION ALL SELECT 'avg_speed', count(*) FILTER (WHERE avg_speed IS NULL OR NOT isfinite(avg_speed)) FROM dirty
UNION ALL SELECT 'vehicle_count', count(*) FILTER (WHERE vehicle_count IS NULL OR NOT isfinite(vehicle_count)) FROM dirty""")
def publication_guard(spark, folder):
    return reported(Q.publication_guard(T.dirty_traffic(spark, folder), ["sensor_id", "avg_speed", "vehicle_count"]))


READ = """r AS (SELECT sensor_id, "timestamp", event_id, CASE WHEN event_id % 7 <> 3 THEN vehicle_count END AS vehicle_count,
  CASE WHEN sensor_id % 10 = 0 THEN 5.0 ELSE avg_speed END AS avg_speed, CAST(floor(epoch("timestamp")) AS BIGINT) AS e FROM traffic)"""


def holes(spark, folder):
    """Events with a seventh of the counts missing and some sensors stuck."""
    return T.traffic(spark, folder).select(
        "sensor_id", "timestamp", "event_id", F.when(F.col("event_id") % 7 != 3, F.col("vehicle_count")).alias("vehicle_count"),
        F.when(F.col("sensor_id") % 10 == 0, 5.0).otherwise(F.col("avg_speed")).alias("avg_speed"))


@query("sensor_diagnostics", f"""WITH {T.TRAFFIC_SQL}, {READ}, g AS (SELECT sensor_id, e - lag(e) OVER (PARTITION BY sensor_id ORDER BY t) AS gap FROM (SELECT DISTINCT sensor_id, "timestamp" AS t, e FROM r)),
i AS (SELECT sensor_id, count(gap) AS observed_intervals, quantile_cont(gap, 0.5) AS med, max(gap) AS mx FROM g GROUP BY 1),
h AS (SELECT sensor_id, count(*) AS readings, min("timestamp") AS a, max("timestamp") AS z, max(e) AS ze, count(*) - count(vehicle_count) AS m1, count(vehicle_count) AS o1, var_samp(vehicle_count) AS v1,
  count(*) - count(avg_speed) AS m2, count(avg_speed) AS o2, var_samp(avg_speed) AS v2 FROM r GROUP BY 1),
f AS (SELECT *, 100 * (1 - (m1 + m2) / (readings * 2.0)) AS score, (o1 >= 3 AND v1 = 0) OR (o2 >= 3 AND v2 = 0) AS const, mx > 1.5 * 86400 AS late FROM h JOIN i USING (sensor_id))
SELECT sensor_id, readings, {moment("a", "first_reading")}, {moment("z", "last_reading")}, m1 AS vehicle_count_missing, o1 AS vehicle_count_observed, {num("v1", "vehicle_count_variance")},
  m2 AS avg_speed_missing, o2 AS avg_speed_observed, {num("v2", "avg_speed_variance")}, {num("100.0 * m1 / readings", "vehicle_count_missing_pct")}, {num("100.0 * m2 / readings", "avg_speed_missing_pct")},
  {num("score", "completeness_score")}, const AS constant_measurement_flag, observed_intervals, {num("med", "median_interval_seconds")}, mx AS max_interval_seconds,
  {num("((SELECT max(e) FROM r) - ze) / 3600.0", "hours_behind_dataset_latest")}, true AS schedule_assessed, late AS long_interval_flag,
  CASE WHEN score < 100 OR const OR late THEN 'review' ELSE 'no_flag_in_assessed_checks' END AS review_status FROM f""")
def sensor_diagnostics(spark, folder):
    return reported(Q.sensor_diagnostics(holes(spark, folder), "sensor_id", ["vehicle_count", "avg_speed"], expected_seconds=86400))


@query("sensor_health", f"""WITH {T.TRAFFIC_SQL}, {READ}, g AS (SELECT *, (e - lag(e) OVER (PARTITION BY sensor_id ORDER BY "timestamp")) / 60.0 AS gap FROM r),
h AS (SELECT sensor_id, count(*) AS total_readings, min("timestamp") AS a, max("timestamp") AS z, round(avg(gap), 2) AS ag, round(max(gap), 2) AS mg,
  round(100.0 * (count(*) - count(vehicle_count)) / count(*), 2) AS m1, round(100.0 * (count(*) - count(avg_speed)) / count(*), 2) AS m2, var_samp(vehicle_count) AS v1, var_samp(avg_speed) AS v2 FROM g GROUP BY 1),
s AS (SELECT *, floor(greatest(0.0, 100 - (m1 + m2) / 2 - CASE WHEN coalesce(v1, 0) = 0 OR coalesce(v2, 0) = 0 THEN 25 ELSE 0 END - CASE WHEN mg > 3 * ag THEN 15 ELSE 0 END) * 100 + 0.5000001) / 100 AS health_score FROM h)
SELECT sensor_id, total_readings, {moment("a", "first_reading")}, {moment("z", "last_reading")}, {num("m1", "vehicle_count_missing_pct")}, {num("v1", "vehicle_count_variance")}, {num("v2", "avg_speed_variance")},
  {num("m2", "avg_speed_missing_pct")}, {num("ag", "avg_gap_minutes")}, {num("mg", "max_gap_minutes")}, {num("health_score", "health_score")}, CASE WHEN health_score > 80 THEN 'healthy' WHEN health_score > 60 THEN 'warning' ELSE 'critical' END AS status FROM s""")
def sensor_health(spark, folder):
    return reported(Q.sensor_health(holes(spark, folder), "sensor_id", ["vehicle_count", "avg_speed"]))


def _missing(group: str) -> str:
    return " UNION ALL ".join(f"""SELECT {group} AS "group", '{c}' AS measurement, count(*) AS rows, count(*) - count({c}) AS missing_cells,
  {num(f"100.0 * (count(*) - count({c})) / count(*)", "missing_pct")}, 100.0 * (count(*) - count({c})) / count(*) > 10 AS above_limit FROM r GROUP BY 1""" for c in ("vehicle_count", "avg_speed"))


@query("missing_patterns_hour", f"""WITH {T.TRAFFIC_SQL}, {READ} {_missing('hour("timestamp")')}""")
def missing_patterns_hour(spark, folder):
    return reported(Q.missing_patterns(holes(spark, folder), F.hour("timestamp"), ["vehicle_count", "avg_speed"]))


@query("missing_patterns_weekday", f"""WITH {T.TRAFFIC_SQL}, {READ} {_missing('dayofweek("timestamp") + 1')}""")
def missing_patterns_weekday(spark, folder):
    return reported(Q.missing_patterns(holes(spark, folder), F.dayofweek("timestamp"), ["vehicle_count", "avg_speed"]))


@query("missing_patterns_sensor", f"""WITH {T.TRAFFIC_SQL}, {READ} {_missing("sensor_id")}""")
def missing_patterns_sensor(spark, folder):
    return reported(Q.missing_patterns(holes(spark, folder), F.col("sensor_id"), ["vehicle_count", "avg_speed"]))


LINE_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
BOUNDS = """b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM x),
f AS (SELECT *, l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1) AS iqr, abs((l_extendedprice - m) / s) > 3 AS z, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM x, b)"""
SPIKED = "x AS (SELECT * REPLACE (CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS l_extendedprice) FROM lineitem)"


def spiked(spark, folder):
    price = F.col("l_extendedprice")
    return T.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_orderkey") % 97 == 0, price * 10).otherwise(price).alias("l_extendedprice"))


@query("outlier_flags_global", f"""WITH {SPIKED}, {BOUNDS} SELECT {LINE_ID}, {num("l_extendedprice", "l_extendedprice")}, iqr AS l_extendedprice_iqr_outlier, z AS l_extendedprice_zscore_outlier FROM f""")
def outlier_flags_global(spark, folder):
    d = spiked(spark, folder)
    return reported(O.flag_outliers(d, O.fit_bounds(d, ["l_extendedprice"])))


@query("outlier_flags_approximate")
def outlier_flags_approximate(spark, folder):
    d = spiked(spark, folder)
    return reported(O.flag_outliers(d, O.fit_bounds(d, ["l_extendedprice"], exact=False)))


@query("outlier_clip", f"""WITH {SPIKED}, {BOUNDS} SELECT {LINE_ID}, {num("CASE WHEN iqr THEN greatest(lo, least(l_extendedprice, hi)) ELSE l_extendedprice END", "l_extendedprice")},
  iqr AS l_extendedprice_iqr_outlier, z AS l_extendedprice_zscore_outlier, {num("l_extendedprice", "l_extendedprice_original")}, iqr AS l_extendedprice_treated FROM f""")
def outlier_clip(spark, folder):
    d = spiked(spark, folder)
    return reported(O.flag_outliers(d, O.fit_bounds(d, ["l_extendedprice"]), "clip", ["l_extendedprice"]))


@query("outlier_removed", f"""WITH {SPIKED}, {BOUNDS} SELECT count(*) AS rows, {num("avg(l_extendedprice)", "mean")} FROM f WHERE NOT iqr""")
def outlier_removed(spark, folder):
    d = spiked(spark, folder)
    d = O.flag_outliers(d, O.fit_bounds(d, ["l_extendedprice"]))
    return reported(O.drop_or_impute(d, "l_extendedprice", "l_extendedprice_iqr_outlier", "remove").agg(F.count("*").alias("rows"), F.avg("l_extendedprice").alias("mean")))


@query("outlier_impute", f"""WITH {SPIKED}, {BOUNDS} SELECT {LINE_ID}, {num("CASE WHEN iqr THEN (SELECT quantile_cont(l_extendedprice, 0.5) FROM f WHERE NOT iqr) ELSE l_extendedprice END", "l_extendedprice")},
  iqr AS l_extendedprice_imputed FROM f""")
def outlier_impute(spark, folder):
    d = spiked(spark, folder)
    d = O.flag_outliers(d, O.fit_bounds(d, ["l_extendedprice"]))
    d = O.drop_or_impute(d, "l_extendedprice", "l_extendedprice_iqr_outlier", "impute")
    return reported(d.drop("l_extendedprice_original", "l_extendedprice_iqr_outlier", "l_extendedprice_zscore_outlier"))


GROUPED = """g AS (SELECT *, quantile_cont(l_extendedprice, 0.25) OVER w AS q1, quantile_cont(l_extendedprice, 0.75) OVER w AS q3, avg(l_extendedprice) OVER w AS m, stddev_samp(l_extendedprice) OVER w AS s
  FROM x WINDOW w AS (PARTITION BY l_suppkey)),
o AS (SELECT *, coalesce(q3 > q1 AND (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)), false) AS iqr, CASE WHEN s > 0 THEN abs((l_extendedprice - m) / s) END AS z FROM g)"""


@query("outlier_flags_by_sensor", f"""WITH {SPIKED}, {GROUPED} SELECT {LINE_ID}, {num("l_extendedprice", "l_extendedprice")}, iqr AS l_extendedprice_outlier_iqr, {num("z", "l_extendedprice_zscore")}, coalesce(z > 3, false) AS l_extendedprice_outlier_zscore FROM o""")
def outlier_flags_by_sensor(spark, folder):
    return reported(O.flag_by_group(spiked(spark, folder), ["l_extendedprice"], ["l_suppkey"]))


@query("outlier_cap", f"""WITH {SPIKED}, {GROUPED}, p AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.95) AS b FROM x)
SELECT {LINE_ID}, {num("CASE WHEN iqr OR coalesce(z > 3, false) THEN greatest(a, least(b, l_extendedprice)) ELSE l_extendedprice END", "l_extendedprice_capped")} FROM o, p""")
def outlier_cap(spark, folder):
    d = O.flag_by_group(spiked(spark, folder), ["l_extendedprice"], ["l_suppkey"])
    return reported(O.treat(d, "cap").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice_capped"))


@query("outlier_treat_impute", f"""WITH {SPIKED}, {GROUPED}, a AS (SELECT quantile_cont(l_extendedprice, 0.5) AS v FROM o WHERE NOT iqr), b AS (SELECT quantile_cont(l_extendedprice, 0.5) AS v FROM o WHERE NOT coalesce(z > 3, false))
SELECT {LINE_ID}, {num("CASE WHEN coalesce(z > 3, false) THEN b.v WHEN iqr THEN a.v ELSE l_extendedprice END", "l_extendedprice_imputed")} FROM o, a, b""")
def outlier_treat_impute(spark, folder):
    d = O.flag_by_group(spiked(spark, folder), ["l_extendedprice"], ["l_suppkey"])
    return reported(O.treat(d, "impute").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice_imputed"))


@query("domain_flags", f"""WITH {T.DIRTY_SQL} SELECT "timestamp", coalesce(avg_speed < 0 OR avg_speed > 120, false) AS speed_outlier_domain, coalesce(vehicle_count < 0, false) AS vehicle_count_outlier_domain FROM dirty""")
def domain_flags(spark, folder):
    return reported(O.domain_flags(T.dirty_traffic(spark, folder), "traffic").select("timestamp", "speed_outlier_domain", "vehicle_count_outlier_domain"))


@query("unit_convert", f"""WITH {T.TRAFFIC_SQL} SELECT event_id, {num("avg_speed * 1.609344", "speed_kmh")}, 'km/h' AS speed_kmh_unit, {num("(vehicle_count - 32) * 5 / 9", "temperature_celsius")}, 'C' AS temperature_celsius_unit,
  {num("vehicle_count / 1000", "power_kw")}, 'kW' AS power_kw_unit FROM traffic""")
def unit_convert(spark, folder):
    d = T.traffic(spark, folder).select("event_id", "avg_speed", F.col("vehicle_count").alias("temperature"), F.col("vehicle_count").alias("power_consumption"))
    d = O.convert_units(d, {"avg_speed": "mph", "temperature": "F", "power_consumption": "W", "absent": None}, labels=True)
    return reported(d.drop("avg_speed", "temperature", "power_consumption"))
