"""Lag, window, interaction and pair features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gaugeworks.functions.calendar import add_calendar_features
from gaugeworks.operators import features as X
from gaugeworks.operators import profiles as P
from gaugeworks.plans import tables as T
from gaugeworks.plans.registry import day, moment, near, num, query, reported

BY = 'PARTITION BY sensor_id ORDER BY "timestamp", event_id'
ORDER = ("timestamp", "event_id")
EP = """t AS (SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS e FROM traffic)"""


def readings(spark, folder):
    return T.traffic(spark, folder).select("event_id", "sensor_id", "timestamp", "vehicle_count", "avg_speed")


LAGS = ", ".join(f"lag(vehicle_count, {k}) OVER w AS l{k}" for k in (1, 2, 6, 12, 24))


@query("lag_features", f"""WITH {T.TRAFFIC_SQL}, {EP}, g AS (SELECT *, {LAGS}, (e - lag(e) OVER w) / 3600.0 AS h, lag("timestamp") OVER w AS pt FROM t WINDOW w AS ({BY}))
SELECT event_id, {moment("pt", "previous_observation_at")}, {num("h", "elapsed_hours")}, {", ".join(num(f"l{k}", f"vehicle_count_lag_{k}") for k in (1, 2, 6, 12, 24))},
  {near("vehicle_count - l1", "vehicle_count_difference")}, {near("CASE WHEN l1 <> 0 THEN 100 * (vehicle_count - l1) / l1 END", "vehicle_count_pct_change")},
  {near("CASE WHEN h > 0 THEN (vehicle_count - l1) / h END", "vehicle_count_change_per_hour")} FROM g""")
def lag_features(spark, folder):
    d = X.lag_features(readings(spark, folder), "sensor_id", ["vehicle_count"], ORDER).drop("sensor_id", "timestamp", "vehicle_count", "avg_speed")
    return reported(d, "vehicle_count_difference", "vehicle_count_pct_change", "vehicle_count_change_per_hour")


def _prior(d: int) -> str:
    w = f"OVER (PARTITION BY sensor_id ORDER BY e RANGE BETWEEN {d * 86400} PRECEDING AND 1 PRECEDING)"
    return f"count(vehicle_count) {w} AS n{d}, avg(vehicle_count) {w} AS m{d}, stddev_samp(vehicle_count) {w} AS s{d}, min(vehicle_count) {w} AS lo{d}, max(vehicle_count) {w} AS hi{d}"


def _prior_out(d: int) -> str:
    p = f"vehicle_count_prior_{d}d"
    return f"""n{d} AS {p}_count, {num(f"m{d}", f"{p}_mean")}, {near(f"s{d}", f"{p}_std")}, {num(f"lo{d}", f"{p}_min")}, {num(f"hi{d}", f"{p}_max")}, {near(f"hi{d} - lo{d}", f"{p}_range")},
  {near(f"CASE WHEN hi{d} > lo{d} THEN (vehicle_count - lo{d}) / (hi{d} - lo{d}) END", f"{p}_position")}"""


PRIOR_NEAR = [f"vehicle_count_prior_{d}d_{x}" for d in (7, 30) for x in ("std", "range", "position")]
PRIOR_SQL = f"""WITH {T.TRAFFIC_SQL}, {EP}, g AS (SELECT *, {_prior(7)}, {_prior(30)} FROM t) SELECT event_id, {_prior_out(7)}, {_prior_out(30)} FROM g"""


@query("prior_window_features", PRIOR_SQL)
def prior_window_features(spark, folder):
    d = X.prior_window_features(readings(spark, folder), "sensor_id", ["vehicle_count"]).drop("sensor_id", "timestamp", "vehicle_count", "avg_speed")
    return reported(d, *PRIOR_NEAR)


@query("prior_window_features_sliced", PRIOR_SQL)
def prior_window_features_sliced(spark, folder):
    """The same features by the plan for sensors too large for one task."""
    d = X.prior_window_features(readings(spark, folder), "sensor_id", ["vehicle_count"], budget=1).drop("sensor_id", "timestamp", "vehicle_count", "avg_speed")
    return reported(d, *PRIOR_NEAR)


def _rolling(n: int) -> str:
    w = f"OVER ({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"avg(vehicle_count) {w} AS m{n}, stddev_samp(vehicle_count) {w} AS s{n}, min(vehicle_count) {w} AS lo{n}, max(vehicle_count) {w} AS hi{n}"


def _rolling_out(n: int) -> str:
    p = "vehicle_count_rolling"
    return f"""{num(f"m{n}", f"{p}_mean_{n}")}, {near(f"s{n}", f"{p}_std_{n}")}, {num(f"lo{n}", f"{p}_min_{n}")}, {num(f"hi{n}", f"{p}_max_{n}")}, {near(f"hi{n} - lo{n}", f"{p}_range_{n}")},
  {near(f"CASE WHEN hi{n} > lo{n} THEN (vehicle_count - lo{n}) / (hi{n} - lo{n}) ELSE 0.5 END", f"vehicle_count_position_in_window_{n}")}"""


ROLL_NEAR = [f"vehicle_count_rolling_{x}_{n}" for n in (3, 6, 12) for x in ("std", "range")] + [f"vehicle_count_position_in_window_{n}" for n in (3, 6, 12)]
ROLL_SQL = f"""WITH {T.TRAFFIC_SQL}, g AS (SELECT *, {", ".join(map(_rolling, (3, 6, 12)))} FROM traffic) SELECT event_id, {", ".join(map(_rolling_out, (3, 6, 12)))} FROM g"""


@query("trailing_window_features", ROLL_SQL)
def trailing_window_features(spark, folder):
    d = X.trailing_window_features(readings(spark, folder), "sensor_id", ["vehicle_count"], ORDER).drop("sensor_id", "timestamp", "vehicle_count", "avg_speed")
    return reported(d, *ROLL_NEAR)


@query("trailing_window_features_sliced", ROLL_SQL)
def trailing_window_features_sliced(spark, folder):
    """The same features with every sensor cut into time slices."""
    d = X.trailing_window_features(readings(spark, folder), "sensor_id", ["vehicle_count"], ORDER, budget=10).drop("sensor_id", "timestamp", "vehicle_count", "avg_speed")
    return reported(d, *ROLL_NEAR)


@query("calendar_features", f"""WITH {T.TRAFFIC_SQL}, c AS (SELECT event_id, hour("timestamp") AS hour, dayofweek("timestamp") + 1 AS weekday, year("timestamp") AS year, month("timestamp") AS month,
  day("timestamp") AS day_of_month, weekofyear("timestamp") AS week_of_year, dayofweek("timestamp") IN (0, 6) AS is_weekend FROM traffic)
SELECT *, {near(f"sin(2 * {math.pi} * hour / 24)", "hour_sin")}, {near(f"cos(2 * {math.pi} * hour / 24)", "hour_cos")}, {near(f"sin(2 * {math.pi} * (weekday - 1) / 7)", "weekday_sin")},
  {near(f"cos(2 * {math.pi} * (weekday - 1) / 7)", "weekday_cos")} FROM c""")
def calendar_features(spark, folder):
    d = add_calendar_features(readings(spark, folder).select("event_id", "timestamp")).drop("timestamp")
    return reported(d, "hour_sin", "hour_cos", "weekday_sin", "weekday_cos")


@query("interactions", f"""WITH {T.OCCUPANCY_SQL}, {T.FISCAL_SQL}, {T.TRAFFIC_SQL}, {T.WEATHER_SQL}, {T.ENERGY_SQL}, {T.FULL_ENERGY_SQL}, {T.AIR_QUALITY_SQL}
SELECT 'traffic' AS dataset, count(*) AS rows, {num("avg(vehicle_count * avg_speed)", "mean")} FROM traffic
UNION ALL SELECT 'occupancy', count(*), {num("avg(CASE WHEN available_rooms > 0 THEN occupied_rooms / available_rooms END)", "mean")} FROM occupancy
UNION ALL SELECT 'fiscal', count(*), {num("avg(revenue - expense)", "mean")} FROM fiscal
UNION ALL SELECT 'weather', count(*), {num("avg(temperature * humidity)", "mean")} FROM weather
UNION ALL SELECT 'energy', count(*), {num("avg(voltage * current)", "mean")} FROM full_energy
UNION ALL SELECT 'air_quality', count(*), {num("avg(CASE WHEN pm10 > 0 THEN pm25 / pm10 END)", "mean")} FROM air_quality""")
def interactions(spark, folder):
    def one(df, dataset, column):
        return X.interactions(df, dataset).agg(F.lit(dataset).alias("dataset"), F.count("*").alias("rows"), F.avg(column).alias("mean"))
    out = one(T.traffic(spark, folder), "traffic", "vehicle_count_times_speed").unionByName(
        one(T.occupancy(spark, folder), "occupancy", "occupancy_fraction")).unionByName(one(T.fiscal(spark, folder), "fiscal", "net_revenue")).unionByName(
        one(T.weather(spark, folder), "weather", "temperature_times_humidity")).unionByName(
        one(T.full_energy(spark, folder), "energy", "voltage_times_current")).unionByName(one(T.air_quality(spark, folder), "air_quality", "pm25_pm10_ratio"))
    return reported(out)


@query("traffic_indicators", f"""WITH {T.TRAFFIC_SQL} SELECT event_id, {num("vehicle_count * avg_speed", "traffic_flow")}, {num("vehicle_count / (avg_speed + 1)", "congestion_indicator")},
  {num("CASE WHEN vehicle_count > 0 THEN avg_speed / sqrt(vehicle_count) ELSE avg_speed END", "speed_efficiency")} FROM traffic""")
def traffic_indicators(spark, folder):
    return reported(X.indicators(readings(spark, folder), "traffic").drop("sensor_id", "timestamp", "vehicle_count", "avg_speed"))


@query("building_efficiency", f"""WITH {T.ENERGY_SQL} SELECT reading_id, {num("power_consumption / avg(power_consumption) OVER (PARTITION BY building_type)", "building_efficiency")},
  {num("avg(power_consumption) OVER (PARTITION BY building_type)", "avg_building_consumption")} FROM energy""")
def building_efficiency(spark, folder):
    return reported(X.indicators(T.energy(spark, folder), "energy").select("reading_id", "building_efficiency", "avg_building_consumption"))


@query("indicator_totals", f"""WITH {T.OCCUPANCY_SQL}, {T.FISCAL_SQL}, {T.TRAFFIC_SQL}
SELECT 'occupancy' AS dataset, {num("avg(occupied_rooms / (available_rooms + occupied_rooms))", "mean")} FROM occupancy
UNION ALL SELECT 'fiscal', {num("avg(revenue - expense)", "mean")} FROM fiscal
UNION ALL SELECT 'weather', {num("avg(vehicle_count + 0.5 * avg_speed / 100 * (vehicle_count - 14))", "mean")} FROM traffic
UNION ALL SELECT 'air_quality', {num("avg(0.6 * vehicle_count + 0.4 * avg_speed)", "mean")} FROM traffic""")
def indicator_totals(spark, folder):
    t = T.traffic(spark, folder)

    def one(df, dataset, column):
        return X.indicators(df, dataset).agg(F.lit(dataset).alias("dataset"), F.avg(column).alias("mean"))
    parts = [one(T.occupancy(spark, folder), "occupancy", "occupied_share_of_total"), one(T.fiscal(spark, folder), "fiscal", "net_profit"),
             one(t.select(F.col("vehicle_count").alias("temperature"), F.col("avg_speed").alias("humidity")), "weather", "heat_index"),
             one(t.select(F.col("vehicle_count").alias("pm25"), F.col("avg_speed").alias("no2")), "air_quality", "combined_pollution")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return reported(out)


BOUNDS_SQL = """b AS (SELECT CAST(floor(min(e) + 0.6 * (max(e) - min(e))) AS BIGINT) AS b1, CAST(floor(min(e) + 0.8 * (max(e) - min(e))) AS BIGINT) AS b2 FROM t)"""


@query("next_obs_pairs", f"""WITH {T.TRAFFIC_SQL}, {EP}, {BOUNDS_SQL}, g AS (SELECT *, lead(vehicle_count) OVER w AS label, lead(e) OVER w AS fe FROM t WINDOW w AS ({BY})),
p AS (SELECT *, CASE WHEN e < b1 THEN 'train' WHEN e < b2 THEN 'validation' ELSE 'test' END AS o, CASE WHEN fe < b1 THEN 'train' WHEN fe < b2 THEN 'validation' ELSE 'test' END AS f FROM g, b)
SELECT event_id, {num("label", "label")}, {num("(fe - e) / 3600.0", "horizon_hours")}, CASE WHEN label IS NULL THEN 'unlabelled' WHEN o <> f THEN 'purged' ELSE o END AS part FROM p""")
def next_obs_pairs(spark, folder):
    r = readings(spark, folder)
    return reported(X.next_observation_pairs(r, "sensor_id", "vehicle_count", X.time_boundaries(r), ORDER).select("event_id", "label", "horizon_hours", "part"))


FACTS = """f AS (SELECT CAST("timestamp" AS DATE) AS d, count(*) AS observations, count(DISTINCT sensor_id) AS sensors, avg(vehicle_count) AS vc, min(vehicle_count) AS vl, max(vehicle_count) AS vh,
  avg(avg_speed) AS sc, min(avg_speed) AS sl, max(avg_speed) AS sh FROM traffic GROUP BY 1)"""


@query("daily_facts", f"""WITH {T.TRAFFIC_SQL}, {FACTS} SELECT 'traffic' AS dataset, {day("d", "day")}, 'vehicle_count' AS metric, observations, sensors, {num("vc", "mean")}, {num("vl", "minimum")}, {num("vh", "maximum")} FROM f
UNION ALL SELECT 'traffic', {day("d", "day")}, 'avg_speed', observations, sensors, {num("sc", "mean")}, {num("sl", "minimum")}, {num("sh", "maximum")} FROM f""")
def daily_facts(spark, folder):
    from gaugeworks.operators.facts import daily_facts as facts
    return reported(facts(T.traffic(spark, folder), "traffic", "sensor_id", ["vehicle_count", "avg_speed"]))


@query("daily_facts_wide", f"""WITH {T.TRAFFIC_SQL}, {FACTS} SELECT {day("d", "day")}, {num("vc", "vehicle_count")}, {num("sc", "avg_speed")} FROM f""")
def daily_facts_wide(spark, folder):
    from gaugeworks.operators.facts import daily_facts as facts
    return reported(P.spread(facts(T.traffic(spark, folder), "traffic", "sensor_id", ["vehicle_count", "avg_speed"]), ["day"], "metric", ["vehicle_count", "avg_speed"], "mean"))


@query("weighted_range_mean", f"""WITH {T.TRAFFIC_SQL}, {FACTS}, r AS (SELECT * FROM f WHERE d >= DATE '2024-01-05' AND d < DATE '2024-01-20')
SELECT 'traffic' AS dataset, 'vehicle_count' AS metric, {num("sum(vc * observations) / sum(observations)", "mean")}, CAST(sum(observations) AS BIGINT) AS observations, {num("min(vl)", "minimum")}, {num("max(vh)", "maximum")} FROM r
UNION ALL SELECT 'traffic', 'avg_speed', {num("sum(sc * observations) / sum(observations)", "mean")}, CAST(sum(observations) AS BIGINT), {num("min(sl)", "minimum")}, {num("max(sh)", "maximum")} FROM r""")
def weighted_range_mean(spark, folder):
    from gaugeworks.operators.facts import daily_facts as facts
    from gaugeworks.plans.planner import weighted_range
    return reported(weighted_range(facts(T.traffic(spark, folder), "traffic", "sensor_id", ["vehicle_count", "avg_speed"]), "2024-01-05", "2024-01-20"))
