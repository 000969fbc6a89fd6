"""Trend, pattern, correlation and cycle queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gaugeworks.operators import statistics as S
from gaugeworks.operators.facts import readings_panel
from gaugeworks.operators.fiscal import MEASURES
from gaugeworks.operators.profiles import melt
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalogue.capacity_queries import OUTER, SIX_TABLES, outer_table
from gaugeworks.plans.catalogue.cleaning_queries import RESAMPLED, resampled
from gaugeworks.plans.catalogue.feature_queries import BY, ORDER
from gaugeworks.plans.catalogue.fiscal_queries import PANEL, panel
from gaugeworks.plans.registry import day, near, num, query, reported

LONG = f"""{PANEL}, long AS (SELECT d, metric, v FROM (SELECT d, revenue, expense, net_per_observation FROM daily) UNPIVOT INCLUDE NULLS (v FOR metric IN (revenue, expense, net_per_observation)))"""


def long_panel(spark, folder):
    """Daily means in long form, so that the series of all metrics are worked on side by side."""
    return melt(panel(spark, folder), ["day"], MEASURES)


@query("linear_trend", f"""WITH {LONG}, a AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN d END) OVER (PARTITION BY metric) - d AS age, d - DATE '1970-01-01' AS x FROM long)
SELECT metric, count(v) AS days, {num("regr_slope(v, x)", "slope_per_day")}, {num("regr_r2(v, x)", "r_squared")}, {num("regr_slope(v, x) FILTER (WHERE age < 30)", "recent_30d_slope")},
  count(v) FILTER (WHERE age < 30) AS recent_30d_observed_days,
  {near("CASE WHEN count(v) FILTER (WHERE age < 7) = 7 AND count(v) FILTER (WHERE age BETWEEN 7 AND 13) = 7 THEN avg(v) FILTER (WHERE age < 7) - avg(v) FILTER (WHERE age BETWEEN 7 AND 13) END", "last_7d_minus_previous_7d")}
FROM a GROUP BY 1""")
def linear_trend(spark, folder):
    return reported(S.linear_trend(long_panel(spark, folder), ["metric"], "value"), "last_7d_minus_previous_7d")


@query("trend_summary", f"""WITH {LONG}, a AS (SELECT *, d - min(d) OVER (PARTITION BY metric) AS x, max(d) OVER (PARTITION BY metric) - d AS z FROM long WHERE v IS NOT NULL)
SELECT metric, count(*) AS observed_days, {num("regr_slope(v, x)", "slope_per_day")}, {num("regr_r2(v, x)", "r_squared")}, {num("avg(v) FILTER (WHERE x < 30)", "first_days_mean")}, {num("avg(v) FILTER (WHERE z < 30)", "last_days_mean")} FROM a GROUP BY 1""")
def trend_summary(spark, folder):
    return reported(S.trend_summary(long_panel(spark, folder), ["metric"], "value"))


@query("per_sensor_trend", f"""WITH {T.TRAFFIC_SQL}, x AS (SELECT *, floor(epoch("timestamp")) / 86400.0 - 19700 AS t FROM traffic)
SELECT sensor_id, count(*) AS observations, {num("max(t) - min(t)", "span_days")}, {num("CASE WHEN count(*) >= 3 THEN regr_slope(vehicle_count, t) END", "slope_per_day")}, {num("CASE WHEN count(*) >= 3 THEN regr_r2(vehicle_count, t) END", "r_squared")} FROM x GROUP BY 1""")
def per_sensor_trend(spark, folder):
    return reported(S.per_sensor_trends(T.traffic(spark, folder), "sensor_id", "vehicle_count"))


STEP = f"""g AS (SELECT *, lag(vehicle_count, 6) OVER w AS ref, stddev_samp(vehicle_count) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 0.001 AS s FROM traffic WINDOW w AS ({BY})),
k AS (SELECT *, CASE WHEN vehicle_count > ref THEN 1 WHEN vehicle_count < ref THEN -1 ELSE 0 END AS dir, CASE WHEN ref IS NOT NULL THEN abs(vehicle_count - ref) / s END AS strength FROM g)"""


def steps(spark, folder, budget=None):
    return S.step_trends(T.traffic(spark, folder), "vehicle_count", "sensor_id", ORDER, budget=budget)


@query("step_trend", f"""WITH {T.TRAFFIC_SQL}, {STEP} SELECT event_id, {num("ref", "vehicle_count_trend_reference")}, CAST(dir AS BIGINT) AS vehicle_count_trend_direction, {near("strength", "vehicle_count_trend_strength")} FROM k""")
def step_trend(spark, folder):
    return reported(steps(spark, folder).select("event_id", "vehicle_count_trend_reference", "vehicle_count_trend_direction", "vehicle_count_trend_strength"), "vehicle_count_trend_strength")


@query("step_trend_summary", f"""WITH {T.TRAFFIC_SQL}, {STEP} SELECT sensor_id, {near("avg(dir)", "avg_trend_direction")}, {num("avg(strength)", "avg_trend_strength")} FROM k GROUP BY 1""")
def step_trend_summary(spark, folder):
    return reported(S.step_trend_summary(steps(spark, folder), "vehicle_count", ["sensor_id"]), "avg_trend_direction")


def _pattern(keys: str, n: int) -> str:
    return f'avg(vehicle_count) OVER (PARTITION BY {keys} ORDER BY "timestamp", event_id ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)'


PATTERN_SQL = f"""WITH {T.TRAFFIC_SQL}, h AS (SELECT *, hour("timestamp") AS hh, dayofweek("timestamp") AS dw FROM traffic),
e AS (SELECT *, {_pattern("hh", 7)} AS e1, {_pattern("dw, hh", 4)} AS e2 FROM h), v AS (SELECT *, abs(vehicle_count - e1) AS d1, abs(vehicle_count - e2) AS d2 FROM e),
s AS (SELECT stddev_samp(d1) AS s1, stddev_samp(d2) AS s2 FROM v)
SELECT event_id, {num("e1", "vehicle_count_expected_daily")}, {num("e2", "vehicle_count_expected_weekly")}, d1 > 2 * s1 AS vehicle_count_anomaly_daily, d2 > 2 * s2 AS vehicle_count_anomaly_weekly FROM v, s"""
PATTERN_COLUMNS = ("event_id", "vehicle_count_expected_daily", "vehicle_count_expected_weekly", "vehicle_count_anomaly_daily", "vehicle_count_anomaly_weekly")


@query("pattern_anomaly", PATTERN_SQL)
def pattern_anomaly(spark, folder):
    return reported(S.pattern_anomalies(T.traffic(spark, folder), "vehicle_count", ORDER).select(*PATTERN_COLUMNS))


@query("pattern_anomaly_sliced", PATTERN_SQL)
def pattern_anomaly_sliced(spark, folder):
    """The same flags with every hour group cut into time slices."""
    return reported(S.pattern_anomalies(T.traffic(spark, folder), "vehicle_count", ORDER, budget=50).select(*PATTERN_COLUMNS))


# energy readings cover every calendar day at the larger scales; days are filled so that the decomposition applies
DAYS = """day_counts AS (SELECT CAST(ts AS DATE) AS d, 'events' AS series, avg(value) AS v FROM events GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM day_counts), (SELECT max(d) FROM day_counts), INTERVAL 1 DAY)) AS DATE) AS d),
s AS (SELECT d, v, count(v) OVER () AS ok, count(*) OVER () AS n FROM cal LEFT JOIN day_counts USING (d))"""


def event_days(spark, folder):
    d = readings_panel(T.traffic(spark, folder), "sensor_id", ["vehicle_count"])
    return d.select(F.lit("events").alias("series"), "day", F.col("vehicle_count").alias("value"))


@query("weekly_decomposition", f"""WITH {DAYS}, t AS (SELECT *, CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END AS trend FROM s WHERE n >= 28 AND ok = n WINDOW w AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
e AS (SELECT isodow(d) AS k, avg(v - trend) AS effect FROM t GROUP BY 1), c AS (SELECT k, effect - avg(effect) OVER () AS component FROM e)
SELECT 'events' AS series, {day("d", "day")}, {num("v", "observed")}, {num("trend", "trend")}, {near("component", "weekly_component")}, {near("v - trend - component", "residual")} FROM t JOIN c ON isodow(d) = k""")
def weekly_decomposition(spark, folder):
    return reported(S.weekly_decomposition(event_days(spark, folder), ["series"], "value"), "weekly_component", "residual")


@query("prior_weekday_deviation", f"""WITH {LONG}, p AS (SELECT *, count(v) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s FROM long WINDOW w AS (PARTITION BY metric, isodow(d) ORDER BY d ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, coalesce(v IS NOT NULL AND n >= 4 AND s > 0, false) AS ok FROM p)
SELECT metric, {day("d", "day")}, {num("v", "value")}, n AS history_n, {num("CASE WHEN n >= 4 THEN m END", "expected")}, {num("CASE WHEN n >= 4 THEN s END", "prior_std")}, ok AS assessed,
  {near("CASE WHEN ok THEN abs(v - m) / s END", "absolute_z")}, CASE WHEN ok THEN abs(v - m) / s > 3 END AS review_flag FROM q""")
def prior_weekday_deviation(spark, folder):
    return reported(S.prior_weekday_deviation(long_panel(spark, folder), ["metric"], "value"), "absolute_z")


@query("mad_flags", f"""WITH {LONG}, p AS (SELECT *, count(v) OVER w AS n, list(v) OVER w AS past FROM long WINDOW w AS (PARTITION BY metric ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE WHEN n = 28 AND v IS NOT NULL THEN list_median(past) END AS med FROM p),
b AS (SELECT *, CASE WHEN med IS NOT NULL THEN list_median(list_transform(past, lambda y: abs(y - med))) END AS mad FROM a),
c AS (SELECT *, CASE WHEN mad > 0 THEN 0.67448975::DOUBLE * (v - med) / mad END AS score FROM b)
SELECT metric, {day("d", "day")}, {num("v", "value")}, {num("med", "prior_median")}, {num("mad", "prior_mad")}, {near("score", "review_score")}, score IS NOT NULL AS assessed, coalesce(abs(score) > 3.5, false) AS review_flag FROM c""")
def mad_flags(spark, folder):
    return reported(S.prior_median_flags(long_panel(spark, folder), ["metric"], "value"), "review_score")


PAIRS = [("revenue", "expense"), ("revenue", "net_per_observation"), ("expense", "net_per_observation")]


def _pair(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS "left", '{b}' AS "right", count(*) AS overlap_days, {day("min(d)", "start")}, {day("max(d)", '"end"')}, {num("corr(a, b)", "pearson_daily_means")},
  count(da) AS difference_pairs, {num("corr(da, db)", "pearson_daily_changes")} FROM (SELECT d, a, b, CASE WHEN d - lag(d) OVER w = 1 THEN a - lag(a) OVER w END AS da, CASE WHEN d - lag(d) OVER w = 1 THEN b - lag(b) OVER w END AS db
  FROM (SELECT d, {a} AS a, {b} AS b FROM daily WHERE {a} IS NOT NULL AND {b} IS NOT NULL) WINDOW w AS (ORDER BY d))"""


@query("daily_pair_corr", f"WITH {PANEL} " + " UNION ALL ".join(_pair(a, b) for a, b in PAIRS))
def daily_pair_corr(spark, folder):
    return reported(S.daily_pair_correlations(panel(spark, folder), list(MEASURES)))


HOURLY = """hourly AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS vehicle_count, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS avg_speed, 1.0 * count(*) AS readings FROM events GROUP BY 1)"""


def _hour_pair(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS "left", '{b}' AS "right", count(*) AS overlap_hours, count(DISTINCT CAST(h AS DATE)) AS overlap_dates, {near(f"corr({a}, {b})", "pearson")}, 'descriptive_association' AS status FROM hourly"""


def hourly(spark, folder):
    return T.traffic(spark, folder).groupBy(F.date_trunc("hour", "timestamp").alias("hour_timestamp")).agg(
        F.avg("vehicle_count").alias("vehicle_count"), F.avg("avg_speed").alias("avg_speed"), F.count("*").cast("double").alias("readings"))


@query("hourly_pair_corr", f"WITH {HOURLY} " + " UNION ALL ".join(_hour_pair(a, b) for a, b in (("vehicle_count", "avg_speed"), ("vehicle_count", "readings"), ("avg_speed", "readings"))))
def hourly_pair_corr(spark, folder):
    return reported(S.hourly_pair_correlations(hourly(spark, folder), ["vehicle_count", "avg_speed", "readings"]), "pearson")


ALL = ("avg_vehicle_count", "avg_occupancy_rate", "avg_guests", "avg_power_consumption", "avg_revenue", "avg_expense", "avg_temperature", "avg_precipitation", "avg_pm25")
ALL_PAIRS = [(a, b) for i, a in enumerate(ALL) for b in ALL[i + 1:]]


@query("all_pairs_corr", f"""WITH {SIX_TABLES}, {OUTER}, r AS ({" UNION ALL ".join(f'SELECT {chr(39)}{a}{chr(39)} AS "left", {chr(39)}{b}{chr(39)} AS "right", count(*) AS records, corr({a}, {b}) AS r FROM j WHERE {a} IS NOT NULL AND {b} IS NOT NULL' for a, b in ALL_PAIRS)})
SELECT "left", "right", records, {near("r", "r")}, CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.5 THEN 'Moderate' WHEN r IS NOT NULL THEN 'Weak' END AS strength, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, "left", "right") AS place FROM r""")
def all_pairs_corr(spark, folder):
    return reported(S.all_pair_correlations(outer_table(spark, folder), list(ALL)), "r")


RANKED = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("spearman_rows", f"""WITH {T.TRAFFIC_SQL}, k AS (SELECT vehicle_count, avg_speed, {RANKED.format(c="vehicle_count")} AS rx, {RANKED.format(c="avg_speed")} AS ry FROM traffic)
SELECT count(*) AS observations, {near("corr(vehicle_count, avg_speed)", "pearson")}, {near("corr(rx, ry)", "spearman")} FROM k""")
def spearman_rows(spark, folder):
    return reported(S.rank_correlation(T.traffic(spark, folder), "vehicle_count", "avg_speed"), "pearson", "spearman")


@query("spearman_rows_split", f"""WITH {T.TRAFFIC_SQL}, k AS (SELECT vehicle_count, avg_speed, {RANKED.format(c="vehicle_count")} AS rx, {RANKED.format(c="avg_speed")} AS ry FROM traffic)
SELECT count(*) AS observations, {near("corr(vehicle_count, avg_speed)", "pearson")}, {near("corr(rx, ry)", "spearman")} FROM k""")
def spearman_rows_split(spark, folder):
    """The same by the plan for more distinct values than one task should order."""
    return reported(S.rank_correlation(T.traffic(spark, folder), "vehicle_count", "avg_speed", budget=200), "pearson", "spearman")


@query("spearman_daily", f"""WITH {PANEL}, k AS (SELECT revenue, expense, {RANKED.format(c="revenue")} AS rx, {RANKED.format(c="expense")} AS ry FROM daily WHERE revenue IS NOT NULL)
SELECT count(*) AS observations, {near("corr(revenue, expense)", "pearson")}, {near("corr(rx, ry)", "spearman")} FROM k""")
def spearman_daily(spark, folder):
    return reported(S.rank_correlation(panel(spark, folder), "revenue", "expense"), "pearson", "spearman")


def _cycle_sql(bins: str, n: str, step: str) -> str:
    angle = f"2 * {math.pi} * ((b * i) % {n}) / {n}"
    return f"p AS (SELECT b, pow(sum(x * cos({angle})), 2) + pow(sum(x * sin({angle})), 2) AS power FROM z, {bins} GROUP BY b)"


INDEXED = "z AS (SELECT v - avg(v) OVER () AS x, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM s)"


def indexed(series, time, value):
    """Even series with its position counted from the first point."""
    first = series.agg(F.min(F.unix_seconds(F.col(time).cast("timestamp"))).alias("a"), F.max(F.unix_seconds(F.col(time).cast("timestamp"))).alias("z"), F.count("*").alias("n")).first()
    step = (first["z"] - first["a"]) // max(1, first["n"] - 1)
    return series.select(F.col(value).alias("v"), ((F.unix_seconds(F.col(time).cast("timestamp")) - F.lit(first["a"])) / F.lit(step)).cast("long").alias("i"))


@query("target_cycles", f"""WITH {RESAMPLED}, {INDEXED}, t AS (SELECT unnest([12.0, 8.0, 24.0])::DOUBLE AS target), nn AS (SELECT max(n) AS n FROM z),
tc AS (SELECT target, b FROM t, nn, (SELECT unnest(range(1, 1489)) AS b) WHERE b <= n / 2 QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(n * 0.25::DOUBLE / b - target), b) = 1),
{_cycle_sql("(SELECT DISTINCT b FROM tc)", "n", "0.25")}
SELECT target AS target_hours, {num("n * 0.25::DOUBLE / b", "period_hours")}, {num("power", "power")}, {num("sqrt(power)", "amplitude")}, {num("100 * power / max(power) OVER ()", "relative_strength")} FROM tc JOIN p USING (b), nn""")
def target_cycles(spark, folder):
    return reported(S.target_cycles(indexed(resampled(spark, folder), "t", "v"), "v", "i", 0.25))


DAILY_SERIES = f"""{PANEL}, s AS (SELECT d AS t, last_value(revenue IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM daily)"""


def daily_series(spark, folder):
    from pyspark.sql import Window
    past = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return panel(spark, folder).select(F.col("day").alias("t"), F.last("revenue", True).over(past).alias("v"))


@query("cycle_rank", f"""WITH {DAILY_SERIES}, {INDEXED}, nn AS (SELECT max(n) AS n FROM z), bins AS (SELECT unnest(range(0, (SELECT n FROM nn) // 2 + 1)) AS b),
{_cycle_sql("bins", "n", "1")}, c AS (SELECT b AS target FROM bins, nn ORDER BY abs(b / n::DOUBLE - 1 / 7.0::DOUBLE), b LIMIT 1)
SELECT {num("(SELECT n FROM nn) / (SELECT target FROM c)::DOUBLE", "period_days")}, count(*) FILTER (WHERE power > (SELECT power FROM p WHERE b = (SELECT target FROM c))) + 1 AS cycle_rank, count(*) AS n_bins FROM p""")
def cycle_rank(spark, folder):
    return reported(S.cycle_rank(indexed(daily_series(spark, folder), "t", "v"), "v", "i"))


@query("top_cycles", f"""WITH m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t, avg(value) AS v FROM events GROUP BY 1),
c AS (SELECT unnest(generate_series((SELECT min(t) FROM m), (SELECT max(t) FROM m), INTERVAL 1 HOUR)) AS t),
s AS (SELECT c.t, coalesce(v, last_value(v IGNORE NULLS) OVER (ORDER BY c.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v FROM c LEFT JOIN m ON m.t = c.t), {INDEXED}, nn AS (SELECT max(n) AS n FROM z),
bins AS (SELECT b FROM (SELECT unnest(range(1, (SELECT n FROM nn) // 2 + 1)) AS b), nn WHERE n / b::DOUBLE BETWEEN 2 AND 168), {_cycle_sql("bins", "n", "1")}, o AS (SELECT *, row_number() OVER (ORDER BY power DESC, b) AS place FROM p)
SELECT b AS bin, {num("power", "power")}, {num("n / b::DOUBLE", "period")}, {num("sqrt(power)", "amplitude")}, place FROM o, nn WHERE place <= 20""")
def top_cycles(spark, folder):
    from pyspark.sql import Window
    hours = hourly(spark, folder).select(F.col("hour_timestamp").alias("t"), F.col("vehicle_count").alias("v"))
    ends = hours.agg(F.min("t").alias("a"), F.max("t").alias("z"))
    grid = ends.select(F.explode(F.sequence("a", "z", F.expr("interval 1 hour"))).alias("t")).join(hours, "t", "left")
    # one row per hour of the calendar
    series = grid.withColumn("v", F.coalesce("v", F.last("v", True).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))))
    return reported(S.top_cycles(indexed(series, "t", "v"), "v", "i"))
