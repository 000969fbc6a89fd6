"""Daily and monthly fiscal panels, analogues and event impact."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gaugeworks.operators import fiscal as X
from gaugeworks.operators.contracts import validate_fiscal
from gaugeworks.operators.facts import readings_panel
from gaugeworks.plans import tables as T
from gaugeworks.plans.registry import day, near, num, query, reported

NET = f"""{T.FISCAL_SQL}, n AS (SELECT *, revenue - expense AS net_per_observation, CAST("timestamp" AS DATE) AS d FROM fiscal)"""
PANEL = f"""{NET}, g AS (SELECT d, count(*) AS observations, count(DISTINCT sensor_id) AS sensors, avg(revenue) AS revenue, avg(expense) AS expense, avg(net_per_observation) AS net_per_observation,
  quantile_cont(revenue, 0.5) AS rm, quantile_cont(expense, 0.5) AS em, quantile_cont(net_per_observation, 0.5) AS nm, avg(CASE WHEN net_per_observation < 0 THEN 1.0 ELSE 0.0 END) AS neg FROM n GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM g), (SELECT max(d) FROM g), INTERVAL 1 DAY)) AS DATE) AS d),
daily AS (SELECT * FROM cal LEFT JOIN g USING (d))"""


def rows(spark, folder):
    return X.with_net(T.fiscal(spark, folder))


def panel(spark, folder):
    """Calendar panel of means only, as the planning operators need it."""
    from gaugeworks.operators.gaps import fill_calendar
    return fill_calendar(readings_panel(rows(spark, folder), "sensor_id", X.MEASURES), "day")


def _roll(m: str, n: int) -> str:
    w = f"OVER (ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return num(f"CASE WHEN count({m}) {w} = {n} THEN avg({m}) {w} END", f"{m}_rolling_{n}d")


@query("daily_panel", f"""WITH {PANEL} SELECT {day("d", "day")}, observations, sensors, {num("revenue", "revenue")}, {num("expense", "expense")}, {num("net_per_observation", "net_per_observation")},
  {num("rm", "revenue_median")}, {num("em", "expense_median")}, {num("nm", "net_per_observation_median")}, {num("neg", "negative_share")}, strftime(d, '%A') AS weekday, strftime(d, '%Y-%m') AS month,
  {", ".join(_roll(m, n) for m in X.MEASURES for n in (7, 30))} FROM daily""")
def daily_panel(spark, folder):
    return reported(X.daily_summary(rows(spark, folder)))


@query("fiscal_daily_means", f"""WITH {NET} SELECT {day("d", "day")}, count(*) AS observations, count(DISTINCT sensor_id) AS sensors, {num("avg(revenue)", "revenue")}, {num("avg(expense)", "expense")} FROM n GROUP BY d""")
def fiscal_daily_means(spark, folder):
    return reported(readings_panel(T.fiscal(spark, folder), "sensor_id", ["revenue", "expense"]))


MONTHLY = f"""{NET}, m AS (SELECT strftime(d, '%Y-%m') AS month, count(*) AS observations, count(DISTINCT d) AS observed_days, avg(revenue) AS revenue, avg(expense) AS expense, avg(net_per_observation) AS net_per_observation,
  day(last_day(max(d))) AS calendar_days FROM n GROUP BY 1)"""


@query("monthly_panel", f"""WITH {MONTHLY} SELECT month, observations, observed_days, {num("revenue", "revenue")}, {num("expense", "expense")}, {num("net_per_observation", "net_per_observation")},
  calendar_days, observed_days = calendar_days AS complete_month FROM m""")
def monthly_panel(spark, folder):
    return reported(X.monthly_summary(rows(spark, folder)))


WEEKS = f"""{PANEL}, w AS (SELECT CAST(date_trunc('week', d) AS DATE) AS week_start, count(*) FILTER (WHERE revenue IS NOT NULL AND expense IS NOT NULL) AS k,
  {", ".join(f"avg({m}) FILTER (WHERE isodow(d) >= 6) - avg({m}) FILTER (WHERE isodow(d) < 6) AS {m}" for m in X.MEASURES)} FROM daily GROUP BY 1),
long AS (SELECT week_start, metric, v FROM (SELECT * FROM w WHERE k = 7) UNPIVOT (v FOR metric IN (revenue, expense, net_per_observation)))"""


@query("complete_weeks", f"""WITH {WEEKS} SELECT {day("week_start", "week_start")}, metric, {near("v", "weekend_minus_weekday")} FROM long""")
def complete_weeks(spark, folder):
    return reported(X.complete_weeks(panel(spark, folder)), "weekend_minus_weekday")


@query("week_difference_summary", f"""WITH {WEEKS} SELECT metric, count(*) AS weeks, {near("avg(v)", "mean")}, {near("min(v)", "minimum")}, {near("max(v)", "maximum")} FROM long GROUP BY 1""")
def week_difference_summary(spark, folder):
    return reported(X.week_difference_summary(X.complete_weeks(panel(spark, folder))), "mean", "minimum", "maximum")


ANALOGUES = f"""{PANEL}, h AS (SELECT * FROM daily WHERE year(d) = 1998 AND month(d) = 4),
hw AS (SELECT a.d AS hs, count(*) AS k, sum(b.observations) AS observations, {", ".join(f"sum(b.{m} * b.observations) / sum(b.observations) AS {m}" for m in X.MEASURES)}
  FROM h a JOIN h b ON b.d BETWEEN a.d AND a.d + 2 WHERE b.observations IS NOT NULL GROUP BY 1 HAVING count(*) = 3),
cand AS (SELECT CAST(unnest(generate_series(DATE '2000-04-01', DATE '2000-04-28', INTERVAL 1 DAY)) AS DATE) AS c),
win AS (SELECT c, c + 2 AS ce, c = DATE '2000-04-04' AS selected, (isodow(c) >= 6)::INT + (isodow(c + 1) >= 6)::INT + (isodow(c + 2) >= 6)::INT AS weekend_days, hw.* FROM cand JOIN hw ON isodow(c) = isodow(hs))"""


def windows(spark, folder):
    return X.analogue_windows(panel(spark, folder), 1998, date(2000, 4, 4), date(2000, 4, 6), date(2000, 4, 1), date(2000, 4, 30))


@query("analogue_windows", f"""WITH {ANALOGUES} SELECT {day("c", "candidate_start")}, {day("ce", "candidate_end")}, selected, CAST(weekend_days AS BIGINT) AS weekend_days, {day("hs", "historical_start")},
  CAST(observations AS BIGINT) AS observations, {num("revenue", "revenue")}, {num("expense", "expense")}, {num("net_per_observation", "net_per_observation")} FROM win""")
def analogue_windows(spark, folder):
    return reported(windows(spark, folder))


@query("analogue_summary", f"""WITH {ANALOGUES}, u AS (SELECT c, ce, selected, metric, v FROM (SELECT c, ce, selected, revenue, expense, net_per_observation FROM win) UNPIVOT (v FOR metric IN (revenue, expense, net_per_observation)))
SELECT {day("c", "candidate_start")}, {day("ce", "candidate_end")}, selected, metric, count(*) AS analogue_windows, {num("avg(v)", "mean")}, {num("min(v)", "minimum")}, {num("max(v)", "maximum")} FROM u GROUP BY c, ce, selected, metric""")
def analogue_summary(spark, folder):
    return reported(X.analogue_summary(X.require_windows(windows(spark, folder), "April 1998")))


INDEX = f"""{MONTHLY}, x AS (SELECT month, revenue, sum(revenue * observations) OVER () / sum(observations) OVER () AS annual FROM m WHERE observed_days = calendar_days AND month LIKE '1998-%')"""


def index(spark, folder):
    return X.fiscal_index(X.monthly_summary(rows(spark, folder)), 1998)


@query("fiscal_index", f"""WITH {INDEX} SELECT month, {num("revenue", "revenue")}, {num("annual", "annual_revenue")}, {num("revenue / annual", "fiscal_index")} FROM x""")
def fiscal_index(spark, folder):
    return reported(index(spark, folder))


@query("pressure_index", f"""WITH {T.OCCUPANCY_SQL}, m AS (SELECT strftime("timestamp", '%Y-%m') AS month, avg(occupied_rooms / nullif(available_rooms, 0)) AS r, count(DISTINCT "timestamp") AS capacity_days FROM occupancy GROUP BY 1)
SELECT month, {num("r", "occupancy_rate")}, capacity_days, {num("sum(r * capacity_days) OVER () / sum(capacity_days) OVER ()", "annual_rate")},
  {num("r / (sum(r * capacity_days) OVER () / sum(capacity_days) OVER ())", "pressure_index")} FROM m""")
def pressure_index(spark, folder):
    m = T.occupancy(spark, folder).groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
        F.avg(F.try_divide("occupied_rooms", "available_rooms")).alias("occupancy_rate"), F.count_distinct("timestamp").alias("capacity_days"))
    return reported(X.pressure_index(m))


SCEN = ", ".join(f"('{n}', {s['visitor_fraction']}, {s['people_per_room']}, {s['nonhotel_spend']}, {s['local_retention']}, {s['facility_allowance']}, {s['service_cost']})" for n, s in X.EVENT_SCENARIOS.items())
MONEY = ("hotel_spending", "lodging_total", "baseline_nonhotel", "indexed_nonhotel", "visitor_activity", "locally_retained_activity", "taxes_fees", "hotel_taxes_fees", "venue_cost", "event_service_total", "organizer_cost", "organizer_cost_per_attendee")


@query("event_impact", f"""WITH {INDEX}, s(scenario, vf, ppr, spend, keep, allow, svc) AS (VALUES {SCEN}),
a AS (SELECT month, revenue / annual AS fi, dur, scenario, spend, keep, allow, svc, round_even(CAST(15000 * vf AS DOUBLE), 0) AS ov, ceil(round_even(CAST(15000 * vf AS DOUBLE), 0) / CAST(ppr AS DOUBLE)) AS rooms FROM x, s, (SELECT unnest([2, 3, 4]) AS dur)),
b AS (SELECT *, rooms * dur AS rn, rooms * dur * CAST(333.71 AS DOUBLE) AS hotel_spending, ov * dur * spend AS baseline_nonhotel, 15000 * dur * svc AS event_service_total FROM a),
c AS (SELECT *, baseline_nonhotel * fi AS indexed_nonhotel, hotel_spending * CAST(0.1475 AS DOUBLE) + rn * 3.5 AS hotel_taxes_fees, allow AS venue_cost, allow + event_service_total AS organizer_cost FROM b),
e AS (SELECT *, hotel_spending + indexed_nonhotel AS visitor_activity, hotel_spending + hotel_taxes_fees AS lodging_total, (hotel_spending + indexed_nonhotel) * keep AS locally_retained_activity,
  hotel_taxes_fees + indexed_nonhotel * CAST(0.08875 AS DOUBLE) AS taxes_fees, organizer_cost / 15000.0 AS organizer_cost_per_attendee FROM c)
SELECT month, scenario, CAST(dur AS BIGINT) AS duration, {num("fi", "fiscal_index")}, {num("ov", "overnight_visitors")}, CAST(rooms AS BIGINT) AS rooms_per_night, CAST(rn AS BIGINT) AS room_nights, {", ".join(num(m, m) for m in MONEY)} FROM e""")
def event_impact(spark, folder):
    p = index(spark, folder).select("month", "fiscal_index", F.lit(15000).alias("attendees"), F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("duration"))
    return reported(X.event_impact(p).select("month", "scenario", "duration", "fiscal_index", "overnight_visitors", "rooms_per_night", "room_nights", *MONEY))


def _audit(m: str) -> str:
    return f"""SELECT '{m}' AS metric, count({m}) AS observations, {num(f"avg({m})", "mean")}, {num(f"stddev_samp({m})", "std")}, {num(f"min({m})", "minimum")}, {num(f"max({m})", "maximum")},
  {num(f"avg(CASE WHEN {m} < 0 THEN 1.0 ELSE 0.0 END)", "negative_share")}, {", ".join(num(f"quantile_cont({m}, {p})", f"p{int(p * 100)}") for p in (.1, .25, .5, .75, .9))} FROM n"""


@query("distribution_audit", f"WITH {NET} " + " UNION ALL ".join(_audit(m) for m in X.MEASURES))
def distribution_audit(spark, folder):
    return reported(X.distribution_audit(rows(spark, folder)))


@query("fiscal_strict", f"""WITH {T.FISCAL_SQL}, g AS (SELECT sensor_id, "timestamp", sum(revenue) AS revenue, sum(expense) AS expense FROM fiscal GROUP BY 1, 2)
SELECT {day('CAST("timestamp" AS DATE)', "day")}, count(*) AS rows, {num("sum(revenue - expense)", "net")} FROM g GROUP BY CAST("timestamp" AS DATE)""")
def fiscal_strict(spark, folder):
    """Takings of each supplier and day as strictly checked fiscal input."""
    takings = T.fiscal(spark, folder).groupBy("sensor_id", "timestamp").agg(F.sum("revenue").alias("revenue"), F.sum("expense").alias("expense"))
    checked = validate_fiscal(takings.select(F.col("sensor_id").cast("string").alias("sensor_id"), F.col("timestamp").cast("timestamp").alias("timestamp"), "revenue", "expense",
                                             F.lit(40.0).alias("location_lat"), F.lit(-73.0).alias("location_lon")))
    return reported(checked.groupBy("day").agg(F.count("*").alias("rows"), F.sum("net_per_observation").alias("net")))
