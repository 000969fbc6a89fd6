"""Daily and monthly fiscal summaries, calendar analogues and event impact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import days_in_month, month_key
from gaugeworks.functions.columns import ratio, weighted_mean
from gaugeworks.operators.gaps import fill_calendar
from gaugeworks.operators.quantiles import exact_quantiles

MEASURES = ("revenue", "expense", "net_per_observation")


def with_net(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.withColumns({"net_per_observation": F.col("revenue") - F.col("expense"), "day": F.to_date(time)})


def daily_summary(rows: DataFrame, sensor: str = "sensor_id", measures: Sequence[str] = MEASURES, windows: Sequence[int] = (7, 30),
                  budget: int | None = None) -> DataFrame:
    """Means, medians and negative share per calendar day, gaps filled, with means over complete calendar windows."""
    means = rows.groupBy("day").agg(
        F.count("*").alias("observations"), F.count_distinct(sensor).alias("sensors"), *[F.avg(m).alias(m) for m in measures],
        F.avg(F.when(F.col("net_per_observation") < 0, 1.0).otherwise(0.0)).alias("negative_share"))
    medians = exact_quantiles(rows, ["day"], {f"{m}_median": (m, .5) for m in measures}, budget=budget)
    panel = fill_calendar(means.join(medians, "day"), "day")
    out = {"weekday": F.date_format("day", "EEEE"), "month": month_key("day")}
    for m in measures:
        for n in windows:
            past = Window.orderBy("day").rowsBetween(-n + 1, 0)  # one row per calendar day
            out[f"{m}_rolling_{n}d"] = F.when(F.count(m).over(past) == n, F.avg(m).over(past))
    return panel.withColumns(out)


def monthly_summary(rows: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    out = rows.groupBy(month_key("day").alias("month")).agg(
        F.count("*").alias("observations"), F.count_distinct("day").alias("observed_days"), *[F.avg(m).alias(m) for m in measures],
        F.max(days_in_month("day")).alias("calendar_days"))
    return out.withColumn("complete_month", F.col("observed_days") == F.col("calendar_days"))


def complete_weeks(daily: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Weekend minus weekday means of Monday-based weeks in which all seven days have every measure."""
    full = F.lit(True)
    for m in measures:
        full = full & F.col(m).isNotNull()
    weekend = F.weekday("day") >= 5
    weeks = daily.groupBy(F.date_trunc("week", "day").cast("date").alias("week_start")).agg(
        F.count(F.when(full, 1)).alias("_full"),
        *[(F.avg(F.when(weekend, F.col(m))) - F.avg(F.when(~weekend, F.col(m)))).alias(m) for m in measures])
    return weeks.filter(F.col("_full") == 7).drop("_full").unpivot(["week_start"], list(measures), "metric", "weekend_minus_weekday")


def week_difference_summary(weeks: DataFrame) -> DataFrame:
    return weeks.groupBy("metric").agg(
        F.count("*").alias("weeks"), F.avg("weekend_minus_weekday").alias("mean"), F.min("weekend_minus_weekday").alias("minimum"),
        F.max("weekend_minus_weekday").alias("maximum"))


def analogue_windows(daily: DataFrame, year: int, event_start: date, event_end: date, candidate_start: date, candidate_end: date,
                     measures: Sequence[str] = MEASURES) -> DataFrame:
    """Every candidate start against the historical windows that begin on the same weekday.

    A historical window lies wholly in the event's month of ``year`` and has every day observed; its means are
    weighted by observations. Candidates and history meet on the weekday; both are calendar-sized.
    """
    length = (event_end - event_start).days + 1
    history = daily.filter((F.year("day") == year) & (F.month("day") == event_start.month))
    seen = F.col("observations").isNotNull()
    for m in measures:
        seen = seen & F.col(m).isNotNull()
    starts = history.select(F.col("day").alias("historical_start"), F.explode(F.sequence(
        F.lit(0), F.lit(length - 1))).alias("_k")).withColumn("day", F.expr("date_add(historical_start, _k)"))
    windows = starts.join(history.filter(seen), "day").groupBy("historical_start").agg(
        F.count("*").alias("_days"), F.sum("observations").alias("observations"), *[weighted_mean(m, "observations").alias(m) for m in measures])
    windows = windows.filter(F.col("_days") == length).drop("_days").withColumn("_w", F.weekday("historical_start"))
    spark = daily.sparkSession
    first, last = F.lit(candidate_start), F.date_sub(F.lit(candidate_end), length - 1)
    candidates = spark.range(1).select(F.explode(F.sequence(first, last)).alias("candidate_start"))
    weekend = F.size(F.filter(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.weekday(F.date_add("candidate_start", k)) >= 5))
    candidates = candidates.withColumns({
        "candidate_end": F.date_add("candidate_start", length - 1), "selected": F.col("candidate_start") == F.lit(event_start),
        "weekend_days": weekend, "_w": F.weekday("candidate_start")})
    return candidates.join(windows, "_w").drop("_w")


def analogue_summary(windows: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    long = windows.unpivot(["candidate_start", "candidate_end", "selected"], list(measures), "metric", "value")
    return long.groupBy("candidate_start", "candidate_end", "selected", "metric").agg(
        F.count("*").alias("analogue_windows"), F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))


def require_windows(windows: DataFrame, label: str) -> DataFrame:
    if windows.limit(1).isEmpty():
        raise ValueError(f"no complete historical {label} analogue windows")
    return windows


def _overall(value: str, weight: str) -> Column:
    """Weighted mean over all rows of a calendar-sized table."""
    w = Window.partitionBy()
    v, n = F.col(value), F.col(weight)
    return ratio(F.sum(v * n).over(w), F.sum(F.when(v.isNotNull(), n)).over(w))


def fiscal_index(monthly: DataFrame, year: int) -> DataFrame:
    """Revenue of each complete month of a year over the observation-weighted year mean."""
    complete = monthly.filter(F.col("complete_month") & F.col("month").startswith(f"{year}-"))
    out = complete.withColumn("annual_revenue", _overall("revenue", "observations"))
    return out.select("month", "revenue", "annual_revenue", ratio("revenue", "annual_revenue").alias("fiscal_index"))


def pressure_index(monthly: DataFrame, weight: str = "capacity_days") -> DataFrame:
    """Occupancy rate of each month over the day-weighted rate of all months."""
    return monthly.withColumn("annual_rate", _overall("occupancy_rate", weight)).withColumn("pressure_index", ratio("occupancy_rate", "annual_rate"))


# Published planning assumptions per scenario, the average daily rate and the tax rates.
EVENT_SCENARIOS = {
    "Conservative": {"visitor_fraction": .40, "people_per_room": 2.3, "nonhotel_spend": 40, "local_retention": .50, "facility_allowance": 300_000, "service_cost": 20},
    "Planning": {"visitor_fraction": .65, "people_per_room": 1.8, "nonhotel_spend": 90, "local_retention": .75, "facility_allowance": 500_000, "service_cost": 35},
    "High activity": {"visitor_fraction": .85, "people_per_room": 1.3, "nonhotel_spend": 160, "local_retention": .90, "facility_allowance": 800_000, "service_cost": 70},
}
AVERAGE_DAILY_RATE = 333.71
HOTEL_TAX, HOTEL_FEE, SALES_TAX = 0.1475, 3.50, 0.08875


def event_impact(parameters: DataFrame, scenarios: Mapping[str, Mapping[str, float]] = EVENT_SCENARIOS, allowance: str | None = None) -> DataFrame:
    """Visitor, lodging, tax and organiser amounts for every parameter row and scenario.

    ``parameters`` has ``attendees``, ``duration`` and ``fiscal_index``; ``allowance`` names a column that replaces
    the scenario's facility allowance.
    """
    fields = list(next(iter(scenarios.values())))
    options = F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(float(s[f])).alias(f) for f in fields]) for n, s in scenarios.items()])
    rows = parameters.withColumn("_s", F.explode(options)).select("*", "_s.*").drop("_s")
    people, days = F.col("attendees"), F.col("duration")
    # whole visitors, halves to even
    rows = rows.withColumn("overnight_visitors", F.bround(people * F.col("visitor_fraction"), 0))
    rows = rows.withColumn("rooms_per_night", F.ceil(F.col("overnight_visitors") / F.col("people_per_room")))
    rows = rows.withColumn("room_nights", F.col("rooms_per_night") * days)
    rows = rows.withColumns({
        "hotel_spending": F.col("room_nights") * F.lit(AVERAGE_DAILY_RATE),
        "baseline_nonhotel": F.col("overnight_visitors") * days * F.col("nonhotel_spend"),
        "event_service_total": people * days * F.col("service_cost"),
        "venue_cost": F.col(allowance) if allowance else F.col("facility_allowance"),
    })
    rows = rows.withColumns({
        "indexed_nonhotel": F.col("baseline_nonhotel") * F.col("fiscal_index"),
        "hotel_taxes_fees": F.col("hotel_spending") * F.lit(HOTEL_TAX) + F.col("room_nights") * F.lit(HOTEL_FEE),
        "organizer_cost": F.col("venue_cost") + F.col("event_service_total"),
    })
    activity: Column = F.col("hotel_spending") + F.col("indexed_nonhotel")
    return rows.withColumns({
        "visitor_activity": activity, "lodging_total": F.col("hotel_spending") + F.col("hotel_taxes_fees"),
        "locally_retained_activity": activity * F.col("local_retention"),
        "taxes_fees": F.col("hotel_taxes_fees") + F.col("indexed_nonhotel") * F.lit(SALES_TAX),
        "organizer_cost_per_attendee": ratio("organizer_cost", people),
    })


def distribution_audit(rows: DataFrame, measures: Sequence[str] = MEASURES, budget: int | None = None) -> DataFrame:
    """Moments and deciles per measure with the share of negative values."""
    from gaugeworks.operators.profiles import melt

    long = melt(rows, [], measures)
    moments = long.groupBy("metric").agg(
        F.count("value").alias("observations"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("minimum"),
        F.max("value").alias("maximum"), F.avg(F.when(F.col("value") < 0, 1.0).otherwise(0.0)).alias("negative_share"))
    points = exact_quantiles(long, ["metric"], {f"p{int(p * 100)}": ("value", p) for p in (.1, .25, .5, .75, .9)}, budget=budget)
    return moments.join(points, "metric")
