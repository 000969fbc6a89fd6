"""Feature columns built from a sensor's own past."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import add_calendar_features, epoch
from gaugeworks.functions.columns import ratio
from gaugeworks.operators.gaps import fill_calendar
from gaugeworks.operators.slices import BROADCAST_KEYS, checked_join, elapsed_stats, with_halo


def lag_features(df: DataFrame, sensor: str, values: Sequence[str], order: Sequence[str] = ("timestamp",),
                 lags: Sequence[int] = (1, 2, 6, 12, 24), budget: int | None = None) -> DataFrame:
    """Lags in observations, difference, percent change and change per elapsed hour."""
    s = with_halo(df, [sensor], order, before=max(*lags, 1), budget=budget)
    w = s.window(*order)
    time = order[0]
    hours = (epoch(time) - F.lag(epoch(time)).over(w)) / 3600
    out = s.frame.withColumns({
        "previous_observation_at": F.lag(time).over(w), "elapsed_hours": hours,
        **{f"{v}_lag_{k}": F.lag(v, k).over(w) for v in values for k in lags},
        **{f"_before_{v}": F.lag(v, 1).over(w) for v in values},
    })
    change = {}
    for v in values:
        before = F.col(f"_before_{v}")
        change |= {
            f"{v}_difference": F.col(v) - before,
            f"{v}_pct_change": F.when(before != 0, 100 * ratio(F.col(v) - before, before)),
            f"{v}_change_per_hour": F.when(F.col("elapsed_hours") > 0, ratio(F.col(v) - before, "elapsed_hours")),
        }
    return s.own(out.withColumns(change)).drop(*[f"_before_{v}" for v in values])


def prior_window_features(df: DataFrame, sensor: str, values: Sequence[str], time: str = "timestamp",
                          days: Sequence[int] = (7, 30), budget: int | None = None) -> DataFrame:
    """Statistics of the elapsed days before the current timestamp, with range and position in that range."""
    out = elapsed_stats(df, [sensor], time, values, days, budget)
    for v in values:
        for d in days:
            low, high = F.col(f"{v}_prior_{d}d_min"), F.col(f"{v}_prior_{d}d_max")
            out = out.withColumns({f"{v}_prior_{d}d_range": high - low,
                                   f"{v}_prior_{d}d_position": F.when(high > low, ratio(F.col(v) - low, high - low))})
    return out


def time_features(df: DataFrame, sensor: str, values: Sequence[str], order: Sequence[str] = ("timestamp",), budget: int | None = None) -> DataFrame:
    """Calendar, lag and prior-window features together."""
    out = lag_features(add_calendar_features(df, order[0]), sensor, values, order, budget=budget)
    return prior_window_features(out, sensor, values, order[0], budget=budget)


def trailing_window_features(df: DataFrame, sensor: str, values: Sequence[str], order: Sequence[str] = ("timestamp",),
                             windows: Sequence[int] = (3, 6, 12), budget: int | None = None) -> DataFrame:
    """Statistics over the last n observations, the current one included; position is 0.5 in a flat window."""
    s = with_halo(df, [sensor], order, before=max(windows) - 1, budget=budget)
    out = s.frame
    for v in values:
        for n in windows:
            w = s.window(*order).rowsBetween(-n + 1, 0)
            out = out.withColumns({
                f"{v}_rolling_mean_{n}": F.avg(v).over(w), f"{v}_rolling_std_{n}": F.stddev_samp(v).over(w),
                f"{v}_rolling_min_{n}": F.min(v).over(w), f"{v}_rolling_max_{n}": F.max(v).over(w)})
            low, high = F.col(f"{v}_rolling_min_{n}"), F.col(f"{v}_rolling_max_{n}")
            out = out.withColumns({
                f"{v}_rolling_range_{n}": high - low,
                f"{v}_position_in_window_{n}": F.when(high > low, ratio(F.col(v) - low, high - low)).otherwise(F.lit(0.5))})
    return s.own(out)


def interactions(df: DataFrame, dataset: str) -> DataFrame:
    """Plain products, differences and guarded ratios of a dataset's measures."""
    c = F.col
    rules: dict[str, dict[str, Column]] = {
        "traffic": {"vehicle_count_times_speed": c("vehicle_count") * c("avg_speed")},
        "weather": {"temperature_times_humidity": c("temperature") * c("humidity")},
        "energy": {"voltage_times_current": c("voltage") * c("current")},
        "occupancy": {"occupancy_fraction": F.when(c("available_rooms") > 0, ratio("occupied_rooms", "available_rooms"))},
        "fiscal": {"net_revenue": c("revenue") - c("expense")},
        "air_quality": {"pm25_pm10_ratio": F.when(c("pm10") > 0, ratio("pm25", "pm10"))},
    }
    return df.withColumns(rules[dataset])


def indicators(df: DataFrame, dataset: str) -> DataFrame:
    """Composite indicators of a dataset; the energy one compares each reading with its building type's mean."""
    c = F.col
    rules: dict[str, dict[str, Column]] = {
        "traffic": {
            "traffic_flow": c("vehicle_count") * c("avg_speed"),
            "congestion_indicator": ratio("vehicle_count", c("avg_speed") + 1),
            "speed_efficiency": F.when(c("vehicle_count") > 0, ratio("avg_speed", F.sqrt(F.greatest(c("vehicle_count"), F.lit(0))))).otherwise(c("avg_speed")),
        },
        "air_quality": {"combined_pollution": 0.6 * c("pm25") + 0.4 * c("no2")},
        "weather": {"heat_index": c("temperature") + 0.5 * (c("humidity") / 100) * (c("temperature") - 14)},
        "occupancy": {"total_rooms": c("available_rooms") + c("occupied_rooms"),
                      "occupied_share_of_total": F.when(c("available_rooms") + c("occupied_rooms") > 0,
                                                        ratio("occupied_rooms", c("available_rooms") + c("occupied_rooms")))},
        "fiscal": {"net_profit": c("revenue") - c("expense")},
    }
    if dataset != "energy":
        return df.withColumns(rules[dataset])
    out = df
    if {"voltage", "current"} <= set(df.columns):
        out = out.withColumn("calculated_power_factor", ratio("power_consumption", c("voltage") * c("current") / 1000))
    if "building_type" in df.columns:
        means = df.groupBy("building_type").agg(F.avg("power_consumption").alias("avg_building_consumption"))
        types = df.select("building_type").distinct().limit(BROADCAST_KEYS + 1).count()
        out = checked_join(out, means, ["building_type"], "left", types).withColumn(
            "building_efficiency", ratio("power_consumption", "avg_building_consumption"))
    return out


def time_boundaries(df: DataFrame, time: str = "timestamp", fractions: tuple[float, float] = (0.6, 0.8)) -> tuple[int, int]:
    """Epoch seconds at which the training and validation parts of the elapsed span end."""
    row = df.agg(F.min(epoch(time)).alias("a"), F.max(epoch(time)).alias("z")).first()
    if row["a"] is None or row["z"] <= row["a"]:
        raise ValueError("a nonzero time span is needed")
    return tuple(int(row["a"] + f * (row["z"] - row["a"])) for f in fractions)


def split_part(time: Column | str, bounds: tuple[int, int]) -> Column:
    at = epoch(time)
    return F.when(at < bounds[0], "train").when(at < bounds[1], "validation").otherwise("test")


def next_observation_pairs(df: DataFrame, sensor: str, target: str, bounds: tuple[int, int],
                           order: Sequence[str] = ("timestamp",), budget: int | None = None) -> DataFrame:
    """Each reading with the sensor's next one as label, its horizon, and its part.

    A pair whose label lies beyond the end of its own part is ``purged``; a last reading has no label.
    """
    time = order[0]
    s = with_halo(df, [sensor], order, after=1, budget=budget)
    w = s.window(*order)
    pairs = s.own(s.frame.withColumns({"label": F.lead(target).over(w), "target_timestamp": F.lead(time).over(w)}))
    pairs = pairs.withColumn("horizon_hours", (epoch("target_timestamp") - epoch(time)) / 3600)
    origin, future = split_part(time, bounds), split_part("target_timestamp", bounds)
    part = F.when(F.col("label").isNull(), "unlabelled").when(origin != future, "purged").otherwise(origin)
    return pairs.withColumn("part", part)


TARGETS = ("revenue", "expense")


def daily_forecast_features(daily: DataFrame, targets: Sequence[str] = TARGETS, day: str = "day") -> DataFrame:
    """Features of each calendar day from the days before it; NULL where any day of a window is missing.

    The panel has one row per day, so one ordered window over it is small whatever the raw data size.
    """
    panel = fill_calendar(daily, day)
    w = Window.orderBy(day)
    out = {}
    for t in targets:
        for n in (7, 28):
            past = w.rowsBetween(-n, -1)
            out[f"{t}_past{n}_mean"] = F.when(F.count(t).over(past) == n, F.avg(t).over(past))
        out |= {f"{t}_lag1": F.lag(t, 1).over(w), f"{t}_lag7": F.lag(t, 7).over(w)}
    out |= {f"weekday_{i}": (F.weekday(day) == i).cast("double") for i in range(1, 7)}
    return panel.withColumns(out)


def feature_names(targets: Sequence[str] = TARGETS) -> list[str]:
    return [f"{t}_{s}" for t in targets for s in ("lag1", "lag7", "past7_mean", "past28_mean")] + [f"weekday_{i}" for i in range(1, 7)]


PARTS = ("train", "validation", "calibration", "test")


def chronological_parts(features: DataFrame, targets: Sequence[str] = TARGETS, day: str = "day",
                        shares: tuple[float, float, float] = (0.60, 0.75, 0.85)) -> DataFrame:
    """Assign calendar days to parts by position and mark the days with complete features and targets as usable."""
    w = Window.orderBy(day)
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(w) - 1
    part = F.when(at < F.floor(n * shares[0]), PARTS[0]).when(at < F.floor(n * shares[1]), PARTS[1]).when(
        at < F.floor(n * shares[2]), PARTS[2]).otherwise(PARTS[3])
    complete = F.lit(True)
    for c in [*feature_names(targets), *targets]:
        complete = complete & F.col(c).isNotNull()
    return features.withColumn("part", part).withColumn("usable", complete)


def partition_audit(parts: DataFrame, day: str = "day") -> DataFrame:
    return parts.groupBy("part").agg(
        F.count("*").alias("calendar_days"), F.sum(F.col("usable").cast("long")).alias("usable_days"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def checked_parts(parts: DataFrame, minimum_days: int = 200, minimum_usable: int = 20) -> DataFrame:
    """Raise unless the panel is long enough for every part to be used."""
    audit = {r["part"]: r for r in partition_audit(parts).collect()}  # four lines
    if sum(r["calendar_days"] for r in audit.values()) < minimum_days:
        raise ValueError(f"at least {minimum_days} calendar days are needed")
    if any(p not in audit or audit[p]["usable_days"] < minimum_usable for p in PARTS):
        raise ValueError(f"every part needs {minimum_usable} usable days")
    return parts
