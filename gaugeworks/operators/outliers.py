"""Outlier bounds, flags and treatments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import any_of, flag, is_finite, ratio
from gaugeworks.operators.quantiles import exact_quantiles, quantile_values
from gaugeworks.operators.slices import BROADCAST_KEYS, checked_join
from gaugeworks.session import keep

# Physical limits per dataset; a flag column maps to (column, low, high).
DOMAIN_LIMITS = {
    "traffic": {"speed": ("avg_speed", 0, 120), "vehicle_count": ("vehicle_count", 0, None)},
    "air_quality": {"pm25": ("pm25", 0, 500), "pm10": ("pm10", 0, None), "no2": ("no2", 0, None), "co": ("co", 0, None),
                    "humidity": ("humidity", 0, 100)},
    "weather": {"humidity": ("humidity", 0, 100), "wind_speed": ("wind_speed", 0, None), "precipitation": ("precipitation", 0, None)},
    "energy": {"power": ("power_consumption", 0, None)},
    "occupancy": {"available_rooms": ("available_rooms", 0, None), "occupied_rooms": ("occupied_rooms", 0, None), "guests": ("guests", 0, None)},
    "fiscal": {"revenue": ("revenue", 0, None), "expense": ("expense", 0, None)},
}


def fit_bounds(df: DataFrame, columns: Sequence[str], exact: bool = True, budget: int | None = None) -> dict[str, dict[str, float]]:
    """Global quartile fences, mean and population std per column; a handful of numbers.

    ``exact=False`` takes the quartiles from a mergeable sketch in the same single scan as the moments.
    """
    moments = [e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    if exact:
        q = quantile_values(df, {f"{side}_{c}": (c, p) for c in columns for side, p in (("lo", .25), ("hi", .75))}, budget=budget)
    else:
        moments += [F.percentile_approx(c, [.25, .75], 1000).alias(f"q_{c}") for c in columns]
    row = df.agg(*moments).first()
    bounds = {}
    for c in columns:
        q1, q3 = (q[f"lo_{c}"], q[f"hi_{c}"]) if exact else (row[f"q_{c}"] or (None, None))
        if q1 is not None:
            bounds[c] = {"low": q1 - 1.5 * (q3 - q1), "high": q3 + 1.5 * (q3 - q1), "iqr": q3 - q1, "mean": row[f"m_{c}"], "std": row[f"s_{c}"]}
    return bounds


def flag_outliers(df: DataFrame, bounds: Mapping[str, Mapping[str, float]], mode: str = "flag", clip: Sequence[str] = ()) -> DataFrame:
    """Fence and z-score flags; ``clip`` pulls approved columns to the fences and keeps the original."""
    if mode not in ("flag", "clip"):
        raise ValueError("mode must be flag or clip")
    out = df
    for c, b in bounds.items():
        x = F.col(c)
        beyond = flag((x < b["low"]) | (x > b["high"])) if b["iqr"] > 0 else F.lit(False)
        far = flag(F.abs((x - b["mean"]) / b["std"]) > 3) if b["std"] else F.lit(False)
        out = out.withColumns({f"{c}_iqr_outlier": beyond, f"{c}_zscore_outlier": far})
        if mode == "clip" and c in clip:
            held = F.greatest(F.lit(b["low"]), F.least(x, F.lit(b["high"])))
            out = out.withColumns({f"{c}_original": x, f"{c}_treated": F.col(f"{c}_iqr_outlier")})
            out = out.withColumn(c, F.when(F.col(f"{c}_treated"), held).otherwise(x))
    return out


def drop_or_impute(df: DataFrame, column: str, flag_column: str, strategy: str, budget: int | None = None) -> DataFrame:
    """Remove flagged rows, or put the median of the unflagged finite values in their place."""
    hit = flag(F.col(flag_column))
    if strategy == "remove":
        return df.filter(~hit)
    if strategy != "impute":
        raise ValueError("use remove or impute")
    middle = quantile_values(df.filter(~hit & is_finite(column)), {"m": (column, .5)}, budget=budget)["m"]
    if middle is None:
        raise ValueError("no unflagged finite values for median replacement")
    return df.withColumns({f"{column}_original": F.col(column), f"{column}_imputed": hit,
                           column: F.when(hit, F.lit(middle)).otherwise(F.col(column))})


def flag_by_group(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), methods: Sequence[str] = ("iqr", "zscore"),
                  guard_flat: bool = True, budget: int | None = None) -> DataFrame:
    """Fences and z-scores fitted per group (or over all rows) with the sample std; adds ``<c>_zscore``.

    Group statistics come from one aggregate and are joined back: replicated while they are few, shuffled otherwise.
    ``guard_flat`` raises no fence flag where the quartiles coincide.
    """
    by = list(by) or ["_all"]
    rows = df.withColumn("_all", F.lit(1)) if by == ["_all"] else df
    parts = []
    if "iqr" in methods:
        parts.append(exact_quantiles(rows, by, {f"_q{i}_{c}": (c, p) for c in columns for i, p in ((1, .25), (3, .75))}, budget=budget))
    if "zscore" in methods:
        parts.append(rows.groupBy(*by).agg(*[e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]))
    groups = rows.select(*by).distinct().limit(BROADCAST_KEYS + 1).count()
    out = rows
    for stats in parts:
        out = checked_join(out, stats, by, "left", groups)
    for c in columns:
        x = F.col(c)
        if "iqr" in methods:
            reach = 1.5 * (F.col(f"_q3_{c}") - F.col(f"_q1_{c}"))
            hit = (x < F.col(f"_q1_{c}") - reach) | (x > F.col(f"_q3_{c}") + reach)
            out = out.withColumn(f"{c}_outlier_iqr", flag(hit & (reach > 0)) if guard_flat else flag(hit))
        if "zscore" in methods:
            z = F.when(F.col(f"_s_{c}") > 0, F.abs(ratio(x - F.col(f"_m_{c}"), f"_s_{c}")))
            out = out.withColumn(f"{c}_zscore", z).withColumn(f"{c}_outlier_zscore", flag(F.col(f"{c}_zscore") > 3))
    return out.drop("_all", *[f"{p}_{c}" for c in columns for p in ("_q1", "_q3", "_m", "_s")])


def domain_flags(df: DataFrame, dataset: str, limits: Mapping[str, tuple] | None = None) -> DataFrame:
    """Flags for physically impossible values."""
    out: dict[str, Column] = {}
    rules = dict(limits if limits is not None else DOMAIN_LIMITS[dataset])
    if dataset == "occupancy" and limits is None:
        rooms = [rules.pop("available_rooms"), rules.pop("occupied_rooms")]
        out["occupancy_outlier_domain"] = flag(any_of([F.col(c) < low for c, low, _ in rooms]))
    for name, (c, low, high) in rules.items():
        if c in df.columns:
            hit = F.lit(False)
            hit = hit | (F.col(c) < low) if low is not None else hit
            hit = hit | (F.col(c) > high) if high is not None else hit
            out[f"{name}_outlier_domain"] = flag(hit)
    return df.withColumns(out)


def measured_column(flag_column: str, columns: Sequence[str]) -> str | None:
    """The measurement a flag column belongs to."""
    name = flag_column.split("_outlier_")[0]
    known = {f"{k}_outlier_domain": c for rules in DOMAIN_LIMITS.values() for k, (c, _, _) in rules.items()}
    name = known.get(flag_column, name)
    return name if name in columns else None


def treat(df: DataFrame, strategy: str = "cap", flags: Sequence[str] | None = None, budget: int | None = None) -> DataFrame:
    """cap to the 5th/95th percentile, remove, impute the unflagged median, or leave flagged; rules chain per column."""
    if strategy not in ("cap", "remove", "impute", "flag_only"):
        raise ValueError(f"invalid treatment strategy: {strategy}")
    flags = list(flags) if flags is not None else [c for c in df.columns if "_outlier_" in c]
    pairs = [(f, c) for f in flags if (c := measured_column(f, df.columns))]
    if strategy == "flag_only" or not pairs:
        return df
    if strategy == "remove":
        return df.filter(~any_of([flag(F.col(f)) for f, _ in pairs]))
    if strategy == "cap":
        hit = df.agg(*[F.max(F.col(f).cast("int")).alias(f) for f, _ in pairs]).first()
        pairs = [(f, c) for f, c in pairs if hit[f]]
        limits = quantile_values(df, {f"{s}_{c}": (c, p) for c in {c for _, c in pairs} for s, p in (("a", .05), ("z", .95))}, budget=budget) if pairs else {}
        out = df
        for f, c in pairs:
            source = f"{c}_capped" if f"{c}_capped" in out.columns else c
            a, z = limits[f"a_{c}"], limits[f"z_{c}"]
            if a is not None:
                held = F.greatest(F.lit(a), F.least(F.lit(z), F.col(source)))
                out = out.withColumn(f"{c}_capped", F.when(flag(F.col(f)) & F.col(source).isNotNull(), held).otherwise(F.col(source)))
        return out
    # stored: medians go through these several times, and flags come from statistics of whole groups
    kept = keep(df.select(*[F.when(F.col(f) == F.lit(False), F.col(c)).alias(f"_k{i}") for i, (f, c) in enumerate(pairs)],
                     *[F.col(f).cast("int").alias(f"_f{i}") for i, (f, _) in enumerate(pairs)]))
    hit = kept.agg(*[F.max(f"_f{i}").alias(f"_f{i}") for i in range(len(pairs))]).first()
    middles = quantile_values(kept, {f"m{i}": (f"_k{i}", .5) for i in range(len(pairs))}, budget=budget)
    out = df
    for i, (f, c) in enumerate(pairs):
        if hit[f"_f{i}"] and middles[f"m{i}"] is not None:
            source = f"{c}_imputed" if f"{c}_imputed" in out.columns else c
            out = out.withColumn(f"{c}_imputed", F.when(flag(F.col(f)), F.lit(middles[f"m{i}"])).otherwise(F.col(source)))
    return out


# Source unit to (analysis column, unit label, conversion).
UNITS = {
    ("temperature", "F"): ("temperature_celsius", "C", lambda x: (x - 32) * 5 / 9),
    ("temperature", "C"): ("temperature_celsius", "C", lambda x: x),
    ("avg_speed", "mph"): ("speed_kmh", "km/h", lambda x: x * 1.609344),
    ("avg_speed", "km/h"): ("speed_kmh", "km/h", lambda x: x),
    ("power_consumption", "W"): ("power_kw", "kW", lambda x: x / 1000),
    ("power_consumption", "kW"): ("power_kw", "kW", lambda x: x),
}


def convert_units(df: DataFrame, units: Mapping[str, str | None], labels: bool = False) -> DataFrame:
    """Add converted columns next to the source ones; an unknown (None) unit is skipped, an unsupported one raises."""
    out: dict[str, Column] = {}
    for c, unit in units.items():
        if unit is None or c not in df.columns:
            continue
        if (c, unit) not in UNITS:
            raise ValueError(f"unsupported unit for {c}: {unit}")
        name, label, convert = UNITS[(c, unit)]
        out[name] = convert(F.col(c))
        if labels:
            out[f"{name}_unit"] = F.lit(label)
    return df.withColumns(out)
