"""Column-level building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Quotient, NULL where the denominator is zero (ANSI mode would raise)."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def is_finite(c: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    x = col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def finite(c: Column | str) -> Column:
    """The number itself, or NULL where it is not finite."""
    return F.when(is_finite(c), col(c))


def flag(condition: Column) -> Column:
    """A flag that is never NULL."""
    return F.coalesce(condition, F.lit(False))


def count_true(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def share_true(condition: Column, scale: float = 100.0) -> Column:
    """Share of rows meeting the condition (a NULL condition counts as not met)."""
    return F.avg(F.when(condition, F.lit(scale)).otherwise(F.lit(0.0)))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Sum of value*weight over the weight of the rows that have a value."""
    v, w = col(value), col(weight)
    return ratio(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def band(c: Column | str, upper_bounds: Sequence[float], labels: Sequence[str], inclusive: bool = True) -> Column:
    """Label by the first upper bound that holds the value; the last label is open-ended; NULL stays NULL."""
    if len(labels) != len(upper_bounds) + 1:
        raise ValueError("one more label than bounds is needed")
    x = col(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(upper_bounds, labels):
        out = out.when((x <= bound) if inclusive else (x < bound), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


# Public air-quality index categories and their upper bounds.
AQI_BOUNDS = (50, 100, 150, 200, 300)
AQI_LABELS = ("Good", "Moderate", "Unhealthy for sensitive groups", "Unhealthy", "Very unhealthy", "Hazardous")


def aqi_category(c: Column | str) -> Column:
    return band(c, AQI_BOUNDS, AQI_LABELS)


# Groups of the public weather codes; 51 to 82 are rain or showers and 95 upwards thunderstorms.
SNOW_CODES = (71, 73, 75, 77, 85, 86)
CLOUD_CODES = (1, 2, 3, 45, 48)


def weather_condition(c: Column | str) -> Column:
    """Readable condition of a weather code."""
    code = col(c)
    return (F.when(code >= 95, "Thunderstorm").when(code.isin(*SNOW_CODES), "Snow").when(code.between(51, 82), "Rain or showers")
            .when(code.isin(*CLOUD_CODES), "Cloudy or partly cloudy").when(code == 0, "Clear").otherwise("Conditions unavailable"))


# Map scales in degrees Fahrenheit and millimetres.
TEMPERATURE_BOUNDS = (50, 60, 70, 80)
TEMPERATURE_LABELS = ("below 50", "50 to 60", "60 to 70", "70 to 80", "80 and above")
PRECIPITATION_BOUNDS = (0.1, 1, 5, 10)
PRECIPITATION_LABELS = ("below 0.1", "0.1 to 1", "1 to 5", "5 to 10", "10 and above")


def temperature_band(c: Column | str) -> Column:
    return band(c, TEMPERATURE_BOUNDS, TEMPERATURE_LABELS, inclusive=False)


def precipitation_band(c: Column | str) -> Column:
    return band(c, PRECIPITATION_BOUNDS, PRECIPITATION_LABELS, inclusive=False)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def occupancy_rate(available: Column | str = "available_rooms", occupied: Column | str = "occupied_rooms") -> Column:
    return ratio(occupied, available)


def add_occupancy_rate(df: DataFrame, available: str = "available_rooms", occupied: str = "occupied_rooms") -> DataFrame:
    return df.withColumn("occupancy_rate", occupancy_rate(available, occupied))


def add_traffic_flags(df: DataFrame, speed: str = "avg_speed", count: str = "vehicle_count") -> DataFrame:
    """Impossible speeds and counts."""
    return df.withColumns({
        "speed_anomaly": flag((F.col(speed) < 0) | (F.col(speed) > 120)),
        "count_anomaly": flag(F.col(count) < 0),
    })


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def sums_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def row_fingerprint(columns: Sequence[str]) -> Column:
    """sha-256 over the JSON of the row with its columns in name order; NULL fields are kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson r over rows where both are present; NULL when either side is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
