"""Alerts on readings that lie far from the clusters, or from the mean, of earlier readings.

A detector is fitted once and then is nothing but numbers: readings are scored by a plain column expression over their raw
columns, so scoring needs no model object, stays in generated code and gives the same result after the detector was stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.columns import count_true, flag, is_finite, ratio
from gaugeworks.operators.quantiles import quantile_values

# The published shape of an alert.
ALERT_COLUMNS = ("alert_id", "dataset", "sensor_id", "observed_at", "reasons", "model_id", "severity")


@dataclass(frozen=True)
class Detector:
    """Measurements with mean, sample and population deviation, cluster centres in units of the sample deviation, and the
    distance from which on a reading is reported (0: distances are not judged)."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    deviations: tuple[float, ...]
    centres: tuple[tuple[float, ...], ...] = ()
    threshold: float = 0.0

    def standardised(self) -> list[Column]:
        """A measurement that never varied counts as its mean."""
        return [(F.col(c) - m) / s if s else F.lit(0.0) for c, m, s in zip(self.columns, self.means, self.scales, strict=True)]

    def distances(self) -> Column:
        """Squared distance to every centre."""
        at = self.standardised()
        return F.array(*[sum(((x - c) * (x - c) for x, c in zip(at, centre, strict=True)), F.lit(0.0)) for centre in self.centres])

    def deviating(self, limit: float) -> list[Column]:
        """For each measurement that varied, its note if the reading is more than ``limit`` deviations off."""
        return [F.when(F.abs((F.col(c) - m) / d) > limit, F.lit(f"zscore:{c}")) for c, m, d in zip(self.columns, self.means, self.deviations, strict=True) if d]


def measure(train: DataFrame, columns: Sequence[str]) -> Detector:
    """A detector that knows the measurements' spread only; one pass over the training readings."""
    row = train.agg(*[e for c in columns for e in (F.avg(c), F.stddev_samp(c), F.stddev_pop(c), count_true(~is_finite(c)))]).first()
    found = [tuple(row[4 * i:4 * i + 4]) for i in range(len(columns))]
    unusable = [c for c, f in zip(columns, found, strict=True) if f[0] is None or f[3]]
    if unusable:
        raise ValueError(f"training readings are missing or not finite: {unusable}")
    means, scales, deviations = (tuple(float(f[i] or 0.0) for f in found) for i in range(3))
    return Detector(tuple(columns), means, scales, deviations)


def fit_detector(train: DataFrame, validation: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 42, rounds: int = 15, level: float = 0.99) -> Detector:
    """Clusters from the training readings and, as threshold, the exact ``level`` quantile of the validation distances.

    Starting centres are sampled, so equal results need the same seed and the same partitioning of ``train``.
    """
    spread = measure(train, columns)
    points = train.select(array_to_vector(F.array(*spread.standardised())).alias("features"))
    fitted = KMeans(k=k, seed=seed, maxIter=rounds).fit(points)
    clustered = Detector(**(asdict(spread) | {"centres": tuple(tuple(map(float, c)) for c in fitted.clusterCenters())}))
    top = quantile_values(score(clustered, validation), {"top": ("distance_squared", level)})["top"]
    return Detector(**(asdict(clustered) | {"threshold": float(top or 0.0)}))


def score(detector: Detector, df: DataFrame) -> DataFrame:
    """``cluster`` (number of the nearest centre) and ``distance_squared`` of every reading."""
    nearest = F.array_min("_all")
    return df.withColumn("_all", detector.distances()).withColumns({
        "cluster": (F.array_position("_all", nearest) - 1).cast("int"), "distance_squared": nearest}).drop("_all")


def alert_id(model_id: str, dataset: str, sensor: str, time: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model_id), F.lit(dataset), F.col(sensor).cast("string"), F.col(time).cast("string")), 256)


def judge(detector: Detector, df: DataFrame, dataset: str, sensor: str, model_id: str, time: str = "timestamp", limit: float = 3.0) -> DataFrame:
    """Reasons, flag, severity and stable id of every reading; distances are judged where the detector has a threshold."""
    notes = detector.deviating(limit)
    if detector.threshold > 0:
        notes = [F.when(F.col("distance_squared") > detector.threshold, F.lit("cluster_distance")), *notes]
    listed = F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")
    return df.withColumn("_notes", listed).withColumns({
        "alert_reasons": F.array_join("_notes", ";"), "is_alert": F.size("_notes") > 0,
        "severity": F.when(F.size("_notes") > 0, F.lit("review")).otherwise(F.lit("none")),
        "model_id": F.lit(model_id), "alert_id": alert_id(model_id, dataset, sensor, time)}).drop("_notes")


def alert_records(alerts: DataFrame, dataset: str, sensor: str, time: str = "timestamp") -> DataFrame:
    """Flagged readings in the published alert shape."""
    shape = {"alert_id": "alert_id", "dataset": F.lit(dataset), "sensor_id": F.col(sensor).cast("string"), "observed_at": F.col(time).cast("string"),
             "reasons": "alert_reasons", "model_id": "model_id", "severity": "severity"}
    return alerts.filter(flag(F.col("is_alert"))).select(*[(F.col(e) if isinstance(e, str) else e).alias(shape_name) for shape_name, e in shape.items()])


def alert_daily(alerts: DataFrame, time: str = "timestamp") -> DataFrame:
    hits = count_true(F.col("is_alert"))
    return alerts.groupBy(F.to_date(time).alias("day")).agg(hits.alias("alerts"), F.count("*").alias("observations"), ratio(hits, F.count("*")).alias("alert_rate"))


def save_detector(detector: Detector, spark: SparkSession, path: str) -> None:
    """One JSON line; the folder must not exist."""
    fields = asdict(detector)
    schema = "columns array<string>, means array<double>, scales array<double>, deviations array<double>, centres array<array<double>>, threshold double"
    spark.createDataFrame([tuple(fields.values())], schema).coalesce(1).write.mode("errorifexists").json(path)


def load_detector(spark: SparkSession, path: str) -> Detector:
    row = spark.read.json(path).first().asDict()
    plain = {k: tuple(row.get(k) or ()) for k in ("columns", "means", "scales", "deviations")}
    return Detector(**plain, centres=tuple(map(tuple, row.get("centres") or ())), threshold=float(row["threshold"]))


def largest_difference(a: Detector, b: Detector, df: DataFrame) -> float | None:
    """How far two detectors are apart on the same readings; both score each row in one pass."""
    return df.agg(F.max(F.abs(F.array_min(a.distances()) - F.array_min(b.distances())))).first()[0]
