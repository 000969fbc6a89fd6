"""Versioned publication of daily facts and alerts.

A store is a folder: ``facts/run_id=…`` and ``alerts/run_id=…`` hold the data of a run, ``runs`` the ledger of complete
runs with their digest, ``publication`` the pointer history, ``removed`` the runs that retention took away. Data is written
first, the ledger line next and the pointer last. A run that died before its ledger line is written again, one that died
before its pointer only gets the pointer, and readers never see either. Retention notes a run as removed before it deletes
anything, so a run that is half deleted is never read or published again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.columns import is_finite, sums_of
from gaugeworks.operators.anomaly import ALERT_COLUMNS
from gaugeworks.operators.cleaning import digest_columns, digest_of
from gaugeworks.operators.facts import METRICS
from gaugeworks.operators.forecast import publication_rules
from gaugeworks.operators.quality import older_than_days
from gaugeworks.session import keep
from gaugeworks.sources.writers import delete_folders, read_or_empty

FACT_SCHEMA = "dataset string, metric string, day date, observations long, sensors long, mean double, minimum double, maximum double"
ALERT_SCHEMA = ", ".join(f"{c} string" for c in ALERT_COLUMNS)
RUN_SCHEMA = "run_id string, digest string, provenance string, created_at timestamp"
REMOVED_SCHEMA = "run_id string, removed_at timestamp"
POINTER_SCHEMA = "name string, run_id string, published_at timestamp"
FORECAST_SCHEMA = "kind string, target string, target_day date, origin_day date, actual double, prediction double, lower double, upper double"


def _partition(root: str, table: str, **keys) -> str:
    return "/".join([root.rstrip("/"), table, *[f"{k}={quote(str(v), safe='')}" for k, v in keys.items()]])


def fact_rules(metrics: Mapping[str, Sequence[str]] = METRICS) -> list[Column]:
    """Counts of broken rules over the facts: keys, numbers, bounds, counts and the exact metric set."""
    def count(c):
        return F.count(F.when(c, 1))
    known = F.array(*[F.lit(f"{d}|{m}") for d, ms in metrics.items() for m in ms])
    pair = F.concat_ws("|", "dataset", "metric")
    finite = is_finite("mean") & is_finite("minimum") & is_finite("maximum")
    size = sum(len(ms) for ms in metrics.values())
    return [
        (F.count("*") - F.count_distinct("dataset", "metric", "day")).alias("duplicate_keys"), count(F.col("day").isNull()).alias("missing_day"),
        count(~finite).alias("nonfinite"), count(finite & ~((F.col("minimum") <= F.col("mean")) & (F.col("mean") <= F.col("maximum")))).alias("bounds"),
        count(~F.coalesce((F.col("sensors") > 0) & (F.col("sensors") <= F.col("observations")), F.lit(False))).alias("counts"),
        count(~F.array_contains(known, pair)).alias("unknown_metric"),
        (F.lit(size) - F.count_distinct(F.when(F.array_contains(known, pair), pair))).alias("missing_metric")]


def fact_violations(facts: DataFrame, metrics: Mapping[str, Sequence[str]] = METRICS) -> DataFrame:
    return facts.agg(*fact_rules(metrics))


def alert_rules(datasets: Sequence[str] = tuple(METRICS)) -> list[Column]:
    blank = sums_of([F.when(F.coalesce(F.trim(F.col(c)) == "", F.lit(True)), 1).otherwise(0) for c in ("alert_id", "sensor_id", "model_id", "reasons", "observed_at")]) > 0
    bad_kind = ~F.coalesce(F.col("dataset").isin(*datasets) & (F.col("severity") == "review"), F.lit(False))
    bad_time = F.try_to_timestamp(F.col("observed_at")).isNull()
    return [(F.count("*") - F.count_distinct("alert_id")).alias("duplicate_alerts"), F.count(F.when(blank, 1)).alias("blank_fields"),
            F.count(F.when(bad_kind, 1)).alias("bad_dataset_or_severity"), F.count(F.when(bad_time, 1)).alias("bad_time")]


def checked_digest(df: DataFrame, rules: Sequence[Column], what: str) -> str:
    """Content digest of a table that breaks none of the rules; both come from one pass."""
    row = df.agg(*digest_columns(df.columns), *rules).first().asDict()
    digest = digest_of({k: row.pop(k) for k in ("rows", "xor_bits", "sum_bits")})
    found = {k: v for k, v in row.items() if v}
    if found:
        raise ValueError(f"{what} rejected: {found}")
    return digest


def removed_runs(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/removed", REMOVED_SCHEMA).select("run_id").distinct()


def ledger(spark: SparkSession, root: str, kind: str = "runs") -> DataFrame:
    """Complete runs that are still there."""
    lines = read_or_empty(spark, f"{root}/{kind}", RUN_SCHEMA)
    return lines.join(removed_runs(spark, root), "run_id", "left_anti") if kind == "runs" else lines


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """The latest pointer of each name."""
    history = read_or_empty(spark, f"{root}/publication", POINTER_SCHEMA)
    return history.groupBy("name").agg(F.max_by("run_id", "published_at").alias("run_id"), F.max("published_at").alias("published_at"))


def _known_digest(spark: SparkSession, root: str, run_id: str, kind: str = "runs") -> str | None:
    row = ledger(spark, root, kind).filter(F.col("run_id") == run_id).select("digest").first()
    return row["digest"] if row else None


def _append_line(spark: SparkSession, path: str, **values) -> None:
    spark.range(1).select(*[F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in values.items()]).coalesce(1).write.mode("append").parquet(path)


def _point(spark: SparkSession, root: str, name: str, run_id: str) -> None:
    _append_line(spark, f"{root}/publication", name=name, run_id=run_id, published_at=F.current_timestamp())


def _settled(spark: SparkSession, root: str, run_id: str, digest: str, name: str, kind: str = "runs") -> dict | None:
    """What to answer for a run id that the store knows; None if it has to be written."""
    if kind == "runs" and not removed_runs(spark, root).filter(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} was removed by retention; publish under a new id")
    known = _known_digest(spark, root, run_id, kind)
    if known is None:
        return None
    if known != digest:
        raise ValueError(f"run {run_id} is already stored with another digest; its content cannot be replaced")
    history = read_or_empty(spark, f"{root}/publication", POINTER_SCHEMA)
    if not history.filter((F.col("name") == name) & (F.col("run_id") == run_id)).isEmpty():
        return {"status": "unchanged", "run_id": run_id}
    _point(spark, root, name, run_id)  # stopped between ledger line and pointer
    return {"status": "completed", "run_id": run_id}


def _record(spark: SparkSession, root: str, run_id: str, digest: str, provenance: str, name: str, kind: str = "runs") -> None:
    _append_line(spark, f"{root}/{kind}", run_id=run_id, digest=digest, provenance=provenance, created_at=F.current_timestamp())
    _point(spark, root, name, run_id)


def publish(facts: DataFrame, alerts: DataFrame, root: str, run_id: str, provenance: str = "{}", name: str = "operations",
            metrics: Mapping[str, Sequence[str]] = METRICS) -> dict:
    """Publish a run once. The same content again is "unchanged", or "completed" if the first attempt had stopped before its
    pointer; other content under the same id is an error, and so is an id that retention has removed."""
    spark = facts.sparkSession
    # checked, digested and written more than once: worked out a single time
    facts = keep(facts.select(*[c.split()[0] for c in FACT_SCHEMA.split(", ")]))
    alerts = keep(alerts.select(*ALERT_COLUMNS))
    digest = f"{checked_digest(facts, fact_rules(metrics), 'facts')}/{checked_digest(alerts, alert_rules(tuple(metrics)), 'alerts')}"
    settled = _settled(spark, root, run_id, digest, name)
    if settled:
        return settled
    facts.write.mode("overwrite").parquet(_partition(root, "facts", run_id=run_id))
    alerts.write.mode("overwrite").parquet(_partition(root, "alerts", run_id=run_id))
    add_dimensions(facts, root)
    _record(spark, root, run_id, digest, provenance, name)
    return {"status": "published", "run_id": run_id}


def date_rows(facts: DataFrame) -> DataFrame:
    return facts.select("day").distinct().withColumns({"year": F.year("day"), "month": F.month("day"), "weekday": F.weekday("day")})


def add_dimensions(facts: DataFrame, root: str) -> None:
    """Append dates and metrics that the dimension tables do not hold yet."""
    spark = facts.sparkSession
    dates = read_or_empty(spark, f"{root}/dim_date", "day date, year int, month int, weekday int")
    date_rows(facts).join(dates.select("day"), "day", "left_anti").coalesce(1).write.mode("append").parquet(f"{root}/dim_date")
    note = "mean over the observations of the day, in the unit of the source"
    names = read_or_empty(spark, f"{root}/dim_metric", "dataset string, metric string, description string")
    new = facts.select("dataset", "metric").distinct().join(names.select("dataset", "metric"), ["dataset", "metric"], "left_anti")
    new.withColumn("description", F.lit(note)).coalesce(1).write.mode("append").parquet(f"{root}/dim_metric")


def published_run(spark: SparkSession, root: str, name: str = "operations", kind: str = "runs") -> str:
    row = pointers(spark, root).filter(F.col("name") == name).join(ledger(spark, root, kind).select("run_id"), "run_id").first()
    if row is None:
        raise ValueError("no published snapshot")
    return row["run_id"]


def read_published(spark: SparkSession, root: str, name: str = "operations") -> tuple[DataFrame, DataFrame]:
    """Facts and alerts of the published run; only that run's partition is read."""
    run = published_run(spark, root, name)
    facts = spark.read.schema(FACT_SCHEMA).parquet(_partition(root, "facts", run_id=run)).withColumn("run_id", F.lit(run))
    alerts = spark.read.schema(ALERT_SCHEMA).parquet(_partition(root, "alerts", run_id=run)).withColumn("run_id", F.lit(run))
    return facts, alerts


def retention_candidates(spark: SparkSession, root: str, keep_days: int = 90, now: str | None = None, apply: bool = False) -> DataFrame:
    """Runs older than the limit that are not published; with ``apply`` they are noted as removed and their data folders deleted."""
    if not isinstance(keep_days, int) or isinstance(keep_days, bool) or keep_days < 1:
        raise ValueError("keep_days must be a positive integer")
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    old = ledger(spark, root).filter(older_than_days(F.col("created_at"), at, keep_days)).select("run_id")
    out = old.join(pointers(spark, root).select("run_id"), "run_id", "left_anti")
    if apply:
        out = keep(out)
        runs = [r["run_id"] for r in out.collect()]  # one line per run
        if runs:
            out.withColumn("removed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/removed")
        delete_folders(spark, [_partition(root, t, run_id=r) for r in runs for t in ("facts", "alerts")])
    return out


def checked_alerts(alerts: DataFrame, expected_rows: int, lineage: str, source_run: str, sensor: str, dataset: str) -> DataFrame:
    """Saved alerts in the published shape, after checking their number, flags and source run."""
    row = alerts.agg(F.count("*").alias("n"), F.count(F.when(~F.coalesce("is_alert", F.lit(False)), 1)).alias("unflagged"),
                     F.count(F.when(F.coalesce(F.col(lineage) != source_run, F.lit(True)), 1)).alias("foreign")).first()
    if row["n"] != expected_rows or row["unflagged"]:
        raise ValueError(f"alert count or flag mismatch: {row['n']} rows, {row['unflagged']} unflagged")
    if row["foreign"]:
        raise ValueError("alert lineage mismatch")
    return alerts.select("alert_id", F.lit(dataset).alias("dataset"), F.col(sensor).cast("string").alias("sensor_id"),
                         F.col("timestamp").cast("string").alias("observed_at"), F.col("alert_reasons").alias("reasons"), "model_id", "severity")


def latest_complete_run(runs: DataFrame, parents: Sequence[str]) -> DataFrame:
    """The newest complete flag-only run whose recorded parent digests match the parents' own.

    ``runs`` has one line per run: run_id, stage, status, outlier_policy, digest and, per parent stage,
    ``<stage>_run`` and ``<stage>_digest``.
    """
    good = runs.filter((F.col("status") == "complete") & (F.col("outlier_policy") == "flag"))
    for p in parents:
        source = runs.filter((F.col("stage") == p) & (F.col("status") == "complete")).select(F.col("run_id").alias(f"{p}_run"), F.col("digest").alias("_d"))
        good = good.join(source, f"{p}_run").filter(F.col("_d") == F.col(f"{p}_digest")).drop("_d")
    newest = good.agg(F.max("run_id").alias("run_id"))
    return good.join(F.broadcast(newest), "run_id")  # one row


def publish_forecast(predictions: DataFrame, root: str, run_id: str, provenance: str = "{}") -> dict:
    """Forecast lines (held-out test and next day) under the same once-only protocol."""
    spark = predictions.sparkSession
    lines = predictions.select(*[c.split()[0] for c in FORECAST_SCHEMA.split(", ")])
    digest = checked_digest(lines, publication_rules(), "forecast")
    settled = _settled(spark, root, run_id, digest, "fiscal", "forecast_runs")
    if settled:
        return settled
    lines.write.mode("overwrite").parquet(_partition(root, "predictions", run_id=run_id))
    _record(spark, root, run_id, digest, provenance, "fiscal", "forecast_runs")
    return {"status": "published", "run_id": run_id}
