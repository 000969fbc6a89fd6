"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def open_session(app: str = "gaugeworks", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; parallelism is left to the cluster unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Wall-clock readings are interpreted in UTC whatever the host is set to."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_OWN: dict[str, str] = {}
_KEPT: dict[str, list[str]] = {}


def is_single_process(master: str) -> bool:
    """Whether driver and executors share one machine's disk: ``local`` and ``local[...]``, not ``local-cluster[...]``."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only on a local master, where driver and executors are one process, is a temporary folder made if it is unset, one per
    application. Elsewhere that is an error, since executors would write to disks that nobody else sees.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not is_single_process(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-gw-", dir="/tmp")
    return _OWN[app]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the shared folder; nothing is created or deleted here."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from the written table.

    Later branches then read one fixed copy instead of repeating the work, the lineage ends here, and lost executors
    do not matter.
    """
    path = new_folder(df.sparkSession, "kept")
    df.write.mode("errorifexists").parquet(path)
    _KEPT.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_in = path
    return kept


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``keep`` returned, once nothing will read them any more."""
    for df in frames:
        path = getattr(df, "kept_in", None)
        known = _KEPT.get(df.sparkSession.sparkContext.applicationId, [])
        if path in known:
            known.remove(path)
            _delete(df.sparkSession, [path])


def drop_kept(spark: SparkSession) -> int:
    """Delete the tables that ``keep`` has written in this application so far; returns how many there were.

    To be called when results have been written: DataFrames that still read a kept table fail afterwards.
    """
    paths = _KEPT.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)
