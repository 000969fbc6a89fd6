"""Replay of stored alerts as a stream of small JSON files into an idempotent sink."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import epoch_micros
from gaugeworks.functions.columns import row_fingerprint
from gaugeworks.operators.anomaly import ALERT_COLUMNS
from gaugeworks.operators.cleaning import digest_columns, digest_of
from gaugeworks.operators.quantiles import numbered
from gaugeworks.sources.writers import delete_folders, read_or_empty
from gaugeworks.streaming.publish import ALERT_SCHEMA, alert_rules

BATCH_ROWS = 100
#: Replay files that one trigger takes.
FILES_PER_TRIGGER = 1000
STORED_SCHEMA = f"{ALERT_SCHEMA}, content_sha256 string, stream_id string, batch_id long"
OUTBOX_SCHEMA = "event_id string, payload string, delivery_status string, stream_id string, batch_id long"
BATCH_SCHEMA = "content_digest string, rows_seen long, stream_id string, batch_id long"


def write_replay_files(alerts: DataFrame, folder: str, rows: int = BATCH_ROWS) -> None:
    """Alerts in time order, ``rows`` to a JSON-lines file; a file's number is that of its batch."""
    ordered = numbered(alerts.select(*ALERT_COLUMNS, epoch_micros(F.col("observed_at")).alias("_at")), ["_at", "alert_id"], "_n")
    cut = ordered.withColumn("batch", F.floor((F.col("_n") - 1) / rows)).drop("_n", "_at")
    dealt = cut.repartition(_writers(alerts.sparkSession), "batch").sortWithinPartitions("batch", "observed_at", "alert_id")
    dealt.write.mode("errorifexists").partitionBy("batch").json(folder)


def _writers(spark: SparkSession) -> int:
    """Tasks that write many small files; a fixed number, as few bytes would be merged into one task."""
    return spark.sparkContext.defaultParallelism


def _stream_folder(root: str, table: str, stream_id: str) -> str:
    return f"{root.rstrip('/')}/{table}/stream_id={quote(stream_id, safe='')}"


def write_batch(frame: DataFrame, root: str, stream_id: str, batch_id: int) -> str:
    """Store one batch as ``write_batches`` does."""
    return write_batches(frame.select(*ALERT_COLUMNS, F.lit(batch_id).cast("long").alias("batch")), root, stream_id, [batch_id])[batch_id]


def write_batches(frame: DataFrame, root: str, stream_id: str, expected: Sequence[int] = ()) -> dict[int, str]:
    """Store numbered batches (``batch``; ``expected`` ones may have no rows): new alerts, an outbox line for each, and last a ledger line per batch.

    A batch that was stored before is left alone if its content is the same and refused if it is not. A batch that
    died before its ledger line is written again in place of what it left. Alerts known from other batches are not stored
    twice, and the same id with other content is refused. All batches take a fixed number of jobs together.
    """
    spark = frame.sparkSession
    rows = frame.select(*ALERT_COLUMNS, "batch").persist()
    fresh = None
    try:
        digests = {int(b): "0:0:0" for b in expected}
        for line in rows.groupBy("batch").agg(*digest_columns(ALERT_COLUMNS), *alert_rules()).collect():  # a line per batch
            told = line.asDict()
            batch, digest = told.pop("batch"), digest_of({k: told.pop(k) for k in ("rows", "xor_bits", "sum_bits")})
            if found := {k: v for k, v in told.items() if v}:
                raise ValueError(f"stream batch rejected: {found}")
            digests[batch] = digest
        if not digests:
            return {}
        mine = (F.col("stream_id") == stream_id) & F.col("batch_id").isin(list(digests))
        lines = read_or_empty(spark, f"{root}/stream_batch", BATCH_SCHEMA).filter(mine).collect()
        seen = {r["batch_id"]: r["content_digest"] for r in lines}
        if any(digests[b] != d for b, d in seen.items()):
            raise ValueError("the stream batch was replayed with changed content")
        new = [b for b in digests if b not in seen]
        if not new:
            return dict.fromkeys(digests, "unchanged")
        marked = rows.filter(F.col("batch").isin(new)).withColumn("content_sha256", row_fingerprint(ALERT_COLUMNS))
        store = read_or_empty(spark, f"{root}/stream_alert", STORED_SCHEMA)
        own = (F.col("stream_id") == stream_id) & F.col("batch_id").isin(new)
        stored = store.filter(~own).select("alert_id", F.col("content_sha256").alias("_stored"))
        known = marked.select("alert_id", F.col("content_sha256").alias("_stored")).unionByName(stored.join(marked, "alert_id", "left_semi"))
        if not known.groupBy("alert_id").agg(F.count_distinct("_stored").alias("n")).filter("n > 1").limit(1).isEmpty():
            raise ValueError("an alert id exists with changed content")
        first = marked.groupBy(*ALERT_COLUMNS, "content_sha256").agg(F.min("batch").alias("batch_id"))
        fresh = first.join(stored, "alert_id", "left_anti").repartition(min(len(new), _writers(spark)), "batch_id").persist()
        left = [store, read_or_empty(spark, f"{root}/outbox", OUTBOX_SCHEMA)]
        dead = {r["batch_id"] for t in left for r in t.filter(own).select("batch_id").distinct().collect()}
        delete_folders(spark, [f"{_stream_folder(root, t, stream_id)}/batch_id={b}" for b in dead for t in ("stream_alert", "outbox")])
        payload = F.to_json(F.struct(*[F.col(c) for c in ALERT_COLUMNS], F.lit(True).alias("replay")))
        outbox = fresh.select("batch_id", F.col("alert_id").alias("event_id"), payload.alias("payload"), F.lit("pending").alias("delivery_status"))
        ledger = spark.createDataFrame([(digests[b], int(digests[b].split(":")[0]), b) for b in new], "content_digest string, rows_seen long, batch_id long")
        ledger = ledger.repartition(min(len(new), _writers(spark)), "batch_id")
        for table, part in (("stream_alert", fresh.select(*ALERT_COLUMNS, "content_sha256", "batch_id")), ("outbox", outbox), ("stream_batch", ledger)):
            part.write.mode("append").partitionBy("batch_id").parquet(_stream_folder(root, table, stream_id))
        return {b: "unchanged" if b in seen else "committed" for b in digests}
    finally:
        rows.unpersist()
        if fresh is not None:
            fresh.unpersist()


def replay(spark: SparkSession, folder: str, root: str, stream_id: str, checkpoint: str, files: int = FILES_PER_TRIGGER) -> list[int]:
    """Stream the replay files into the store, each a batch of its own; returns the rows of each processed batch, by the batch ledger.

    A trigger takes up to ``files`` of them, so that jobs and readings of the store do not grow with the number of files. A file is known
    by its number, or by its name where it has none, whatever trigger it comes in.
    """
    done: list[int] = []

    def store(frame: DataFrame, trigger: int) -> None:
        done.extend(write_batches(frame, root, stream_id))

    source = spark.readStream.schema(f"{ALERT_SCHEMA}, batch long").option("maxFilesPerTrigger", files).json(folder)
    numbered_files = source.select(*ALERT_COLUMNS, F.coalesce("batch", F.xxhash64("_metadata.file_name")).alias("batch"))
    run = numbered_files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    lines = read_or_empty(spark, f"{root}/stream_batch", BATCH_SCHEMA).filter(F.col("stream_id") == stream_id).select("batch_id", "rows_seen").collect()
    seen = {r["batch_id"]: r["rows_seen"] for r in lines}  # one line per batch
    return [seen[b] for b in done]


def stored_alerts(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/stream_alert", STORED_SCHEMA)


def outbox(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/outbox", OUTBOX_SCHEMA)
