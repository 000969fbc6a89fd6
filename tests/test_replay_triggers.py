"""Many replay files to a trigger: jobs that do not grow with the files, and batches that stay one by one."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gaugeworks.session import new_folder
from gaugeworks.streaming import publish as PB
from gaugeworks.streaming import replay as RP


def alerts_of(spark, n):
    i = F.col("id").cast("string")
    return spark.range(n).select(F.concat(F.lit("a"), i).alias("alert_id"), F.lit("traffic").alias("dataset"), i.alias("sensor_id"),
                                 F.timestamp_seconds(F.col("id") * 60).cast("string").alias("observed_at"), F.lit("z").alias("reasons"), F.lit("m").alias("model_id"), F.lit("review").alias("severity"))


def test_triggers_do_not_grow_with_files(spark):
    alerts, files, root = alerts_of(spark, 240), new_folder(spark, "files"), new_folder(spark, "stream")
    RP.write_replay_files(alerts, files, 4)
    triggers = []
    real = RP.write_batches
    RP.write_batches = lambda *a: triggers.append(1) or real(*a)
    try:
        assert RP.replay(spark, files, root, "s", new_folder(spark, "checkpoint")) == [4] * 60
    finally:
        RP.write_batches = real
    assert len(triggers) == 1
    assert rows(RP.stored_alerts(spark, root), *PB.ALERT_COLUMNS) == rows(alerts) and RP.outbox(spark, root).count() == 240
    assert RP.stored_alerts(spark, root).select("batch_id").distinct().count() == 60
    # other triggers, same batches: nothing more is stored
    assert RP.replay(spark, files, root, "s", new_folder(spark, "checkpoint"), 7) == [4] * 60
    assert RP.stored_alerts(spark, root).count() == 240


def test_batches_of_one_trigger(spark):
    alerts, root = alerts_of(spark, 20), new_folder(spark, "stream")
    both = alerts.withColumn("batch", F.lit(1).cast("long")).unionByName(alerts.limit(5).withColumn("batch", F.lit(2).cast("long")))
    # left by a batch that died: replaced, also where nothing new comes in its place
    alerts.limit(2).withColumn("content_sha256", F.lit("x")).write.parquet(f"{root}/stream_alert/stream_id=s/batch_id=2")
    assert RP.write_batches(both, root, "s") == {1: "committed", 2: "committed"}
    assert RP.stored_alerts(spark, root).count() == 20 == RP.outbox(spark, root).count()
    assert RP.write_batches(both.unionByName(alerts.limit(1).withColumn("batch", F.lit(3).cast("long"))), root, "s") == {1: "unchanged", 2: "unchanged", 3: "committed"}
    changed = alerts.limit(1).withColumns({"reasons": F.lit("other"), "batch": F.lit(5).cast("long")})
    with pytest.raises(ValueError, match="alert id exists"):
        RP.write_batches(changed, root, "s")
    with pytest.raises(ValueError, match="alert id exists"):
        RP.write_batches(changed.unionByName(alerts.limit(1).withColumn("batch", F.lit(6).cast("long"))), new_folder(spark, "t"), "s")
    assert RP.write_batch(alerts.limit(0), root, "s", 9) == "committed"
