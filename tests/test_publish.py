import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gaugeworks.operators import anomaly as A
from gaugeworks.operators.facts import METRICS, daily_facts
from gaugeworks.session import new_folder
from gaugeworks.sources import readers as R
from gaugeworks.sources import writers as W
from gaugeworks.streaming import publish as PB
from gaugeworks.streaming import replay as RP


@pytest.fixture(scope="module")
def bundle(spark):
    facts = spark.createDataFrame([(d, m, dt.date(2025, 1, 1), 10, 2, 5.0, 1.0, 9.0) for d, ms in METRICS.items() for m in ms], PB.FACT_SCHEMA)
    alerts = spark.createDataFrame([(f"id{i:03d}", "traffic", f"s{i}", f"2025-01-01 00:{i % 60:02d}:00", "zscore:x", "m", "review") for i in range(25)], PB.ALERT_SCHEMA)
    return facts.cache(), alerts.cache()


@pytest.mark.parametrize("column, value", [("mean", "double('nan')"), ("maximum", "double('inf')"), ("sensors", "11L"), ("sensors", "0L"), ("minimum", "6d"), ("metric", "'speed'"), ("day", "cast(null as date)")])
def test_damaged_facts_are_refused(spark, bundle, column, value):
    facts, alerts = bundle
    hit = facts.withColumn(column, F.when((F.col("dataset") == "traffic") & (F.col("metric") == "avg_speed"), F.expr(value)).otherwise(F.col(column)))
    with pytest.raises(ValueError, match="facts rejected"):
        PB.publish(hit, alerts, new_folder(spark, "s"), "r")


def test_incomplete_duplicate_and_bad_alerts_are_refused(spark, bundle):
    facts, alerts = bundle
    for f, a in ((facts.filter("dataset <> 'fiscal'"), alerts), (facts.unionByName(facts.limit(1)), alerts), (facts, alerts.unionByName(alerts.limit(1))),
                 (facts, alerts.withColumn("severity", F.lit("none"))), (facts, alerts.withColumn("reasons", F.lit(" "))), (facts, alerts.withColumn("observed_at", F.lit("soon")))):
        with pytest.raises(ValueError, match="rejected"):
            PB.publish(f, a, new_folder(spark, "s"), "r")


def test_publication_protocol(spark, bundle):
    facts, alerts = bundle
    root = new_folder(spark, "store")
    assert PB.publish(facts, alerts, root, "r1")["status"] == "published"
    assert PB.publish(facts, alerts, root, "r1")["status"] == "unchanged"
    with pytest.raises(ValueError, match="another digest"):
        PB.publish(facts.withColumn("maximum", F.col("maximum") + 1), alerts, root, "r1")
    f, a = PB.read_published(spark, root)
    assert f.count() == 20 and a.count() == 25
    # a run that died after writing data but before its ledger line is invisible and is written again
    facts.limit(3).write.parquet(f"{root}/facts/run_id=r2")
    assert PB.published_run(spark, root) == "r1"
    assert PB.publish(facts.withColumn("observations", F.lit(11).cast("long")), alerts, root, "r2")["status"] == "published"
    f, _ = PB.read_published(spark, root)
    assert f.count() == 20 and rows(f.select("observations").distinct()) == [(11,)]
    assert spark.read.parquet(f"{root}/dim_date").count() == 1 and spark.read.parquet(f"{root}/dim_metric").count() == 20
    assert rows(PB.retention_candidates(spark, root, 1, "2100-01-01")) == [("r1",)]
    assert PB.retention_candidates(spark, root, 10).count() == 0
    PB.retention_candidates(spark, root, 1, "2100-01-01", apply=True).collect()
    assert PB.read_published(spark, root)[0].count() == 20
    with pytest.raises(ValueError):
        PB.retention_candidates(spark, root, 0)
    with pytest.raises(ValueError, match="no published"):
        PB.read_published(spark, new_folder(spark, "none"))


def test_stream_batches_are_stored_once(spark, bundle):
    _, alerts = bundle
    root = new_folder(spark, "stream")
    first = alerts.filter("alert_id < 'id010'")
    assert RP.write_batch(first, root, "s", 0) == "committed" and RP.write_batch(first, root, "s", 0) == "unchanged"
    with pytest.raises(ValueError, match="changed content"):
        RP.write_batch(first.withColumn("reasons", F.lit("other")), root, "s", 0)
    assert RP.write_batch(alerts.filter("alert_id < 'id015'"), root, "s", 1) == "committed"
    assert RP.stored_alerts(spark, root).count() == 15 == RP.outbox(spark, root).count()
    with pytest.raises(ValueError, match="alert id exists"):
        RP.write_batch(alerts.filter("alert_id = 'id001'").withColumn("reasons", F.lit("other")), root, "s", 2)
    with pytest.raises(ValueError, match="rejected"):
        RP.write_batch(first.unionByName(first), root, "s", 3)
    # data without a ledger line: the batch died half-way and is repeated
    first.withColumn("content_sha256", F.lit("x")).write.parquet(f"{root}/stream_alert/stream_id=s/batch_id=7")
    more = alerts.filter("alert_id >= 'id020'")
    assert RP.write_batch(more, root, "s", 7) == "committed" and RP.stored_alerts(spark, root).count() == 20


def test_replay_twice_gives_the_same(spark, bundle):
    _, alerts = bundle
    files, root = new_folder(spark, "files"), new_folder(spark, "stream")
    RP.write_replay_files(alerts, files, 10)
    checkpoint = new_folder(spark, "checkpoint")
    assert sorted(RP.replay(spark, files, root, "s", checkpoint)) == [5, 10, 10]
    assert RP.replay(spark, files, root, "s", checkpoint) == []
    RP.replay(spark, files, root, "s", new_folder(spark, "checkpoint"))
    assert rows(RP.stored_alerts(spark, root), *PB.ALERT_COLUMNS) == rows(alerts)


def test_detector_judges_what_lies_apart(spark):
    """Two tight clouds; readings between them and beyond them, and one that deviates in one measurement only."""
    clouds = [(f"p{i}", 40.0 + i % 4 / 10, 7.0 + i % 3 / 10) for i in range(30)] + [(f"q{i}", 60.0 + i % 4 / 10, 9.0 - i % 3 / 10) for i in range(30)]
    train = spark.createDataFrame(clouds, "pole string, load double, draft double").withColumn("timestamp", F.lit("2031-05-05"))
    detector = A.fit_detector(train, train, ["load", "draft"], k=2)
    centres = sorted(tuple(round(m + c * s, 3) for m, s, c in zip(detector.means, detector.scales, centre, strict=True)) for centre in detector.centres)
    assert [x for c in centres for x in c] == pytest.approx([40.13, 7.1, 60.13, 8.9], abs=0.05)
    odd = spark.createDataFrame([("mid", 50.0, 8.0), ("far", 90.0, 8.0), ("near", 40.1, 7.1)], "pole string, load double, draft double").withColumn("timestamp", F.lit("2031-06-01"))
    judged = {r["pole"]: r for r in A.judge(detector, A.score(detector, odd), "energy", "pole", "m7").collect()}
    assert judged["mid"]["alert_reasons"] == "cluster_distance" and judged["far"]["alert_reasons"] == "cluster_distance;zscore:load"
    assert not judged["near"]["is_alert"] and judged["near"]["severity"] == "none" and judged["far"]["severity"] == "review"
    assert judged["mid"]["cluster"] in (0, 1) and len({r["alert_id"] for r in judged.values()}) == 3
    alone = A.judge(A.measure(train, ["load", "draft"]), odd, "energy", "pole", "m7")
    assert rows(A.alert_records(alone, "energy", "pole"), "sensor_id", "reasons") == [("far", "zscore:load")]
    path = new_folder(spark, "detector")
    A.save_detector(detector, spark, path)
    assert A.load_detector(spark, path) == detector and A.largest_difference(detector, A.load_detector(spark, path), odd) == 0
    with pytest.raises(ValueError, match="not finite"):
        A.measure(train.withColumn("draft", F.lit(None).cast("double")), ["load", "draft"])
    flat = A.measure(train.withColumn("draft", F.lit(3.0)), ["draft"])
    assert A.judge(flat, odd, "energy", "pole", "m7").filter("is_alert").count() == 0


class Stopped(Exception):
    pass


@pytest.mark.parametrize("stop", range(1, 7))
def test_publication_recovers_from_a_stop_at_any_write(spark, bundle, monkeypatch, stop):
    """The n-th write to the store fails; the run is repeated and must be published, whole and once."""
    from pyspark.sql import DataFrameWriter
    facts, alerts = bundle
    root, plain, left = new_folder(spark, "store"), DataFrameWriter.parquet, [stop]

    def parquet(self, path, *a, **b):
        if path.startswith(root):
            left[0] -= 1
            if left[0] == 0:
                raise Stopped
        return plain(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(Stopped):
        PB.publish(facts, alerts, root, "r1")
    monkeypatch.setattr(DataFrameWriter, "parquet", plain)
    with pytest.raises(ValueError, match="no published"):
        PB.published_run(spark, root)
    assert PB.publish(facts, alerts, root, "r1")["status"] == ("completed" if stop == 6 else "published")
    assert PB.publish(facts, alerts, root, "r1")["status"] == "unchanged"
    f, a = PB.read_published(spark, root)
    assert f.count() == 20 and a.count() == 25 and PB.ledger(spark, root).count() == 1


def test_digest_of_facts_does_not_depend_on_partitions(spark):
    from gaugeworks.operators.cleaning import digest_text
    readings = spark.range(5000).select((F.col("id") % 7).cast("string").alias("s"), F.timestamp_seconds(F.col("id") * 97).alias("timestamp"), (F.sin("id") * 1000 / 7).alias("x"))
    digests = {digest_text(daily_facts(readings.repartition(n), "energy", "s", ["x"])) for n in (1, 3, 11)}
    assert len(digests) == 1
    odd = daily_facts(readings.withColumn("x", F.when(F.col("s") == "3", float("nan")).otherwise(F.col("x"))), "energy", "s", ["x"])
    assert odd.filter("isnan(mean)").count() == odd.count()


def test_sound_facts_of_any_size_publish(spark):
    """Readings beyond nine places, tiny, huge and cancelling ones: exact means within bounds, one digest for every partitioning."""
    import datetime as dt
    from fractions import Fraction

    from gaugeworks.operators.cleaning import digest_text
    from gaugeworks.operators.facts import facts_of
    days = [[1 / 3] * 7, [2 / 3] * 3, [4e-10] * 6, [1e20] * 3, [1e20, 1.0, -1e20, 3.0], [1e-300, 2e-300], [5e-324] * 3, [1.7e308, 1.7e308], [0.1] * 10, [-1e7, 1e7, 0.25], [0.0, -0.0], [9999999.999999998, 1e-3]]
    data = [(str(i % 3), dt.datetime(2024, 1, 1 + d, i % 24), x) for d, xs in enumerate(days) for i, x in enumerate(xs)]
    df = spark.createDataFrame(data, "s string, timestamp timestamp, x double")
    found = daily_facts(df, "energy", "s", ["x"]).orderBy("day").collect()
    for r, xs in zip(found, days, strict=True):
        assert r["minimum"] <= r["mean"] <= r["maximum"] and r["observations"] == len(xs)
        want = float(sum(map(Fraction, xs)) / len(xs))
        assert r["mean"] == pytest.approx(want, rel=1e-15, abs=1e-320)
    tables = {name: df.select("s", "timestamp", *[(F.col("x") if name != "traffic" else F.col("x") / 7).alias(m) for m in ms]) for name, ms in METRICS.items()}
    sensors = dict.fromkeys(METRICS, "s")
    assert not any(PB.fact_violations(facts_of(tables, sensors)).first())
    assert len({digest_text(facts_of({k: t.repartition(n, *t.columns[2:3]) if n > 1 else t.coalesce(1) for k, t in tables.items()}, sensors)) for n, tables in ((1, tables), (3, tables), (11, tables))}) == 1
    nothing = df.filter("s = '9'")
    assert daily_facts(nothing, "energy", "s", ["x"]).count() == 0
    blank = daily_facts(df.withColumns({"x": F.lit(None).cast("double"), "timestamp": F.lit(None).cast("timestamp")}), "energy", "s", ["x"]).collect()
    assert [(r["day"], r["mean"], r["sensors"], r["observations"]) for r in blank] == [(None, None, 3, len(data))]


def test_removed_runs_stay_removed(spark, bundle):
    facts, alerts = bundle
    root = new_folder(spark, "store")
    for run in ("old", "new"):
        PB.publish(facts, alerts, root, run)
    assert rows(PB.retention_candidates(spark, root, 5, "2099-12-31", apply=True)) == [("old",)]
    assert PB.retention_candidates(spark, root, 5, "2099-12-31").count() == 0 and rows(PB.ledger(spark, root), "run_id") == [("new",)]
    with pytest.raises(ValueError, match="removed by retention"):
        PB.publish(facts, alerts, root, "old")


def test_alert_without_a_time_is_written_for_replay(spark, bundle):
    _, alerts = bundle
    files = new_folder(spark, "files")
    RP.write_replay_files(alerts.withColumn("observed_at", F.when(F.col("alert_id") != "id003", F.col("observed_at"))), files, 10)
    assert spark.read.json(files).count() == 25


def test_saved_alert_checks(spark):
    saved = spark.createDataFrame([("i", "s", dt.datetime(2025, 1, 1), "r", "m", "review", True, "d3")], "alert_id string, sensor_id string, timestamp timestamp, alert_reasons string, model_id string, severity string, is_alert boolean, source string")
    assert PB.checked_alerts(saved, 1, "source", "d3", "sensor_id", "traffic").count() == 1
    for n, run, df in ((2, "d3", saved), (1, "d4", saved), (1, "d3", saved.withColumn("is_alert", F.lit(False)))):
        with pytest.raises(ValueError):
            PB.checked_alerts(df, n, "source", run, "sensor_id", "traffic")


def test_json_forms(spark, tmp_path):
    (tmp_path / "array.json").write_text('  [{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    (tmp_path / "lines.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    many = tmp_path / "many"
    many.mkdir()
    (many / "p1.json").write_text('{"a": 1, "b": "x"}\n')
    (many / "p2.json").write_text('{"a": 2, "b": "y"}\n')
    for path, kind in ((tmp_path / "array.json", None), (tmp_path / "lines.json", None), (many, "json")):
        assert rows(R.load_dataset(spark, str(path), kind), "a", "b") == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="unsupported"):
        R.load_dataset(spark, "x.xlsx")


def test_enforced_schema(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    schema = StructType([StructField("a", IntegerType()), StructField("b", StringType())])
    (tmp_path / "ok.csv").write_text("a,b\n1,x\n")
    (tmp_path / "bad.csv").write_text("a,b\nseven,x\n")
    (tmp_path / "head.csv").write_text("b,a\nx,1\n")
    assert rows(R.load_enforced(spark, str(tmp_path / "ok.csv"), schema)) == [(1, "x")]
    for name in ("bad.csv", "head.csv"):
        with pytest.raises(Exception):
            R.load_enforced(spark, str(tmp_path / name), schema).collect()
    stored = new_folder(spark, "p")
    spark.range(2).write.parquet(stored)
    with pytest.raises(ValueError, match="stored schema"):
        R.load_enforced(spark, stored, schema, "parquet")
    opts = R.jdbc_options("jdbc:x", "t", split=("id", 0, 100, 8))
    assert opts["numPartitions"] == "8" and opts["partitionColumn"] == "id"


def test_writers(spark):
    df = spark.range(50).withColumn("ts", F.timestamp_seconds(F.col("id") * 1_000_000))
    path = new_folder(spark, "w")
    assert W.write_verified(df, path)["digest"].startswith("50:")
    with pytest.raises(Exception):
        W.write_verified(df, path)
    assert W.multiset_difference(df, spark.read.parquet(path)).count() == 0
    assert W.multiset_difference(df, df.limit(49)).count() == 1
    assert W.export_text(df, new_folder(spark, "e"), rows_per_file=10) == 50 == W.export_text(df, new_folder(spark, "e"), "json")
    W.write_overwrite(df.limit(3), path)
    assert spark.read.parquet(path).count() == 3
    spark.range(2).createOrReplaceTempView("counted")
    assert ("counted", 2) in rows(R.catalog_counts(spark))


def test_insert_new_refuses_broken_contracts(spark):
    bad = spark.createDataFrame([("s", dt.datetime(2025, 1, 1), 1.0, 1.0, -5.0, 1.0)], "sensor_id string, timestamp timestamp, location_lat double, location_lon double, expense double, revenue double")
    path = new_folder(spark, "f")
    with pytest.raises(ValueError, match="contract failed"):
        W.insert_new(bad, path, "fiscal")
    good = bad.withColumn("expense", F.lit(5.0)).withColumn("ignored", F.lit(1))
    assert W.insert_new(good, path, "fiscal").inserted_rows == 1 and W.insert_new(good, path, "fiscal").inserted_rows == 0
