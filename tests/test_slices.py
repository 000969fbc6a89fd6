"""Cut series must give what the uncut window gives, hot keys included."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from gaugeworks.operators.features import lag_features, next_observation_pairs, prior_window_features, trailing_window_features
from gaugeworks.operators.gaps import fill_forward, interpolate_linear
from gaugeworks.operators.slices import slice_series, with_carry, with_halo
from gaugeworks.operators.statistics import pattern_anomalies, step_trends


@pytest.fixture(scope="module")
def hot(spark):
    """One sensor holds most rows, with bursts of equal timestamps and holes."""
    rng = random.Random(7)
    data, n = [], 0
    for sensor, size in (("hot", 300), ("a", 12), ("b", 3), ("c", 1)):
        t = 0
        for _ in range(size):
            t += rng.choice([0, 60, 600, 3600, 7200, 90_000])
            data.append((n, sensor, t, round(rng.uniform(0, 50), 2) if rng.random() > .2 else None))
            n += 1
    return spark.createDataFrame(data, "id long, sensor_id string, t long, v double").withColumn("timestamp", F.timestamp_seconds("t")).cache()


def test_slices_are_balanced_and_ties_stay_together(hot):
    s = slice_series(hot, ["sensor_id"], "timestamp", 20)
    assert s.cut and s.n_big == 1
    sizes = [r["n"] for r in s.frame.filter("sensor_id = 'hot'").groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) <= 60
    assert s.frame.groupBy("sensor_id", "t").agg(F.count_distinct("_slice").alias("k")).filter("k > 1").count() == 0
    assert s.frame.filter("sensor_id <> 'hot' and _slice <> -2").count() == 0


def test_far_dates_and_missing_times_do_not_undo_the_cuts(spark, hot):
    far = hot.unionByName(spark.createDataFrame([(9000, "hot", 253370764800, 1.0), (9001, "hot", None, 2.0), (9002, "hot", None, None), (9003, "a", None, 3.0)], "id long, sensor_id string, t long, v double")
                          .withColumn("timestamp", F.timestamp_seconds("t")))
    s = slice_series(far, ["sensor_id"], "timestamp", 20)
    sizes = [r["n"] for r in s.frame.filter("sensor_id = 'hot'").groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) <= 60
    order = ["timestamp", "id"]
    for run in (lambda b: lag_features(far, "sensor_id", ["v"], order, budget=b), lambda b: step_trends(far, "v", "sensor_id", order, budget=b),
                lambda b: with_carry(far, ["sensor_id"], order, {"v": F.col("v")}, b)):
        names = sorted(run(1_000_000).columns)
        assert rows(run(1_000_000), *names) == rows(run(20), *names) == rows(run(3), *names)


@pytest.mark.parametrize("before, after", [(1, 0), (24, 0), (0, 1), (7, 7)])
def test_halo_frames_match(hot, before, after):
    order = ["timestamp", "id"]

    def run(budget):
        s = with_halo(hot, ["sensor_id"], order, before, after, budget)
        w = s.window(*order)
        out = s.frame.withColumns({"m": F.sum("v").over(w.rowsBetween(-before, after)), "n": F.count("*").over(w.rowsBetween(-before, after)),
                                   "edge": F.lag("id", before).over(w) if before else F.lead("id", after).over(w)})
        return rows(s.own(out), "id", "n", "edge", F.round("m", 6))

    assert run(1_000_000) == run(20) == run(2)


def test_carry_crosses_empty_slices(hot):
    order = ["timestamp", "id"]
    blank = hot.withColumn("v", F.when(F.col("id") % 40 == 5, F.col("v")))
    cols = {"v": F.col("v")}
    assert rows(with_carry(blank, ["sensor_id"], order, cols), "id", "_prev_v", "_next_v") == rows(
        with_carry(blank, ["sensor_id"], order, cols, 10), "id", "_prev_v", "_next_v")


def test_elapsed_windows_match(hot):
    columns = ["id"] + [f"v_prior_{d}d_{x}" for d in (7, 30) for x in ("count", "mean", "std", "min", "max", "range", "position")]

    def run(budget):
        out = prior_window_features(hot, "sensor_id", ["v"], budget=budget)
        return rows(out, *[F.col(c).cast("float").alias(c) if c != "id" and not c.endswith("count") else c for c in columns])

    for a, b in zip(run(None), run(1), strict=True):
        assert [x is None for x in a] == [x is None for x in b]
        assert [x for x in a if x is not None] == pytest.approx([x for x in b if x is not None], rel=1e-5)


@pytest.mark.parametrize("fn", [
    lambda d, b: lag_features(d, "sensor_id", ["v"], ["timestamp", "id"], budget=b),
    lambda d, b: trailing_window_features(d, "sensor_id", ["v"], ["timestamp", "id"], budget=b),
    lambda d, b: interpolate_linear(d, ["v"], ["sensor_id"], ["timestamp", "id"], 7200, b),
    lambda d, b: fill_forward(d, ["v"], ["sensor_id"], ["timestamp", "id"], 6, b),
    lambda d, b: step_trends(d, "v", "sensor_id", ["timestamp", "id"], budget=b),
    lambda d, b: next_observation_pairs(d, "sensor_id", "v", (1_000_000, 2_000_000), ["timestamp", "id"], b),
    lambda d, b: pattern_anomalies(d, "v", ["timestamp", "id"], b),
])
def test_operators_do_not_depend_on_slicing(hot, fn):
    def run(budget):
        out = fn(hot, budget)
        return rows(out, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(out.dtypes)])
    assert run(None) == run(15)


def test_future_rows_do_not_move_prior_features(hot):
    cut = 3_000_000
    changed = hot.withColumn("v", F.when(F.col("t") > cut, F.col("v") + 1000).otherwise(F.col("v")))
    for fn in (lambda d: prior_window_features(d, "sensor_id", ["v"]), lambda d: lag_features(d, "sensor_id", ["v"], ["timestamp", "id"]),
               lambda d: trailing_window_features(d, "sensor_id", ["v"], ["timestamp", "id"])):
        assert rows(fn(hot).filter(F.col("t") <= cut)) == rows(fn(changed).filter(F.col("t") <= cut))


def test_plain_window_is_kept_for_ordinary_series(hot):
    s = with_halo(hot, ["sensor_id"], ["timestamp", "id"], 3)
    assert not s.cut and s.frame is hot
    assert isinstance(s.window("timestamp"), type(Window.partitionBy("a")))


def test_elapsed_windows_with_null_sensors_and_times(spark):
    """Cut and uncut frames agree where sensors, times or values are NULL, and where very many rows share few seconds."""
    day = 86400
    times = [None, None, 0, 0, 1, 59, 60, 3599, 3600, day - 1, day, day + 1, 7 * day - 1, 7 * day, 7 * day, 7 * day + 1, 7 * day + 60, 8 * day, 30 * day, 30 * day + 5, 31 * day + 3600, -5, -day]
    data = [(i * 100 + k, s, t, None if (i + k) % 5 == 0 else float((i * 37 + k * 11) % 23)) for i, t in enumerate(times) for k, s in enumerate([None, "a", "b"])]
    data += [(10_000 + i, "a", i % 3 + 7200, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, sensor_id string, t long, v double").withColumn("timestamp", F.timestamp_seconds("t")).repartition(5)
    labels = [f"v_prior_{d}d_{x}" for d in (7, 30) for x in ("count", "mean", "std", "min", "max")]

    def run(budget):
        return {r["id"]: r for r in prior_window_features(df, "sensor_id", ["v"], budget=budget).collect()}

    plain, cut = run(None), run(1)
    assert plain.keys() == cut.keys() and len(plain) == len(data)
    for key, r in plain.items():
        for c in labels:
            assert cut[key][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-9, abs=1e-9)), (key, c)
    assert plain[0]["v_prior_7d_count"] == cut[0]["v_prior_7d_count"] > 0


def test_elapsed_windows_of_one_crowded_hour_hold_few_rows(spark):
    """What is left to window of a sensor with very many rows in an hour are its seconds."""
    from gaugeworks.operators.slices import elapsed_stats
    df = spark.range(200_000).select(F.lit("hot").alias("sensor_id"), F.timestamp_seconds(F.col("id") % 3600).alias("timestamp"), (F.col("id") % 11).cast("double").alias("v"))
    out = elapsed_stats(df, ["sensor_id"], "timestamp", ["v"], (7,))
    last = out.filter("timestamp = timestamp_seconds(3599)").select("v_prior_7d_count").distinct().collect()
    assert [r[0] for r in last] == [sum(1 for i in range(200_000) if i % 3600 < 3599)]
