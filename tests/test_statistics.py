import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from gaugeworks.operators import features as X
from gaugeworks.operators import statistics as S
from gaugeworks.operators.fourier import bin_powers

START = dt.date(2025, 1, 1)


def daily(spark, values, skip=(), start=START):
    data = [("s", start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(data, "series string, day date, value double")


def test_linear_trend(spark):
    d = spark.createDataFrame([("s", START, 2.0), ("s", START + dt.timedelta(2), 6.0), ("s", START + dt.timedelta(4), 10.0)], "series string, day date, value double")
    r = S.linear_trend(d, ["series"], "value").first()
    assert r["slope_per_day"] == pytest.approx(2) and r["r_squared"] == pytest.approx(1) and r["last_7d_minus_previous_7d"] is None
    assert S.linear_trend(daily(spark, [1, 1, 1]), ["series"], "value").first()["r_squared"] is None
    short = S.linear_trend(daily(spark, [1, 2]), ["series"], "value").first()
    assert short["slope_per_day"] is None and short["days"] == 2
    assert S.linear_trend(daily(spark, range(20)), ["series"], "value").first()["last_7d_minus_previous_7d"] == pytest.approx(7)


def test_weekly_decomposition(spark):
    """Against a plain centred seven-day mean and weekday means of what it leaves, on a noisy series."""
    rng = np.random.default_rng(12)
    values = 50 + 0.3 * np.arange(70) + np.tile([4, 0, -1, -2, -3, 1, 1], 10) + rng.normal(0, .5, 70)
    got = {r["day"]: r for r in S.weekly_decomposition(daily(spark, values), ["series"], "value").collect()}
    trend = {i: values[i - 3:i + 4].mean() for i in range(3, 67)}
    assert {i for i in range(70) if got.get(START + dt.timedelta(i)) and got[START + dt.timedelta(i)]["trend"] is not None} == set(trend)
    for i, t in trend.items():
        r = got[START + dt.timedelta(i)]
        assert r["trend"] == pytest.approx(t) and r["trend"] + r["weekly_component"] + r["residual"] == pytest.approx(values[i])
    parts = {(START + dt.timedelta(i)).weekday(): got[START + dt.timedelta(i)]["weekly_component"] for i in trend}
    assert sum(parts.values()) == pytest.approx(0, abs=1e-9) and parts[START.weekday()] == max(parts.values())
    for holes in ([35], range(12, 70)):  # a day is missing; fewer than two weeks
        assert S.weekly_decomposition(daily(spark, values, skip=holes), ["series"], "value").isEmpty()


@pytest.mark.parametrize("shift", [-400.0, 25.0])
def test_expected_values_come_from_the_past_only(spark, shift):
    """Whatever happens from one day on, that day's own value included, what was expected up to it stays."""
    rng = np.random.default_rng(31)
    values = rng.gamma(4, 10, 91)
    turn = 70
    bent = np.where(np.arange(91) >= turn, values + shift, values)
    plain, changed = ({r["day"]: r["expected"] for r in S.prior_weekday_deviation(daily(spark, v), ["series"], "value").collect()} for v in (values, bent))
    days = [START + dt.timedelta(i) for i in range(91)]
    assert [plain.get(d) for d in days[:turn + 1]] == [changed.get(d) for d in days[:turn + 1]]
    assert any(plain.get(d) != changed.get(d) for d in days[turn + 7:])
    same = S.prior_weekday_deviation(daily(spark, [6.5] * 91), ["series"], "value")
    assert same.filter("review_flag").isEmpty()


def test_median_flags(spark):
    values = [10 + i % 5 for i in range(40)]
    got = {r["day"]: r for r in S.prior_median_flags(daily(spark, [*values[:35], 500, *values[36:]]), ["series"], "value").collect()}
    hit = got[START + dt.timedelta(35)]
    past = np.array(values[7:35])
    mad = np.median(np.abs(past - np.median(past)))
    assert hit["review_flag"] and hit["review_score"] == pytest.approx(0.67448975 * (500 - np.median(past)) / mad)
    assert not got[START + dt.timedelta(27)]["assessed"] and got[START + dt.timedelta(28)]["assessed"]
    gap = S.prior_median_flags(daily(spark, values, skip=[20]), ["series"], "value")
    assert gap.filter("assessed").count() == 0
    assert S.prior_median_flags(daily(spark, [3.0] * 40), ["series"], "value").filter("assessed").count() == 0


def panel(spark, n, skip=()):
    data = [(START + dt.timedelta(i), float(i), float(2 * i), 1.0) for i in range(n) if i not in skip]
    return spark.createDataFrame(data, "day date, a double, b double, c double")


def test_daily_pairs(spark):
    got = {(r["left"], r["right"]): r for r in S.daily_pair_correlations(panel(spark, 20), ["a", "b", "c"]).collect()}
    assert got["a", "b"]["pearson_daily_means"] == pytest.approx(1) and got["a", "c"]["pearson_daily_means"] is None
    assert got["a", "b"]["pearson_daily_changes"] is None
    gapped = S.daily_pair_correlations(panel(spark, 20, skip=[10]), ["a", "b"]).first()
    assert gapped["overlap_days"] == 19 and gapped["difference_pairs"] == 17
    assert S.daily_pair_correlations(panel(spark, 5), ["a", "b"]).first()["pearson_daily_means"] is None


def test_hourly_pairs(spark):
    def hours(n):
        return spark.range(n).select(F.timestamp_seconds(F.lit(1735689600) + F.col("id") * 3600).alias("hour_timestamp"), F.col("id").cast("double").alias("a"),
                                     (F.col("id") * 2.0).alias("b"), F.lit(1.0).alias("c"))
    got = {(r["left"], r["right"]): r["pearson"] for r in S.hourly_pair_correlations(hours(336), ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "c"] is None
    assert S.hourly_pair_correlations(hours(48), ["a", "b"]).first()["pearson"] is None


def test_cycles_match_fft(spark):
    n = 96
    y = [3 + math.sin(2 * math.pi * i / 7) + .3 * math.cos(2 * math.pi * i / 24) for i in range(n)]
    series = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "i long, v double").repartition(3)
    power = np.abs(np.fft.rfft(np.array(y) - np.mean(y))) ** 2
    got = dict(rows(S.spectrum(series, "v", "i"), "bin", "power"))
    assert np.allclose([got[b] for b in range(n // 2 + 1)], power, atol=1e-6)
    t = int(np.argmin(np.abs(np.fft.rfftfreq(n) - 1 / 7)))
    r = S.cycle_rank(series, "v", "i").first()
    assert r["n_bins"] == len(power) and r["cycle_rank"] == int((power > power[t]).sum()) + 1 and r["period_days"] == pytest.approx(n / t)
    periods = 1 / np.fft.rfftfreq(n)[1:]
    for r in S.target_cycles(series, "v", "i", 1.0, (24.0, 12.0, 7.0)).collect():
        k = int(np.argmin(np.abs(periods - r["target_hours"]))) + 1
        assert r["period_hours"] == pytest.approx(n / k) and r["power"] == pytest.approx(power[k], abs=1e-6)


def test_step_direction_and_sensor_trend(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", 0, 1.0)], "sensor string, t long, v double").withColumn("timestamp", F.timestamp_seconds(F.col("t") * 86400))
    s = S.step_trends(d, "v", "sensor").filter("sensor = 'a'").orderBy("t").collect()
    assert [r["v_trend_direction"] for r in s] == [0] * 6 + [1] * 4 and s[5]["v_trend_strength"] is None
    t = {r["sensor"]: r for r in S.per_sensor_trends(d, "sensor", "v").collect()}
    assert t["a"]["slope_per_day"] == pytest.approx(1) and t["b"]["slope_per_day"] is None


def test_rank_correlation(spark):
    d = spark.createDataFrame([(1.0, 10.0), (2.0, 100.0), (3.0, 1000.0), (3.0, 1000.0), (None, 1.0)], "x double, y double")
    r = S.rank_correlation(d, "x", "y").first()
    assert r["observations"] == 4 and r["spearman"] == pytest.approx(1) and r["pearson"] < 1


@pytest.mark.parametrize("budget", [None, 1])
def test_elapsed_windows_against_a_plain_loop(spark, budget):
    """Readings at odd seconds, some exactly 7 or 30 days apart, several at one time."""
    rng = np.random.default_rng(77)
    times = sorted({int(t) for t in rng.integers(0, 60 * 86400, 40)})
    times += [times[3] + 7 * 86400, times[5] + 30 * 86400, times[9]]
    data = [("k", t, None if i % 9 == 4 else float(rng.integers(0, 100))) for i, t in enumerate(times)]
    table = spark.createDataFrame(data, "sensor string, t long, v double").withColumn("timestamp", F.timestamp_seconds("t"))
    got = X.prior_window_features(table, "sensor", ["v"], budget=budget).collect()
    assert len(got) == len(data)
    for r in got:
        for days in (7, 30):
            past = [v for _, t, v in data if r["t"] - days * 86400 <= t < r["t"] and v is not None]
            assert r[f"v_prior_{days}d_count"] == len(past)
            assert r[f"v_prior_{days}d_mean"] == (pytest.approx(np.mean(past)) if past else None)
            assert (r[f"v_prior_{days}d_min"], r[f"v_prior_{days}d_max"]) == ((pytest.approx(min(past)), pytest.approx(max(past))) if past else (None, None))


def test_changes_between_readings(spark):
    table = spark.createDataFrame([("k", 0, 8.0), ("k", 7200, 6.0), ("k", 10800, 0.0), ("k", 14400, 3.0)], "sensor string, t long, v double").withColumn("timestamp", F.timestamp_seconds("t"))
    got = X.lag_features(table, "sensor", ["v"]).orderBy("t").collect()
    assert [r["v_change_per_hour"] for r in got] == [None, -1.0, -6.0, 3.0] and got[3]["v_pct_change"] is None


def test_chronological_pairs(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(1, 7)], "sensor string, d int, v double").withColumn("timestamp", F.timestamp_seconds(F.col("d") * 86400))
    parts = dict(rows(X.next_observation_pairs(d, "sensor", "v", (3 * 86400, 5 * 86400)).groupBy("part").count()))
    assert parts == {"train": 1, "validation": 1, "test": 1, "purged": 2, "unlabelled": 1}


@pytest.mark.parametrize("n", [1, 2, 5, 97, 360, 1001])
def test_bin_powers_of_any_length(spark, n):
    y = np.random.default_rng(n).normal(size=n)
    series = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, v double").repartition(3)
    got = dict(rows(bin_powers(series, "v", "i", n), "bin", "power"))
    assert sorted(got) == list(range(n // 2 + 1)) and np.allclose([got[b] for b in sorted(got)], np.abs(np.fft.rfft(y)) ** 2, rtol=1e-9, atol=1e-9)


def test_bin_powers_of_odd_rows(spark):
    series = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, None), (5, 4.0), (-1, 1.0), (None, 9.0)], "i long, v double")
    got = dict(rows(bin_powers(series, "v", "i", 4), "bin", "power"))  # position 5 is 1, -1 is 3
    assert np.allclose([got[b] for b in sorted(got)], np.abs(np.fft.rfft([3, 4, 0, 1])) ** 2)
    assert bin_powers(series.limit(0), "v", "i", 0).count() == 0
    assert np.allclose([r["power"] for r in bin_powers(series.limit(0), "v", "i", 3).collect()], 0)


def test_spectrum_of_a_long_series(spark):
    n = 200_003  # a prime: no length that a plain split would do
    series = spark.range(n).select(F.col("id").alias("i"), (F.sin(F.col("id") * 2 * math.pi / 24) + F.rand(3)).alias("v"))
    y = np.array([r["v"] for r in series.orderBy("i").collect()])
    power = np.abs(np.fft.rfft(y - y.mean())) ** 2
    got = np.array([r["power"] for r in S.spectrum(series, "v", "i").orderBy("bin").collect()])
    assert len(got) == len(power) and np.allclose(got, power, rtol=1e-6, atol=1e-6 * power.max() * 1e-6)
