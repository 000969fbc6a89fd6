"""Correlations of near sensors that are made cell by cell, against plain sums over the shared times."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import spatial as S


def far(a, b):
    y1, x1, y2, x2 = map(math.radians, (*a, *b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def plain(places, readings, km, minimum):
    out = {}
    for a in places:
        for b in places:
            if a < b and far(places[a], places[b]) <= km:
                both = sorted(readings.get(a, {}).keys() & readings.get(b, {}).keys())
                x, y = [readings[a][t] for t in both], [readings[b][t] for t in both]
                r = None
                if len(both) >= minimum and len(set(x)) > 1 and len(set(y)) > 1:
                    mx, my = sum(x) / len(x), sum(y) / len(y)
                    r = sum((i - mx) * (j - my) for i, j in zip(x, y, strict=True)) / math.sqrt(sum((i - mx) ** 2 for i in x) * sum((j - my) ** 2 for j in y))
                out[a, b] = (len(both), r)
    return out


@pytest.mark.parametrize("per_lot", [8192, 7])
def test_pairs_and_r_against_plain_sums(spark, monkeypatch, per_lot):
    monkeypatch.setattr(S, "SERIES_PER_LOT", per_lot)
    rng = random.Random(4)
    places = {f"s{i:02d}": (rng.uniform(-0.5, 0.5), (179.6 + rng.uniform(0, .8) + 180) % 360 - 180) for i in range(70)}
    readings = {k: {t: 7.25 if i % 9 == 0 or t < 4 else 1e6 + rng.randrange(50) / 7 for t in rng.sample(range(40), rng.randint(0, 30))} for i, k in enumerate(places)}
    readings.pop("s05"), readings.pop("s06")
    df = spark.createDataFrame([(k, t, v) for k, r in readings.items() for t, v in r.items()], "k string, t int, v double")
    sites = spark.createDataFrame([(k, *p) for k, p in places.items()], "k string, location_lat double, location_lon double")
    want = plain(places, readings, 20, 3)
    assert any(r is None and n >= 3 for n, r in want.values()) and any(n == 0 for n, _ in want.values())
    for most in (S.DENSE_TIMES, 0):  # in cells, and along the list of pairs
        got = {(r.sensor1, r.sensor2): (r.paired_observations, r.pearson) for r in S.spatial_correlation(
            df, "k", "v", 20, 3, time="t", sites=sites, dense_times=most).collect()}
        assert got.keys() == want.keys()
        for pair, (n, r) in want.items():
            assert got[pair][0] == n and got[pair][1] == (None if r is None else pytest.approx(r, abs=1e-8))


def test_few_bytes_of_sites_are_compared_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS_PER_TASK", 20_000)
    sites = spark.range(600).select("id", (F.rand(1) * .1).alias("location_lat"), (F.rand(2) * .1).alias("location_lon")).cache()
    pairs = S.near_pairs(sites, "id", 30)
    assert pairs.count() == 600 * 599 // 2 and pairs.rdd.getNumPartitions() >= 8
