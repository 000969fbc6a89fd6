import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gaugeworks.operators import spatial as S


@pytest.mark.parametrize("bins", [500_000, 0])
def test_touching_zones(spark, bins):
    zones = spark.createDataFrame([("B", "b", "t", 0.0, 1.0, 1.0, 2.0, 5), ("A", "a", "t", 0.0, 1.0, 0.0, 1.0, 5)],
                                  "zone_id string, zone_name string, zone_type string, lat_min double, lat_max double, lon_min double, lon_max double, population int")
    points = spark.createDataFrame([("s", 1, .5, 1.0), ("s", 2, 5.0, 5.0)], "sensor_id string, timestamp int, location_lat double, location_lon double")
    got = rows(S.map_to_zones(points, zones, ["sensor_id", "timestamp"], .1, broadcast_bins=bins), "timestamp", "zone_id", "zone_match_count")
    assert got == [(1, "A", 2), (2, None, 0)]
    every = rows(S.map_to_zones(points, zones, ["sensor_id", "timestamp"], .1, ties="all", broadcast_bins=bins), "timestamp", "zone_id")
    assert every == [(1, "A"), (1, "B"), (2, None)]
    with pytest.raises(ValueError):
        S.map_to_zones(points, zones, ["sensor_id"], ties="first")


@pytest.mark.parametrize("bins, per", [(500_000, 256), (500_000, 2), (0, 256)])
def test_zone_plans_match_brute_force(spark, bins, per):
    rng = random.Random(5)
    zs = [(i, *(lambda a, b: (a, a + rng.uniform(0, 1.5), b, b + rng.uniform(0, 1.5)))(rng.uniform(-4, 4), rng.uniform(-4, 4))) for i in range(60)]
    # a third of the points fall on one spot
    ps = [(i, 1.0, 1.0) if i % 3 == 0 else (i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(300)]
    zones = spark.createDataFrame(zs, "zone_id int, lat_min double, lat_max double, lon_min double, lon_max double")
    points = spark.createDataFrame(ps, "id int, location_lat double, location_lon double")
    hits = {i: [z[0] for z in zs if z[1] <= y <= z[2] and z[3] <= x <= z[4]] for i, y, x in ps}
    got = rows(S.map_to_zones(points, zones, ["id"], .25, broadcast_bins=bins, zones_per_bin=per), "id", "zone_id", "zone_match_count")
    assert sorted(got) == sorted((i, min(h) if h else None, len(h)) for i, h in hits.items())


@pytest.mark.parametrize("bins", [500_000, 0])
def test_points_need_no_key(spark, bins):
    """Two readings with one key in different zones, several without a key, without a place, and equal readings."""
    zones = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0), (2, 2.0, 4.0, 0.0, 2.0), (3, 1.5, 2.5, 0.0, 9.0)], "zone_id int, lat_min double, lat_max double, lon_min double, lon_max double")
    points = spark.createDataFrame([("k", .5, 1.0), ("k", 3.5, 1.0), (None, .5, 1.0), (None, 2.0, 1.0), ("x", None, 1.0), ("y", 1.0, None), ("z", 8.0, 8.0), ("z", 8.0, 8.0)],
                                   "id string, location_lat double, location_lon double")
    got = rows(S.map_to_zones(points, zones, ["id"], .25, broadcast_bins=bins), "id", "location_lat", "zone_id", "zone_match_count")
    want = [("k", .5, 1, 1), ("k", 3.5, 2, 1), (None, .5, 1, 1), (None, 2.0, 1, 3), ("x", None, None, 0), ("y", 1.0, None, 0), ("z", 8.0, None, 0), ("z", 8.0, None, 0)]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("shift", [0.0, 179.0])
def test_near_pairs_match_brute_force(spark, shift):
    rng = random.Random(2)
    sites = spark.createDataFrame([(i, rng.uniform(-60, 60), (rng.uniform(-3, 3) + shift + 180) % 360 - 180) for i in range(120)], "k int, location_lat double, location_lon double")
    a, b = sites.toDF("sensor1", "y1", "x1"), sites.toDF("sensor2", "y2", "x2")
    brute = a.join(b, F.col("sensor1") < F.col("sensor2")).filter(S.haversine_km("y1", "x1", "y2", "x2") <= 300)
    assert rows(S.near_pairs(sites, "k", 300), "sensor1", "sensor2") == rows(brute, "sensor1", "sensor2")


@pytest.mark.parametrize("per_lot", [2048, 7])
def test_near_pairs_in_crowded_cells(spark, per_lot):
    """Two crowds in touching cells, one spot with many sites, and sites without key or place."""
    rng = random.Random(4)
    ps = [(i, rng.gauss(10.0, .01), rng.gauss(20.0 + (i % 2) * .05, .01)) for i in range(150)] + [(i, 10.0, 20.0) for i in range(150, 190)]
    ps += [(i, rng.uniform(5, 15), rng.uniform(15, 25)) for i in range(190, 240)]
    sites = spark.createDataFrame([*ps, (None, 10.0, 20.0), (900, None, 20.0), (901, 10.0, None)], "k int, location_lat double, location_lon double")
    a, b = (spark.createDataFrame(ps, "k int, y double, x double").toDF(f"sensor{i}", f"y{i}", f"x{i}") for i in (1, 2))
    brute = a.join(b, F.col("sensor1") < F.col("sensor2")).filter(S.haversine_km("y1", "x1", "y2", "x2") <= 3)
    assert rows(S.near_pairs(sites, "k", 3, per_lot=per_lot), "sensor1", "sensor2") == rows(brute, "sensor1", "sensor2")
    assert S.near_pairs(sites.limit(0), "k", 3).count() == 0


def test_spatial_association_needs_stable_sites(spark):
    data = [(s, 0.0, lon, f"2025-01-{d:02d}", float(d * k)) for s, lon, k in (("a", 0.0, 1), ("b", .001, 2)) for d in range(1, 21)]
    df = spark.createDataFrame(data, "sensor string, location_lat double, location_lon double, timestamp string, reading double").withColumn("timestamp", F.to_timestamp("timestamp"))
    got = S.spatial_correlation(df, "sensor", "reading").collect()
    assert len(got) == 1 and got[0]["pearson"] == pytest.approx(1) and got[0]["paired_observations"] == 20
    assert S.spatial_correlation(df, "sensor", "reading", minimum=21).first()["status"] == "insufficient_overlap_or_constant"
    moved = df.withColumn("location_lat", F.when((F.col("sensor") == "a") & (F.dayofmonth("timestamp") == 1), 1.0).otherwise(F.col("location_lat")))
    assert S.spatial_correlation(moved, "sensor", "reading").count() == 0
    assert S.location_stability(moved, "sensor").first()["stable_location_sensors"] == 1


def test_a_wide_zone_has_few_cells(spark):
    shape = "zone_id int, lat_min double, lat_max double, lon_min double, lon_max double"
    zones = spark.createDataFrame([(1, 40.0, 50.0, 0.0, 10.0), (2, 41.0, 41.001, 3.0, 3.001), (3, -90.0, 90.0, -180.0, 180.0), (4, 1.0, 1.0, 1.0, 1.0)], shape)
    cells = {r["zone_id"]: r["count"] for r in S.zone_bins(zones, 0.002).groupBy("zone_id").count().collect()}
    assert cells.keys() == {1, 2, 3, 4} and max(cells.values()) < 1000


@pytest.mark.parametrize("bins", [500_000, 0])
def test_zones_of_very_different_sizes(spark, bins):
    rng = random.Random(9)
    zs = []
    for i in range(40):
        side = 10 ** rng.uniform(-3, 1.2)
        y, x = rng.uniform(-20, 20), rng.uniform(-20, 20)
        zs.append((i, y, y + side * rng.random(), x, x + side))
    ps = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(200)] + [(200 + i, z[1], z[4]) for i, z in enumerate(zs)]
    zones = spark.createDataFrame(zs, "zone_id int, lat_min double, lat_max double, lon_min double, lon_max double")
    points = spark.createDataFrame(ps, "id int, location_lat double, location_lon double")
    want = sorted((i, z[0]) for i, y, x in ps for z in zs if z[1] <= y <= z[2] and z[3] <= x <= z[4])
    got = rows(S.map_to_zones(points, zones, ["id"], .002, ties="all", broadcast_bins=bins).filter("zone_id is not null"), "id", "zone_id")
    assert sorted(got) == want
    first = rows(S.map_to_zones(points, zones, ["id"], .002, broadcast_bins=bins), "id", "zone_id", "zone_match_count")
    hits = {i: [z for p, z in want if p == i] for i, *_ in ps}
    assert sorted(first) == sorted((i, min(h) if h else None, len(h)) for i, h in hits.items())
