"""Zone mapping, near pairs and spatial association."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.columns import EARTH_RADIUS_KM, haversine_km, pearson
from gaugeworks.operators.overlaps import overlapping_pairs
from gaugeworks.operators.slices import BROADCAST_KEYS, checked_join
from gaugeworks.session import keep

BROADCAST_BINS = 500_000
"""Most grid cells of a zone table that are replicated to every task."""

ZONES_PER_BIN = 256
"""Most zones kept in one replicated grid cell."""


def _bin(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(size)).cast("long")


SITES_PER_LOT = 2048
"""Sites of a crowded cell that one lot compares with those of the cells around it."""

COVER = 16
"""Cells that a zone spans in each direction before it goes to cells of twice the size."""


def zone_level(bin_size: float) -> Column:
    """Level of the cells that cover a zone; cells of level n are ``bin_size * 2^n`` wide."""
    span = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min"))
    return F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(F.when(span > 0, span / (bin_size * COVER)))), F.lit(0))).cast("int").alias("_level")


def zone_bins(zones: DataFrame, bin_size: float) -> DataFrame:
    """One row per zone and grid cell it touches; a zone has cells of one level, at most about ``COVER`` squared of them."""
    levelled = zones.withColumn("_level", zone_level(bin_size))
    size = F.lit(bin_size) * F.pow(F.lit(2.0), F.col("_level"))
    lat, lon = (F.explode(F.sequence(F.floor(F.col(f"{c}_min") / size).cast("long"), F.floor(F.col(f"{c}_max") / size).cast("long"))) for c in ("lat", "lon"))
    return levelled.withColumn("_lat_bin", lat).withColumn("_lon_bin", lon)


def map_to_zones(points: DataFrame, zones: DataFrame, key: Sequence[str], bin_size: float = 0.002, lat: str = "location_lat",
                 lon: str = "location_lon", ties: str = "lowest", attributes: Sequence[str] = ("zone_name", "zone_type", "population"),
                 broadcast_bins: int = BROADCAST_BINS, zones_per_bin: int = ZONES_PER_BIN) -> DataFrame:
    """Attach the rectangular zone (edges included) a point lies in.

    ``ties="lowest"`` keeps every point once, with the smallest matching zone id and ``zone_match_count``;
    ``ties="all"`` keeps all matches. Unmatched points keep NULL. Points and zones meet on grid cells of several sizes, wide zones on
    wide cells, and a point looks up one cell of each size; never is every point compared with every zone; ``key`` only documents what a point is and may repeat or be NULL. While the cell table is small (its size is counted), each cell carries
    its zones to the points and no point is shuffled; otherwise both sides are shuffled on the cell.
    """
    if ties not in ("lowest", "all"):
        raise ValueError("ties must be lowest or all")
    attributes = [a for a in attributes if a in zones.columns]
    corners = ["lat_min", "lat_max", "lon_min", "lon_max"]
    wanted = zones.select("zone_id", *corners, *attributes)
    bins = keep(zone_bins(wanted, bin_size))
    levels = sorted(r[0] for r in bins.select("_level").distinct().collect())  # a few dozen at most
    at = ["_level", "_lat_bin", "_lon_bin"]
    y, x = F.col(lat), F.col(lon)

    small = bins.count() <= broadcast_bins
    if small:
        small = (bins.groupBy(*at).count().agg(F.max("count")).first()[0] or 0) <= zones_per_bin
    if small:
        listed = keep(bins.groupBy(*at).agg(F.collect_list(F.struct("zone_id", *corners, *attributes)).alias("_zones")))
        joined, lists = points, []
        for n in levels:
            size = bin_size * 2 ** n
            own = listed.filter(F.col("_level") == n).select("_lat_bin", "_lon_bin", F.col("_zones").alias(f"_zones{n}"))
            joined = joined.withColumns({"_lat_bin": _bin(lat, size), "_lon_bin": _bin(lon, size)}).join(F.broadcast(own), at[1:], "left").drop(*at[1:])
            lists.append(F.filter(F.coalesce(f"_zones{n}", F.array()), lambda z: y.between(z["lat_min"], z["lat_max"]) & x.between(z["lon_min"], z["lon_max"])))
        none = F.array().cast(listed.schema["_zones"].dataType)
        found = joined.withColumn("_hits", F.array_sort(F.concat(none, *lists))).select(*points.columns, "_hits")
        if ties == "lowest":
            first = F.try_element_at("_hits", F.lit(1))
            return found.withColumns({"zone_match_count": F.size("_hits"), "zone_id": first["zone_id"],
                                      **{a: first[a] for a in attributes}}).drop("_hits")
        one = found.withColumn("_z", F.explode_outer("_hits"))
        return one.withColumns({"zone_id": F.col("_z.zone_id"), **{a: F.col(f"_z.{a}") for a in attributes}}).drop("_hits", "_z")

    # a point's zones depend on its place only: each place is compared once, in one cell per level, and points need no key to get the answer back
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("_level"), _bin(lat, bin_size * 2 ** n).alias("_lat_bin"), _bin(lon, bin_size * 2 ** n).alias("_lon_bin"))
                                for n in levels or [0]]))
    p, z = points.select(lat, lon).distinct().withColumn("_cell", cells).select(lat, lon, "_cell.*").alias("p"), bins.alias("z")
    inside = F.col(f"p.{lat}").between(F.col("z.lat_min"), F.col("z.lat_max")) & F.col(f"p.{lon}").between(F.col("z.lon_min"), F.col("z.lon_max"))
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}") == F.col(f"z.{c}") for c in at])
    found = p.join(z, same & inside, "inner").select(
        F.col(f"p.{lat}").alias(lat), F.col(f"p.{lon}").alias(lon), F.struct("z.zone_id", *[f"z.{a}" for a in attributes]).alias("_z"))
    if ties == "all":
        return points.join(found, [lat, lon], "left").select(*points.columns, "_z.zone_id", *[f"_z.{a}" for a in attributes])
    best = found.groupBy(lat, lon).agg(F.min_by("_z", "_z.zone_id").alias("_z"), F.count("*").alias("_n"))
    return points.join(best, [lat, lon], "left").select(*points.columns, "_z", "_n").withColumns({
        "zone_match_count": F.coalesce("_n", F.lit(0)).cast("int"), "zone_id": F.col("_z.zone_id"),
        **{a: F.col(f"_z.{a}") for a in attributes}}).drop("_z", "_n")


def zone_day_totals(mapped: DataFrame, sensor: str, count: str, speed: str, time: str = "timestamp") -> DataFrame:
    """Observations, sensors and means per zone and day, with the readings whose zone was ambiguous."""
    return mapped.groupBy("zone_id", "zone_name", "zone_type", F.to_date(time).alias("day")).agg(
        F.count("*").alias("observations"), F.count_distinct(sensor).alias("sensors"), F.avg(count).alias("mean_count"),
        F.avg(speed).alias("mean_speed"), F.sum((F.col("zone_match_count") > 1).cast("long")).alias("ambiguous_zone_readings"))


def site_table(df: DataFrame, key: str, lat: str = "location_lat", lon: str = "location_lon") -> DataFrame:
    """One row per sensor with its number of distinct coordinates; coordinates are those of a stable sensor."""
    places = df.select(key, lat, lon).distinct()
    return places.groupBy(key).agg(F.count("*").alias("coordinates"), F.min(lat).alias(lat), F.min(lon).alias(lon))


def location_stability(df: DataFrame, key: str, lat: str = "location_lat", lon: str = "location_lon") -> DataFrame:
    sites = site_table(df, key, lat, lon)
    stable = F.count(F.when(F.col("coordinates") == 1, 1))
    return sites.agg(F.count("*").alias("sensors"), stable.alias("stable_location_sensors"), (F.count("*") - stable).alias("changing_location_sensors"))


def _meetings(spots: DataFrame, max_km: float, per_lot: int, wide: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Homes and visitors of grid cells whose sides are ``wide`` times ``max_km`` or more, the number of lots, and the pairs that meet.

    A table of spots (id, y, x), cheap to read again, gets (cy, cx, lot, role). Each spot is at home in its cell (role 0), visits it (1), and visits those cells of
    greater number that its surroundings reach into (2), so spots of different cells meet once and those of one cell in both orders. A cell
    with more than ``per_lot`` spots is dealt out: each of them is at home in one lot, and visitors go to every lot.
    """
    highest = spots.agg(F.max(F.abs("y"))).first()[0] or 0.0
    height = max_km / 111.19 * 1.001
    near_a_pole = highest + height >= 89.9
    width = 360.0 if near_a_pole else min(360.0, height / math.cos(math.radians(highest + height)))
    across = max(1, int(360 / min(360.0, wide * width)))
    tall, broad = wide * height, 360 / across
    row, column = (lambda d: F.floor((F.col("y") + d) / tall)), (lambda d: F.pmod(F.floor((F.col("x") + d) / broad), F.lit(across)))
    home = spots.withColumns({"cy": row(0.0), "cx": column(0.0)})
    reached = F.array_distinct(F.array(*[F.struct(row(dy).alias("cy"), column(dx).alias("cx")) for dy in (-height, 0.0, height) for dx in (-width, 0.0, width)]))
    greater = F.filter(reached, lambda c: (c["cy"] > F.col("cy")) | ((c["cy"] == F.col("cy")) & (c["cx"] > F.col("cx"))))
    visits = F.concat(F.array(F.struct("cy", "cx", F.lit(1).alias("role"))), F.transform(greater, lambda c: F.struct(c["cy"].alias("cy"), c["cx"].alias("cx"), F.lit(2).alias("role"))))
    visitors = home.withColumn("_c", F.explode(visits)).select(*spots.columns, "_c.*")
    sizes = home.groupBy("cy", "cx").agg(F.count("*").alias("n")).join(visitors.groupBy("cy", "cx").agg(F.count("*").alias("m")), ["cy", "cx"])
    cells = keep(sizes.withColumn("lots", F.ceil(F.col("n") / per_lot)))
    told = cells.agg(F.sum("lots").alias("lots"), F.sum(F.col("n").cast("double") * F.col("m")).alias("work"), F.count(F.when(F.col("lots") > 1, 1)).alias("crowds")).first()
    crowded = cells.filter("lots > 1").select("cy", "cx", "lots")
    lots = F.coalesce("lots", F.lit(1).cast("long"))
    home, visitors = (checked_join(df, crowded, ["cy", "cx"], "left", told["crowds"]) for df in (home.withColumn("role", F.lit(0)), visitors))
    home = home.withColumn("lot", F.pmod(F.xxhash64("id"), lots)).drop("lots")
    visitors = visitors.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1))).drop("lots")
    return home, visitors, int(told["lots"] or 1), int(told["work"] or 0)


def _spots(sites: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """Sites with a key and a place, stored under a number of their own."""
    placed = F.col(key).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return keep(sites.filter(placed).select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")))


def _in_order(met: DataFrame, max_km: float, *others: Column) -> DataFrame:
    """Met pairs (key1, y1, x1, key2, y2, x2) that are near, smaller key first."""
    swap = F.col("key1") > F.col("key2")
    first, second = ([F.when(swap, F.col(f"{c}{b}")).otherwise(F.col(f"{c}{a}")) for c in ("key", "y", "x")] for a, b in ((1, 2), (2, 1)))
    far = haversine_km("_y1", "_x1", "_y2", "_x2")
    told = met.filter("key1 <> key2").select(*[c.alias(n) for c, n in zip(first, ("sensor1", "_y1", "_x1"), strict=True)], *[c.alias(n) for c, n in zip(second, ("sensor2", "_y2", "_x2"), strict=True)], *others)
    return told.withColumn("distance_km", far).filter(F.col("distance_km") <= max_km).drop("_y1", "_x1", "_y2", "_x2")


PAIRS_PER_TASK = 50_000_000
"""Pairs of sites that one task compares."""


def near_pairs(sites: DataFrame, key: str, max_km: float, lat: str = "location_lat", lon: str = "location_lon", per_lot: int = SITES_PER_LOT) -> DataFrame:
    """Pairs of sites at most ``max_km`` apart, smaller key first; sites without a key or a place are in no pair.

    Sites meet only within their own and the eight surrounding cells, whose sides are at least ``max_km``, and only once. Homes of a crowded
    cell are dealt to lots of ``per_lot``, and so are a lot's visitors. The number of tasks follows from the counted
    comparisons, not from the bytes shuffled: a few MB of sites can stand for billions of pairs.
    """
    spots = _spots(sites, key, lat, lon)
    home, visitors, lots, work = _meetings(spots, max_km, per_lot, 1)
    tasks = 1 + work // PAIRS_PER_TASK
    hands = max(1, min(tasks, -(-4 * tasks // lots)))  # lots of the visitors, each of which meets a copy of the homes
    meet = ["cy", "cx", "lot", "hand"]
    home = home.withColumn("hand", F.explode(F.sequence(F.lit(0), F.lit(hands - 1)))).drop("role")
    visitors = visitors.withColumn("hand", F.pmod(F.xxhash64("id", F.lit(hands)), F.lit(hands)).cast("int"))
    # a fixed number of partitions, which is not merged again because their bytes are few
    parts = max(1, min(4 * tasks, lots * hands, 4000))
    left = visitors.withColumnsRenamed({"id": "id1", "key": "key1", "y": "y1", "x": "x1"}).repartition(parts, *meet)
    right = home.withColumnsRenamed({"id": "id2", "key": "key2", "y": "y2", "x": "x2"}).repartition(parts, *meet)
    once = (F.col("role") == 2) | (F.col("id1") < F.col("id2"))
    close = F.abs(F.col("y1") - F.col("y2")) <= max_km / 111.19 * 1.001
    met = left.join(right.hint("shuffle_hash"), meet).filter(once & close)
    return _in_order(met, max_km).select("sensor1", "sensor2", "distance_km")


DENSE_TIMES = 20_000
"""Different times up to which series are laid out over all of them."""

SERIES_PER_LOT = 8192
"""Series of a crowded cell that one task holds."""

FLOPS_PER_TASK = 5e9


def spatial_correlation(df: DataFrame, key: str, value: str, max_km: float = 2.0, minimum: int = 14, align: str = "timestamp",
                        time: str = "timestamp", lat: str = "location_lat", lon: str = "location_lon", sites: DataFrame | None = None,
                        dense_times: int = DENSE_TIMES) -> DataFrame:
    """Pearson r between stable sensors at most ``max_km`` apart, over exact shared times or over hours of the day.

    Readings are averaged per sensor and time before they are paired. While there are at most ``dense_times`` different times, a sensor's
    series is one row that goes to its own cell and to those it reaches into, and pairs are made and correlated there (``overlaps``): what is
    shuffled and stored grows with the readings and not with pairs times shared times. With more times, readings are
    joined along the list of pairs.
    """
    places = sites if sites is not None else site_table(df, key, lat, lon).filter(F.col("coordinates") == 1)
    at = F.hour(time) if align == "hour_of_day" else F.col(time)
    read = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("_s"), at.alias("_t"), F.col(value).alias("_v")).filter("_t IS NOT NULL")
    times = keep(read.select("_t").distinct())
    different = times.count()
    if different <= dense_times:
        out = _correlated_in_cells(read, times, different, _spots(places, key, lat, lon), max_km, minimum)
    else:
        out = _correlated_by_rows(read, keep(near_pairs(places, key, max_km, lat, lon)), minimum)
    return out.withColumn("status", F.when(F.col("pearson").isNotNull(), "descriptive_association").otherwise("insufficient_overlap_or_constant"))


def _correlated_in_cells(read: DataFrame, times: DataFrame, different: int, spots: DataFrame, max_km: float, minimum: int) -> DataFrame:
    numbers = times.select("_t", (F.row_number().over(Window.orderBy("_t")) - 1).cast("int").alias("_n"))  # at most dense_times rows
    means = read.groupBy("_s", "_t").agg(F.avg("_v").alias("_v")).join(F.broadcast(numbers), "_t")
    series = means.groupBy("_s").agg(F.collect_list(F.struct("_n", "_v")).alias("_r")).select(F.col("_s").alias("key"), F.col("_r._n").alias("at"), F.col("_r._v").alias("v"))
    told = keep(checked_join(series, spots, ["key"], "inner", spots.count()).select("id", "key", "y", "x", "at", "v"))
    silent = spots.join(told.select("id"), "id", "left_anti").select("id", "key", "y", "x", F.array().cast("array<int>").alias("at"), F.array().cast("array<double>").alias("v"))
    held = told.unionByName(silent)
    home, visitors, lots, work = _meetings(held, max_km, SERIES_PER_LOT, 2)
    parts = int(max(1, min(4 * lots, 4000, work * (different + 500) / FLOPS_PER_TASK)))
    rows = home.unionByName(visitors).repartition(parts, "cy", "cx", "lot").sortWithinPartitions("cy", "cx", "lot", "role")
    chord = 2 * math.sin(min(math.pi, max_km / EARTH_RADIUS_KM) / 2) * (1 + 1e-9)
    kind = spots.schema["key"].dataType.simpleString()
    schema = f"key1 {kind}, key2 {kind}, y1 double, x1 double, y2 double, x2 double, n bigint, r double"
    met = rows.mapInArrow(partial(overlapping_pairs, times=different, chord=chord, minimum=minimum), schema)
    return _in_order(met, max_km, F.col("n").alias("paired_observations"), F.col("r").alias("pearson")).select(
        "sensor1", "sensor2", "distance_km", "paired_observations", "pearson")


def _correlated_by_rows(read: DataFrame, pairs: DataFrame, minimum: int) -> DataFrame:
    series = read.groupBy("_s", "_t").agg(F.avg("_v").alias("_v"))
    size = pairs.limit(BROADCAST_KEYS + 1).count()
    first = checked_join(series.select(F.col("_s").alias("sensor1"), "_t", F.col("_v").alias("_a")), pairs, ["sensor1"], "inner", size)
    second = series.select(F.col("_s").alias("sensor2"), "_t", F.col("_v").alias("_b"))
    paired = first.join(second, ["sensor2", "_t"])
    valid = (F.count("*") >= minimum) & (F.min("_a") < F.max("_a")) & (F.min("_b") < F.max("_b"))
    stats = paired.groupBy("sensor1", "sensor2").agg(F.count("*").alias("paired_observations"), F.when(valid, pearson("_a", "_b")).alias("pearson"))
    return pairs.join(stats, ["sensor1", "sensor2"], "left").withColumn("paired_observations", F.coalesce("paired_observations", F.lit(0).cast("long")))
