"""What daily facts shuffle, and sums of readings at the edges of the size classes."""

import datetime as dt
import math
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from gaugeworks.operators.facts import daily_facts


def test_sums_are_shuffled_without_sensors(spark):
    rows = spark.range(500).select((F.col("id") % 97).alias("s"), F.timestamp_seconds(F.col("id") * 9000).alias("timestamp"), F.col("id").cast("double").alias("x"), F.lit(0.5).alias("y"))
    plan = daily_facts(rows, "energy", "s", ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys and not [k for k in keys if "metric" in k and "_sensor" in k]


def test_edges_of_classes(spark):
    rng = random.Random(8)
    values = [s * v for e in (1e-3, 1e7) for v in (e, math.nextafter(e, 0), math.nextafter(e, 1e9)) for s in (1, -1)] + [0.0, 1 / 3, 1e20, 2.5e-300]
    values += [rng.choice((1, -1)) * rng.random() * 10 ** rng.randint(-6, 9) for _ in range(300)]
    df = spark.createDataFrame([(i % 5, dt.datetime(2030, 1, 1), v) for i, v in enumerate(values)], "s int, timestamp timestamp, x double")
    got = daily_facts(df, "energy", "s", ["x"]).first()
    assert (got["observations"], got["sensors"], got["minimum"], got["maximum"]) == (len(values), 5, min(values), max(values))
    assert math.isclose(got["mean"], float(sum(map(Fraction, values)) / len(values)), rel_tol=1e-15)
