"""Slices at the same cost for any number of cuts, and brackets in which all rows are equal."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from gaugeworks.operators import quantiles as Q
from gaugeworks.operators import slices as SL


def test_slices_of_many_cuts(spark):
    rng = random.Random(2)
    data = [(rng.choice((None, "a", "b")), rng.choice((None, *range(400))), i, float(i)) for i in range(3000)] + [("c", i, i, 1.0) for i in range(5)]
    df = spark.createDataFrame(data, "k string, t long, id long, v double").withColumn("time", F.timestamp_seconds("t"))
    s = SL.slice_series(df, ["k"], "time", 10)
    assert not [n for n in s.frame._jdf.queryExecution().analyzed().toString().split() if "_cuts" in n]
    got = s.frame.groupBy("k", "_slice").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z"), F.count("t").alias("timed")).collect()
    for k in ("a", "b"):
        mine = sorted((r for r in got if r["k"] == k and r["_slice"] >= 0), key=lambda r: r["_slice"])
        assert len(mine) > 40 and all(a["z"] < b["a"] for a, b in zip(mine, mine[1:])) and max(r["n"] for r in mine) < 30  # noqa: B905
        assert [r["timed"] for r in got if r["k"] == k and r["_slice"] == SL.TIMELESS] == [0]
    assert [(r["_slice"], r["n"]) for r in got if r["k"] == "c"] == [(SL.SMALL, 5)]
    assert {r["_slice"] for r in got if r["k"] is None} == {SL.SMALL}
    frame = Window.partitionBy("k").orderBy("time", "id").rowsBetween(-3, 2)
    h = SL.with_halo(df, ["k"], ["time", "id"], 3, 2, 10)
    own = h.own(h.frame.withColumn("m", F.avg("v").over(h.window("time", "id").rowsBetween(-3, 2))))
    assert rows(own, "id", "m") == rows(df.withColumn("m", F.avg("v").over(frame)), "id", "m")


def test_brackets_of_one_value_hand_on_no_rows(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.lit(-0.0).alias("same"), (F.col("id") * 37 % 5000).cast("double").alias("x"))
    ordered = []
    real = Q.rows_below
    monkeypatch.setattr(Q, "rows_below", lambda counted, keys, value, weight, out, budget: ordered.append(counted.agg(F.count("*"), F.sum(weight)).first()) or real(counted, keys, value, weight, out, budget))
    wanted = {f"{c}_{p}": (c, p) for c in ("same", "x") for p in (.1, .5, .9)}
    cut, plain = (rows(Q.exact_quantiles(df, ["k"], wanted, budget=b)) for b in (100, None))
    assert [list(r) for r in cut] == [pytest.approx(list(r)) for r in plain]
    assert ordered[0][1] < 500  # of 30000 values
