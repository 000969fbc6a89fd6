import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from gaugeworks.operators.quantiles import average_rank, exact_quantiles, numbered, percent_rank, quantile_values, rows_below, value_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """A large group with a third of its rows equal, and small ones."""
    rng = random.Random(3)
    data = [("big", 5.0 if rng.random() < .34 else rng.gauss(0, 10)) for _ in range(25_000)] + [("small", float(i)) for i in range(7)] + [("one", 3.0), ("none", None)]
    return spark.createDataFrame(data, "g string, x double").repartition(6).cache(), data


PROBS = (0.0, .05, .1, .25, .5, .75, .9, .975, 1.0)


@pytest.mark.parametrize("rule, method", [("linear", "linear"), ("higher", "higher")])
def test_bracketed_quantiles_are_exact(skewed, rule, method):
    df, data = skewed
    got = {r["g"]: r.asDict() for r in exact_quantiles(df, ["g"], {f"q{i}": ("x", p) for i, p in enumerate(PROBS)}, rule, budget=10).collect()}
    for g in ("big", "small", "one"):
        want = np.quantile([x for k, x in data if k == g], PROBS, method=method)
        assert np.allclose([got[g][f"q{i}"] for i in range(len(PROBS))], want, rtol=1e-12)
    assert got["none"]["q4"] is None


def test_plain_and_bracketed_agree_over_the_whole_table(skewed):
    df, _ = skewed
    cols = {"a": ("x", .25), "b": ("x", .99)}
    assert quantile_values(df, cols) == pytest.approx(quantile_values(df, cols, budget=100))


def test_ranks_with_ties(skewed, spark):
    df, data = skewed
    xs = sorted(x for _, x in data if x is not None)
    for budget in (None, 500):
        got = {r[0]: (r[1], r[2], r[3]) for r in value_ranks(df, "x", budget).select("x", "copies", "below", "average_rank").collect()}
        assert sum(c for c, _, _ in got.values()) == len(xs)
        fives = [i for i, x in enumerate(xs, 1) if x == 5.0]
        assert got[5.0] == (len(fives), fives[0] - 1, sum(fives) / len(fives))
    tiny = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double")
    assert rows(percent_rank(tiny, "x", "p")) == [(1.0, pytest.approx(1 / 3)), (2.0, pytest.approx(2.5 / 3)), (2.0, pytest.approx(2.5 / 3)), (None, None)]
    assert rows(average_rank(tiny, "x", "r")) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (None, None)]


def test_grouped_ranks_split(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 997).cast("double").alias("x"))
    plain, cut = (rows(value_ranks(df, "x", b, ["g"])) for b in (None, 50))
    assert plain == cut


def test_global_numbers(spark):
    df = spark.range(500).select((F.col("id") % 90).alias("t"), F.col("id"))
    got = rows(numbered(df, ["t", "id"], "n", budget=20), "n", "t", "id")
    want = sorted(((i % 90, i) for i in range(500)))
    assert sorted(got) == [(n, t, i) for n, (t, i) in enumerate(want, 1)]
    assert math.isclose(sum(r[0] for r in got), 500 * 501 / 2)
    # one leading value for a third of the rows, ordered further by text
    text = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("t"), F.md5(F.col("id").cast("string")).alias("name"))
    numbers = rows(numbered(text, ["t", "name"], "n"), "n", "t", "name")
    assert [r[1:] for r in sorted(numbers)] == sorted(r[1:] for r in numbers) and sorted(r[0] for r in numbers) == list(range(1, 301))


def test_a_shared_folder_is_asked_for_off_local_masters(spark, monkeypatch):
    from types import SimpleNamespace

    from gaugeworks import session
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(away)
    assert [session.is_single_process(m) for m in ("local", "local[*]", "local[8]", "local-cluster[2,1,1024]", "yarn", "k8s://x")] == [True] * 3 + [False] * 3
    one, two = session.keep(spark.range(5)), session.keep(spark.range(6))
    session.forget(one)
    assert two.count() == 6
    with pytest.raises(Exception):
        spark.read.parquet(one.kept_in).count()


def test_rows_without_a_leading_value_are_numbered_first(spark):
    df = spark.createDataFrame([(3, "a"), (None, "b"), (1, "c"), (None, "a"), (1, "b")], "lead int, name string")
    from gaugeworks.operators.quantiles import numbered
    got = [(r["lead"], r["name"]) for r in numbered(df, ["lead", "name"], "n", 1).orderBy("n").collect()]
    assert got == [(None, "a"), (None, "b"), (1, "b"), (1, "c"), (3, "a")]


def test_null_groups_and_crowded_brackets(spark):
    """A NULL group keeps its quantiles and ranks, and a bracket above the budget is ordered in parts."""
    rng = random.Random(8)
    data = [(None, rng.gauss(0, 5)) for _ in range(30_000)] + [("a", float(i % 50)) for i in range(400)] + [("b", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], {"p50": ("x", .5), "p90": ("x", .9)}, budget=3).collect()}
    for g in (None, "a"):
        assert np.allclose([got[g]["p50"], got[g]["p90"]], np.quantile([x for k, x in data if k == g], [.5, .9]), rtol=1e-12)
    assert got["b"]["p90"] is None and got.keys() == {None, "a", "b"}
    assert rows(exact_quantiles(df, ["g"], {"p90": ("x", .9)})) == rows(exact_quantiles(df, ["g"], {"p90": ("x", .9)}, budget=3))
    assert rows(value_ranks(df, "x", None, ["g"])) == rows(value_ranks(df, "x", 700, ["g"]))
    assert rows(value_ranks(df, "x")) == rows(value_ranks(df, "x", 700))


def test_no_task_orders_more_than_the_budget(spark):
    """Of an unkeyed table 100 times the budget, no part that is windowed holds more rows than the budget."""
    counted = spark.range(40_000).select((F.col("id") * 7919 % 40_009).cast("double").alias("v"), F.lit(1).cast("long").alias("c"))
    parts = counted.repartitionByRange(200, "v").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert parts <= 400
    out = rows_below(counted, [], "v", "c", "less", 400)
    assert out.agg(F.sum("less")).first()[0] == 40_000 * 39_999 // 2
    assert out.filter("less = 0").first()["v"] == counted.agg(F.min("v")).first()[0]
