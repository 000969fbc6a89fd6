"""Values that come out differently each time they are worked out, as last digits of means may: ranks must still find them."""

import random

from pyspark.sql import functions as F

from gaugeworks.operators import statistics as S
from gaugeworks.operators.quantiles import average_rank, percent_rank


def unsteady(spark, n=60):
    shaken = F.udf(lambda v: v + random.random() * 1e-6, "double").asNondeterministic()
    d = spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") * 7 % n).cast("double").alias("y"))
    return d.select(shaken("x").alias("x"), shaken("y").alias("y"))


def test_rank_correlation_keeps_all_rows(spark):
    steady = S.rank_correlation(spark.range(60).select(F.col("id").cast("double").alias("x"), (F.col("id") * 7 % 60).cast("double").alias("y")), "x", "y")
    shaken = S.rank_correlation(unsteady(spark), "x", "y").first()
    assert shaken["observations"] == 60 and abs(shaken["spearman"] - steady.first()["spearman"]) < 1e-9


def test_every_row_gets_a_rank(spark):
    assert sorted(r["r"] for r in average_rank(unsteady(spark), "x", "r").collect()) == list(range(1, 61))
    assert percent_rank(unsteady(spark), "x", "p").filter("p IS NULL").count() == 0
