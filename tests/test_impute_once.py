"""Imputation works its flags out once for the medians, however often those go through them."""

from pyspark.sql import functions as F

from gaugeworks.operators import outliers as O


def test_flags_are_worked_out_once_for_medians(spark):
    calls = spark.sparkContext.accumulator(0)

    def mark(v):
        calls.add(1)
        return v > 900

    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    df = df.withColumn("x_outlier_iqr", F.udf(mark, "boolean").asNondeterministic()("x"))
    out = O.treat(df, "impute", budget=100)
    assert calls.value == 1000
    assert out.filter("x_imputed = 450").count() == 100  # 99 flagged readings, and 450 itself
