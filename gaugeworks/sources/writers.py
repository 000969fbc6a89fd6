"""Writing tables and verifying what was written."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.operators.cleaning import digest_text
from gaugeworks.operators.contracts import Contract, contract_for, require


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, copies counted."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def write_verified(df: DataFrame, path: str) -> dict[str, str]:
    """Write Parquet to a new place, read it back and compare row count and content digest."""
    df.write.mode("errorifexists").parquet(path)
    before, after = digest_text(df), digest_text(df.sparkSession.read.parquet(path))
    if before != after:
        raise ValueError(f"the table read back differs: {after} instead of {before}")
    return {"path": path, "digest": after}


def write_overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_month(df: DataFrame, path: str, time: str, spread: int = 1, rows_per_file: int = 5_000_000) -> None:
    """Parquet partitioned by year and month. ``spread`` tasks share each month, so that a heavy month is not one task's work."""
    dated = df.withColumns({"year": F.year(time), "month": F.month(time)})
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
    dated.repartition("year", "month", salt).write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy("year", "month").parquet(path)


def export_text(df: DataFrame, path: str, format: str = "csv", rows_per_file: int = 5_000_000) -> int:
    """CSV or JSON lines as a folder of part files, whatever the size; returns the rows written, by reading them back."""
    writer = df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
    writer.option("header", True).csv(path) if format == "csv" else writer.json(path)
    back = df.sparkSession.read
    return (back.option("header", True).schema(df.schema).csv(path) if format == "csv" else back.schema(df.schema).json(path)).count()


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The stored table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


@dataclass(frozen=True)
class LoadResult:
    source_rows: int
    before_rows: int
    after_rows: int
    inserted_rows: int


def insert_new(df: DataFrame, path: str, dataset: str | Contract) -> LoadResult:
    """Append the contract's columns of rows whose key is not stored yet. Nothing passes through the driver.

    Stored keys are read alone (column pruning) and excluded with an anti join.
    """
    contract = contract_for(dataset)
    rows = require(df, contract).select(*contract.required)
    spark = df.sparkSession
    stored = read_or_empty(spark, path, rows.schema)
    source, before = rows.count(), stored.count()
    fresh = rows.dropDuplicates(list(contract.key)).join(stored.select(*contract.key), list(contract.key), "left_anti")
    fresh.write.mode("append").parquet(path)
    after = spark.read.schema(rows.schema).parquet(path).count()
    return LoadResult(source, before, after, after - before)


def delete_folders(spark: SparkSession, paths: Sequence[str]) -> None:
    """Remove whole run folders through the cluster's file system."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
