"""What the training-data operators share: reading, column names, batches and folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import forget, keep

__all__ = ["BLANK", "documents", "embeddings", "fresh", "fold_of", "forget", "keep", "parts_of", "rows_per_task", "texts", "whole_text"]

#: Characters that separate words: [\x20\x09-\x0D]. Fixed value.
BLANK = " \t\n\x0b\x0c\r"
#: Bytes of text that one Arrow batch brings to a Python worker, so that a run of very long texts stays in memory.
BATCH_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id and the whole text as UTF-8 bytes (null: empty), ready for Arrow batches of bounded size.

    No other column of ``docs`` gets through, so extra columns cannot clash with those of an operator.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if docs.sparkSession.conf.get(name, None) in (None, "-1", str((1 << 63) - 1), str((1 << 31) - 1)):
        docs.sparkSession.conf.set(name, str(BATCH_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"), *more)


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the column's text form, modulo ``folds``; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_per_task(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of Arrow batches as plain Python tuples."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
