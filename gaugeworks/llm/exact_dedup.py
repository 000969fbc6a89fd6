"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a table bucketed and sorted by digest. A batch of documents is digested once, reduced to one row per digest
(with a partial aggregate before the shuffle, so that a hot text costs no more than any other), held against the index by a
sort-merge anti-join, and what is new is appended. The index side is never shuffled again.

Each digest carries the id of the batch that brought it. A caller who names the batch can repeat a call that was stopped anywhere:
what an append of the same batch brought before counts as this batch's own.

Defined cases: a null text counts as empty; texts are equal when they are the same after removal of blanks; of equal texts
the one with the most code points, then the smallest doc_id (null first) stays; of repeated rows one stays; an empty table
gives an empty verdict and leaves the index as it is; other columns of the documents are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import BLANK, documents, fresh, keep, parts_of, whole_text
from gaugeworks.session import new_folder

#: Of n rows at most this many groups can each hold more than n / HOT_GROUPS; those few are joined by broadcast.
HOT_GROUPS = 1000

SCHEMA = "text_sha256 string, keep_id bigint, keep_row bigint, batch string"


def normal_digest(column: str = "text"):
    """SHA-256 of the text without its blanks."""
    return F.sha2(F.translate(whole_text(column), BLANK, ""), 256)


class DigestIndex:
    """Digests seen so far, as a bucketed and sorted table in the catalog with its files in ``path``."""

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int | None = None):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets or parts_of(spark)
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        # dealt out as the buckets are, so that each task writes one sorted file of one bucket
        (rows.repartition(self.buckets, "text_sha256").write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.table))

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def admit(self, digested: DataFrame, batch: str | None = None) -> tuple[str, DataFrame]:
        """Add the digests that are new. ``digested`` (row, doc_id, n_points, text_sha256) must be a stored table.

        Returns the batch id under which new digests were appended and the batch's groups, stored: text_sha256, first (the row
        that would stay) and group_size. A call with a ``batch`` that was appended before, in whole or in part, adds what is missing.
        """
        batch = batch or uuid.uuid4().hex
        first = F.min(F.struct((-F.col("n_points")).alias("n"), "doc_id", "row")).alias("first")
        groups = keep(digested.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size")))  # stored, else the anti-join is moved below the aggregate
        unseen = groups.hint("merge").join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        self._append(unseen.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"),
                                   F.lit(batch).alias("batch")))
        return batch, groups


def digest_rows(docs: DataFrame) -> DataFrame:
    """One stored row per row of ``docs``: row (a number), doc_id, n_points (code points), text_sha256."""
    return keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                            F.length(whole_text()).alias("n_points"), normal_digest().alias("text_sha256")))


def verdicts(digested: DataFrame, index: DigestIndex, batch: str, groups: DataFrame) -> DataFrame:
    """row, doc_id, keep_id, group_size (rows of this batch with the text), kept and text_sha256 for every row."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") > max(total // HOT_GROUPS, 1)
    sizes = groups.select("text_sha256", "group_size", F.col("first.row").alias("first_row"))
    known = index.read()

    def judged(rows: DataFrame, some: DataFrame) -> DataFrame:
        return rows.join(some, "text_sha256").select(
            "row", "doc_id", "keep_id", "group_size",
            ((F.col("batch") == batch) & (F.col("row") == F.col("first_row"))).alias("kept"), "text_sha256")

    often = F.broadcast(sizes.filter(is_hot).join(known, "text_sha256"))  # at most HOT_GROUPS rows
    rest = digested.join(F.broadcast(sizes.filter(is_hot).select("text_sha256")), "text_sha256", "left_anti")
    seldom = sizes.filter(~is_hot).join(known.hint("merge"), "text_sha256")
    return judged(digested, often).unionByName(judged(rest, seldom))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Verdict on every row of ``docs``; texts that the index did not hold are added to it."""
    digested = digest_rows(docs)
    return verdicts(digested, index, *index.admit(digested, batch))


def own_index(spark: SparkSession) -> DigestIndex:
    """A new, empty index in the shared folder."""
    return DigestIndex(spark, f"digests_{uuid.uuid4().hex}", new_folder(spark, "digests"))


def keep_first_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = fresh(docs, "row_number")
    stored = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    digested = keep(stored.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                                  F.length(whole_text()).alias("n_points"), normal_digest().alias("text_sha256")))
    batch, groups = index.admit(digested, batch)
    own = index.read().filter(F.col("batch") == batch).select("text_sha256")
    staying = groups.hint("merge").join(own.hint("merge"), "text_sha256", "left_semi").select(F.col("first.row").alias(row))
    return stored.join(staying, row, "left_semi").drop(row)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), own_index(spark)).drop("row")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
g AS (SELECT h, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


def dedup_in_batches(docs: DataFrame, index: DigestIndex, batch_of: Column, batches: int) -> DataFrame:
    """Verdicts, with the number of the batch, on ``docs`` that arrive one batch after the other; later ones meet the digests of earlier ones.

    ``batch_of`` gives the batch of a row (0 to ``batches`` - 1) from its doc_id. The documents are read once.
    """
    digested = digest_rows(docs)
    parts = []
    for i in range(batches):
        own = digested.filter(batch_of == i)
        parts.append(verdicts(own, index, *index.admit(own)).withColumn("batch", F.lit(i).cast("long")))
    return reduce(DataFrame.unionByName, parts)


def exact_dedup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in three batches by doc_id, against one index that lasts from batch to batch."""
    batch_of = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))
    return dedup_in_batches(documents(spark, sf_dir), own_index(spark), batch_of, 3).drop("row")


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id, 0) % 3 AS batch, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT h, batch, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS first_id FROM d GROUP BY h, batch),
f AS (SELECT h, min(batch) AS first_batch, arg_min(first_id, batch) AS keep_id FROM g GROUP BY h)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, keep_id, group_size, batch = first_batch AND doc_id = keep_id AS kept, h AS text_sha256
FROM d JOIN g USING (h, batch) JOIN f USING (h)
"""
