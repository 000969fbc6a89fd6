"""Mixing sources to target weights: capped water-filling over sources, seeded whole and fractional repetitions of documents.

Targets: every source asks for its weight's share of all words. Sources that ask for more than ``max_epochs`` times their
size are clamped there and what they leave is shared out again by weight, until no source is above. The loop runs on one row
per source and brings only three sums to the driver in each round.

Repetitions: a source with target t and size s takes every document floor(t / s) times. Of the rest, whole documents are taken
once more in a seeded order while they fit, and lastly the one document that brings the source nearest to its target.
The running sum along the seeded order is kept in two levels: sums of ``BLOCKS`` ranges of the seed per source first (a plain
grouped sum, whatever the source's size), and rows only inside the one range of a source in which the sum crosses its goal.

Defined cases: a null text has size 0; a null source is a source, the last one; a null doc_id is hashed as an empty text;
repeated rows are separate documents; a source of size 0 has target 0 and takes nothing; an empty table gives an empty result.
Documents of size 0 follow their place in the order and are never taken more often than ``max_epochs`` either. Other columns are ignored, or passed on by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, fresh, keep, parts_of, whole_text

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"
#: Ranges of the seeded order per source; a row-level running sum is taken in one of them only.
BLOCKS = 4096


def words(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place(seed: str) -> Column:
    """Seeded place of a document, 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8),
                  16, 10).cast("long")


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight``: weights repeat along the sources by code point, null last.

    Sources are dealt out by range and numbered from the row counts of the ranges before, so that no task holds them all.
    """
    part = F.spark_partition_id()
    ordered = keep(sizes.repartitionByRange(parts_of(sizes.sparkSession), F.col("source").asc_nulls_last())
                   .sortWithinPartitions(F.col("source").asc_nulls_last())
                   .select("*", part.alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = sorted((r.part, r.n, r.low) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low")).collect())
    before, starts = 0, []
    for p, n, low in counts:  # one entry per range
        starts += [F.lit(p), F.lit(before - low)]
        before += n
    number = F.col("at") + (F.create_map(*starts)[F.col("part")] if starts else F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights)).cast("int") + 1)
    return ordered.select("source", "source_size", weight.cast("long").alias("weight"))


def water_filled(weighted: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``weighted`` (source, source_size, weight) with ``target``, a double."""
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * max_epochs
    left, open_weight = total, None
    while True:
        # what open sources would get at the present level: weight * left / open_weight
        held = F.lit(False) if open_weight is None else cap * open_weight < F.col("weight") * left
        clamped, free = weighted.agg(F.sum(F.when(held, cap)), F.sum(F.when(~held, F.col("weight")))).first()
        now_left, now_free = total - (clamped or 0), free or 0
        if (now_left, now_free) == (left, open_weight):
            break
        left, open_weight = now_left, now_free
        if not now_free:
            break
    level = F.when(cap * (open_weight or 0) < F.col("weight") * left, cap.cast("double")).otherwise(
        (F.col("weight") * left).cast("double") / F.lit(float(open_weight or 1)))
    return weighted.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(level))


def repetitions(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """For every stored row of ``docs`` (row, doc_id, source, size): times it is taken, with the figures of its source.

    ``docs`` must be a stored table, since it is read several times.
    """
    docs = docs.withColumn("u", place(seed)).withColumn("block", F.shiftright(F.col("u"), 20).cast("int"))  # 2^32 / BLOCKS = 2^20
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = keep(water_filled(source_weights(sizes, weights), max_epochs).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"))
        .withColumn("goal", F.round("target").cast("long") - F.col("whole") * F.col("source_size")))  # words still to take

    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    blocks = docs.groupBy("source", "block").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("upto", F.sum("words").over(along))  # BLOCKS rows per source at most
    blocks = blocks.alias("d").join(targets.alias("t"), same).select(
        "d.source", "block", (F.col("upto") - F.col("words")).alias("before"), "upto", "source_size", "target", "whole", "goal")
    blocks = keep(blocks)

    here = F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.block") == F.col("t.block"))
    rows = docs.alias("d").join(blocks.alias("t"), here).select(
        "d.row", "d.doc_id", "d.source", "size", "u", "before", "upto", "source_size", "target", "whole", "goal", "d.block")
    inside = (F.col("before") < F.col("goal")) & (F.col("upto") > F.col("goal"))
    sure = rows.filter(~inside).withColumn("more", ((F.col("goal") > 0) & (F.col("upto") <= F.col("goal"))).cast("long"))
    order = Window.partitionBy("source", "block").orderBy("u", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = rows.filter(inside).withColumn("more", (F.col("before") + F.sum("size").over(order) <= F.col("goal")).cast("long"))
    columns = ["row", "doc_id", "source", "size", "u", "source_size", "target", "whole", "goal", "more"]
    marked = keep(sure.select(*columns).unionByName(split.select(*columns)))

    # the one document not taken yet that brings its source nearest to the goal
    short = marked.groupBy("source").agg((F.max("goal") - F.coalesce(F.sum(F.when(F.col("more") == 1, F.col("size"))), F.lit(0))).alias("short"))
    spare = marked.filter("more = 0").alias("d").join(short.alias("t"), same)
    miss = F.abs(F.col("short") - F.col("size"))
    last = (spare.groupBy("d.source").agg(F.min(F.when(miss < F.col("short"), F.struct(miss.alias("miss"), "u", "doc_id", "row"))).alias("best"))
            .select(F.col("best.row").alias("row"), F.lit(1).alias("extra")).filter("row IS NOT NULL"))
    chosen = marked.join(last, "row", "left")
    return chosen.select("row", "doc_id", "source", "size", "source_size", "target",
                         (F.col("whole") + F.col("more") + F.coalesce(F.col("extra"), F.lit(0))).alias("times"))


def sized(docs: DataFrame) -> DataFrame:
    """Stored row number, doc_id, source and size in words of every row."""
    return keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("source").cast("string").alias("source"), words().alias("size")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as many times as it is taken, with all their columns."""
    row, times = fresh(docs, "row_number"), fresh(docs, "times")
    stored = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    plain = keep(stored.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                               F.col("source").cast("string").alias("source"), words().alias("size")))
    taken = repetitions(plain, **options).filter("times > 0").select(F.col("row").alias(row), F.col("times").alias(times))
    copies = F.explode(F.sequence(F.lit(1), F.col(times))).alias(fresh(docs, "copy"))
    return stored.join(taken, row).select(*[F.col(f"`{c}`") for c in docs.columns], copies).drop(fresh(docs, "copy"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = repetitions(sized(documents(spark, sf_dir)))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
-- sources in the order in which a rising level reaches their caps; those before the first that stays below its cap are clamped
o AS (
  SELECT *, coalesce(sum(3 * source_size) OVER k, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER k, 0) AS open_w,
         sum(source_size) OVER () AS total
  FROM s WINDOW k AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT capped, open_w, total FROM o WHERE 3 * source_size * open_w >= w * (total - capped) ORDER BY capped LIMIT 1),
t AS (
  SELECT s.source, source_size,
         CASE WHEN source_size = 0 THEN 0.0
              WHEN 3 * source_size * open_w < w * (total - capped) THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(w * (total - capped) AS DOUBLE) / CAST(open_w AS DOUBLE) END AS target
  FROM s, f),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.source, size, u, source_size, target, whole, CAST(round(target) AS BIGINT) - whole * source_size AS goal,
         sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
-- a range of the seeded order is taken whole where it ends at or below the goal
m AS (SELECT *, CASE WHEN goal > 0 AND upto <= goal THEN 1 ELSE 0 END AS more FROM r),
h AS (SELECT source, max(goal) - coalesce(sum(CASE WHEN more = 1 THEN size END), 0) AS short FROM m GROUP BY source),
x AS (
  SELECT m.source, arg_min(doc_id, (abs(short - size), u, doc_id)) FILTER (WHERE abs(short - size) < short) AS pick
  FROM m JOIN h ON m.source IS NOT DISTINCT FROM h.source WHERE more = 0 GROUP BY m.source)
SELECT m.doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (whole + more + CASE WHEN doc_id = pick THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + more + CASE WHEN doc_id = pick THEN 1 ELSE 0 END AS BIGINT) AS times
FROM m LEFT JOIN x ON m.source IS NOT DISTINCT FROM x.source
"""
