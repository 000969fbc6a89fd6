"""Exact order statistics and ranks that do not gather a group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.slices import null_safe_join, row_budget
from gaugeworks.session import keep

ACCURACY = 1_000
"""Accuracy of the sketches that bracket a rank. A task hands on about as many values for each group and column, whatever its rows, and
a bracket holds four in ACCURACY of a group; what is sorted out of it is exact either way."""


def _largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    got = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("k")).first()
    return int(got["n"] or 0), int(got["k"] or 0)


def rows_below(counted: DataFrame, keys: Sequence[str], value: str, weight: str, out: str, budget: int) -> DataFrame:
    """Add ``out``: the summed ``weight`` of smaller values in the group. ``counted`` has each value of a group once.

    While groups have at most ``budget`` values they are plain windows. Otherwise rows are dealt to parts of about half the budget by
    ranges of (keys, value), which the partitioner finds; each part sums on its own, and the sums of the parts before are added.
    """
    keys = list(keys)
    counted = keep(counted)
    rows, largest = 0, 0
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("rows")).first()
    if sizes["n"]:
        rows, largest = int(sizes["rows"]), int(sizes["n"])
    if largest <= budget:
        return counted.withColumn(out, F.sum(weight).over(Window.partitionBy(*keys).orderBy(value)) - F.col(weight))
    parts = max(2, -(-2 * rows // budget))
    # stored, since the ranges come from a sample and must not be drawn twice
    dealt = keep(counted.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(weight).alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_sum")
    sums = keep(sums.select(*keys, "_part", ahead.alias("_ahead")))  # a row per part and group in it
    inner = F.sum(weight).over(Window.partitionBy("_part", *keys).orderBy(value)) - F.col(weight)
    both = null_safe_join(dealt.withColumn("_inner", inner), sums, [*keys, "_part"], "inner", sums.count())
    return both.withColumn(out, F.col("_ahead") + F.col("_inner")).drop("_part", "_ahead", "_inner")


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, float]], rule: str = "linear",
                    budget: int | None = None) -> DataFrame:
    """One row per group with the named quantiles; ``columns`` maps an output name to (input column, probability).

    ``linear`` interpolates between neighbours; ``higher`` takes the next observed value. NULLs are ignored.
    A NULL key is a group like any other. Groups within the budget use the built-in exact percentile. Above it, a mergeable
    sketch brackets each wanted rank, rows below the bracket are only counted, and just the values inside it are ordered, in
    parts if they are more than the budget. The answer is exact.
    """
    keys = list(keys)
    budget = row_budget(df, budget)
    by_column: dict[str, list[float]] = {}
    for c, p in columns.values():
        by_column.setdefault(c, [])
        if p not in by_column[c]:
            by_column[c].append(p)
    largest, groups = _largest_group(df, keys)
    if largest * len(by_column) <= budget and rule == "linear":
        # one pass over a column's values serves all of its probabilities
        found = df.groupBy(*keys).agg(*[F.percentile(F.col(f"`{c}`").cast("double"), ps).alias(f"_p_{i}") for i, (c, ps) in enumerate(by_column.items())])
        at = {c: i for i, c in enumerate(by_column)}
        return found.select(*keys, *[F.col(f"_p_{at[c]}")[by_column[c].index(p)].alias(n) for n, (c, p) in columns.items()])
    return _bracketed_quantiles(df, keys, columns, rule, groups, budget)


def _bracketed_quantiles(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, float]], rule: str, groups: int, budget: int) -> DataFrame:
    marker = keys or ["_all"]
    wanted = list(columns.values())
    names = {c: f"_x{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in wanted))}
    rows = (df if keys else df.withColumn("_all", F.lit(1))).select(*marker, *[F.col(f"`{c}`").cast("double").alias(x) for c, x in names.items()])

    # A sketch over n rows is off by at most n/accuracy ranks, so twice that on both sides holds the wanted rank.
    margin = 2.0 / ACCURACY
    points = {x: sorted({q for c, p in wanted if names[c] == x for q in (max(0.0, p - margin), min(1.0, p + margin))}) for x in names.values()}
    spans = rows.groupBy(*marker).agg(*[e for x in names.values() for e in (
        F.count(x).alias(f"_n{x}"), F.min(x).alias(f"_min{x}"), F.max(x).alias(f"_max{x}"), F.percentile_approx(x, points[x], ACCURACY).alias(f"_s{x}"))])
    edges = {}
    for i, (c, p) in enumerate(wanted):
        x = names[c]
        # Small groups (and the ends) take the full range: rank rounding could step outside a narrow bracket.
        wide = F.col(f"_n{x}") <= ACCURACY
        low, high = (F.col(f"_s{x}")[points[x].index(q)] for q in (max(0.0, p - margin), min(1.0, p + margin)))
        edges[f"_a{i}"] = F.when(wide | F.lit(p - margin <= 0), F.col(f"_min{x}")).otherwise(low)
        edges[f"_z{i}"] = F.when(wide | F.lit(p + margin >= 1), F.col(f"_max{x}")).otherwise(high)
        edges[f"_n{i}"] = F.col(f"_n{x}")
    spans = spans.select(*marker, *[e.alias(n) for n, e in edges.items()])
    spans = keep(spans)
    joined = null_safe_join(rows, spans, marker, "inner", groups)

    def value(i: int):
        return F.col(names[wanted[i][0]])

    below = joined.groupBy(*marker).agg(*[e for i in range(len(wanted)) for e in (
        F.count(F.when(value(i) < F.col(f"_a{i}"), 1)).alias(f"_b{i}"), F.first(f"_n{i}").alias(f"_n{i}"))])
    # a bracket of one value needs no rows, and few rows lie in any of the others: the rest go before anything is built of them
    inside = [(F.col(f"_a{i}") < F.col(f"_z{i}")) & value(i).between(F.col(f"_a{i}"), F.col(f"_z{i}")) for i in range(len(wanted))]
    held = joined.filter(reduce(lambda a, b: a | b, inside))
    hits = F.array(*[F.when(hit, F.struct(F.lit(i).alias("i"), value(i).alias("v"))) for i, hit in enumerate(inside)])
    counted = (held.select(*marker, F.explode(hits).alias("_h")).filter("_h IS NOT NULL").select(*marker, F.col("_h.i").alias("_i"), F.col("_h.v").alias("_v"))
               .groupBy(*marker, "_i", "_v").agg(F.count("*").alias("_c")))
    ranks = below.select(*marker, F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_b{i}").alias("_below"), F.lit(float(p)).alias("_p"),
                         F.col(f"_n{i}").alias("_n")) for i, (_, p) in enumerate(wanted)])).alias("_r")).select(*marker, "_r.*")
    place = F.col("_p") * (F.col("_n") - 1)
    ordered = rows_below(counted, [*marker, "_i"], "_v", "_c", "_less", budget)
    upto = F.col("_less") + F.col("_c") + F.col("_below")
    ranked = null_safe_join(ordered, ranks, [*marker, "_i"], "inner", groups * len(wanted)).withColumns({"_upto": upto, "_place": place})
    first = F.floor("_place") if rule == "linear" else F.ceil("_place")
    picked = ranked.groupBy(*marker, "_i").agg(
        F.min(F.when(F.col("_upto") > first, F.col("_v"))).alias("_lo"), F.min(F.when(F.col("_upto") > F.ceil("_place"), F.col("_v"))).alias("_hi"),
        F.max(F.col("_place") - F.floor("_place")).alias("_part"))
    picked = picked.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part") if rule == "linear" else F.col("_lo"))
    wide_out = picked.groupBy(*marker).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(columns)])
    out = null_safe_join(spans, wide_out, marker, "left", groups).select(*marker, *[
        F.when(F.col(f"_a{i}") == F.col(f"_z{i}"), F.col(f"_a{i}") + 0.0).otherwise(F.col(f"`{n}`")).alias(n) for i, n in enumerate(columns)])
    return out if keys else out.drop("_all")


def quantile_values(df: DataFrame, columns: dict[str, tuple[str, float]], rule: str = "linear", budget: int | None = None) -> dict:
    """Whole-table quantiles as plain numbers, used to parametrise a later plan."""
    return exact_quantiles(df, [], columns, rule, budget).first().asDict()


def value_ranks(df: DataFrame, value: str, budget: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Each distinct non-NULL value (per group) with ``copies``, ``below`` (rows smaller) and ``average_rank``.

    Copies are counted before anything is ordered. If more distinct values remain than one task should order, they are
    dealt out by ranges (``rows_below``). A NULL in ``by`` is a group like any other.
    """
    by, budget = list(by), row_budget(df, budget)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("copies"))
    ranked = rows_below(counted, by, value, "copies", "below", budget)
    return ranked.withColumn("average_rank", F.col("below") + (F.col("copies") + 1) / 2)


def average_rank(df: DataFrame, value: str, out: str, budget: int | None = None) -> DataFrame:
    """Add the average-tie rank of a column (NULL for NULL)."""
    df = keep(df)  # joined back by value, which must not be worked out twice
    ranks = value_ranks(df, value, budget).select(value, F.col("average_rank").alias(out))
    return df.join(ranks, value, "left")


def percent_rank(df: DataFrame, value: str, out: str, budget: int | None = None) -> DataFrame:
    """Average-tie rank over the number of non-NULL rows."""
    df = keep(df)  # joined back by value, which must not be worked out twice
    ranks = value_ranks(df, value, budget)
    total = ranks.agg(F.sum("copies")).first()[0] or 1
    return df.join(ranks.select(value, (F.col("average_rank") / F.lit(total)).alias(out)), value, "left")


def numbered(df: DataFrame, order: Sequence[str], out: str, budget: int | None = None) -> DataFrame:
    """Global 1-based row number by ``order`` without sorting everything in one task.

    The leading column is ranked by distinct value; rows then only compete with rows of the same leading value. Where
    the next column is text, its first two characters split even those, so that a leading value shared by a large part
    of the rows is numbered by many tasks. Rows without a leading value come first, as in any ascending order.
    """
    lead, *rest = order
    without = df.filter(F.col(lead).isNull()).count()
    ranks = value_ranks(df, lead, budget).select(F.col(lead).alias("_lead"), (F.col("below") + without).alias("below"))
    text = bool(rest) and df.schema[rest[0]].dataType.typeName() == "string"
    cut = df.withColumn("_head", F.coalesce(F.substring(rest[0], 1, 2), F.lit("")) if text else F.lit(""))
    counts = cut.groupBy(F.col(lead).alias("_of"), F.col("_head").alias("_with")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_ahead", F.sum("_c").over(Window.partitionBy("_of").orderBy("_with")) - F.col("_c")).drop("_c")
    inner = F.row_number().over(Window.partitionBy(lead, "_head").orderBy(*(rest or [lead])))
    same = F.col(lead).eqNullSafe(F.col("_of")) & (F.col("_head") == F.col("_with"))
    return (cut.withColumn("_inner", inner).join(counts, same).join(ranks, F.col(lead) == F.col("_lead"), "left")
            .withColumn(out, F.coalesce("below", F.lit(0)) + F.col("_ahead") + F.col("_inner"))
            .drop("_head", "_inner", "_ahead", "below", "_of", "_with", "_lead"))
