"""Normalise, quarantine with reasons, and account for every input row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import finite, row_fingerprint
from gaugeworks.operators.contracts import Contract, contract_for, numeric_columns, outside, structure_issues, text_columns
from gaugeworks.session import keep

EXPAND_CHUNK = 100_000


def normalize(df: DataFrame, dataset: str | Contract) -> DataFrame:
    """Trimmed text, blank and non-finite as NULL, lower-case categories, parsed time, plus the raw row's hash."""
    contract = contract_for(dataset)
    issues = structure_issues(df, contract)
    if issues["missing_columns"]:
        raise ValueError(f"{contract.name}: missing columns {sorted(issues['missing_columns'])}; schema repair required")
    if issues["non_numeric_columns"]:
        raise ValueError(f"{contract.name}: review nonnumeric columns {issues['non_numeric_columns']}; no silent coercion")
    trimmed = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in text_columns(df)}
    cleaned = {**trimmed, **{c: finite(c) for c in numeric_columns(df)}}
    for c in contract.allowed:
        cleaned[c] = F.lower(cleaned.get(c, F.col(c)))
    if "timestamp" in contract.required:
        cleaned["timestamp"] = F.try_to_timestamp(cleaned.get("timestamp", F.col("timestamp")).cast("string"))
    return df.select(*[cleaned.get(c, F.col(c)).alias(c) for c in df.columns], row_fingerprint(df.columns).alias("_raw_hash"))


def rejection_reasons(contract: Contract):
    """All reasons of a row joined by ';', empty for an eligible row."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in contract.required]
    reasons += [F.when(outside(c, b), F.lit(f"range:{c}")) for c, b in contract.bounds.items()]
    reasons += [F.when(~F.col(c).isin(*v), F.lit(f"category:{c}")) for c, v in contract.allowed.items()]
    reasons += [F.when(F.col(a) > F.col(b), F.lit(name)) for name, (a, b) in contract.ordered.items()]
    return F.concat_ws(";", *reasons)


def clean(df: DataFrame, dataset: str | Contract, materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined rows with ``_reasons``, ``_raw_hash`` and ``_copies``.

    Identical raw rows are folded into one line with a count before anything is compared, so a row that makes up a
    third of the table costs one line per map task. Accepted rows plus the sum of ``_copies`` equal the input rows;
    ``expand_copies`` writes the folded lines out again. The folded rows feed five branches, so they are written
    once to the checkpoint folder unless ``materialize`` is off.
    """
    contract = contract_for(dataset)
    columns = df.columns
    rows = normalize(df, contract).withColumn("_reasons", rejection_reasons(contract))
    folded = rows.groupBy(*columns, "_raw_hash", "_reasons").agg(F.count("*").alias("_copies"))
    folded = folded.withColumn("_content", F.when(F.col("_reasons") == "", row_fingerprint(columns)))
    folded = keep(folded) if materialize else folded
    invalid = folded.filter(F.col("_reasons") != "")
    eligible = folded.filter(F.col("_reasons") == "")

    # one survivor per content: the smallest raw hash
    survivors = eligible.groupBy("_content").agg(F.min("_raw_hash").alias("_kept"))
    marked = eligible.join(survivors, "_content").withColumn("_first", F.col("_raw_hash") == F.col("_kept"))
    extra = F.col("_copies") - F.col("_first").cast("long")
    duplicates = marked.withColumn("_copies", extra).filter(F.col("_copies") > 0).withColumn("_reasons", F.lit("exact_duplicate"))

    distinct = marked.filter(F.col("_first"))
    clashes = distinct.groupBy(*contract.key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    compared = distinct.join(clashes, list(contract.key), "left")
    conflicts = compared.filter(F.col("_n").isNotNull()).withColumns({"_reasons": F.lit("conflicting_primary_key"), "_copies": F.lit(1).cast("long")})
    accepted = compared.filter(F.col("_n").isNull()).select(*columns)
    quarantine_columns = [*columns, "_raw_hash", "_reasons", "_copies"]
    quarantine = (invalid.select(*quarantine_columns).unionByName(duplicates.select(*quarantine_columns))
                  .unionByName(conflicts.select(*quarantine_columns)))
    return accepted, quarantine


def expand_copies(quarantine: DataFrame) -> DataFrame:
    """One row per quarantined input row. Large counts are cut into chunks that are spread before they are written out."""
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / EXPAND_CHUNK))
    cut = quarantine.withColumn("_chunk", F.explode(chunks))
    cut = cut.withColumn("_size", F.least(F.lit(EXPAND_CHUNK).cast("long"), F.col("_copies") - F.col("_chunk") * EXPAND_CHUNK))
    spread = cut.repartition(F.xxhash64("_raw_hash", "_chunk"))
    return spread.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size")))).drop("_i", "_size", "_chunk", "_copies")


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("_reasons").agg(F.sum("_copies").alias("rows"))


def account(source: DataFrame, accepted: DataFrame, quarantine: DataFrame) -> dict[str, int]:
    """Row accounting; raises if a row was lost or made up."""
    n, a = source.count(), accepted.count()
    q = quarantine.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    if n != a + q:
        raise ValueError(f"{n} input rows, but {a} accepted and {q} quarantined")
    return {"source": n, "accepted": a, "quarantined": q}


def digest_columns(columns) -> list:
    """Aggregates of an order-free content digest: row count, xor and sum over 60 bits of each row's sha-256."""
    bits = F.conv(F.substring(row_fingerprint(columns), 1, 15), 16, 10).cast("long")
    return [F.count("*").alias("rows"), F.coalesce(F.bit_xor(bits), F.lit(0).cast("long")).alias("xor_bits"),
            F.coalesce(F.sum(bits.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("sum_bits")]


def table_digest(df: DataFrame) -> DataFrame:
    return df.agg(*digest_columns(df.columns))


def digest_of(row) -> str:
    return f"{row['rows']}:{row['xor_bits']}:{row['sum_bits']}"


def digest_text(df: DataFrame) -> str:
    return digest_of(table_digest(df).first())
