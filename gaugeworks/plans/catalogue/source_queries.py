"""Round trips through the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from gaugeworks.plans import tables as T
from gaugeworks.plans.registry import num, query, reported
from gaugeworks.session import new_folder
from gaugeworks.sources import readers as R
from gaugeworks.sources import writers as W

SUMS = f"""SELECT event_type, count(*) AS rows, {num("sum(value)", "total")}, min(user_id) AS lowest, max(user_id) AS highest FROM events GROUP BY 1"""
SCHEMA = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("event_type", StringType()), StructField("value", DoubleType())])

#: Rows of one JSON array file, about; one task parses a file.
ARRAY_ROWS = 2000


def plain(spark, folder):
    return T.table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")


def summed(df):
    return reported(df.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("value").alias("total"), F.min("user_id").alias("lowest"), F.max("user_id").alias("highest")))


@query("load_csv", SUMS)
def load_csv(spark, folder):
    path = new_folder(spark, "csv")
    plain(spark, folder).write.option("header", True).csv(path)
    return summed(R.load_dataset(spark, path, "csv"))


@query("load_json_lines", SUMS)
def load_json_lines(spark, folder):
    path = new_folder(spark, "json")
    plain(spark, folder).write.json(path)
    return summed(R.load_dataset(spark, path, "json"))


@query("load_json_array", SUMS)
def load_json_array(spark, folder):
    """All events as files that each hold one JSON array, as web services export reports page by page; files are parsed side by side."""
    rows = plain(spark, folder)
    pages = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, -(-rows.count() // ARRAY_ROWS)))).alias("page")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    path = new_folder(spark, "array")
    pages.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return summed(R.load_dataset(spark, path, "json", rows.schema))


@query("load_parquet", SUMS)
def load_parquet(spark, folder):
    return summed(R.load_dataset(spark, f"{folder}/events.parquet"))


@query("load_schema_enforced", SUMS)
def load_schema_enforced(spark, folder):
    path = new_folder(spark, "csv")
    plain(spark, folder).write.option("header", True).csv(path)
    return summed(R.load_enforced(spark, path, SCHEMA, "csv"))


@query("write_verify", SUMS)
def write_verify(spark, folder):
    path = new_folder(spark, "parquet")
    W.write_verified(plain(spark, folder), path)
    return summed(spark.read.parquet(path))


@query("write_overwrite", SUMS)
def write_overwrite(spark, folder):
    """Sums and counts after a table was written over by the whole of its rows."""
    path, rows = new_folder(spark, "parquet"), plain(spark, folder)
    W.write_overwrite(rows.unionByName(rows), path)
    W.write_overwrite(rows, path)
    return summed(spark.read.parquet(path))


@query("multiset_difference", """WITH a AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE value < 100 GROUP BY 1, 2)
SELECT 'left' AS side, CAST(sum(greatest(a.n - coalesce(b.n, 0), 0)) AS BIGINT) AS rows FROM a LEFT JOIN b USING (event_type, user_id) HAVING rows > 0""")
def multiset_difference(spark, folder):
    e = plain(spark, folder)
    kept = e.filter("value < 100").select("event_type", "user_id")
    return reported(W.multiset_difference(e.select("event_type", "user_id"), kept).groupBy("side").agg(F.count("*").alias("rows")))


@query("partitioned_write", f"""SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS rows, {num("sum(o_totalprice)", "total")} FROM orders GROUP BY 1, 2""")
def partitioned_write(spark, folder):
    path = new_folder(spark, "monthly")
    W.write_by_month(T.table(spark, folder, "orders"), path, "o_orderdate", spread=2)
    return reported(spark.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("rows"), F.sum("o_totalprice").alias("total")))


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("events", "lineitem", "orders", "part", "customer", "supplier", "nation", "region")))
def table_counts(spark, folder):
    return reported(R.table_counts({t: T.table(spark, folder, t) for t in ("events", "lineitem", "orders", "part", "customer", "supplier", "nation", "region")}))


@query("time_range_rows", """SELECT event_id, user_id FROM events WHERE (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05') OR (ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21 12:00:00')""")
def time_range_rows(spark, folder):
    from gaugeworks.functions.calendar import time_range
    e = T.table(spark, folder, "events")
    return reported(e.filter(time_range("ts", ("2024-01-03", "2024-01-05"), ("2024-01-20", "2024-01-21 12:00:00"))).select("event_id", "user_id"))


@query("distinct_rows", """SELECT DISTINCT user_id, event_type FROM events""")
def distinct_rows(spark, folder):
    return reported(T.table(spark, folder, "events").select("user_id", "event_type").dropDuplicates())


@query("exported_report", """SELECT event_type, count(*) AS rows FROM events GROUP BY 1""")
def exported_report(spark, folder):
    path = new_folder(spark, "report")
    W.export_text(plain(spark, folder).groupBy("event_type").agg(F.count("*").alias("rows")), path, "json")
    return reported(spark.read.schema("event_type string, rows long").json(path))
