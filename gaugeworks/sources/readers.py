"""Loading files and database tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SUFFIXES = {"csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "pq": "parquet"}


def file_format(path: str, given: str | None = None) -> str:
    name = (given or path.rstrip("/").rsplit(".", 1)[-1]).lower().lstrip(".")
    if name not in SUFFIXES:
        raise ValueError(f"unsupported file format {name!r}; use one of {', '.join(sorted(SUFFIXES))}")
    return SUFFIXES[name]


def starts_with_array(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file, or the first data file of a folder, begins with ``[``. Only its leading bytes are read; a folder holds either
    JSON lines or one array per file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return False
    found = files.listFiles(place, True)
    while found.hasNext():
        file = found.next()
        if file.getLen() == 0 or file.getPath().getName()[0] in "._":
            continue
        stream = files.open(file.getPath())
        try:
            byte = stream.read()
            while byte >= 0 and chr(byte).isspace():
                byte = stream.read()
            return byte == ord("[")
        finally:
            stream.close()
    return False


def load_dataset(spark: SparkSession, path: str, format: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """CSV with header, JSON lines or JSON arrays of one file each, or Parquet. Give a schema for large inputs: inference reads them twice."""
    kind = file_format(path, format)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if kind == "json":
        return reader.option("multiLine", starts_with_array(spark, path)).json(path)
    return reader.parquet(path)


def load_enforced(spark: SparkSession, path: str, schema: StructType, format: str | None = None) -> DataFrame:
    """Read under a declared schema. A malformed record fails the job, and a CSV header must carry the declared names."""
    kind = file_format(path, format)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if kind == "csv":
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    if kind == "json":
        return reader.option("multiLine", starts_with_array(spark, path)).json(path)
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    wrong = [f.name for f in schema.fields if found.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"stored schema differs in {wrong}")
    return reader.parquet(path)


def jdbc_options(url: str, table: str, driver: str | None = None, split: tuple[str, int, int, int] | None = None,
                 fetch: int = 10_000, properties: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of a database read; ``split`` = (column, lower, upper, partitions) makes it parallel."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch), **(properties or {})}
    if driver:
        options["driver"] = driver
    if split:
        column, low, high, parts = split
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return options


def load_jdbc(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    """Database table; needs the driver's JAR on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table, as one job."""
    lines = [t.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, t in tables.items()]
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out


def catalog_counts(spark: SparkSession, database: str | None = None) -> DataFrame:
    names = [t.name for t in spark.catalog.listTables(database)]
    if not names:
        raise ValueError("no tables in the catalog")
    return table_counts({n: spark.table(f"{database}.{n}" if database else n) for n in names})
