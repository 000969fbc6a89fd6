"""Registered queries: one Spark callable and, where SQL can say it, the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def reported(df: DataFrame, *near_zero: str) -> DataFrame:
    """Output form of a registered query.

    Fractional columns are reported in single precision, so that the order in which partial sums were merged does
    not show; columns named in ``near_zero`` (differences that cancel) are first rounded to six places. Whole
    numbers become long, dates and timestamps text.
    """
    out = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType.typeName()
        if field.name in near_zero:
            c = ((F.round(c.cast("double"), 6) + F.lit(0.0)).cast("float")).cast("double")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = c.cast("float").cast("double")
        elif kind in ("integer", "short", "byte", "long"):
            c = c.cast("long")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


def num(sql: str, name: str) -> str:
    """SQL twin of a fractional column in ``reported``."""
    return f"CAST(CAST({sql} AS FLOAT) AS DOUBLE) AS {name}"


def near(sql: str, name: str) -> str:
    return f"CAST(CAST(round({sql}, 6) + 0.0 AS FLOAT) AS DOUBLE) AS {name}"


def whole(sql: str, name: str) -> str:
    return f"CAST({sql} AS BIGINT) AS {name}"


def day(sql: str, name: str) -> str:
    return f"strftime({sql}, '%Y-%m-%d') AS {name}"


def moment(sql: str, name: str) -> str:
    return f"strftime({sql}, '%Y-%m-%d %H:%M:%S') AS {name}"


def nums(*names: str) -> str:
    """The named columns of a subquery, reported under their own names."""
    return ", ".join(num(n, n) for n in names)
