"""Power spectrum of one evenly spaced series of any length, as two rounds of short transforms over Spark groups.

A transform of n points is a convolution with a chirp, so it can be carried out at a power of two M >= 2n - 1. M = R x C
points are a table of R rows and C columns: every column is transformed by itself, turned by a phase, and every row is
transformed by itself. A row then holds all it takes to multiply with the chirp's transform and to start the way back, which ends
with the columns. Groups have about sqrt(M) points, whatever the length of the series, and the work is n log n.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_for(n: int) -> tuple[int, int]:
    """Rows and columns, both powers of two, with at least 2n - 1 cells."""
    bits = max(0, (2 * n - 2)).bit_length()
    return 1 << bits // 2, 1 << bits - bits // 2


def _turn(product: np.ndarray, whole: int, sign: int) -> np.ndarray:
    """exp(sign * 2 pi i product / whole); the product is reduced in whole numbers first."""
    return np.exp(sign * 2j * np.pi * (product % whole) / whole)


def _frame(**columns: np.ndarray) -> pd.DataFrame:
    out = {}
    for name, values in columns.items():
        out |= {f"{name}_re": values.real, f"{name}_im": values.imag} if np.iscomplexobj(values) else {name: values}
    return pd.DataFrame(out)


def _placed(part: pd.DataFrame, at: str, name: str, size: int) -> np.ndarray:
    line = np.zeros(size, complex)
    line[part[at].to_numpy()] = part[f"{name}_re"].to_numpy() + 1j * part[f"{name}_im"].to_numpy()
    return line


def bin_powers(series: DataFrame, value: str, index: str, n: int) -> DataFrame:
    """``bin`` (0 to n // 2) and ``power`` of the series: |sum of value * exp(2 pi i bin index / n)| squared.

    Positions without a row and NULL values count as zero, rows of one position are added up, and positions are taken modulo n.
    """
    if n < 1:
        return series.sparkSession.createDataFrame([], "bin long, power double")
    rows, columns = shape_for(n)
    size = rows * columns

    def from_columns(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        column = int(key[0])
        at = np.arange(rows, dtype=np.int64) * columns + column
        mine = part[part["at"].notna()]
        place = mine["at"].to_numpy().astype(np.int64)
        line, lag = np.zeros(rows, complex), np.minimum(at, size - at)
        np.add.at(line, place // columns, mine["v"].to_numpy() * _turn(place * place, 2 * n, -1))
        chirp = np.where(lag < n, _turn(lag * lag, 2 * n, 1), 0)
        k = np.arange(rows, dtype=np.int64)
        phase = _turn(k * column, size, -1)
        return _frame(row=k, column=np.full(rows, column), a=np.fft.fft(line) * phase, b=np.fft.fft(chirp) * phase)

    def along_rows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        row = int(key[0])
        both = np.fft.fft(_placed(part, "column", "a", columns)) * np.fft.fft(_placed(part, "column", "b", columns))
        j = np.arange(columns, dtype=np.int64)
        return _frame(row=np.full(columns, row), column=j, y=np.fft.ifft(both) * _turn(j * row, size, 1))

    def to_columns(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bins = np.arange(rows, dtype=np.int64) * columns + int(key[0])
        line = np.fft.ifft(_placed(part, "row", "y", rows))
        wanted = bins <= n // 2
        return pd.DataFrame({"bin": bins[wanted], "power": line.real[wanted] ** 2 + line.imag[wanted] ** 2})

    points = series.select(F.pmod(F.col(index).cast("long"), F.lit(n)).alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    points = points.filter(F.col("at").isNotNull()).groupBy("at").agg(F.sum("v").alias("v"))
    empty = series.sparkSession.range(columns).select(F.lit(None).cast("long").alias("at"), F.lit(0.0).alias("v"), F.col("id").alias("column"))
    cells = points.select("at", "v", (F.col("at") % columns).alias("column")).unionByName(empty)
    first = cells.groupBy("column").applyInPandas(from_columns, "row long, column long, a_re double, a_im double, b_re double, b_im double")
    second = first.groupBy("row").applyInPandas(along_rows, "row long, column long, y_re double, y_im double")
    return second.groupBy("column").applyInPandas(to_columns, "bin long, power double")
