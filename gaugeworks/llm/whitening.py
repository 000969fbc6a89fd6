"""Whitening of embeddings by shifted Cholesky QR.

The fit list, each different vector once, is stored. A Gram pass lets every task centre its rows exactly, solve them through the
triangular factors found so far and add up the products; what comes back is one sum per pair of dimensions. Its Cholesky factor,
in the first pass of the matrix shifted by a multiple of the rounding unit, so that no conditioning makes it fail, is the next
factor. Passes go on until the solved rows are orthonormal to rounding. The factors multiplied are R of the centred rows, so its
singular value decomposition has the principal axes and, squared over n, the eigenvalues, without squaring the condition of the data.

What reaches the driver and every task is ``dim`` x ``dim`` numbers, whatever the number of rows.

Defined cases: vectors that are null, empty, or hold null, non-finite or very large (2^30 and more) components take no part;
repeated rows and rows without an id are whitened like any other, and equal vectors count once in the fit; vectors of
different lengths are fitted apart; axes along which the vectors do not vary (to rounding) have no component, so a single
vector gets no rows; a deviation that does not fit into a long is null; of equal eigenvalues any orthonormal axes are right;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import embeddings, keep

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Passes over the fit list, at most; three do unless axes are missing.
PASSES = 6
UNIT = 2.0 ** -53
WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_vectors(table: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, x (whole components) and dim of the rows that take part."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 30)))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)
    return table.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"),
                                                              F.size("embedding").alias("dim"))


@dataclass(frozen=True)
class Centre:
    """The mean of n vectors with sums ``sums``, as whole parts and remainders, so that centring rounds once."""
    n: int
    whole: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - sums)^2, exact."""
        apart = x - self.whole
        most = int(np.abs(apart).max(initial=0)) * self.n + self.n
        if most * most * x.shape[1] < 1 << 62:
            return ((self.n * apart - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest.tolist(), strict=True)) for row in apart.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


@dataclass(frozen=True)
class Whitening:
    """Axes (one row each) with their eigenvalues, falling, and the total variance."""
    centre: Centre
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.axes / np.sqrt(self.values)[:, None]).T


def solve_upper(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``r``, column by column."""
    q = np.empty_like(rows)
    for j in range(r.shape[0]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for x in _matrices(batches):
        own = x.sum(0)
        n, total = n + len(x), own if total is None else total + own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["cell", "value"])


def _gram(batches: Iterator[pa.RecordBatch], rows_of) -> Iterator[pa.RecordBatch]:
    """Sums of products of ``rows_of(x)``: the upper triangle, row by row, of one matrix per task."""
    total = None
    for x in _matrices(batches):
        rows = rows_of(x)
        own = rows.T @ rows
        total = own if total is None else total + own
    if total is not None:
        upper = total[np.triu_indices(len(total))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper)), pa.int32()), pa.array(upper)], names=["cell", "value"])


def gram(fit_list: DataFrame, rows_of, size: int) -> np.ndarray:
    """The Gram matrix of ``rows_of(x)``, ``size`` columns, over all of ``fit_list``."""
    parts = fit_list.select("x").mapInArrow(partial(_gram, rows_of=rows_of), "cell int, value double")
    out, (i, j) = np.zeros((size, size)), np.triu_indices(size)
    for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # size^2 / 2 rows
        out[i[r.cell], j[r.cell]] = out[j[r.cell], i[r.cell]] = r.value
    return out


def _solved(x: np.ndarray, centre: Centre, factors: list[np.ndarray]) -> np.ndarray:
    return reduce(solve_upper, factors, centre.centred(x))


def cholesky(g: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular factor of ``g``; shifted if asked for, and where it is not positive definite to rounding."""
    d, shift = len(g), 11 * len(g) * (len(g) + 1) * UNIT * max(np.trace(g), UNIT)
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d) if shifted else g).T
        except np.linalg.LinAlgError:
            shift, shifted = shift * (10 if shifted else 1), True


def fit(fit_list: DataFrame, dim: int, most: int = COMPONENTS) -> Whitening | None:
    """Whitening of the different vectors ``fit_list`` (x; a stored table) of length ``dim``; None if there is none."""
    parts = fit_list.select("x").mapInArrow(_sums, "cell int, value bigint")
    sums = {r.cell: int(r.value) for r in parts.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    if not sums:
        return None
    centre, factors = Centre.of(sums[-1], [sums[j] for j in range(dim)]), []
    for _ in range(PASSES):
        g = gram(fit_list, partial(_solved, centre=centre, factors=list(factors)), dim)
        if not g.any():
            break
        if len(factors) > 1 and np.abs(g - np.eye(dim)).max() <= 16 * dim * UNIT:
            break
        factors.append(cholesky(g, shifted=not factors))
    r = reduce(lambda done, new: new @ done, factors) if factors else np.zeros((dim, dim))
    _, sizes, axes = np.linalg.svd(r)
    values, trace = sizes ** 2 / centre.n, float((sizes ** 2).sum() / centre.n)
    varying = sizes > max(sizes[0], UNIT) * 64 * dim * UNIT
    chosen = np.flatnonzero(varying)[:most]
    axes = axes[chosen]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)]) if len(axes) else np.ones(0)
    return Whitening(centre, axes * signs[:, None], values[chosen], trace)


def _with_one(x: np.ndarray, model: Whitening) -> np.ndarray:
    return np.column_stack([model.project(x), np.ones(len(x))])


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from one more pass."""
    k, n = len(model.values), model.centre.n
    g = gram(fit_list, partial(_with_one, model=model), k + 1)
    mean = g[:k, k] / n
    return float(np.abs(g[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    share = model.values / model.trace
    for whole in batches:
        for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
            ids = batch.column("vec_id")
            for x in _matrices([batch]):
                rows, m = np.repeat(np.arange(len(x)), k), len(x)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.centre.n)),
                     pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(rows)), pa.array(model.project(x).ravel()),
                     pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Rows of ``WHITENED`` for every row of ``vectors`` (vec_id, x, dim) and component."""
    stored = keep(vectors)
    # equal vectors are folded in each task before anything is shuffled
    fit_list = keep(stored.select("dim", "x").distinct())
    out = stored.sparkSession.createDataFrame([], WHITENED)
    for (dim,) in sorted(fit_list.select("dim").distinct().collect()):
        own = fit_list.filter(F.col("dim") == dim)
        model = fit(own, dim, most)
        if model is not None and len(model.values):
            rows = stored.filter(F.col("dim") == dim).select("vec_id", "x")
            out = out.unionByName(rows.mapInArrow(partial(_whitened, model=model, error=identity_error(own, model)), WHITENED))
    return out


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(whole_vectors(embeddings(spark, sf_dir)))
