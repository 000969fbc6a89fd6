"""Pearson r of many series against many others over the times they share, in tasks that Spark has laid out.

A task's rows come sorted by group, homes before visitors. Homes of one group are held; visitors pass by in batches, and sums over
shared times are matrix products of dense blocks (series by times), so no pair and no shared time is ever a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HOME_BLOCK, VISITOR_BLOCK = 256, 512
CLOSE = 1e-6
"""Share of a sum of squares below which what is left of it is worked out again from the shared readings."""


def unit_vectors(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    y, x = np.radians(y), np.radians(x)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)


class Series:
    """Rows (id, key, y, x, at, v) with their readings as one flat array and finite readings centred on their mean."""

    def __init__(self, batch: pa.RecordBatch):
        y, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x"))
        order = np.lexsort((x, np.floor(y * 8)))  # neighbours in a block: narrow boxes
        batch = batch.take(pa.array(order))
        self.batch, self.id, self.y, self.x = batch, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "x"))
        self.place = unit_vectors(self.y, self.x)
        lists = batch.column("at")
        self.size = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        self.end = np.cumsum(self.size)
        self.at, self.v = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "v"))
        owner = np.repeat(np.arange(len(self.size)), self.size)
        finite = np.isfinite(self.v)
        self.odd = np.bincount(owner, ~finite, len(self.size)) > 0
        kept = np.where(finite, self.v, 0.0)
        mean = np.bincount(owner, kept, len(self.size)) / np.maximum(1, self.size)
        self.centred = np.where(finite, kept - mean[owner], 0.0)

    def dense(self, rows: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks (rows by times) of what is there (0 or 1) and of centred readings."""
        there, value = np.zeros((len(rows), times)), np.zeros((len(rows), times))
        size = self.size[rows]
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.end[rows] - size, size)
        at = np.repeat(np.arange(len(rows)), size), self.at[flat]
        there[at], value[at] = 1.0, self.centred[flat]
        return there, value

    def readings(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.end[row] - self.size[row], self.end[row])
        return self.at[part], self.v[part]


def plain_pearson(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float | None:
    """Pearson r from the shared readings themselves; None if either side is constant there."""
    _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    a, b = one[1][i], other[1][j]
    if len(np.unique(a)) < 2 or len(np.unique(b)) < 2:
        return None
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = a - a.mean(), b - b.mean()
        spread = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        return float((a * b).sum() / spread) if spread != 0 else None


def _pairs(homes: Series, visitors: Series, own: bool, times: int, chord: float, minimum: int) -> Iterator[pa.RecordBatch]:
    """Pairs at most about ``chord`` apart on the unit sphere, with the number of shared times and r where there are ``minimum``."""
    for v0 in range(0, len(visitors.id), VISITOR_BLOCK):
        vs = np.arange(v0, min(v0 + VISITOR_BLOCK, len(visitors.id)))
        low, high = visitors.place[vs].min(0) - chord, visitors.place[vs].max(0) + chord
        reach = np.flatnonzero(((homes.place >= low) & (homes.place <= high)).all(1))
        there_v = value_v = None
        for h0 in range(0, len(reach), HOME_BLOCK):
            hs = reach[h0:h0 + HOME_BLOCK]
            apart = 2.0 - 2.0 * (homes.place[hs] @ visitors.place[vs].T)
            near = apart <= chord * chord + 1e-14
            if own:  # a pair of one cell is met in both orders
                near &= homes.id[hs][:, None] < visitors.id[vs][None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            if there_v is None:
                there_v, value_v = visitors.dense(vs, times)
                both_v = np.concatenate([there_v, value_v, value_v * value_v]).T
            there_h, value_h = homes.dense(hs, times)
            m = len(vs)
            n, sy, syy = (p[i, j] for p in np.split(there_h @ both_v, 3, axis=1))
            sx, sxy = (p[i, j] for p in np.split(value_h @ both_v[:, :2 * m], 2, axis=1))
            sxx = ((value_h * value_h) @ both_v[:, :m])[i, j]
            with np.errstate(invalid="ignore", divide="ignore"):
                vx, vy = n * sxx - sx * sx, n * syy - sy * sy
                r = (n * sxy - sx * sy) / (np.sqrt(vx) * np.sqrt(vy))
            enough = n >= minimum
            known = enough.copy()
            unsure = enough & ~((vx > CLOSE * n * sxx) & (vy > CLOSE * n * syy) & np.isfinite(r))
            unsure |= enough & (homes.odd[hs][i] | visitors.odd[vs][j])
            for at in np.flatnonzero(unsure):
                exact = plain_pearson(homes.readings(hs[i[at]]), visitors.readings(vs[j[at]]))
                known[at], r[at] = exact is not None, 0.0 if exact is None else exact
            yield pa.RecordBatch.from_arrays(
                [homes.batch.column("key").take(pa.array(hs[i])), visitors.batch.column("key").take(pa.array(vs[j])), pa.array(homes.y[hs[i]]), pa.array(homes.x[hs[i]]),
                 pa.array(visitors.y[vs[j]]), pa.array(visitors.x[vs[j]]), pa.array(np.rint(n).astype(np.int64)), pa.array(r, mask=~known)],
                names=["key1", "key2", "y1", "x1", "y2", "x2", "n", "r"])


def overlapping_pairs(batches: Iterator[pa.RecordBatch], times: int, chord: float, minimum: int) -> Iterator[pa.RecordBatch]:
    """All pairs of homes and visitors of each group; rows come sorted by (cy, cx, lot, role): 0 homes, 1 visitors from the same cell, 2 others."""
    held, group, homes = [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cy", "cx", "lot", "role")], axis=1).astype(np.int64)
        starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, z in zip(starts, starts[1:]):  # noqa: B905
            mark, part = tuple(marks[a].tolist()), batch.slice(a, z - a)
            if mark[:3] != group:
                held, group, homes = [], mark[:3], None
            if mark[3] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if homes is None:
                homes = Series(pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0])
            yield from _pairs(homes, Series(part), mark[3] == 1, times, chord, minimum)
