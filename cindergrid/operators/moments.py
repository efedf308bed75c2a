"""Mergeable sums over vectors: co-moments in one Arrow aggregate.

A task turns its rows into one partial result; partial results are dealt
together ``fan`` at a time and merged until at most ``fan`` are left, which
the driver merges one by one.  Nothing holds more than two of them at once,
whatever the number of rows or tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.session import ship_package


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix; nulls are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def merged(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], object], merge: Callable[[object, object], object],
           fan: int = 32) -> object:
    """``partial`` of every task's batches, merged; a task may have no rows, and None comes where there is no task.

    ``merge`` must give the same result, up to rounding, in whatever order
    partial results meet.
    """
    ship_package(rows.sparkSession)

    def whole(bodies: Iterator[bytes]) -> object:
        out = None
        for b in bodies:
            out = pickle.loads(b) if out is None else merge(out, pickle.loads(b))
        return out

    def row(found: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["body"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield row(partial(batches))

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = whole(b for batch in batches for b in batch.column(0).to_pylist())
        if found is not None:
            yield row(found)

    n, out = rows.rdd.getNumPartitions(), rows.mapInArrow(first, "body binary")
    while n > fan:
        n = -(-n // fan)
        out = out.repartition(n).mapInArrow(more, "body binary")
    return whole(r[0] for r in out.collect())


@dataclass
class Moments:
    """Weight, mean and centred cross-products of weighted vectors."""

    rows: int
    weight: float
    mean: np.ndarray
    cross: np.ndarray

    @staticmethod
    def of(x: np.ndarray, w: np.ndarray) -> Moments:
        total = float(w.sum())
        mean = w @ x / total if total else np.zeros(x.shape[1])
        d = (x - mean) * np.sqrt(w)[:, None]
        return Moments(len(x), total, mean, d.T @ d)

    def plus(self, other: Moments) -> Moments:
        total = self.weight + other.weight
        if not total:
            return self
        gap = other.mean - self.mean
        return Moments(self.rows + other.rows, total, self.mean + gap * (other.weight / total),
                       self.cross + other.cross + np.outer(gap, gap) * (self.weight * other.weight / total))


def co_moments(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> Moments:
    """Moments of the rows without a null or NaN in ``columns`` (and with a positive weight)."""
    size = len(columns)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), w.alias("w"))
    none = Moments(0, 0.0, np.zeros(size), np.zeros((size, size)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Moments:
        out = none
        for batch in batches:
            x, weights = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            keep = ~np.isnan(x).any(axis=1) & (weights > 0)
            if keep.any():
                out = out.plus(Moments.of(x[keep], weights[keep]))
        return out

    return merged(rows, partial, Moments.plus) or none


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A11 for all pairs: ``(a, b, corr, n)`` from one co-moment matrix, after a listwise null drop.

    A pair with a constant column has a null correlation; so has every pair
    where no row is whole.
    """
    found = co_moments(df, columns)
    spread = np.sqrt(np.diag(found.cross))
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            scale = spread[i] * spread[j]
            # a spread of rounding errors only is none
            flat = min(spread[i] ** 2 / (1 + found.weight * found.mean[i] ** 2),
                       spread[j] ** 2 / (1 + found.weight * found.mean[j] ** 2)) < 1e-20
            rows.append((a, b, None if flat else float(np.clip(found.cross[i, j] / scale, -1, 1)), found.rows))
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double, n long")
