"""Kernels between every row and a bounded set of landmark rows.

The reference builds full n x n and n x m kernel matrices on one machine.
Here the landmark set is the only thing gathered: ``m`` rows, where ``m`` is
the caller's parameter and is honoured exactly.  Each row gets an
``array<double>`` of its kernel values - a map-side operation with no
shuffle and no join.  Cost is rows x m; nothing grows as n x n.

Kernels: ``linear`` (x.l), ``cosine``, ``rbf`` (exp(-gamma |x - l|^2)) and
``fidelity`` = squared inner product of the unit vectors (the overlap
|<phi(x)|phi(l)>|^2 of normalised state vectors).

A task multiplies ``PIECE`` rows at a time by the broadcast landmark matrix
and hands their values on before the next, so its memory is bounded by
``PIECE`` times the landmarks whatever the batches and the number of rows.  A kernel value is null where it is not
defined: for a null vector, a vector with a null or of another length, and
under ``cosine`` and ``fidelity`` for a zero vector on either side.

:func:`nystroem_map` turns kernel rows into explicit features: with the
landmarks' own kernel matrix ``K`` (m x m), the features of a row ``k`` are
``k K^(-1/2)``, whose inner products reproduce the kernel on the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.operators.sampling import order_hash
from cindergrid.session import ship_package

KERNELS = ("linear", "cosine", "rbf", "fidelity")


class Landmarks:
    """Landmark ids and their vectors (m x d, float64), gathered once."""

    def __init__(self, ids: list, matrix: np.ndarray):
        self.ids = ids
        self.matrix = np.asarray(matrix, dtype=np.float64)

    @property
    def m(self) -> int:
        return self.matrix.shape[0]


def collect_landmarks(df: DataFrame, id_col: str, vec_col: str, m: int, seed: int = 42,
                      order: Sequence[str | Column] | None = None) -> Landmarks:
    """Gather ``m`` landmark vectors (all rows where there are fewer).

    They are the first by ``order``, by default the seeded md5 order of
    the sampling operators, so any row may be chosen.  Rows without a vector
    can't be landmarks.
    """
    if m < 1:
        raise ValueError("at least one landmark is needed")
    sel = df.select(id_col, F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")
    rows = sel.orderBy(*(order if order is not None else [order_hash(seed, [id_col]), id_col])).limit(m).collect()
    if not rows:
        raise ValueError("no landmark rows")
    return Landmarks([r[id_col] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64))


def kernel_matrix(x: np.ndarray, y: np.ndarray, kind: str, gamma: float = 1.0) -> np.ndarray:
    """Kernel values of the rows of ``x`` against those of ``y``; NaN where undefined."""
    products = x @ y.T
    if kind == "linear":
        return products
    xx, yy = np.einsum("ij,ij->i", x, x)[:, None], np.einsum("ij,ij->i", y, y)[None, :]
    if kind == "rbf":
        return np.exp(-gamma * np.maximum(xx + yy - 2.0 * products, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return products / np.sqrt(xx * yy) if kind == "cosine" else products * products / (xx * yy)


def nystroem_map(lm: Landmarks, kind: str, gamma: float = 1.0, tol: float = 1e-9) -> np.ndarray:
    """``K^(-1/2)`` over the eigenvalues above ``tol`` of the largest: an m x r matrix, r the numerical rank."""
    own = kernel_matrix(lm.matrix, lm.matrix, kind, gamma)
    if not np.isfinite(own).all():
        raise ValueError("the kernel is undefined on a landmark")
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > tol * max(values[-1], 0.0)
    if not keep.any():
        raise ValueError("the kernel of the landmarks is zero")
    return vectors[:, keep] / np.sqrt(values[keep])


PIECE = 512  # rows whose kernel values a task holds at once


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as a matrix, NaN for a null and for a vector that is null or of another length."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    x = np.full((len(column), width), np.nan)
    flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x[fits.to_numpy(zero_copy_only=False)] = flat.reshape(-1, width)
    return x


def kernel_features(df: DataFrame, vec_col: str, lm: Landmarks, kind: str = "rbf", gamma: float = 1.0,
                    out: str = "kernel", project: np.ndarray | None = None) -> DataFrame:
    """Add ``out`` = array of kernel values against every landmark (in landmark order).

    With ``project`` (see :func:`nystroem_map`) the array holds the kernel
    row times that matrix, and is all null where any kernel value is.
    """
    if kind not in KERNELS:
        raise ValueError(f"unknown kernel {kind!r}")
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((lm.matrix, project))
    width = lm.matrix.shape[1]
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, turn = shared.value
        for whole in batches:
            for batch in (whole.slice(i, PIECE) for i in range(0, len(whole), PIECE)):
                values = kernel_matrix(_vectors(batch.column(len(kept)), width), marks, kind, gamma)
                if turn is not None:
                    values = values @ turn
                n, m = values.shape
                flat = values.ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(flat, mask=np.isnan(flat)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists], names=[*kept, out])

    slim = df.select(*kept, F.col(vec_col).cast("array<double>").alias("__cg_v"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField(out, T.ArrayType(T.DoubleType()))])
    return slim.mapInArrow(run, schema)


def kernel_long(df: DataFrame, id_col: str, vec_col: str, lm: Landmarks, kind: str = "rbf", gamma: float = 1.0,
                value: str = "k") -> DataFrame:
    """Long form ``(id, landmark_id, k)``: the kernel array exploded with positions."""
    feats = kernel_features(df.select(id_col, vec_col), vec_col, lm, kind, gamma, "__cg_k")
    id_type = df.schema[id_col].dataType
    ids = F.array(*[F.lit(i).cast(id_type) for i in lm.ids])
    # ``posexplode_outer``: the arrays always hold m >= 1 values, and the plain
    # generator would add an inferred non-empty filter that evaluates the
    # kernel a second time
    ex = feats.select(id_col, F.posexplode_outer("__cg_k").alias("__cg_i", value))
    return ex.select(id_col, ids[F.col("__cg_i")].alias("landmark_id"), value)


def vector_from_columns(cols: Sequence[str]) -> Column:
    """Feature columns -> array<double> (input for the kernels)."""
    return F.array(*[F.col(c).cast("double") for c in cols])
