"""Linear models read off mergeable sums (M1, M4) and a margin classifier with probabilities (M7, M8).

* Ridge is the solution of the normal equations of one co-moment matrix.
* Logistic regression and the squared-hinge margin classifier are Newton
  runs: each step is one aggregate of the objective, its gradient and its
  curvature matrix.  A step that doesn't lower the objective is halved.
* A margin's probability is a sigmoid of the score (Platt), fitted on scores
  of rows that the scoring model has not seen: rows are dealt into folds by
  digest, and one further model a fold is fitted without it.  All folds share
  each aggregate.

Where the kernel's rank is high, sums are taken over kernel values and turned
into those of the features when they are whole, which takes far fewer
operations than turning every row.  A squared hinge bends only inside the
margin, so from one step to the next the curvature changes by the rows that
crossed it: only those are multiplied out again (``Moves``).

Rows carry their plain features; a kernel's features against landmarks are
made inside the tasks (``Lift``), so no row stores hundreds of values.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.models.trees import row_tasks
from cindergrid.operators.kernels import Landmarks, kernel_matrix
from cindergrid.operators.moments import co_moments, matrix, merged
from cindergrid.operators.sampling import hash_to_long, order_hash
from cindergrid.session import materialize, ship_package


# --- ridge ---------------------------------------------------------------


@dataclass
class Linear:
    """``intercept + sum(coefficient * column)`` as a column expression."""

    columns: list[str]
    coefficients: np.ndarray
    intercept: float

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, k in zip(self.columns, self.coefficients):
            out = out + F.col(c).cast("double") * F.lit(float(k))
        return out


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> Linear:
    """M1 on features scaled by their population deviation (0 -> 1), as coefficients of the plain columns.

    Rows with a null feature or label are left out; without rows all is 0.
    """
    found = co_moments(df, [*features, label])
    f = len(features)
    scale = np.sqrt(np.diag(found.cross)[:f] / max(found.weight, 1.0))
    scale[scale == 0] = 1.0
    left = found.cross[:f, :f] / np.outer(scale, scale) + alpha * np.eye(f)
    w = np.linalg.lstsq(left, found.cross[:f, f] / scale, rcond=None)[0] / scale
    return Linear(list(features), w, float(found.mean[f] - w @ found.mean[:f]))


# --- Newton runs ---------------------------------------------------------


@dataclass
class Lift:
    """Features of a batch of vectors: themselves, or kernel values against landmarks times a matrix."""

    marks: np.ndarray | None = None
    kind: str = "rbf"
    gamma: float = 1.0
    turn: np.ndarray | None = None

    def __post_init__(self):
        # the fidelity of two vectors is the inner product of their unit vectors' products of two entries
        self.short = None
        if self.marks is not None and self.kind == "fidelity" and self.marks.shape[1] * (self.marks.shape[1] + 1) // 2 < len(self.marks):
            self.short = _pairs(self.marks).T @ self.turn

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.marks is None:
            return x
        return self.values(x) @ self.turn if self.short is None else np.nan_to_num(_pairs(x), copy=False, nan=0.0) @ self.short

    def values(self, x: np.ndarray) -> np.ndarray:
        """Kernel values, where an undefined one counts as 0."""
        if self.kind == "rbf":  # the exponents as one product
            y, g = self.marks, self.gamma
            left = np.column_stack((2 * g * x, -g * np.einsum("ij,ij->i", x, x), np.ones(len(x))))
            values = left @ np.column_stack((y, np.ones(len(y)), -g * np.einsum("ij,ij->i", y, y))).T
            np.exp(np.minimum(values, 0.0, out=values), out=values)
        else:
            values = kernel_matrix(x, self.marks, self.kind, self.gamma)
        return np.nan_to_num(values, copy=False, nan=0.0)

    @property
    def late(self) -> bool:
        """Whether sums over kernel values, turned when they are whole, take fewer operations than turning every row."""
        if self.marks is None or self.short is not None:
            return False
        m, r = self.turn.shape
        return m * m < 2 * m * r + r * r

    @property
    def size(self) -> int | None:
        return None if self.marks is None else self.turn.shape[1]


def _pairs(x: np.ndarray) -> np.ndarray:
    """Products of two entries of the unit vectors, so that inner products are squared ones; NaN for zero vectors."""
    i, j = np.triu_indices(x.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return x[:, i] * x[:, j] * np.where(i == j, 1.0, np.sqrt(2.0)) / np.einsum("ij,ij->i", x, x)[:, None]


def _logistic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of the log loss by the score; ``y`` is 0 or 1."""
    p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
    return np.logaddexp(0.0, score) - y * score, p - y, p * (1 - p)


def _squared_hinge(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sign = 2 * y - 1
    gap = np.maximum(0.0, 1 - sign * score)
    return gap * gap, -2 * sign * gap, 2.0 * (gap > 0)


LOSSES = {"logistic": _logistic, "squared_hinge": _squared_hinge}


class Curves:
    """Curvature matrices ``X' diag(bend) X`` of several problems that each leave out one fold.

    Problems mostly agree on a row's bend, so rows are multiplied out once,
    by fold, with the bend of most problems, and only the rows on which a
    problem differs a second time.
    """

    def __init__(self, size: int, own: Sequence[int], folds: int):
        self.own, self.folds = own, folds
        self.of_fold = np.zeros((max(folds, 1), size, size))
        self.apart = np.zeros((len(own), size, size))
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in own]

    def add(self, x: np.ndarray, bend: np.ndarray, used: np.ndarray, fold: np.ndarray) -> None:
        common = np.where(2 * (bend > 0).sum(axis=1) >= used.sum(axis=1), bend.max(axis=1), 0.0)
        for f in np.unique(fold) if self.folds else [0]:
            rows = np.flatnonzero((common > 0) & (fold == f) if self.folds else common > 0)
            root = x[rows] * np.sqrt(common[rows])[:, None]
            self.of_fold[f] += root.T @ root
        for i in range(len(self.own)):
            gap = bend[:, i] - np.where(used[:, i], common, 0.0)
            rows = np.flatnonzero(gap)
            if len(rows):
                self.held[i].append((x[rows], gap[rows]))
                if sum(len(g) for _, g in self.held[i]) >= 1024:
                    self._settle(i)

    def _settle(self, i: int) -> None:
        if self.held[i]:
            x, gap = (np.concatenate(c) for c in zip(*self.held[i]))
            self.apart[i] += (x * gap[:, None]).T @ x
            self.held[i] = []

    def whole(self) -> list[np.ndarray]:
        for i, j in enumerate(self.own):
            self._settle(i)
            for f in range(len(self.of_fold)):
                if not self.folds or f != j:
                    self.apart[i] += self.of_fold[f]
        return list(self.apart)


class Moves:
    """How curvature matrices change by the rows whose bend does, added up in groups; rows wait until there are some."""

    def __init__(self, size: int, groups: int):
        self.sums = np.zeros((groups, size, size))
        self.held: dict[tuple[int, float], list[np.ndarray]] = {}

    def add(self, x: np.ndarray, gap: np.ndarray, group: int) -> None:
        for sign in (1.0, -1.0):
            rows = np.flatnonzero(sign * gap > 0)
            if len(rows):
                held = self.held.setdefault((group, sign), [])
                held.append(x[rows] * np.sqrt(sign * gap[rows])[:, None])
                if sum(map(len, held)) >= 1024:
                    self._settle(group, sign)

    def _settle(self, group: int, sign: float) -> None:
        root = np.concatenate(self.held.pop((group, sign)))
        self.sums[group] += sign * (root.T @ root)

    def whole(self) -> list[np.ndarray]:
        for group, sign in list(self.held):
            self._settle(group, sign)
        return list(self.sums)


@dataclass
class Curved:
    """A point and the curvature there by fold, from which a run without each fold goes on."""

    folds: int
    point: np.ndarray | None = None
    of_fold: np.ndarray | None = None


def newton(rows: DataFrame, size: int, loss: str, *, c: float = 1.0, lift: Lift | None = None, folds: int = 0,
           start: np.ndarray | None = None, steps: int = 100, tol: float = 1e-10, curved: Curved | None = None) -> np.ndarray:
    """Minimises ``|w|^2 / 2 + c * sum(weight * loss(x w + b))`` for all rows, or once without each fold.

    ``rows`` are ``(x array, y 0/1, w, fold)``.  Returns a row of weights and
    the bias for each problem.  Every step is one aggregate that all
    unfinished problems share.  ``curved`` is left by a run over all rows
    for the one without each fold.
    """
    lift = lift or Lift()
    rule, problems = LOSSES[loss], folds or 1
    at = np.zeros((problems, size + 1)) if start is None else np.tile(start, (problems, 1))
    best: list[tuple[float, np.ndarray, np.ndarray] | None] = [None] * problems
    live = list(range(problems))
    spark = rows.sparkSession
    ship_package(spark)
    shared_lift = spark.sparkContext.broadcast(lift)
    late = lift.late
    back = np.eye(size + 1)
    if late:  # from the features, and the bias, to kernel values
        back = np.zeros((lift.turn.shape[0] + 1, size + 1))
        back[:-1, :-1], back[-1, -1] = lift.turn, 1.0
    # a hinge's curvature is kept, with the point it is of, and changed by the rows whose bend does
    keeps = loss == "squared_hinge"
    parts = curved.folds if curved and not folds else 0
    before, kept = [None] * problems, [None] * problems
    if keeps and folds and curved and curved.of_fold is not None:
        whole = curved.of_fold.sum(axis=0)
        before, kept = [curved.point] * problems, [whole - curved.of_fold[j] for j in range(problems)]
    of_fold = None
    for _ in range(steps):
        own = list(live)
        points = at[own] @ back.T
        moves = keeps and (not folds or before[own[0]] is not None)
        last = np.stack([before[j] for j in own]) if moves and before[own[0]] is not None else None

        def partial(batches: Iterator[pa.RecordBatch]) -> list[tuple[float, np.ndarray, np.ndarray]]:
            make = shared_lift.value.values if late else shared_lift.value
            values, slopes = np.zeros(len(own)), np.zeros((points.shape[1], len(own)))
            curves = Moves(points.shape[1], max(parts, len(own))) if moves else Curves(points.shape[1], own, folds)
            # few enough rows that their kernel values stay in the cache
            for batch in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
                x = make(matrix(batch.column(0)))
                x = np.column_stack((x, np.ones(len(x))))
                y, w, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                used = np.stack([fold != j if folds else np.ones(len(x), bool) for j in own], axis=1)
                value, slope, curve = rule(x @ points.T, y[:, None])
                weight = used * w[:, None]
                values += (weight * value).sum(axis=0)
                slopes += x.T @ (weight * slope)
                if not moves:
                    curves.add(x, weight * curve, used, fold)
                    continue
                gap = weight * (curve if last is None else curve - rule(x @ last.T, y[:, None])[2])
                for i in range(len(own)):
                    for k in np.unique(fold) if parts else [i]:
                        curves.add(x, np.where(fold == k, gap[:, i], 0.0) if parts else gap[:, i], k)
            each = [np.stack(curves.whole())] if parts else curves.whole()
            return [(float(v), g, c) for v, g, c in zip(values, slopes.T, each)]

        found = merged(rows, partial, lambda a, b: [tuple(u + v for u, v in zip(s, t)) for s, t in zip(a, b)], fan=8)
        if found is None:
            break
        for (value, slope, curve), j in zip(found, own):
            w = at[j]
            if keeps:
                if parts:
                    of_fold = curve if of_fold is None else of_fold + curve
                    curve = of_fold.sum(axis=0)
                elif moves and kept[j] is not None:
                    curve = kept[j] + curve
                before[j], kept[j] = back @ w, curve
            if late:
                slope, curve = back.T @ slope, back.T @ curve @ back
            total = c * value + w[:-1] @ w[:-1] / 2
            if best[j] is not None and total > best[j][0] + 1e-12 * abs(best[j][0]):
                at[j] = (best[j][1] + w) / 2  # too far: half the step
                if np.abs(at[j] - best[j][1]).max() <= tol * (1 + np.abs(best[j][1]).max()):
                    at[j] = best[j][1]
                    live.remove(j)
                continue
            penalty = np.append(np.ones(size), 1e-12)  # the bias is free
            slope, curve = c * slope + np.append(w[:-1], 0.0), c * curve + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            best[j] = (total, w.copy(), step)
            if np.abs(step).max() <= tol * (1 + np.abs(w).max()):
                live.remove(j)
            else:
                at[j] = w - step
        if not live:
            break
    if curved and not folds:
        curved.point, curved.of_fold = before[0], of_fold
    return at


def labelled(df: DataFrame, x: Column, label: str, weight: str | None, key: Sequence[str] = (), folds: int = 1,
             seed: int = 42) -> DataFrame:
    """``x, y, w, fold`` of the rows with a label, a positive weight and no null feature, written once."""
    fold = hash_to_long(order_hash(seed, list(key))) % F.lit(folds) if folds > 1 else F.lit(0)
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), fold.cast("long").alias("fold"))
    rows = rows.where(F.col("y").isNotNull() & (F.col("w") > 0) & F.col("x").isNotNull()
                      & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    if folds <= 1:
        return materialize(rows)
    # every step reads all rows: they lie in enough tasks, however few ``df`` came in; a fold's rows of a task are
    # multiplied out together
    tasks = row_tasks(rows.count(), df.sparkSession.sparkContext.defaultParallelism)
    return materialize(rows.repartition(tasks).sortWithinPartitions("fold"))


# --- calibration ---------------------------------------------------------


def fit_sigmoid(scores: DataFrame, score: str = "score", label: str = "y", steps: int = 100, tol: float = 1e-10
                ) -> tuple[float, float]:
    """Platt's sigmoid ``1 / (1 + exp(a * score + b))``: Newton steps, one aggregate each.

    Targets are ``(n1 + 1) / (n1 + 2)`` and ``1 / (n0 + 2)``, so that
    separable scores have finite parameters.  Without rows a is -1, b is 0.
    """
    scores = materialize(scores.select(score, label))  # scores are made once
    n = scores.agg(F.count_if(F.col(label) > 0).alias("n1"), F.count_if(F.col(label) <= 0).alias("n0")).first()
    if not n["n1"] + n["n0"]:
        return -1.0, 0.0
    target = F.when(F.col(label) > 0, F.lit((n["n1"] + 1.0) / (n["n1"] + 2.0))).otherwise(F.lit(1.0 / (n["n0"] + 2.0)))
    rows = scores.select(F.col(score).alias("s"), target.alias("t"))
    a, b, best = 0.0, float(np.log((n["n0"] + 1.0) / (n["n1"] + 1.0))), None
    for _ in range(steps):
        z = F.lit(a) * F.col("s") + F.lit(b)
        p = 1 / (1 + F.exp(z))
        # log loss in a form that doesn't overflow: t z + log(1 + exp(-z))
        cost = F.col("t") * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        gap, bend = F.col("t") - p, p * (1 - p)
        r = rows.agg(F.sum(cost).alias("cost"), F.sum(gap * F.col("s")).alias("ga"), F.sum(gap).alias("gb"),
                     F.sum(bend * F.col("s") * F.col("s")).alias("aa"), F.sum(bend * F.col("s")).alias("ab"),
                     F.sum(bend).alias("bb")).first()
        if best is not None and r["cost"] > best[0] + 1e-12 * abs(best[0]):
            a, b = (a + best[1]) / 2, (b + best[2]) / 2
            continue
        step = np.linalg.solve([[r["aa"] + 1e-12, r["ab"]], [r["ab"], r["bb"] + 1e-12]], [r["ga"], r["gb"]])
        best = (r["cost"], a, b)
        if np.abs(step).max() <= tol * (1 + max(abs(a), abs(b))):
            break
        a, b = a - float(step[0]), b - float(step[1])
    return best[1], best[2]


# --- classifiers ---------------------------------------------------------


@dataclass
class LinearScorer:
    """Logistic regression on plain columns."""

    name: str
    model: Linear
    columns: list[str]
    fit_seconds: float

    def score(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        return df.withColumn(prob, 1 / (1 + F.exp(-self.model.column()))) \
            .withColumn(pred, (F.col(prob) > 0.5).cast("int"))


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None, c: float = 1.0,
                 scale: dict[str, tuple[float, float]] | None = None, name: str = "Logistic Regression",
                 steps: int = 100) -> LinearScorer:
    """M4 by Newton steps over ``features`` (scaled by ``scale`` where given), L2 penalty ``1 / c``, free bias."""
    scale = scale or {f: (0.0, 1.0) for f in features}
    x = F.array(*[(F.col(f).cast("double") - F.lit(scale[f][0])) / F.lit(scale[f][1]) for f in features])
    rows = labelled(train, x, label, weight)
    t0 = time.time()
    w = newton(rows, len(features), "logistic", c=c, steps=steps)[0]
    mean, std = (np.array([scale[f][i] for f in features]) for i in (0, 1))
    plain = w[:-1] / std
    return LinearScorer(name, Linear(list(features), plain, float(w[-1] - plain @ mean)), list(features), time.time() - t0)


@dataclass
class Margin:
    """A margin classifier: ``sum(alpha * feature) + bias``, and the sigmoid that makes it a probability."""

    lift: Lift
    weights: np.ndarray
    bias: float
    a: float = -1.0
    b: float = 0.0

    def scores(self, spark) -> Callable[[Column], Column]:
        """The score of an ``array<double>`` column; null where the array or a value in it is null."""
        ship_package(spark)
        # kernel values times (turn times weights): a vector instead of a matrix per row
        plain = self.lift.marks is None or self.lift.short is not None
        alpha = self.weights if plain else self.lift.turn @ self.weights
        shared = spark.sparkContext.broadcast((self.lift, alpha, self.bias))

        @F.pandas_udf("double")
        def score(vectors: pd.Series) -> pd.Series:
            lift, a, bias = shared.value
            known = np.array([v is not None and not np.isnan(np.asarray(v, float)).any() for v in vectors], bool)
            out = np.full(len(vectors), np.nan)
            if known.any():
                x = np.array(vectors[known].tolist(), float)
                # few rows at a time: they are as wide as there are landmarks
                out[known] = np.concatenate([(lift(piece) if plain else lift.values(piece)) @ a + bias
                                             for piece in (x[i: i + 1024] for i in range(0, len(x), 1024))])
            return pd.Series(out)

        return lambda x: F.nanvl(score(x), F.lit(None).cast("double"))


@dataclass
class MarginScorer:
    """A margin classifier over an array expression of its columns."""

    name: str
    model: Margin
    vector: Column
    columns: list[str]
    fit_seconds: float = 0.0
    folds: int = field(default=5)

    def score(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        """``df`` plus the calibrated probability and the side of the margin."""
        out = df.withColumn("__cg_m", self.model.scores(df.sparkSession)(self.vector))
        p = 1 / (1 + F.exp(F.lit(self.model.a) * F.col("__cg_m") + F.lit(self.model.b)))
        return out.withColumn(prob, p).withColumn(pred, (F.col("__cg_m") > 0).cast("int")).drop("__cg_m")


def fit_margin(train: DataFrame, vector: Column, size: int, label: str, key: Sequence[str], columns: Sequence[str], *,
               weight: str | None = None, c: float = 1.0, landmarks: Landmarks | None = None, kind: str = "rbf",
               gamma: float = 1.0, turn: np.ndarray | None = None, folds: int = 5, seed: int = 42, tol: float = 1e-6,
               name: str = "Margin") -> MarginScorer:
    """Squared-hinge margin classifier with calibrated probabilities.

    ``vector`` is the row's array of ``size`` features.  With ``landmarks``
    the features are kernel values against them times ``turn``.  A row's fold
    depends on ``key``.  The folds' models start from the one of all rows.
    """
    lift = Lift() if landmarks is None else Lift(landmarks.matrix, kind, gamma, turn)
    rows = labelled(train, vector, label, weight, key, folds, seed)
    t0 = time.time()
    size = lift.size or size
    curved = Curved(folds)
    w = newton(rows, size, "squared_hinge", c=c, lift=lift, tol=tol, curved=curved)[0]
    model = Margin(lift, w[:-1], float(w[-1]))
    without = newton(rows, size, "squared_hinge", c=c, lift=lift, folds=folds, start=w, tol=tol, curved=curved)
    # a vector a fold instead of a matrix a row
    plain = lift.marks is None or lift.short is not None
    shared = train.sparkSession.sparkContext.broadcast((lift, (without[:, :-1] if plain else without[:, :-1] @ lift.turn.T).T, without[:, -1]))

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift_, each, bias = shared.value
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, len(whole), 512)):
                x, fold = matrix(batch.column(0)), batch.column(3).to_numpy()
                score = ((lift_(x) if plain else lift_.values(x)) @ each + bias)[np.arange(len(fold)), fold]
                yield pa.RecordBatch.from_arrays([pa.array(score), batch.column(1)], names=["score", "y"])

    model.a, model.b = fit_sigmoid(rows.mapInArrow(unseen, "score double, y double"))
    return MarginScorer(name, model, vector, list(columns), time.time() - t0, folds)
