"""Training with a loss given as column expressions.

The caller says what a row costs and how the cost changes with its score;
everything else is a limited-memory quasi-Newton run over the coefficients
of a linear score, whose every evaluation is one aggregate of built-in
functions.  The driver holds the coefficients and the last few steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.models.linear import Linear
from cindergrid.session import materialize

Loss = Callable[[Column, Column], Column]


def log_loss(score: Column, label: Column) -> Column:
    """-log of the probability of the true class, in a form that doesn't overflow."""
    return F.greatest(score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score))) - label * score


def log_loss_slope(score: Column, label: Column) -> Column:
    return 1 / (1 + F.exp(-score)) - label


def by_class(loss: Loss, weights: dict, scale: float = 1.0) -> Loss:
    """A22's form: the loss (or its slope) times the weight of the true class; other classes weigh 1."""

    def weighted(score: Column, label: Column) -> Column:
        w = F.lit(1.0)
        for c, v in weights.items():
            w = F.when(label == F.lit(c), F.lit(float(v))).otherwise(w)
        return loss(score, label) * w * F.lit(scale)

    return weighted


def fit_loss(df: DataFrame, features: Sequence[str], label: str, loss: Loss, slope: Loss, *, weight: str | None = None,
             l2: float = 0.0, memory: int = 10, steps: int = 200, tol: float = 1e-9,
             told: Callable[[int, float], None] | None = None) -> Linear:
    """Minimises ``sum(weight * loss(score, label)) + l2 / 2 * |coefficients|^2`` over linear scores.

    ``loss`` and ``slope`` (its derivative by the score) take the score and
    label columns.  Rows with a null feature, label or weight are left out;
    without rows, or where the loss is null or not finite at the start, the
    result is all zeros.  Steps are halved until the loss falls enough
    (Armijo).  ``told`` gets the number of aggregates and the loss.
    """
    f = len(features)
    columns = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.select(*columns, F.col(label).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna()
    rows = materialize(rows)
    passes = 0

    def at(point: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal passes
        passes += 1
        score = F.lit(float(point[f]))
        for i in range(f):
            score = score + F.col(f"x{i}") * F.lit(float(point[i]))
        by_score = F.col("w") * slope(score, F.col("y"))
        cost = rows.select("*", (F.col("w") * loss(score, F.col("y"))).alias("__c"), by_score.alias("__g"))
        r = cost.agg(F.sum("__c"), *[F.sum(F.col("__g") * F.col(f"x{i}")) for i in range(f)], F.sum("__g")).first()
        if any(v is None or not np.isfinite(v) for v in r):
            return np.inf, np.zeros(f + 1)
        flat = np.append(point[:f], 0.0)
        return float(r[0]) + l2 / 2 * float(flat @ flat), np.array(r[1:], float) + l2 * flat

    x = np.zeros(f + 1)
    value, grad = at(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps if np.isfinite(value) else 0):
        if np.abs(grad).max() <= tol * max(1.0, abs(value)):
            break
        # two-loop recursion over the last steps
        q, kept = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, np.abs(grad).max())
        for (s, y), a in zip(past, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        down, size = float(grad @ q), 1.0
        if down <= 0:  # no descent: forget the past
            past, q, down = [], grad.copy(), float(grad @ grad)
        while True:
            nearer = x - size * q
            found, slope_ = at(nearer)
            if found <= value - 1e-4 * size * down or size < 1e-12:
                break
            size /= 2
        if not found < value:
            break
        s, y = nearer - x, slope_ - grad
        if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
            past = [*past[-(memory - 1):], (s, y)] if memory > 1 else [(s, y)]
        x, value, grad = nearer, found, slope_
        if told:
            told(passes, value)
    return Linear(list(features), x[:f], float(x[f]))
