"""Experiment runners (M0, M7-M13): fits are Spark ML jobs on executors,
metrics are the aggregate operators, and the driver only holds fitted
parameters and one-row results.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.models import boosting, linear, trees
from cindergrid.models import estimators as est
from cindergrid.operators import kernels, metrics, prep, report, sampling
from cindergrid.session import materialize, release

NAIVE = "Naive (Lag-1)"
_FORESTS = threading.Lock()


def assemble(df: DataFrame, features: Sequence[str] | str, out: str = "features") -> DataFrame:
    """Feature columns -> one ML vector; a single ``array<double>`` column name is
    converted directly (``array_to_vector``), without a column per element."""
    if isinstance(features, str):
        return df.withColumn(out, array_to_vector(F.col(features)))
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def _predictions(model, df: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
    return model.transform(df).select(*keep, F.col("prediction").cast("double").alias("yhat"),
                                      F.lit(name).alias("model"))


def run_experiment(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, experiment: str,
                   keep: Sequence[str] = (), naive_col: str | None = "premium_lag1",
                   models: Sequence[str] = ("ridge", "forest", "boosted"), forest_trees: int = 200,
                   forest_depth: int | None = None, gbt_iters: int = 200, alpha: float = 1.0,
                   rounding: Mapping[str, int] | None = None, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """M9: impute with train medians (taken before the null-target drop), drop
    null targets, naive baseline, ridge, forest and boosting, one metrics aggregate.

    Returns ``(metrics, predictions)``; predictions keep ``keep`` columns.
    The draws of the forest go by ``key`` (by all columns where none is
    given, so that equal rows are drawn together).  Fitted trees are tables;
    each model's predictions are written before they are stacked.
    """
    feats = list(features)
    cols = list(dict.fromkeys([*keep, *key, *feats, target] + ([naive_col] if naive_col else [])))
    tr, te, _ = prep.impute_train_median(train.select(*cols), test.select(*cols), feats)
    tr = materialize(tr.filter(F.col(target).isNotNull()))
    te = materialize(te.filter(F.col(target).isNotNull()))
    ident = list(key) or cols
    preds = []
    if naive_col and naive_col in feats:
        preds.append(te.select(*keep, F.col(target).alias("y"), F.col(naive_col).cast("double").alias("yhat"),
                               F.lit(NAIVE).alias("model")))
    if "ridge" in models:
        params = prep.fit_scaler(tr, feats)
        tr_s = assemble(prep.apply_scaler(tr, params), feats)
        te_s = assemble(prep.apply_scaler(te, params), feats)
        m = est.ridge(tr_s, target, alpha).fit(tr_s)
        preds.append(_predictions(m, te_s.withColumn("y", F.col(target)), [*keep, "y"], "Ridge"))

    def scored(name, fitted):
        rows = trees.score_trees(te.withColumn("y", F.col(target)), fitted, feats, "yhat")
        return materialize(rows.select(*keep, "y", "yhat", F.lit(name).alias("model")))

    if "forest" in models:
        with _FORESTS:  # a forest keeps all cores busy and has many nodes, which go once they are scored
            preds.append(scored("Random Forest", trees.fit_forest(tr, feats, target, ident, trees=forest_trees,
                                                                  max_depth=forest_depth, seed=est.SEED)))
            release(train.sparkSession)
    if "boosted" in models:
        preds.append(scored("Gradient Boosting", boosting.fit_boosted(tr, feats, target, ident, rounds=gbt_iters, seed=est.SEED)))
    allp = report.stack_frames(preds).withColumn("experiment", F.lit(experiment))
    met = metrics.regression_metrics(allp, "y", "yhat", ["experiment", "model"],
                                     rounding=dict(rounding or {"MAE": 2, "RMSE": 2, "R2": 4, "MAPE": 2}), half_even=True)
    return materialize(met), allp


def experiment_matrix(train: DataFrame, test: DataFrame, feature_sets: Mapping[str, Sequence[str]], target: str,
                      parallelism: int = 4, **kw) -> DataFrame:
    """The same run over several feature sets; metric rows stacked.

    Up to ``parallelism`` sets are fitted at a time: a boosted fit is a long
    chain of short jobs, which leave executors idle on their own.  A set's
    metric rows are written as soon as it is done.
    """
    def one(item):
        name, feats = item
        available = [c for c in feats if c in train.columns]  # P2
        return run_experiment(train, test, available, target, name, **kw)[0]

    with ThreadPool(max(1, min(parallelism, len(feature_sets)))) as pool:
        return report.stack_frames(pool.map(inheritable_thread_target(train.sparkSession)(one), feature_sets.items()))


# ------------------------------------------------------------- classifiers
def class_metrics(pred: DataFrame, label: str, group: Sequence[str] = (), prob: str = "prob",
                  predicted: str = "pred") -> DataFrame:
    """M11 metric set: ROC-AUC, PR-AUC (average precision), F1, precision, recall - one aggregate."""
    return metrics.ranking_metrics(pred, label, prob, group, pred=predicted)


def weighted(df: DataFrame, label: str) -> tuple[DataFrame, float]:
    """Balanced weight column and the weight total, which is the number of rows with a class."""
    return prep.balanced_weights(df, label), float(df.filter(F.col(label).isNotNull()).count())


@dataclass
class Scorer:
    """A fitted classifier: ``features`` turns a frame into one with the vector column, ``model`` scores it."""

    name: str
    model: object
    features: Callable[[DataFrame, str], DataFrame]
    columns: list[str]
    fit_seconds: float

    def score(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        """``df`` plus P(class 1) and the class; several scorers can follow one another on one frame."""
        named = {"featuresCol": "__cg_f", "probabilityCol": "__cg_p", "predictionCol": "__cg_y",
                 "rawPredictionCol": "__cg_r"}
        model = self.model.copy({self.model.getParam(k): v for k, v in named.items()})
        out = model.transform(self.features(df, "__cg_f"))
        return out.withColumn(prob, vector_to_array("__cg_p")[1]).withColumn(pred, F.col("__cg_y").cast("int")) \
            .drop(*named.values())


def fit_scorer(make: Callable[[float], object], train: DataFrame, label: str,
               features: Callable[[DataFrame, str], DataFrame], columns: Sequence[str], name: str) -> Scorer:
    """Fit ``make(sum of weights)`` with balanced weights.

    Only label, weight and vector are persisted for the fit: iterative
    solvers pass over them once per iteration.
    """
    slim, total = weighted(features(train, "features").select(label, "features"), label)
    tr = slim.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tr.count()
        t0 = time.time()
        model = make(total).fit(tr)
        seconds = time.time() - t0
    finally:
        tr.unpersist()
    return Scorer(name, model, features, list(columns), seconds)


def evaluate(scorer: Scorer | TreeScorer | linear.LinearScorer | linear.MarginScorer, valid: DataFrame, label: str, keep: Sequence[str] = ()
             ) -> tuple[DataFrame, DataFrame, float]:
    """Metrics (one row, with the fit's seconds), predictions and the fit's seconds."""
    pred = scorer.score(valid).select(*keep, F.col(label), "pred", "prob")
    met = class_metrics(pred, label).withColumn("model", F.lit(scorer.name)) \
        .withColumn("train_runtime_s", F.lit(round(scorer.fit_seconds, 4)))
    return met, pred, scorer.fit_seconds


def evaluate_classifier(estimator, train: DataFrame, valid: DataFrame, features: Sequence[str], label: str,
                        keep: Sequence[str] = (), name: str = "model") -> tuple[DataFrame, DataFrame, float]:
    """M11 for an estimator on plain feature columns."""
    return evaluate(fit_scorer(lambda _: estimator, train, label, _columns(features), features, name), valid, label, keep)


@dataclass
class TreeScorer:
    """A fitted ensemble of trees for a 0/1 label: mean leaf shares, or log odds where it has a start value."""

    name: str
    model: trees.Forest
    columns: list[str]
    fit_seconds: float

    def score(self, df: DataFrame, prob: str = "prob", pred: str = "pred") -> DataFrame:
        """``df`` plus P(class 1) and the class (1 above one half)."""
        out = trees.score_trees(df, self.model, self.columns, "__cg_s")
        p = F.col("__cg_s") if self.model.start is None else 1 / (1 + F.exp(-F.col("__cg_s")))
        return out.withColumn(prob, p).withColumn(pred, (F.col(prob) > 0.5).cast("int")).drop("__cg_s")


def fit_forest_classifier(train: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = (),
                          n_trees: int = 300, seed: int = est.SEED, name: str = "Random Forest", **kw) -> TreeScorer:
    """M5: square root of the features at a split, balanced weights, trees grown to the end."""
    slim, _ = weighted(train.select(*dict.fromkeys([*key, *features, label])), label)
    slim, t0 = materialize(slim), time.time()
    model = trees.fit_forest(slim, features, label, list(key) or [*features, label], trees=n_trees, weight="weight",
                             max_features=max(1, math.isqrt(len(features))), seed=seed, **kw)
    return TreeScorer(name, model, list(features), time.time() - t0)


def fit_boosted_classifier(train: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = (),
                           rounds: int = 300, seed: int = est.SEED, name: str = "Gradient Boosting", **kw) -> TreeScorer:
    """M6: log-loss boosting on eight tenths of the rows a round, balanced weights, Newton leaves."""
    slim, _ = weighted(train.select(*dict.fromkeys([*key, *features, label])), label)
    slim, t0 = materialize(slim), time.time()
    model = boosting.fit_boosted(slim, features, label, list(key) or [*features, label], rounds=rounds, weight="weight",
                                 loss=boosting.LOGISTIC, subsample=0.8, seed=seed, **kw)
    return TreeScorer(name, model, list(features), time.time() - t0)


def _columns(features: Sequence[str]) -> Callable[[DataFrame, str], DataFrame]:
    return lambda df, out: assemble(df, features, out)


def _scaled(features: Sequence[str], params: Mapping[str, tuple[float, float]]):
    """A21 as an array expression, which leaves the columns themselves alone."""
    return F.array(*[(F.col(c).cast("double") - F.lit(params[c][0])) / F.lit(params[c][1]) for c in features])


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, max_iter: int = 1000) -> linear.LinearScorer:
    """M4 on A21-scaled features with balanced weights, by Newton steps."""
    slim, _ = weighted(train.select(*features, label), label)
    return linear.fit_logistic(materialize(slim), features, label, "weight", scale=prep.fit_scaler(train, features),
                               steps=max_iter)


def logistic_classifier(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str,
                        keep: Sequence[str] = (), max_iter: int = 1000):
    """M4 fitted and evaluated."""
    return evaluate(fit_logistic(train, features, label, max_iter), valid, label, keep)


def draw_landmarks(train: DataFrame, label: str, key: Sequence[str], n: int = 800, seed: int = 42) -> DataFrame:
    """The stratified sample of ``n`` training rows that landmark classifiers use, written once."""
    return materialize(sampling.stratified_sample(train, label, key, n, seed))


def fit_landmarks(train: DataFrame, features: Sequence[str], label: str, key: Sequence[str], kind: str = "fidelity",
                  n_landmarks: int = 800, k_features: int | None = None, gamma: float | None = None, seed: int = 42,
                  tol: float = 1e-6, name: str | None = None, sample: DataFrame | None = None,
                  scale_on: DataFrame | None = None, folds: int = 5) -> linear.MarginScorer:
    """M7 / M8: stratified sample -> MI feature selection (k) -> scaling ->
    whitened kernel features against the sample -> balanced margin classifier
    with calibrated probabilities.

    ``scale_on`` is the frame that the scaler is fitted on: the sample by
    default, as the kernel runs do; the RBF baseline passes all training
    rows.  ``sample`` shares one sample among several fits.  Every training
    row is fitted on (cost rows x landmarks); only the sample reaches the
    driver, and its kernel matrix (``n_landmarks`` squared) is whitened
    there.  An undefined kernel value counts as 0.
    """
    sample = sample if sample is not None else draw_landmarks(train, label, key, n_landmarks, seed)
    feats = list(features)
    if k_features and k_features < len(feats):
        mi = prep.mutual_information(sample, feats, label)
        feats = [r["feature"] for r in prep.select_k_best(mi, k_features).collect()]
    vector = _scaled(feats, prep.fit_scaler(sample if scale_on is None else scale_on, feats))
    ident = F.concat_ws("#", *[F.col(k).cast("string") for k in key])
    marks = kernels.collect_landmarks(sample.select(ident.alias("id"), vector.alias("x")), "id", "x", n_landmarks,
                                      order=["id"])
    g = gamma if gamma is not None else 1.0 / max(len(feats), 1)
    turn = kernels.nystroem_map(marks, kind, g)
    slim, _ = weighted(train.select(*dict.fromkeys([*key, *feats, label])), label)
    return linear.fit_margin(slim, vector, len(feats), label, key, feats, weight="weight", landmarks=marks, kind=kind,
                             gamma=g, turn=turn, folds=folds, seed=seed, tol=tol,
                             name=name or f"Kernel margin ({kind}, {len(feats)}f)")


def landmark_classifier(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, key: Sequence[str],
                        keep: Sequence[str] = (), **kw):
    """M7 / M8 fitted and evaluated; ``kw`` as in :func:`fit_landmarks`."""
    scorer = fit_landmarks(train, features, label, key, **kw)
    met, pred, seconds = evaluate(scorer, valid, label, keep)
    return met.withColumn("n_features", F.lit(len(scorer.columns))) \
        .withColumn("features", F.lit("; ".join(scorer.columns))), pred, seconds


def ablation(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, key: Sequence[str],
             settings: Sequence[tuple[int, str]], n_landmarks: int = 800, seed: int = 42, **kw) -> DataFrame:
    """The landmark classifier under several (feature count, kernel) settings, on one sample."""
    sample = draw_landmarks(train, label, key, n_landmarks, seed)
    frames = []
    for k, kind in settings:
        met, _, _ = landmark_classifier(train, valid, features, label, key, kind=kind, k_features=k,
                                        n_landmarks=n_landmarks, sample=sample, name=f"{kind}-{k}f", **kw)
        frames.append(met)
    return report.stack_frames(frames)


def score_generator(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str,
                    entity: Sequence[str], key: Sequence[str], n_landmarks: int = 800,
                    k_features: int | None = None, kind: str = "fidelity") -> DataFrame:
    """M12 + K4 shape: score every validation entity with two models in one pass,
    ``(entity..., kernel_risk_prob, classical_risk_prob)`` rounded to 6, sorted."""
    plain = fit_logistic(train, features, label)
    kernel = fit_landmarks(train, features, label, key, kind=kind, n_landmarks=n_landmarks, k_features=k_features)
    both = kernel.score(plain.score(valid, "classical_risk_prob", "__cg_a"), "kernel_risk_prob", "__cg_b")
    return both.select(*entity, *[F.round(c, 6).alias(c) for c in ("kernel_risk_prob", "classical_risk_prob")]) \
        .orderBy(*entity)
