"""Model metrics as aggregate jobs.

* regression metrics: one ``groupBy(group).agg``; the R2 denominator uses
  ``var_pop`` (a numerically stable merge), not ``sum(y^2) - n*mean^2``;
* ROC-AUC and average precision are exact and tie-aware: predictions are
  first reduced to one row per distinct score (partial aggregation), then
  running positive/negative totals along descending score come from the
  range-partitioned prefix sum - no single-task window over all scores.
  Spark's ``areaUnderPR`` interpolates and ``numBins`` makes ROC-AUC
  approximate, so neither is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.operators.ordering import running_totals


def _required(c: Column, what: str) -> Column:
    """``c``, failing the job at the first null: a metric over fewer rows than given is no metric."""
    return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"null {what}: drop or fill it first")))


def regression_metrics(df: DataFrame, y: str, yhat: str, group: Sequence[str] = (),
                       rounding: dict | None = None, half_even: bool = False) -> DataFrame:
    """MAE, RMSE, R2, MAPE (x100, denominator |y| + 1) per group.

    ``rounding`` e.g. ``{"MAE": 2, "RMSE": 2, "R2": 4, "MAPE": 2}`` as in
    the reference; ``half_even`` for Python-style rounding.  A null target
    or prediction fails the job.  Of a constant target, R2 is 1 where every
    prediction is exact and 0 otherwise.
    """
    yy = _required(F.col(y).cast("double"), y)
    err = _required(F.col(yhat).cast("double"), yhat) - yy
    spread = F.var_pop(yy) * F.count(F.lit(1))
    missed = F.sum(err * err)
    r2 = F.when(spread > 0, F.lit(1.0) - F.try_divide(missed, spread)).otherwise((missed == 0).cast("double"))
    out = df.groupBy(*group).agg(F.avg(F.abs(err)).alias("MAE"), F.sqrt(F.avg(err * err)).alias("RMSE"), r2.alias("R2"),
                                 (F.avg(F.abs(err) / (F.abs(yy) + 1)) * 100).alias("MAPE"))
    if rounding:
        fn = F.bround if half_even else F.round
        out = out.select(*group, *[fn(c, rounding[c]).alias(c) if c in rounding else F.col(c)
                                   for c in ("MAE", "RMSE", "R2", "MAPE")])
    return out


def confusion_metrics(df: DataFrame, label: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """TP/FP/FN counts, precision, recall, F1 with ``zero_division=0``."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    out = df.groupBy(*group).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                                 F.count_if(y & ~p).alias("fn"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return out.select(*group, "tp", "fp", "fn", prec.cast("double").alias("precision"),
                      rec.cast("double").alias("recall"), f1.cast("double").alias("f1"))


def score_curve(df: DataFrame, label: str, score: str, group: Sequence[str] = (),
                pred: str | None = None) -> DataFrame:
    """Distinct scores with positives/negatives and running totals from the top.

    A null label or score fails the job.
    Columns: group..., score, pos, neg, cum_pos, cum_neg (inclusive); with
    ``pred`` also the per-score confusion counts tp, fp, fn.
    """
    y = _required(F.col(label).cast("double"), label)
    extra = []
    if pred is not None:
        yy, pp = F.col(label) == 1, F.col(pred) == 1
        extra = [F.count_if(yy & pp).alias("tp"), F.count_if(~yy & pp).alias("fp"),
                 F.count_if(yy & ~pp).alias("fn")]
    per_score = df.groupBy(*group, _required(F.col(score).cast("double"), score).alias("score")) \
        .agg(F.sum(y).alias("pos"), F.sum(F.lit(1.0) - y).alias("neg"), *extra)
    return running_totals(per_score, list(group), [F.desc("score")], ["pos", "neg"], prefix="cum_")


def ranking_metrics(df: DataFrame, label: str, score: str, group: Sequence[str] = (),
                    pred: str | None = None) -> DataFrame:
    """A18 + A19: exact tie-aware ROC-AUC and average precision (step sum).

    ROC-AUC = sum over scores of neg * (positives strictly above + pos / 2) / (P * N);
    AP = sum over thresholds of (pos / P) * precision at that threshold.
    With ``pred`` (0/1 predicted class) the same aggregate also yields A17's
    precision, recall and F1 (``zero_division=0``) - no second pass, no join.
    """
    c = score_curve(df, label, score, group, pred)
    above = F.col("cum_pos") - F.col("pos")
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    aggs = [F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("__cg_auc_num"),
            F.sum(F.col("pos") * prec).alias("__cg_ap_num"),
            F.sum("pos").alias("__cg_p"), F.sum("neg").alias("__cg_n")]
    if pred is not None:
        aggs += [F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")]
    agg = c.groupBy(*group).agg(*aggs)
    auc = F.try_divide(F.col("__cg_auc_num"), F.col("__cg_p") * F.col("__cg_n"))
    ap = F.try_divide(F.col("__cg_ap_num"), F.col("__cg_p"))
    out = [*group, auc.alias("roc_auc"), ap.alias("average_precision")]
    if pred is not None:
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        out += [F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).cast("double").alias("precision"),
                F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).cast("double").alias("recall"),
                F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).cast("double").alias("f1")]
    return agg.select(*out)


def weighted_log_loss(df: DataFrame, label: str, probs: str, weights: dict | str | None = None,
                      group: Sequence[str] = (), nulls: str | None = None) -> DataFrame:
    """Mean over rows of w(true class) * -log2(max(p_true, 1e-10)).

    ``probs`` is an array<double> of class probabilities; ``weights`` a
    ``{class: weight}`` dict, a weight column, or None (all 1).  Rows whose
    label or probability is null have no loss; ``nulls`` names a column that
    counts them.
    """
    p_true = F.element_at(F.col(probs), F.col(label).cast("int") + 1)
    if isinstance(weights, dict):
        w = None
        for c, v in weights.items():
            cond = F.col(label) == F.lit(c)
            w = F.when(cond, F.lit(float(v))) if w is None else w.when(cond, F.lit(float(v)))
        w = w.otherwise(F.lit(1.0))
    elif isinstance(weights, str):
        w = F.col(weights)
    else:
        w = F.lit(1.0)
    # ``greatest`` would skip a null probability and score it as the floor
    loss = w * -F.log2(F.when(p_true < 1e-10, F.lit(1e-10)).otherwise(p_true))
    counts = [F.count_if(loss.isNull()).alias(nulls)] if nulls else []
    return df.groupBy(*group).agg(F.avg(loss).alias("log_loss"), *counts)


def loss_gradient(probs: str, label: str, n_classes: int, weights: dict | None = None) -> Column:
    """Per-row gradient ``(p * sum(target) - target) * w`` as array<double>.

    The target is the one-hot of ``label`` (so ``sum(target) = 1``); ``w`` is the
    weight of the true class.
    """
    w = F.lit(1.0)
    if weights:
        w = None
        for c, v in weights.items():
            cond = F.col(label) == F.lit(c)
            w = F.when(cond, F.lit(float(v))) if w is None else w.when(cond, F.lit(float(v)))
        w = w.otherwise(F.lit(1.0))
    onehot = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                         lambda i: F.when(i == F.col(label).cast("int"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.zip_with(F.col(probs), onehot, lambda p, t: (p * F.lit(1.0) - t) * w)


def predicted_class(probs: str) -> Column:
    """argmax over class probabilities (0-based)."""
    a = F.col(probs)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
