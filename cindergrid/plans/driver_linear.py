"""Linear models, margins and losses small enough that SQL gives their values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cindergrid.models import custom_loss, linear
from cindergrid.operators import moments, prep
from cindergrid.operators.neighbour_information import neighbour_information
from cindergrid.plans.driver_fits import LENGTH_SQL, length_labels
from cindergrid.plans.driver_stats import (
    DOC_FEATURES,
    LAG_PANEL_SQL,
    MI_QUANTILE_SQL,
    doc_features,
    lag_panel,
    split_lag_panel,
)
from cindergrid.plans.registry import ORACLES, query

PANEL_COLUMNS = ["premium", "exposure", "premium_lag1", "premium_lag2"]


@query("correlation_matrix", sql=f"""
WITH {LAG_PANEL_SQL},
r AS (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in PANEL_COLUMNS)} FROM f
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in PANEL_COLUMNS)}),
""" + "u AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr, count(*) AS n FROM r"
    for a in PANEL_COLUMNS for b in PANEL_COLUMNS) + ") SELECT a, b, round(corr, 6) AS corr, n FROM u")
def correlation_matrix(spark, sf):
    """A11 for all pairs of columns, read off one co-moment matrix."""
    found = moments.correlation_matrix(lag_panel(spark, sf), PANEL_COLUMNS)
    return found.select("a", "b", F.round("corr", 6).alias("corr"), "n")


@query("ridge_from_moments", sql=ORACLES["ridge_closed_form"])
def ridge_from_moments(spark, sf):
    """M1 read off the co-moment matrix of two lags and the premium."""
    feats = ["premium_lag1", "premium_lag2"]
    panel = split_lag_panel(spark, sf).dropna(subset=feats)
    model = linear.fit_ridge(panel.filter(F.col("split") == "train"), feats, "premium")
    return panel.filter(F.col("split") == "test").select("o_custkey", F.round(model.column(), 2).alias("yhat"))


@query("logistic_reweighted", sql=ORACLES["logistic_newton"])
def logistic_reweighted(spark, sf):
    """M4 on one feature with balanced weights, by Newton steps of one aggregate each."""
    rows = prep.balanced_weights(length_labels(spark, sf), "quality")
    scorer = linear.fit_logistic(rows, ["x"], "quality", "weight")
    return scorer.score(rows.select("x").distinct()).select("x", F.round("prob", 5).alias("prob"))


@query("custom_loss_logistic", sql=ORACLES["logistic_newton"])
def custom_loss_logistic(spark, sf):
    """A loss passed by the caller, here the log loss with M4's penalty."""
    rows = prep.balanced_weights(length_labels(spark, sf), "quality")
    model = custom_loss.fit_loss(rows, ["x"], "quality", custom_loss.log_loss, custom_loss.log_loss_slope, weight="weight",
                                 l2=1.0)
    points = rows.select("x").distinct()
    return points.select("x", F.round(1 / (1 + F.exp(-model.column())), 5).alias("prob"))


CLASS_WEIGHTS = {0: 3.0, 1: 1.25}


@query("custom_loss_weighted", sql=f"""
WITH RECURSIVE {LENGTH_SQL},
g AS (SELECT x, y, sum(CASE WHEN y = 1 THEN {CLASS_WEIGHTS[1]}::DOUBLE ELSE {CLASS_WEIGHTS[0]}::DOUBLE END) / ln(2) AS w
      FROM ls GROUP BY x, y),
step(k, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, a - (hbb * (ga + a) - hab * gb) / ((haa + 1) * hbb - hab * hab),
         b - ((haa + 1) * gb - hab * (ga + a)) / ((haa + 1) * hbb - hab * hab)
  FROM (SELECT k, a, b, sum(w * (p - y) * x) AS ga, sum(w * (p - y)) AS gb, sum(w * p * (1 - p) * x * x) AS haa,
               sum(w * p * (1 - p) * x) AS hab, sum(w * p * (1 - p)) AS hbb
        FROM (SELECT k, a, b, x, y, w, 1 / (1 + exp(-(a * x + b))) AS p FROM step, g WHERE k < 25) GROUP BY k, a, b))
SELECT x, round(1 / (1 + exp(-(a * x + b))), 5) AS prob FROM step, (SELECT DISTINCT x FROM g) WHERE k = 25""")
def custom_loss_weighted(spark, sf):
    """A22's loss, class weights times -log2 of the true class's probability, as the caller's own."""
    rows = length_labels(spark, sf)
    loss, slope = (custom_loss.by_class(c, CLASS_WEIGHTS, 1 / math.log(2))
                   for c in (custom_loss.log_loss, custom_loss.log_loss_slope))
    model = custom_loss.fit_loss(rows, ["x"], "quality", loss, slope, l2=1.0)
    points = rows.select("x").distinct()
    return points.select("x", F.round(1 / (1 + F.exp(-model.column())), 5).alias("prob"))


FOLDS = 5


@query("margin_calibrated", sql=f"""
WITH RECURSIVE {LENGTH_SQL},
z AS (SELECT x, y, w, CAST('0x' || substr(md5('42#' || doc_id), 1, 15) AS BIGINT) % {FOLDS} AS fold FROM ls),
g AS (SELECT x, y, 2 * y - 1 AS s, fold, sum(w) AS w, count(*) AS n FROM z GROUP BY ALL),
step(k, j, a, b) AS (
  SELECT 0, j, 0.0::DOUBLE, 0.0::DOUBLE FROM range({FOLDS + 1}) AS r(j)
  UNION ALL
  SELECT k + 1, j, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT k, j, a, b, a + sum(-2 * w * s * gap * x) AS ga, sum(-2 * w * s * gap) AS gb,
               1 + sum(2 * w * x * x) FILTER (gap > 0) AS haa, sum(2 * w * x) FILTER (gap > 0) AS hab,
               sum(2 * w) FILTER (gap > 0) AS hbb
        FROM (SELECT k, j, a, b, x, y, s, w, greatest(0, 1 - s * (a * x + b)) AS gap FROM step, g WHERE k < 40 AND fold <> j)
        GROUP BY k, j, a, b)),
m AS (SELECT j, a, b FROM step WHERE k = 40),
c AS (SELECT sum(n) FILTER (y = 1) AS n1, sum(n) FILTER (y = 0) AS n0 FROM g),
o AS (SELECT a * x + b AS f, n, CASE WHEN y = 1 THEN (n1 + 1.0::DOUBLE) / (n1 + 2) ELSE 1 / (n0 + 2.0::DOUBLE) END AS t
      FROM g JOIN m ON j = fold, c),
plat(k, a, b) AS (
  SELECT 0, 0.0::DOUBLE, ln((n0 + 1.0::DOUBLE) / (n1 + 1)) FROM c
  UNION ALL
  SELECT k + 1, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab)
  FROM (SELECT k, a, b, sum(n * (t - p) * f) AS ga, sum(n * (t - p)) AS gb, sum(n * p * (1 - p) * f * f) AS aa,
               sum(n * p * (1 - p) * f) AS ab, sum(n * p * (1 - p)) AS bb
        FROM (SELECT k, a, b, f, n, t, 1 / (1 + exp(a * f + b)) AS p FROM plat, o WHERE k < 40) GROUP BY k, a, b))
SELECT x, round(m.a * x + m.b, 5) AS margin, round(1 / (1 + exp(q.a * (m.a * x + m.b) + q.b)), 5) AS prob
FROM (SELECT DISTINCT x FROM g), m, plat q WHERE m.j = {FOLDS} AND q.k = 40""")
def margin_calibrated(spark, sf):
    """M7 on one feature with balanced weights: squared-hinge margin, sigmoid fitted on the scores of unseen folds."""
    rows = prep.balanced_weights(length_labels(spark, sf), "quality")
    scorer = linear.fit_margin(rows, F.array("x"), 1, "quality", ["doc_id"], ["x"], weight="weight", folds=FOLDS, tol=1e-10)
    points = scorer.score(rows.select("x").distinct())
    margin = scorer.model.scores(spark)(F.array("x"))
    return points.select("x", F.round(margin, 5).alias("margin"), F.round("prob", 5).alias("prob"))


def _digamma_sql(n: str) -> str:
    z = f"(({n}) + 10.0::DOUBLE)"
    series = f"ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6)"
    return f"({series} - " + " - ".join(f"1 / (({n}) + {i}.0::DOUBLE)" for i in range(10)) + ")"


NEIGHBOUR_SQL = f"""
r AS (SELECT row_number() OVER () AS id, quality AS y, unnest([0, 1, 2]) AS position, unnest([n_chars, n_spaces, n_lines]) AS x
      FROM d),
s AS (SELECT *, count(*) OVER (PARTITION BY position, y) AS size FROM r),
w AS (SELECT a.position, a.id, a.x, a.y, a.size, abs(b.x - a.x) AS away,
             row_number() OVER (PARTITION BY a.position, a.id ORDER BY abs(b.x - a.x)) AS i
      FROM s a JOIN s b ON a.position = b.position AND a.y = b.y AND a.id <> b.id WHERE a.size > 1),
q AS (SELECT * FROM w WHERE i = least(3, size - 1)),
m AS (SELECT q.position, q.id, q.size, count(*) AS m FROM q JOIN s b
      ON q.position = b.position AND b.size > 1 AND (abs(b.x - q.x) < q.away OR (q.away = 0 AND b.x = q.x)) GROUP BY ALL)
SELECT ['n_chars', 'n_spaces', 'n_lines'][position + 1] AS feature, CAST(position AS INTEGER) AS position,
       round(greatest({_digamma_sql("count(*)")} + avg({_digamma_sql("least(3, size - 1)")}) - avg({_digamma_sql("size")})
                      - avg({_digamma_sql("m")}), 0), 6) AS mi FROM m GROUP BY position"""


@query("mutual_information_neighbours", sql=f"WITH {MI_QUANTILE_SQL.split('long AS')[0]}" + NEIGHBOUR_SQL.lstrip())
def mutual_information_neighbours(spark, sf):
    """A24 by nearest neighbours within the class; the oracle compares all pairs."""
    mi = neighbour_information(doc_features(spark, sf), DOC_FEATURES, "quality", piece_rows=100)
    return mi.select("feature", "position", F.round("mi", 6).alias("mi"))
