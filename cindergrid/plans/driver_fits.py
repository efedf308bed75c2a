"""Model fits small enough that SQL gives their values (M1-M6).

Two-feature ridge has a closed form in sums; one-feature logistic
regression is a fixed number of Newton steps; forests and boosting with one
tree of one split predict the means of the two sides of the best split.
The estimators are those of the full-size queries, with other counts.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cindergrid.models import boosting
from cindergrid.models import estimators as est
from cindergrid.models import experiments as ex
from cindergrid.models import trees as trees_
from cindergrid.operators import prep
from cindergrid.plans.driver_stats import LAG_PANEL_SQL, split_lag_panel
from cindergrid.plans.registry import query
from cindergrid.sources.tables import table

ALPHA = 1.0


@query("ridge_closed_form", sql=f"""
WITH {LAG_PANEL_SQL},
c AS (SELECT * FROM s WHERE premium_lag1 IS NOT NULL AND premium_lag2 IS NOT NULL),
m AS (SELECT avg(premium_lag1) AS m1, stddev_pop(premium_lag1) AS s1, avg(premium_lag2) AS m2,
             stddev_pop(premium_lag2) AS s2, avg(premium) AS my, count(*)::DOUBLE AS n FROM c WHERE split = 'train'),
z AS (SELECT c.*, (premium_lag1 - m1) / s1 AS z1, (premium_lag2 - m2) / s2 AS z2, premium - my AS yc FROM c, m),
t AS (SELECT sum(z1 * z1) + {ALPHA} AS a, sum(z1 * z2) AS b, sum(z2 * z2) + {ALPHA} AS d, sum(z1 * yc) AS p,
             sum(z2 * yc) AS q FROM z WHERE split = 'train')
SELECT o_custkey, round(my + z1 * (d * p - b * q) / (a * d - b * b) + z2 * (a * q - b * p) / (a * d - b * b), 2) AS yhat
FROM z, m, t WHERE split = 'test'""")
def ridge_closed_form(spark, sf):
    """M1 on two standardised lags; the oracle solves the normal equations."""
    feats = ["premium_lag1", "premium_lag2"]
    panel = split_lag_panel(spark, sf).dropna(subset=feats)
    train, test = (panel.filter(F.col("split") == x) for x in ("train", "test"))
    params = prep.fit_scaler(train, feats)
    tr = ex.assemble(prep.apply_scaler(train, params), feats)
    model = est.ridge(tr, "premium", ALPHA).fit(tr)
    out = model.transform(ex.assemble(prep.apply_scaler(test, params), feats))
    return out.select("o_custkey", F.round("prediction", 2).alias("yhat"))


LENGTH_SQL = """
ls AS (SELECT d.doc_id, l.quality::DOUBLE AS y, least(floor(d.n_chars / 1000), 9)::DOUBLE AS x,
              count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY l.quality)) AS w
       FROM labels l JOIN documents d USING (doc_id))"""


def length_labels(spark, sf):
    """Label rows with the document's length in thousands, at most 9."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).cast("double").alias("x"))
    return table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id")


@query("logistic_newton", sql=f"""
WITH RECURSIVE {LENGTH_SQL},
g AS (SELECT x, y, sum(w) AS w FROM ls GROUP BY ALL),
step(k, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, a - (hbb * (ga + a) - hab * gb) / ((haa + 1) * hbb - hab * hab),
         b - ((haa + 1) * gb - hab * (ga + a)) / ((haa + 1) * hbb - hab * hab)
  FROM (SELECT k, a, b, sum(w * (p - y) * x) AS ga, sum(w * (p - y)) AS gb, sum(w * p * (1 - p) * x * x) AS haa,
               sum(w * p * (1 - p) * x) AS hab, sum(w * p * (1 - p)) AS hbb
        FROM (SELECT k, a, b, x, y, w, 1 / (1 + exp(-(a * x + b))) AS p FROM step, g WHERE k < 25) GROUP BY k, a, b))
SELECT x, round(1 / (1 + exp(-(a * x + b))), 5) AS prob FROM step, (SELECT DISTINCT x FROM g) WHERE k = 25""")
def logistic_newton(spark, sf):
    """M4 on one feature with balanced weights; the oracle takes 25 Newton steps."""
    rows = ex.assemble(length_labels(spark, sf), ["x"])
    weighted, total = ex.weighted(rows, "quality")
    model = est.logistic("quality", total, tol=1e-12).fit(weighted)
    points = ex.assemble(rows.select("x").distinct(), ["x"])
    return model.transform(points).select("x", F.round(vector_to_array("probability")[1], 5).alias("prob"))


ORDERS_SPLIT_SQL = """
r AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS x, o_totalprice AS y FROM orders),
g AS (SELECT x, count(*)::DOUBLE AS n, sum(y) AS sy FROM r GROUP BY x),
c AS (SELECT a.x AS cut, sum(b.n) FILTER (b.x <= a.x) AS nl, sum(b.sy) FILTER (b.x <= a.x) AS sl,
             sum(b.n) FILTER (b.x > a.x) AS nr, sum(b.sy) FILTER (b.x > a.x) AS sr FROM g a, g b GROUP BY a.x),
best AS (SELECT cut, sl / nl AS ml, sr / nr AS mr FROM c WHERE nr IS NOT NULL
         ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1)
SELECT g.x, round(CASE WHEN g.x <= cut THEN ml ELSE mr END, 3) AS yhat FROM g, best"""


def _priority_means(spark, sf, estimator):
    rows = table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    rows = ex.assemble(rows, ["x"])
    model = estimator.fit(rows)
    points = ex.assemble(rows.select("x").distinct(), ["x"])
    return model.transform(points).select("x", F.round("prediction", 3).alias("yhat"))


@query("forest_one_split", sql=f"WITH {ORDERS_SPLIT_SQL}")
def forest_one_split(spark, sf):
    """M2 with one tree of one split on all rows: the side means of the split with the least squared error."""
    return _priority_means(spark, sf, est.random_forest_regressor("y", num_trees=1, max_depth=1).setBootstrap(False))


@query("boosted_one_split", sql=f"WITH {ORDERS_SPLIT_SQL}")
def boosted_one_split(spark, sf):
    """M3 with one round of one split: the first tree is the one of M2."""
    return _priority_means(spark, sf, est.gbt_regressor("y", max_iter=1, max_depth=1))


CLASS_SPLIT_SQL = """
g AS (SELECT x, sum(w) AS n, sum(w * y) AS sy FROM ls GROUP BY x),
c AS (SELECT a.x AS cut, sum(b.n) FILTER (b.x <= a.x) AS nl, sum(b.sy) FILTER (b.x <= a.x) AS sl,
             sum(b.n) FILTER (b.x > a.x) AS nr, sum(b.sy) FILTER (b.x > a.x) AS sr FROM g a, g b GROUP BY a.x),
best AS (SELECT cut, sl / nl AS ml, sr / nr AS mr FROM c WHERE nr IS NOT NULL
         ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1),
leaf AS (SELECT g.x, CASE WHEN g.x <= cut THEN ml ELSE mr END AS p FROM g, best)"""


def _class_shares(spark, sf, estimator):
    rows = ex.assemble(length_labels(spark, sf), ["x"])
    weighted, _ = ex.weighted(rows, "quality")
    model = estimator.fit(weighted)
    points = ex.assemble(rows.select("x").distinct(), ["x"])
    return model.transform(points).select("x", F.round(vector_to_array("probability")[1], 5).alias("prob"))


@query("forest_classifier_one_split", sql=f"WITH {LENGTH_SQL}, {CLASS_SPLIT_SQL} SELECT x, round(p, 5) AS prob FROM leaf")
def forest_classifier_one_split(spark, sf):
    """M5 with one tree of one split on all rows, balanced weights: weighted class shares of the best split's sides."""
    return _class_shares(spark, sf, est.random_forest_classifier("quality", num_trees=1, max_depth=1)
                         .setBootstrap(False))


@query("boosted_classifier_one_split", sql=f"""
WITH {LENGTH_SQL}, {CLASS_SPLIT_SQL} SELECT x, round(1 / (1 + exp(-2 * (2 * p - 1))), 5) AS prob FROM leaf""")
def boosted_classifier_one_split(spark, sf):
    """M6 with one round of one split on all rows: a mean of -1 and 1 on each side, through the logistic link."""
    return _class_shares(spark, sf, est.gbt_classifier("quality", max_iter=1, max_depth=1, subsample=1.0))


# ------------------------------------------------- whole trees, level by level
TREE_ROWS_SQL = """
r AS (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS x0, CAST(month(o_orderdate) AS DOUBLE) AS x1,
             CAST(o_custkey % 7 AS DOUBLE) AS x2, round(o_totalprice)::DOUBLE AS y,
             CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 2147483647 AS rid FROM orders)"""


def _levels_sql(name: str, levels: int, features: int = 3) -> str:
    """CTEs ``<name>0 .. <name><levels>``: rows ``(tree, node, m, t, x0, ...)`` split level by level by the library's rule.

    ``m`` is a row's weight and ``t`` its target; rows of weight 0 are routed but not counted.
    """
    xs, out = [f"x{i}" for i in range(features)], []
    for k in range(levels):
        b, h, c, d = (f"{name}{x}{k}" for x in ("", "h", "c", "d"))
        out += [
            f"{h} AS (SELECT tree, node, f, v, sum(m) AS w, sum(m * t) AS s FROM (SELECT tree, node, m, t, "
            f"unnest({list(range(features))}) AS f, unnest([{', '.join(xs)}]) AS v FROM {b} WHERE m > 0) GROUP BY ALL)",
            f"{c} AS (SELECT tree, node, f, v, sum(w) OVER p AS wl, sum(s) OVER p AS sl, sum(w) OVER a AS wa, "
            f"sum(s) OVER a AS sa, lead(v) OVER p AS nv FROM {h} WINDOW p AS (PARTITION BY tree, node, f ORDER BY v), "
            f"a AS (PARTITION BY tree, node, f))",
            f"{d} AS (SELECT tree, node, f, (v + nv) / 2 AS cut FROM {c} WHERE nv IS NOT NULL QUALIFY row_number() OVER "
            f"(PARTITION BY tree, node ORDER BY sl * sl / wl + (sa - sl) * (sa - sl) / (wa - wl) DESC, f, v) = 1)",
            f"{name}{k + 1} AS (SELECT {b}.* REPLACE (CASE WHEN f IS NULL THEN node ELSE 2 * node + "
            f"CAST(CASE f {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(xs))} END > cut AS INTEGER) END AS node) "
            f"FROM {b} LEFT JOIN {d} USING (tree, node))"]
    return ",\n".join(out)


def _draws_sql(trees: int, seed: int) -> str:
    """Each tree's factor and addend of the row hash."""
    values = ", ".join(f"({t}, {a}, {b})" for t, (a, b) in ((t, trees_.draw_constants(seed, t)) for t in range(trees)))
    return f"draws(tree, fa, fb) AS (VALUES {values})"


POISSON_SQL = " + ".join(f"CAST((rid * fa + fb) % 2147483647 >= {int(c)} AS INTEGER)" for c in trees_._POISSON)

TWO_TREES_SQL = f"""
WITH {TREE_ROWS_SQL}, {_draws_sql(2, 42)},
b0 AS (SELECT tree, r.*, y AS t, CAST({POISSON_SQL} AS DOUBLE) AS m, 1 AS node FROM r, draws),
{_levels_sql("b", 3)},
leaf AS (SELECT tree, node, sum(m * t) / sum(m) AS value FROM b3 WHERE m > 0 GROUP BY ALL)
SELECT o_orderkey, round(avg(value), 3) AS yhat FROM b3 JOIN leaf USING (tree, node) GROUP BY o_orderkey"""


def _tree_rows(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("double").alias("x0"),
        F.month("o_orderdate").cast("double").alias("x1"), (F.col("o_custkey") % 7).cast("double").alias("x2"),
        F.round("o_totalprice").alias("y"))


def _two_trees(spark, sf, **kw):
    rows = _tree_rows(spark, sf)
    model = trees_.fit_forest(rows, ["x0", "x1", "x2"], "y", ["o_orderkey"], trees=2, max_depth=3, seed=42, **kw)
    out = trees_.score_trees(rows, model, ["x0", "x1", "x2"])
    return out.select("o_orderkey", F.round("prediction", 3).alias("yhat"))


@query("forest_two_trees", sql=TWO_TREES_SQL)
def forest_two_trees(spark, sf):
    """M2 with two trees of three levels, each on its bootstrap sample; subtrees grown whole in their tasks."""
    return _two_trees(spark, sf)


@query("forest_two_trees_levels", sql=TWO_TREES_SQL)
def forest_two_trees_levels(spark, sf):
    """The same fit with every level as a histogram job over all rows."""
    return _two_trees(spark, sf, limit=0)


def _rounds_sql(rounds: int, levels: int, step: float, gradient: str, curvature: str, kept: str = "TRUE",
                features: int = 3) -> str:
    """CTEs ``p1 .. p<rounds>``: rows ``(key, y, w, score, x0, ...)`` of ``p0`` with their score after each round."""
    out = []
    for i in range(rounds):
        rows = f"SELECT {i} AS tree, p{i}.*, fa, fb FROM p{i}, draws WHERE draws.tree = {i}"
        out += [
            f"q{i}_0 AS (SELECT *, {gradient} AS t, {curvature} AS h, CASE WHEN {kept} THEN w ELSE 0 END AS m, 1 AS node "
            f"FROM ({rows}))",
            _levels_sql(f"q{i}_", levels, features),
            f"l{i} AS (SELECT node, sum(m * t) / sum(m * h) AS value FROM q{i}_{levels} WHERE m > 0 GROUP BY node)",
            f"p{i + 1} AS (SELECT q.* EXCLUDE (tree, fa, fb, t, h, m, node, score), score + {step} * value AS score "
            f"FROM q{i}_{levels} q JOIN l{i} USING (node))"]
    return ",\n".join(out)


@query("boosted_three_rounds", sql=f"""
WITH {TREE_ROWS_SQL}, {_draws_sql(3, 42)},
p0 AS (SELECT r.*, 1.0::DOUBLE AS w, avg(y) OVER () AS score FROM r),
{_rounds_sql(3, 2, 0.05, "y - score", "1.0::DOUBLE")}
SELECT o_orderkey, round(score, 3) AS yhat FROM p3""")
def boosted_three_rounds(spark, sf):
    """M3 with three rounds of depth two."""
    rows = _tree_rows(spark, sf)
    model = boosting.fit_boosted(rows, ["x0", "x1", "x2"], "y", ["o_orderkey"], rounds=3, depth=2)
    out = trees_.score_trees(rows, model, ["x0", "x1", "x2"])
    return out.select("o_orderkey", F.round("prediction", 3).alias("yhat"))


@query("boosted_classifier_three_rounds", sql=f"""
WITH {TREE_ROWS_SQL}, {_draws_sql(3, 42)},
c AS (SELECT r.* REPLACE (CAST(y > 150000 AS DOUBLE) AS y) FROM r),
p0 AS (SELECT c.*, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)) AS w, 0.0::DOUBLE AS score FROM c),
{_rounds_sql(3, 2, 0.05, "y - 1 / (1 + exp(-score))", "exp(-score) / (1 + exp(-score)) / (1 + exp(-score))",
             f"(rid * fa + fb) % 2147483647 < {int(0.8 * trees_.PRIME)}")}
SELECT o_orderkey, round(1 / (1 + exp(-score)), 6) AS prob FROM p3""")
def boosted_classifier_three_rounds(spark, sf):
    """M6 with three rounds of depth two on eight tenths of the rows each, balanced weights, Newton leaves."""
    rows = _tree_rows(spark, sf).withColumn("y", (F.col("y") > 150000).cast("double"))
    weighted, _ = ex.weighted(rows, "y")
    model = boosting.fit_boosted(weighted, ["x0", "x1", "x2"], "y", ["o_orderkey"], rounds=3, depth=2,
                                 loss=boosting.LOGISTIC, subsample=0.8, weight="weight")
    out = trees_.score_trees(rows, model, ["x0", "x1", "x2"], "score")
    return out.select("o_orderkey", F.round(1 / (1 + F.exp(-F.col("score"))), 6).alias("prob"))
