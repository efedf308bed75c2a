"""Driver-table queries for kernels, report operators and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.functions.scalars import abbreviate_list, leading_code, lookup
from cindergrid.operators import clean, kernels, metrics, prep, report
from cindergrid.plans import standins as si
from cindergrid.plans.driver_stats import LAG_PANEL_SQL, split_lag_panel
from cindergrid.plans.registry import query
from cindergrid.sources.tables import table

N_LANDMARKS = 800  # as many as the models use
RBF_GAMMA = 0.5


# -------------------------------------------------------------------- kernels
def _kernel_query(kind: str):
    def run(spark, sf):
        emb = table(spark, sf, "embeddings")
        lm = kernels.collect_landmarks(emb, "vec_id", "embedding", N_LANDMARKS)
        k = kernels.kernel_long(emb, "vec_id", "embedding", lm, kind, gamma=RBF_GAMMA)
        return k.select("vec_id", "landmark_id", F.round("k", 6).alias("k"))
    run.__doc__ = f"J10: {kind} kernel of every embedding against {N_LANDMARKS} of them, chosen by seeded md5."
    return run


KERNEL_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
lm AS (SELECT vec_id AS landmark_id, x AS l FROM e ORDER BY md5('42#' || vec_id), vec_id LIMIT 800)
SELECT e.vec_id, lm.landmark_id, round({expr}, 6) AS k FROM e CROSS JOIN lm"""

KERNEL_EXPRS = {
    "linear": "list_inner_product(x, l)",
    "rbf": "exp(-0.5 * (list_inner_product(x, x) + list_inner_product(l, l) - 2 * list_inner_product(x, l)))",
    "cosine": "list_inner_product(x, l) / sqrt(list_inner_product(x, x) * list_inner_product(l, l))",
    "fidelity": "list_inner_product(x, l) * list_inner_product(x, l) / "
                "(list_inner_product(x, x) * list_inner_product(l, l))",
}

for _kind, _expr in KERNEL_EXPRS.items():
    query(f"kernel_{_kind}", sql=KERNEL_SQL.format(expr=_expr))(_kernel_query(_kind))


@query("kernel_fidelity_arrow", sql=KERNEL_SQL.format(expr=KERNEL_EXPRS["fidelity"]))
def kernel_fidelity_arrow(spark, sf):
    """J10 through the Arrow path (broadcast landmark matrix, one matmul per batch)."""
    emb = table(spark, sf, "embeddings")
    lm = kernels.collect_landmarks(emb, "vec_id", "embedding", N_LANDMARKS)
    k = kernels.kernel_long(emb, "vec_id", "embedding", lm, "fidelity")
    return k.select("vec_id", "landmark_id", F.round("k", 6).alias("k"))


# ------------------------------------------------------------ metric reports
SEGMENT_METRICS_SQL = f"""
{LAG_PANEL_SQL},
med AS (SELECT quantile_cont(premium_lag1, 0.5) AS m1, quantile_cont(premium_lag2, 0.5) AS m2 FROM s WHERE split = 'train'),
t AS (SELECT s.*, c.c_mktsegment AS experiment FROM s JOIN customer c ON s.o_custkey = c.c_custkey WHERE split = 'test'),
pred AS (SELECT experiment, 'Naive (Lag-1)' AS model, premium AS y, coalesce(premium_lag1, m1) AS yhat FROM t, med
         UNION ALL SELECT experiment, 'Naive (Lag-2)', premium, coalesce(premium_lag2, m2) FROM t, med),
met AS (SELECT experiment, model, round(avg(abs(yhat - y)), 2) AS MAE,
               round(sqrt(avg((yhat - y) * (yhat - y))), 2) AS RMSE,
               round(1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*)), 4) AS R2,
               round(avg(abs(yhat - y) / (abs(y) + 1)) * 100, 2) AS MAPE
        FROM pred GROUP BY experiment, model)"""


def segment_metrics(spark, sf):
    """Metrics table per (experiment = market segment, model) of the naive predictions."""
    s = split_lag_panel(spark, sf)
    train, test, _ = prep.impute_train_median(s.filter(F.col("split") == "train"),
                                              s.filter(F.col("split") == "test"), ["premium_lag1", "premium_lag2"])
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                               F.col("c_mktsegment").alias("experiment"))
    t = test.join(cust, "o_custkey")
    preds = report.stack_frames([
        t.select("experiment", F.lit("Naive (Lag-1)").alias("model"), F.col("premium").alias("y"),
                 F.col("premium_lag1").alias("yhat")),
        t.select("experiment", F.lit("Naive (Lag-2)").alias("model"), F.col("premium").alias("y"),
                 F.col("premium_lag2").alias("yhat"))])
    return metrics.regression_metrics(preds, "y", "yhat", ["experiment", "model"],
                                      rounding={"MAE": 2, "RMSE": 2, "R2": 4, "MAPE": 2})


@query("improvement_vs_baseline", sql=f"""
WITH {SEGMENT_METRICS_SQL},
one AS (SELECT * FROM met WHERE model = 'Naive (Lag-1)'),
base AS (SELECT min_by(MAE, experiment) AS b FROM one WHERE starts_with(experiment, 'A'))
SELECT experiment, MAE, round((b - MAE) / b * 100, 4) AS improvement_pct,
       CASE WHEN (b - MAE) / b * 100 > 0 THEN 'improved' ELSE 'no improvement' END AS direction,
       nullif(regexp_extract(experiment, '^([A-D])', 1), '') AS label
FROM one, base WHERE NOT starts_with(experiment, 'A')""")
def improvement_vs_baseline(spark, sf):
    """J7 + P18 + P20: one model's rows, MAE change against the experiment starting with 'A'."""
    one = segment_metrics(spark, sf).filter(F.col("model") == "Naive (Lag-1)")
    out = report.improvement_vs_baseline(one, "experiment", "MAE", F.col("experiment").startswith("A"))
    return out.select("experiment", "MAE", F.round("improvement_pct", 4).alias("improvement_pct"), "direction",
                      leading_code("experiment").alias("label"))


@query("pivot_compare", sql=f"""
WITH {SEGMENT_METRICS_SQL.replace("t AS (SELECT s.*, c.c_mktsegment AS experiment", "t AS (SELECT s.*, 'all' AS experiment")},
long AS (UNPIVOT met ON MAE, RMSE, R2, MAPE INTO NAME metric VALUE v)
SELECT metric, max(v) FILTER (WHERE model = 'Naive (Lag-1)') AS lag1,
       max(v) FILTER (WHERE model = 'Naive (Lag-2)') AS lag2,
       round(max(v) FILTER (WHERE model = 'Naive (Lag-2)') - max(v) FILTER (WHERE model = 'Naive (Lag-1)'), 4) AS delta
FROM long GROUP BY metric""")
def pivot_compare(spark, sf):
    """Metric x model side by side, with the difference column."""
    s = split_lag_panel(spark, sf)
    train, test, _ = prep.impute_train_median(s.filter(F.col("split") == "train"),
                                              s.filter(F.col("split") == "test"), ["premium_lag1", "premium_lag2"])
    preds = report.stack_frames([
        test.select(F.lit("lag1").alias("model"), F.col("premium").alias("y"), F.col("premium_lag1").alias("yhat")),
        test.select(F.lit("lag2").alias("model"), F.col("premium").alias("y"), F.col("premium_lag2").alias("yhat"))])
    met = metrics.regression_metrics(preds, "y", "yhat", ["model"],
                                     rounding={"MAE": 2, "RMSE": 2, "R2": 4, "MAPE": 2})
    long = met.unpivot(["model"], ["MAE", "RMSE", "R2", "MAPE"], "metric", "v")
    wide = report.side_by_side(long, "metric", "model", "v", ["lag1", "lag2"], {"delta": ("lag2", "lag1")})
    return wide.select("metric", "lag1", "lag2", F.round("delta", 4).alias("delta"))


@query("best_per_metric", sql=f"""
WITH {SEGMENT_METRICS_SQL},
one AS (SELECT *, row_number() OVER (ORDER BY experiment) AS ord FROM met WHERE model = 'Naive (Lag-1)'),
long AS (UNPIVOT one ON MAE, RMSE, R2, MAPE INTO NAME metric VALUE value),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, ord) AS rn FROM long WHERE value IS NOT NULL)
SELECT metric, experiment, value FROM r WHERE rn = 1""")
def best_per_metric(spark, sf):
    """For each metric the experiment with the largest value (first wins ties)."""
    one = segment_metrics(spark, sf).filter(F.col("model") == "Naive (Lag-1)")
    one = one.withColumn("ord", report.canonical_rank("experiment", sorted(
        ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])))
    best = report.best_per_metric(one, "experiment", ["MAE", "RMSE", "R2", "MAPE"], "ord")
    return best.select("metric", "experiment", "value")


@query("first_per_group", sql="""
SELECT event_type, event_id, user_id, value
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def first_per_group(spark, sf):
    """First row per group (hot groups reduced map-side with ``min_by``)."""
    ev = table(spark, sf, "events").select("event_type", "event_id", "user_id", "value")
    return report.first_per_group(ev, ["event_type"], ["event_id"]).select("event_type", "event_id", "user_id", "value")


@query("latest_record", sql="""
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL) WHERE rn = 1""")
def latest_record(spark, sf):
    """Newest row per entity among rows whose JSON carries the key ``k``."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "props")
    has_key = F.get_json_object("props", "$.k").isNotNull()
    out = report.latest_per_group(ev, ["user_id"], ["ts", "event_id"], has_key)
    return out.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                      "event_type")


FAMILY_SQL = """
fam AS (
  SELECT 'events' AS family, event_type AS name, count(*) AS n_rows, round(avg(value), 4) AS avg_value,
         NULL AS extra FROM events GROUP BY event_type
  UNION ALL
  SELECT 'orders', o_orderpriority, count(*), round(avg(o_totalprice), 4), NULL FROM orders GROUP BY o_orderpriority
  UNION ALL
  SELECT 'lineitem', l_returnflag, count(*), round(avg(l_extendedprice), 4), max(l_linestatus) FROM lineitem
  GROUP BY l_returnflag)"""


@query("canonical_order", sql=f"""
WITH {FAMILY_SQL}
SELECT family, name, n_rows, avg_value, coalesce(extra, '-') AS extra,
       CAST(CASE family WHEN 'lineitem' THEN 1 WHEN 'orders' THEN 2 WHEN 'events' THEN 3 ELSE 4 END AS INTEGER)
         AS family_rank
FROM fam""")
def canonical_order(spark, sf):
    """U2 + J8 + P21: three families stacked ('-' where a column does not apply),
    ranked by a fixed family order, rounded."""
    ev = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("avg_value")).withColumn("family", F.lit("events"))
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("o_totalprice").alias("avg_value")).withColumn("family", F.lit("orders"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("l_extendedprice").alias("avg_value"),
        F.max("l_linestatus").alias("extra")).withColumn("family", F.lit("lineitem"))
    rows = report.fill_not_applicable(report.stack_frames([ev, o, li]), ["extra"])
    rows = clean.round_columns(rows, {"avg_value": 4})
    ranked = report.canonical_order(rows, "family", ["lineitem", "orders", "events"], rank="family_rank",
                                    then=["name"], keep_rank=True)
    return ranked.select("family", "name", "n_rows", "avg_value", "extra", "family_rank")


@query("json_extract_default", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       coalesce(json_extract_string(props, '$.pr_auc'), 'n/a') AS pr_auc
FROM events""")
def json_extract_default(spark, sf):
    """Nested key with a default for a missing key."""
    ev = table(spark, sf, "events").select("event_id", "props")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                     F.coalesce(F.get_json_object("props", "$.pr_auc"), F.lit("n/a")).alias("pr_auc"))


# Fixed abbreviation map for the part-type stand-in.
PART_TYPE_ABBREV = {"MEDIUM": "MED", "STANDARD": "STD", "LARGE": "LG", "PROMO": "PRM"}


@query("feature_label_join", sql="""
SELECT p_partkey,
       concat_ws('; ', CASE p_type WHEN 'MEDIUM' THEN 'MED' WHEN 'STANDARD' THEN 'STD' WHEN 'LARGE' THEN 'LG'
                                   WHEN 'PROMO' THEN 'PRM' ELSE p_type END, p_brand) AS features
FROM part""")
def feature_label_join(spark, sf):
    """Scalar list formatting: abbreviate each item where a short name exists, join with '; '."""
    p = table(spark, sf, "part").select("p_partkey", F.array("p_type", "p_brand").alias("items"))
    return p.select("p_partkey", abbreviate_list("items", PART_TYPE_ABBREV).alias("features"))


# Fixed display labels for the event-type stand-in (other codes stay unlabelled).
EVENT_LABELS = {"click": "Click", "view": "Page view", "purchase": "Purchase"}


@query("label_lookup", sql="""
SELECT event_type, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'Page view'
                                   WHEN 'purchase' THEN 'Purchase' END AS label, count(*) AS n_rows
FROM events GROUP BY event_type""")
def label_lookup(spark, sf):
    """P20: code -> display label through a literal map; unmatched -> null."""
    ev = table(spark, sf, "events")
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows")) \
        .select("event_type", lookup("event_type", EVENT_LABELS).alias("label"), "n_rows")


@query("score_adapter", sql="""
SELECT CAST(trunc(TRY_CAST(zip AS DOUBLE)) AS INTEGER) AS ZIP, round(classical_risk_prob, 6) AS wildfire_risk_prob
FROM (SELECT CAST(s_nationkey AS VARCHAR) || '.0' AS zip, avg(s_acctbal) / 10000.0 AS classical_risk_prob
      FROM supplier GROUP BY s_nationkey HAVING count(*) >= 3)""")
def score_adapter(spark, sf):
    """P16 adapter (T12): scorer output ``(zip text, <model>_risk_prob)`` -> ``(ZIP int, wildfire_risk_prob)``."""
    scores = si.nation_risk(spark, sf).select(
        F.concat(F.col("nation_key").cast("string"), F.lit(".0")).alias("zip"),
        F.col("nation_risk").alias("classical_risk_prob"))
    a = clean.adapt_scores(scores, "zip", "classical_risk_prob", "ZIP", "wildfire_risk_prob")
    return a.select("ZIP", F.round("wildfire_risk_prob", 6).alias("wildfire_risk_prob"))


@query("chart_bounds", sql="""
WITH p AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS premium
           FROM orders GROUP BY ALL),
f AS (SELECT *, lag(premium, 1) OVER (PARTITION BY o_custkey ORDER BY year) AS premium_lag1 FROM p)
SELECT round(max(greatest(premium, premium_lag1)), 4) AS upper_bound,
       count(*) FILTER (WHERE year = 2000) AS n_kind FROM f""")
def chart_bounds(spark, sf):
    """Upper bound over actual and predicted (null-ignoring), and a conditional row count."""
    from cindergrid.operators import stats
    from cindergrid.plans.driver_stats import lag_panel
    f = lag_panel(spark, sf).withColumn("year_text", F.col("year").cast("string"))
    out = stats.chart_bounds(f, "premium", "premium_lag1", kind="year_text", kind_value="2000")
    return out.select(F.round("upper_bound", 4).alias("upper_bound"), "n_kind")


@query("predicted_class", sql="""
SELECT l.doc_id, CASE WHEN d.n_chars / (d.n_chars + 2000.0::DOUBLE) > 1 - d.n_chars / (d.n_chars + 2000.0::DOUBLE)
                      THEN 1 ELSE 0 END AS pred
FROM labels l JOIN documents d USING (doc_id)""")
def predicted_class(spark, sf):
    """argmax over class probabilities (first class wins ties)."""
    s = si.scored_labels(spark, sf)
    p1 = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    s = s.withColumn("probs", F.array(F.lit(1.0) - p1, p1))
    return s.select("doc_id", metrics.predicted_class("probs").alias("pred"))


@query("sorted_union_days", sql="""
WITH d AS (SELECT user_id, event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events),
a AS (SELECT user_id, list(DISTINCT day) FILTER (WHERE event_type = 'error') AS err,
             list(DISTINCT day) FILTER (WHERE event_type = 'purchase') AS buy FROM d GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(err, []), coalesce(buy, [])))), ',') AS days
FROM a""")
def sorted_union_days(spark, sf):
    """U4: per entity, the sorted union of two period lists (bounded by the calendar)."""
    from cindergrid.functions.scalars import sorted_union
    ev = table(spark, sf, "events").select("user_id", "event_type", F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"))
    a = ev.groupBy("user_id").agg(
        F.collect_set(F.when(F.col("event_type") == "error", F.col("day"))).alias("err"),
        F.collect_set(F.when(F.col("event_type") == "purchase", F.col("day"))).alias("buy"))
    return a.select("user_id", F.array_join(sorted_union("err", "buy"), ",").alias("days"))


@query("report_text", sql="""
WITH fam AS (SELECT o_orderpriority AS name, count(*) AS n_rows, avg(o_totalprice) AS avg_value
             FROM orders GROUP BY o_orderpriority)
SELECT name, rpad(name, 18, ' ') || ' ' || lpad(format('{:,.0f}', n_rows::DOUBLE), 8, ' ') || ' ' ||
             lpad(format('{:,.2f}', avg_value), 14, ' ') AS line
FROM fam""")
def report_text(spark, sf):
    """Printed-table formatting: padded names, thousands separators, fixed decimals."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("o_totalprice").alias("avg_value"))
    t = report.text_lines(o, [("name", 18, None), ("n_rows", 8, 0), ("avg_value", 14, 2)])
    return t.select("name", "line")


@query("run_log")
def run_log_query(spark, sf):
    """K5: one run document whose ``models`` map holds per-language ranking metrics."""
    m = metrics.ranking_metrics(si.scored_labels(spark, sf), "quality", "n_chars", ["lang"])
    return report.run_log(m, "lang", "length_ranking_by_language", 42, {"source_table": "labels"})
