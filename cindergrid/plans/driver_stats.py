"""Driver-table queries for audit statistics, fitted preparation, sampling and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.operators import clean, metrics, panel, prep, sampling, stats
from cindergrid.plans import standins as si
from cindergrid.plans.registry import query
from cindergrid.session import materialize
from cindergrid.sources.tables import table

LAG_COLS = ["premium_lag1", "premium_lag2", "premium_yoy_change"]

LAG_PANEL_SQL = """
p AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS premium,
             count(*) AS exposure
      FROM orders GROUP BY ALL),
f AS (SELECT *, lag(premium, 1) OVER w AS premium_lag1, lag(premium, 2) OVER w AS premium_lag2,
             lag(premium, 1) OVER w - lag(premium, 2) OVER w AS premium_yoy_change,
             (lag(premium, 1) OVER w - lag(premium, 2) OVER w) / (abs(lag(premium, 2) OVER w) + 1)
               AS premium_pct_change
      FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY year)),
s AS (SELECT *, CASE WHEN year IN (1997, 1998, 1999) THEN 'train' WHEN year IN (2000) THEN 'test' END AS split
      FROM f WHERE year IN (1997, 1998, 1999, 2000))"""


def lag_panel(spark, sf):
    p = si.orders_panel(spark, sf)
    return panel.premium_features(p, ["o_custkey"], ["year"], "premium")


def split_lag_panel(spark, sf):
    return clean.temporal_split(lag_panel(spark, sf), "year", si.ORDER_TRAIN_YEARS, si.ORDER_TEST_YEARS,
                                labels=("train", "test"))


def _r(cols, n):
    return [F.round(c, n).alias(c) for c in cols]


# ------------------------------------------------------------------ imputation
@query("median_impute_train", sql=f"""
WITH {LAG_PANEL_SQL},
med AS (SELECT quantile_cont(premium_lag1, 0.5) AS m1, quantile_cont(premium_lag2, 0.5) AS m2,
               quantile_cont(premium_yoy_change, 0.5) AS m3 FROM s WHERE split = 'train')
SELECT o_custkey, year, split, round(coalesce(premium_lag1, m1), 4) AS premium_lag1,
       round(coalesce(premium_lag2, m2), 4) AS premium_lag2, round(coalesce(premium_yoy_change, m3), 4) AS premium_yoy_change
FROM s, med""")
def median_impute_train(spark, sf):
    """A3: exact train medians fill train and test."""
    s = split_lag_panel(spark, sf)
    train, test, _ = prep.impute_train_median(s.filter(F.col("split") == "train"),
                                              s.filter(F.col("split") == "test"), LAG_COLS)
    return train.unionByName(test).select("o_custkey", "year", "split", *_r(LAG_COLS, 4))


@query("median_impute_all", sql=f"""
WITH {LAG_PANEL_SQL},
med AS (SELECT quantile_cont(premium_lag1, 0.5) AS m1, quantile_cont(premium_lag2, 0.5) AS m2,
               quantile_cont(premium_yoy_change, 0.5) AS m3 FROM f)
SELECT o_custkey, year, round(premium, 4) AS premium, round(coalesce(premium_lag1, m1), 4) AS premium_lag1,
       round(coalesce(premium_lag2, m2), 4) AS premium_lag2, round(coalesce(premium_yoy_change, m3), 4) AS premium_yoy_change
FROM f, med""")
def median_impute_all(spark, sf):
    """A4: medians over all rows for the columns that have nulls (``scope="all"``)."""
    f, filled = prep.impute_all_rows(lag_panel(spark, sf), ["premium", *LAG_COLS])
    assert "premium" not in filled
    return f.select("o_custkey", "year", *_r(["premium", *LAG_COLS], 4))


@query("standardise", sql=f"""
WITH {LAG_PANEL_SQL},
fit AS (SELECT avg(premium) AS mp, stddev_pop(premium) AS sp, avg(CAST(exposure AS DOUBLE)) AS me,
               stddev_pop(CAST(exposure AS DOUBLE)) AS se FROM s WHERE split = 'train')
SELECT o_custkey, year, split, round((premium - mp) / CASE WHEN sp = 0 THEN 1 ELSE sp END, 6) AS premium,
       round((exposure - me) / CASE WHEN se = 0 THEN 1 ELSE se END, 6) AS exposure
FROM s, fit""")
def standardise(spark, sf):
    """Mean / population std fitted on train, applied to both splits."""
    s = split_lag_panel(spark, sf)
    params = prep.fit_scaler(s.filter(F.col("split") == "train"), ["premium", "exposure"])
    z = prep.apply_scaler(s.select("o_custkey", "year", "split", "premium", "exposure"), params)
    return z.select("o_custkey", "year", "split", *_r(["premium", "exposure"], 6))


@query("balanced_weights", sql="""
SELECT doc_id, toxic, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY toxic)), 6) AS weight
FROM labels""")
def balanced_weights(spark, sf):
    """N / (k * n_class) per row."""
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    return prep.balanced_weights(lab, "toxic").select("doc_id", "toxic", F.round("weight", 6).alias("weight"))


# ------------------------------------------------------------------- sampling
QUOTA_SQL = """
c AS (SELECT quality, count(*) AS n_c FROM labels GROUP BY quality),
t AS (SELECT sum(n_c) AS n FROM c),
q AS (SELECT quality, n_c, 100.0::DOUBLE * n_c / n AS raw, floor(100.0::DOUBLE * n_c / n) AS fl FROM c, t),
r AS (SELECT *, row_number() OVER (ORDER BY raw - fl DESC, quality) AS rr FROM q),
quota AS (SELECT quality, n_c, CAST(fl AS BIGINT) + CASE WHEN rr <= 100 - (SELECT sum(fl) FROM q) THEN 1 ELSE 0 END
            AS quota FROM r)"""


@query("stratified_sample", sql=f"""
WITH {QUOTA_SQL},
ranked AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42#' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
           FROM labels)
SELECT doc_id, quality FROM ranked JOIN quota USING (quality) WHERE rn <= quota""")
def stratified_sample(spark, sf):
    """R1 without replacement: 100 rows, class shares by largest remainder, md5 order."""
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return sampling.stratified_sample(lab, "quality", ["doc_id"], 100, seed=42)


@query("stratified_bootstrap", sql=f"""
WITH {QUOTA_SQL},
cq AS (SELECT quality, n_c, quota, sum(quota) OVER (ORDER BY quality) - quota AS start FROM quota),
d AS (SELECT range AS draw FROM range(100)),
dc AS (SELECT d.draw, cq.quality, d.draw - cq.start AS j, cq.n_c FROM d JOIN cq ON d.draw >= cq.start AND d.draw < cq.start + cq.quota),
pick AS (SELECT draw, quality,
                (('0x' || substring(md5('42#' || CAST(quality AS VARCHAR) || '#' || CAST(j AS VARCHAR)), 1, 15))::BIGINT % n_c) + 1 AS pos
         FROM dc),
ranked AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42#' || CAST(doc_id AS VARCHAR)), doc_id) AS pos
           FROM labels)
SELECT draw, quality, doc_id FROM pick JOIN ranked USING (quality, pos)""")
def stratified_bootstrap(spark, sf):
    """R1 with replacement (T8): 100 seeded draws, class quotas by largest remainder."""
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return sampling.stratified_bootstrap(lab, "quality", ["doc_id"], 100, seed=42).select("draw", "quality", "doc_id")


# --------------------------------------------------------------- MI + top-k
DOC_FEATURES_SQL = """
d AS (SELECT l.quality, CAST(d.n_chars AS DOUBLE) AS n_chars,
             CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS n_spaces,
             CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS DOUBLE) AS n_lines
      FROM labels l JOIN documents d USING (doc_id)),
long AS (SELECT quality, 'n_chars' AS feature, 0 AS position, n_chars AS v FROM d
         UNION ALL SELECT quality, 'n_spaces', 1, n_spaces FROM d
         UNION ALL SELECT quality, 'n_lines', 2, n_lines FROM d),
e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature),
b AS (SELECT l.feature, l.position, l.quality,
             least(floor((v - lo) / CASE WHEN hi > lo THEN (hi - lo) / 10.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS bin
      FROM long l JOIN e USING (feature)),
j AS (SELECT feature, position, bin, quality, CAST(count(*) AS DOUBLE) AS nxy FROM b GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bin) AS nx,
             sum(nxy) OVER (PARTITION BY feature, quality) AS ny FROM j),
mi AS (SELECT feature, position, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM m GROUP BY feature, position)"""

DOC_FEATURES = ["n_chars", "n_spaces", "n_lines"]


def doc_features(spark, sf):
    """Label + three whole-text features per labelled document.

    Deriving them reads every text in full, and MI reads the result twice
    (bin edges, then counts), so the small derived table is written once.
    """
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    d = lab.join(docs, "doc_id")
    t = F.col("text")
    return materialize(d.select(
        "doc_id", "quality", F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("double").alias("n_spaces"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("double").alias("n_lines")))


@query("mutual_information_topk", sql=f"""
WITH {DOC_FEATURES_SQL},
top AS (SELECT * FROM mi ORDER BY mi DESC, position LIMIT 2)
SELECT feature, position, round(mi, 6) AS mi FROM top""")
def mutual_information_topk(spark, sf):
    """A24 + L5: binned MI of three text features with ``quality``; keep the best 2 in column order."""
    mi = prep.mutual_information(doc_features(spark, sf), DOC_FEATURES, "quality", bins=10)
    return prep.select_k_best(mi, 2).select("feature", "position", F.round("mi", 6).alias("mi"))


MI_QUANTILE_SQL = """
d AS (SELECT l.quality, CAST(d.n_chars AS DOUBLE) AS n_chars,
             CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS n_spaces,
             CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS DOUBLE) AS n_lines
      FROM labels l JOIN documents d USING (doc_id)),
long AS (SELECT quality, 'n_chars' AS feature, 0 AS position, n_chars AS v FROM d
         UNION ALL SELECT quality, 'n_spaces', 1, n_spaces FROM d
         UNION ALL SELECT quality, 'n_lines', 2, n_lines FROM d),
e AS (SELECT feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM long GROUP BY feature),
b AS (SELECT l.feature, l.position, l.quality, len(list_filter(e.cuts, lambda c: c <= l.v)) AS bin
      FROM long l JOIN e USING (feature)),
j AS (SELECT feature, position, bin, quality, CAST(count(*) AS DOUBLE) AS nxy FROM b GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bin) AS nx,
             sum(nxy) OVER (PARTITION BY feature, quality) AS ny FROM j)
SELECT feature, position, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mi FROM m GROUP BY feature, position"""


@query("mutual_information_quantile", sql="WITH " + MI_QUANTILE_SQL)
def mutual_information_quantile(spark, sf):
    """A24 with quantile cuts: 10 bins at the exact deciles of each feature."""
    mi = prep.mutual_information(doc_features(spark, sf), DOC_FEATURES, "quality", bins=10, binning="quantile")
    return mi.select("feature", "position", F.round("mi", 6).alias("mi"))


@query("mutual_information", sql=f"""
WITH {DOC_FEATURES_SQL}
SELECT feature, position, round(mi, 6) AS mi FROM mi""")
def mutual_information(spark, sf):
    """MI score of every feature."""
    mi = prep.mutual_information(doc_features(spark, sf), DOC_FEATURES, "quality", bins=10)
    return mi.select("feature", "position", F.round("mi", 6).alias("mi"))


# ------------------------------------------------------------------ audit
@query("describe_exact", sql="""
SELECT feature, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
       round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max
FROM (SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem
      UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
      UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
WHERE v IS NOT NULL GROUP BY feature""")
def describe_exact(spark, sf):
    """Count, mean, sample std, min, exact quartiles, max per column."""
    li = table(spark, sf, "lineitem")
    d = stats.describe_exact(li, ["l_quantity", "l_extendedprice", "l_discount"])
    return d.select("feature", "count", *_r(["mean", "std", "min", "p25", "p50", "p75", "max"], 6))


@query("value_counts", sql="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_rows FROM orders GROUP BY 1 ORDER BY 1""")
def value_counts(spark, sf):
    """A5: rows per year, in year order."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    return stats.value_counts(o, "year")


@query("distinct_count", sql="""
SELECT count(DISTINCT o_custkey) AS n_distinct FROM orders""")
def distinct_count(spark, sf):
    """Exact distinct entities."""
    return stats.distinct_count(table(spark, sf, "orders"), "o_custkey")


@query("null_profile", sql=f"""
WITH {LAG_PANEL_SQL},
n AS (SELECT count(*) AS n_rows,
             count(*) FILTER (WHERE premium IS NULL) AS premium,
             count(*) FILTER (WHERE exposure IS NULL) AS exposure,
             count(*) FILTER (WHERE premium_lag1 IS NULL) AS premium_lag1,
             count(*) FILTER (WHERE premium_lag2 IS NULL) AS premium_lag2,
             count(*) FILTER (WHERE premium_yoy_change IS NULL) AS premium_yoy_change,
             count(*) FILTER (WHERE premium_pct_change IS NULL) AS premium_pct_change FROM f),
l AS (UNPIVOT n ON premium, exposure, premium_lag1, premium_lag2, premium_yoy_change, premium_pct_change
      INTO NAME "column" VALUE n_null)
SELECT "column", n_null, round(n_null * 100.0::DOUBLE / n_rows, 6) AS pct_null
FROM l WHERE n_null > 0 ORDER BY n_null DESC, "column" LIMIT 20""")
def null_profile(spark, sf):
    """Null count and share per column, columns with nulls only, top 20."""
    f = lag_panel(spark, sf)
    cols = ["premium", "exposure", "premium_lag1", "premium_lag2", "premium_yoy_change", "premium_pct_change"]
    prof = stats.null_profile(f, cols, top=20)
    return prof.select("column", "n_null", F.round("pct_null", 6).alias("pct_null"))


@query("correlation_with_target", sql=f"""
WITH {LAG_PANEL_SQL},
c AS (SELECT * FROM f WHERE premium_lag1 IS NOT NULL AND premium_lag2 IS NOT NULL AND premium IS NOT NULL)
SELECT feature, round(corr, 6) AS corr FROM (
  SELECT 'premium_lag1' AS feature, corr(premium_lag1, premium) AS corr FROM c
  UNION ALL SELECT 'premium_lag2', corr(premium_lag2, premium) FROM c
  UNION ALL SELECT 'exposure', corr(CAST(exposure AS DOUBLE), premium) FROM c)""")
def correlation_with_target(spark, sf):
    """Pearson correlation with the target after a listwise null drop."""
    f = lag_panel(spark, sf)
    c = stats.correlation_with_target(f, ["premium_lag1", "premium_lag2", "exposure"], "premium")
    return c.select("feature", F.round("corr", 6).alias("corr"))


HIST_SQL = """
x AS (SELECT {expr} AS x FROM orders),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM x WHERE x IS NOT NULL),
w AS (SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) / 60 ELSE 1.0::DOUBLE END AS width FROM mm),
c AS (SELECT CAST(least(floor((x - lo) / width), 59) AS INTEGER) AS bin, count(*) AS n_rows FROM x, w
      WHERE x IS NOT NULL GROUP BY 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(60))
SELECT b.bin, round(lo + b.bin * width, 6) AS bin_lo, round(lo + (b.bin + 1) * width, 6) AS bin_hi,
       coalesce(c.n_rows, 0) AS n_rows
FROM bins b CROSS JOIN w LEFT JOIN c USING (bin)"""

CLIP_AT = 400000.0


@query("histogram", sql="WITH " + HIST_SQL.format(
    expr="CASE WHEN o_totalprice > 400000.0::DOUBLE THEN 400000.0::DOUBLE ELSE o_totalprice END"))
def histogram(spark, sf):
    """A12 + P4: 60 equal-width bins of the upper-clipped order total."""
    o = table(spark, sf, "orders")
    h = stats.histogram(o, clean.clip_range("o_totalprice", upper=CLIP_AT), bins=60)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "n_rows")


@query("histogram_log", sql="WITH " + HIST_SQL.format(
    expr="ln(1 + CASE WHEN o_totalprice < 0 THEN 0.0::DOUBLE ELSE o_totalprice END)"))
def histogram_log(spark, sf):
    """A12 + P4: 60 bins of log1p of the lower-clipped order total."""
    o = table(spark, sf, "orders")
    h = stats.histogram(o, F.log1p(clean.clip_range("o_totalprice", lower=0.0)), bins=60)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "n_rows")


@query("class_balance", sql=f"""
WITH {LAG_PANEL_SQL}
SELECT split, count(*) AS n_rows, sum(CAST(premium > 500000 AS INTEGER))::DOUBLE AS n_positive,
       round(avg(CAST(premium > 500000 AS INTEGER)), 6) AS positive_rate
FROM s GROUP BY split""")
def class_balance(spark, sf):
    """Rows, positives and rate per split (label: yearly total above 500,000)."""
    s = split_lag_panel(spark, sf).withColumn("label", (F.col("premium") > 500000).cast("int"))
    b = stats.class_balance(s, "split", "label")
    return b.select("split", "n_rows", "n_positive", F.round("positive_rate", 6).alias("positive_rate"))


@query("feature_means", sql=f"""
WITH {LAG_PANEL_SQL}
SELECT feature, round(mean, 6) AS mean FROM (
  SELECT 'premium_lag1' AS feature, avg(premium_lag1) AS mean FROM f
  UNION ALL SELECT 'premium_lag2', avg(premium_lag2) FROM f
  UNION ALL SELECT 'has_history', avg(CAST(premium_lag1 IS NOT NULL AS INTEGER)) FROM f)""")
def feature_means(spark, sf):
    """Mean of the lags and rate of a 0/1 flag."""
    f = lag_panel(spark, sf).withColumn("has_history", F.col("premium_lag1").isNotNull().cast("int"))
    m = stats.column_means(f, ["premium_lag1", "premium_lag2", "has_history"])
    return m.select("feature", F.round("mean", 6).alias("mean"))


@query("score_summary", sql="""
WITH s AS (SELECT CAST(d.n_chars AS DOUBLE) AS n_chars, d.n_chars / (d.n_chars + 2000.0::DOUBLE) AS length_score
           FROM labels l JOIN documents d USING (doc_id))
SELECT feature, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
       round(stddev_samp(v), 6) AS std
FROM (SELECT 'n_chars' AS feature, n_chars AS v FROM s UNION ALL SELECT 'length_score', length_score FROM s)
GROUP BY feature""")
def score_summary(spark, sf):
    """Min, max, mean, sample std per score column."""
    s = si.scored_labels(spark, sf).select(
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("length_score"))
    out = stats.score_summary(s, ["n_chars", "length_score"])
    return out.select("feature", *_r(["min", "max", "mean", "std"], 6))


# ------------------------------------------------------------------ metrics
@query("regression_metrics", sql=f"""
WITH {LAG_PANEL_SQL},
med AS (SELECT quantile_cont(premium_lag1, 0.5) AS m1, quantile_cont(premium_lag2, 0.5) AS m2 FROM s WHERE split = 'train'),
pred AS (SELECT 'Naive (Lag-1)' AS model, premium AS y, coalesce(premium_lag1, m1) AS yhat FROM s, med WHERE split = 'test'
         UNION ALL
         SELECT 'Naive (Lag-2)', premium, coalesce(premium_lag2, m2) FROM s, med WHERE split = 'test')
SELECT 'A - orders panel' AS experiment, model, round(avg(abs(yhat - y)), 2) AS MAE,
       round(sqrt(avg((yhat - y) * (yhat - y))), 2) AS RMSE,
       round(1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*)), 4) AS R2,
       round(avg(abs(yhat - y) / (abs(y) + 1)) * 100, 2) AS MAPE
FROM pred GROUP BY model""")
def regression_metrics(spark, sf):
    """A16 + M0 + U3: naive last-value predictions (train-median imputed), metrics per model."""
    s = split_lag_panel(spark, sf)
    train, test, _ = prep.impute_train_median(s.filter(F.col("split") == "train"),
                                              s.filter(F.col("split") == "test"), ["premium_lag1", "premium_lag2"])
    preds = test.select(F.lit("Naive (Lag-1)").alias("model"), F.col("premium").alias("y"),
                        F.col("premium_lag1").alias("yhat")).unionByName(
        test.select(F.lit("Naive (Lag-2)").alias("model"), F.col("premium").alias("y"),
                    F.col("premium_lag2").alias("yhat")))
    preds = preds.withColumn("experiment", F.lit("A - orders panel"))
    return metrics.regression_metrics(preds, "y", "yhat", ["experiment", "model"],
                                      rounding={"MAE": 2, "RMSE": 2, "R2": 4, "MAPE": 2})


LABEL_SCORE_SQL = """
ls AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, CAST(d.n_chars AS DOUBLE) AS score,
              d.n_chars / (d.n_chars + 2000.0::DOUBLE) AS p1
       FROM labels l JOIN documents d USING (doc_id))"""


@query("confusion_metrics", sql=f"""
WITH {LABEL_SCORE_SQL},
c AS (SELECT count(*) FILTER (WHERE quality = 1 AND score >= 2000) AS tp,
             count(*) FILTER (WHERE quality <> 1 AND score >= 2000) AS fp,
             count(*) FILTER (WHERE quality = 1 AND NOT score >= 2000) AS fn FROM ls)
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def confusion_metrics(spark, sf):
    """Precision / recall / F1 of ``n_chars >= 2000`` against ``quality``."""
    s = si.scored_labels(spark, sf).withColumn("pred", (F.col("n_chars") >= 2000).cast("int"))
    m = metrics.confusion_metrics(s, "quality", "pred")
    return m.select("tp", "fp", "fn", *_r(["precision", "recall", "f1"], 6))


@query("roc_auc_exact", sql=f"""
WITH {LABEL_SCORE_SQL},
pos AS (SELECT score FROM ls WHERE quality = 1), neg AS (SELECT score FROM ls WHERE quality = 0)
SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS roc_auc
FROM pos p CROSS JOIN neg n""")
def roc_auc_exact(spark, sf):
    """Exact tie-aware ROC-AUC (oracle: the pairwise definition)."""
    m = metrics.ranking_metrics(si.scored_labels(spark, sf), "quality", "n_chars")
    return m.select(F.round("roc_auc", 6).alias("roc_auc"))


AP_SQL = """
g AS (SELECT {grp} score, sum(quality)::DOUBLE AS pos, sum(1 - quality)::DOUBLE AS neg FROM ls GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM g
      WINDOW w AS ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("average_precision", sql=f"""
WITH {LABEL_SCORE_SQL}, {AP_SQL.format(grp='', part='')}
SELECT round(sum(pos * cp / (cp + cn)) / sum(pos), 6) AS average_precision FROM c""")
def average_precision(spark, sf):
    """Average precision as the step sum (not the interpolated PR area)."""
    m = metrics.ranking_metrics(si.scored_labels(spark, sf), "quality", "n_chars")
    return m.select(F.round("average_precision", 6).alias("average_precision"))


@query("ranking_by_group", sql=f"""
WITH {LABEL_SCORE_SQL}, {AP_SQL.format(grp='lang,', part='PARTITION BY lang')},
auc AS (SELECT lang, round(sum(neg * (cp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
               round(sum(pos * cp / (cp + cn)) / sum(pos), 6) AS average_precision FROM c GROUP BY lang)
SELECT * FROM auc""")
def ranking_by_group(spark, sf):
    """A18 + A19 per group (document language)."""
    m = metrics.ranking_metrics(si.scored_labels(spark, sf), "quality", "n_chars", ["lang"])
    return m.select("lang", *_r(["roc_auc", "average_precision"], 6))


@query("weighted_log_loss", sql=f"""
WITH {LABEL_SCORE_SQL},
w AS (SELECT *, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY quality)) AS wt FROM ls)
SELECT round(avg(wt * -log2(greatest(CASE WHEN quality = 1 THEN p1 ELSE 1 - p1 END, 1e-10))), 6) AS log_loss FROM w""")
def weighted_log_loss(spark, sf):
    """Balanced-weight cross entropy (log base 2, probabilities clipped at 1e-10)."""
    s = si.scored_labels(spark, sf)
    p1 = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    s = s.withColumn("probs", F.array(F.lit(1.0) - p1, p1))
    weights = prep.class_weights(prep.class_counts(s, "quality"))
    out = metrics.weighted_log_loss(s, "quality", "probs", weights)
    return out.select(F.round("log_loss", 6).alias("log_loss"))


@query("loss_gradient", sql=f"""
WITH {LABEL_SCORE_SQL},
w AS (SELECT *, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY quality)) AS wt FROM ls)
SELECT doc_id, round((1 - p1 - CASE WHEN quality = 0 THEN 1 ELSE 0 END) * wt, 6) AS grad_0,
       round((p1 - CASE WHEN quality = 1 THEN 1 ELSE 0 END) * wt, 6) AS grad_1 FROM w""")
def loss_gradient(spark, sf):
    """Per-row gradient (p * sum(target) - target) * w of the weighted loss."""
    s = si.scored_labels(spark, sf)
    p1 = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    s = s.withColumn("probs", F.array(F.lit(1.0) - p1, p1))
    weights = prep.class_weights(prep.class_counts(s, "quality"))
    g = s.select("doc_id", metrics.loss_gradient("probs", "quality", 2, weights).alias("g"))
    return g.select("doc_id", F.round(F.col("g")[0], 6).alias("grad_0"), F.round(F.col("g")[1], 6).alias("grad_1"))
