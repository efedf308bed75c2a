"""The premium composites (W1, W2, W6) over a premium panel made of the driver tables.

``premium_raw`` gives orders the columns of the reference's panel file: one
row per customer (ZIP), year and priority category, with a target that is
negative at times, a loss that is null where there was none, and a
fire-risk score that some customers lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindergrid.plans import composites as W
from cindergrid.plans import presets as P
from cindergrid.plans.registry import query
from cindergrid.sources.tables import table

LOSS = P.PREMIUM_LOSS_COLS[0]
CATEGORIES = {"1": "Category_HO", "2": "Category_CO", "3": "Category_DO", "4": "Category_DT", "5": "Category_MH"}

RAW_SQL = f"""
lost AS (SELECT l_orderkey, sum(l_extendedprice * l_discount) AS loss FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
raw AS (
  SELECT o_custkey AS zip, CAST(year(o_orderdate) + 21 AS INTEGER) AS year, substr(o_orderpriority, 1, 1) AS cat,
         sum(o_totalprice) - 60000 AS premium, count(*)::DOUBLE AS exposure, sum(loss) AS loss,
         CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 100)::DOUBLE END AS fire
  FROM orders LEFT JOIN lost ON o_orderkey = l_orderkey GROUP BY ALL)"""


def premium_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("loss"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    rows = o.join(lost, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(
        F.col("o_custkey").alias("ZIP"), (F.year("o_orderdate") + 21).alias("Year"),
        F.substring("o_orderpriority", 1, 1).alias("cat")).agg(
        (F.sum("o_totalprice") - 60000).alias(P.PREMIUM_TARGET), F.count(F.lit(1)).cast("double").alias(P.PREMIUM_EXPOSURE),
        F.sum("loss").alias(LOSS))
    fire = F.when(F.col("ZIP") % 3 > 0, (F.col("ZIP") % 100).cast("double"))
    return rows.select("ZIP", "Year", P.PREMIUM_TARGET, P.PREMIUM_EXPOSURE, LOSS, fire.alias(P.FIRE_RISK_COL),
                       *[(F.col("cat") == k).alias(c) for k, c in CATEGORIES.items()])


def _category(df: DataFrame):
    return F.coalesce(*[F.when(F.col(c) == 1, F.lit(k)) for k, c in CATEGORIES.items()]).alias("cat")


@query("w1_clean_data", sql=f"""
WITH {RAW_SQL},
med AS (SELECT quantile_cont(loss, 0.5) AS ml, quantile_cont(fire, 0.5) AS mf FROM raw)
SELECT CASE WHEN year = 2021 THEN 'test' ELSE 'train' END AS split, zip, year, cat,
       round(greatest(premium, 0), 2) AS premium, round(coalesce(loss, ml), 4) AS loss, round(coalesce(fire, mf), 4) AS fire
FROM raw, med WHERE year BETWEEN 2018 AND 2021""")
def w1_clean_data(spark, sf):
    """Leakage columns, clipped target, one-hots, medians over all rows, temporal split."""
    df = premium_raw(spark, sf)
    train, test, _ = W.clean_data(df, [LOSS, P.FIRE_RISK_COL, P.PREMIUM_EXPOSURE])
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select("split", F.col("ZIP").alias("zip"), F.col("Year").alias("year"), _category(both),
                       F.round(P.PREMIUM_TARGET, 2).alias("premium"), F.round(F.col(f"`{LOSS}`"), 4).alias("loss"),
                       F.round(P.FIRE_RISK_COL, 4).alias("fire"))


@query("w2_premium_panel", sql=f"""
WITH {RAW_SQL},
c AS (SELECT zip, year, cat, greatest(premium, 0) AS premium, exposure, coalesce(loss, 0) AS loss FROM raw),
r AS (SELECT *, loss / (premium + 1) AS ratio, premium / (exposure + 1) AS per FROM c),
risk AS (SELECT c_custkey AS zip, c_acctbal / 10000 AS score FROM customer WHERE c_acctbal > 4000)
SELECT r.zip, year, cat, round(premium, 2) AS premium, round(lag(premium, 1) OVER w, 2) AS premium_lag1,
       round(lag(premium, 2) OVER w, 2) AS premium_lag2, round(lag(premium, 1) OVER w - lag(premium, 2) OVER w, 2) AS yoy,
       round(lag(ratio, 1) OVER w, 6) AS loss_ratio_lag1, round(lag(per, 1) OVER w, 4) AS per_lag1,
       round(coalesce(score, 0), 6) AS risk
FROM r LEFT JOIN risk ON r.zip = risk.zip WINDOW w AS (PARTITION BY r.zip, cat ORDER BY year)""")
def w2_premium_panel(spark, sf):
    """Clipped target, one-hots, lags per ZIP and category, and a joined risk score that ZIPs of low balance lack."""
    risk = table(spark, sf, "customer").where("c_acctbal > 4000").select(
        F.col("c_custkey").alias("ZIP"), (F.col("c_acctbal") / 10000).alias("wildfire_risk_prob"))
    df = W.premium_panel(premium_raw(spark, sf), risk, P.CLASSICAL_RISK_COL)
    return df.select(F.col("ZIP").alias("zip"), F.col("Year").alias("year"), _category(df),
                     F.round(P.PREMIUM_TARGET, 2).alias("premium"), F.round("premium_lag1", 2).alias("premium_lag1"),
                     F.round("premium_lag2", 2).alias("premium_lag2"), F.round("premium_yoy_change", 2).alias("yoy"),
                     F.round("loss_ratio_lag1", 6).alias("loss_ratio_lag1"), F.round("prem_per_exp_lag1", 4).alias("per_lag1"),
                     F.round(P.CLASSICAL_RISK_COL, 6).alias("risk"))


@query("w6_data_audit", sql=f"""
WITH {RAW_SQL},
v AS (SELECT 'risk' AS feature, fire AS x FROM raw UNION ALL SELECT 'target', premium FROM raw)
SELECT feature, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
       round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50,
       round(quantile_cont(x, 0.75), 4) AS p75, round(max(x), 4) AS max,
       count(*) FILTER (x IS NULL) AS n_null, count(*) FILTER (feature = 'target' AND x < 0) AS n_negative
FROM v GROUP BY feature""")
def w6_data_audit(spark, sf):
    """Exact describe of target and fire-risk score with their null and negative counts."""
    audit = W.data_audit(premium_raw(spark, sf))
    counts = audit["target_counts"].select(F.lit("target").alias("feature"), F.col("n_null_target").alias("n_null"),
                                           F.col("n_negative_target").alias("n_negative")).unionByName(
        audit["risk_nulls"].select(F.lit("risk").alias("feature"), F.col("n_null_risk").alias("n_null"),
                                   F.lit(0).cast("long").alias("n_negative")))
    rows = audit["target_describe"].unionByName(audit["risk_describe"]).join(F.broadcast(counts), "feature")
    return rows.select("feature", F.col("count").alias("n"),
                       *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
                       "n_null", "n_negative")
