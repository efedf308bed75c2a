"""Driver-table queries for scans, cleaning, panel building and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.functions.scalars import year_from_text
from cindergrid.operators import clean, joins, panel
from cindergrid.plans import standins as si
from cindergrid.plans import wildfire
from cindergrid.plans.registry import query
from cindergrid.sources.tables import table

# ------------------------------------------------------------------ SQL bits
EV_SQL = """
ev AS (
  SELECT CAST(CAST(trunc(TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE)) AS INTEGER) AS VARCHAR) AS user_key,
         CAST(ts AS DATE) AS day, event_type, value
  FROM events),
m AS (SELECT * FROM ev WHERE user_key IS NOT NULL AND NOT coalesce(event_type = 'error', false)),
e AS (SELECT * FROM ev WHERE user_key IS NOT NULL AND coalesce(event_type = 'error', false)),
agg AS (
  SELECT user_key, day, avg(value) AS avg_value, min(value) AS min_value,
         max(value) AS max_value, sum(value) AS sum_value
  FROM m
  WHERE day IS NOT NULL AND value IS NOT NULL AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-30'
  GROUP BY user_key, day),
flags AS (SELECT DISTINCT user_key, day FROM e WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-30'),
ds AS (
  SELECT a.*, CAST(CASE WHEN f.user_key IS NULL THEN 0 ELSE 1 END AS INTEGER) AS error_event
  FROM agg a LEFT JOIN flags f USING (user_key, day)),
grid AS (
  SELECT u.user_key, CAST(g.d AS DATE) AS day
  FROM (SELECT DISTINCT user_key FROM ds) u
  CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d) g),
cnt AS (SELECT user_key, day, count(*) AS error_count FROM e WHERE day IS NOT NULL GROUP BY user_key, day),
hist AS (
  SELECT g.user_key, g.day, CAST(coalesce(c.error_count, 0) AS BIGINT) AS error_count
  FROM grid g LEFT JOIN cnt c USING (user_key, day)),
feat AS (
  SELECT user_key, day, error_count,
         lag(error_count, 1, 0) OVER w AS error_count_lag1,
         lag(error_count, 2, 0) OVER w AS error_count_lag2,
         CAST(coalesce(sum(error_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
           AS cumulative_errors
  FROM hist WINDOW w AS (PARTITION BY user_key ORDER BY day))
"""

MEASURE_COLS_SQL = """round(avg_value, 6) AS avg_value, round(min_value, 6) AS min_value,
  round(max_value, 6) AS max_value, round(sum_value, 6) AS sum_value"""


def _measure_cols():
    return [F.round("avg_value", 6).alias("avg_value"), F.round("min_value", 6).alias("min_value"),
            F.round("max_value", 6).alias("max_value"), F.round("sum_value", 6).alias("sum_value")]


def _day(c="day"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


# ------------------------------------------------------------ scans/cleaning
@query("typed_scan_project", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_custkey AS customer_key,
       o_totalprice AS total_price, strftime(o_orderdate, '%Y-%m-%d') AS order_date
FROM orders""")
def typed_scan_project(spark, sf):
    """S8 + P2 + P16: keep the wanted columns that exist, rename, cast the key."""
    o = table(spark, sf, "orders")
    kept, missing = clean.select_available(o, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                               "o_clerk"])
    assert missing == ["o_clerk"], missing
    out = clean.rename_cast(kept, {"o_orderkey": "order_key", "o_custkey": "customer_key",
                                   "o_totalprice": "total_price", "o_orderdate": "order_date"},
                            {"order_key": "string"})
    return out.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query("drop_present_columns", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount + 0.0 AS l_discount, l_returnflag
FROM lineitem""")
def drop_present_columns(spark, sf):
    """Drop listed columns that exist; ``l_comment`` is not in the table."""
    li = clean.drop_present(table(spark, sf, "lineitem"), ["l_tax", "l_linestatus", "l_shipdate", "l_comment"])
    return li.withColumn("l_discount", F.col("l_discount") + F.lit(0.0))


@query("clip_negative_target", sql="""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal,
       CAST(c_acctbal < 0 AS INTEGER) AS was_negative
FROM customer""")
def clip_negative_target(spark, sf):
    """Clip the target at 0, keeping nulls; flag the clipped rows."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    c = c.withColumn("was_negative", (F.col("c_acctbal") < 0).cast("int"))
    return clean.clip_target(c, "c_acctbal", 0.0).select("c_custkey", "c_acctbal", "was_negative")


@query("conditional_counts", sql="""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_acctbal IS NULL) AS n_null_target,
       count(*) FILTER (WHERE c_acctbal < 0) AS n_negative_target
FROM customer""")
def conditional_counts(spark, sf):
    """A10: null and negative target counts in one pass."""
    c = table(spark, sf, "customer")
    return c.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("c_acctbal").isNull()).alias("n_null_target"),
                 F.count_if(F.col("c_acctbal") < 0).alias("n_negative_target"))


@query("coerce_key", sql="""
SELECT c_custkey, k AS zip_key
FROM (SELECT c_custkey,
             CAST(CAST(trunc(TRY_CAST(substring(c_name, 10) AS DOUBLE)) AS INTEGER) AS VARCHAR) AS k
      FROM customer)
WHERE k IS NOT NULL""")
def coerce_key(spark, sf):
    """Numeric text key -> canonical int text; failures dropped."""
    c = table(spark, sf, "customer").select("c_custkey", F.substring("c_name", 10, 1 << 20).alias("zip_key"))
    return clean.normalise_key(c, "zip_key")


@query("period_from_text", sql="""
SELECT o_orderkey, year_month, y AS year
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month,
             CAST(trunc(TRY_CAST(substring(strftime(o_orderdate, '%Y-%m'), 1, 4) AS DOUBLE)) AS INTEGER) AS y
      FROM orders)
WHERE y IS NOT NULL""")
def period_from_text(spark, sf):
    """P8 + P9 + P10: year from a ``YYYY-MM`` text, lenient, nulls dropped."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
    o = o.withColumn("year", year_from_text("year_month"))
    return clean.drop_nulls(o, ["year"])


@query("boolean_encode", sql="""
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_final,
       CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS is_urgent, o_totalprice
FROM orders""")
def boolean_encode(spark, sf):
    """P5: every boolean column -> 0/1."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("is_final"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"), "o_totalprice")
    return clean.encode_booleans(o)


@query("row_kind_split", sql="""
WITH ev AS (SELECT user_id, CAST(ts AS DATE) AS day, coalesce(event_type = 'error', false) AS is_event FROM events)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day,
       CASE WHEN is_event THEN 'event' ELSE 'measure' END AS row_kind, count(*) AS n_rows
FROM ev GROUP BY ALL""")
def row_kind_split(spark, sf):
    """P7 + P14 + A2: one scan split into two row kinds, counted per entity-period."""
    ev = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    measure, event = clean.split_row_kinds(ev, F.col("event_type") == "error")
    counts = [panel.event_counts(part, ["user_id", "day"], "n_rows").withColumn("row_kind", F.lit(kind))
              for kind, part in (("measure", measure), ("event", event))]
    out = counts[0].unionByName(counts[1])
    return out.select("user_id", _day(), "row_kind", "n_rows")


@query("temporal_split", sql="""
SELECT split, count(*) AS n_rows, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS n_positive,
       round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS positive_rate
FROM (SELECT *, CASE WHEN year(o_orderdate) IN (1997, 1998, 1999) THEN 'train'
                     WHEN year(o_orderdate) IN (2000) THEN 'test' END AS split FROM orders)
WHERE split IS NOT NULL GROUP BY split""")
def temporal_split_counts(spark, sf):
    """P11 + P12 + A13: strict temporal split, class balance per split."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"),
                                          (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    s = clean.temporal_split(o, "year", si.ORDER_TRAIN_YEARS, si.ORDER_TEST_YEARS, labels=("train", "test"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_positive"),
                                  F.round(F.avg("label"), 6).alias("positive_rate"))


# ------------------------------------------------------------- wildfire
@query("zip_year_aggregate", sql=f"""
WITH {EV_SQL}
SELECT user_key, strftime(day, '%Y-%m-%d') AS day, {MEASURE_COLS_SQL} FROM agg""")
def zip_year_aggregate(spark, sf):
    """A1 on the measure rows (P10, P11 first)."""
    measure, _ = si.event_rows(spark, sf)
    agg = wildfire.measure_panel(measure, si.events_spec())
    return agg.select("user_key", _day(), *_measure_cols())


@query("label_join", sql=f"""
WITH {EV_SQL}
SELECT user_key, strftime(day, '%Y-%m-%d') AS day, {MEASURE_COLS_SQL}, error_event FROM ds""")
def label_join(spark, sf):
    """J1 + P13: the measure panel is the universe; event flag left-joined, missing -> 0."""
    measure, event = si.event_rows(spark, sf)
    ds = wildfire.labelled_panel(measure, event, si.events_spec())
    return ds.select("user_key", _day(), *_measure_cols(), "error_event")


@query("dense_panel", sql=f"""
WITH {EV_SQL}
SELECT user_key, strftime(day, '%Y-%m-%d') AS day, error_count FROM hist""")
def dense_panel(spark, sf):
    """A7 + J6 + J2: distinct entities x every grid period, counts filled with 0."""
    spec = si.events_spec()
    measure, event = si.event_rows(spark, sf)
    ds = wildfire.labelled_panel(measure, event, spec)
    grid = panel.dense_grid(ds, spec.entity, spec.grid_periods, spec.period)
    counts = panel.event_counts(event, [spec.entity, spec.period], spec.count)
    return panel.attach_counts(grid, counts, [spec.entity, spec.period], spec.count) \
        .select("user_key", _day(), "error_count")


@query("grid_lags", sql=f"""
WITH {EV_SQL}
SELECT user_key, strftime(day, '%Y-%m-%d') AS day, error_count, error_count_lag1, error_count_lag2 FROM feat""")
def grid_lags(spark, sf):
    """Lag 1 and 2 on the dense grid, 0 before the grid starts."""
    spec = si.events_spec()
    measure, event = si.event_rows(spark, sf)
    hist = wildfire.history_grid(wildfire.labelled_panel(measure, event, spec), event, spec)
    return hist.select("user_key", _day(), "error_count", "error_count_lag1", "error_count_lag2")


@query("running_total_flag", sql=f"""
WITH {EV_SQL}
SELECT user_key, strftime(day, '%Y-%m-%d') AS day, error_count, cumulative_errors,
       CAST(cumulative_errors > 0 AS INTEGER) AS ever_had_error FROM feat""")
def running_total_flag(spark, sf):
    """N6 + P15: exclusive running total from the first grid period, and the ever flag."""
    spec = si.events_spec()
    measure, event = si.event_rows(spark, sf)
    hist = wildfire.history_grid(wildfire.labelled_panel(measure, event, spec), event, spec)
    return hist.select("user_key", _day(), "error_count", "cumulative_errors", "ever_had_error")


WILDFIRE_SQL = f"""
WITH {EV_SQL},
tgt AS (SELECT * FROM feat WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-30'),
full_ds AS (
  SELECT ds.*, coalesce(t.error_count_lag1, 0) AS error_count_lag1, coalesce(t.error_count_lag2, 0) AS error_count_lag2,
         coalesce(t.cumulative_errors, 0) AS cumulative_errors,
         CAST(coalesce(t.cumulative_errors, 0) > 0 AS INTEGER) AS ever_had_error
  FROM ds LEFT JOIN tgt t USING (user_key, day))
SELECT user_key, strftime(day, '%Y-%m-%d') AS day, {MEASURE_COLS_SQL}, error_event,
       error_count_lag1, error_count_lag2, cumulative_errors, ever_had_error,
       round(max_value - min_value, 6) AS value_range,
       CASE WHEN day <= DATE '2024-01-23' THEN 'train' ELSE 'validation' END AS split
FROM full_ds"""


def wildfire_panel_df(spark, sf):
    """W0 in the single-scan form (one aggregate, range-frame history features)."""
    rows, is_event = si.event_rows_single(spark, sf)
    return wildfire.history_panel_single_scan(rows, is_event, si.events_spec())


@query("wildfire_panel_grid", sql=WILDFIRE_SQL)
def wildfire_panel_grid(spark, sf):
    """W0 in the step-by-step form (split kinds, dense grid, row lags, join back)."""
    measure, event = si.event_rows(spark, sf)
    ds = wildfire.history_panel(measure, event, si.events_spec())
    return ds.select("user_key", _day(), *_measure_cols(), "error_event", "error_count_lag1", "error_count_lag2",
                     "cumulative_errors", "ever_had_error", F.round("value_range", 6).alias("value_range"), "split")


@query("wildfire_panel", sql=WILDFIRE_SQL)
def wildfire_panel(spark, sf):
    """W0 end to end (flagship)."""
    ds = wildfire_panel_df(spark, sf)
    return ds.select("user_key", _day(), *_measure_cols(), "error_event", "error_count_lag1", "error_count_lag2",
                     "cumulative_errors", "ever_had_error", F.round("value_range", 6).alias("value_range"), "split")


# ------------------------------------------------------ premium-panel windows
PANEL_SQL = """
p AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS premium,
             count(*) AS exposure
      FROM orders GROUP BY ALL)"""


@query("panel_lag_features", sql=f"""
WITH {PANEL_SQL},
f AS (SELECT *, lag(premium, 1) OVER w AS l1, lag(premium, 2) OVER w AS l2
      FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY year))
SELECT o_custkey, year, round(premium, 4) AS premium, round(l1, 4) AS premium_lag1,
       round(l2, 4) AS premium_lag2, round(l1 - l2, 4) AS premium_yoy_change,
       round((l1 - l2) / (abs(l2) + 1), 6) AS premium_pct_change
FROM f""")
def panel_lag_features(spark, sf):
    """N1 + N2 on the customer x year panel (one row per entity-period)."""
    p = si.orders_panel(spark, sf)
    f = panel.premium_features(p, ["o_custkey"], ["year"], "premium")
    return f.select("o_custkey", "year", *[F.round(c, 4).alias(c) for c in
                                          ("premium", "premium_lag1", "premium_lag2", "premium_yoy_change")],
                    F.round("premium_pct_change", 6).alias("premium_pct_change"))


@query("row_lag_ties", sql="""
SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice,
       lag(o_totalprice, 1) OVER w AS o_totalprice_lag1, lag(o_totalprice, 2) OVER w AS o_totalprice_lag2
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey)""")
def row_lag_ties(spark, sf):
    """N1 in the row form (T1): several rows per entity-period, total order by
    (year, order key); the skew-safe ranged strategy (a hot customer is
    spread over many tasks)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"),
                                          "o_totalprice")
    return panel.lag_features(o, ["o_custkey"], ["year", "o_orderkey"], {"o_totalprice": [1, 2]},
                              strategy="ranged")


LOSS_SQL = """
per_order AS (
  SELECT l_orderkey,
         sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * l_discount END) AS loss_a,
         sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice * l_discount END) AS loss_n,
         sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount END) AS loss_r
  FROM lineitem GROUP BY l_orderkey),
lp AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS premium, count(*) AS exposure,
         sum(loss_a) AS loss_a, sum(loss_n) AS loss_n, sum(loss_r) AS loss_r
  FROM orders o LEFT JOIN per_order l ON o.o_orderkey = l.l_orderkey GROUP BY ALL),
lr AS (
  SELECT *, (coalesce(loss_a, 0.0) + coalesce(loss_n, 0.0) + coalesce(loss_r, 0.0)) / (premium + 1) AS loss_ratio
  FROM lp)"""


@query("loss_ratio_lag", sql=f"""
WITH {LOSS_SQL}
SELECT o_custkey, year, round(loss_ratio, 8) AS loss_ratio,
       round(lag(loss_ratio, 1) OVER (PARTITION BY o_custkey ORDER BY year), 8) AS loss_ratio_lag1
FROM lr""")
def loss_ratio_lag(spark, sf):
    """(sum of loss columns, null as 0) / (target + 1), then lag 1."""
    p = si.orders_loss_panel(spark, sf)
    f = panel.premium_features(p, ["o_custkey"], ["year"], "premium",
                               loss_cols=[f"loss_{x.lower()}" for x in si.RETURN_FLAGS])
    return f.select("o_custkey", "year", F.round("loss_ratio", 8).alias("loss_ratio"),
                    F.round("loss_ratio_lag1", 8).alias("loss_ratio_lag1"))


@query("per_exposure_lag", sql=f"""
WITH {PANEL_SQL}
SELECT o_custkey, year, exposure, round(premium / (exposure + 1), 6) AS premium_per_exposure,
       round(lag(premium / (exposure + 1), 1) OVER (PARTITION BY o_custkey ORDER BY year), 6)
         AS premium_per_exposure_lag1
FROM p""")
def per_exposure_lag(spark, sf):
    """Target / (exposure + 1), then lag 1."""
    p = si.orders_panel(spark, sf)
    f = panel.premium_features(p, ["o_custkey"], ["year"], "premium", exposure="exposure")
    return f.select("o_custkey", "year", "exposure",
                    F.round("premium_per_exposure", 6).alias("premium_per_exposure"),
                    F.round("premium_per_exposure_lag1", 6).alias("premium_per_exposure_lag1"))


@query("all_features", sql=f"""
WITH {LOSS_SQL},
f AS (SELECT *, lag(premium, 1) OVER w AS l1, lag(premium, 2) OVER w AS l2,
             lag(loss_ratio, 1) OVER w AS lrl1, lag(premium / (exposure + 1), 1) OVER w AS pel1
      FROM lr WINDOW w AS (PARTITION BY o_custkey ORDER BY year))
SELECT o_custkey, year, round(premium, 4) AS premium, round(l1, 4) AS premium_lag1, round(l2, 4) AS premium_lag2,
       round(l1 - l2, 4) AS premium_yoy_change, round((l1 - l2) / (abs(l2) + 1), 6) AS premium_pct_change,
       round(loss_ratio, 8) AS loss_ratio, round(lrl1, 8) AS loss_ratio_lag1,
       round(premium / (exposure + 1), 6) AS premium_per_exposure, round(pel1, 6) AS premium_per_exposure_lag1
FROM f""")
def all_features(spark, sf):
    """N1-N4 in one select over one window spec (one shuffle, one sort)."""
    p = si.orders_loss_panel(spark, sf)
    f = panel.premium_features(p, ["o_custkey"], ["year"], "premium",
                               loss_cols=[f"loss_{x.lower()}" for x in si.RETURN_FLAGS], exposure="exposure")
    r4 = ("premium", "premium_lag1", "premium_lag2", "premium_yoy_change")
    return f.select("o_custkey", "year", *[F.round(c, 4).alias(c) for c in r4],
                    F.round("premium_pct_change", 6).alias("premium_pct_change"),
                    F.round("loss_ratio", 8).alias("loss_ratio"), F.round("loss_ratio_lag1", 8).alias("loss_ratio_lag1"),
                    F.round("premium_per_exposure", 6).alias("premium_per_exposure"),
                    F.round("premium_per_exposure_lag1", 6).alias("premium_per_exposure_lag1"))


# ------------------------------------------------------------ external score
RISK_SQL = """
risk AS (SELECT s_nationkey AS nation_key, avg(s_acctbal) / 10000.0 AS nation_risk
         FROM supplier GROUP BY s_nationkey HAVING count(*) >= 3),
pn AS (SELECT p.*, c.c_nationkey AS nation_key FROM p JOIN customer c ON p.o_custkey = c.c_custkey)"""


@query("risk_merge", sql=f"""
WITH {PANEL_SQL}, {RISK_SQL}
SELECT o_custkey, year, nation_key, round(coalesce(r.nation_risk, 0.0), 6) AS nation_risk
FROM pn LEFT JOIN risk r USING (nation_key)""")
def risk_merge(spark, sf):
    """Left join an external score on the key only; missing -> 0; duplicate keys rejected."""
    p = si.orders_panel(spark, sf)
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                               F.col("c_nationkey").alias("nation_key"))
    pn = p.join(cust, "o_custkey", "inner")
    merged = joins.merge_score(pn, si.nation_risk(spark, sf), ["nation_key"], "nation_risk")
    return merged.select("o_custkey", "year", "nation_key", F.round("nation_risk", 6).alias("nation_risk"))


@query("risk_match_report", sql=f"""
WITH {PANEL_SQL}, {RISK_SQL}
SELECT count(*) FILTER (WHERE nation_key IN (SELECT nation_key FROM pn)) AS matched_keys,
       count(*) AS score_keys
FROM risk""")
def risk_match_report(spark, sf):
    """Score keys found in the panel, of all score keys."""
    p = si.orders_panel(spark, sf)
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                               F.col("c_nationkey").alias("nation_key"))
    return joins.match_report(si.nation_risk(spark, sf), p.join(cust, "o_custkey"), ["nation_key"])


@query("dense_grid_keys", sql=f"""
WITH {EV_SQL}
SELECT count(*) AS grid_rows, count(DISTINCT user_key) AS n_entities, count(DISTINCT day) AS n_periods FROM grid""")
def dense_grid_keys(spark, sf):
    """A7 + J6 invariant: grid rows = distinct entities x periods."""
    spec = si.events_spec()
    measure, event = si.event_rows(spark, sf)
    grid = panel.dense_grid(wildfire.labelled_panel(measure, event, spec), spec.entity, spec.grid_periods,
                            spec.period)
    return grid.agg(F.count(F.lit(1)).alias("grid_rows"), F.count_distinct("user_key").alias("n_entities"),
                    F.count_distinct("day").alias("n_periods"))

