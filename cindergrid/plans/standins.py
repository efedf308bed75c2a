"""Presets that map the reference's datasets onto the driver tables.

* premium panel (ZIP x Year, target, exposure)  -> ``orders`` by customer x year
* mixed weather/fire file (two row kinds)        -> ``events``: error rows are
  the "event" kind, the others carry the measure ``value``; entity = user,
  period = day
* external risk score                            -> ``supplier`` aggregated by nation
* scored validation set                          -> ``labels`` join ``documents``
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindergrid.functions.scalars import coerce_key_text
from cindergrid.operators import clean
from cindergrid.plans.wildfire import HistoryPanelSpec
from cindergrid.sources.tables import table

# Fixed parameters of the presets.
EVENT_GRID_DAYS = [dt.date(2024, 1, d) for d in range(1, 31)]
EVENT_TRAIN_DAYS = [dt.date(2024, 1, d) for d in range(3, 24)]
EVENT_TEST_DAYS = [dt.date(2024, 1, d) for d in range(24, 31)]
ORDER_TRAIN_YEARS = [1997, 1998, 1999]
ORDER_TEST_YEARS = [2000]
RETURN_FLAGS = ["A", "N", "R"]


def events_spec() -> HistoryPanelSpec:
    return HistoryPanelSpec(
        entity="user_key",
        period="day",
        measures={
            "avg_value": F.avg("value"),
            "min_value": F.min("value"),
            "max_value": F.max("value"),
            "sum_value": F.sum("value"),
        },
        measure_inputs=["value"],
        grid_periods=EVENT_GRID_DAYS,
        train_periods=EVENT_TRAIN_DAYS,
        test_periods=EVENT_TEST_DAYS,
        label="error_event",
        count="error_count",
        cumulative="cumulative_errors",
        ever="ever_had_error",
        derived={"value_range": F.col("max_value") - F.col("min_value")},
        measure_specs={"avg_value": ("avg", "value"), "min_value": ("min", "value"),
                       "max_value": ("max", "value"), "sum_value": ("sum", "value")},
        period_index=F.unix_date,
    )


def event_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """P6 + P7 + period: normalised key, day, then the two row kinds."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    ev = clean.normalise_key(ev.withColumn("user_key", coerce_key_text("user_id")), "user_key")
    ev = ev.withColumn("day", F.to_date("ts"))
    return clean.split_row_kinds(ev, F.col("event_type") == F.lit("error"))


def event_rows_single(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Both row kinds in one frame (normalised key, day) and the event predicate."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    ev = clean.normalise_key(ev.withColumn("user_key", coerce_key_text("user_id")), "user_key")
    return ev.withColumn("day", F.to_date("ts")), F.col("event_type") == F.lit("error")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x year panel: target = sum of order totals, exposure = order count."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("premium"), F.count(F.lit(1)).alias("exposure"))


def orders_loss_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x year panel with loss columns (discount amounts by return flag).

    Line items are reduced to one row per order before the join, so the
    join is order-to-order and the big side shuffles partial aggregates only.
    """
    li = table(spark, sf_dir, "lineitem")
    amount = F.col("l_extendedprice") * F.col("l_discount")
    per_order = li.groupBy("l_orderkey").agg(*[
        F.sum(F.when(F.col("l_returnflag") == f, amount)).alias(f"loss_{f.lower()}") for f in RETURN_FLAGS])
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    j = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
    return j.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("premium"), F.count(F.lit(1)).alias("exposure"),
        *[F.sum(f"loss_{f.lower()}").alias(f"loss_{f.lower()}") for f in RETURN_FLAGS])


def nation_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External score stand-in: nations with at least 3 suppliers, score =
    mean supplier balance / 10,000 (other nations are absent on purpose)."""
    s = table(spark, sf_dir, "supplier")
    return s.groupBy(F.col("s_nationkey").alias("nation_key")).agg(
        (F.avg("s_acctbal") / 10000.0).alias("nation_risk"), F.count(F.lit(1)).alias("n_suppliers")) \
        .filter(F.col("n_suppliers") >= 3).select("nation_key", "nation_risk")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation-set stand-in: label rows with the document length as score."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return lab.join(docs, "doc_id", "inner")
