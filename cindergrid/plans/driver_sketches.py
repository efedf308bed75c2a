"""Stored sketches over the driver tables; exact answers bound their error."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.operators import sketches
from cindergrid.plans.registry import query
from cindergrid.session import materialize
from cindergrid.sources.tables import table

SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]
K, LG_SIZE = 800, 12


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey", "o_totalprice")


@query("quantile_sketch_error", sql=f"""
SELECT unnest({SHARES})::DOUBLE AS share, n, TRUE AS within FROM (SELECT count(*) AS n FROM orders)""")
def quantile_sketch_error(spark, sf):
    """Quantiles from sketches of single years, united: the exact rank of each lies within the stated error."""
    rows = _orders(spark, sf)
    years = materialize(sketches.quantile_sketches(rows, ["year"], ["o_totalprice"], K))
    found = materialize(sketches.quantiles_of(sketches.merge_quantiles(years), SHARES))
    value = {r["share"]: r["value"] for r in found.collect()}
    ranks = rows.agg(*[x for i, s in enumerate(SHARES) for x in (
        (F.count_if(F.col("o_totalprice") < value[s]) / F.count(F.lit(1))).alias(f"lo{i}"),
        (F.count_if(F.col("o_totalprice") <= value[s]) / F.count(F.lit(1))).alias(f"hi{i}"))])
    checks = F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
                       for i, s in enumerate(SHARES)])
    exact = ranks.select(F.explode(checks).alias("c")).select(F.col("c.share").alias("of"), "c.lo", "c.hi")
    error = 2 * sketches.rank_error(K)  # every run stays inside, not 99 of 100
    return found.join(exact, F.col("share") == F.col("of")).select(
        "share", "n", ((F.col("lo") <= F.col("share") + error) & (F.col("hi") >= F.col("share") - error)).alias("within"))


@query("distinct_sketch_error", sql="""
SELECT count(DISTINCT year(o_orderdate)) AS years, count(DISTINCT o_custkey) AS n_distinct, TRUE AS within FROM orders""")
def distinct_sketch_error(spark, sf):
    """Customers counted by sketches of single years, united: within three standard errors of the exact count."""
    rows = _orders(spark, sf)
    years = materialize(sketches.distinct_sketches(rows, ["year"], ["o_custkey"], LG_SIZE))
    found = sketches.distinct_of(sketches.merge_distinct(years))
    exact = rows.agg(F.count_distinct("year").alias("years"), F.count_distinct("o_custkey").alias("n_distinct"))
    within = F.abs(F.col("estimate") - F.col("n_distinct")) <= F.col("n_distinct") * sketches.count_error(LG_SIZE)
    return exact.join(found).select("years", "n_distinct", within.alias("within"))
