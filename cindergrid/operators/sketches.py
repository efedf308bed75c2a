"""Mergeable sketches that are stored and united later.

A sketch is a binary column of bounded size: one row per group and column.
Sketches of new files or periods are united with stored ones, so old rows
are never read again.

* Quantiles (KLL): a value's rank is off by at most
  :func:`rank_error` of all rows, with a probability of 99 % for each
  question; the sketch draws at random, so two runs may differ within that.
* Distinct values (HLL): the estimate is off by at most
  :func:`count_error` of the truth, three standard errors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_error(k: int) -> float:
    """Rank error of a quantile sketch of size ``k``, merged or not, as a share of the rows."""
    return 2.296 / k ** 0.9021


def count_error(lg_size: int) -> float:
    """Three relative standard errors of a distinct count over ``2 ** lg_size`` registers, united or not."""
    return 3 * 1.04 / 2 ** (lg_size / 2)


def _long(df: DataFrame, group: Sequence[str], columns: Sequence[str], kind: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*group, F.explode(pairs).alias("__cg")).select(*group, "__cg.column", "__cg.value")


def quantile_sketches(df: DataFrame, group: Sequence[str], columns: Sequence[str], k: int = 800) -> DataFrame:
    """``(group..., column, n, sketch)``: one sketch per group and column over its values that aren't null or NaN.

    A group whose column holds no value has a null sketch and n 0.
    """
    rows = _long(df, group, columns, "double")
    value = F.when(~F.isnan("value"), F.col("value"))
    return rows.withColumn("value", value).groupBy(*group, "column").agg(
        F.count("value").alias("n"), F.when(F.count("value") > 0, F.kll_sketch_agg_double("value", F.lit(k))).alias("sketch"))


def merge_quantiles(sketches: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The sketches of a coarser grouping, without their rows."""
    there = sketches.where("sketch is not null")
    return there.groupBy(*group, "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles_of(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(..., share, value)`` of every sketch."""
    asked = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s)))
                               .alias("value")) for s in shares])
    rows = sketches.where("sketch is not null").withColumn("__cg", F.explode(asked))
    return rows.withColumns({"share": F.col("__cg.share"), "value": F.col("__cg.value")}).drop("sketch", "__cg")


def sketch_medians(sketches: DataFrame) -> dict[str, float]:
    """Column -> median, for :func:`cindergrid.operators.prep.apply_fill`; one row per column reaches the driver."""
    return {r["column"]: r["value"] for r in quantiles_of(merge_quantiles(sketches), [0.5]).collect()}


def distinct_sketches(df: DataFrame, group: Sequence[str], columns: Sequence[str], lg_size: int = 12) -> DataFrame:
    """``(group..., column, sketch)``: one sketch per group and column; nulls aren't counted."""
    rows = _long(df, group, columns, "string")
    return rows.groupBy(*group, "column").agg(F.hll_sketch_agg("value", F.lit(lg_size)).alias("sketch"))


def merge_distinct(sketches: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return sketches.groupBy(*group, "column").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_of(sketches: DataFrame, out: str = "estimate") -> DataFrame:
    return sketches.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")


def store(sketches: DataFrame, path: str, period: str) -> None:
    """Sketches by ``period``; writing a period again replaces it and leaves the others alone."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)
