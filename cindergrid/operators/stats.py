"""Audit statistics.

All of them are one or two aggregate jobs; wide column sets are unpivoted
once (``stack``) instead of running one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.operators.quantiles import FEATURE, VALUE, quantiles_long, unpivot_numeric


def value_counts(df: DataFrame, c: str, name: str = "n_rows") -> DataFrame:
    """A5: rows per value (``value_counts().sort_index()``)."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(name)).orderBy(c)


def distinct_count(df: DataFrame, c: str, approx: bool = False, name: str = "n_distinct") -> DataFrame:
    """Exact ``count(DISTINCT)`` (two-phase, partial-aggregated) or HLL++."""
    agg = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    return df.agg(agg.alias(name))


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values as a table."""
    return df.select(*cols).distinct()


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per column (long form).

    Count, moments and extremes are one partial aggregate with no value
    shuffled; only the quartiles need the value counts.  ``std`` of a single
    value is null, as in pandas; a column without values has count 0 and nulls.
    ``DataFrame.summary()`` uses approximate percentiles, so it is not used.
    """
    parts = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    value = {c: F.col(c).cast("double") for c in cols}
    wide = df.agg(*[F.count(value[c]).alias(f"count_{i}") for i, c in enumerate(cols)],
                  *[fn(value[c]).alias(f"{name}_{i}") for i, c in enumerate(cols) for name, fn in parts.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias(FEATURE), F.col(f"count_{i}").alias("count"),
                                        *[F.col(f"{name}_{i}").alias(name) for name in parts])
                               for i, c in enumerate(cols)])).alias("r")
    q = quantiles_long(df, cols, [0.25, 0.5, 0.75])
    # one row per column on either side
    out = wide.select(rows).select("r.*").join(F.broadcast(q), FEATURE, "left")
    return out.select(FEATURE, "count", "mean", "std", "min", F.col("q0_25").alias("p25"), F.col("q0_5").alias("p50"),
                      F.col("q0_75").alias("p75"), "max")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, top: int | None = 20) -> DataFrame:
    """Null count and % per column, only columns with nulls, most first, top ``top``."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__cg_n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["__cg_n"], cols, "column", "n_null")
    out = long.filter(F.col("n_null") > 0).select(
        "column", "n_null", (F.col("n_null") * 100.0 / F.col("__cg_n")).alias("pct_null"))
    out = out.orderBy(F.desc("n_null"), F.asc("column"))
    return out.limit(top) if top else out


def correlation_with_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each feature with the target after a
    listwise null drop, strongest first (one aggregate job)."""
    clean = df.select(*features, target).dropna()
    wide = clean.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in features])
    return wide.unpivot([], list(features), "feature", "corr").orderBy(F.desc_nulls_last("corr"), "feature")


def histogram(df: DataFrame, c: str | Column, bins: int = 60, lower: float | None = None,
              upper: float | None = None) -> DataFrame:
    """``bins`` equal-width bins over [min, max] (last bin closed), empty bins included.

    Edges come from one min/max aggregate; counting is a partial-aggregated
    ``groupBy(bin)``; the bin list itself is ``spark.range(bins)``.
    """
    x = F.col(c) if isinstance(c, str) else c
    vals = df.select(x.cast("double").alias("x")).filter(F.col("x").isNotNull())
    if lower is None or upper is None:
        mm = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        lower = mm["lo"] if lower is None else lower
        upper = mm["hi"] if upper is None else upper
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lower is None:  # no data
        return all_bins.select("bin", F.lit(None).cast("double").alias("bin_lo"),
                               F.lit(None).cast("double").alias("bin_hi"), F.lit(0).cast("long").alias("n_rows"))
    width = (upper - lower) / bins if upper > lower else 1.0
    idx = F.least(F.floor((F.col("x") - F.lit(lower)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = vals.filter((F.col("x") >= lower) & (F.col("x") <= upper)) \
        .groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    out = all_bins.join(F.broadcast(counts), "bin", "left")  # at most ``bins`` rows
    return out.select("bin", (F.lit(lower) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                      (F.lit(lower) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                      F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"))


def class_balance(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows, positives and positive rate per split."""
    y = F.col(label).cast("double")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(y).alias("n_positive"),
                                 F.avg(y).alias("positive_rate"))


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each column (rates for 0/1 flags), long form."""
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "feature", "mean")


def score_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min, max, mean, sample std per score column."""
    long = unpivot_numeric(df, cols)
    return long.groupBy(FEATURE).agg(F.min(VALUE).alias("min"), F.max(VALUE).alias("max"),
                                     F.avg(VALUE).alias("mean"), F.stddev_samp(VALUE).alias("std"))


def chart_bounds(df: DataFrame, actual: str, predicted: str, kind: str | None = None,
                 kind_value: str | None = None) -> DataFrame:
    """Max over actual and predicted, plus a conditional row count."""
    aggs = [F.max(F.greatest(F.col(actual), F.col(predicted))).alias("upper_bound")]
    if kind is not None:
        aggs.append(F.count_if(F.col(kind) == F.lit(kind_value)).alias("n_kind"))
    return df.agg(*aggs)
