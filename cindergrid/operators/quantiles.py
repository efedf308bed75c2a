"""Exact quantiles with linear interpolation (SQL ``percentile`` / ``quantile_cont``).

``percentile(c, p)`` is exact but keeps a value->count map per column in
one aggregation buffer; the final merge for a global quantile happens in
a single task and grows with the number of distinct values.  The
``distributed`` method here is exact and bounded per task:

1. unpivot the columns to ``(feature, value)`` and count each distinct value
   (map-side partial aggregation);
2. running counts along ``(feature, value)`` with the range-partitioned
   prefix sum (a column with many distinct values spans many tasks);
3. for each wanted position ``h = (n - 1) * p`` keep the two values that
   cover ``floor(h)`` and ``ceil(h)`` and interpolate.

There is one path for every size, so a result never depends on how many
values there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.operators.ordering import running_totals
from cindergrid.session import materialize

FEATURE = "feature"
VALUE = "value"


def unpivot_numeric(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
                    feature: str = FEATURE, value: str = VALUE, drop_nulls: bool = True) -> DataFrame:
    """Wide numeric columns -> long ``(ids..., feature, value double)`` (one ``stack``)."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    long = wide.unpivot(list(ids), list(cols), feature, value)
    return long.filter(F.col(value).isNotNull()) if drop_nulls else long


def _prob_name(p: float) -> str:
    return "q" + f"{p:.6f}".rstrip("0").rstrip(".").replace(".", "_")


def value_counts_long(df: DataFrame, cols: Sequence[str], materialized: bool = True) -> DataFrame:
    """``(feature, value, cnt)``: one scan of the source, partial-aggregated.

    Materialised (written once to the checkpoint folder) by default, since
    the quantile and moment steps read it several times.
    """
    counts = unpivot_numeric(df, cols).groupBy(FEATURE, VALUE).agg(F.count(F.lit(1)).alias("cnt"))
    return materialize(counts) if materialized else counts


def quantiles_from_counts(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles per feature from a ``(feature, value, cnt)`` table, by distributed selection."""
    names = [_prob_name(p) for p in probs]
    sizes = counts.groupBy(FEATURE).agg(F.sum("cnt").alias("n"))          # one row per column
    cum = running_totals(counts, [FEATURE], [VALUE], ["cnt"], prefix="cum_")
    # ``sizes`` has one row per requested column: a proven bound, so broadcast.
    cum = cum.join(F.broadcast(sizes), FEATURE).withColumn("before", F.col("cum_cnt") - F.col("cnt"))
    picks, wanted = [], None
    for p, nm in zip(probs, names):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        covers_lo = (F.col("before") <= lo) & (lo < F.col("cum_cnt"))
        covers_hi = (F.col("before") <= hi) & (hi < F.col("cum_cnt"))
        picks += [F.max(F.when(covers_lo, F.col(VALUE))).alias(f"{nm}__lo"),
                  F.max(F.when(covers_hi, F.col(VALUE))).alias(f"{nm}__hi"),
                  F.max(h - lo).alias(f"{nm}__frac")]
        wanted = (covers_lo | covers_hi) if wanted is None else (wanted | covers_lo | covers_hi)
    got = cum.filter(wanted).groupBy(FEATURE).agg(F.max("n").alias("n"), *picks)
    out = [F.col(FEATURE), F.col("n")]
    for nm in names:
        lo, hi, fr = F.col(f"{nm}__lo"), F.col(f"{nm}__hi"), F.col(f"{nm}__frac")
        out.append((lo + fr * (hi - lo)).alias(nm))
    return got.select(*out)


def quantiles_long(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per feature that has values: ``feature, n, q0_25, q0_5, ...``, exact.

    The source is read once into the value-count table.
    """
    return quantiles_from_counts(value_counts_long(df, cols), probs)


def column_quantiles(df: DataFrame, cols: Sequence[str], p: float = 0.5) -> dict:
    """Driver-side ``{column: quantile}`` (one small row per column); all-null columns -> None."""
    nm = _prob_name(p)
    rows = quantiles_long(df, cols, [p]).select(FEATURE, nm).collect()
    got = {r[FEATURE]: r[nm] for r in rows}
    return {c: got.get(c) for c in cols}
