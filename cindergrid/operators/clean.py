"""Projections, filters and cleaning steps.

Each function is a narrow transformation: no shuffle, and filters stay
above the scan so Catalyst can push them into parquet.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.functions.scalars import clip_lower, clip_upper, coerce_int, coerce_key_text, col_of, lookup


def drop_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist; names that do not exist are ignored."""
    present = [n for n in names if n in df.columns]
    return df.drop(*present)


def select_available(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep the requested columns that exist (in request order); return the missing ones."""
    have = set(df.columns)
    available = [c for c in wanted if c in have]
    missing = [c for c in wanted if c not in have]
    return df.select(*available), missing


def clip_target(df: DataFrame, target: str, lower: float = 0.0) -> DataFrame:
    """Values below ``lower`` become ``lower``; null stays null."""
    return df.withColumn(target, clip_lower(target, lower))


def clip_range(c: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Null-keeping clip at either or both ends."""
    out = col_of(c)
    if lower is not None:
        out = clip_lower(out, lower)
    if upper is not None:
        out = clip_upper(out, upper)
    return out


def encode_booleans(df: DataFrame) -> DataFrame:
    """P5: every boolean column -> 0/1 int."""
    bools = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
    if not bools:
        return df
    return df.select(*[(F.col(c).cast("int").alias(c) if c in bools else F.col(c)) for c in df.columns])


def normalise_key(df: DataFrame, key: str, out: str | None = None) -> DataFrame:
    """Coerce a dirty numeric key to canonical integer text and drop failures."""
    out = out or key
    return df.withColumn(out, coerce_key_text(key)).filter(F.col(out).isNotNull())


def split_row_kinds(df: DataFrame, is_event: Column) -> tuple[DataFrame, DataFrame]:
    """One scan, two row kinds: (measure rows, event rows).

    In the reference the marker is a nullable id column; any boolean
    predicate works.  Null predicate values count as measure rows.
    """
    flag = F.coalesce(is_event, F.lit(False))
    return df.filter(~flag), df.filter(flag)


def coerce_int_column(df: DataFrame, c: str, out: str | None = None, drop_invalid: bool = True) -> DataFrame:
    """Lenient numeric coercion to int, optionally dropping failures (P10)."""
    out = out or c
    df = df.withColumn(out, coerce_int(c))
    return df.filter(F.col(out).isNotNull()) if drop_invalid else df


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P10: listwise (``subset=None``) or per-column null drop."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def keep_periods(df: DataFrame, period: str, periods: Sequence) -> DataFrame:
    """Membership filter (pushed to the scan where the column is stored)."""
    return df.filter(F.col(period).isin(list(periods)))


def temporal_split(df: DataFrame, period: str, train_periods: Sequence, test_periods: Sequence,
                   split_col: str = "split", labels: tuple[str, str] = ("train", "test")) -> DataFrame:
    """P12 as one column: ``train`` / ``test``; rows in neither list are dropped."""
    tr, te = list(train_periods), list(test_periods)
    overlap = set(tr) & set(te)
    if overlap:
        raise ValueError(f"train and test periods overlap: {sorted(overlap)}")
    split = F.when(F.col(period).isin(tr), F.lit(labels[0])).when(F.col(period).isin(te), F.lit(labels[1]))
    return df.withColumn(split_col, split).filter(F.col(split_col).isNotNull())


def train_test(df: DataFrame, period: str, train_periods: Sequence, test_periods: Sequence) -> tuple[DataFrame, DataFrame]:
    """P12 as two frames (two filters over one plan)."""
    return df.filter(F.col(period).isin(list(train_periods))), df.filter(F.col(period).isin(list(test_periods)))


def fill_constant(df: DataFrame, cols: Sequence[str], value=0) -> DataFrame:
    """Null -> constant in the listed columns."""
    return df.fillna(value, subset=list(cols))


def threshold_flag(c: str | Column, threshold: float = 0) -> Column:
    """``c > threshold`` as 0/1."""
    return (col_of(c) > F.lit(threshold)).cast("int")


def rename_cast(df: DataFrame, renames: Mapping[str, str] | None = None,
                casts: Mapping[str, str] | None = None) -> DataFrame:
    """Rename then cast columns in one projection."""
    renames = dict(renames or {})
    casts = dict(casts or {})
    cols = []
    for c in df.columns:
        name = renames.get(c, c)
        e = F.col(c)
        if name in casts:
            e = e.cast(casts[name])
        cols.append(e.alias(name))
    return df.select(*cols)


def adapt_scores(scores: DataFrame, key: str, score: str, out_key: str, out_score: str,
                 key_type: str = "int") -> DataFrame:
    """P16 adapter (T12): a scorer's ``(zip, <model>_prob)`` output -> the
    consumer's ``(ZIP, wildfire_risk_prob)`` with a cast key."""
    return scores.select(coerce_int(key).cast(key_type).alias(out_key), F.col(score).cast("double").alias(out_score))


def difference(a: str | Column, b: str | Column) -> Column:
    """``a - b``."""
    return col_of(a) - col_of(b)


def label_column(df: DataFrame, c: str, mapping: Mapping, out: str) -> DataFrame:
    """P20: code -> display label through a literal map; unmatched -> null."""
    return df.withColumn(out, lookup(c, mapping))


def round_columns(df: DataFrame, scales: Mapping[str, int], half_even: bool = False) -> DataFrame:
    """Round the named columns (half-up like SQL, or half-even like Python)."""
    fn = F.bround if half_even else F.round
    return df.select(*[(fn(F.col(c), scales[c]).alias(c) if c in scales else F.col(c)) for c in df.columns])
