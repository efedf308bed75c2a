"""Deterministic stratified samples (without and with replacement).

Row order inside a class is ``md5(seed # key...)``, the same text in Spark
and DuckDB, so samples are reproducible across engines and partitionings.

*Without replacement*: a class's sample is its first ``quota`` rows in that
order.  Digests are uniform, so the rows below ``2 * quota / class size`` of
the digest range hold them nearly surely.  A map-side filter keeps only
those, at most a small multiple of ``n`` rows in all, and only they are
ranked.  Should a class fall short, the range is doubled until it doesn't.

*With replacement* (sklearn ``resample`` default, T8): draws are generated
with ``spark.range`` (distributed), mapped to a class by cumulative quota,
and each draw picks the row at a hashed position in its class.  Positions
come from the range-partitioned prefix sum (skew-safe) over the class and
key columns alone; the drawn keys are then joined with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.operators.ordering import positions
from cindergrid.operators.prep import class_counts


def order_hash(seed: int, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_to_long(text: Column) -> Column:
    """First 15 hex digits of a digest as a non-negative long."""
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


HASH_RANGE = 16 ** 15


def largest_remainder(counts: dict, n: int) -> dict:
    """Quota per class: floor of ``n * share`` plus one for the largest
    remainders (ties -> smaller class value first)."""
    total = sum(counts.values())
    raw = {c: n * m / total for c, m in counts.items()}
    quota = {c: math.floor(v) for c, v in raw.items()}
    left = n - sum(quota.values())
    for c in sorted(counts, key=lambda c: (-(raw[c] - quota[c]), c))[:left]:
        quota[c] += 1
    return quota


def _per_class(label: str, numbers: dict) -> Column:
    """The number of the row's class, 0 for other classes."""
    pairs = [F.lit(x) for c, v in numbers.items() for x in (c, int(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(label)), F.lit(0))


def stratified_sample(df: DataFrame, label: str, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (when the frame is larger), class shares kept by
    largest remainder; the frame is returned whole when it has <= ``n`` rows.
    Rows with a null class are not sampled."""
    df = df.filter(F.col(label).isNotNull())
    counts = class_counts(df, label)
    if sum(counts.values()) <= n:
        return df
    quotas = largest_remainder(counts, n)
    place = hash_to_long(order_hash(seed, keys))
    widen = 2.0
    while True:
        # the first 15 hex digits order rows as the whole digest does
        limits = {c: math.ceil(HASH_RANGE * min(1.0, (widen * q + 16) / counts[c])) if q else 0
                  for c, q in quotas.items()}
        near = df.filter(place <= _per_class(label, limits))
        found = {r[label]: r["count"] for r in near.groupBy(label).count().collect()}
        if all(found.get(c, 0) >= q for c, q in quotas.items()):
            break
        widen *= 2
    w = Window.partitionBy(label).orderBy(order_hash(seed, keys), *keys)
    ranked = near.withColumn("__cg_rn", F.row_number().over(w))
    return ranked.filter(F.col("__cg_rn") <= _per_class(label, quotas)).drop("__cg_rn")


def stratified_bootstrap(df: DataFrame, label: str, keys: Sequence[str], n: int, seed: int = 42,
                         draw_col: str = "draw") -> DataFrame:
    """``n`` draws with replacement, class quotas by largest remainder.

    Draw ``j`` of class ``c`` takes the row at position
    ``hash(seed # c # j) mod n_c + 1`` of the class's hash order.  Rows with a
    null class are not sampled.  ``keys`` must name a row within its class:
    rows that share a class and keys come out together.
    """
    df = df.filter(F.col(label).isNotNull())
    counts = class_counts(df, label)
    quotas = largest_remainder(counts, n)
    classes = sorted(quotas)
    spark = df.sparkSession
    draws = spark.range(n).withColumnRenamed("id", draw_col)
    cls, start, size = None, None, None
    acc = 0
    for c in classes:
        cond = F.col(draw_col) < F.lit(acc + quotas[c])
        cls = F.when(cond, F.lit(c)) if cls is None else cls.when(cond, F.lit(c))
        start = F.when(cond, F.lit(acc)) if start is None else start.when(cond, F.lit(acc))
        size = F.when(cond, F.lit(counts[c])) if size is None else size.when(cond, F.lit(counts[c]))
        acc += quotas[c]
    draws = draws.select(draw_col, cls.alias(label), (F.col(draw_col) - start).alias("__cg_j"), size.alias("__cg_nc"))
    pick = F.pmod(hash_to_long(F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(label).cast("string"),
                                                  F.col("__cg_j").cast("string")))), F.col("__cg_nc")) + 1
    draws = draws.select(draw_col, label, pick.alias("__cg_pos"))
    slim = df.select(label, *[k for k in keys if k != label])
    ranked = positions(slim, [label], [order_hash(seed, keys), *[F.col(k) for k in keys]], name="__cg_pos")
    drawn = draws.join(ranked, [label, "__cg_pos"]).select(
        draw_col, *[F.col(c).alias(f"__cg_d_{c}") for c in slim.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__cg_d_{c}")) for c in slim.columns]
    others = [c for c in df.columns if c != label]
    return df.join(drawn, same).select(label, draw_col, *others)
