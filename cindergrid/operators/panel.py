"""Entity-by-period panels: aggregation, label joins, dense grids, lag features.

Entity, period and measure names are arguments.  Two window strategies:

* ``window``: ``Window.partitionBy(entity).orderBy(period, tiebreak)``.  Used
  on aggregated panels, where one entity holds at most one row per period,
  so the largest window partition is bounded by the number of periods.
* ``ranged``: rows are range-partitioned, so that a hot entity spans many
  tasks; lags are taken inside each task's piece, and the first rows of a
  piece look into a small table of the rows before it.  Used for lags over
  raw rows, where one entity may hold a large share of the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.session import checkpoint_dir, shuffle_partitions


# ---------------------------------------------------------------- aggregates
def aggregate_measures(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """A1: one row per key with named aggregate columns (partial agg before the shuffle)."""
    return df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in measures.items()])


def event_counts(df: DataFrame, keys: Sequence[str], name: str = "event_count",
                 periods: Sequence | None = None, period_col: str | None = None) -> DataFrame:
    """A2: rows per key, optionally restricted to a list of periods."""
    if periods is not None and period_col is not None:
        df = df.filter(F.col(period_col).isin(list(periods)))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# --------------------------------------------------------------------- joins
def flag_join(universe: DataFrame, events: DataFrame, keys: Sequence[str],
              flag: str = "event_flag") -> DataFrame:
    """J1 + P13 + P14: ``universe`` left join the event keys, flag 1 when matched else 0.

    The event side is reduced to distinct keys first, so a key with many
    events cannot fan the universe out.
    """
    marks = events.select(*keys).distinct().withColumn(flag, F.lit(1))
    return universe.join(marks, on=list(keys), how="left") \
        .withColumn(flag, F.coalesce(F.col(flag), F.lit(0)).cast("int"))


def dense_grid(entities: DataFrame, entity: str, periods: Sequence | Column,
               period: str = "period") -> DataFrame:
    """Every distinct entity times every period.

    Expressed as an ``explode`` of the (small, literal) period list per
    entity, i.e. a narrow generate after one distinct, not a cross join.
    """
    arr = periods if isinstance(periods, Column) else F.array(*[F.lit(p) for p in periods])
    return entities.select(entity).distinct().select(entity, F.explode(arr).alias(period))


def attach_counts(grid: DataFrame, counts: DataFrame, keys: Sequence[str], count_col: str) -> DataFrame:
    """Left join counts onto the grid; missing -> 0."""
    return grid.join(counts.select(*keys, count_col), on=list(keys), how="left") \
        .withColumn(count_col, F.coalesce(F.col(count_col), F.lit(0)))


def left_fill_join(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """Left join feature columns, then constant-fill their nulls."""
    out = left.join(right, on=list(keys), how="left")
    return out.fillna(dict(fill)) if fill else out


# ------------------------------------------------------------------- windows
def history_features(grid: DataFrame, entity: str, period: str, count_col: str,
                     lags: Sequence[int] = (1, 2), lag_prefix: str | None = None,
                     cumulative: str = "cumulative_count", ever: str = "ever_flag") -> DataFrame:
    """N5 + N6 + P15 on a dense grid, all over one window spec (one shuffle, one sort).

    * ``{prefix}lag{n}``: count ``n`` periods back, 0 before the grid starts;
    * ``cumulative``: sum over all earlier grid periods (exclusive), 0 first;
    * ``ever``: ``cumulative > 0`` as 0/1.
    """
    prefix = lag_prefix if lag_prefix is not None else f"{count_col}_"
    w = Window.partitionBy(entity).orderBy(period)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cum = F.coalesce(F.sum(count_col).over(before), F.lit(0))
    cols = [F.col(c) for c in grid.columns]
    cols += [F.lag(count_col, n, 0).over(w).alias(f"{prefix}lag{n}") for n in lags]
    cols += [cum.alias(cumulative), (cum > 0).cast("int").alias(ever)]
    return grid.select(*cols)


def _lag_window(df: DataFrame, entity_cols: Sequence[str], order_cols: Sequence[str | Column],
                values: Mapping[str, Sequence[int]], default=None) -> DataFrame:
    w = Window.partitionBy(*entity_cols).orderBy(*order_cols)
    cols = [F.col(c) for c in df.columns]
    for c, ns in values.items():
        cols += [F.lag(c, n, default).over(w).alias(f"{c}_lag{n}") for n in ns]
    return df.select(*cols)


def _lag_ranged(df: DataFrame, entity_cols: Sequence[str], order_cols: Sequence[str | Column],
                values: Mapping[str, Sequence[int]], default=None) -> DataFrame:
    """Row lags without a window over the entity, and without copies of rows.

    1. Rows are range-partitioned once on (entity, order), so a hot entity
       spans many partitions; the tagged rows are written to the checkpoint
       folder, as two evaluations of a range exchange could cut differently.
    2. Lags are taken inside each piece, the part of an entity in one partition.
    3. The first ``L`` rows of a later piece (``L`` the longest lag) look back
       into the pieces before: only entities that cross a partition bound
       have such pieces, at most two pieces per partition begin or end there, and each
       gives its last ``L`` rows.  That table is bounded by the number of
       partitions and is joined by broadcast.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    pid, rn, size, carry = "__cg_pid", "__cg_rn", "__cg_size", "__cg_carry"
    longest = max(n for ns in values.values() for n in ns)
    names = {(c, n): f"{c}_lag{n}" for c, ns in values.items() for n in ns}
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(shuffle_partitions(spark), *[F.col(c) for c in entity_cols], *order) \
        .withColumn(pid, F.spark_partition_id()).checkpoint(eager=True)
    whole = Window.partitionBy(*entity_cols, pid)
    inside = whole.orderBy(*order)
    local = ranged.select("*", F.row_number().over(inside).alias(rn), F.count(F.lit(1)).over(whole).alias(size),
                          *[F.lag(c, n).over(inside).alias(name) for (c, n), name in names.items()])

    def same(left: DataFrame, right: dict[str, str]):
        return [left[c].eqNullSafe(F.col(o)) for c, o in right.items()]

    renamed = {c: f"__cg_e_{i}" for i, c in enumerate(entity_cols)}
    crossing = ranged.select(*entity_cols, pid).distinct().groupBy(*entity_cols).agg(F.count(F.lit(1)).alias("k")) \
        .where("k > 1").select(*[F.col(c).alias(o) for c, o in renamed.items()])
    last = local.where(F.col(rn) > F.col(size) - longest)
    ends = last.join(F.broadcast(crossing), same(last, renamed)).groupBy(*renamed.values(), pid).agg(
        F.sort_array(F.collect_list(F.struct(rn, *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)]))).alias("t"))
    # each earlier piece holds a row at least, so ``longest`` pieces hold enough
    before = Window.partitionBy(*renamed.values()).orderBy(pid).rowsBetween(-longest, -1)
    carried = ends.select(*renamed.values(), F.col(pid).alias("__cg_p"), F.flatten(F.collect_list("t").over(before)).alias(carry))
    out = local.join(F.broadcast(carried), [*same(local, renamed), local[pid] == F.col("__cg_p"),
                                            local[rn] <= longest], "left")
    column = {c: f"v{i}" for i, c in enumerate(values)}
    lags = []
    for (c, n), name in names.items():
        # the row ``n`` back is the (n - rn + 1)-th from the end of what came before the piece
        back = F.try_element_at(F.col(carry), (F.col(rn) - n - 1).cast("int"))[column[c]]
        value = F.when(F.col(rn) > n, F.col(name)).otherwise(back)
        outside = F.col(rn) + F.coalesce(F.array_size(carry), F.lit(0)) <= n
        lags.append((value if default is None else F.when(outside, F.lit(default)).otherwise(value)).alias(name))
    return out.select(*df.columns, *lags)


def lag_features(df: DataFrame, entity_cols: Sequence[str], order_cols: Sequence[str | Column],
                 values: Mapping[str, Sequence[int]], default=None, strategy: str = "window") -> DataFrame:
    """N1/N5 generalised: ``{c}_lag{n}`` = value of ``c`` ``n`` rows earlier within the entity.

    ``order_cols`` must be a total order inside the entity (end it with a
    unique key); Spark has no stable input order, so ties would give
    arbitrary lags.  ``default`` fills rows with no predecessor (null keeps
    pandas ``shift`` semantics).
    """
    if strategy == "window":
        return _lag_window(df, entity_cols, order_cols, values, default)
    if strategy == "ranged":
        return _lag_ranged(df, entity_cols, order_cols, values, default)
    raise ValueError(f"unknown strategy {strategy!r}")


def premium_features(df: DataFrame, entity_cols: Sequence[str], order_cols: Sequence[str | Column],
                     target: str, loss_cols: Sequence[str] = (), exposure: str | None = None,
                     prefix: str = "premium", strategy: str = "window") -> DataFrame:
    """N1-N4 and N7 (``build_all_features``): row-level ratios, then every lag
    in one :func:`lag_features` pass, then the trend columns.

    * ``{prefix}_lag1``, ``{prefix}_lag2``: target 1 and 2 rows back (null when absent);
    * ``{prefix}_yoy_change`` = lag1 - lag2, ``{prefix}_pct_change`` = change / (|lag2| + 1);
    * ``loss_ratio`` = sum(losses, null as 0) / (target + 1), ``loss_ratio_lag1``;
    * ``{prefix}_per_exposure`` = target / (exposure + 1), ``{prefix}_per_exposure_lag1``.

    ``strategy="window"`` is one window spec (one shuffle, one sort) - right
    for panels with one row per entity-period.  ``"ranged"`` is for the
    row-lag form over raw rows, where one entity may be hot.
    """
    t = _unquote(target)
    cols = [F.col(f"`{c}`") for c in df.columns]
    lags: dict[str, list[int]] = {t: [1, 2]}
    tail = []
    if loss_cols:
        total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in loss_cols), F.lit(0.0))
        cols.append((total / (F.col(target) + 1)).alias("loss_ratio"))
        lags["loss_ratio"] = [1]
        tail += ["loss_ratio", "loss_ratio_lag1"]
    if exposure:
        per = f"{prefix}_per_exposure"
        cols.append((F.col(target) / (F.col(exposure) + 1)).alias(per))
        lags[per] = [1]
        tail += [per, f"{per}_lag1"]
    lagged = lag_features(df.select(*cols), [_unquote(e) for e in entity_cols], [_unquote(o) for o in order_cols],
                          lags, strategy=strategy)
    l1, l2 = F.col(f"`{t}_lag1`"), F.col(f"`{t}_lag2`")
    return lagged.select(*[F.col(f"`{c}`") for c in df.columns],
                         l1.alias(f"{prefix}_lag1"), l2.alias(f"{prefix}_lag2"),
                         (l1 - l2).alias(f"{prefix}_yoy_change"),
                         ((l1 - l2) / (F.abs(l2) + 1)).alias(f"{prefix}_pct_change"), *tail)


def _unquote(c):
    return c[1:-1] if isinstance(c, str) and c.startswith("`") and c.endswith("`") else c
