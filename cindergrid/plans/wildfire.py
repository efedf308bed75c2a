"""The event-history panel (weather measures + event labels + history features).

Generic over column names.  The reference runs it on ZIP x year with a
mixed weather/fire file; the driver-table preset runs it on users x days
of ``events``.

Two forms with the same result:

* :func:`history_panel_single_scan` (used at scale): one scan, one
  partial-aggregated ``groupBy(entity, period)`` over both row kinds, and
  range-frame history features over that aggregate - one aggregate
  exchange and one window exchange, no grid and no joins.
* :func:`history_panel` (step by step, as the reference does it): measure
  aggregate, event flags, dense grid, grid lags and running total, joined
  back.  Both aggregates shuffle partially aggregated rows; every later step
  works on entities x periods, so the window by entity cannot be skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.operators import clean, panel


@dataclass
class HistoryPanelSpec:
    entity: str                      # normalised entity key column
    period: str                      # period column (int year, date, ...)
    measures: Mapping[str, Column]   # A1: name -> aggregate expression
    measure_inputs: Sequence[str]    # P10: rows with a null here are dropped
    grid_periods: Sequence           # J6 / U4: dense grid, from the first grid period (T2)
    train_periods: Sequence
    test_periods: Sequence
    label: str = "event_flag"
    count: str = "event_count"
    lags: Sequence[int] = (1, 2)
    cumulative: str = "cumulative_count"
    ever: str = "ever_flag"
    derived: Mapping[str, Column] = field(default_factory=dict)   # P17
    split_col: str = "split"
    split_labels: tuple[str, str] = ("train", "validation")
    # Single-scan form: measure name -> (aggregate, input column), and the
    # period as a contiguous integer index (a year, a day number, ...).
    measure_specs: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    period_index: Callable[[Column], Column] = field(default=lambda c: c)

    @property
    def target_periods(self) -> list:
        return sorted(set(self.train_periods) | set(self.test_periods))

    @property
    def lag_cols(self) -> list[str]:
        return [f"{self.count}_lag{n}" for n in self.lags]


def measure_panel(measure_rows: DataFrame, spec: HistoryPanelSpec) -> DataFrame:
    """P10 + P11 + A1: drop incomplete rows, keep target periods, aggregate."""
    rows = clean.drop_nulls(measure_rows, [spec.period, *spec.measure_inputs])
    rows = clean.keep_periods(rows, spec.period, spec.target_periods)
    return panel.aggregate_measures(rows, [spec.entity, spec.period], spec.measures)


def labelled_panel(measure_rows: DataFrame, event_rows: DataFrame, spec: HistoryPanelSpec) -> DataFrame:
    """+ J1: event flag for target periods (the measure panel is the universe)."""
    events = clean.keep_periods(event_rows.filter(F.col(spec.period).isNotNull()), spec.period, spec.target_periods)
    return panel.flag_join(measure_panel(measure_rows, spec), events, [spec.entity, spec.period], spec.label)


def history_grid(universe: DataFrame, event_rows: DataFrame, spec: HistoryPanelSpec) -> DataFrame:
    """J6 + A2 + J2 + N5 + N6 + P15 over the dense grid of the universe's entities.

    Events outside the grid periods never enter the running total (T2).
    """
    grid = panel.dense_grid(universe, spec.entity, sorted(set(spec.grid_periods) | set(spec.target_periods)),
                            spec.period)
    counts = panel.event_counts(event_rows.filter(F.col(spec.period).isNotNull()), [spec.entity, spec.period],
                                spec.count)
    grid = panel.attach_counts(grid, counts, [spec.entity, spec.period], spec.count)
    return panel.history_features(grid, spec.entity, spec.period, spec.count, spec.lags,
                                  lag_prefix=f"{spec.count}_", cumulative=spec.cumulative, ever=spec.ever)


def history_panel(measure_rows: DataFrame, event_rows: DataFrame, spec: HistoryPanelSpec) -> DataFrame:
    """W0 end to end: labelled measures + history features + derived columns + split."""
    data = labelled_panel(measure_rows, event_rows, spec)
    hist = history_grid(data, event_rows, spec)
    feats = [*spec.lag_cols, spec.cumulative, spec.ever]
    hist = clean.keep_periods(hist.select(spec.entity, spec.period, *feats), spec.period, spec.target_periods)
    data = panel.left_fill_join(data, hist, [spec.entity, spec.period], {c: 0 for c in feats})
    for name, expr in spec.derived.items():
        data = data.withColumn(name, expr)
    return clean.temporal_split(data, spec.period, spec.train_periods, spec.test_periods,
                                spec.split_col, spec.split_labels)


_AGGS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def history_panel_single_scan(rows: DataFrame, is_event: Column, spec: HistoryPanelSpec) -> DataFrame:
    """W0 in one scan and one aggregate (the plan used at scale).

    ``rows`` holds both row kinds with the normalised entity and one period
    column; ``is_event`` tells them apart.  Per (entity, period) a single
    partial-aggregated ``groupBy`` yields the measure aggregates over the
    complete measure rows of the target periods, and the event count over
    all event rows from the first grid period on.  The history features are
    RANGE frames over the integer period index of that one table:

    * ``lag n``  = events at period - n (``rangeBetween(-n, -n)``, absent -> 0);
    * cumulative = events in all earlier periods since the grid start.

    On a contiguous period range this equals the dense-grid formulation
    (grid x counts, row lags, running sum) without materialising the grid
    or joining features back.  The window is partitioned by entity over
    aggregated rows: at most one row per period per entity, so a hot entity
    cannot overload a task.
    """
    if not spec.measure_specs:
        raise ValueError("single-scan form needs measure_specs")
    ev = F.coalesce(is_event, F.lit(False))
    period = F.col(spec.period)
    periods = sorted(set(spec.grid_periods) | set(spec.target_periods))
    first, last = periods[0], max(spec.target_periods)
    in_target = period.isin(list(spec.target_periods))
    complete = ~ev & in_target
    for c in spec.measure_inputs:
        complete = complete & F.col(c).isNotNull()
    kept = rows.filter(F.col(spec.entity).isNotNull() & period.isNotNull()
                       & (period >= F.lit(first)) & (period <= F.lit(last)))
    measures = [_AGGS[fn](F.when(complete, F.col(c))).alias(name) for name, (fn, c) in spec.measure_specs.items()]
    agg = kept.groupBy(spec.entity, spec.period).agg(
        F.count_if(complete).alias("__cg_n_measure"), *measures, F.count_if(ev).alias(spec.count))

    idx = "__cg_pidx"
    agg = agg.withColumn(idx, spec.period_index(period).cast("long"))
    w = Window.partitionBy(spec.entity).orderBy(idx)
    cum = F.coalesce(F.sum(spec.count).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    feats = [F.coalesce(F.sum(spec.count).over(w.rangeBetween(-n, -n)), F.lit(0)).cast("long").alias(f"{spec.count}_lag{n}")
             for n in spec.lags]
    out = agg.select(spec.entity, spec.period, "__cg_n_measure", *spec.measure_specs,
                     (F.col(spec.count) > 0).cast("int").alias(spec.label), *feats,
                     cum.alias(spec.cumulative), (cum > 0).cast("int").alias(spec.ever))
    out = out.filter(F.col("__cg_n_measure") > 0).drop("__cg_n_measure")
    for name, expr in spec.derived.items():
        out = out.withColumn(name, expr)
    return clean.temporal_split(out, spec.period, spec.train_periods, spec.test_periods,
                                spec.split_col, spec.split_labels)
