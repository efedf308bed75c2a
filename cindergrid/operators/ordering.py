"""Running totals along a global order without a single-task window.

``Window.partitionBy(g).orderBy(o)`` puts every row of a group ``g`` into
one task; with no ``partitionBy`` at all the whole table goes to one task.
Both break when one group holds a third of the data.  The plan used here
instead (the classic prefix-sum over range partitions):

1. ``repartitionByRange(n, *groups, *order)`` - a hot group is split over
   many range partitions, each bounded in size;
2. tag each row with ``spark_partition_id()`` and checkpoint the tagged rows;
3. local running sums inside each (partition, group) piece;
4. per-piece totals (at most ``n`` x groups-per-partition rows) turned into
   exclusive offsets with a window over that tiny table;
5. local sum + offset = global running sum.

The result does not depend on where the range bounds fall, as long as the
order keys are a total order within each group (pass a unique tie-break).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.session import checkpoint_dir, shuffle_partitions

_PID = "__cg_pid"


def _order_exprs(order_cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


def running_totals(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                   sum_cols: Sequence[str], *, prefix: str = "cum_", inclusive: bool = True,
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``prefix + c`` = running sum of ``c`` along ``order_cols`` within ``group_cols``.

    ``inclusive=False`` gives the sum over strictly earlier rows (0 for the
    first).  ``order_cols`` may hold ``desc(...)`` columns.
    """
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    groups = list(group_cols)
    order = _order_exprs(order_cols)
    # The partition tag must be identical in the two passes below (local sums
    # and piece totals).  Two evaluations of a range exchange may sample
    # different bounds, so the tagged rows are written once to the shared
    # checkpoint folder; a lost executor re-reads them instead of re-tagging.
    checkpoint_dir(spark)
    ranged = df.repartitionByRange(n, *[F.col(g) for g in groups], *order) \
        .withColumn(_PID, F.spark_partition_id()).checkpoint(eager=True)

    piece = [_PID, *groups]
    w_local = Window.partitionBy(*piece).orderBy(*order)
    frame = w_local.rowsBetween(Window.unboundedPreceding,
                                Window.currentRow if inclusive else -1)
    local = ranged
    for c in sum_cols:
        local = local.withColumn(f"__cg_loc_{c}", F.coalesce(F.sum(c).over(frame), F.lit(0)))

    totals = ranged.groupBy(*piece).agg(*[F.sum(c).alias(f"__cg_tot_{c}") for c in sum_cols])
    w_off = (Window.partitionBy(*groups).orderBy(_PID) if groups else Window.orderBy(_PID)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*piece, *[
        F.coalesce(F.sum(f"__cg_tot_{c}").over(w_off), F.lit(0)).alias(f"__cg_off_{c}")
        for c in sum_cols])

    # null-safe on the group keys: a NULL group is a group like any other
    o = offsets.select(*[F.col(k).alias(f"__cg_o_{k}") for k in piece],
                       *[f"__cg_off_{c}" for c in sum_cols])
    cond = [local[k].eqNullSafe(o[f"__cg_o_{k}"]) for k in piece]
    out = local.join(o, on=cond, how="inner")
    for c in sum_cols:
        out = out.withColumn(prefix + c, F.col(f"__cg_loc_{c}") + F.col(f"__cg_off_{c}"))
    return out.drop(_PID, *[f"__cg_o_{k}" for k in piece], *[f"__cg_loc_{c}" for c in sum_cols],
                    *[f"__cg_off_{c}" for c in sum_cols])


def positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
              name: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """1-based row number along ``order_cols`` within ``group_cols``, skew-safe.

    Equal to ``row_number() over (partition by g order by o)`` when the
    order is total; a hot group never lands in one task.
    """
    one = "__cg_one"
    out = running_totals(df.withColumn(one, F.lit(1).cast("long")), group_cols, order_cols,
                         [one], prefix="__cg_cum_", num_partitions=num_partitions)
    return out.withColumnRenamed(f"__cg_cum_{one}", name).drop(one)
