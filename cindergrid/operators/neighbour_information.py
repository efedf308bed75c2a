"""Nearest-neighbour mutual information of continuous features with a class.

The estimate is ``psi(n) + mean(psi(k_i)) - mean(psi(n_class)) - mean(psi(m_i))``
over the rows of classes with at least two rows: ``k_i`` is ``neighbours``, or
the rest of a smaller class; the row's radius is the distance to its
``k_i``-th neighbour within its class; ``m_i`` counts the rows of any class,
itself included, that are nearer than the radius (equally near ones where the
radius is 0).  Negative estimates are 0.  There is no noise and no seed.

No task holds a whole feature.  Equal values of a class are one row with a
count; these rows are dealt by ranges of (feature, value) into pieces.

1. A neighbour is at most ``neighbours`` distinct values of the class away,
   so a piece needs that many more of each class from either side.  They are
   found in a table of the pieces' outermost rows alone.
2. A radius becomes two probes, one for each end, sent to the piece where
   the end falls.  A piece answers with the number of rows below the probe:
   its own prefix sums plus the rows of the pieces before it.  Ends are
   judged by the rounded distance itself, so ties count as on one machine.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.session import materialize, ship_package


def digamma(n: Column) -> Column:
    """Digamma of a positive whole number: ten steps of the recurrence, then the asymptotic series."""
    x = n.cast("double")
    z = x + 10
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z)
    return series - sum((1 / (x + i) for i in range(1, 10)), 1 / x)


def _radii(x: np.ndarray, c: np.ndarray, own: slice, k: int, size: int) -> np.ndarray:
    """Distance of each value of ``own`` to its k-th neighbour among the class's sorted values; ``size``: rows of the class."""
    k = min(k, size - 1)
    at = np.arange(own.start, own.stop)
    near, times = [np.zeros(len(at))], [c[at] - 1]
    for step in range(1, k + 1):
        for other in (at - step, at + step):
            there = (other >= 0) & (other < len(x))
            held = np.where(there, other, 0)
            near.append(np.where(there, np.abs(x[held] - x[at]), np.inf))
            times.append(np.where(there, c[held], 0))
    near, times = np.stack(near, axis=1), np.stack(times, axis=1)
    order = np.argsort(near, axis=1, kind="stable")
    upto = np.cumsum(np.take_along_axis(times, order, axis=1), axis=1)
    hit = np.argmax(upto >= k, axis=1)
    return np.take_along_axis(near, order, axis=1)[np.arange(len(at)), hit]


def neighbour_information(df: DataFrame, features: Sequence[str], label: str, neighbours: int = 3,
                          piece_rows: int = 500_000) -> DataFrame:
    """``(feature, position, mi)`` in nats, one row a feature.

    Rows with a null or NaN feature don't count for that feature, rows with a
    null label for none; classes of one row are left out.  A feature without
    rows left has a null estimate.
    """
    spark, k = df.sparkSession, neighbours
    if k < 1:
        raise ValueError("at least one neighbour is needed")
    ship_package(spark)
    wide = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y"), F.array(
        *[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(features)]).alias("all"))
    rows = wide.select("y", F.explode("all").alias("v")).select(F.col("v.f").alias("f"), (F.col("v.x") + 0.0).alias("x"), "y") \
        .where(F.col("x").isNotNull() & ~F.isnan("x"))
    counted = materialize(rows.groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("c")))
    sizes = counted.groupBy("f", "y").agg(F.sum("c").alias("size")).where("size > 1")
    counted = counted.join(sizes, ["f", "y"])
    pieces = max(1, -(-counted.count() // piece_rows))
    ranged = materialize(counted.repartitionByRange(pieces, "f", "x").withColumn("piece", F.spark_partition_id()))

    # the outermost k values of each class in each piece, and what precedes and follows them
    inside = Window.partitionBy("piece", "f", "y")
    outer = ranged.withColumns({"i": F.row_number().over(inside.orderBy("x")), "n": F.count(F.lit(1)).over(inside)}) \
        .where((F.col("i") <= k) | (F.col("i") > F.col("n") - k))
    along = Window.partitionBy("f", "y").orderBy("x")
    outer = outer.withColumns({
        "before": F.array(*[F.struct(F.lag("x", s).over(along).alias("x"), F.lag("c", s).over(along).alias("c")) for s in range(k, 0, -1)]),
        "after": F.array(*[F.struct(F.lead("x", s).over(along).alias("x"), F.lead("c", s).over(along).alias("c")) for s in range(1, k + 1)])})
    halo = outer.groupBy("piece", "f", "y").agg(F.min_by("before", "i").alias("before"), F.max_by("after", "i").alias("after"))
    halo = halo.select(F.col("piece").alias("h_piece"), F.col("f").alias("h_f"), F.col("y").alias("h_y"), "before", "after")

    # one row per piece and feature: at most pieces + features of them, whatever the number of rows
    values = ranged.groupBy("piece", "f", "x").agg(F.sum("c").alias("c"))
    spread = Window.partitionBy("piece", "f")
    ends = values.withColumns({"i": F.row_number().over(spread.orderBy("x")), "n": F.count(F.lit(1)).over(spread),
                               "all": F.sum("c").over(spread)})
    ends = ends.where("i <= 2 or i > n - 2").groupBy("piece", "f").agg(
        F.sort_array(F.collect_list(F.struct("x", "c", "i"))).alias("edge"), F.max("n").alias("n"), F.max("all").alias("rows"))
    bounds: dict[int, list[tuple]] = {}
    for r in ends.collect():
        bounds.setdefault(r["f"], []).append((r["edge"][0]["x"], r["piece"], [(e["x"], e["c"]) for e in r["edge"]], r["rows"]))
    for own in bounds.values():
        own.sort()
    shared = spark.sparkContext.broadcast(bounds)

    def probes(group: pa.Table, edges: pa.Table) -> pa.Table:
        around = {(r["h_f"], r["h_y"]): r for r in edges.to_pylist()}
        out = {n: [] for n in ("piece", "f", "y", "x", "c", "size", "r", "upper")}
        f_, y_ = group["f"].to_numpy(), np.array(group["y"].to_pylist(), dtype=object)
        x_, c_, s_ = (group[n].to_numpy() for n in ("x", "c", "size"))
        for (f, y), ends_ in around.items():
            mine = np.flatnonzero((f_ == f) & (y_ == y))
            mine = mine[np.argsort(x_[mine])]
            left = [(e["x"], e["c"]) for e in ends_["before"] if e["x"] is not None]
            right = [(e["x"], e["c"]) for e in ends_["after"] if e["x"] is not None]
            x = np.concatenate(([e[0] for e in left], x_[mine], [e[0] for e in right]))
            c = np.concatenate(([e[1] for e in left], c_[mine], [e[1] for e in right])).astype(np.int64)
            r = _radii(x, c, slice(len(left), len(left) + len(mine)), k, int(s_[mine[0]]))
            starts = np.array([b[0] for b in shared.value[f]])
            homes = np.array([b[1] for b in shared.value[f]])
            for upper in (False, True):
                at = x_[mine] + (r if upper else -r)
                home = homes[np.maximum(np.searchsorted(starts, at, side="right") - 1, 0)]
                for n, v in (("piece", home), ("f", np.full(len(mine), f)), ("y", np.full(len(mine), y, object)), ("x", x_[mine]),
                             ("c", c_[mine]), ("size", s_[mine]), ("r", r), ("upper", np.full(len(mine), upper))):
                    out[n].append(v)
        kinds = {"piece": pa.int32(), "f": pa.int32(), "y": pa.string(), "x": pa.float64(), "c": pa.int64(), "size": pa.int64(),
                 "r": pa.float64(), "upper": pa.bool_()}
        return pa.table({n: pa.array(np.concatenate(v) if v else [], t) for (n, v), t in zip(out.items(), kinds.values())})

    def answers(asked: pa.Table, held: pa.Table) -> pa.Table:
        empty = pa.table({"f": pa.array([], pa.int32()), "y": pa.array([], pa.string()), "x": pa.array([], pa.float64()),
                          "c": pa.array([], pa.int64()), "size": pa.array([], pa.int64()), "below": pa.array([], pa.int64())})
        if not len(asked):
            return empty
        piece = asked["piece"][0].as_py()
        f_, x_, r_, upper = (asked[n].to_numpy(zero_copy_only=False) for n in ("f", "x", "r", "upper"))
        below = np.zeros(len(f_), np.int64)
        own_f, own_x, own_c = (held[n].to_numpy() for n in ("f", "x", "c"))
        for f in np.unique(f_):
            pieces_ = shared.value[f]
            here = next(i for i, b in enumerate(pieces_) if b[1] == piece)
            mine = np.flatnonzero(own_f == f)
            v, which = np.unique(own_x[mine], return_inverse=True)
            n = np.bincount(which, own_c[mine]).astype(np.int64)
            left = pieces_[here - 1][2][-2:] if here else []
            right = pieces_[here + 1][2][:2] if here + 1 < len(pieces_) else []
            offset = sum(b[3] for b in pieces_[:here]) - sum(c for _, c in left)
            v = np.concatenate(([e[0] for e in left], v, [e[0] for e in right]))
            upto = np.concatenate(([0], np.cumsum(np.concatenate(([e[1] for e in left], n, [e[1] for e in right]))))).astype(np.int64)
            q = np.flatnonzero(f_ == f)
            x, r, up = x_[q], r_[q], upper[q]
            # the place of the first value beyond the end: not nearer than the radius above, nearer below
            place = np.searchsorted(v, np.where(up, x + r, x - r), side="left")
            beyond = lambda i: np.where(r > 0, np.where(up, v[i] - x >= r, x - v[i] < r), np.where(up, v[i] > x, v[i] >= x))
            for _ in range(3):
                back = (place > 0) & beyond(np.maximum(place - 1, 0))
                place = place - back
                on = ~back & (place < len(v)) & ~beyond(np.minimum(place, len(v) - 1))
                place = place + on
            below[q] = offset + upto[place]
        return pa.table({"f": asked["f"], "y": asked["y"], "x": asked["x"], "c": asked["c"], "size": asked["size"],
                         "below": np.where(upper, below, -below)})

    asked = ranged.groupBy("piece").cogroup(halo.groupBy("h_piece")).applyInArrow(
        probes, "piece int, f int, y string, x double, c long, size long, r double, upper boolean")
    answered = asked.groupBy("piece").cogroup(ranged.groupBy("piece")).applyInArrow(
        answers, "f int, y string, x double, c long, size long, below long")
    near = answered.groupBy("f", "y", "x", "c", "size").agg(F.sum("below").alias("m"))
    n = F.sum("c")
    mi = digamma(n) + (F.sum(F.col("c") * (digamma(F.least(F.lit(k), F.col("size") - 1)) - digamma(F.col("size"))
                                           - digamma(F.col("m")))) / n)
    found = near.groupBy("f").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))
    names = spark.createDataFrame([(i, c) for i, c in enumerate(features)], "position int, feature string")
    return names.join(found, F.col("position") == F.col("f"), "left").select("feature", "position", "mi")
