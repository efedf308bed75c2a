"""Operator 8: exact cosine range join of vectors by pivots.

Vectors are scaled to length 1, where ``cos >= c`` means an angle of at
most ``acos(c)``, and the angle is a metric.

1. Equal vectors (to the last bit of their components) become one node with
   a count.
2. A bounded number of pivots is drawn from the nodes; each node's *home*
   cell is that of its nearest pivot.
3. A node is also a *guest* of every cell of a lower number that may hold a
   neighbour, so two nodes of different cells meet once.  Two consequences of the triangle inequality decide, for home pivot ``p``
   and cell ``q``: no member lies farther from ``q`` than the cell's radius,
   so the angle to ``q`` must not exceed radius plus range; and members lie
   on the far side of the great circle between ``p`` and ``q``, so the
   angle to that circle must not exceed the range.
4. Cells are joined independently.  A cell's homes and its homes and guests
   are cut into blocks by hash, and each task compares one block with
   another by a matrix product in double precision.  A crowded cell is many
   block pairs, so no task grows with it.
5. A task counts links per home node, and lists only a spanning forest of
   the links it found, which keeps their components without listing pairs.

Every link is found: the cells are exact, not approximate.  How many cells a
node visits depends on the data.  Vectors in clusters visit few; vectors
without structure in many dimensions are nearly equally far from all pivots
and visit most, which no metric index avoids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches, connected_components, materialised, release

SLACK = 1e-7  # radians added to every bound, far above the rounding of a dot product


def _matrix(column: pa.Array | pa.ChunkedArray | pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(-1, size) if len(column) else np.empty((0, size))


def unit_nodes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, node binary`` per row: the unit vector's bytes, null for vectors that can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for v in batch.column(1):
                values = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0)
                if not len(values) or not np.isfinite(values).all():
                    nodes.append(None)
                    continue
                # scaled by the largest component first, so that no square overflows or vanishes
                most = np.abs(values).max()
                scaled = values / most if most else values
                length = math.sqrt(float(scaled @ scaled))
                nodes.append((scaled / length + 0.0).astype("<f8").tobytes() if length else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary())], names=["key", "node"])

    bounded_batches(vectors.sparkSession)
    slim = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, node binary")


def _angles(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ pivots.T, -1.0, 1.0))


def _homes(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, node, home int, away double``: the nearest pivot and the angle to it."""
    size = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(_matrix(batch.column("node").to_pylist(), size), pivots)
            home = angles.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home), pa.array(angles[np.arange(len(home)), home])],
                names=["id", "node", "copies", "home", "away"])

    return nodes.mapInArrow(run, "id long, node binary, copies long, home int, away double")


def _between(pivots: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """``pivots x cells``: the distance of each pivot from each cell's."""
    return np.maximum(np.stack([np.linalg.norm(pivots - pivots[c], axis=1) for c in cells], axis=1), 1e-300)


def _may_visit(points: np.ndarray, home: np.ndarray, pivots: np.ndarray, cells: np.ndarray, between: np.ndarray,
               radius: np.ndarray, reach: float) -> np.ndarray:
    """``nodes x cells``: whether a node is a guest of a cell, which has a lower number than its home."""
    angles = _angles(points, pivots[cells])
    # sine of the angle to the great circle between the home pivot and each cell's pivot
    own = np.einsum("ij,ij->i", points, pivots[home])
    side = (own[:, None] - points @ pivots[cells].T) / between[home]
    near = (angles <= radius[cells] + reach + SLACK) & (side <= math.sin(min(reach + SLACK, math.pi / 2)))
    return near & (radius[cells] >= 0) & (cells[None, :] < home[:, None])


def _count_guests(homes: DataFrame, pivots: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """The number of guests of each cell."""
    cells = np.arange(len(pivots))
    between = _between(pivots, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cells), np.int64)
        for batch in batches:
            points = _matrix(batch.column("node").to_pylist(), pivots.shape[1])
            n += _may_visit(points, batch.column("home").to_numpy(), pivots, cells, between, radius, reach).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(n)], names=["cell", "n"])

    out = np.zeros(len(cells), np.int64)
    for r in homes.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


HOME, HOME_AGAIN, GUEST = 0, 1, 2  # a cell's home on the left side and on the right side, a guest on the right side


def _rounds(volume: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of units whose volumes add up to ``most`` each; a larger unit is a range of its own."""
    out, start, held = [], 0, 0
    for i, v in enumerate(volume.tolist()):
        if i > start and held + v > most:
            out.append((start, i))
            start, held = i, 0
        held += v
    return [*out, (start, len(volume))] if len(volume) else out


def _visits(homes: DataFrame, pivots: np.ndarray, radius: np.ndarray, reach: float, blocks: np.ndarray,
            units: tuple[int, int]) -> DataFrame:
    """A row per node and block pair of the ``units``: ``cell, left, right, id, node, copies, part``.

    ``left`` is a block of a cell's homes; ``right`` is a block of its
    homes or guests.  A home of block ``b`` goes to every ``(b, r)`` as the
    left side and, as a right side, to every ``(l, b')`` where ``b'`` is its
    own right block; a guest goes to every ``(l, b')``.  A unit is one left
    block of a cell; units are numbered through the cells.
    """
    size = pivots.shape[1]
    first_unit = np.cumsum(blocks[:, 0]) - blocks[:, 0]
    cells = np.flatnonzero((first_unit < units[1]) & (first_unit + blocks[:, 0] > units[0]))
    between = _between(pivots, cells)
    # the left blocks of each of these cells that belong to the round
    low = np.maximum(units[0] - first_unit[cells], 0)
    high = np.minimum(units[1] - first_unit[cells], blocks[cells, 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("node").to_pylist(), size)
            ids = batch.column("id").to_numpy()
            home = batch.column("home").to_numpy()
            may = _may_visit(points, home, pivots, cells, between, radius, reach) | (cells[None, :] == home[:, None])
            row, at_cell = np.nonzero(may)
            cell, lows, highs = cells[at_cell], low[at_cell], high[at_cell]
            mixed = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            lefts, rights = blocks[cell, 0], blocks[cell, 1]
            own_left, own_right = (mixed % lefts.astype(np.uint64)).astype(int), (mixed % rights.astype(np.uint64)).astype(int)
            is_home = home[row] == cell
            for left_side in (True, False):
                pick = np.flatnonzero(is_home & (own_left >= lows) & (own_left < highs)) if left_side else np.arange(len(row))
                times = rights[pick] if left_side else (highs - lows)[pick]
                at = np.repeat(pick, times)
                step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                left = own_left[at] if left_side else lows[at] + step
                right = step if left_side else own_right[at]
                part = np.full(len(at), HOME) if left_side else np.where(is_home[at], HOME_AGAIN, GUEST)
                for start in range(0, len(at), 4096):
                    cut = slice(start, start + 4096)
                    base = batch.take(pa.array(row[at[cut]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[at[cut]].astype(np.int32)), pa.array(left[cut].astype(np.int32)),
                         pa.array(right[cut].astype(np.int32)), base.column("id"), base.column("node"),
                         base.column("copies"), pa.array(part[cut].astype(np.int32))],
                        names=["cell", "left", "right", "id", "node", "copies", "part"])

    return homes.mapInArrow(
        run, "cell int, left int, right int, id long, node binary, copies long, part int")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component under the links ``a - b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _join_cells(visits: DataFrame, size: int, cosine: float, step: int = 512) -> DataFrame:
    """Rows ``id, links, root``: links counted for a node (root null), or a forest link (links 0).

    Two homes of a cell meet twice, once with each on the left, so the left
    one is counted; a home and a guest meet once, so both are.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["part"] == HOME], group[group["part"] != HOME]
        x, y = _matrix(left["node"], size), _matrix(right["node"], size)
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        copies, weights = left["copies"].to_numpy(), right["copies"].to_numpy()
        guest = right["part"].to_numpy() == GUEST
        every, where = np.unique(np.concatenate((ids, others)), return_inverse=True)
        links, back, forest = np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64), np.arange(len(every))
        for start in range(0, len(ids), step):
            a, b = np.nonzero(x[start: start + step] @ y.T >= cosine)
            a += start
            apart = ids[a] != others[b]
            a, b = a[apart], b[apart]
            if len(a):
                links += np.bincount(a, weights[b], len(ids)).astype(np.int64)
                back += np.bincount(b[guest[b]], copies[a[guest[b]]], len(others)).astype(np.int64)
                forest = _roots(len(every), forest[where[a]], forest[where[len(ids) + b]])[forest]
        moved = np.flatnonzero(forest != np.arange(len(every)))
        some, some_back = links > 0, back > 0
        counted = np.concatenate((ids[some], others[some_back]))
        return pd.DataFrame({"id": np.concatenate((counted, every[moved])),
                             "links": np.concatenate((links[some], back[some_back], np.zeros(len(moved), np.int64))),
                             "root": pd.array([None] * len(counted) + every[forest[moved]].tolist(), dtype="Int64")})

    return visits.groupBy("cell", "left", "right").applyInPandas(run, "id long, links long, root long")


def near_vectors(vectors: DataFrame, *, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding",
                 cell: int = 4096, max_pivots: int = 1024, block: int = 4096, seed: int = 3,
                 round_bytes: int = 128 << 20) -> DataFrame:
    """Links and components of vectors whose cosine is at least ``cosine`` (over 0), for every row.

    Returns ``key, n_links long, component_id (the key's type), kept
    boolean``.  Copies of a vector are linked with one another.

    About one pivot per ``cell`` nodes is drawn, at most ``max_pivots``; that
    bounds what the driver and the tasks hold, and more nodes per pivot mean
    more block pairs.  Block pairs are joined in rounds: one round's shuffle
    holds about as many bytes as the vectors themselves (at least
    ``round_bytes``), so the disk doesn't grow with the number of pairs, which
    is the square of the vectors where they have no structure.
    Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; so do vectors of different
    lengths with one another.  Repeated rows count as copies.  Rows with a
    null key take part, and a component without any key has a null id.  An
    empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    if not 0 < cosine <= 1:
        raise ValueError("0 < cosine <= 1 is needed")
    spark = vectors.sparkSession
    found_nodes = unit_nodes(vectors, key, vector)
    id_ = F.xxhash64("node")
    rows = materialised(found_nodes.select("key", F.when(F.col("node").isNotNull(), id_).alias("id"),
                                           F.length("node").alias("bytes")))
    reach = math.acos(cosine)
    totals = rows.where("id is not null").groupBy("bytes").agg(F.count_distinct("id").alias("n")).collect()
    nodes, parts = [], []
    for length, total in sorted((r["bytes"], r["n"]) for r in totals):
        size, wanted = length // 8, min(max_pivots, max(1, total // cell))
        of_size = found_nodes.where(F.length("node") == length)
        drawn = [r["id"] for r in rows.where(F.col("bytes") == length).select("id").distinct()
                 .orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(wanted).collect()]
        picked = of_size.withColumn("id", id_).where(F.col("id").isin(drawn)).groupBy("id").agg(F.first("node").alias("node"))
        pivots = _matrix([r["node"] for r in sorted(picked.collect(), key=lambda r: drawn.index(r["id"]))], size)
        homes = materialised(_homes(of_size.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).select(
            id_.alias("id"), "node", "copies"), pivots))
        release(spark)
        nodes.append(homes.select("id", "copies"))
        radius, members = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
        for r in homes.groupBy("home").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect():
            radius[r["home"]], members[r["home"]] = r["r"], r["n"]
        others = members + _count_guests(homes, pivots, radius, reach)
        blocks = np.stack((np.maximum(1, -(-members // block)), np.maximum(1, -(-others // block))), axis=1)
        # rows that meet in the units of a cell: its homes at every right block, homes and guests at every left block
        met = np.repeat(-(-members // blocks[:, 0]) * blocks[:, 1] + others, blocks[:, 0])
        for units in _rounds(met * (length + 40), max(round_bytes, total * length)):
            joined = _join_cells(_visits(homes, pivots, radius, reach, blocks, units), size, cosine)
            parts.append(materialised(joined.groupBy("id", "root").agg(F.sum("links").alias("links"))))
            joined = None
            release(spark)  # the next round's shuffle files take the place of these
    none = spark.createDataFrame([], "id long, root long, links long")
    links = reduce(DataFrame.unionByName, parts, none)
    nodes = reduce(DataFrame.unionByName, nodes, spark.createDataFrame([], "id long, copies long"))
    counted = links.where("root is null").groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(nodes.select(F.col("id").alias("node")),
                                     links.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    least = (rows.where("id is not null").groupBy("id").agg(F.min("key").alias("least"))
             .withColumnRenamed("id", "node").join(component, "node"))
    named = least.groupBy("component").agg(F.min("least").alias("component_id"))
    found = (nodes.join(counted, "id", "left").join(component.withColumnRenamed("node", "id"), "id").join(named, "component")
             .select(F.col("id").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     "component_id"))
    out = rows.join(found, F.col("id") == F.col("of"), "left")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("of").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
