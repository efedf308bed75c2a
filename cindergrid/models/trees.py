"""Tree ensembles as node tables: forests (M2, M5) and Newton boosting (M3, M6).

A fitted ensemble is a DataFrame with one row per node, not an object of the
driver: ``tree, node, part, feature, threshold, left, right, value, weight``.
Rows with ``x[feature] <= threshold`` go left; a leaf has ``feature`` -1.

Growing has two stages, whose splits follow one rule (below):

* *Levels.*  While a node holds more than ``limit`` rows, one job a level
  finds the splits of all such nodes of all trees: tasks route their rows
  through the nodes grown so far and add up a histogram per node, feature
  and bin; a grouped sum and one small task a node pick the split.
* *Parts.*  A node of at most ``limit`` rows becomes a part: its rows are
  dealt to one task, which grows the subtree to its end, so depth has no
  limit but the data.  Only nodes above the parts ever reach the driver;
  their number is checked against ``most_top``.

What follows single rows through single nodes (histograms, dealing, growing,
scoring) runs as the compiled loops of :mod:`cindergrid.models.tree_steps`.

**Split rule.**  The split maximises ``S_l^2 / W_l + S_r^2 / W_r`` (W sums of
weights, S of weights times target), which is the variance criterion, and for
a 0/1 target the Gini one.  Ties go to the lower feature, then the lower
threshold.  A threshold is the middle of the two values around it.  A node is
a leaf when all its targets are equal or no feature has two values.  In the
level stage a feature of more than ``bins`` distinct values is cut at that
many quantiles only; everything else is exact.

**Random choices** are hashes of row key, seed and tree, so they depend on
neither partitioning nor order.  A bootstrap draws each row Poisson(1) times.
``max_features`` takes that many features with two values in the node.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.models import tree_steps as steps
from cindergrid.session import materialize, release, ship_package

NODES = ("tree int, node long, part long, feature int, threshold double, left long, right long, value double, weight double")
PRIME = 2147483647
_POISSON = np.floor(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)]) * PRIME).astype(np.int64)


# --- random choices ------------------------------------------------------


def row_hash(keys: Sequence[str]) -> Column:
    """A whole number below ``PRIME`` from the row's key columns."""
    text = F.concat_ws("#", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(PRIME)).cast("long")


def draw_constants(seed: int, tree: int) -> tuple[int, int]:
    """Factor and addend of one tree's hash ``(row * factor + addend) % PRIME``."""
    digest = hashlib.md5(f"{seed}#{tree}".encode()).hexdigest()
    return 1 + int(digest[:8], 16) % (PRIME - 1), int(digest[8:16], 16) % PRIME


def _uniform(rid: np.ndarray, seed: int, tree: int) -> np.ndarray:
    factor, addend = draw_constants(seed, tree)
    # the remainder by 2^31 - 1 is the sum of the digits to that base
    found = rid.astype(np.int64) * factor
    found += addend
    for _ in range(2):
        found = (found & PRIME) + (found >> 31)
    found[found == PRIME] = 0
    return found


def bootstrap_counts(rid: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1) by its hash."""
    return np.searchsorted(_POISSON, _uniform(rid, seed, tree), side="right")


def feature_order(node: np.ndarray, features: int, tree: int, seed: int) -> np.ndarray:
    """A pseudo-random rank of the features at each node."""
    h = node.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + tree)
    h = h + np.arange(1, features + 1, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.argsort(np.argsort(h ^ (h >> np.uint64(31)), axis=1, kind="stable"), axis=1, kind="stable")


def _allowed(splittable: np.ndarray, rank: np.ndarray | None, m: int | None) -> np.ndarray:
    """``nodes x features``: the first ``m`` features by rank among those that can split the node."""
    if rank is None or m is None:
        return splittable
    order = np.argsort(rank, axis=1)
    sorted_ = np.take_along_axis(splittable, order, axis=1)
    first = sorted_ & (np.cumsum(sorted_, axis=1) <= m)
    out = np.zeros_like(splittable)
    np.put_along_axis(out, order, first, axis=1)
    return out


# --- one part in one task ------------------------------------------------


def middle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The middle of two neighbouring values, the lower one where rounding reaches the upper."""
    with np.errstate(invalid="ignore", over="ignore"):
        t = (low + high) / 2
    return np.where((t >= high) | ~np.isfinite(t), low, t)


def _class_counts(y: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray] | None:
    """The unit weight of targets 0 and of targets 1, and how many units each row has, where the rows are of that kind.

    Counts of targets 1 stand in the upper half of the number, so that one sum adds up both.
    """
    ones = y == 1
    if not (ones | (y == 0)).all():
        return None
    units, counts = [1.0, 1.0], np.zeros(len(y), np.int64)
    for c, own in enumerate((~ones, ones)):
        if own.any():
            units[c] = float(w[own].min())
            times = np.rint(w[own] / units[c])
            if times.sum() >= 1 << 31 or not np.allclose(times * units[c], w[own], rtol=1e-14, atol=0):
                return None
            counts[own] = times.astype(np.int64) << (32 * c)
    return units[0], units[1], counts


def _in_slots(slot: np.ndarray, code: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``code`` and ``row`` by slot, code and row; each is a number of at most ``bits`` bits.

    The code may keep the slot above it: it is compared inside slots, and its lowest ``bits`` bits are read.
    """
    if 3 * bits > 63:
        order = np.lexsort((row, code, slot))
        return code[order].astype(np.int64), row[order]
    # numbers that hold all three are sorted without gathering
    key = slot << bits
    key |= code
    key <<= bits
    key |= row
    key.sort()
    return key >> bits, key & ((1 << bits) - 1)


def _turns(s: np.ndarray) -> np.ndarray:
    """Where the stretches of equal numbers begin."""
    return np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))


def grow_part(x: np.ndarray, y: np.ndarray, w: np.ndarray, *, depth: int | None, m: int | None = None, tree: int = 0,
              part: int = 0, seed: int = 0) -> dict[str, np.ndarray]:
    """A whole subtree, all open nodes of a level at a time; nodes are numbered from 0, children are -1 at leaves.

    The compiled step ``grow`` makes the same subtree; this is its plain form, which the tests hold it to.  Each node tries its features in their random order until ``m`` of them
    had two values, so the others cost nothing.  Rows of two classes with one
    weight each are counted in whole numbers; equal gains are then equal.
    """
    n, f = x.shape
    wy, bits = w * y, max(1, (n - 1).bit_length())
    values, codes = [], np.empty((f, n), np.int32)
    for j in range(f):
        found, codes[j] = np.unique(x[:, j], return_inverse=True)
        values.append(found)
    base, values, codes = np.cumsum([0, *map(len, values)])[:-1], np.concatenate(values), codes.ravel()
    mask = (1 << bits) - 1
    drawn = m is not None and m < f
    classes = _class_counts(y, w)
    terms = [w, wy] if classes is None else [classes[2]]

    def sums(parts: list[np.ndarray]) -> list[np.ndarray]:
        if classes is None:
            return parts
        ones = classes[1] * (parts[0] >> 32)
        return [classes[0] * (parts[0] & 0xFFFFFFFF) + ones, ones]

    made = {"feature": [], "threshold": [], "left": [], "right": [], "weight": [np.array([w.sum()])], "total": [np.array([wy.sum()])]}
    row, slot = np.arange(n), np.zeros(n, np.int64)
    flat = np.zeros((1, f), bool)  # features known to have one value in the node
    size, level = 1, 0
    while True:
        # the open nodes are the last ones made
        k = len(flat)
        open_ = np.arange(size - k, size)
        best, best_j = np.full(k, -np.inf), np.full(k, f)
        low, high = np.zeros(k, np.int64), np.zeros(k, np.int64)
        if depth is None or level < depth:
            start = _turns(slot)
            impure = np.maximum.reduceat(y[row], start) > np.minimum.reduceat(y[row], start)
        else:
            impure = np.zeros(k, bool)
        if impure.any():
            if classes is not None and not impure.all():
                kept = impure[slot]
                row, slot = row[kept], slot[kept]
            order = np.argsort(feature_order(part * 1_000_003 + open_, f, tree, seed), axis=1) if drawn else None
            wanted = np.where(impure, m, 0) if drawn else None
            for p in range(f):
                j_of = order[:, p] if drawn else np.full(k, p)
                r, s = row, slot
                if drawn:
                    trying = (wanted > 0) & ~flat[np.arange(k), j_of]
                    if not trying.any():
                        continue
                    if not trying.all():
                        kept = trying[slot]
                        r, s = row[kept], slot[kept]
                c, r = _in_slots(s, codes[(j_of * n)[s] + r], r, bits)
                at = np.flatnonzero((s[:-1] == s[1:]) & (c[:-1] != c[1:]))
                here = s[at]
                if drawn:
                    constant = trying.copy()
                    constant[here] = False
                    flat[constant, j_of[constant]] = True
                if not len(at):
                    continue
                start = _turns(s)
                which, stop = s[start], np.append(start[1:], len(s)) - 1
                lefts_, rights_ = [], []
                for term in terms:
                    each = term[r]
                    upto = np.cumsum(each)
                    before, whole = np.zeros(k, each.dtype), np.zeros(k, each.dtype)
                    before[which] = upto[start] - each[start]
                    whole[which] = upto[stop] - before[which]
                    lefts_.append(upto[at] - before[here])
                    rights_.append(whole[here] - lefts_[-1])
                (wl, sl), (wr, sr) = sums(lefts_), sums(rights_)
                gain = sl * sl / wl + sr * sr / wr
                first = _turns(here)
                slots, top = here[first], np.maximum.reduceat(gain, first)
                hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(at)))))
                pick = at[hit[_turns(here[hit])]]
                if drawn:
                    wanted[slots] -= 1
                j = j_of[slots]
                better = (top > best[slots]) | ((top == best[slots]) & (j < best_j[slots]))
                slots, pick = slots[better], pick[better]
                best[slots], best_j[slots], low[slots], high[slots] = top[better], j[better], c[pick] & mask, c[pick + 1] & mask
        split = np.flatnonzero(impure & (best_j < f))
        j = best_j[split]
        feature, threshold, left, right = np.full(k, -1), np.full(k, np.nan), np.full(k, -1), np.full(k, -1)
        feature[split], threshold[split] = j, middle(values[base[j] + low[split]], values[base[j] + high[split]])
        left[split] = size + 2 * np.arange(len(split))
        right[split] = left[split] + 1
        for name, column in (("feature", feature), ("threshold", threshold), ("left", left), ("right", right)):
            made[name].append(column)
        if not len(split):
            break
        # nodes that stay leaves are closed: their rows drop out of the next level
        kept = left[slot] >= 0
        row, slot = row[kept], slot[kept]
        child = left[slot] - size + (codes[(best_j * n)[slot] + row] > low[slot])
        opened = 2 * len(split)
        slot, row = _in_slots(np.zeros_like(child), child, row, bits)  # the slot is the code here
        made["weight"].append(np.bincount(slot, w[row], opened))
        made["total"].append(np.bincount(slot, wy[row], opened))
        flat = np.repeat(flat[split], 2, axis=0)
        size, level = size + opened, level + 1
    joined = {c: np.concatenate(v) for c, v in made.items()}
    weight, total = joined["weight"], joined.pop("total")
    return joined | {"value": total / np.where(weight > 0, weight, 1.0)}


# --- nodes above the parts -----------------------------------------------


@dataclass
class Top:
    """Nodes grown by level jobs, for all trees; a child that isn't split yet is an open node."""

    tree: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)

    def add(self, tree: int, depth: int, value: float = 0.0, weight: float = 0.0) -> int:
        for column, v in ((self.tree, tree), (self.feature, -1), (self.threshold, math.nan), (self.left, -1),
                          (self.right, -1), (self.value, value), (self.weight, weight), (self.depth, depth)):
            column.append(v)
        return len(self.tree) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.threshold, float), np.array(self.left, np.int64),
                np.array(self.right, np.int64))


def route(x: np.ndarray, root: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray,
          row: np.ndarray | None = None) -> np.ndarray:
    """The node without children that each row reaches from its root; ``row`` names the row of each start."""
    at = root.copy()
    row = np.arange(len(x)) if row is None else row
    moving = np.flatnonzero(feature[at] >= 0)
    x, first, here = np.ascontiguousarray(x).ravel(), row[moving] * x.shape[1], at[moving]
    while len(moving):
        here = np.where(x[first + feature[here]] <= threshold[here], left[here], right[here])
        going = feature[here] >= 0
        if not going.all():
            there = ~going
            at[moving[there]] = here[there]
            moving, first, here = moving[going], first[going], here[going]
    return at


def above(ends: Sequence[int], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which nodes have one of the ``ends`` below them."""
    parent = np.full(len(left), -1)
    for side in (left, right):
        parent[side[side >= 0]] = np.flatnonzero(side >= 0)
    found, at = np.zeros(len(left), bool), np.array(ends, np.int64)
    while len(at):
        at = np.unique(parent[at])
        at = at[at >= 0]
        at = at[~found[at]]
        found[at] = True
    return found


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    # unknown values lie below every threshold
    return np.where(np.isnan(values), -np.inf, values)


def training_rows(df: DataFrame, features: Sequence[str] | str, label: str, key: Sequence[str], weight: str | None
                  ) -> DataFrame:
    """``rid, x, y, w`` of the rows with a label and a positive weight, written once."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(
        *[F.col(c).cast("double") for c in features])
    rows = df.select(row_hash(key).alias("rid"), x.alias("x"), F.col(label).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return rows.where(F.col("y").isNotNull() & ~F.isnan("y") & (F.col("w") > 0) & F.col("x").isNotNull())


def row_tasks(n: int, cores: int) -> int:
    """Tasks for ``n`` training rows: one a core where each has at least 4,096, four where each has 65,536, and at most
    262,144 rows a task."""
    return max(1, min(cores, n >> 12), min(4 * cores, n >> 16), math.ceil(n / (1 << 18)))


BLOCK = 1 << 16


def row_blocks(rows: DataFrame, features: int, kept: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Blocks of about ``size`` rows: ``n`` and the ``kept`` columns, then the values of ``x`` row by row, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks((b.slice(i, size) for b in batches for i in range(0, len(b), size)), size):
            columns = [batch.column(c).to_numpy() for c in kept]
            body = b"".join(c.tobytes() for c in (*columns, np.ascontiguousarray(_matrix(batch.column("x"), features))))
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int32()), pa.array([body], pa.binary())],
                                             names=["n", "body"])

    return rows.select(*kept, "x").mapInArrow(run, "n int, body binary")


@dataclass
class Bins:
    """Cut points of every feature: its values where it has few (``exact``), else quantiles."""

    edges: list[np.ndarray]
    exact: list[bool]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value: the first edge that isn't below it."""
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], axis=1)

    @property
    def width(self) -> int:
        return max(len(e) for e in self.edges) + 1

    def threshold(self, feature: int, low: int, high: int) -> float:
        e = self.edges[feature]
        return float(middle(e[low: low + 1], e[high: high + 1])[0]) if self.exact[feature] else float(e[low])


def find_bins(rows: DataFrame, features: int, bins: int) -> Bins:
    """At most ``bins`` edges a feature: all values of features with that few, quantiles (to 1 / 10 of a bin) of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * features
        for batch in batches:
            x = _matrix(batch.column(0), features)
            # one value more than a feature may have says that it has too many
            seen = [np.unique(np.concatenate((s, x[:, j])))[: bins + 1] for j, s in enumerate(seen)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(features), [len(s) for s in seen]).astype(np.int32)), pa.array(np.concatenate(seen))],
            names=["j", "v"])

    ship_package(rows.sparkSession)
    values: list[list[float]] = [[] for _ in range(features)]
    seen = materialize(rows.select("x").mapInArrow(run, "j int, v double").distinct())
    few = [r["j"] for r in seen.groupBy("j").agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] <= bins]
    for r in seen.where(F.col("j").isin(few)).collect():  # at most features * bins values
        values[r["j"]].append(r["v"])
    many = [j for j, v in enumerate(values) if not v]
    exact = [bool(v) for v in values]
    if many:
        shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        cuts = rows.agg(*[F.percentile_approx(F.coalesce(F.col("x")[j], F.lit(-math.inf)), shares, F.lit(10 * bins))
                          .alias(f"q{j}") for j in many]).first()
        for j in many:
            values[j] = list(cuts[f"q{j}"] or [])
    return Bins([np.unique(np.array(v, float)) for v in values], exact)


SPLITS = "slot int, feature int, low int, high int, n_l long, w_l double, s_l double, h_l double, n_r long, w_r double, " \
    "s_r double, h_r double"


def split_of(dense: dict[str, np.ndarray], q: float, m: int | None = None, seed: int = 0, name: tuple[int, int] = (0, 0)
             ) -> dict[str, float]:
    """The split of one node's sums ``features x bins`` by name: ``feature``, the bins around it and both sides' sums.

    ``q`` is the node's sum of squared targets; ``feature`` is -1 without a split.
    """
    features, width = dense["n"].shape
    upto = {c: np.cumsum(v, axis=1) for c, v in dense.items()}
    whole = {c: v[:, -1:] for c, v in upto.items()}
    there = dense["n"] > 0
    ok = there & (upto["n"] < whole["n"])
    with np.errstate(divide="ignore", invalid="ignore"):
        sl, wl = upto["s"], upto["w"]
        gain = np.where(ok, sl * sl / wl + (whole["s"] - sl) ** 2 / (whole["w"] - wl), -np.inf)
    use = ok.any(axis=1)
    if m is not None and m < features:
        use = _allowed(use[None], feature_order(np.array([name[1] * 1_000_003]), features, name[0], seed), m)[0]
    gain[~use] = -np.inf
    j, low = divmod(int(np.argmax(gain)), width)
    # targets that are all equal have no spread about their mean
    w, s = whole["w"][j, 0], whole["s"][j, 0]
    if not use.any() or q - s * s / w <= 1e-12 * q:
        found = {"feature": -1, "low": 0, "high": 0}
        sides = [{c: whole[c][0, 0] for c in "nwsh"}, dict.fromkeys("nwsh", 0.0)]
    else:
        found = {"feature": j, "low": low, "high": low + 1 + int(np.argmax(there[j, low + 1:]))}
        sides = [{c: upto[c][j, low] for c in "nwsh"}, {c: whole[c][j, 0] - upto[c][j, low] for c in "nwsh"}]
    return found | {f"{c}_{side}": int(v) if c == "n" else float(v) for side, sums in zip("lr", sides) for c, v in sums.items()}


def best_splits(partial: DataFrame, bins: Bins, m: int | None = None, seed: int = 0, names: Sequence[tuple[int, int]] = ()
                ) -> DataFrame:
    """:func:`split_of` of every slot, in tasks, from rows ``slot, body``; ``names`` are (tree, node) of the slots.

    A body is rows, weights and targets of each bin of each feature, then the squared targets.
    """
    names, lengths, width = list(names), [len(e) + 1 for e in bins.edges], bins.width
    at = np.concatenate([j * width + np.arange(k) for j, k in enumerate(lengths)])
    features = len(lengths)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        sums = sum(np.frombuffer(b.as_py()) for b in group["body"])
        dense = np.zeros((4, features * width))
        dense[:3, at] = sums[:-1].reshape(-1, 3).T
        dense[3] = dense[1]  # a row's curvature is its weight
        dense = dict(zip("nwsh", dense.reshape(4, features, width)))
        row = {"slot": slot, **split_of(dense, float(sums[-1]), m, seed, names[slot])}
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        return pa.table({c: pa.array([row[c]], kinds[t]) for c, t in (p.split(" ") for p in SPLITS.split(", "))})

    return partial.groupBy("slot").applyInArrow(run, SPLITS)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """The batches put together to about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


# --- forests -------------------------------------------------------------


def _draws(top: Top, wanted: Iterable[int], bootstrap: bool, seed: int) -> tuple[np.ndarray, ...]:
    """The ``wanted`` trees with their roots and draws, as the compiled steps read them."""
    root = {top.tree[i]: i for i in range(len(top.tree)) if top.depth[i] == 0}
    trees = sorted(wanted)
    constants = np.array([draw_constants(seed, t) for t in trees], np.int64).reshape(-1, 2)
    return (np.array(trees), np.array([root[t] for t in trees]), *(steps.long(c) for c in constants.T.copy()),
            steps.long(_POISSON if bootstrap else []))


def _level(rows: DataFrame, top: Top, frontier: Sequence[int], bins: Bins, features: int, bootstrap: bool, seed: int,
           m: int | None) -> list:
    """The splits of the ``frontier`` nodes: one job.  ``rows`` are blocks."""
    slot_of = np.full(len(top.tree), -1)
    slot_of[list(frontier)] = np.arange(len(frontier))
    draws = _draws(top, {top.tree[i] for i in frontier}, bootstrap, seed)
    feature, *rest = top.arrays()
    feature[~above(frontier, *rest[1:])] = -1  # rows on their way to other nodes are left where that shows
    body = steps.state(features, feature, *rest, slot_of, *draws, np.cumsum([0, *map(len, bins.edges)]), np.concatenate(bins.edges),
                       len(frontier))
    names = [(top.tree[i], i) for i in frontier]
    # one set of histograms a core
    spread = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    found = best_splits(steps.run(spread, "level", body, "slot int, body binary"), bins, m, seed, names).collect()
    # nodes are numbered as their splits come, and draw features by number: in one order whatever task was first
    return sorted(found, key=lambda r: r["slot"])


@dataclass
class Forest:
    """A fitted ensemble: its node table (``NODES``) and how trees combine: ``mean`` of their values, or ``start + sum``.

    A forest grown to the end has more nodes than the table had rows, many
    times, so parts are kept as arrays and become node rows when asked for.
    """

    nodes: DataFrame
    features: int
    trees: int
    start: float | None = None  # None: mean of the trees
    packed: DataFrame | None = None  # the parts as ``PARTS``, a row a part, where the nodes are made from them
    tops: DataFrame | None = None  # and the nodes above them

    def write(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(path)


def fit_forest(df: DataFrame, features: Sequence[str] | str, label: str, key: Sequence[str], *, size: int | None = None,
               trees: int = 200, weight: str | None = None, max_features: int | None = None, max_depth: int | None = None,
               bootstrap: bool = True, bins: int = 256, limit: int = 1 << 16, most_top: int = 1 << 20, seed: int = 42,
               cells: int = 1 << 22, round_bytes: int = 2 << 30) -> Forest:
    """Forest of fully grown trees (or of ``max_depth``); a leaf's value is its weighted mean of the label.

    ``features`` are columns, or one array column of ``size`` values.  Rows
    without a label or a positive weight are left out; null features lie
    below every threshold.  With no rows left, each tree is one leaf of
    value 0.  A row's draws depend on ``key``, so rows with equal keys are
    drawn together.  ``limit`` is the number of rows that one task grows a
    subtree from, and rows are dealt to their parts for as many trees at a
    time as ``round_bytes`` hold; a forest whose level nodes would pass ``most_top`` raises.
    """
    f = size if isinstance(features, str) else len(features)
    if not f or trees < 1:
        raise ValueError("features and trees are needed")
    spark = df.sparkSession
    ship_package(spark)
    # each level and each round of parts reads all rows: they lie in enough tasks, however few ``df`` came in
    rows = training_rows(df, features, label, key, weight)
    n = rows.count()
    rows = materialize(rows.repartition(row_tasks(n, spark.sparkContext.defaultParallelism), "rid"))
    blocks = materialize(row_blocks(rows, f, ("rid", "y", "w")))
    top = Top()
    frontier = [top.add(t, 0) for t in range(trees)]
    bag = dict.fromkeys(frontier, n)
    large = [i for i in frontier if bag[i] > limit and (max_depth is None or max_depth > 0)]
    found_bins = find_bins(rows, f, bins) if large else None
    while large:
        following = []
        step = max(1, cells // sum(len(e) + 1 for e in found_bins.edges))  # nodes whose histograms a task holds at once
        for start in range(0, len(large), step):
            some = large[start: start + step]
            for r in _level(blocks, top, some, found_bins, f, bootstrap, seed, max_features):
                i = some[r["slot"]]
                w, s = r["w_l"] + r["w_r"], r["s_l"] + r["s_r"]
                top.value[i], top.weight[i] = s / w, w
                bag[i] = 0
                if r["feature"] < 0:
                    continue
                top.feature[i] = r["feature"]
                top.threshold[i] = found_bins.threshold(r["feature"], r["low"], r["high"])
                for side in "lr":
                    c = top.add(top.tree[i], top.depth[i] + 1, r[f"s_{side}"] / r[f"w_{side}"], r[f"w_{side}"])
                    bag[c] = r[f"n_{side}"]
                    following.append(c)
                top.left[i], top.right[i] = c - 1, c
        if len(top.tree) > most_top:
            raise ValueError(f"more than {most_top} nodes above the parts: raise limit or bound max_depth")
        following.sort(key=lambda i: top.tree[i])
        large = [i for i in following if bag[i] > limit and (max_depth is None or top.depth[i] < max_depth)]
    # leaves and inner nodes of the level stage, then the parts
    parts = {i for i, b in bag.items() if b and (max_depth is None or top.depth[i] < max_depth)}
    per_tree = max(1, n * (f + 2) * 8)
    together = max(1, round_bytes // per_tree)  # trees whose rows are dealt at a time
    packed = []
    for first in range(0, trees, together):
        some = {i for i in parts if first <= top.tree[i] < first + together}
        if some:
            packed.append(materialize(_grow_parts(blocks, top, some, f, max_depth, bootstrap, seed, max_features, n)))
            release(spark)
    grown = reduce(DataFrame.unionByName, packed, spark.createDataFrame([], PARTS))
    above = [(top.tree[i], i << 32, -1, top.feature[i], top.threshold[i] if top.feature[i] >= 0 else None,
              top.left[i] << 32 if top.feature[i] >= 0 else -1, top.right[i] << 32 if top.feature[i] >= 0 else -1,
              top.value[i], top.weight[i]) for i in range(len(top.tree)) if i not in parts]
    tops = materialize(spark.createDataFrame(above, NODES))
    return Forest(tops.unionByName(_node_rows(grown)), f, trees, packed=grown, tops=tops)


def _grow_parts(rows: DataFrame, top: Top, parts: set[int], f: int, max_depth: int | None, bootstrap: bool, seed: int,
                m: int | None, n: int) -> DataFrame:
    """The subtrees of the ``parts``, as ``PARTS``; ``rows`` are blocks of ``n`` rows in all."""
    is_part = np.zeros(len(top.tree), np.int32)
    is_part[list(parts)] = 1
    draws = _draws(top, {top.tree[i] for i in parts}, bootstrap, seed)
    dealt = steps.run(rows, "deal", steps.state(f, *top.arrays(), is_part, *draws), "tree int, part long, body binary")
    # a task's share of the dealt rows is some 32 MB
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(len(parts), max(4 * cores, len(draws[0]) * n * (f + 2) * 8 >> 25)))
    own = dealt.repartition(tasks, "tree", "part").sortWithinPartitions("tree", "part")
    body = steps.state(f, -1 if m is None else m, -1 if max_depth is None else max_depth, steps.long(seed), np.array(top.depth))
    return steps.run(own, "grow", body, PARTS)


PARTS = "tree int, part long, n long, body binary"


def _pack(made: dict[str, np.ndarray]) -> bytes:
    """A subtree as bytes: features, then thresholds of inner nodes and values of leaves, then the rest.

    Children aren't stored: :func:`grow_part` numbers the k-th inner node's
    2 k + 1 and 2 k + 2.  The first byte says whether features take 4 bytes
    instead of 1 (1), and weights 8 instead of 4 (2), where those are exact.
    """
    feature, weight = made["feature"], made["weight"]
    leaf = feature < 0
    wide, exact = bool(len(feature)) and feature.max() > 127, (weight.astype("<f4") == weight).all()
    columns = (feature.astype("<i4" if wide else "i1"), np.where(leaf, made["value"], made["threshold"]), made["value"][~leaf],
               weight.astype("<f4" if exact else "<f8"))
    return bytes([wide + 2 * (not exact)]) + b"".join(c.tobytes() for c in columns)


def _unpack(body: bytes, n: int) -> tuple[np.ndarray, ...]:
    """``feature, number, left, right, value, weight`` of a packed subtree; ``number`` is the threshold or a leaf's value."""
    feature = np.frombuffer(body, "<i4" if body[0] & 1 else "i1", n, 1).astype(np.int32)
    at = 1 + n * (4 if body[0] & 1 else 1)
    number = np.frombuffer(body, "<f8", n, at)
    inner = feature >= 0
    k = int(inner.sum())
    left = np.where(inner, 2 * np.cumsum(inner) - 1, -1)
    value = number.copy()
    value[inner] = np.frombuffer(body, "<f8", k, at + 8 * n)
    weight = np.frombuffer(body, "<f8" if body[0] & 2 else "<f4", n, at + 8 * (n + k)).astype(float)
    return feature, number, left, np.where(inner, left + 1, -1), value, weight


def _node_rows(packed: DataFrame) -> DataFrame:
    """The packed parts as rows of ``NODES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, part, n, body in zip(*(c.to_pylist() for c in batch.columns)):
                feature, number, left, right, value, weight = _unpack(body, n)
                leaf, base = feature < 0, part << 32
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, tree, np.int32)), pa.array(base + np.arange(n)), pa.array(np.full(n, part)),
                     pa.array(feature), pa.array(number, mask=leaf), pa.array(np.where(leaf, -1, base + left)),
                     pa.array(np.where(leaf, -1, base + right)), pa.array(value), pa.array(weight)],
                    names=[c.split(" ")[0] for c in NODES.split(", ")])

    return packed.mapInArrow(run, NODES)


def _packed_nodes(nodes: DataFrame) -> DataFrame:
    """Rows of ``NODES`` as ``PARTS``, for ensembles that come as a node table."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        made = {c: group[c].to_numpy() for c in ("feature", "threshold", "value", "weight")}
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "part": [key[1].as_py()], "n": [len(group)],
                         "body": pa.array([_pack(made)], pa.binary())})

    return materialize(nodes.where("part >= 0").groupBy("tree", "part").applyInArrow(run, PARTS))


# --- scoring -------------------------------------------------------------


def score_trees(df: DataFrame, model: Forest, features: Sequence[str] | str, out: str = "prediction",
                bundle: int = 1 << 22, block: int = 1 << 23, round_bytes: int = 2 << 30) -> DataFrame:
    """``df`` plus the ensemble's value for each row.

    Rows are routed through the nodes above the parts, which are few and
    checked; then rows meet the parts they need in bundles of about
    ``bundle`` nodes.  A bundle that more than about ``block`` pairs of a row
    and a part need is met by several blocks of rows, so a task holds one
    bundle and some rows whatever the size of the ensemble and of ``df``.
    Rows travel as arrays, and so do the bundles' sums on their way back, for
    as many bundles at a time as ``round_bytes`` hold.
    """
    spark = df.sparkSession
    ship_package(spark)
    f, cores = model.features, spark.sparkContext.defaultParallelism
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(
        *[F.col(c).cast("double") for c in features])
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__x", x))
    top = (model.nodes if model.packed is None else model.tops).where("part < 0").select(
        "tree", "node", "feature", "threshold", "left", "right", "value").collect()
    packed = model.packed if model.packed is not None else _packed_nodes(model.nodes)
    found = sorted((r["tree"], r["part"], r["n"]) for r in packed.select("tree", "part", "n").collect())
    bundle_of, held, whole, load, nodes_of = {}, 0, Counter(), Counter(), Counter()
    for tree, _, n in found:
        whole[tree] += n
    for tree, part, n in found:
        bundle_of[part] = held // bundle
        held += n
        nodes_of[bundle_of[part]] += n
        load[bundle_of[part]] += n / whole[tree]  # a row needs one part of a tree, about by their sizes
    total = rows.count()
    blocks = max(1, math.ceil(total * max(load.values(), default=0) / block))
    ranges = max(1, total * model.trees * 16 >> 25)  # of rows, whose sums one task adds up
    # the nodes above the parts under running numbers; parts hang below them as negative numbers, in the order of their names
    parts = sorted(bundle_of)
    number = {p << 32: -2 - k for k, p in enumerate(parts)} | {r["node"]: i for i, r in enumerate(top)}
    children = [[number[r[c]] if r["feature"] >= 0 else -1 for r in top] for c in ("left", "right")]
    inner = {r[c] for r in top for c in ("left", "right")}
    starts = [(r["tree"], number[r["node"]]) for r in top if r["node"] not in inner]
    starts += [(t, number[p << 32]) for t, p, _ in found if p << 32 not in inner]
    above = (np.array([r["feature"] for r in top], np.int32), np.array([np.nan if r["threshold"] is None else r["threshold"] for r in top], float),
             *np.array(children, np.int32).reshape(2, -1), np.array([r["value"] for r in top], float))
    spread = max(1, min(4 * cores, total >> 14))
    packed_rows = materialize(row_blocks(rows.select("__row", F.col("__x").alias("x")), f, ("__row",), 1 << 14).repartition(spread))
    # bundles a round: their nodes once a block, and the rows that need them
    bytes_of = {b: n * 9 * blocks + total * (8 * (f + 1) + 4 * load[b]) for b, n in nodes_of.items()}
    rounds, sent = [[]], 0
    for b in sorted(nodes_of):
        if rounds[-1] and sent + bytes_of[b] > round_bytes:
            rounds.append([])
            sent = 0
        rounds[-1].append(b)
        sent += bytes_of[b]
    sums = []
    for k, some in enumerate(rounds):
        own = set(some)
        trees_ = {t for t, p, _ in found if bundle_of[p] in own}
        home = np.array(parts, np.int32), np.array([bundle_of[p] - some[0] if bundle_of[p] in own else -1 for p in parts], np.int32), blocks
        begin = np.array([s for t, s in starts if k == 0 or t in trees_], np.int32)
        met = steps.run(packed_rows, "route", steps.state(f, *above, begin, *home, int(k == 0)), MEETING)
        if some:
            met = met.unionByName(steps.run(packed, "bundle", steps.state(*home), MEETING))
        tasks = max(cores, min(32 * cores, len(some) * blocks + 8))
        met = met.repartition(tasks, "bundle", "block").sortWithinPartitions("bundle", "block", "kind")
        sums.append(materialize(steps.run(met, "meet", steps.state(f, ranges), "range int, body binary")))
        if len(rounds) > 1:
            release(spark)

    def added(group: pa.Table) -> pa.Table:
        ids, made = [], []
        for body in group["body"]:
            body = body.as_py()
            ids.append(np.frombuffer(body, "<i8", len(body) // 16))
            made.append(np.frombuffer(body, "<f8", len(body) // 16, len(body) // 2))
        row, where = np.unique(np.concatenate(ids), return_inverse=True)
        return pa.table({"row": row, "total": np.bincount(where, np.concatenate(made), len(row))})

    totals = materialize(reduce(DataFrame.unionByName, sums).groupBy("range").applyInArrow(added, "row long, total double")
                         .withColumnRenamed("total", "__total"))
    combined = F.col("__total") / F.lit(float(model.trees)) if model.start is None else F.col("__total") + F.lit(model.start)
    return rows.join(totals, F.col("__row") == F.col("row"), "left").withColumn(out, combined).drop("__row", "__x", "row", "__total")


MEETING = "bundle int, block int, kind int, part int, n int, body binary"
