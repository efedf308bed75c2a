"""Operator 6: near-duplicate texts by circulant MinHash, banding and exact Jaccard verification.

A text's set holds its distinct word shingles.  Its signature is circulant
(C-MinHash): a first permutation sends each shingle to one of ``DOMAIN``
places, a second permutation ``T`` is read from that place, and coordinate
``k`` is the minimum of ``T`` shifted circularly by ``k``.  Two permutations
thus serve all coordinates, and the values of one shingle for all of them
are neighbouring entries of ``T``.

1. *Sketch*: one pass over the texts gives each the size, the 128-bit digest
   and the band hashes of its set.  Texts with equal digests are one node
   from here on, however many there are.
2. *Star pairs*: in each band bucket, every node is paired with the bucket's
   centre, the node that meets most others over all buckets, so a bucket of
   ``m`` nodes yields ``m - 1`` pairs.
3. *Verification*: pairs are joined with the full shingle sets, and the
   integer test ``100 * intersection >= percent * union`` decides.
4. *Outliers*: a node that the links so far don't connect with its centre
   may still be linked with another node of the bucket.  The outliers of a
   centre are compared with all its nodes in blocks of bounded size, one
   task per pair of blocks, by counting common shingles through an inverted
   index.  A task lists one link per outlier and component at most, so the
   pairs of a large group are never listed.  Every pair that meets in a bucket is thus
   tested or already connected.
5. Components of all links; each is named by its smallest key.

With 42 bands of 6 rows, a pair at similarity 0.8 misses every bucket with
probability ``(1 - 0.8^6)^42``, about 3e-6; more similar pairs less often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches, connected_components, materialised

DOMAIN = 1 << 20


# --- sets and signatures -------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; of all words at once where there are fewer.

    A-Z are lower-cased; words are runs of anything but space and
    ``\\x09-\\x0D``.  No words: the empty set.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, found)), dtype=np.uint64)
    width = min(words, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i: i + len(total)])
    return np.unique(total)


@lru_cache(2)
def _circle(size: int, seed: int) -> np.ndarray:
    """The second permutation, written on past its end so that shifts are slices."""
    turn = np.random.default_rng(seed).permutation(DOMAIN).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((turn, turn[:size])), size)


def signature(shingles: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a non-empty set."""
    circle = _circle(size, seed)
    places = (_mix(shingles + np.uint64(seed)) % np.uint64(DOMAIN)).astype(np.int64)
    best = circle[places[0]].copy()
    for start in range(0, len(places), 2048):
        np.minimum(best, circle[places[start: start + 2048]].min(axis=0), out=best)
    return best


def band_hashes(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` coordinates, different for equal rows in different bands."""
    bands = coordinates.reshape(-1, rows)
    total = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return total.view(np.int64)


# --- the distributed steps -----------------------------------------------


def _per_text(fn: Callable[[str | None], tuple], types: tuple, names: list[str]):
    """An Arrow function that keeps column 0 and replaces column 1, the text, by the columns of ``fn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(v.as_py()) for v in batch.column(1)]
            columns = zip(*rows) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                                             names=names)
    return run


def sketch(slim: DataFrame, *, words: int, bands: int, rows: int) -> DataFrame:
    """``key, n long, node binary, bands array<long>`` per row of ``slim(key, text)``; empty sets have no node."""

    def one(text: str | None) -> tuple:
        shingles = shingle_set(text, words)
        if not len(shingles):
            return 0, None, []
        return (len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()),
                band_hashes(signature(shingles, bands * rows), rows))

    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(_per_text(one, (pa.int64(), pa.binary(), pa.list_(pa.int64())), ["key", "n", "node", "bands"]),
                           f"key {kind}, n long, node binary, bands array<long>")


def _sets(slim: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, shingles binary`` for the nodes of ``wanted(key, node)``."""

    def one(text: str | None) -> tuple:
        raw = shingle_set(text, words).tobytes()
        return xxhash.xxh3_128_digest(raw), raw

    kind = slim.schema["key"].dataType.simpleString()
    keys = wanted.select(F.col("key").alias("wanted"))
    texts = slim.join(keys, F.col("key").eqNullSafe(F.col("wanted")), "left_semi").select("key", "text")
    made = texts.mapInArrow(_per_text(one, (pa.binary(), pa.binary()), ["key", "node", "shingles"]),
                            f"key {kind}, node binary, shingles binary")
    return made.join(wanted.select("node"), "node", "left_semi").select("node", "shingles").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets pass the test."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(test, "a binary, b binary")


def _outlier_links(members: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """Links ``a, b`` between outliers and other nodes of their centre, in other components.

    ``members(centre, node, n, component, out)``.  Blocks hold about ``size``
    shingles, however many nodes a centre has.
    """
    amount = F.col("n").cast("double")
    blocks = members.groupBy("centre").agg(
        F.ceil(F.sum(F.when(F.col("out"), amount)) / size).cast("int").alias("lefts"),
        F.ceil(F.sum(amount) / size).cast("int").alias("rights"), F.count(F.lit(1)).alias("nodes")) \
        .where("lefts >= 1 and nodes > 1").drop("nodes")
    dealt = members.join(blocks, "centre")
    place = F.xxhash64("node")

    def side(rows: DataFrame, left: bool) -> DataFrame:
        own, other = ("lefts", "rights") if left else ("rights", "lefts")
        mine = F.pmod(place, F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.select("centre", (mine if left else each).alias("l"), (each if left else mine).alias("r"),
                           "node", "component", F.lit(left).alias("left"))

    rows = side(dealt.where("out"), True).unionByName(side(dealt, False)).join(
        sets.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left"]], group[~group["left"]].reset_index(drop=True)
        theirs = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
        sizes = np.array([len(x) for x in theirs], dtype=np.int64)
        owner = np.repeat(np.arange(len(theirs)), sizes)
        flat = np.concatenate(theirs) if theirs else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        component = right["component"].to_numpy()
        found = []
        for node, label, raw in zip(left["node"], left["component"], left["shingles"]):
            mine = np.frombuffer(raw, np.uint64)
            low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(theirs))
            near = np.flatnonzero(100 * both >= percent * (len(mine) + sizes - both))
            # one link into each other component is enough
            ends = {c: i for i, c in zip(near.tolist(), component[near]) if c != label}
            found.extend((node, right["node"][i]) for i in ends.values())
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("centre", "l", "r").applyInPandas(compare, "a binary, b binary")


def _near(n: str, m: str, percent: int):
    """Sizes that allow the similarity at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 42, rows: int = 6,
                    block: int = 500_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of texts whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns per row ``key, n_shingles long, component_id (the key's type),
    kept boolean``: the smallest key that links can reach, itself
    included, and whether the row bears that key.

    Null, empty and blank texts have an empty set and link with nothing.
    Texts of fewer words than a shingle have one shingle of all their words.
    Repeated rows are in one component; two rows may then bear the smallest
    key, and both are kept.  Rows with a null key take part; a component
    whose keys are all null has a null id and is kept.  An empty table gives
    no rows.  Other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = materialised(sketch(slim, words=words, bands=bands, rows=rows))
    classes = made.where("n > 0").groupBy("node").agg(F.min("key").alias("least"))

    bucket = Window.partitionBy("band")
    met = materialised(
        made.where("n > 0").dropDuplicates(["node"]).select("node", "n", F.explode("bands").alias("band"))
        .withColumn("others", F.count(F.lit(1)).over(bucket) - 1).where("others > 0"))
    weights = met.groupBy("node").agg(F.sum("others").alias("weight"))
    members = materialised(weights.select("node"))
    centre = F.max(F.struct("weight", "node", "n")).over(bucket)
    stars = materialised(
        met.join(weights, "node").withColumn("centre", centre).where("node <> centre.node")
        .select("node", "n", F.col("centre.node").alias("centre"), F.col("centre.n").alias("m")).distinct())
    sets = materialised(_sets(slim, classes.join(members, "node", "left_semi")
                              .select(F.col("least").alias("key"), "node"), words))
    pairs = stars.where(_near("n", "m", percent)).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    links = materialised(_linked(pairs, sets, percent))
    component = materialised(connected_components(members, links))

    own = component.select("node", "component")
    theirs = component.select(F.col("node").alias("centre"), F.col("component").alias("main"))
    around = stars.join(own, "node").join(theirs, "centre").select(
        "centre", "node", "n", "component", (F.col("component") != F.col("main")).alias("out"))
    more = _outlier_links(around, sets, percent, block)
    joined = connected_components(members, links.union(more))

    whole = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = whole.join(ids, "component").select(F.col("node").alias("of"), "component_id")
    return made.select("key", "n", "node").join(by_node, F.col("node") == F.col("of"), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")) \
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
