"""Operator 11: exact top-k inner products by distributed histogram selection.

Scores of all candidates are far too many to keep or to sort, so the k-th
best score of each query is located first:

1. every component becomes ``floor(scale * x)``, so scores are integers and
   equal on every machine;
2. queries and candidates are dealt into blocks by a hash of the row, and
   each task scores one block of queries against one block of candidates by
   a matrix product;
3. a task turns its scores into a histogram of ``bins`` bins per query, over
   the range that the query's k-th best score is known to lie in.  The sums
   of these histograms name the bin of the k-th best score, which is the
   range of the next round, and the number of scores above it.  Rounds end
   when every range is one integer wide (two or three for unit vectors);
4. a last pass keeps the scores above a query's k-th score, and as many ties
   as are still wanted, by the smallest key.

State is one row a query (range and count above), and stays distributed.  A
task sends at most ``k`` bins of a query: bins below the ``k`` best scores
that it has itself can't hold the global k-th.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches, materialised

MOST = (1 << 62) - 1  # scores and components are held within +-MOST, so that no range of scores passes 64 bits
_WIDTHS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def _packed(values: np.ndarray, most: int) -> bytes:
    """Integers as bytes of the least width that holds them, which is the first byte."""
    width = next(w for w in _WIDTHS if most < 1 << (8 * w - 1))
    return bytes([width]) + values.astype(_WIDTHS[width]).tobytes()


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """One row of 64-bit integers per vector."""
    found = [np.frombuffer(b, _WIDTHS[b[0]], offset=1) for b in column.to_pylist()]
    return np.stack(found).astype(np.int64) if found else np.empty((0, 0), np.int64)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products, in doubles where these hold every partial sum, else in Python's integers."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if bound < 1 << 52:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return np.clip(x.astype(object) @ y.astype(object).T, -MOST, MOST).astype(np.int64)


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``key, rid, size, most, body`` of the vectors that take part; ``most`` is the largest component without sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, mosts, bodies = [], [], []
            for v in batch.column("vector"):
                values = v.values.to_numpy(zero_copy_only=False).astype(float) if v.is_valid else None
                if values is None or not np.isfinite(values).all():
                    sizes.append(None), mosts.append(None), bodies.append(None)
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.floor(values * scale)
                whole = np.clip(scaled, -(2.0 ** 61), 2.0 ** 61).astype(np.int64)
                most = int(np.abs(whole).max(initial=0))
                sizes.append(len(whole)), mosts.append(most), bodies.append(_packed(whole, most))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("rid"), pa.array(sizes, pa.int32()), pa.array(mosts, pa.int64()),
                 pa.array(bodies, pa.binary())], names=["key", "rid", "size", "most", "body"])

    bounded_batches(vectors.sparkSession)
    slim = vectors.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("rid"),
                          F.col(vector).cast("array<double>").alias("vector"))
    return slim.mapInArrow(run, "key long, rid long, size int, most long, body binary").where("body is not null")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")


def _every(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


class _Blocks:
    """Queries with their state against candidates, a task for each pair of blocks."""

    def __init__(self, candidates: DataFrame, query_blocks: int, candidate_blocks: int):
        self.query_blocks, self.candidate_blocks = query_blocks, candidate_blocks
        self.candidates = candidates.select("key", "rid", "size", "body", _block(candidate_blocks).alias("right")) \
            .withColumn("left", _every(query_blocks))

    def pairs(self, queries: DataFrame, run, schema: str) -> DataFrame:
        left = queries.withColumn("left", _block(self.query_blocks)).withColumn("right", _every(self.candidate_blocks))
        keys = ["size", "left", "right"]
        return left.groupBy(*keys).cogroup(self.candidates.groupBy(*keys)).applyInArrow(run, schema)


def _scores(queries: pa.Table, candidates: pa.Table, step: int = 256) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Per few queries: their slice, the scores, and which of them count (all but a query's own row)."""
    if not len(queries) or not len(candidates):
        return
    x, y = _unpacked(queries["body"]), _unpacked(candidates["body"])
    mine, others = queries["rid"].to_numpy(), candidates["rid"].to_numpy()
    for start in range(0, len(x), step):
        cut = slice(start, start + step)
        yield cut, _products(x[cut], y), mine[cut, None] != others[None, :]


def _table(schema: str, *columns: list[np.ndarray]) -> pa.Table:
    """Lists of pieces as a table of whole-number columns."""
    parts = [f.rsplit(" ", 1) for f in schema.split(", ")]
    kinds = {"long": np.int64, "int": np.int32}
    return pa.table({n: np.concatenate([*c, np.empty(0)]).astype(kinds[t]) if not c else np.concatenate(c).astype(kinds[t])
                     for (n, t), c in zip(parts, columns)})


def _histograms(blocks: _Blocks, state: DataFrame, bins: int) -> DataFrame:
    """``rid, bin, scores``: how many scores lie in each bin of a query's range ``low .. low + span - 1``."""
    schema = "rid long, bin int, scores long"

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        low, span, need, ids = (queries[c].to_numpy() for c in ("low", "span", "need", "rid"))
        wide = ((span - 1) // bins + 1).astype(np.uint64)
        rid, place, n = [], [], []
        for cut, scores, use in _scores(queries, candidates):
            # unsigned, as the difference of two scores may pass the range of signed ones
            past = scores.astype(np.uint64) - low[cut, None].astype(np.uint64)
            use &= (scores >= low[cut, None]) & (past < span[cut, None].astype(np.uint64))
            rows, cols = np.nonzero(use)
            where = (past[rows, cols] // wide[cut][rows]).astype(np.int64)
            counts = np.bincount(rows * bins + where, minlength=len(scores) * bins).reshape(len(scores), bins)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            # a bin below as many scores of this task as are needed can't hold the k-th of all
            at, where = np.nonzero((counts > 0) & (above < need[cut, None]))
            rid.append(ids[cut][at]), place.append(where), n.append(counts[at, where])
        return _table(schema, rid, place, n)

    return blocks.pairs(state, run, schema).groupBy("rid", "bin").agg(F.sum("scores").alias("scores"))


def _narrowed(state: DataFrame, counts: DataFrame, bins: int) -> DataFrame:
    """Ranges cut down to the bin of the k-th best score; a query with too few scores keeps them all (span 0)."""
    down = Window.partitionBy("of").orderBy(F.col("bin").desc())
    upto = (counts.withColumnRenamed("rid", "of").withColumn("upto", F.sum("scores").over(down))
            .join(state.select(F.col("rid").alias("of"), F.col("need").alias("wanted")), "of").where("upto >= wanted")
            .groupBy("of").agg(F.max("bin").alias("bin"), F.min("upto").alias("upto"),
                               F.max_by("scores", "bin").alias("scores")))
    wide = F.expr(f"(span - 1) div {bins} + 1")
    start = F.col("bin") * wide
    inside = F.least(wide, F.col("span") - start)
    joined = state.join(upto, F.col("rid") == F.col("of"), "left")
    kept, open_ = F.col("span") <= 1, F.col("of").isNull()
    return joined.select(
        "key", "rid", "size", "body",
        F.when(kept | open_, F.col("low")).otherwise(F.col("low") + start).alias("low"),
        F.when(kept, F.col("span")).when(open_, F.lit(0)).otherwise(inside).cast("long").alias("span"),
        F.when(kept | open_, F.col("need")).otherwise(F.col("need") - F.col("upto") + F.col("scores")).alias("need"))


def _best(blocks: _Blocks, state: DataFrame) -> DataFrame:
    """``rid, query, key, other, score``: scores above the k-th, and a task's smallest keys among those equal to it."""
    schema = "rid long, query long, score long, at long"

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        low, span, need, ids = (queries[c].to_numpy() for c in ("low", "span", "need", "rid"))
        missing = candidates["key"].is_null().to_numpy()
        ordered = candidates.take(np.lexsort((candidates["rid"].to_numpy(), candidates["key"].fill_null(0).to_numpy(),
                                              missing)))
        rid, query, score, at = [], [], [], []
        for cut, scores, use in _scores(queries, ordered):
            tied = use & (scores == low[cut, None]) & (span[cut, None] == 1)
            tied &= np.cumsum(tied, axis=1) <= need[cut, None]
            more = use & ((scores > low[cut, None]) | (span[cut, None] == 0))
            rows, cols = np.nonzero(tied | more)
            rid.append(ids[cut][rows]), query.append(queries["key"].to_numpy()[cut][rows])
            score.append(scores[rows, cols]), at.append(cols)
        found = _table(schema, rid, query, score, at)
        other = ordered.take(found["at"])
        return found.drop_columns(["at"]).append_column("key", other["key"]).append_column("other", other["rid"])

    return blocks.pairs(state, run, "rid long, query long, score long, key long, other long")


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
          scale: float = 64.0, bins: int = 256, query_block: int = 1024, candidate_block: int = 4096) -> DataFrame:
    """The ``k`` best candidates of each query row: ``query_id long, rank int, key long, score long``.

    Queries are the rows whose key is divisible by ``every``; candidates are
    all rows but the query's own.  Scores are inner products of the vectors
    ``floor(scale * x)``.  Ties go to the smaller key.  Queries with fewer
    than ``k`` candidates get all of them.

    Vectors that are null or hold null or non-finite components take no part.
    Only vectors of equal length are compared; empty ones score 0 with one
    another.  A repeated row is a candidate of its own and, as a query, gets
    ``k`` rows of its own.  Rows with a null key are candidates, last among
    ties, and never queries.  Components are held within +-2^61 and scores
    within +-2^62.  An empty table gives no rows.  Other columns are ignored.
    """
    if k < 1 or bins < 2:
        raise ValueError("k >= 1 and bins >= 2 are needed")
    rows = materialised(integer_vectors(vectors, key, vector, scale))
    asked = rows.where(F.col("key") % F.lit(every) == 0)
    there = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("key") % F.lit(every) == 0).alias("q"),
                     F.max("most").alias("most"), F.max("size").alias("size")).first()
    blocks = _Blocks(rows, max(1, -(-there["q"] // query_block)), max(1, -(-there["n"] // candidate_block)))
    # no score is farther from 0 than the largest component's square times the length
    reach = min((there["most"] or 0) ** 2 * (there["size"] or 0), MOST)
    state = asked.select("key", "rid", "size", "body", F.lit(-reach).cast("long").alias("low"),
                         F.lit(2 * reach + 1).cast("long").alias("span"), F.lit(k).cast("long").alias("need"))
    span = 2 * reach + 1  # of the widest range
    while True:
        # the first round also finds the queries with too few candidates
        counts = _histograms(blocks, state, bins)
        state = materialised(_narrowed(state, counts, bins))
        span = -(-span // bins)
        if span <= 1:
            break
    order = Window.partitionBy("rid").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "other")
    return (_best(blocks, state).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("key").alias(key), "score"))
