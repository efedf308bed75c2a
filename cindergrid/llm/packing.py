"""Operator 4: packing by cutting-stock column generation.

Documents become token sequences; each is cut at every ``capacity`` tokens,
so that only its last piece is shorter than a full sequence.  Packing these
last pieces into sequences is a cutting-stock problem over the histogram of
their lengths:

1. one grouped count per length is the histogram, the only thing the driver
   sees (at most ``capacity`` rows at every input size).  Lengths are
   measured in units (``capacity / 256`` by default): pieces of one length
   are bundled by so many that the bundle fills whole units as nearly as it
   can (16 pieces of 5 tokens are exactly 5 units), within a quarter of a
   sequence; what a length has left over is rounded up piece by piece;
2. the linear program "cover the histogram with the fewest sequences" is
   solved over patterns (how many pieces of each class share a sequence).
   Patterns are generated on demand: a knapsack dynamic program prices them
   with the dual values until no pattern improves the bound;
3. pattern counts are rounded down and what is left is filled greedily, so
   every piece has a slot;
4. pieces are ranked inside their length by :func:`gapless_slots`; the rank
   decides bundle, pattern, sequence and place.  The tables of slot ranges
   are as bounded as the histogram and are the only broadcasts.

Token ids never leave the task that made them: a piece travels as its
length and checksum.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches, gapless_slots, materialised

PIECES = "key {key}, start long, length long, ids_crc32 long, doc_tokens long"


# --- tokens --------------------------------------------------------------


class WordBpe:
    """Ids of a lower-casing word BPE (a ``tokenizers`` JSON file), text in, little-endian uint32 out.

    White space separates words and is dropped, so a text's ids are the
    concatenation of its words' ids.  Words repeat, so their ids are kept in
    a dictionary of at most ``keep`` words (emptied when full).  New words
    made of plain Latin characters are encoded in one call per text by the
    byte-pair engine of ``tiktoken`` with this file's merges: a zero byte
    stands for the end-of-word mark.  Every other word (other scripts,
    control characters, combining marks) goes to ``tokenizers`` itself, and
    so does a whole text that may hold a special token.  All ways give the
    ids of ``tokenizers`` for the file as it is, which the tests check.
    """

    PLAIN = re.compile("[!-~¡-ɏ]+")

    def __init__(self, path: str, keep: int = 300_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.keep, self.known = keep, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        byte_of = _byte_alphabet()

        def spelled(token: str) -> bytes:
            ends = token.endswith(end)
            return bytes(byte_of[c] for c in (token[: -len(end)] if ends else token)) + b"\0" * ends

        ranks = {bytes([b]): b for b in range(256)}
        ids = [0] * 256
        for c, b in byte_of.items():
            ids[b] = vocab[c]
        for c, b in byte_of.items():
            if b:
                ranks[bytes([b, 0])] = len(ids)
                ids.append(vocab[c + end])
        for merge in spec["model"]["merges"]:
            joined = "".join(merge if isinstance(merge, list) else merge.split(" "))
            ranks[spelled(joined)] = len(ids)
            ids.append(vocab[joined])
        self.ids = np.array(ids, dtype="<u4")
        self.ends = np.zeros(len(ids), bool)
        for token, rank in ranks.items():
            self.ends[rank] = token.endswith(b"\0")
        # the file's special tokens are found in texts too; they begin alike, and such texts go to the library whole
        self.special = os.path.commonprefix([t["content"] for t in spec["added_tokens"]])
        self.fast = tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.special and self.special in text:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        fresh = set(words).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > self.keep:
                self.known = {}
                fresh = set(words)
            found = self._encode_words([w for w in fresh])
            if len(fresh) > self.keep:  # one text with more distinct words than are kept
                return b"".join(map(found.__getitem__, words))
            self.known.update(found)
        return b"".join(map(self.known.__getitem__, words))

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if self.PLAIN.fullmatch(w)]
        found = {w: np.array(self.slow.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
                 for w in set(words).difference(plain)}
        parts = [self.pieces(unicodedata.normalize("NFC", w).lower()) for w in plain]
        if not parts:
            return found
        spelled = "\0".join([p for word in parts for p in word] + [""])
        got = np.array(self.fast.encode_ordinary(spelled), dtype=np.int64)
        ends = np.concatenate(([0], np.flatnonzero(self.ends[got]) + 1))
        cuts = (ends[np.concatenate(([0], np.cumsum([len(p) for p in parts])))] * 4).tolist()
        raw = self.ids[got].tobytes()
        found.update((w, raw[a:b]) for w, a, b in zip(plain, cuts, cuts[1:]))
        return found


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_ENCODERS: dict[str, WordBpe] = {}


def _encoder(path: str) -> WordBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def cut_pieces(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row per piece: each document's ids and ``end_id``, cut at every ``capacity`` ids."""
    schema = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = _encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            origin, rows = [], []
            for i, body in enumerate(batch.column(1)):
                ids = encoder.encode(body.as_py() or "") + last
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start: 4 * (start + capacity)]
                    origin.append(i)
                    rows.append((start, len(piece) // 4, zlib.crc32(piece), n))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(origin, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)],
                names=["key", "start", "length", "ids_crc32", "doc_tokens"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut, PIECES.format(key=schema))


# --- the cutting-stock program -------------------------------------------


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern (count per class) of total size at most ``capacity``."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = fits[room]
        if k:
            worth = best[room - sizes[:k]] + values[:k]
            i = int(worth.argmax())
            if worth[i] > best[room]:
                best[room], take[room] = worth[i], i
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            pattern[take[room]] += 1
            room -= sizes[take[room]]
    return float(best[capacity]), pattern


def cutting_stock(demand: dict[int, int], capacity: int, gap: float = 1e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns ``{size: count}`` with how often each is used; together they hold the demand exactly.

    Column generation on the linear relaxation (revised simplex, one basis
    column per size) until the priced bound is within ``gap`` of the
    objective, then counts are rounded down and the rest is filled with the
    largest sizes that fit.
    """
    sizes = np.array(sorted(s for s, d in demand.items() if d > 0), dtype=np.int64)
    if not len(sizes):
        return []
    if sizes[0] < 1 or sizes[-1] > capacity:
        raise ValueError("every size must be in 1..capacity")
    want = np.array([demand[int(s)] for s in sizes], dtype=float)
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    for step in range(40 * m + 100):
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ want, 0)
        duals = inverse.sum(axis=0)
        value, pattern = price(duals, sizes, capacity)
        total = amount.sum()
        if value <= 1 + 1e-9 or total - total / value <= gap * total:
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
    else:
        warnings.warn(f"column generation ended {100 * (1 - 1 / value):.2g} % above its bound", stacklevel=2)
    amount = np.maximum(np.linalg.solve(basis, want), 0)
    left = {int(s): int(demand[int(s)]) for s in sizes}
    used: list[tuple[dict[int, int], int]] = []
    for column, x in zip(basis.T, amount):
        pattern = {int(s): int(c) for s, c in zip(sizes, column) if c}
        times = min(int(x + 1e-6), *(left[s] // c for s, c in pattern.items()))
        if times > 0:
            used.append((pattern, times))
            for s, c in pattern.items():
                left[s] -= c * times
    while any(left.values()):
        pattern, room = {}, capacity
        for s in sizes[::-1].tolist():
            c = min(left[s], room // s)
            if c:
                pattern[s] = c
                room -= c * s
        times = min(left[s] // c for s, c in pattern.items())
        used.append((pattern, times))
        for s, c in pattern.items():
            left[s] -= c * times
    return used


def slot_ranges(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (class, first rank, rank after, per sequence, first sequence, place in the pattern)."""
    ranges, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        place = 0
        for size, count in sorted(pattern.items(), reverse=True):
            first = taken.get(size, 0)
            taken[size] = first + count * times
            ranges.append((size, first, taken[size], count, sequence, place))
            place += count
        sequence += times
    return ranges


def bundle_size(length: int, unit: int, capacity: int) -> int:
    """How many pieces of a length to bundle: the fewest that waste the least share of their whole units."""
    most = max(1, capacity // 4 // length)
    return min(range(1, min(most, unit) + 1), key=lambda c: (-(-c * length // unit) * unit / (c * length), c))


def bundles(lengths: dict[int, int], unit: int, capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], dict[int, int]]:
    """Rows (length, first rank, rank after, pieces a bundle, class, first rank in the class), and the demand per class."""
    rows, demand = [], {}
    for length, n in sorted(lengths.items()):
        c = bundle_size(length, unit, capacity)
        whole = n // c * c
        for first, last, per in ((0, whole, c), (whole, n, 1)):
            if last > first:
                size = -(-per * length // unit)
                rows.append((length, first, last, per, size, demand.get(size, 0)))
                demand[size] = demand.get(size, 0) + (last - first) // per
    return rows, demand


# --- the operator --------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = 4096, classes: int = 256,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``key, start long, length long, ids_crc32
    long, doc_tokens long, sequence_id long, offset long``.

    Null and empty texts have the one token ``end_id``.  Very long texts are
    cut like any other.  Repeated rows are packed each on its own; rows with
    a null key too.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    if capacity % classes:
        raise ValueError("classes must divide capacity")
    unit = capacity // classes
    spark = docs.sparkSession
    pieces = materialised(cut_pieces(docs, tokenizer, end_id=end_id, capacity=capacity, key=key, text=text))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, demand = bundles(lengths, unit, capacity)
    parts = spark.createDataFrame(rows, "b_length long, b_from long, b_to long, b_per long, b_class int, b_first long")
    ranges = spark.createDataFrame(
        slot_ranges(cutting_stock(demand, classes)),
        "r_class int, r_from long, r_to long, r_per long, r_sequence long, r_place long")
    ranked = gapless_slots(pieces, ["length"], slot="rank")
    since = F.col("rank") - F.col("b_from")
    bundled = ranked.join(F.broadcast(parts), (F.col("length") == F.col("b_length")) & (F.col("rank") >= F.col("b_from"))
                          & (F.col("rank") < F.col("b_to"))).select(
        "key", "start", "length", "ids_crc32", "doc_tokens", F.col("b_class").alias("class"),
        (F.col("b_first") + F.floor(since / F.col("b_per"))).alias("unit_rank"), (since % F.col("b_per")).alias("inside"))
    within = F.col("unit_rank") - F.col("r_from")
    placed = bundled.join(F.broadcast(ranges), (F.col("class") == F.col("r_class")) & (F.col("unit_rank") >= F.col("r_from"))
                          & (F.col("unit_rank") < F.col("r_to"))).select(
        "key", "start", "length", "ids_crc32", "doc_tokens", "inside",
        (F.col("r_sequence") + F.floor(within / F.col("r_per"))).cast("long").alias("sequence_id"),
        (F.col("r_place") + within % F.col("r_per")).alias("place"))
    earlier = Window.partitionBy("sequence_id").orderBy("place", "inside").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"))
