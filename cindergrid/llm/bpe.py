"""Operator 1: byte-level BPE encoding and decoding over overlapping chunks.

A pre-tokenising pattern splits a text into pieces, and byte-pair merges
never cross a piece.  Matching goes left to right, never looks before a
match and only a few characters past it: once two scans of the same text
have a piece starting at the same position, they agree from there on.  A
long text can therefore be cut into overlapping chunks:

1. texts of more than ``chunk`` characters become one row per chunk, each
   with ``overlap`` more characters to its right, dealt over all tasks,
   which scan them in parallel for the starts of pieces;
2. a text's chunks are stitched: at each seam the first start that both
   neighbours found is where they resynchronise.  Where the overlap holds
   none (a run of letters longer than the overlap), the pattern is matched
   on from the last certain start until it meets a start of a later chunk;
3. the pieces between the stitched starts are encoded.

Texts of at most one chunk have no seams and are encoded where they are
read.  Decoding concatenates the bytes of the ids' tokens.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches


class ByteBpe:
    """Pieces, ids and bytes for one rank file (``base64-token rank`` a line) and split pattern.

    Ids of pieces are kept in a dictionary of at most ``keep`` pieces, which
    is emptied when full; pieces of over 64 characters are not kept.
    """

    def __init__(self, path: str, pattern: str, keep: int = 200_000):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.zero = ranks[b"\0"]
        self.keep, self.known = keep, {}
        # both engines get pieces only: the first a list of them with zero characters between, the second a single one
        self.listed = tiktoken.Encoding("listed", pat_str="\0|[^\0]+", mergeable_ranks=ranks, special_tokens={})
        self.single = tiktoken.Encoding("single", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ids(self, pieces: list[str]) -> list[int]:
        fresh = set(pieces).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > self.keep:
                self.known = {}
                fresh = set(pieces)
            found = self._encode(list(fresh))
            if len(fresh) > self.keep or max(map(len, fresh)) > 64:
                return list(chain.from_iterable(found[p] if p in found else self.known[p] for p in pieces))
            self.known.update(found)
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def _encode(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        found = {p: tuple(self.single.encode_ordinary(p)) for p in pieces if "\0" in p}
        pieces = [p for p in pieces if p not in found]
        got = np.array(self.listed.encode_ordinary("\0".join(pieces)), dtype=np.int64)
        ends = [*np.flatnonzero(got == self.zero).tolist(), len(got)]
        got, start = got.tolist(), 0
        for piece, end in zip(pieces, ends):
            found[piece] = tuple(got[start:end])
            start = end + 1
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def starts(self, text: str, whole: bool) -> list[int]:
        """Starts of pieces, up to the first that more text to the right could change.

        ``whole``: the text ends here, so all are certain.  Otherwise a piece
        is certain if three more characters follow its end: one to end a run,
        two for a contraction such as ``'re``.
        """
        found, sure = [], len(text) if whole else len(text) - 3
        for match in self.pattern.finditer(text):
            found.append(match.start())
            if match.end() > sure:
                break
        return found

    def stitch(self, text: str, chunk: int, starts: list[list[int]]) -> list[int]:
        """Starts of the pieces of ``text`` from those of its chunks (each counted from its own begin)."""
        bounds = list(starts[0])
        for i in range(1, len(starts)):
            base = i * chunk
            if bounds[-1] >= base + chunk:  # a piece that reaches past this whole chunk
                continue
            own = set(starts[i])
            at = next((k for k in range(bisect_left(bounds, base), len(bounds)) if bounds[k] - base in own), None)
            while at is None:
                step = self.pattern.match(text, bounds[-1]).end()
                if step >= min(base + chunk, len(text)):
                    if step < len(text):
                        bounds.append(step)
                    break
                bounds.append(step)
                at = len(bounds) - 1 if step - base in own else None
            if at is not None:
                first = bounds[at] - base
                bounds[at:] = [base + p for p in starts[i] if p >= first]
        while (end := self.pattern.match(text, bounds[-1]).end()) < len(text):
            bounds.append(end)
        return bounds


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(path, pattern)
    return _CODECS[path, pattern]


def _digest(model: ByteBpe, ids: list[int]) -> tuple[int, str, str]:
    listed = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(model.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, ranks: str, pattern: str, *, key: str = "doc_id", text: str = "text",
               chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """Encode every whole text, decode the ids, and return the digests of both.

    Returns ``key, n_tokens long, ids_sha256 string, decoded_sha256 string,
    n_chunks int``: lowercase hex digests of the decimal ids joined by
    commas, and of the decoded bytes.

    Null text counts as empty: no tokens, digests of the empty string.  Rows
    are independent, so repeated rows and null keys give a row each.  An
    empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("0 < overlap <= chunk is needed")
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(ranks, pattern)
        for batch in batches:
            rows = [_digest(model, model.ids(model.pieces(t.as_py() or ""))) for t in batch.column(1)]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    length = F.coalesce(F.length("text"), F.lit(0))
    small = slim.where(length <= chunk).mapInArrow(
        short, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    long = _long_texts(slim.where(length > chunk), kind, ranks, pattern, chunk, overlap)
    return small.withColumn("n_chunks", F.lit(1)).unionByName(long).withColumnRenamed("key", key)


def _long_texts(slim: DataFrame, kind: str, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """The rows of :func:`round_trip` for texts of more than one chunk; repeated rows are encoded once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(1)):
                body = value.as_py()
                name = hashlib.sha256(body.encode()).hexdigest()
                at = range(0, len(body), chunk)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([row] * len(at))), pa.array([name] * len(at)),
                     batch.column(2).take(pa.array([row] * len(at))), pa.array(range(len(at)), pa.int32()),
                     pa.array([body[i: i + chunk + overlap] for i in at])],
                    names=["key", "name", "copies", "i", "body"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(ranks, pattern)
        for batch in batches:
            found, own = [], []
            for value in batch.column(4):
                body = value.as_py()
                found.append(np.array(model.starts(body, len(body) < chunk + overlap), dtype="<i4").tobytes())
                own.append(body[:chunk])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own), pa.array(found, pa.binary())],
                                             names=["key", "name", "copies", "i", "body", "starts"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(ranks, pattern)
        for batch in batches:
            rows = []
            for value in batch.column("chunks"):
                parts = value.as_py()
                body = "".join(p["body"] for p in parts)
                bounds = model.stitch(body, chunk, [np.frombuffer(p["starts"], "<i4").tolist() for p in parts])
                pieces = [body[a:b] for a, b in zip(bounds, [*bounds[1:], len(body)])]
                rows.append((*_digest(model, model.ids(pieces)), len(parts)))
            n, ids, back, chunks = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()),
                 pa.array(chunks, pa.int32()), batch.column("copies")],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "copies"])

    distinct = slim.groupBy("key", "text").agg(F.count(F.lit(1)).alias("copies"))
    chunks = distinct.mapInArrow(cut, f"key {kind}, name string, copies long, i int, body string")
    scanned = chunks.repartition("key", "name", "i").mapInArrow(
        scan, f"key {kind}, name string, copies long, i int, body string, starts binary")
    texts = scanned.groupBy("key", "name", "copies").agg(
        F.array_sort(F.collect_list(F.struct("i", "body", "starts"))).alias("chunks"))
    done = texts.select("key", "copies", "chunks").mapInArrow(
        encode, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks int, copies long")
    return done.select("key", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks",
                       F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
