"""Operator 10: document fingerprints from prefix polynomial hashes.

For a text of code points ``c_0 .. c_{n-1}`` the prefix array is
``P[i] = sum(c_j + 1) * B^j for j < i`` modulo a prime.  Two differences of
it, brought to the same power of ``B``, answer whether any two spans are
equal; since equal prefixes stay equal when shortened, the longest common
extension of two texts is found by binary search over equal-span questions
(:class:`PrefixHash`).  Two primes below 2^31 are used side by side, so a
chance equality has odds of about 2^-62 per question, and all arithmetic
stays in 64-bit integers.

A fingerprint keeps the answers that a later comparison needs: the number
of code points, the hash of the whole text, and the hashes of the prefixes
and suffixes whose lengths are a fixed geometric series.  The likeness of two
fingerprints binary-searches both series for the longest common prefix
and suffix, and is their total share of the longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches

# Two primes and a base for each: fixed values.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)

BLOCK = 1 << 16


def _power(base: int, exponent: int, prime: int) -> int:
    return pow(base, int(exponent), prime)


@lru_cache
def _powers(k: int, sign: int) -> np.ndarray:
    """``B^0 .. B^(BLOCK-1)`` (``sign`` 1) or of the inverse of ``B`` (-1) for prime ``k``."""
    prime, base = PRIMES[k], _power(BASES[k], sign, PRIMES[k])
    row = np.ones(1, np.uint64)
    while len(row) < BLOCK:
        row = np.concatenate((row, row * np.uint64(_power(base, len(row), prime)) % np.uint64(prime)))
    return row


def _inverse_powers(k: int, exponents: np.ndarray) -> np.ndarray:
    low = _powers(k, -1)[exponents % BLOCK]
    blocks = exponents // BLOCK
    if not blocks.any():
        return low
    high = np.array([_power(BASES[k], -BLOCK * int(q), PRIMES[k]) for q in blocks], dtype=np.uint64)
    return low * high % np.uint64(PRIMES[k])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHash:
    """Prefix arrays of one text, built block by block."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for k, prime in enumerate(PRIMES):
            p, total = np.uint64(prime), 0
            array = np.zeros(self.n + 1, np.uint32)
            powers = _powers(k, 1)
            for start in range(0, self.n, BLOCK):
                block = points[start: start + BLOCK].astype(np.uint64) + np.uint64(1)
                terms = block * powers[: len(block)] % p
                shift = np.uint64(_power(BASES[k], start, prime))
                run = (np.cumsum(terms) % p * shift + np.uint64(total)) % p
                array[start + 1: start + 1 + len(block)] = run
                total = int(run[-1])
            self.sums.append(array)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of the code points ``start .. end-1``, the same wherever the span stands."""
        return tuple(int((int(a[end]) - int(a[start])) * _power(b, -start, p) % p)
                     for a, p, b in zip(self.sums, PRIMES, BASES))

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def common_extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest span that starts at ``start`` here and at ``at`` there."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, at, mid) else (low, mid - 1)
        return low


@lru_cache(4096)
def checkpoints(n: int, first: int = 1, ratio: float = 1.125) -> list[int]:
    """The series of span lengths below ``n``: the same for every text, so that texts can be compared."""
    found, length = [], float(first)
    while int(length) < n:
        found.append(int(length))
        length = max(length * ratio, int(length) + 1.0)
    return found


class Fingerprint:
    """``n:whole:prefixes:suffixes``; a hash is 16 hex digits for the whole and 8 for each checkpoint."""

    def __init__(self, n: int, whole: str, prefixes: str, suffixes: str):
        self.n, self.whole, self.prefixes, self.suffixes = n, whole, prefixes, suffixes

    @classmethod
    def of(cls, text: PrefixHash) -> Fingerprint:
        return cls.joined([(text, text.n)])

    @classmethod
    def joined(cls, parts: list[tuple[PrefixHash, int]]) -> Fingerprint:
        """Of the first code points of one or two texts in a row, from their prefix arrays alone."""
        n = sum(length for _, length in parts)
        lengths = np.array(checkpoints(n), dtype=np.int64)
        asked = np.concatenate((lengths, [n], n - lengths))
        sums = []
        for k, (prime, base) in enumerate(zip(PRIMES, BASES)):
            first, cut = parts[0]
            values = first.sums[k][np.minimum(asked, cut)].astype(np.uint64)
            if len(parts) > 1:
                shift = np.uint64(_power(base, cut, prime))
                values = (values + parts[1][0].sums[k][np.maximum(asked - cut, 0)].astype(np.uint64) * shift) \
                    % np.uint64(prime)
            sums.append(values)
        m = len(lengths)
        # a suffix's hash is brought to power 0 by the inverse power of its start
        p = np.uint64(PRIMES[0])
        suffixes = (sums[0][m] + p - sums[0][m + 1:]) % p * _inverse_powers(0, n - lengths) % p
        return cls(n, f"{int(sums[0][m]):08x}{int(sums[1][m]):08x}", _hex(sums[0][:m]), _hex(suffixes))

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, prefixes, suffixes = text.split(":")
        return cls(int(n), whole, prefixes, suffixes)

    def __str__(self) -> str:
        return f"{self.n}:{self.whole}:{self.prefixes}:{self.suffixes}"

    def likeness(self, other: Fingerprint) -> float:
        """Common prefix plus common suffix as a share of the longer text; 1 for equal texts, 0 for nothing shared."""
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        lengths = checkpoints(min(self.n, other.n))
        shared = 0
        for mine, theirs in ((self.prefixes, other.prefixes), (self.suffixes, other.suffixes)):
            low, high = 0, len(lengths)
            while low < high:
                mid = (low + high + 1) // 2
                same = mine[8 * mid - 8: 8 * mid] == theirs[8 * mid - 8: 8 * mid]
                low, high = (mid, high) if same else (low, mid - 1)
            shared += lengths[low - 1] if low else 0
        return min(1.0, shared / max(self.n, other.n))


def _hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    return Fingerprint.parse(a).likeness(Fingerprint.parse(b))


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", pieces: int | None = None,
                          next_share: int = 4) -> DataFrame:
    """Fingerprint every text, its edited form, and compare with both that and the next document.

    The edited text has its last ``n // next_share`` code points replaced by
    the first as many (or all) of the next document's, in ascending ``key``
    (an integer column; nulls first; equal keys by the text's hash), the
    first document following the last.

    Returns ``key, n_chars long, edited_sha256, fingerprint,
    edited_fingerprint string, near_edited, near_next double``.

    The rows are cut into ``pieces`` ranges of the key (by default four per
    shuffle partition) at quantiles of all keys and shuffled once, with the
    text.  Each range is sorted and streamed.  A copy of the next range's
    first row comes along as its end mark.  The driver sees the bounds
    and the ranges' first keys only, one row per range.

    Null text counts as empty; empty texts have likeness 1 to one another
    and 0 to others.  A single document is its own next one.  Repeated rows
    and equal keys are rows of their own.  An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    slim = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    shares = [i / pieces for i in range(1, pieces)]
    found = slim.select(F.percentile_approx("key", shares, 10 * pieces)).first()[0] if shares else None
    bounds = np.array(sorted(set(found or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def piece_of(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, keys.fillna(0).to_numpy(dtype=np.int64), side="right")
        return pd.Series(np.where(keys.isna(), 0, at))

    rows = slim.withColumn("hash", F.xxhash64("text")).withColumn("piece", piece_of("key"))
    # nulls sort first, in Spark's struct order too
    firsts = sorted(rows.groupBy("piece").agg(F.min(F.struct("key", "hash")).alias("first")).collect())
    ends = [(firsts[i - 1]["piece"], r["piece"], r["first"]["key"], r["first"]["hash"]) for i, r in enumerate(firsts)]
    marks = spark.createDataFrame(ends, "to int, piece int, m_key long, m_hash long")
    marked = rows.join(F.broadcast(marks), ["piece"]).where(
        F.col("key").eqNullSafe(F.col("m_key")) & (F.col("hash") == F.col("m_hash")))
    marked = marked.dropDuplicates(["piece"]).select("key", "text", "hash", F.col("to").alias("piece"),
                                                     F.lit(1).alias("mark"))
    dealt = rows.withColumn("mark", F.lit(0)).unionByName(marked).repartition("piece").sortWithinPartitions(
        "piece", "mark", F.asc_nulls_first("key"), "hash").select("piece", "mark", "key", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for piece, mark, name, value in zip(*(c.to_pylist() for c in batch.columns)):
                points = code_points(value)
                array = PrefixHash(points)
                here = Fingerprint.of(array)
                if last is not None:
                    out.append(_compared(*last, value, array, here, next_share))
                last = None if mark else (name, value, array, here)
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(),
                                                          pa.string(), pa.float64(), pa.float64()))],
                names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(
        compare, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double").withColumn("key", F.col("key").cast(kind)) \
        .withColumnRenamed("key", key)


def _compared(name, text: str, array: PrefixHash, mine: Fingerprint, following: str, after: PrefixHash,
              theirs: Fingerprint, share: int) -> tuple:
    cut = array.n // share
    kept = array.n - cut
    edited = Fingerprint.joined([(array, kept), (after, min(cut, after.n))])
    digest = hashlib.sha256((text[:kept] + following[:cut]).encode("utf-8", "surrogatepass")).hexdigest()
    return (name, array.n, digest, str(mine), str(edited), mine.likeness(edited), mine.likeness(theirs))
