"""Operator 13: phrase collocations by Toivonen's sampling.

Counting every sequence of up to four words is mostly wasted on sequences
that occur once.  Toivonen's method counts few others than the frequent ones:

1. a sample of the texts, mined length by length at a lowered threshold,
   proposes phrases;
2. one pass over all texts counts the proposed phrases and their negative
   border: phrases that aren't proposed, but whose two parts of one word
   less are.  All single words are proposed or on the border;
3. a border phrase that turns out frequent was missed by the sample.  A
   further pass then takes every phrase that holds a missed one for proposed,
   and counts the phrases that this adds with their border.  Passes end when
   none is missed.

Counts are therefore complete whatever the sample holds: a frequent phrase
has frequent parts, so either all its parts are proposed, or the shortest one
that isn't lies on the border, where it is found.

Passes count phrases by 64-bit hashes, which hold the phrase's length: the
rows of a phrase that occurs once are two numbers.  Equal hashes can only
raise a count, so no frequent phrase is lost; a last pass counts the phrases
themselves, exactly, for the hashes that are frequent.

Proposed phrases travel to the tasks as a Bloom filter of bounded size.  A
phrase that it takes for proposed by mistake only widens the border.  Its
bits are set by grouped bitmap aggregates; no list of phrases reaches the
driver.  Tasks count inside runs of ``flush`` words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches, materialised, release

COUNTS = "hash long, f long"
ROWS = "lang string, words int, phrase string, f long"
LONGEST = 8  # a hash holds the length in its last three bits
_MARK = b"\xff"  # between pieces; no byte of UTF-8
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r",
                        b"abcdefghijklmnopqrstuvwxyz " + _MARK * 10)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PROBES = 4


def split_words(text: str) -> list[bytes]:
    """Lower-cased words in order, with a mark wherever a piece ends."""
    return text.encode().translate(_FOLD).replace(_MARK, b" \xff ").split()


class _Ids(dict):
    """Words numbered as they come; the mark is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


# --- the filter ----------------------------------------------------------


class PhraseFilter:
    """A Bloom filter over phrase hashes; ``size`` bits, a power of two."""

    def __init__(self, size: int, bits: np.ndarray | None = None):
        self.size = size
        self.bits = np.zeros(size // 8, np.uint8) if bits is None else bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        found = np.ones(len(hashes), bool)
        for probe in range(_PROBES):
            at = (low + np.uint64(probe) * high) & np.uint64(self.size - 1)
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def with_phrases(self, phrases: DataFrame) -> PhraseFilter:
        """This filter with the ``hash`` column of ``phrases`` added: one bitmap aggregate, at most ``size / 8`` bytes."""
        low = F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned("hash", 32).bitwiseOR(F.lit(1))
        places = F.array(*[(low + F.lit(p) * high).bitwiseAND(F.lit(self.size - 1)) for p in range(_PROBES)])
        # bitmap positions count from 1
        maps = (phrases.select(F.explode(places).alias("p")).select((F.col("p") + 1).alias("p"))
                .groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
                .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect())
        bits = self.bits.copy()
        for r in maps:
            start = (r["bucket"] - 1) * 4096
            part = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(bits) - start]
            bits[start: start + len(part)] |= part
        return PhraseFilter(self.size, bits)


# --- one pass ------------------------------------------------------------


class _Run:
    """Words of one language as they come, and the hashes of their phrases."""

    def __init__(self, lang: str):
        import xxhash

        self.digest, self.lang = xxhash.xxh64_intdigest, lang
        self.ids, self.parts = _Ids({_MARK: 0}), []

    def add(self, text: str) -> int:
        found = split_words(text)
        found.append(_MARK)
        self.parts.append(np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)))
        return len(found)

    def close(self) -> None:
        self.words = np.concatenate([*self.parts, np.zeros(1, np.int32)])
        self.parts = []
        self.spelled = list(self.ids)
        self.hashed = np.fromiter(map(self.digest, self.spelled), np.uint64, len(self.spelled))

    def walk(self, longest: int, members: Sequence[Callable[[int, np.ndarray, list], np.ndarray]]
             ) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """Per length: where phrases start, their hashes, and for each rule whether it has them counted and proposed.

        A rule of ``members`` says which phrases of a length are proposed;
        one word more is counted where this and the next place are proposed.
        Places go on while the last rule counts them, and it counts whatever
        the others count.  A rule gets the length, the hashes and its own
        list for what it carries along; arrays in it follow the places.
        """
        words = self.words
        place = np.flatnonzero(words)
        full = np.full(len(place), self.digest(self.lang.encode()), np.uint64)
        counted = [np.ones(len(place), bool) for _ in members]
        carried: list[list] = [[] for _ in members]
        for length in range(1, longest + 1):
            with np.errstate(over="ignore"):
                full = _mixed(full * _PRIME + self.hashed[words[place + length - 1]])
            named = (full & ~np.uint64(LONGEST - 1)) | np.uint64(length - 1)
            proposed = [m(length, named, c) for m, c in zip(members, carried)]
            yield length, place, named, counted, proposed
            if length == longest or not members:
                return
            follows = np.zeros(len(place), bool)
            follows[:-1] = place[1:] == place[:-1] + 1
            held = [p & c for p, c in zip(proposed, counted)]
            counted = [h & np.append(h[1:], False) & follows for h in held]
            keep = np.flatnonzero(counted[-1])
            for c in carried:
                # what is carried for a place holds for this and the next one
                c[:] = [(v | np.append(v[1:], False))[keep] for v in c]
            place, full, counted = place[keep], full[keep], [c[keep] for c in counted]


def _in(filter_: PhraseFilter) -> Callable[[int, np.ndarray, list], np.ndarray]:
    return lambda length, named, carried: filter_.has(named)


def _in_or_around(filter_: PhraseFilter, missed: PhraseFilter) -> Callable[[int, np.ndarray, list], np.ndarray]:
    """Proposed: in the filter, or with a missed phrase inside."""

    def rule(length: int, named: np.ndarray, carried: list) -> np.ndarray:
        around = missed.has(named)
        if carried:
            around |= carried[0]
        carried[:] = [around]
        return filter_.has(named) | around

    return rule


def _runs(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[list[_Run]]:
    """Runs of about ``flush`` words, by language."""
    runs: dict[str, _Run] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in runs:
                runs[lang] = _Run(lang)
            held += runs[lang].add(text)
            if held >= flush:
                for r in runs.values():
                    r.close()
                yield list(runs.values())
                runs, held = {}, 0
    for r in runs.values():
        r.close()
    yield list(runs.values())


def _hash_counts(texts: DataFrame, filters: Sequence[PhraseFilter], lengths: range, flush: int) -> DataFrame:
    """``hash, f``: all occurrences of the phrases that the last rule counts and no earlier one does.

    ``filters`` are none (every word counts), the proposed phrases, or these
    and the missed ones of a further pass.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast([(f.size, f.bits) for f in filters])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [PhraseFilter(*f) for f in shared.value]
        members = [] if not told else [_in(told[0])] + ([_in_or_around(*told)] if len(told) > 1 else [])
        for runs in _runs(batches, flush):
            for one in runs:
                for length, _, named, counted, _ in one.walk(lengths[-1], members):
                    if length not in lengths:
                        continue
                    fresh = named if len(members) < 2 else named[~counted[0]]
                    hashes, n = np.unique(fresh, return_counts=True)
                    for start in range(0, len(hashes), 1 << 17):
                        cut = slice(start, start + (1 << 17))
                        yield pa.RecordBatch.from_arrays([pa.array(hashes[cut].astype(np.int64)), pa.array(n[cut])],
                                                         names=["hash", "f"])

    bounded_batches(spark)
    # tasks have added up their own; dealing first spares a second adding up before the shuffle
    rows = texts.select("lang", "text").mapInArrow(run, COUNTS).repartition("hash")
    return rows.groupBy("hash").agg(F.sum("f").alias("f"))


def _named_counts(texts: DataFrame, frequent: PhraseFilter, longest: int, flush: int, least: int = 1, buckets: int = 32
                  ) -> DataFrame:
    """``lang, words, phrase, f``: exact counts of the phrases whose hash is in the filter, from ``least`` on.

    The row of 0 words and an empty phrase has a language's number of words.
    A run's phrases travel packed, one row per language and ``bucket`` of
    their hashes; a bucket's rows meet in one task, which adds them up.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((frequent.size, frequent.bits))

    def counted(one: _Run, filter_: PhraseFilter) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Phrases, how often each occurs, and its bucket."""
        size = len(one.spelled)
        phrases, numbers, homes = [b""], [np.array([np.count_nonzero(one.words)])], [np.zeros(1, np.int64)]
        for length, place, named, _, proposed in one.walk(longest, [_in(filter_)]):
            at = place[proposed[0]]
            code = np.zeros(len(at), np.int64)
            for j in range(length):
                if len(code) and int(code.max()) >= (1 << 62) // size:  # numbered anew, so that codes stay exact
                    code = np.unique(code, return_inverse=True)[1]
                code = code * size + one.words[at + j]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            columns = [[one.spelled[i] for i in one.words[at[first] + j].tolist()] for j in range(length)]
            phrases += columns[0] if length == 1 else map(b" ".join, zip(*columns))
            numbers.append(n)
            homes.append(((named[proposed[0]][first] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64))
        return phrases, np.concatenate(numbers), np.concatenate(homes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = PhraseFilter(*shared.value)
        for runs in _runs(batches, flush):
            for one in runs:
                phrases, n, home = counted(one, filter_)
                order = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
                langs, homes, bodies, numbers = [], [], [], []
                for at in np.split(order, cuts[1:]):
                    langs.append(one.lang)
                    homes.append(int(home[at[0]]))
                    # no phrase holds a line end
                    bodies.append(pa.compress(b"\n".join([phrases[i] for i in at.tolist()]), codec="zstd", asbytes=True)
                                  + sum(len(phrases[i]) + 1 for i in at.tolist()).to_bytes(8, "little"))
                    numbers.append(pa.compress(n[at].astype("<i8").tobytes(), codec="zstd", asbytes=True)
                                   + len(at).to_bytes(8, "little"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(homes, pa.int32()), pa.array(bodies, pa.binary()),
                     pa.array(numbers, pa.binary())], names=["lang", "bucket", "phrases", "numbers"])

    def added(key: tuple, group: pa.Table) -> pa.Table:
        found: dict[bytes, int] = {}
        for body, numbers in zip(group["phrases"].to_pylist(), group["numbers"].to_pylist()):
            size, k = int.from_bytes(body[-8:], "little") - 1, int.from_bytes(numbers[-8:], "little")
            phrases = pa.decompress(body[:-8], size, codec="zstd", asbytes=True).split(b"\n")
            n = np.frombuffer(pa.decompress(numbers[:-8], 8 * k, codec="zstd", asbytes=True), "<i8").tolist()
            for p, m in zip(phrases, n):
                found[p] = found.get(p, 0) + m
        kept = {p: m for p, m in found.items() if m >= least or not p}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(kept), pa.string()),
                         "words": pa.array([p.count(b" ") + 1 if p else 0 for p in kept], pa.int32()),
                         "phrase": pa.array(list(kept), pa.binary()).cast(pa.string()),
                         "f": pa.array(list(kept.values()), pa.int64())})

    bounded_batches(spark)
    packed = texts.select("lang", "text").mapInArrow(run, "lang string, bucket int, phrases binary, numbers binary")
    return packed.groupBy("lang", "bucket").applyInArrow(added, ROWS)


def _unproposed(counts: DataFrame, filter_: PhraseFilter, longest: int) -> DataFrame:
    """The hashes of phrases shorter than ``longest`` that the filter doesn't hold."""
    shared = counts.sparkSession.sparkContext.broadcast((filter_.size, filter_.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = PhraseFilter(*shared.value)
        for batch in batches:
            h = batch.column(0).to_numpy().astype(np.uint64)
            out = ~told.has(h) & ((h & np.uint64(LONGEST - 1)) < longest - 1)
            yield batch.filter(pa.array(out))

    return counts.select("hash").mapInArrow(run, "hash long")


# --- mining --------------------------------------------------------------


def filter_of(hashes: DataFrame, most_bits: int) -> PhraseFilter:
    """A filter of 16 bits a phrase, at most ``most_bits``."""
    n, size = hashes.count(), 1 << 16
    while size < 16 * n and size < most_bits:
        size *= 2
    return PhraseFilter(size).with_phrases(hashes)


def frequent_phrases(texts: DataFrame, *, least: int, longest: int, sample: float, key: Sequence[str], flush: int,
                     most_bits: int = 1 << 26, told: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lang, words, phrase, f)`` of all phrases of at most ``longest`` words found ``least`` times, and ``(lang, n)``.

    ``told`` gets the number of missed phrases of each pass.
    """
    if not 2 <= longest <= LONGEST or least < 1:
        raise ValueError(f"2 <= longest <= {LONGEST} and least >= 1 are needed")
    drawn = texts.where(F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < F.lit(int(sample * (1 << 20))))
    # below what a phrase of just enough occurrences has on average, so that few are missed
    lowered = max(2, int(sample * least * 0.7))
    bloom, proposed = PhraseFilter(1 << 16), None
    for length in range(1, longest if sample > 0 else 1):
        found = _hash_counts(drawn, [bloom] if proposed is not None else [], range(length, length + 1), flush)
        found = materialised(found.where(F.col("f") >= lowered).select("hash"))
        proposed = found if proposed is None else proposed.unionByName(found)
        bloom = filter_of(proposed, most_bits)
    release(texts.sparkSession)
    lengths = range(1, longest + 1)
    frequent = materialised(_hash_counts(texts, [bloom], lengths, flush).where(F.col("f") >= least))
    release(texts.sparkSession)
    missed = materialised(_unproposed(frequent, bloom, longest))
    n = missed.count()
    if told:
        told(n)
    if n:
        # every phrase around a missed one counts as proposed, so nothing is left on the border of this pass
        more = _hash_counts(texts, [bloom, filter_of(missed, most_bits)], lengths, flush).where(F.col("f") >= least)
        frequent = frequent.unionByName(materialised(more))
    # a bucket holds what about 2^18 words have to offer
    occurrences = frequent.where(F.col("hash").bitwiseAND(F.lit(LONGEST - 1)) == 0).agg(F.sum("f")).first()[0] or 0
    named = materialised(_named_counts(texts, filter_of(frequent, most_bits), longest, flush, least,
                                       max(32, min(occurrences >> 18, 1 << 30))))
    return named.where("words > 0"), named.where("words = 0").select("lang", F.col("f").alias("n"))


def _words(at: Column, n: Column) -> Column:
    return F.array_join(F.slice("w", at, n), " ")


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, absorbed: int = 80, first: int = 2000,
                 sample: float = 0.1, text: str = "text", lang: str = "lang", key: str = "doc_id",
                 flush: int = 1 << 22, told: Callable[[int], None] | None = None) -> DataFrame:
    """The best phrases of each language: ``lang, rank long, phrase, a, l, r, n, score`` (long).

    Texts are lower-cased (A-Z only) and split at ``.,;:!?`` and line ends
    into pieces, and these at blanks and tabs into words.  Candidates are
    phrases of 2 to ``longest`` words inside pieces with ``a >= least``
    occurrences.  A cut after its first k words has parts with ``l`` and
    ``r`` occurrences and scores ``floor(2000000 a / (l + r))``; the lowest
    cut counts, ties to the smallest k.  Candidates inside a longer candidate
    with at least ``absorbed`` percent of their occurrences are dropped.  The
    ``first`` ones by score, a (both descending) and phrase (by bytes) are
    returned; ``n`` counts a language's words.

    ``sample`` (a share of rows, by the hash of ``key``) decides how much the
    passes count, never the result.  A null language is ``und``; null
    and empty texts have no words; repeated rows count again; an empty table
    gives no rows; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).alias("id"))
    found, totals = frequent_phrases(texts, least=least, longest=longest, sample=sample, key=["id"], flush=flush, told=told)
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"),
                                                 F.split("phrase", " ").alias("w"))
    parts = found.where(F.col("words") < longest).select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f")

    def joined(rows: DataFrame, name: str) -> DataFrame:
        side = parts.select(F.col("of"), F.col("part").alias(f"{name}_part"), F.col("f").alias(name))
        return rows.join(side, (F.col("lang") == F.col("of")) & (F.col(f"{name}_phrase") == F.col(f"{name}_part"))) \
            .drop("of", f"{name}_part")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("l_phrase"),
        _words(F.col("k") + 1, F.col("words") - F.col("k")).alias("r_phrase"))
    # decimals: the product may pass 64 bits
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div CAST(l + r AS DECIMAL(20,0))")
    scored = joined(joined(cuts, "l"), "r").withColumn("score", score).groupBy("lang", "phrase", "a") \
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every shorter phrase inside a candidate, and how often the most frequent candidate around it occurs
    size, at = F.col("inside.size"), F.col("inside.at")
    spans = F.expr("flatten(transform(sequence(2, words - 1), "
                   "s -> transform(sequence(1, words - s + 1), t -> struct(s AS size, t AS at))))")
    around = (candidates.where("words > 2").withColumn("inside", F.explode(spans))
              .select(F.col("lang").alias("of"), _words(at, size).alias("sub"), F.col("a").alias("longer"))
              .groupBy("of", "sub").agg(F.max("longer").alias("longer")))
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * absorbed
    kept = scored.join(around, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("sub")), "left") \
        .where(~F.coalesce(covered, F.lit(False)))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each bucket hold the first of all; a language's last ranking sees a bounded number of rows
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))) \
        .where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= first)
    totals = totals.select(F.col("lang").alias("of"), "n")
    return rows.join(totals, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
