"""Operator 5: substring deduplication by hashing lines, sentences and runs of words.

1. Every text is cut into units: its lines, and the sentences of each line
   that has several.  A unit is normalised (lower case, single spaces, no
   punctuation at either end) and named by a 128-bit digest.  Lines of fewer
   than ``line_words`` words and sentences of fewer than
   ``sentence_words`` are too short to name a passage and get no digest.
2. One grouped aggregate over all digests finds the least key that has
   each; it is combined before the shuffle, so a line that a third of all
   texts share is one row per task.
3. A unit is a repeat if a smaller key has its digest, or if it stands
   earlier in the same text.  Repeats go back to their texts by key.
4. A text loses its repeated lines, and inside other lines each run of
   repeated sentences that has at least ``run_words`` words in all; short
   sentences between two repeats belong to the run.  Removed spans keep
   their offsets in the original text.
5. *Passages* need no line or sentence of their own: every run of
   ``passage_words`` words that a smaller key has goes, wherever it starts
   and ends, and so does one that stands earlier in the same text without
   overlapping.  Words are compared in lower case without punctuation at
   either end; line ends count as blanks.  To find the runs without a row
   per word, each run is named by a seed, the least hash of the short word
   groups inside it: equal runs have equal seeds.  Only runs whose seed
   occurs in two different texts are hashed and compared one by one.  A text
   that is an exact copy of a smaller key's loses all its units and runs and
   takes no part in that comparison.

A letter of a script written without blanks (Chinese, Japanese, Thai, ...) is
a word of its own in a passage, and half a word in the length of a line or
sentence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches, forget, materialised, release, table_path, written
from cindergrid.llm.phrases import PhraseFilter, filter_of

_END = re.compile(r"[.!?]+(?:\s+|$)|[。！？｡]+\s*")
_EDGES = " \t.,;:!?\"'()[]{}<>*#|-_=/\\。！？｡，、；：「」『』（）《》"

# letters of scripts without blanks: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han
_LETTERS = "\u0e01-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff" \
    "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_LETTERS}]")
_TOKEN = re.compile(f"[{_LETTERS}]|[^\\s{_LETTERS}]+")
_NOT_PLAIN = re.compile(f"[{_LETTERS}。！？｡]")
_NEXT = re.compile("(?<=[.!?]) ")
# UTF-8 bytes of ASCII and of Latin, Greek, Cyrillic, Hebrew and Arabic letters: a text of these alone has nothing odd
_USUAL = bytes([*range(0xC0), *range(0xC3, 0xE0)])
_WORD = re.compile(r"\S+")  # a token of a text without such letters
_SEED_WORDS = 12
_AT_ONCE = 1 << 18  # bytes whose words are hashed at a time
_FACTORS = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


# a unit: start, end, number of words, digest (None: too short to name a passage)
Unit = tuple[int, int, int, "bytes | None"]


def _has_unspaced(text: str) -> bool:
    return not text.isascii() and _UNSPACED.search(text) is not None


def _unit(start: int, end: int, body: str, least: int, unspaced: bool) -> Unit:
    words = body.lower().split()
    size = len(words)
    if unspaced:
        size = max(size, len(_UNSPACED.findall(body)) // 2)
    if size < least:
        return start, end, size, None
    named = " ".join(words).strip(_EDGES).encode("utf-8", "surrogatepass")
    return start, end, size, xxhash.xxh3_128_digest(named)


def _unusual(text: str) -> bool:
    return not text.isascii() and bool(text.encode("utf-8", "surrogatepass").translate(None, _USUAL))


def _is_plain(text: str) -> bool:
    """Whether words are parted by blanks and sentences end in . ! ? alone."""
    return not _unusual(text) or _NOT_PLAIN.search(text) is None


def _plain_units(body: str, line_words: int, sentence_words: int) -> list[tuple[int, bytes | None]]:
    """Sizes and digests of a plain line and of its sentences, as :func:`_unit` makes them, from one split of the line."""
    named = " ".join(body.split())
    size = named.count(" ") + 1 if named else 0
    if size < line_words:
        return [(size, None)]
    found = [(size, xxhash.xxh3_128_digest(named.strip(_EDGES).encode("utf-8", "surrogatepass")))]
    # a sentence ends at a word's end; the dot that a plain split takes away would be stripped anyway
    parts = _NEXT.split(named) if "! " in named or "? " in named else named.split(". ")
    if len(parts) > 1:
        for part in parts:
            size = part.count(" ") + 1
            found.append((size, None if size < sentence_words else
                          xxhash.xxh3_128_digest(part.strip(_EDGES).encode("utf-8", "surrogatepass"))))
    return found


# start, end, (size, digest) of a line and of its sentences, and the ends of these
Line = tuple[int, int, "tuple[int, bytes | None]", "list[tuple[int, bytes | None]]", "Callable[[], list[int]]"]


def _cuts(body: str) -> list[int]:
    """Where the sentences of a line end."""
    cuts = [m.end() for m in _END.finditer(body)]
    if not cuts or cuts[-1] < len(body):
        cuts.append(len(body))
    return cuts


def _lines(text: str, line_words: int, sentence_words: int) -> Iterator[Line]:
    at = 0
    plain = _is_plain(text)
    unspaced = not plain and _has_unspaced(text)
    bodies = text.split("\n")
    for body, lowered in zip(bodies, text.lower().split("\n") if plain else bodies):
        end = min(at + len(body) + 1, len(text))
        if end > at:
            if plain:
                own, *parts = _plain_units(lowered, line_words, sentence_words)
            else:
                own, parts = _unit(at, end, body, line_words, unspaced)[2:], []
                cuts = _cuts(body) if own[1] is not None else []
                if len(cuts) > 1:
                    parts = [_unit(at + a, at + b, body[a:b], sentence_words, unspaced)[2:] for a, b in zip([0, *cuts], cuts)]
            yield at, end, own, parts, partial(_cuts, body)
        at = end


def lines_of(text: str, line_words: int, sentence_words: int) -> Iterator[tuple[Unit, list[Unit]]]:
    """Each line (its span holds the newline) with its sentences, where it has several."""
    for at, end, own, parts, cuts in _lines(text, line_words, sentence_words):
        ends = cuts() if parts else []
        yield (at, end, *own), [(at + a, at + b, *u) for a, b, u in zip([0, *ends], ends, parts)]


# --- passages ------------------------------------------------------------


# bytes of plain texts: 0 blanks, 1 punctuation that is stripped from words, 2 the rest
_KIND = np.full(256, 2, np.uint8)
_KIND[[ord(c) for c in _EDGES if c.isascii()]] = 1
_KIND[[c for c in range(128) if chr(c).isspace()]] = 0
# texts whose blanks, punctuation or words aren't told by single bytes
_ODD = re.compile(f"[{_LETTERS}{''.join(c for c in _EDGES if not c.isascii())}"
                  "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BYTE_VALUES = np.random.default_rng(42).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95 ^ 0x6  # 3 modulo 8


class _Powers:
    """Powers of ``_BASE`` and of its inverse modulo 2^64, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < size:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors))
        return cls.up, cls.down


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, 0 where it is empty: a polynomial in the bytes' random values, then mixed."""
    up, down = _Powers.of(max(len(data) + 1, _AT_ONCE))
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=upto[1:])
    found = (upto[end] - upto[start]) * down[start]
    found = _mixed(found, (end - start).astype(np.uint64), 0x9E3779B97F4A7C15) | np.uint64(1)
    found[end <= start] = 0
    return found


def _plain_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(token, start, end)``: where each token begins, and the bytes of its word."""
    kind = _KIND[data]
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = kind > 0
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    token, start, end = turns[::2], turns[::2].copy(), turns[1::2].copy()
    left, right = np.flatnonzero(kind[start] == 1), np.flatnonzero(kind[end - 1] == 1)
    if len(left) or len(right):
        core = np.append(np.flatnonzero(kind == 2), len(data))
        start[left] = np.minimum(core[np.searchsorted(core, start[left])], end[left])
        before = np.searchsorted(core, end[right]) - 1
        end[right] = np.maximum(np.where(before >= 0, core[before] + 1, 0), start[right])
    return token, start, end


def _batch_words(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`_word_hashes` of many texts; the words of plain ones are found and hashed as bytes, some texts at a time."""
    found: list = [None] * len(texts)
    held: list[int] = []
    raw: list[bytes] = []
    size = 0

    def close() -> None:
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        token, start, end = _plain_words(data)
        words = _span_hashes(data, start, end)
        first = np.cumsum([0, *(len(r) + 1 for r in raw)])
        bounds = np.searchsorted(token, first)
        for i, a, b in zip(held, bounds, bounds[1:]):
            at = np.flatnonzero(words[a:b])
            found[i] = words[a:b][at], at
        held.clear()
        raw.clear()

    for i, text in enumerate(texts):
        if _unusual(text) and _ODD.search(text):
            words = [t.lower().strip(_EDGES).encode("utf-8", "surrogatepass") for t in _TOKEN.findall(text)]
            end = np.cumsum([len(w) for w in words], dtype=np.int64)
            at = np.flatnonzero([len(w) for w in words])
            found[i] = _span_hashes(np.frombuffer(b"".join(words), np.uint8), np.append(0, end)[:-1][at], end[at]), at
            continue
        held.append(i)
        raw.append(text.lower().encode("utf-8", "surrogatepass"))
        size += len(raw[-1]) + 1
        if size >= _AT_ONCE:
            close()
            size = 0
    if held:
        close()
    return found


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and which of the blank-separated tokens they are; punctuation alone is no word."""
    return _batch_words([text])[0]


def _mixed(a: np.ndarray, b: np.ndarray, factor: int) -> np.ndarray:
    x = a * np.uint64(factor) + b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _groups(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words."""
    if len(words) < n:
        return words[:0]
    found, width = words, 1
    while width < n:
        step = min(width, n - width)
        found = _mixed(found[:len(found) - step], found[step:], factor)
        width += step
    return found


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """128-bit hashes of every run of ``n`` words, as rows of two integers."""
    halves = [_groups(words, n, f).view(np.int64) for f in _FACTORS]
    return np.stack(halves, axis=1).astype("<i8")


def _run_seeds(words: np.ndarray, n: int) -> np.ndarray:
    """The seed of every run of ``n`` words: the least hash of the groups of words inside it."""
    size = min(n, _SEED_WORDS)
    found, width = _groups(words, size, 0xA0761D6478BD642F), 1
    if len(words) < n:
        return found[:0].view(np.int64)
    while width < n - size + 1:
        step = min(width, n - size + 1 - width)
        found = np.minimum(found[:len(found) - step], found[step:])
        width += step
    return found.view(np.int64)


def _may_repeat_itself(seeds: np.ndarray, n: int) -> bool:
    """Whether any run can stand twice in the text: its seed then leads two stretches, or one too long for one place."""
    if len(seeds) <= n:
        return False
    turns = np.concatenate([[0], np.flatnonzero(seeds[1:] != seeds[:-1]) + 1, [len(seeds)]])
    led = seeds[turns[:-1]]
    return int(np.diff(turns).max()) > n - min(n, _SEED_WORDS) + 1 or len(np.unique(led)) < len(led)


def _batch_seeds(words: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, seed, suspects)``: the distinct seeds of each text, and the texts in which a run may stand twice.

    One pass over the words of all texts at once; runs that would cross from
    one text to the next don't count.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seeds = _run_seeds(np.concatenate([np.empty(0, np.uint64), *words]), n)
    texts = np.repeat(np.arange(len(words)), np.maximum(lengths - n + 1, 0))
    first = np.cumsum(lengths) - lengths
    places = np.arange(len(texts)) - np.repeat(np.cumsum(np.maximum(lengths - n + 1, 0)), np.maximum(lengths - n + 1, 0))
    seeds = seeds[first[texts] + places + np.maximum(lengths - n + 1, 0)[texts]]
    if not len(seeds):
        return texts, seeds, texts
    turns = np.concatenate([[0], np.flatnonzero((seeds[1:] != seeds[:-1]) | (texts[1:] != texts[:-1])) + 1, [len(seeds)]])
    led, of = seeds[turns[:-1]], texts[turns[:-1]]
    long_ = of[np.diff(turns) > n - min(n, _SEED_WORDS) + 1]
    order = np.lexsort((led, of))
    led, of = led[order], of[order]
    again = (led[1:] == led[:-1]) & (of[1:] == of[:-1])
    keep = np.concatenate([[True], ~again])
    suspects = np.unique(np.concatenate([long_, of[1:][again]]))
    return of[keep], led[keep], suspects[lengths[suspects] - n + 1 > n]


def _repeats_itself(words: np.ndarray, n: int) -> np.ndarray:
    """Which runs stand earlier in the same text without overlapping."""
    if not _may_repeat_itself(_run_seeds(words, n), n):
        return np.zeros(max(len(words) - n + 1, 0), bool)
    runs = _groups(words, n, _FACTORS[0])
    _, first, which = np.unique(runs, return_index=True, return_inverse=True)
    return np.arange(len(runs)) - first[which] >= n


def _as_bytes(runs: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(runs).tobytes()
    return [raw[i: i + 16] for i in range(0, len(raw), 16)]


def passage_spans(text: str, repeated: set[bytes] | None, passage_words: int, twice: bool = True,
                  hashed: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Spans of the runs that a smaller key has (``None``: all of them) or that the text repeats itself.

    ``hashed`` are the text's :func:`_word_hashes` where they are known.
    """
    words, at = hashed or _word_hashes(text)
    if len(words) < passage_words:
        return []
    if repeated is None:
        gone = np.ones(len(words) - passage_words + 1, bool)
    else:
        gone = _repeats_itself(words, passage_words) if twice else np.zeros(len(words) - passage_words + 1, bool)
        known = np.frombuffer(b"".join(repeated), "<i8").reshape(-1, 2)[:, 0]
        likely = np.flatnonzero(np.isin(_groups(words, passage_words, _FACTORS[0]).view(np.int64), known))
        if len(likely):
            runs = _as_bytes(_run_hashes(words, passage_words)[likely])
            gone[likely] |= np.fromiter((d in repeated for d in runs), bool, len(runs))
    if not gone.any():
        return []
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(gone)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + passage_words, -1)
    covered = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    turns = np.flatnonzero(covered[1:] != covered[:-1])
    places = [m.span() for m in (_TOKEN if _has_unspaced(text) else _WORD).finditer(text)]
    spans = []
    for a, b in zip(turns[::2], turns[1::2]):
        start, end = places[at[a]][0], places[at[b - 1]][1]
        # blanks after the passage go with it, and its line's end where it starts a line
        while end < len(text) and text[end] != "\n" and text[end].isspace():
            end += 1
        if end < len(text) and text[end] == "\n" and (start == 0 or text[start - 1] == "\n"):
            end += 1
        spans.append((start, end))
    return spans


# --- units and passages of a text ----------------------------------------


def digests_of(text: str, line_words: int, sentence_words: int, passage_words: int = 40) -> tuple[list[bytes], bool]:
    """The distinct digests of a text's units and runs of words, and whether it repeats any of them."""
    units, twice = unit_digests(text, line_words, sentence_words)
    words = _word_hashes(text)[0]
    runs = _as_bytes(_run_hashes(words, passage_words))
    return [*units, *dict.fromkeys(runs)], twice or bool(_repeats_itself(words, passage_words).any())


def unit_digests(text: str, line_words: int, sentence_words: int) -> tuple[list[bytes], bool]:
    """The distinct digests of a text's units, and whether any of them occurs twice in it."""
    found = []
    if _is_plain(text):
        for body in text.lower().split("\n"):
            found.extend(d for _, d in _plain_units(body, line_words, sentence_words) if d is not None)
        distinct = list(dict.fromkeys(found))
        return distinct, len(distinct) < len(found)
    for line, sentences in lines_of(text, line_words, sentence_words):
        if line[3] is not None:
            found.append(line[3])
            found.extend(u[3] for u in sentences if u[3] is not None)
    distinct = list(dict.fromkeys(found))
    return distinct, len(distinct) < len(found)


def removed_spans(text: str, repeated: set[bytes] | None, line_words: int, sentence_words: int,
                  run_words: int, passage_words: int = 40, runs: set[bytes] | None = None, twice: bool = True,
                  hashed: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Spans to remove, given the digests of units and of runs that a smaller key has (``None``: all of the text's).

    Without ``runs`` these are among ``repeated``.  ``twice`` is whether the
    text may repeat a unit or run of its own.
    """
    runs = repeated if runs is None else runs
    spans: list[tuple[int, int]] = []
    seen: set[bytes] = set()

    def repeat(digest: bytes | None) -> bool:
        if digest is None:
            return False
        known = repeated is None or digest in repeated or digest in seen
        seen.add(digest)
        return known

    for at, end, own, sentences, cuts in _lines(text, line_words, sentence_words) if repeated is None or repeated or twice else ():
        whole = repeat(own[1])
        marks = [repeat(u[1]) for u in sentences]
        if whole:
            spans.append((at, end))
            continue
        if not any(marks):
            continue
        ends = cuts()
        i = 0
        while i < len(marks):
            if not marks[i]:
                i += 1
                continue
            last, k = i, i
            while k < len(marks) and (marks[k] or sentences[k][1] is None):
                last = k if marks[k] else last
                k += 1
            if sum(u[0] for u in sentences[i: last + 1]) >= run_words:
                spans.append((at + ends[i - 1] if i else at, at + ends[last]))
            i = last + 1
    if runs is None or runs or twice:
        spans.extend(passage_spans(text, runs, passage_words, twice, hashed))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and merged[-1][1] >= a:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def without(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]])


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", line_words: int = 6,
                   sentence_words: int = 5, run_words: int = 20, passage_words: int = 40,
                   most_bits: int = 1 << 26) -> DataFrame:
    """``docs`` with repeated lines, sentence runs and passages removed from ``text``.

    Returns all columns of ``docs`` plus ``removed array<struct<start int,
    end int>>``: code-point offsets into the original text.

    The rank of a text is its key, an integer, ascending; the text of the
    least key keeps its units.  Rows with equal keys have equal rank and do
    not take units from one another; rows with a null key come after all
    others, and each keeps what no keyed row has.  Null texts stay null and
    empty texts empty, with nothing removed.  A text may lose everything and
    is then empty; no row is dropped.  Very long texts are read whole.  An
    empty table gives no rows.  Extra columns pass through; a column named
    ``removed`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    rank = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    fields = [f for f in docs.schema.fields if f.name != "removed"]
    names = [f.name for f in fields]
    spot = names.index(text)
    # the table's own columns go by number, so that no name of theirs meets one of these
    inner = [f"in_{i}" for i in range(len(names))]
    tagged = docs.select(*[F.col(f"`{n}`").alias(i) for n, i in zip(names, inner)], rank.alias("rank_"),
                         F.xxhash64(text).alias("hash_"))
    slim = docs.select(rank.alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))

    def dealt(batch, key_at, origin, halves, flags=None):
        # rows are cut into small batches: one text has many units
        for start in range(0, len(origin), 20_000):
            part = pa.array(origin[start: start + 20_000], pa.int64())
            own = halves[start: start + 20_000]
            columns = [batch.column(key_at).take(part), batch.column(key_at + 1).take(part),
                       pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(
                columns + ([pa.array(flags[start: start + 20_000], pa.bool_())] if flags is not None else []),
                names=["key", "hash", "d1", "d2", "twice"][:4 + (flags is not None)])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [value or "" for value in batch.column(2).to_pylist()]
            words = [found[0] for found in _batch_words(bodies)]
            texts, seeds, suspects = _batch_seeds(words, passage_words)
            doubtful = set(suspects.tolist())
            origin, found, twice = [], [], []
            for i, body in enumerate(bodies):
                own, inside = unit_digests(body, line_words, sentence_words)
                if i in doubtful and _repeats_itself(words[i], passage_words).any():
                    own, inside = own or _as_bytes(_run_hashes(words[i], passage_words)[:1]), True
                found.extend(own)
                origin.extend([i] * len(own))
                twice.extend([inside] + [False] * (len(own) - 1) if own else [])
            yield from dealt(batch, 0, origin, np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2), twice)
            # a seed is a row whose second half is 0
            yield from dealt(batch, 0, texts, np.stack([seeds, np.zeros_like(seeds)], axis=1), [False] * len(seeds))

    def firsts_of(named: DataFrame) -> DataFrame:
        return (named.groupBy("d1", "d2").agg(F.min("key").alias("first"), F.max("key").alias("last"))
                .where("first < last").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "first"))

    same = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    mark = F.when(F.col("key") > F.col("first"), F.struct("d1", "d2")).alias("mark")
    # written once: it feeds the aggregate and the join
    path = table_path(docs.sparkSession)
    named = written(slim.mapInArrow(units, "key long, hash long, d1 long, d2 long, twice boolean"), path)
    # units count where a smaller key has them, seeds where two different texts do
    several = materialised(
        named.groupBy("d1", "d2").agg(F.min("key").alias("first"), F.max("key").alias("last"),
                                      F.min("hash").alias("least"), F.max("hash").alias("most"))
        .where(F.when(F.col("d2") == 0, F.col("least") < F.col("most")).otherwise(F.col("first") < F.col("last")))
        .select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "first"))
    release(docs.sparkSession)

    def among(digests_: DataFrame):
        """Most digests occur once; a filter of bounded size over the others keeps them out of a join."""
        known = filter_of(digests_.select(F.col("e1").alias("hash")), most_bits)
        told = docs.sparkSession.sparkContext.broadcast((known.size, known.bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = PhraseFilter(*told.value)
            for batch in batches:
                may = known.has(batch.column(2).to_numpy().view(np.uint64))
                if batch.num_columns > 4:  # a text that repeats itself
                    may |= batch.column(4).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(may))

        return run

    named = named.mapInArrow(among(several), "key long, hash long, d1 long, d2 long, twice boolean")
    # a text that repeats a unit of its own comes back too, with one digest that marks nothing by itself
    found = materialised(named.join(several, same, "left").where(
        F.when(F.col("d2") == 0, F.col("first").isNotNull()).otherwise((F.col("key") > F.col("first")) | F.col("twice")))
        .select("key", "hash", "d1", "d2", "first", "twice"))
    # all that is read from here on is in ``found``
    del named, several
    forget(docs.sparkSession, path)
    release(docs.sparkSession)
    again = found.where("d2 <> 0")

    # exact copies of a smaller key's text, told without their texts
    ids = docs.where(F.col(text).isNotNull()).select(
        rank.alias("key"), F.xxhash64(text).alias("hash"), F.crc32(F.col(text)).alias("crc"))
    originals = (ids.groupBy("hash", "crc").agg(F.min("key").alias("first"), F.max("key").alias("last"))
                 .where("first < last").select(F.col("hash").alias("o_hash"), F.col("crc").alias("o_crc"), "first"))
    copies = ids.join(originals, (F.col("hash") == F.col("o_hash")) & (F.col("crc") == F.col("o_crc"))).where(
        "key > first").select("key", "hash")

    # shared seeds go back to their texts; copies need none
    common = (found.where("d2 = 0").groupBy(F.col("key").alias("c_key"), F.col("hash").alias("c_hash"))
              .agg(F.collect_set("d1").alias("seeds"))
              .join(copies.distinct(), (F.col("c_key") == F.col("key")) & (F.col("c_hash") == F.col("hash")), "left_anti"))
    seeded = tagged.join(common, (F.col("rank_") == F.col("c_key")) & (F.col("hash_") == F.col("c_hash"))).select(
        "rank_", "hash_", "seeds", inner[spot])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, found = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
            bodies = [value or "" for value in batch.column(3).to_pylist()]
            for i, ((words, _), wanted) in enumerate(zip(_batch_words(bodies), batch.column(2))):
                mine = np.isin(_run_seeds(words, passage_words), wanted.values.to_numpy(zero_copy_only=False))
                own = _run_hashes(words, passage_words)[mine]
                found.append(own)
                origin.append(np.full(len(own), i))
            yield from dealt(batch, 0, np.concatenate(origin), np.concatenate(found))

    # written once too, so that the texts travel once
    strung = written(seeded.mapInArrow(runs, "key long, hash long, d1 long, d2 long"))
    release(docs.sparkSession)
    firsts = materialised(firsts_of(strung))
    release(docs.sparkSession)
    strung = strung.mapInArrow(among(firsts), "key long, hash long, d1 long, d2 long")
    passages = strung.join(firsts, same).where(F.col("key") > F.col("first"))
    none = F.lit(None).cast("struct<d1: bigint, d2: bigint>")
    marks = (again.select("key", "hash", mark, none.alias("run"), F.lit(False).alias("copy"), "twice")
             .union(passages.select("key", "hash", none, mark, F.lit(False), F.lit(False)))
             .union(copies.select("key", "hash", none, none, F.lit(True), F.lit(False)))
             .groupBy(F.col("key").alias("m_key"), F.col("hash").alias("m_hash"))
             .agg(F.collect_set("mark").alias("units"), F.collect_set("run").alias("runs"), F.max("copy").alias("copy"),
                  F.max("twice").alias("twice")))

    joined = tagged.join(marks, (F.col("rank_") == F.col("m_key")) & (F.col("hash_") == F.col("m_hash")), "left") \
        .select(*inner, "units", "runs", "copy", "twice")

    def digests(found: pa.ListScalar) -> set[bytes]:
        halves = [x.to_numpy(zero_copy_only=False) for x in found.values.flatten()]
        return set(_as_bytes(np.stack(halves, axis=1).astype("<i8")))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())]))
        for batch in batches:
            texts, gone = [], []
            bodies = batch.column(spot).to_pylist()
            # words matter where whole runs of them may go
            marked = [i for i, (body, runs_, copy, twice) in enumerate(zip(bodies, *batch.columns[len(fields) + 1:]))
                      if body and runs_.is_valid and (len(runs_) or copy.as_py() or twice.as_py())]
            hashed = dict(zip(marked, _batch_words([bodies[i] for i in marked])))
            for i, (body, units_, runs_, copy, twice) in enumerate(zip(bodies, *batch.columns[len(fields):])):
                spans = []
                if body and units_.is_valid:
                    spans = removed_spans(body, None if copy.as_py() else digests(units_), line_words, sentence_words, run_words,
                                          passage_words, None if copy.as_py() else digests(runs_), twice.as_py(), hashed.get(i))
                texts.append(without(body, spans) if spans else body)
                gone.append([{"start": a, "end": b} for a, b in spans])
            columns = list(batch.columns[:-4])
            columns[spot] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, kind)],
                                             names=[*inner, "removed"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, fields))
    cleaned = joined.mapInArrow(clean, schema + ", removed array<struct<start: int, end: int>>")
    return cleaned.select(*[F.col(i).alias(n) for i, n in zip(inner, names)], "removed")
