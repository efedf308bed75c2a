"""Operator 9: license scans by patience alignment.

A notice is found in a text by aligning their words:

1. *Signals*: for each notice, enough of its once-only words are chosen that
   any match of the wanted coverage must hold at least one.  One
   Aho-Corasick pass over the whole text finds them all; most texts hold
   none and are done.
2. *Windows*: around a signal, the words that a match could span, up to the
   next occurrence of the same signal on either side.
3. *Patience alignment* of window and notice: equal words at the ends are
   matched; words that occur exactly once on both sides are anchors; the
   longest increasing subsequence of the anchors' places is kept; and the
   gaps between kept anchors are aligned in the same way.
4. *Coverage* is the share of the notice's words that were matched.  A
   notice of under ``WHOLE`` words must be matched whole and without words
   between, and so must the *naming words* of longer ones: each phrase that
   tells the license from its relatives, at one of its places.  Of matches that overlap in
   the text, the one with most words stays.

Each text is scanned where it is read; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches

_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")


WHOLE = 12

# what names a license inside a longer notice, and what must not stand between
_NAMING = re.compile(
    r"(?:apache|mit|mozilla|eclipse|boost) (?:public |software )?license(?: version \d[\d.]*)?"
    r"|\b(?:lesser|library|affero)\b|version \d[\d.]*"
    r"|creative commons attribution\S* \d[\d.]*")


# words that make another license of the same notice where it doesn't have them
_OTHERS = frozenset(("lesser", "library", "affero"))


def naming_runs(words: list[str]) -> list[tuple[int, int]]:
    """Places of the runs of words that name the license."""
    starts, at = {}, 0
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 1
    return [(starts[m.start()], starts[m.start()] + m[0].count(" ") + 1)
            for m in _NAMING.finditer(" ".join(words)) if m.start() in starts]


def words_of(text: str) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(text)]


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k] = v
            piles[k] = i
        back.append(piles[k - 1] if k else -1)
    found, i = [], piles[-1] if piles else -1
    while i >= 0:
        found.append(i)
        i = back[i]
    return found[::-1]


def patience_align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places ``(i, j)`` with ``a[i] == b[j]``, increasing on both sides."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ours, theirs = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if theirs[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if ours[w] == 1 and w in place]
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        matched.extend(kept)
        if kept:
            # an anchor's neighbours are matched outwards when their gap is aligned
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]))
    return sorted(matched)


class Scanner:
    """Finds notices in texts; one per worker and set of notices."""

    def __init__(self, notices: dict[str, str], coverage: float):
        import ahocorasick

        self.coverage = coverage
        self.notices = {name: words_of(body) for name, body in notices.items()}
        if not all(self.notices.values()):
            raise ValueError("a notice without words")
        self.naming = {name: [(0, len(ws))] if len(ws) < WHOLE else naming_runs(ws) for name, ws in self.notices.items()}
        tally = Counter(w for ws in self.notices.values() for w in set(ws))
        self.signals: dict[str, list[str]] = {}
        for name, ws in self.notices.items():
            # a match may lack this many words, so one more signal word than that can't all be missing
            lacking = int((1 - coverage) * len(ws) + 1e-9)
            counts = Counter(ws)
            # long words that few notices share are rarest elsewhere
            ranked = sorted(counts, key=lambda w: (len(w) < 6, counts[w] > 1, tally[w], -len(w), w))
            chosen, total = [], 0
            for w in ranked:
                if total > lacking:
                    break
                chosen.append(w)
                total += counts[w]
            for w in chosen:
                self.signals.setdefault(w, []).append(name)
        self.automaton = ahocorasick.Automaton()
        for w in self.signals:
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()

    def _named(self, name: str, found: list[tuple[int, int]], words: list[str], low: int) -> bool:
        """Whether every naming phrase of the notice is matched somewhere, word by word."""
        between = _OTHERS.intersection(words[low + found[0][0]: low + found[-1][0] + 1])
        if not between.issubset(self.notices[name]):
            return False
        place = {j: i for i, j in found}
        phrases: dict[tuple[str, ...], bool] = {}
        for a, b in self.naming[name]:
            phrase = tuple(self.notices[name][a:b])
            whole = all(j in place and place[j] - place.get(a, -1) == j - a for j in range(a, b))
            phrases[phrase] = phrases.get(phrase, False) or whole
        return all(phrases.values())

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """``(notice, coverage, start, end)`` with code-point offsets, in the order of the text."""
        low = f" {text.lower()} "
        if not any(not low[end + 1].isalnum() and not low[end - len(w)].isalnum() for end, w in self.automaton.iter(low)):
            return []
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.signals:
                places.setdefault(w, []).append(i)
        best: dict[tuple[str, int, int], int] = {}
        for signal, at in places.items():
            for name in self.signals[signal]:
                notice = self.notices[name]
                # a match with its gaps may be half as long again as the notice
                reach = len(notice) + len(notice) // 2 + 2
                once = notice.count(signal) == 1
                done = -1
                for k, i in enumerate(at):
                    if i < done:
                        continue
                    low, high = max(0, i - reach), min(len(words), i + reach)
                    if once:
                        low = max(low, at[k - 1] + 1 if k else 0)
                        high = min(high, at[k + 1] if k + 1 < len(at) else len(words))
                    found = patience_align(words[low:high], notice)
                    if len(found) >= self.coverage * len(notice) - 1e-9 and self._named(name, found, words, low):
                        first, last = low + found[0][0], low + found[-1][0] + 1
                        if last - first <= 2 * reach:
                            best[name, first, last] = len(found)
                            done = last if not once else -1
        kept: list[tuple[int, int, str, int]] = []
        for (name, first, last), n in sorted(best.items(), key=lambda x: (-x[1], x[0][2] - x[0][1], x[0])):
            if all(last <= a or first >= b for a, b, _, _ in kept):
                kept.append((first, last, name, n))
        return [(name, n / len(self.notices[name]), spans[a][0], spans[b - 1][1]) for a, b, name, n in sorted(kept)]


_SCANNERS: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, notices: dict[str, str], *, coverage: float = 0.8, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per notice found: ``key, license string, coverage double, start int, end int``.

    A text without any notice has one row with null license and offsets and
    coverage 0; so have null and empty texts.  Offsets are code points of
    the original text.  Very long texts are read whole.  Repeated rows and
    null keys give their rows each.  An empty table gives no rows.  Other
    columns are ignored, whatever their names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (coverage, *notices.items())
        if name not in _SCANNERS:
            _SCANNERS[name] = Scanner(notices, coverage)
        scanner = _SCANNERS[name]
        for batch in batches:
            origin, rows = [], []
            for i, value in enumerate(batch.column(1)):
                found = scanner.scan(value.as_py() or "") or [(None, 0.0, None, None)]
                rows.extend(found)
                origin.extend([i] * len(found))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(origin, pa.int64())),
                 *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int32(), pa.int32())))],
                names=["key", "license", "coverage", "start", "end"])

    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, license string, coverage double, start int, end int") \
        .withColumnRenamed("key", key)
