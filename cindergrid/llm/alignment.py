"""Operator 12: alignment of two tokenizers' tokens by their byte ranges.

Both tokenizers spell the same bytes, a blank and the text, so tokens can be
compared by where they start and end.

1. Each Arrow batch of texts is encoded by both.  Two ``merge_asof`` joins,
   keyed by document, give every token start the token of the other side
   that covers it; the union of both directions is all overlaps.  Overlaps
   that end together are the cuts between groups.
2. A document's links are the token pairs of its groups, kept as distinct id
   pairs with how often each occurs.  They are written once, one row per
   document, beside one row per batch with its distinct pairs and in how
   many documents each occurs.
3. The pairs are counted over all documents, and each left id's largest
   count is found, by grouped aggregates.
4. Counts go back to the batches that hold the pair (not to each document:
   a pair that every document holds is one row a batch), and each batch
   sums them over its documents' links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches, materialised
from cindergrid.llm.packing import _byte_alphabet

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class ByteLevel:
    """A byte-level BPE file of ``tokenizers``: ids of a text, without special tokens, and each id's bytes.

    The merges run in ``tiktoken``, whose result is the same where ids follow
    the order of the merges; a file where they don't is refused.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of = spec["model"]["vocab"], _byte_alphabet()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or merged != sorted(merged):
            raise ValueError("a byte-level BPE whose ids follow its merges is needed")
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("a token for every byte is needed")
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.engine = tiktoken.Encoding("left", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        made = (self.engine.encode_ordinary(" " + t) for t in texts)
        return [np.fromiter(ids, np.int64, len(ids)) for ids in made]


class Pieces:
    """A ``sentencepiece`` model: ids of a text, and each id's bytes.

    Where no piece holds a blank after another character and the model doesn't
    normalise, merges never cross from a word to the blank behind it.  Words
    (with the blanks before them) are then encoded once and kept, at most
    ``keep`` of them.
    """

    def __init__(self, path: str, keep: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.engine = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.engine.id_to_piece(i) for i in range(self.engine.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.engine.is_byte(i) else n.replace("▁", " ").encode()
                      for i, n in enumerate(names)]
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        how = model.normalizer_spec
        self.by_word = not (how.precompiled_charsmap or how.remove_extra_whitespaces) and how.add_dummy_prefix \
            and how.escape_whitespaces and not any(re.search("[^▁]▁", n) for n in names)
        self.keep, self.known, self.odd = keep, {}, set()

    def spells(self, ids: Sequence[int], text: str) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode()

    def encode(self, texts: list[str]) -> list[Sequence[int] | None]:
        """Ids of each text, or None where they don't spell a blank and the text."""
        if not self.by_word:
            made = self.engine.encode(texts, num_threads=1)
            return [ids if self.spells(ids, t) else None for ids, t in zip(made, texts)]
        words = [t.split(" ") if "  " not in t and t[0] != " " != t[-1] else
                 [w[1:] for w in re.findall(" *[^ ]+| +$", " " + t)] for t in texts]
        fresh = list(set(chain.from_iterable(words)).difference(self.known))
        if len(self.known) + len(fresh) > self.keep:
            self.known, self.odd = {}, set()
            fresh = list(set(chain.from_iterable(words)))
        # blanks at a text's end come without a word, which the engine would not encode alone
        blank = [w for w in fresh if not w.strip(" ")]
        lead = len(self.engine.encode("a"))
        self.known.update((w, tuple(self.engine.encode(f"a {w}")[lead:])) for w in blank)
        fresh = [w for w in fresh if w.strip(" ")]
        self.known.update(zip(fresh, map(tuple, self.engine.encode(fresh, num_threads=1))))
        self.odd.update(w for w in fresh if not self.spells(self.known[w], w))
        out = []
        for text, parts in zip(texts, words):
            ids = list(chain.from_iterable(map(self.known.__getitem__, parts)))
            out.append(ids if self.odd.isdisjoint(parts) or self.spells(ids, text) else None)
        if len(self.known) > self.keep:  # one batch with more distinct words than are kept
            self.known, self.odd = {}, set()
        return out


class Aligner:
    """Both tokenizers, made once per worker."""

    def __init__(self, left: str, pattern: str, right: str):
        self.sides = ByteLevel(left, pattern), Pieces(right)
        self.widths = [np.array([len(b) for b in s.bytes]) for s in self.sides]
        sizes = [len(s.bytes) for s in self.sides]
        self.base = sizes[1]  # a pair's code is left * base + right
        self.pairs = sizes[0] * sizes[1]
        # ids as written in the groups: left ids, then right ids, each inside and at the end of its side of a group
        self.spelled = [b"%d%c" % (i, end) for n, ends in zip(sizes, (b",|", b",;")) for end in ends for i in range(n)]
        self.starts = 0, sizes[0], 2 * sizes[0], 2 * sizes[0] + sizes[1]

    def tokens(self, texts: Sequence[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every text under both; none where either side doesn't spell a blank and the text."""
        at = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in at]
        found = [[np.empty(0, np.int64)] * len(texts) for _ in self.sides]
        # the left side has a token for every byte, so its tokens always spell the text
        for i, left, right in zip(at, *[side.encode(some) for side in self.sides]):
            if right is not None:
                found[0][i], found[1][i] = left, np.fromiter(right, np.int64, len(right))
        return found[0], found[1]


def overlaps(starts: Sequence[np.ndarray], docs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the left and right tokens that share bytes; starts rise over the whole batch."""
    left, right = (pd.DataFrame({"start": s, "doc": d, "token": np.arange(len(s))}) for s, d in zip(starts, docs))
    covers = pd.merge_asof(left, right, on="start", by="doc", suffixes=("_l", "_r"))
    covered = pd.merge_asof(right, left, on="start", by="doc", suffixes=("_r", "_l"))
    pairs = pd.concat([covers, covered], ignore_index=True)
    l, r = pairs["token_l"].to_numpy(), pairs["token_r"].to_numpy()
    # tokens that start together are in both
    twice = np.arange(len(l)) >= len(covers)
    twice &= starts[0][l] == starts[1][r]
    return l[~twice], r[~twice]


def _pair_counts(group: Sequence[np.ndarray], ids: Sequence[np.ndarray], doc: np.ndarray, groups: int, base: int, pairs: int,
                 small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``doc * pairs + code`` with their number of occurrences.

    Groups of up to ``small`` pairs are listed; larger ones are reduced to
    their distinct ids first, so that a long run of one token is one row.
    """
    sizes = [np.bincount(g, minlength=groups) for g in group]
    first = [np.cumsum(s) - s for s in sizes]
    n = sizes[0] * sizes[1]
    # every left token of a small group with each right token of it
    tokens = np.flatnonzero(n[group[0]] <= small)
    times = sizes[1][group[0][tokens]]
    at = np.repeat(tokens, times)
    step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    codes = [doc[at] * pairs + ids[0][at] * base + ids[1][first[1][group[0][at]] + step]]
    weights = [np.ones(len(at), np.int64)]
    for g in np.flatnonzero(n > small):
        cut = [slice(f[g], f[g] + s[g]) for f, s in zip(first, sizes)]
        (a, m), (b, k) = (np.unique(i[c], return_counts=True) for i, c in zip(ids, cut))
        codes.append((doc[cut[0].start] * pairs + a[:, None] * base + b).ravel())
        weights.append((m[:, None] * k).ravel())
    if len(codes) == 1:
        return np.unique(codes[0], return_counts=True)
    every, where = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, where, np.concatenate(weights))
    return every, total


def _packed(codes: np.ndarray, numbers: np.ndarray) -> bytes:
    """Rising codes and a number for each, compressed."""
    steps = np.diff(codes, prepend=0)
    wide = [np.uint8 if x.max(initial=0) < 1 << 8 else np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64
            for x in (steps, numbers)]
    raw = b"".join(x.astype(w).tobytes() for x, w in zip((steps, numbers), wide))
    head = np.array([len(codes), *[np.dtype(w).itemsize for w in wide]], "<i8").tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, *wide = np.frombuffer(body[:24], "<i8").tolist()
    raw = pa.decompress(body[24:], n * sum(wide), codec="zstd", asbytes=True)
    steps = np.frombuffer(raw[: n * wide[0]], f"<u{wide[0]}").astype(np.int64)
    return np.cumsum(steps), np.frombuffer(raw[n * wide[0]:], f"<u{wide[1]}").astype(np.int64)


def align_batch(tool: Aligner, texts: Sequence[str | None]) -> tuple[dict[str, np.ndarray], list[str], list[bytes], bytes]:
    """Counts per text, group digests, packed links per text, and the batch's distinct pairs with their texts."""
    rows = len(texts)
    tokens = tool.tokens(texts)
    counts = [np.array([len(t) for t in side], np.int64) for side in tokens]
    ids = [np.concatenate([*side, np.empty(0, np.int64)]) for side in tokens]
    docs = [np.repeat(np.arange(rows), n) for n in counts]
    # both sides of a text have the same bytes, so running sums over the batch keep texts apart and aligned
    ends = [np.cumsum(w[i]) for w, i in zip(tool.widths, ids)]
    starts = [e - w[i] for e, w, i in zip(ends, tool.widths, ids)]
    left, right = overlaps(starts, docs)
    together = ends[0][left] == ends[1][right]
    last = [np.zeros(len(i), bool) for i in ids]
    last[0][left[together]] = True
    last[1][right[together]] = True
    group = [np.cumsum(x) - x for x in last]
    groups = int(last[0].sum())
    sizes = [np.bincount(g, minlength=groups) for g in group]
    code, number = _pair_counts(group, ids, docs[0], groups, tool.base, tool.pairs)
    # the groups as text: a group's left ids, then its right ids
    before = [np.concatenate(([0], np.cumsum(s))) for s in sizes]
    shown = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for side, (here, there) in enumerate(((0, 1), (1, 0))):
        place = np.arange(len(ids[here])) + before[there][group[here] + side]
        shown[place] = ids[here] + np.where(last[here], tool.starts[2 * side + 1], tool.starts[2 * side])
    shown, cuts = shown.tolist(), np.concatenate(([0], np.cumsum(counts[0] + counts[1]))).tolist()
    spelled = tool.spelled
    digests = [hashlib.sha256(b"".join(map(spelled.__getitem__, shown[a:b]))[:-1]).hexdigest() if b > a else ""
               for a, b in zip(cuts, cuts[1:])]
    of, pair = np.divmod(code, tool.pairs)
    bounds = np.searchsorted(of, np.arange(rows + 1)).tolist()
    bodies = [_packed(pair[a:b], number[a:b]) if b > a else b"" for a, b in zip(bounds, bounds[1:])]
    links = np.bincount(of, weights=number, minlength=rows).astype(np.int64)
    per_doc = np.bincount(docs[0][last[0]], minlength=rows)
    return ({"n_a": counts[0], "n_b": counts[1], "n_groups": per_doc, "n_links": links}, digests, bodies,
            _packed(*np.unique(pair, return_counts=True)))


_TOOLS: dict[tuple[str, str, str], Aligner] = {}


def _tool(*paths: str) -> Aligner:
    if paths not in _TOOLS:
        _TOOLS[paths] = Aligner(*paths)
    return _TOOLS[paths]


def token_links(docs: DataFrame, left: str, pattern: str, right: str, *, text: str, key: str) -> DataFrame:
    """A row per document (``whole`` false) and one per batch with its pairs (``whole`` true); see the module."""
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(left, pattern, right)
        for number, batch in enumerate(batches):
            made, digests, bodies, pairs = align_batch(tool, batch.column(1).to_pylist())
            n = len(batch)
            chunk = (TaskContext.get().partitionId() << 32) + number
            key_ = pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])
            yield pa.RecordBatch.from_arrays(
                [key_, pa.array([chunk] * (n + 1)), pa.array([False] * n + [True]),
                 *[pa.array([*made[c].tolist(), 0], pa.int64()) for c in COUNTS], pa.array([*digests, None], pa.string()),
                 pa.array([*bodies, pairs], pa.binary())],
                names=["key", "chunk", "whole", *COUNTS, "groups_sha256", "body"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, chunk long, whole boolean, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, body binary")


def _listed(wholes: DataFrame) -> DataFrame:
    """``chunk, pair, docs`` from the batches' packed pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pair, docs = _unpacked(body)
                for start in range(0, len(pair), 1 << 16):
                    cut = slice(start, start + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pair[cut]), chunk)), pa.array(pair[cut]), pa.array(docs[cut])],
                        names=["chunk", "pair", "docs"])

    return wholes.select("chunk", "body").mapInArrow(run, "chunk long, pair long, docs long")


def _summed(key_kind: str):
    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["pair"].to_numpy())
        known, docs_, best = (pairs[c].to_numpy()[order] for c in ("pair", "docs", "best"))
        sums, bests = [], []
        for body in docs["body"].to_pylist():
            code, number = _unpacked(body) if body else (np.empty(0, np.int64),) * 2
            at = np.searchsorted(known, code)
            sums.append(int((docs_[at] * number).sum()))
            bests.append(int(number[best[at]].sum()))
        return docs.select(["key", *COUNTS]).append_column("n_best", pa.array(bests, pa.int64())) \
            .append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])

    return run, f"key {key_kind}, {', '.join(f'{c} long' for c in (*COUNTS, 'n_best', 'count_sum'))}, groups_sha256 string"


def align_tokens(docs: DataFrame, left: str, pattern: str, right: str, *, text: str = "text", key: str = "doc_id"
                 ) -> DataFrame:
    """One row per document: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``left`` is a byte-level BPE file that gets a blank and the text (A),
    with the ``pattern`` that it splits texts by; ``right`` is a
    ``sentencepiece`` model that puts the blank there itself (B).  Offsets
    where tokens of both end cut them into groups, and all A-B pairs of a
    group are links.  A pair's count is the number of documents that hold it.
    ``n_best`` is the number of links whose count is the highest of their A
    id, ``count_sum`` the sum of the counts over the links, and
    ``groups_sha256`` the SHA-256 of ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that a tokenizer changes (B's model may
    normalise, and a literal U+2581 reads as a blank), have no tokens: zeros
    and an empty digest.  Special tokens inside a text are plain text.
    Repeated rows count as documents of their own, whatever their keys; null
    keys are kept.  An empty table gives no rows.  Other columns are ignored.
    """
    stage = materialised(token_links(docs, left, pattern, right, text=text, key=key))
    base = Pieces(right).engine.get_piece_size()
    listed = _listed(stage.where("whole"))
    counted = listed.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair div {base}"))
    most = counted.groupBy("a").agg(F.max("docs").alias("most")).withColumnRenamed("a", "of")
    counted = counted.join(most, F.col("a") == F.col("of")).select(
        F.col("pair").alias("code"), "docs", (F.col("docs") == F.col("most")).alias("best"))
    back = listed.select("chunk", "pair").join(counted, F.col("pair") == F.col("code")).select("chunk", "pair", "docs", "best")
    run, schema = _summed(stage.schema["key"].dataType.simpleString())
    rows = stage.where("not whole").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, schema)
    return rows.withColumnRenamed("key", key)
