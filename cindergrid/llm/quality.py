"""Operator 7: text quality by a sparse ensemble of rules.

1. *Statistics*: one pass over each whole text counts characters, words and
   lines and turns the counts into ratios.
2. *Rules*: a forest and boosted trees are grown on the labelled
   statistics; every path from a root to an inner node or leaf is a
   conjunction of threshold tests, that is, a rule.
3. *Weights*: a logistic regression with an L1 penalty over the rules (0/1
   columns) keeps a few of them with a weight each.
4. *Compilation*: the kept rules become one Spark column expression over the
   statistics, so scoring is a projection.

The fit uses at most ``max_rows`` labelled rows, chosen by the hash of
their key; this is the operator's only bound, and it bounds the labelled
rows used for fitting alone.  Every text is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.common import bounded_batches, materialised

STATISTICS = ("chars", "words", "word_length", "letters", "capitals", "digits", "spaces", "symbols", "pipes",
              "bangs", "distinct_words", "doubled_words", "top_word", "lines", "line_length", "distinct_lines",
              "symbol_words", "sentence_ends", "stop_ends")


# --- statistics ----------------------------------------------------------

# byte classes of UTF-8: bytes over 127 belong to letters in nearly all prose
_LETTER, _CAPITAL, _DIGIT, _SPACE, _SYMBOL = (1 << i for i in range(5))


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b > 127 or c.isalpha():
            table[b] |= _LETTER
        if b < 128 and c.isupper():
            table[b] |= _CAPITAL
        if b < 128 and c.isdigit():
            table[b] |= _DIGIT
        if b < 128 and c.isspace():
            table[b] |= _SPACE
        if b < 128 and not c.isalnum() and not c.isspace() and c not in ".,;:'\"-()?":
            table[b] |= _SYMBOL
    return table


_CLASSES = _byte_classes()


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for one whole text; all 0 for null and empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return (0.0,) * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = [float(counts[(_CLASSES & c) > 0].sum()) / n for c in (_LETTER, _CAPITAL, _DIGIT, _SPACE, _SYMBOL)]
    words = raw.split()
    m = max(1, len(words))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = [w[-1] for w in words]
    symbols = sum(1 for e in ends if _CLASSES[e] & _SYMBOL)
    stops = ends.count(46) + ends.count(33) + ends.count(63)
    return (math.log1p(n), math.log1p(len(words)), n / m, *share,
            counts[124] / n, counts[33] / n, len(tally) / m, doubled / m, max(tally.values(), default=0) / m,
            math.log1p(len(lines)), math.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
            symbols / m, stops / m, ends.count(46) / m)


def with_statistics(slim: DataFrame) -> DataFrame:
    """``slim`` (last column the text) with the text replaced by ``stat_...`` columns of doubles."""
    names = [f"stat_{s}" for s in STATISTICS]
    kept = slim.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(v.as_py()) for v in batch.column(len(kept))]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(map(float, c), pa.float64()) for c in columns)],
                                             names=[*kept, *names])

    bounded_batches(slim.sparkSession)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    return slim.mapInArrow(run, ", ".join(schema + [f"{x} double" for x in names]))


# --- rules ---------------------------------------------------------------


@dataclass(frozen=True, order=True)
class Rule:
    """A conjunction of tests ``statistic <= limit`` (``below``) or ``> limit``."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        found = F.lit(True)
        for name, below, limit in self.tests:
            found = found & ((F.col(f"stat_{name}") <= F.lit(limit)) if below else (F.col(f"stat_{name}") > F.lit(limit)))
        return found

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if b else '>'} {x:.6g}" for n, b, x in self.tests)


def tree_rules(root, names: tuple[str, ...]) -> set[Rule]:
    """Every path of a Spark ML tree as a rule; of several tests on one side of a statistic the tightest stays."""
    found: set[Rule] = set()

    def walk(node, tests: dict[tuple[str, bool], float]) -> None:
        if tests:
            found.add(Rule(tuple(sorted((n, b, x) for (n, b), x in tests.items()))))
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, limit = names[split.featureIndex()], round(float(split.threshold()), 9)
        low = tests.get((name, True), math.inf)
        high = tests.get((name, False), -math.inf)
        walk(node.leftChild(), tests | {(name, True): min(low, limit)})
        walk(node.rightChild(), tests | {(name, False): max(high, limit)})

    walk(root, {})
    return found


@dataclass(frozen=True)
class RuleEnsemble:
    """A fitted model: log-odds = ``base`` + the weights of the rules that hold."""

    base: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as a column over ``stat_...`` columns."""
        odds = F.lit(self.base)
        for rule, weight in self.rules:
            odds = odds + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_rules(labelled: DataFrame, *, trees: int = 16, depth: int = 3, rounds: int = 8, penalty: float = 0.002,
              seed: int = 7) -> RuleEnsemble:
    """Fit on ``labelled(stat_..., label double)``.

    Where all labels are equal there is nothing to learn: no rules, and the
    base says that label with odds of ten thousand to one.  Without any
    labelled row the base says even odds.
    """
    sums = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    if not sums["n"] or sums["ones"] in (0.0, float(sums["n"])):
        return RuleEnsemble(math.log(1e4) * (0 if not sums["n"] else 1 if sums["ones"] else -1), ())
    columns = [f"stat_{s}" for s in STATISTICS]
    train = VectorAssembler(inputCols=columns, outputCol="features").transform(labelled).select("features", "label").cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(train)
    boosted = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed).fit(train)
    rules: set[Rule] = set()
    for tree in [*forest.trees, *boosted.trees]:
        rules |= tree_rules(tree._call_java("rootNode"), STATISTICS)
    train.unpersist()
    ordered = sorted(rules)
    if not ordered:
        return RuleEnsemble(math.log(sums["ones"] / (sums["n"] - sums["ones"])), ())
    held = labelled.select("label", F.array(*[r.column().cast("double") for r in ordered]).alias("held"))
    from pyspark.ml.functions import array_to_vector
    design = held.select("label", array_to_vector("held").alias("features")).cache()
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60, tol=1e-5).fit(design)
    design.unpersist()
    weights = model.coefficients.toArray().tolist()
    return RuleEnsemble(float(model.intercept), tuple((r, w) for r, w in zip(ordered, weights) if w))


# --- the operator --------------------------------------------------------


def learnable(key: str | Column) -> Column:
    """True for the rows that labels may be learnt from: crc32 of the key as text, mod 4, is not 2."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % 4 != 2


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8_000, key: str = "doc_id", text: str = "text",
                label: str = "quality") -> RuleEnsemble:
    """Learn ``label`` (0/1) from the learnable labelled texts, at most ``max_rows`` of them.

    Labels that are null, or contradict one another for a key, are left out;
    so are rows with a null key.
    """
    marks = (labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
             .where(F.col("key").isNotNull() & F.col("label").isin(0, 1)).where(learnable("key"))
             .groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most"))
             .where("label = most").drop("most"))
    chosen = marks.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(chosen), "key").select(F.col("label").cast("double").alias("label"), "text")
    # at most max_rows short rows: a few tasks per fitting job are enough
    return fit_rules(materialised(with_statistics(rows)).coalesce(8))


def score_quality(docs: DataFrame, model: RuleEnsemble, *, key: str = "doc_id", text: str = "text",
                  threshold: float = 0.7) -> DataFrame:
    """``key, held_out boolean, score double, predicted int`` for every row.

    Null and empty texts have all statistics 0 and are scored by the rules
    like any other.  Very long texts are read whole.  Repeated rows and null
    keys (``held_out`` null) give a row each.  An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    scored = with_statistics(slim).select("key", model.score().alias("score"))
    return scored.select(F.col("key").alias(key), (~learnable("key")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: RuleEnsemble, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``.

    The rows never leave the task that scores them.  Columns named
    ``stat_...`` after a statistic can't be passed through and raise.
    """
    clash = [c for c in docs.columns if c in {f"stat_{s}" for s in STATISTICS} or c == "__scored"]
    if clash:
        raise ValueError(f"columns {clash} clash with statistics")
    scored = with_statistics(docs.withColumn("__scored", F.col(text)))
    return scored.where(model.score() >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
