"""A training-data pipeline over ``documents``: filter, identify, deduplicate, pack.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and
works on the whole output of the stage before it.  All but the last return
the columns of ``documents``.

* quality: texts scored below 0.7 by the rule ensemble go;
* language: texts whose language can't be determined go;
* near_duplicates: of each group of near-duplicates (five-word shingles,
  similarity 0.8) the smallest doc_id stays;
* substrings: lines and passages that a smaller doc_id has are cut out, and
  ``n_chars`` follows the text;
* packing: token sequences of at most 4096, one row per piece.

Nulls, empty and very long texts, repeated rows and empty tables are treated
as the operators' docstrings say.  Rows that are alike in doc_id, text, lang
and source are decided alike in the first two stages; the third keeps one of
them.  Columns other than those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindergrid.llm.language import UNDETERMINED, fit_text_model, fuse, text_evidence
from cindergrid.llm.minhash import near_duplicates
from cindergrid.llm.packing import pack
from cindergrid.llm.quality import fit_quality, keep_quality
from cindergrid.llm.substrings import remove_repeats
from cindergrid.session import checkpoint_dir
from cindergrid.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# No SQL: tree ensembles, MinHash components and token merges have no form in it.
ORACLE_SQL = None


def _identity() -> list:
    """What tells rows apart where decisions come back to them; rows without a doc_id come last in order."""
    return [F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"),
            F.xxhash64("text", "lang", "source").alias("hash")]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score at least 0.7; the rules are learnt from ``labels`` and the texts of ``docs``."""
    docs = docs.select(*COLUMNS)
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is determined; the source stands for the host, ``lang`` for the declaration."""
    docs = docs.select(*COLUMNS)
    model = fit_text_model(docs)
    found = fuse(text_evidence(docs, model, _identity(), text="text", source="source", declared="lang"),
                 model.languages)
    gone = found.where(F.col("lang") == UNDETERMINED).select(F.col("key").alias("gone")).distinct()
    return docs.withColumn("key", F.struct(*_identity())).join(gone, F.col("key") == F.col("gone"), "left_anti") \
        .select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates: the one with the smallest doc_id."""
    rows = docs.select(*COLUMNS, F.struct(*_identity()).alias("key"))
    kept = near_duplicates(rows, words=5, percent=80, key="key").where("kept").select(F.col("key").alias("stays"))
    return rows.join(kept.distinct(), F.col("key") == F.col("stays")).dropDuplicates(["key"]).select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and passages that a smaller doc_id has."""
    cleaned = remove_repeats(docs.select(*COLUMNS))
    cut = F.size("removed") > 0
    return cleaned.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096, one row per piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("substrings", substring),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    The output of each but the last is written as Parquet to a new folder
    below the shared checkpoint folder and read again, so that an executor
    lost later never repeats an earlier stage.  The folders stay until
    the checkpoint folder is cleared.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
