"""File sources of the reference: panel CSV, mixed-grain Latin-1 CSV, score
CSV, metric-file folders and nested JSON run logs (S1-S7).

Schemas are explicit (inference costs a second pass over the data and
gives unstable types).  Blank CSV fields read as SQL null, never NaN.
Every reader takes a folder or glob, so a whole directory is one scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

SOURCE_FILE = "source_file"

# Mixed weather/fire file (two row kinds, told apart by OBJECTID null).
WILDFIRE_SCHEMA = T.StructType([
    T.StructField("OBJECTID", T.LongType()),
    T.StructField("zip", T.StringType()),
    T.StructField("year_month", T.StringType()),
    T.StructField("Year", T.StringType()),
    T.StructField("avg_tmax_c", T.DoubleType()),
    T.StructField("avg_tmin_c", T.DoubleType()),
    T.StructField("tot_prcp_mm", T.DoubleType()),
    T.StructField("FIRE_NAME", T.StringType()),
])

SCORE_SCHEMA = T.StructType([
    T.StructField("ZIP", T.StringType()),
    T.StructField("wildfire_risk_prob", T.DoubleType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("Experiment", T.StringType()),
    T.StructField("Model", T.StringType()),
    T.StructField("MAE", T.DoubleType()),
    T.StructField("RMSE", T.DoubleType()),
    T.StructField("R2", T.DoubleType()),
    T.StructField("MAPE", T.DoubleType()),
])

# The two report tables (S7): scores and seconds are numbers, counts and "-" markers are text.
COMPARISON_SCHEMA = T.StructType([
    T.StructField(c, T.DoubleType() if c in ("ROC-AUC", "PR-AUC", "F1", "Precision", "Recall", "Runtime_s")
                  else T.LongType() if c == "Train_samples" else T.StringType())
    for c in ("Model", "Type", "Qubits", "Features", "ROC-AUC", "PR-AUC", "F1", "Precision", "Recall", "Runtime_s",
              "Train_samples", "Notes")])
RESOURCE_SCHEMA = T.StructType([
    T.StructField(c, T.DoubleType() if c == "Best ROC-AUC" else T.StringType())
    for c in ("Model", "Qubits", "Circuit Depth", "Feature Map", "Shots", "Backend", "Train Samples",
              "Kernel Build Time (s)", "Total Runtime (s)", "Trainable Parameters", "Best ROC-AUC")])

_CLS_METRICS = [T.StructField(n, T.DoubleType()) for n in ("roc_auc", "pr_auc", "f1", "precision", "recall")]
_KERNEL_RUN = T.StructType([
    T.StructField("num_qubits", T.LongType()),
    T.StructField("feature_map_name", T.StringType()),
    T.StructField("selected_features", T.ArrayType(T.StringType())),
    T.StructField("mi_scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("circuit_depth", T.LongType()),
    T.StructField("num_parameters", T.LongType()),
    T.StructField("kernel_runtime_s", T.DoubleType()),
    T.StructField("svm_train_runtime_s", T.DoubleType()),
    *_CLS_METRICS,
])

# One wide nullable schema for every run-log shape (single-, dual-, triple-
# kernel, VQC and the classical baseline log); absent keys read as null.
RUN_LOG_SCHEMA = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("timestamp_utc", T.StringType()),
    T.StructField("random_seed", T.LongType()),
    T.StructField("data", T.StructType([
        T.StructField("source_file", T.StringType()),
        T.StructField("train_years", T.ArrayType(T.LongType())),
        T.StructField("val_years", T.ArrayType(T.LongType())),
        T.StructField("train_samples", T.LongType()),
        T.StructField("val_samples", T.LongType()),
        T.StructField("subsampled", T.BooleanType()),
        T.StructField("max_train_cap", T.LongType()),
        T.StructField("class_balance", T.StructType([
            T.StructField("train_fire_rate", T.DoubleType()),
            T.StructField("val_fire_rate", T.DoubleType())])),
    ])),
    T.StructField("features", T.StructType([
        T.StructField("all_features_used", T.ArrayType(T.StringType())),
        T.StructField("scaler", T.StringType()),
        T.StructField("class_weight", T.StringType())])),
    T.StructField("models", T.MapType(T.StringType(), T.StructType([
        *_CLS_METRICS, T.StructField("train_runtime_s", T.DoubleType())]))),
    T.StructField("feature_engineering", T.StructType([
        T.StructField("candidate_features", T.ArrayType(T.StringType())),
        T.StructField("selection_method", T.StringType()),
        T.StructField("mi_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("selected_features", T.ArrayType(T.StringType()))])),
    T.StructField("shared_config", T.StructType([
        T.StructField("candidate_features", T.ArrayType(T.StringType())),
        T.StructField("kernel", T.StringType()),
        T.StructField("reps", T.LongType()),
        T.StructField("zz_reps", T.LongType()),
        T.StructField("shots", T.StringType()),
        T.StructField("backend", T.StringType()),
        T.StructField("class_weight", T.StringType())])),
    T.StructField("quantum_config", T.StructType([
        T.StructField("num_qubits", T.LongType()),
        T.StructField("reps", T.LongType()),
        T.StructField("circuit_depth_decomposed", T.LongType()),
        T.StructField("kernel_runtime_s", T.DoubleType()),
        T.StructField("svm_train_runtime_s", T.DoubleType())])),
    T.StructField("quantum_svm_results", T.StructType(_CLS_METRICS)),
    T.StructField("classical_svm_baseline", T.StructType([
        *_CLS_METRICS, T.StructField("train_runtime_s", T.DoubleType())])),
    T.StructField("quantum_4qubit", _KERNEL_RUN),
    T.StructField("quantum_6qubit", _KERNEL_RUN),
    T.StructField("quantum_pauli_4qubit", _KERNEL_RUN),
    T.StructField("vqc_config", T.StructType([
        T.StructField("num_qubits", T.LongType()),
        T.StructField("feature_map", T.StringType()),
        T.StructField("ansatz", T.StringType()),
        T.StructField("full_circuit_depth", T.LongType()),
        T.StructField("num_parameters", T.LongType()),
        T.StructField("sampler", T.StringType()),
        T.StructField("class_weights", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("iterations_run", T.LongType()),
        T.StructField("initial_loss", T.DoubleType()),
        T.StructField("final_loss", T.DoubleType()),
        T.StructField("train_runtime_s", T.DoubleType())])),
    T.StructField("vqc_results", T.StructType(_CLS_METRICS)),
    T.StructField("_corrupt_record", T.StringType()),
])


# what a run's entry says of its classifier
LOG_FIELDS = {"roc_auc": "double", "pr_auc": "double", "f1": "double", "precision": "double", "recall": "double"}


def _with_source(df: DataFrame) -> DataFrame:
    return df.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8",
             with_source: bool = False, rejects: str | None = None) -> DataFrame:
    """Header CSV with an explicit schema: one pass, and the same types whatever the rows hold.

    A cell that doesn't fit its type is null.  ``rejects`` names a column
    that then holds the row's text (null for good rows), for
    :func:`count_rejects`.
    """
    r = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
    if rejects:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = T.StructType([*schema.fields, T.StructField(rejects, T.StringType())])
        r = r.option("columnNameOfCorruptRecord", rejects)
    df = r.schema(schema).csv(path)
    return _with_source(df) if with_source else df


def count_rejects(df: DataFrame, rejects: str) -> DataFrame:
    """``(rows, rejected)`` of a frame read with ``rejects``."""
    # all columns are kept: Spark parses no cell that isn't asked for, and then finds no fault
    faulty = F.when(F.col(rejects).isNotNull(), F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(faulty).alias("rejected"))


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    """The model-comparison report, typed."""
    return read_csv(spark, path, COMPARISON_SCHEMA)


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """The resource report, typed."""
    return read_csv(spark, path, RESOURCE_SCHEMA)


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType | str, rejects: str | None = None) -> DataFrame:
    """The premium panel (header, typed by ``schema``)."""
    return read_csv(spark, path, schema, rejects=rejects)


def read_mixed_csv(spark: SparkSession, path: str, schema: T.StructType = WILDFIRE_SCHEMA,
                   encoding: str = "ISO-8859-1", rejects: str | None = None) -> DataFrame:
    """The mixed weather/fire file in Latin-1."""
    return read_csv(spark, path, schema, encoding=encoding, rejects=rejects)


def read_scores(spark: SparkSession, path: str, schema: T.StructType = SCORE_SCHEMA, rejects: str | None = None
                ) -> DataFrame:
    """S3: external score file."""
    return read_csv(spark, path, schema, rejects=rejects)


def read_metric_folder(spark: SparkSession, folder: str, schema: T.StructType = METRICS_SCHEMA,
                       pattern: str = "*.csv") -> DataFrame:
    """Every metric CSV in ``folder`` stacked, with the source file.

    An empty or missing folder gives an empty frame with the schema.
    """
    try:
        return read_csv(spark, f"{folder.rstrip('/')}/{pattern}", schema, with_source=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e) or "UNABLE_TO_INFER" in str(e):
            # a new StructType: ``schema.add`` would mutate the shared schema object
            empty = T.StructType([*schema.fields, T.StructField(SOURCE_FILE, T.StringType())])
            return spark.createDataFrame([], empty)
        raise


def read_json_docs(spark: SparkSession, path: str, schema: T.StructType = RUN_LOG_SCHEMA) -> DataFrame:
    """One multi-line JSON document per file, all files in one scan.

    Unreadable files land in ``_corrupt_record`` (PERMISSIVE) instead of
    failing the scan; :func:`pick_latest` skips them.
    """
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).json(path)
    return _with_source(df)


def read_log_documents(spark: SparkSession, path: str) -> DataFrame:
    """S5 without a fixed schema: ``(source_file, doc variant)``, one row per file, null for unreadable ones."""
    text = _with_source(spark.read.text(path, wholetext=True))
    return text.select(SOURCE_FILE, F.try_parse_json("value").alias("doc"))


def log_entries(docs: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """P19 over logs of any shape: one row per top-level key whose value is an object with any of ``fields``.

    Returns ``(source_file, timestamp_utc, key, <fields...>, entry variant)``;
    ``fields`` maps a name inside the entry to its type.  A run under a key
    that no schema knows gives its row like any other; missing fields are
    null; documents that can't be read give none.
    """
    fields = LOG_FIELDS if fields is None else fields
    rows = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    found = rows.where(F.schema_of_variant("value").startswith("OBJECT")).select(
        SOURCE_FILE, F.try_variant_get("doc", "$.timestamp_utc", "string").alias("timestamp_utc"), "key",
        *[F.try_variant_get("value", f"$.{name}", kind).alias(name) for name, kind in fields.items()],
        F.col("value").alias("entry"))
    return found.where(F.coalesce(*[F.col(n).cast("string") for n in fields]).isNotNull())


def pick_latest(docs: DataFrame, predicate: Column | None = None, order: str = "timestamp_utc") -> DataFrame:
    """The newest document satisfying ``predicate``; unreadable rows skipped.

    Newest is by the timestamp inside the file (file times are lost on
    copy), with the file path as tie-break.  One partial aggregate.
    """
    rows = docs.filter(F.col("_corrupt_record").isNull()) if "_corrupt_record" in docs.columns else docs
    if predicate is not None:
        rows = rows.filter(predicate)
    key = F.struct(F.col(order), F.col(SOURCE_FILE))
    picked = rows.agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), key).alias("__cg_doc"))
    return picked.filter(F.col("__cg_doc").isNotNull()).select("__cg_doc.*")


def file_name_matches(pattern: str) -> Column:
    """Predicate on the source file's base name (e.g. ``'_vqc\\.json$'``)."""
    return F.regexp_extract(F.col(SOURCE_FILE), r"([^/]*)$", 1).rlike(pattern)


def snake_case(name: str) -> str:
    """``'CAT Cov A Fire -  Incurred Losses'`` -> ``'cat_cov_a_fire_incurred_losses'``."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


def snake_case_columns(df: DataFrame) -> tuple[DataFrame, dict]:
    """Rename every column to snake_case once at the scan; returns the mapping."""
    mapping = {c: snake_case(c) for c in df.columns}
    if len(set(mapping.values())) != len(mapping):
        raise ValueError("snake_case names collide")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in mapping.items()]), mapping
