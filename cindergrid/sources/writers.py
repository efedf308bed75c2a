"""Sinks (K1-K7).  Every writer is a distributed ``DataFrameWriter`` call
into a folder; nothing is gathered on the driver to be written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> str:
    """CSV with header.  ``single_file`` coalesces to one part - only for
    small report tables (a handful of rows), never for row-level data."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)
    return path


def save_metrics(metrics: DataFrame, path: str) -> DataFrame:
    """K1: write a metrics table and return it."""
    write_csv(metrics, path, single_file=True)
    return metrics


def save_predictions(preds: DataFrame, path: str, key: str, y_true: str, y_pred: str, model: str,
                     experiment: str, key_out: str = "ZIP") -> DataFrame:
    """K2: per-row predictions tagged with model and experiment, partitioned by both.

    Writing a model of an experiment again replaces its rows and leaves the others.
    """
    out = preds.select(F.col(key).alias(key_out), F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"),
                       F.lit(model).alias("model"), F.lit(experiment).alias("experiment"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "model").parquet(path)
    return out


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ("Year",), fmt: str = "parquet") -> str:
    """K3: the feature-complete panel, partitioned by period so later reads prune."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_bucketed_panel(df: DataFrame, name: str, entity: Sequence[str], period: Sequence[str], buckets: int,
                         path: str | None = None) -> str:
    """K3 as a table of ``buckets`` buckets by entity, each sorted by entity and period.

    Windows by entity and joins or aggregates on it read the table
    (``spark.table(name)``) without an exchange: a bucket is one file and one
    task.  ``path`` keeps the files outside the warehouse.
    """
    w = df.repartition(buckets, *entity).write.mode("overwrite").format("parquet") \
        .bucketBy(buckets, *entity).sortBy(*entity, *period)
    (w.option("path", path) if path else w).saveAsTable(name)
    return name


def write_scores(scores: DataFrame, path: str, key: str, score_cols: Sequence[str], digits: int = 6) -> DataFrame:
    """K4: zip-level scores rounded to ``digits``, globally sorted by key
    (a range-partitioned sort, so part files are in key order)."""
    out = scores.select(key, *[F.round(c, digits).alias(c) for c in score_cols]).orderBy(key)
    out.write.mode("overwrite").option("header", True).csv(path)
    return out


def write_run_log(log: DataFrame, path: str, partition_by: str | None = "experiment", run_id: str | None = None) -> str:
    """K5: one JSON document per run; runs accumulate.

    With ``run_id`` the document has its own partition, which Spark stages
    and swaps in whole: a run that is retried or repeated under its id is
    there once.  Without it a document is appended.
    """
    parts = [partition_by] if partition_by and partition_by in log.columns else []
    if run_id is None:
        w = log.coalesce(1).write.mode("append")
    else:
        parts.append("run_id")
        w = log.coalesce(1).withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*parts) if parts else w).json(path)
    return path


def write_combined(df: DataFrame, path: str) -> str:
    """K6: stacked metrics to a folder *outside* the input folder."""
    return write_csv(df, path, single_file=True)


def write_report(df: DataFrame, path: str) -> str:
    """K7: a report table (a few rows) as one CSV part."""
    return write_csv(df, path, single_file=True)
