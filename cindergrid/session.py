"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

# Settings every job here relies on: AQE for runtime coalescing and skew
# splitting, UTC so that day/year extraction does not depend on the host,
# Arrow for the few pandas-backed steps, and no web UI.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files are removed once their DataFrames are garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app_name: str = "cindergrid",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master`` is left to the launcher (spark-submit) when ``None``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a path that the driver and every executor
    see, and is used as is.  When it is unset, a private folder is made only
    for a ``local[...]`` master (tests), where driver and executor are one
    process; any other master raises, because each executor would write to
    its own disk and later reads would miss those files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local_master(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="cindergrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def is_local_master(master: str) -> bool:
    """True for ``local`` and ``local[...]``, not for ``local-cluster[...]``."""
    return master == "local" or master.startswith("local[")


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and continue from it.

    Used where one derived table feeds many jobs (model fits): the lineage
    is cut, later jobs read the written files, and a lost executor re-reads
    them instead of recomputing the whole derivation.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written.

    They go when the driver's objects for them are collected as garbage,
    which on a large driver heap may be long after the step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: ``--py-files``, once per application.

    Functions sent to workers name their module, which a worker must be able
    to import wherever it was started.  The driver packs its own copy and
    Spark's file server hands it to every executor.
    """
    sc = spark.sparkContext
    with _SHIPPING:  # models may be fitted in several threads
        if not getattr(sc, "_cindergrid_shipped", False):
            _ship(sc)


def _ship(sc) -> None:
    top = os.path.dirname(os.path.abspath(__file__))
    packed = os.path.join(tempfile.mkdtemp(prefix="cindergrid-code-"), "cindergrid.zip")
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("cindergrid", os.path.relpath(path, top)))
    sc.addPyFile(packed)
    sc._cindergrid_shipped = True
