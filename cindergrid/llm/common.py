"""Helpers that several operators of this package share.

* :func:`bounded_batches` keeps Arrow batches small, so that a Python worker
  holds a few megabytes of text whatever the longest documents are;
* :func:`gapless_slots` numbers the rows of each group 0, 1, 2, ... without
  bringing a group together in one task;
* :func:`connected_components` labels the components of a link table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindergrid.session import checkpoint_dir, release, ship_package  # noqa: F401


def bounded_batches(spark: SparkSession, rows: int = 1024, size: int = 4 << 20) -> None:
    """Bound the Arrow batches sent to Python workers, ``rows`` rows or ``size`` bytes, and let workers import this."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder: less disk than a checkpoint where values repeat."""
    spark = df.sparkSession
    path = path or table_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(spark: SparkSession) -> str:
    """A new folder for :func:`written`, for a table that :func:`forget` deletes before the checkpoint folder is cleared."""
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more; what was made from it must be written itself."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def utf8_text(text: str | Column) -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def gapless_slots(rows: DataFrame, group: Sequence[str], *, slot: str = "slot", buckets: int = 1024) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each ``group``, in a fixed pseudo-random order.

    Equal rows are counted before the shuffle and expanded again at the end,
    so a row repeated any number of times is one row on the way.  A group is
    split into ``buckets`` hash buckets over all columns; slots are the
    bucket's offset (a running sum over at most ``buckets`` counts per group)
    plus the position inside the bucket, so no task ever holds more than one
    bucket of a group.
    """
    cols, keys = rows.columns, [*group, "__bucket"]
    counted = (rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")))
    offsets = (counted.groupBy(*keys).agg(F.sum("__n").alias("__size"))
               .withColumn("__offset", F.coalesce(F.sum("__size").over(
                   Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select(*[F.col(k).alias(f"__o_{k}") for k in keys], "__offset"))
    inside = Window.partitionBy(*keys).orderBy(*[c for c in cols if c not in group]).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = counted.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    joined = placed.join(offsets, [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys])
    first = F.col("__offset") + F.col("__inside")
    return joined.select(*cols, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(slot))


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, component)`` for every row of ``nodes(node)``; component = smallest node reachable.

    ``links(a, b)`` are undirected.  Alternating large-star and small-star
    steps (each one grouped aggregate and one join over the links, which stay
    distributed) until the links are stars around the smallest node of each
    component.  Every step is written to the shared checkpoint folder.  The
    number of rounds grows with the logarithm of the longest path.
    """
    edges = materialised(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .distinct())
    while True:
        # large star: every larger neighbour of u moves to the smallest of u's neighbours and u itself
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = (moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        after = materialised(small)
        same = _fingerprint(after) == _fingerprint(edges)
        edges = after
        if same:
            break
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("__least")), "node", "left").select(
        "node", F.coalesce("__least", "node").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    """One row that tells two sets of links apart: their number and two sums over them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                           F.sum(F.hash("v", "u").cast("decimal(38,0)"))).first())
