"""Operator 2: weighted rendezvous sharding, in DataFrame functions only.

Every record key is hashed together with each shard number to a uniform
number ``u`` in (0, 1); the record goes to the shard with the least
``-ln(u) / weight``.  Shard ``i`` then gets its share ``weight_i / sum`` of
the keys, and the choice depends on the key and the list of shards alone.
Adding a shard can only replace the least cost by that of the new shard, so
rows move into the new shard and nowhere else.

The hash and the logarithm are Spark's own expressions (``xxhash64`` and
``ln``), which give the same value on every machine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.common import gapless_slots, utf8_text


def rendezvous_shard(keys: Sequence[str | Column], weights: Sequence[float]) -> Column:
    """Shard number (int) of the key columns among ``len(weights)`` weighted shards.

    Shards of weight 0 get nothing.  Null keys hash like any other value:
    all rows with the same null pattern share a shard.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights: at least one positive number, none negative")
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    bids = []
    for i, w in enumerate(weights):
        if w:
            bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(i)), 11)  # 53 bits
            u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
            bids.append(F.struct((-F.ln(u) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")))
    return F.array_min(F.array(*bids))["shard"]


def shard_rows(docs: DataFrame, weights: Sequence[float], *, grown_weight: float = 1.0, key: str = "doc_id",
               text: str = "text", buckets: int = 1024) -> DataFrame:
    """Place every row of ``docs`` in a shard, with a gapless slot there.

    Returns ``key, size long, text_crc32 long, law string, shard int,
    slot long, grown_shard int``: ``grown_shard`` is the row's shard once a
    shard of ``grown_weight`` has been added.

    The text is read once and reduced to its size and checksum before any
    shuffle.  Null text: size 1, checksum 0 (that of no bytes).  A null key is
    a key like any other.  Repeated rows get slots of their own.  An empty
    table gives no rows.  Other columns are ignored, whatever their names.
    """
    body = utf8_text(text)
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous_shard(["key"], weights)) \
               .withColumn("grown_shard", rendezvous_shard(["key"], [*weights, grown_weight]))
    return gapless_slots(rows, ["shard"], buckets=buckets).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
