"""Sharding by jump consistent hashing."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shared import running_start, whole_text

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: jumps over shard counts until the next jump would pass ``shards``.

    Growing ``shards`` by one moves about one key in shards + 1, and only into the new shard.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        state[live] = state[live] * _STEP + np.uint64(1)
        jump = np.floor((shard[live] + 1) * (2.0 ** 31 / ((state[live] >> np.uint64(33)) + np.uint64(1)))).astype(np.int64)
        inside = jump < shards
        live = live[inside]
        shard[live] = jump[inside]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of an integer key; null keys go where 0 goes."""
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return jump(F.coalesce(key.cast("long"), F.lit(0)))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put documents into shards by doc_id alone: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size: UTF-8 bytes of the text plus 1; a null text counts as empty (size 1, crc 0). slot: position in the shard, from
    0 without gaps, in an order fixed by doc_id (rows with the same id follow each other by crc and size; identical rows
    are interchangeable). grown_shard: the shard when there is one more. Rows with a null id share the shard of id 0. Empty
    table: no rows. Texts stay in the scan: only ids, sizes and checksums are shuffled, and slots of a shard are counted in
    4096 hash buckets, not in one task.
    """
    text = F.col("text")
    rows = whole_text(docs, "doc_id").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"), shard_of(F.col("doc_id"), shards).alias("shard"),
                       shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
    return (running_start(rows, "shard", ["doc_id", "text_crc32", "size"], F.lit(1), "slot")
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
