"""Contiguous shards of nearly equal bytes, from global prefix sums [native].

Rows are put in a global order by range partitioning. Each partition's total gives the bytes and rows
before it; a running sum inside the partition gives those before each row. A row belongs to the shard
in which the middle of its bytes falls, so no cut is further from its equal target than half a row.
Only numbers move: texts are measured where they are read, once.

Defined cases: a null or empty text has size 1 and CRC-32 zero; equal rows are separate rows, in any
order among themselves; null keys come first; an empty table gives an empty result; input columns besides
the key and those of the expressions aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.ordering import ranged, with_prefix
from tessera.llm.scratch import materialise


def shard_by_bytes(docs: DataFrame, n_shards: int, key: str, size: Column, kept: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """``key``, ``size``, the columns of ``kept``, ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard)."""
    # Written first, so that drawing the range bounds doesn't read the texts again.
    slim = materialise(docs.select(F.col(key), size.cast("long").alias("size"), *[c.alias(k) for k, c in kept.items()]), "sizes")
    placed = with_prefix(ranged(slim, key, partitions), key, "size", [x for x in slim.columns if x != key])
    middle = F.col("_before") + F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * n_shards / F.col("_total")), F.lit(n_shards - 1)).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_start"))
    # At most n_shards rows.
    return placed.join(F.broadcast(firsts), "shard").select(*slim.columns, "shard", (F.col("_rank") - F.col("_start")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8, partitions: int | None = None) -> DataFrame:
    """All documents in shards by the law ``bytes``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = shard_by_bytes(docs, n_shards, "doc_id", F.octet_length(text) + 1, {"text_crc32": F.crc32(text)}, partitions)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
