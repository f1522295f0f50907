"""Joins that a hot key can't hold up, and keys that are dealt evenly.

Defined cases: null keys match nothing; an empty table gives an empty result; columns of both sides must differ but for the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot, so hot keys are at most the inverse; a task can hold so many rows of a key.
SHARE, LEAST = 0.001, 100_000
#: More keys than this are even enough by themselves.
FEW = 100_000


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` distinct numbers that a shuffle by them deals evenly over the session's partitions; hashing 0 to ``n`` - 1 would give some several times as many."""
    if n > FEW:
        return list(range(n))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = -(-n // parts)
    known = spark.range(0, 4 * (n + 8 * parts), 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, each).alias("ids")).collect()
    out = [r["ids"][k] for k in range(each) for r in sorted(known) if k < len(r["ids"])][:n]
    return out if len(out) == n else list(range(n))


def spread_join(rows: DataFrame, one: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has one row for each ``key``; both should be written tables.

    The rows of ``one`` for hot keys, at most 1 / ``SHARE`` of them, are broadcast, so rows of a hot key stay where they are. No
    other key has more than ``SHARE`` of the rows that are shuffled.
    """
    total = rows.count() if total is None else total
    if total <= LEAST:
        return rows.join(one, key)
    counted = rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).filter((F.col("_n") > max(LEAST, int(total * SHARE))) & F.col("_hot").isNotNull())
    keys = [r["_hot"] for r in counted.select("_hot").collect()]
    if not keys:
        return rows.join(one, key)
    hot = F.col(key).isin(keys)
    return rows.filter(hot).join(F.broadcast(one.filter(hot)), key).unionByName(rows.filter(~hot).join(one.filter(~hot), key))
