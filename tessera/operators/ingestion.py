"""From raw filings to all stored tables in one declared pipeline."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import markup_blocks
from tessera.operators.chunking import chunks
from tessera.operators.dom import dom
from tessera.operators.filings import facts, segments
from tessera.operators.maintenance import replace_partition, store_postings


def index_filings(filings: DataFrame, path: str, partitions: int | None = None, **sizes: int) -> None:
    """Write filings, chunks, postings and facts of ``filings`` (doc, html) below ``path``, replacing those of the same documents and no others.

    Each page is parsed once; its elements are kept on the executors' disks until both tables are written. A document without chunks or facts has
    none afterwards.
    """
    parsed = dom(filings.select("doc", markup_blocks(F.col("html")).alias("html")), partitions).persist(StorageLevel.DISK_ONLY)
    try:
        replace_partition(filings.select("doc", "html"), f"{path}/filings", "doc")
        made = chunks(segments(parsed), **sizes)
        replace_partition(made, f"{path}/chunks", "doc", filings)
        stored = read_stored(made.sparkSession, f"{path}/chunks", made).join(filings.select("doc").distinct(), "doc", "left_semi")
        store_postings(stored.select("doc", F.col("chunk_id").alias("id"), "text"), path, filings)
        replace_partition(facts(parsed), f"{path}/facts", "doc", filings)
    finally:
        parsed.unpersist()


def read_stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stored table with the columns of ``like``."""
    return spark.read.schema(like.schema).parquet(path)
