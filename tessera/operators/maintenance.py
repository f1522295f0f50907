"""Upkeep of stored chunks and ingestion choices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.retrieval import postings


def duplicates(chunks: DataFrame, key: list[str], id_: str) -> DataFrame:
    """Rows whose id is not the smallest of their key (M1)."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(id_))).filter("_n > 1").drop("_n")


def without_duplicates(chunks: DataFrame, key: list[str], id_: str) -> DataFrame:
    """The row with the smallest id of each key (M2): aggregated before it is shuffled."""
    rest = [c for c in chunks.columns if c not in key]
    return chunks.groupBy(*key).agg(F.min_by(F.struct(*rest), id_).alias("_v")).select(*key, "_v.*")


def duplicates_by(chunks: DataFrame, group: str, text: str, most: int = 20) -> DataFrame:
    """Groups with repeated texts: total and repeats, the most first (M3)."""
    return chunks.groupBy(group).agg(F.count("*").alias("total"), (F.count("*") - F.count_distinct(text)).alias("duplicates")).filter("duplicates > 0").orderBy(F.col("duplicates").desc(), group).limit(most)


def select_ingest(files: DataFrame, subset: DataFrame | None, reserved: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Files to ingest: in the subset, not reserved, not yet indexed (M8)."""
    out = files if subset is None else files.join(subset.select(key), key, "left_semi")
    return out.join(reserved.select(key), key, "left_anti").join(indexed.select(key), key, "left_anti")


def update_pages(stored: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Stored rows with the newly parsed page where there is one (M5)."""
    new = parsed.select(key, F.col("page_num").alias("_new"))
    return stored.join(new, key, "left").withColumn("page_num", F.coalesce("_new", "page_num")).drop("_new")


def migrate(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows that the new store lacks."""
    return old.join(new.select(key), key, "left_anti")


def with_status(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Documents with their stored status, pending where there is none."""
    return docs.join(done.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def replace_partition(rows: DataFrame, path: str, by: str, keys: DataFrame | None = None) -> None:
    """Replace the partitions of the keys that ``rows`` has, and of those in ``keys`` that it has none for, which are emptied."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if keys is not None:
        spark = rows.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        # Documents of one ingestion, of which few are empty.
        for row in keys.select(by).distinct().join(rows.select(by).distinct(), by, "left_anti").toLocalIterator():
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={escape(str(row[by]))}")
            folder.getFileSystem(conf).delete(folder, True)


def store_postings(chunks: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    """Write the postings and sizes of the chunks' documents (doc, id, text), replacing theirs; the success marker is written last."""
    replace_partition(postings(chunks, ["doc"]), f"{path}/postings", "doc", docs)
    sizes = chunks.select("doc", "id", F.size(tokens(F.col("text"))).alias("n_tokens"))
    replace_partition(sizes, f"{path}/sizes", "doc", docs)


def rebuild_postings(chunks: DataFrame, path: str) -> None:
    """Write all postings again from the stored chunks (M4): whatever else the folder had goes."""
    postings(chunks, ["doc"]).write.mode("overwrite").partitionBy("doc").parquet(f"{path}/postings")
    chunks.select("doc", "id", F.size(tokens(F.col("text"))).alias("n_tokens")).write.mode("overwrite").partitionBy("doc").parquet(f"{path}/sizes")


def ingest_facts(filings: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame], only: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """Extract and store the facts of ``filings`` (doc, html), of all or of those in ``only`` (M7): doc, n_facts, status (stored, empty, missing, dry run)."""
    asked = filings.select("doc") if only is None else only.select("doc").distinct()
    chosen = filings if only is None else filings.join(only.select("doc"), "doc", "left_semi")
    found = extract(chosen)
    if not dry_run:
        replace_partition(found, path, "doc", chosen)
        found = found.sparkSession.read.schema(found.schema).parquet(path).join(chosen.select("doc"), "doc", "left_semi")
    counted = found.groupBy("doc").agg(F.count("*").alias("n_facts"))
    out = asked.join(counted, "doc", "left").join(filings.select("doc", F.lit(True).alias("_has")), "doc", "left")
    status = F.when(F.col("_has").isNull(), "missing").when(F.coalesce("n_facts", F.lit(0)) == 0, "empty").otherwise("dry run" if dry_run else "stored")
    return out.select("doc", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), status.alias("status"))


def diagnose(stages: dict[str, DataFrame]) -> dict[str, int]:
    """Row counts of retrieval stages; the first empty one says where hits are lost (M6)."""
    return {name: df.count() for name, df in stages.items()}


def diagnosis(counts: dict[str, int]) -> str:
    """What the numbers of ``sparse``, ``dense`` and ``fused`` hits say (M6)."""
    sparse, dense = counts.get("sparse", 0), counts.get("dense", 0)
    if not sparse and not dense:
        return "neither search found anything: the filing isn't indexed, or its name differs"
    if not sparse:
        return "no chunk has the question's terms: expand them, or check the chunks"
    if not dense:
        return "no vectors are stored for the filing: index it again"
    return "both found chunks: if nothing is answered, the draft or its check is unsure"
