"""Tables that cut lineage, in the folder that driver and executors share.

A table stays until it is forgotten or the driver's JVM ends, which deletes what is left.

Defined cases: an empty table is written and read back like any other; rows, repeats, nulls and columns stay as they are.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; a fresh local one only where the master is a single JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return _qualified(spark, base.rstrip("/"))
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL[app]


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, so that readers other than Spark find the same folder."""
    if "://" not in path:
        system, target = _located(spark, path)
        path = system.makeQualified(target).toString()
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    system, target = _located(spark, path)
    system.deleteOnExit(target)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete those of ``tables`` that :func:`materialise` wrote and no later step reads."""
    for t in tables:
        path = t.__dict__.pop("_written", None)
        if path:
            system, target = _located(t.sparkSession, path)
            system.delete(target, True)


def _located(spark: SparkSession, path: str) -> tuple:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target
