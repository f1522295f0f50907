"""Readers and writers of filings, question files and stored tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "id string, question string, answer string, doc_name string, company string, doc_period string, doc_type string, evidence array<struct<evidence_page_num:int,passage:string>>"
CHUNK = "chunk_id string, doc_name string, page_num int, page_num_method string, chunk_type string, units string, section_type string, text string, embedding array<float>"


def utf8(content: Column, bad: str = "ignore") -> Column:
    """Bytes as text, dropping or replacing what isn't UTF-8."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.translate(text, "�", "") if bad == "ignore" else text


def filings(spark: SparkSession, folder: str, bad: str = "ignore") -> DataFrame:
    """doc, html of each .htm and .html file; the name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{htm,html}").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.html?$", 1).alias("doc"), utf8(F.col("content"), bad).alias("html"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of uploaded .htm, .html and .txt files (S3)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{htm,html,txt,HTM,HTML,TXT}").load(folder)
    return files.select(F.regexp_extract("path", r"(?i)([^/]+)\.(?:html?|txt)$", 1).alias("doc"), utf8(F.col("content")).alias("html"))


def questions(spark: SparkSession, path: str, strict: bool = True, first: int | None = None) -> DataFrame:
    """Question records, or the ``first`` of them; blank lines are skipped, malformed ones fail or, if not ``strict``, are dropped."""
    rows = spark.read.schema(QUESTION).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows if first is None else rows.limit(first)


def question_documents(rows: DataFrame) -> DataFrame:
    """doc_name, n: the distinct documents that questions name, without endings, and how many each has."""
    name = F.regexp_replace("doc_name", r"\.html?$", "")
    return rows.filter("doc_name is not null").groupBy(name.alias("doc_name")).agg(F.count("*").alias("n"))


def valid_name(name: str) -> str:
    """An identifier that may name a table."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def create_chunks(spark: SparkSession, name: str) -> None:
    """An empty table of chunks, unless there is one."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {valid_name(name)} ({CHUNK}) USING parquet PARTITIONED BY (doc_name)")


def stored(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A stored table, or an empty one where nothing is stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(conf).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def document_names(chunks: DataFrame) -> DataFrame:
    """Sorted names of indexed documents."""
    return chunks.select("doc_name").distinct().orderBy("doc_name")


def write_log(records: DataFrame, path: str) -> None:
    """One JSON object for each record."""
    records.write.mode("errorifexists").json(path)
