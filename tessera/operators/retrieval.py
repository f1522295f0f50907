"""Sparse and dense search and their fusion.

Everything is one lazy plan over many groups at once. Query terms and query vectors are literals, so only their postings
are scored, and a top-k is a sort that keeps k rows in each task.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(chunks: DataFrame, group: list[str]) -> DataFrame:
    """group, id, n_tokens, term, tf of each term of each chunk."""
    toks = chunks.select(*group, "id", tokens(F.col("text")).alias("toks"))
    return toks.select(*group, "id", F.size("toks").alias("n_tokens"), F.explode("toks").alias("term")).groupBy(*group, "id", "n_tokens", "term").agg(F.count("*").alias("tf"))


def _scored(chunks: DataFrame, query: list[str], group: list[str], carried: list[str]) -> DataFrame:
    """group, id, the ``carried`` columns and score of the chunks that a tokenised query scores above zero.

    Frequencies of all terms are counted once, in each task before they are shuffled; one aggregate makes a group's statistics of them. Then each
    chunk is scored where it is read, by how often it holds the few terms asked for.
    """
    base = chunks.select(*group, "id", *carried, tokens(F.col("text")).alias("_toks"))
    one = lambda a, b: a.join(b, group) if group else a.join(F.broadcast(b))
    # The number of chunks and their mean length include chunks without tokens.
    sizes = base.groupBy(*group).agg(F.count("*").alias("n"), F.avg(F.size("_toks")).alias("mean"))
    df = base.select(*group, F.explode(F.array_distinct("_toks")).alias("term")).groupBy(*group, "term").agg(F.count("*").alias("df"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    asked = list(Counter(query).items())
    each = [F.max(F.when(F.col("term") == t, idf)).alias(f"_idf{i}") for i, (t, _) in enumerate(asked)]
    # For each group, or one row. Negative weights become a quarter of the group's mean weight.
    stats = one(df, sizes).groupBy(*group, "n", "mean").agg((F.avg(idf) * EPSILON).alias("_floor"), *each).drop("n")
    part = F.lit(0.0)
    for i, (term, times) in enumerate(asked):
        tf = F.size(F.filter("_toks", F.lit(term).__eq__))
        weight = F.when(F.col(f"_idf{i}") < 0, F.col("_floor")).otherwise(F.col(f"_idf{i}")) * times
        part = part + F.when(tf > 0, weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("_toks") / F.col("mean")))).otherwise(0.0)
    return one(base, stats).select(*group, "id", *carried, F.round(part, 6).alias("score")).filter("score > 0")


def bm25(chunks: DataFrame, query: list[str], group: list[str] | None = None) -> DataFrame:
    """group, id, score (positive ones) for a tokenised query; repeated query terms count as often.

    Document frequencies and lengths are those of the chunk's group.
    """
    return _scored(chunks, query, group or [], [])


def from_postings(terms: DataFrame, sizes: DataFrame, query: list[str]) -> DataFrame:
    """doc, id, score as :func:`bm25` finds them, from stored :func:`postings` and chunk sizes of each doc (S7, M4): only the asked terms' rows are joined."""
    df = terms.groupBy("doc", "term").agg(F.count("*").alias("df"))
    stats = sizes.groupBy("doc").agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"))
    idf = df.join(stats, "doc").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = idf.groupBy("doc").agg((F.avg("idf") * EPSILON).alias("floor"))
    asked = Counter(query)
    wanted = F.col("term").isin(list(asked))
    times = F.element_at(F.create_map(*[F.lit(x) for kv in asked.items() for x in kv]), F.col("term"))
    weights = idf.filter(wanted).join(floor, "doc").select("doc", "term", "mean", (F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")) * times).alias("w"))
    f = F.col("tf")
    part = F.col("w") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    return terms.filter(wanted).join(weights, ["doc", "term"]).groupBy("doc", "id").agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")


def distinct_text(ranked: DataFrame, order: list[Column], group: list[str] | None = None, text: str = "text") -> DataFrame:
    """The best-ranked row of each trimmed text (R3); texts are told apart by their SHA-256, so they aren't shuffled."""
    keyed = ranked.withColumn("_text", F.sha2(F.trim(text), 256)).drop(text)
    w = Window.partitionBy(*(group or []), "_text").orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_text")


def top(ranked: DataFrame, order: list[Column], k: int, group: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows of each group, or of all, with their rank from 0 as ``rank0``."""
    if group:
        return ranked.withColumn("rank0", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).filter(F.col("rank0") < k)
    # At most k rows reach the single partition of the rank.
    return ranked.orderBy(*order).limit(k).withColumn("rank0", F.row_number().over(Window.orderBy(*order)) - 1)


def sparse_top(chunks: DataFrame, query: list[str], k: int, group: list[str] | None = None) -> DataFrame:
    """The best chunks by BM25 with distinct texts (R2)."""
    group = group or []
    order = [F.col("score").desc(), F.col("id")]
    return top(distinct_text(_scored(chunks, query, group, ["text"]), order, group), order, k, group)


def per_group(k: int, groups: int, least: int = 3) -> int:
    """How many hits each of several documents gives to a list of ``k``."""
    return max(least, k // max(groups, 1))


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """One minus the cosine, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return 1 - dot / (norm * F.lit(sum(x * x for x in query) ** 0.5))


def dense_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """id, distance, rank0 of the nearest vectors (columns id, embedding)."""
    scored = vectors.select("id", F.round(cosine_distance(F.col("embedding"), query), 6).alias("distance"))
    return top(scored, [F.col("distance"), F.col("id")], k)


def fuse(dense: DataFrame, sparse: DataFrame, keys: list[str], sparse_weight: Column | float = 1.0, damping: int = 60, boost: float = 1.5) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists, boosted where both agree (R7, R8): keys, dense_rank, bm25_rank, score, dual_agreement."""
    d, s = dense.select(*keys, F.col("rank0").alias("dense_rank")), sparse.select(*keys, F.col("rank0").alias("bm25_rank"))
    weight = sparse_weight if isinstance(sparse_weight, Column) else F.lit(float(sparse_weight))
    both = F.col("dense_rank").isNotNull() & F.col("bm25_rank").isNotNull()
    score = F.coalesce(1.0 / (damping + F.col("dense_rank") + 1), F.lit(0.0)) + F.coalesce(weight / (damping + F.col("bm25_rank") + 1), F.lit(0.0))
    return d.join(s, keys, "full").withColumn("dual_agreement", both).withColumn("score", F.round(F.when(both, score * boost).otherwise(score), 9))


def weighted(ranked: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores times learned weights (columns id, weight), one where none is known."""
    return ranked.join(weights, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("score", F.round(F.col("score") * F.col("weight"), 9))


def hybrid(dense: DataFrame, sparse: DataFrame, texts: DataFrame, k: int, sparse_weight: Column | float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """The best ``k`` of both lists: fused, weighted by memory, each trimmed text once (R7-R10). ``texts`` has id and text.

    Equal scores stand in dense order, then in sparse order. The lists are short, so they are what is broadcast.
    """
    fused = fuse(dense, sparse, ["id"], sparse_weight)
    if weights is not None:
        fused = weighted(fused, weights).drop("weight")
    named = texts.select("id", "text").join(F.broadcast(fused), "id")
    order = [F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), F.col("id")]
    return distinct_text(named, order).orderBy(*order).limit(k)


def typed_hits(hits: DataFrame) -> DataFrame:
    """Hits as chunks with defaults for what they lack (R17): chunk_id, doc_name, page_num, page_num_method, chunk_type, text, units, section_type."""
    value = lambda name, default=None: F.coalesce(F.nullif(F.col(name), F.lit("")) if name in hits.columns else F.lit(None).cast("string"), F.lit(default)).alias(name)
    return hits.select("chunk_id", "doc_name", "page_num", value("page_num_method", "unknown"), value("chunk_type", "prose"), "text", value("units"), value("section_type", "other"))


def agreement(fused: DataFrame) -> DataFrame:
    """The share of both lists that agree."""
    d, s = F.count("dense_rank"), F.count("bm25_rank")
    return fused.agg(F.round(F.count_if("dual_agreement") / F.greatest(F.lit(1), F.least(d, s)), 6).alias("agreement_ratio"))


def hashed_embedding(texts: list[str | None], size: int = 64) -> list[list[float]]:
    """The offline default: each token adds or takes one at a place, both from its MD5; unit length, zero without tokens (I4)."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts):
        for token, n in Counter(re.findall(r"\w+", (text or "").lower())).items():
            h = hashlib.md5(token.encode()).digest()
            row[int.from_bytes(h[:2], "big") % size] += n if h[2] < 128 else -n
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(length > 0, length, 1)).tolist()


def embed(texts: DataFrame, model: Callable[[list[str | None]], list[list[float]]] = hashed_embedding) -> DataFrame:
    """``texts`` (with text) and the ``embedding`` that ``model`` gives for batches of them (I4)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    return texts.withColumn("embedding", F.pandas_udf(run, "array<double>")("text"))
