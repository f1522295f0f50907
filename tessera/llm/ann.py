"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are dealt to shards, and each shard's forest is written once. In it, every tree hashes vectors to long strings of bits (sides
of random planes) and keeps them sorted. A query descends every tree to the rows that share the longest prefix with it, then all trees
ascend together, one bit at a time, until they have offered ``share`` times the shard's rows between them (a
row counts in each tree that offers it). Only offered rows are scored, by their exact inner product.

For the largest inner product, vectors get one more coordinate that makes them all equally long, and queries a zero
there; then the largest product is the smallest angle. The longest vector comes from an aggregate.

Isotropic data in 64 dimensions has neighbours at 60 degrees and more, where planes hardly tell them from the rest:
recall of 0.9 takes about half of all rows. Data with structure reaches it with a smaller ``share``.

Queries are dealt to tasks in blocks. A task reads the written shards one after another, each task from another one on, and
keeps the best ``k`` of each of its queries. So only the vectors are shuffled, once as rows and once more as queries, and nothing is broadcast;
what is scored grows with queries times ``share`` times rows. Shards are read with pyarrow's file systems from the shared folder.

Defined cases: vectors that are null, zero, of another than the most common length, or hold null or non-finite
components take no part; a row is no candidate for a query of its own id; with fewer candidates than ``k`` those offered
are returned; repeated ids are separate candidates, and of queries with one id the least vector asks; ties go to the smaller
id; an empty table gives an empty result; input columns besides vec_id, embedding and those of the query condition aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.names import unused
from tessera.llm.scratch import materialise

TREES, DEPTH, SHARE, LEAST = 16, 24, 1.1, 400
SHARD, BLOCK, SEED = 8_192, 4_096, 7
FOUND = "query_id long, rank int, vec_id long, score double"
#: A shard's forest: ids, vectors (64-bit floats), sorted hash strings of each tree and their rows.
FOREST = "ids binary, vectors binary, keys binary, places binary"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _keys(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bit strings, first bit highest: a row for each tree."""
    bits = (x @ planes >= 0).reshape(len(x), TREES, DEPTH)
    return (bits @ (1 << np.arange(DEPTH - 1, -1, -1))).T


def _planes(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, TREES * DEPTH))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    held = column.combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)


def _grower(longest: float):
    """A shard's rows become its forest."""

    def grow(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("embedding"))
        extra = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
        keys = _keys(np.column_stack((x, extra)), _planes(x.shape[1]))
        order = np.argsort(keys, axis=1, kind="stable")
        parts = (table.column("vec_id").to_numpy().astype("<i8"), x.astype("<f8"), np.take_along_axis(keys, order, 1).astype("<i4"), order.astype("<i4"))
        return pa.table([pa.array([p.tobytes()], pa.binary()) for p in parts], names=[c.split()[0] for c in FOREST.split(", ")])

    return grow


class Forest:
    """A written shard: its vectors, and the sorted hash strings of each tree."""

    def __init__(self, row: dict[str, bytes], width: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(-1, width)
        self.keys, self.order = (np.frombuffer(row[c], "<i4").reshape(TREES, -1) for c in ("keys", "places"))

    def offered(self, asked: np.ndarray, budget: float) -> Iterator[np.ndarray]:
        """For each query's hash strings (a row for each tree) the rows that the trees offer."""
        levels = np.arange(DEPTH, -1, -1)
        low = np.empty((len(levels), TREES, asked.shape[1]), dtype=np.int32)
        high = np.empty_like(low)
        for n, level in enumerate(levels.tolist()):
            width = DEPTH - level
            for t in range(TREES):
                prefix = asked[t] >> width
                low[n, t] = np.searchsorted(self.keys[t], prefix << width)
                high[n, t] = np.searchsorted(self.keys[t], (prefix + 1) << width)
        enough = (high - low).sum(1) >= min(budget, TREES * self.keys.shape[1])
        stop = enough.argmax(0)
        mask = np.zeros(self.keys.shape[1], dtype=bool)
        for q, n in enumerate(stop.tolist()):
            mask[:] = False
            for t in range(TREES):
                mask[self.order[t, low[n, t, q] : high[n, t, q]]] = True
            yield np.flatnonzero(mask)


def _searcher(path: str, k: int, share: float):
    """The best ``k`` of each of a task's queries over all written shards."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # At most a block, about.
        asked = [b for b in batches if b.num_rows]
        if not asked:
            return
        table = pa.Table.from_batches(asked)
        q, names = _matrix(table.column("embedding")), table.column("vec_id").to_numpy()
        keys = _keys(np.column_stack((q, np.zeros(len(q)))), _planes(q.shape[1]))
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        system, folder = fs.FileSystem.from_uri(path)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet"))
        at = TaskContext.get().partitionId() % max(len(files), 1)
        for file in files[at:] + files[:at]:
            with system.open_input_file(file) as source:
                for batch in pq.ParquetFile(source).iter_batches(1):
                    forest = Forest(batch.to_pylist()[0], q.shape[1])
                    budget = max(LEAST, share * len(forest.x))
                    for a in range(0, len(q), 256):
                        for n, rows in enumerate(forest.offered(keys[:, a : a + 256], budget), a):
                            rows = rows[forest.ids[rows] != names[n]]
                            score, ids = np.concatenate((best[n][0], forest.x[rows] @ q[n])), np.concatenate((best[n][1], forest.ids[rows]))
                            if len(score) > k:
                                edge = np.partition(score, len(score) - k)[len(score) - k]
                                score, ids = score[score >= edge], ids[score >= edge]
                            order = np.lexsort((ids, -score))[:k]
                            best[n] = score[order], ids[order]
        for a in range(0, len(q), 1024):
            part = best[a : a + 1024]
            count = [len(s) for s, _ in part]
            columns = (np.repeat(names[a : a + 1024], count), np.concatenate([np.arange(1, c + 1) for c in count]), np.concatenate([i for _, i in part]), np.concatenate([s for s, _ in part]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=[c.split()[0] for c in FOUND.split(", ")])

    return search


def nearest(vectors: DataFrame, queries: Column, k: int = 20, share: float = SHARE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each row where ``queries`` holds."""
    spark, mark = vectors.sparkSession, unused(vectors, "_query")
    good = vectors.withColumn(mark, F.coalesce(queries, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col(mark).alias("_query"))
    good = materialise(good.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("_n", F.size("embedding")), "vectors")
    common = good.groupBy("_n").count().orderBy(F.col("count").desc(), "_n").first()
    good = good.filter(F.col("_n") == (common["_n"] if common else 0))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = good.agg(F.count("*").alias("n"), F.count_if("_query").alias("q"), F.max(norm).alias("longest")).first()
    shards = max(1, -(-stats.n // shard))
    # As many blocks as there are cores, unless they get small.
    blocks = max(1, -(-stats.q // block), min(spark.sparkContext.defaultParallelism, -(-stats.q // 256)))
    dealt = good.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id()), F.lit(shards)).alias("s"))
    forest = materialise(dealt.groupBy("s").applyInArrow(_grower(stats.longest or 0.0), FOREST), "forest")
    asked = good.filter("_query").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return asked.repartition(blocks, "vec_id").mapInArrow(_searcher(forest._written, k, share), FOUND)
