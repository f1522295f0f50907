"""A content-addressed store of token ids.

Writing tokenises each document once, in the task that reads it. A rolling hash over the ids cuts the
stream into chunks of 128 to 4096 ids, so that equal passages give equal chunks wherever they stand. A
chunk is named by its digest. Chunks are dealt by digest and one copy of each is kept; a task sends a
chunk's ids once. Beside them stands a recipe for each document: its chunks' digests and lengths and their
Merkle root. Recipes are then put in ascending order of doc_id with the number of ids before each. The manifest is a hash tree
over the recipes in that order, with at most ``FAN`` nodes under one: its lowest nodes are pages of recipes, its highest is the root.

Files below the store's path, all Parquet: ``blocks`` (chunks, and recipes as first written), ``recipes``
(ascending, with starts), ``manifest``.

Before anything is returned, reading makes every page's node again from the recipes and every higher node from those below, and
compares them with the manifest (and its root with the caller's, if given); and it looks for each chunk that a recipe names. Then it
opens the chunks where they lie, checks each against its name and takes its CRC. CRC-32 is linear,
so a document's is the exclusive or of its chunks' values moved by the bytes after each: only numbers
are joined, and a document's chunks needn't meet in order. :func:`read_ids` gives the ids themselves.

Defined cases: null and empty texts have only the end id; repeated rows are separate documents with starts
of their own; null ids come first; an empty table gives an empty store and an empty result; a lost, doubled or changed
recipe, a lost or changed chunk and a wrong root raise an error; input columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.ordering import ranged, with_prefix
from tessera.llm.scratch import materialise
from tessera.llm.skew import spread_join
from tessera.llm.tokens import Encoder, crc32

END = 1
LEAST, WINDOW, MASK, MOST = 128, 16, 511, 4096
#: A task remembers so many chunks that it has sent.
REMEMBERED = 500_000
#: And encodes texts of so many characters at once.
AT_ONCE = 6_000_000
#: Nodes of the manifest's tree under one.
FAN = 1024
BLOCKS = "digest binary, payload binary, doc_id long, n_tokens long, digests binary, lengths binary, root binary"
_ODD = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _spread(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            _POWERS[name] = np.cumprod(np.full(size, base, dtype=np.uint64))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A random-looking number for each id; small ids are looked up."""
    if "mixed" not in _POWERS:
        _POWERS["mixed"] = _spread(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
    return _POWERS["mixed"][ids] if int(ids.max()) < 1 << 16 else _spread(ids.astype(np.uint64) + np.uint64(1))


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last ``WINDOW`` ids has zeros in its high bits."""
    up, down = _powers(len(ids))
    total = np.cumsum(_mixed(ids) * down)
    rolled = total * up
    rolled[WINDOW:] = (total[WINDOW:] - total[:-WINDOW]) * up[WINDOW:]
    return np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def chunk_ends(found: list[int], n: int) -> list[int]:
    """Ends of the chunks of ``n`` ids from the marks among them: ``LEAST`` to ``MOST`` ids apart, but for the last."""
    out, last = [], 0
    for m in (*found, n):
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < n:
            out.append(m)
            last = m
    if last < n:
        out.append(n)
    return out


def cuts(texts: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each of several texts. All are hashed at once: as ``LEAST`` is over ``WINDOW``, no cut sees the text before."""
    ends = np.cumsum([len(x) for x in texts])
    found = marks(np.concatenate(texts))
    starts = ends - [len(x) for x in texts]
    lo, hi = np.searchsorted(found, starts, "right"), np.searchsorted(found, ends, "right")
    return [chunk_ends((found[a:b] - s).tolist(), len(x)) for a, b, s, x in zip(lo.tolist(), hi.tolist(), starts.tolist(), texts)]


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


class Merkle:
    """The root of a binary hash tree over leaves given one at a time; keeps a node for each level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for k, have in enumerate(self.levels):
            if have is None:
                self.levels[k] = node
                return
            self.levels[k], node = None, hashlib.sha256(have + node).digest()
        self.levels.append(node)

    def root(self) -> bytes:
        out = b""
        for node in self.levels:
            if node is not None:
                out = hashlib.sha256(node + out).digest()
        return out


def _root(digests: bytes) -> bytes:
    tree = Merkle()
    for a in range(0, len(digests), 16):
        tree.add(digests[a : a + 16])
    return tree.root()


def _batch(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(list(zip(*rows)) or [()] * len(names), kinds)], names=names)


_B, _L = pa.binary(), pa.int64()


def _encoder(vocabulary: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.shared(vocabulary), np.array([END], dtype="<u4")
        sent: set[bytes] = set()
        nth, part = 0, TaskContext.get().partitionId()

        def coded(docs: list[int | None], texts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal nth
            rows: list[tuple] = []
            for doc_id, ids, ends in zip(docs, texts, cuts(texts)):
                # The first byte says how wide the ids are.
                wide = 2 if int(ids.max()) < 1 << 16 else 4
                raw, head = ids.astype(f"<u{wide}").tobytes(), bytes([wide])
                names, last = [], 0
                for cut in ends:
                    payload = head + raw[wide * last : wide * cut]
                    names.append(name := digest(payload))
                    last = cut
                    if name not in sent:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(name)
                        rows.append((name, payload, None, None, None, None, None))
                # A recipe's own key deals it anywhere.
                key = hashlib.blake2b(f"{part}:{nth}".encode(), digest_size=17).digest()
                nth += 1
                digests = b"".join(names)
                rows.append((key, None, doc_id, len(ids), digests, np.diff([0, *ends]).astype("<u4").tobytes(), _root(digests)))
            return _batch(rows, BLOCKS, [_B, _B, _L, _L, _B, _B, _B])

        def several(docs: list[int | None], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            block, held = [np.append(ids, end) for ids in encoder.many(texts)], 0
            first = 0
            for k, ids in enumerate(block):
                held += len(ids)
                if held > 500_000 or k == len(block) - 1:
                    yield coded(docs[first : k + 1], block[first : k + 1])
                    first, held = k + 1, 0

        for batch in batches:
            docs, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc_id)
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held > AT_ONCE:
                    yield from several(docs, texts)
                    docs, texts, held = [], [], 0
            if docs:
                yield from several(docs, texts)

    return encode


def _pages(recipes: DataFrame) -> DataFrame:
    """The lowest nodes of the manifest: ``nth``, n_docs, n_tokens and node (hex) of each page of recipes."""
    leaf = F.sha2(F.concat_ws(":", "start", "n_tokens", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex("root")), 256)
    leaves = recipes.select(F.col("page").alias("nth"), "n_tokens", F.struct("start", leaf.alias("node")).alias("leaf"))
    return leaves.groupBy("nth").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _node("leaf").alias("node"))


def _node(column: str):
    """The hash of the sorted nodes under one."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(column)), lambda x: x["node"]), ""), 256)


def _above(nodes: DataFrame) -> DataFrame:
    """The nodes over ``nodes``, in runs of ``FAN`` of their ranks, which are gapless."""
    under = F.struct("nth", F.sha2(F.concat_ws(":", "n_docs", "n_tokens", "node"), 256).alias("node")).alias("leaf")
    rows = nodes.select(F.floor(F.col("nth") / FAN).alias("nth"), "n_docs", "n_tokens", under)
    return rows.groupBy("nth").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _node("leaf").alias("node"))


def write_store(docs: DataFrame, path: str, vocabulary: str, partitions: int | None = None) -> str:
    """Write the ids of all documents below ``path``; returns the manifest's root."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_encoder(vocabulary), BLOCKS)
    coded.repartition(n, "digest").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/blocks")
    recipes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter(F.octet_length("digest") == 17)
    slim = ranged(recipes.select("doc_id", "n_tokens", "digests", "lengths", "root"), "doc_id", n)
    placed = with_prefix(slim, "doc_id", "n_tokens", ["root"]).select("doc_id", F.col("_before").cast("long").alias("start"), "n_tokens", "digests", "lengths", "root", "_part", F.floor(F.col("_rank") / FAN).cast("long").alias("page"))
    placed.sortWithinPartitions("_part", "start").drop("_part").write.option("compression", "zstd").parquet(f"{path}/recipes")
    level, nodes = 0, _pages(spark.read.parquet(f"{path}/recipes"))
    while True:
        nodes.select(F.lit(level).alias("level"), "nth", "n_docs", "n_tokens", "node").write.mode("append").parquet(f"{path}/manifest")
        level, below = level + 1, spark.read.parquet(f"{path}/manifest").filter(F.col("level") == level)
        if below.count() <= 1:
            break
        nodes = _above(below)
    top = below.head()
    return top["node"] if top else ""


def verify_manifest(spark: SparkSession, path: str, root: str | None = None) -> None:
    """Raise ValueError unless the recipes make the manifest's nodes, those the ones above, and all the ``root``, if given."""
    manifest = spark.read.parquet(f"{path}/manifest")
    # A row for each level: their number grows with the logarithm of the recipes.
    levels = {r.level: r.n for r in manifest.groupBy("level").agg(F.count("*").alias("n")).collect()}
    top = manifest.filter(F.col("level") == max(levels, default=0)).head()
    if sorted(levels) != list(range(len(levels))) or (levels and levels[max(levels)] != 1):
        raise ValueError(f"{path}: the manifest has no single root")
    if root is not None and root != (top["node"] if top else ""):
        raise ValueError(f"{path}: the manifest's root isn't {root}")
    for level in range(max(len(levels), 1)):
        stated = manifest.filter(F.col("level") == level).select("nth", F.struct("n_docs", "n_tokens", "node").alias("stated"))
        source = _pages(spark.read.schema(RECIPES).parquet(f"{path}/recipes")) if level == 0 else _above(manifest.filter(F.col("level") == level - 1))
        made = source.select("nth", F.struct("n_docs", "n_tokens", "node").alias("made"))
        if not made.join(stated, "nth", "full").filter(~F.col("made").eqNullSafe(F.col("stated"))).isEmpty():
            raise ValueError(f"{path}: the recipes differ from the manifest")


RECIPES = "doc_id long, start long, n_tokens long, digests binary, lengths binary, root binary, page long"


#: The CRC's polynomial, lowest power in the highest bit.
_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), modulo the CRC's polynomial."""
    out, b = np.zeros_like(a), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return out


def moved(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What data of this CRC-32 adds to the CRC-32 of data with so many bytes after it."""
    out, power, n = crc.astype(np.uint32), np.array([1 << 23], dtype=np.uint32), n_bytes.astype(np.int64)  # 1 << 23: x ** 8
    while n.any():
        out = np.where(n & 1, _times(out, np.broadcast_to(power, out.shape)), out)
        power, n = _times(power, power), n >> 1
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, length and CRC of each chunk, checked against its name."""
    for batch in batches:
        rows = []
        for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest(payload) != name:
                raise ValueError(f"a chunk differs from its name {name.hex()}")
            ids = np.frombuffer(payload, dtype=f"<u{payload[0]}", offset=1).astype("<u4")
            rows.append((name, len(ids), crc32(ids.tobytes())))
        yield _batch(rows, "digest, n, crc", [_B, _L, _L])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with the bytes after it."""
    for batch in batches:
        names, n, after, count = [], [], [], []
        for doc_id, tokens, digests, lengths, root in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "n_tokens", "digests", "lengths", "root")]):
            own = np.frombuffer(lengths, dtype="<u4").astype(np.int64)
            if _root(digests) != root or own.sum() != tokens or len(digests) != 16 * len(own):
                raise ValueError(f"the recipe of document {doc_id} differs from its root")
            names += [digests[a : a + 16] for a in range(0, len(digests), 16)]
            n.append(own)
            after.append((own.sum() - np.cumsum(own)) * 4)
            count.append(len(own))
        if names:
            where = pa.array(np.repeat(np.arange(len(count)), count))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("start").take(where), pa.array(names, _B), pa.array(np.concatenate(n), _L), pa.array(np.concatenate(after), _L)], names=["doc_id", "start", "digest", "length", "after"])


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = moved(batch.column("crc").to_numpy(zero_copy_only=False), batch.column("after").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(share.astype(np.int64), _L)], names=["doc_id", "start", "n", "share"])


def _read(spark: SparkSession, path: str, root: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored chunks, their digest, n and crc, and the parts of all recipes; verified, and no part lacks its chunk."""
    verify_manifest(spark, path, root)
    chunks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter(F.octet_length("digest") == 16).select("digest", "payload")
    known = materialise(chunks.mapInArrow(_chunks, "digest binary, n long, crc long"), "chunks")
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "digests", "lengths", "root")
    parts = materialise(recipes.mapInArrow(_parts, "doc_id long, start long, digest binary, length long, after long"), "parts")
    asked = parts.groupBy("digest").agg(F.min("length").alias("least"), F.max("length").alias("most"))
    if not asked.join(known, "digest", "left").filter("n is null or n <> least or n <> most").isEmpty():
        raise ValueError(f"{path}: a recipe's chunk is missing or has another length")
    return chunks, known, parts


def read_summary(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the stored chunks."""
    _, known, parts = _read(spark, path, root)
    joined = spread_join(parts, known, "digest").select("doc_id", "start", "n", "crc", "after")
    shares = joined.mapInArrow(_shares, "doc_id long, start long, n long, share long")
    return shares.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("share").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """doc_id, start and ids of each document, rebuilt from its chunks."""
    chunks, _, parts = _read(spark, path, root)

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(p, dtype=f"<u{p[0]}", offset=1).astype(np.int32).tolist() for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "after", "ids"])

    joined = spread_join(parts, chunks, "digest").select("doc_id", "start", "after", "payload").mapInArrow(widened, "doc_id long, start long, after long, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct(-F.col("after"), "ids")))
    return joined.groupBy("doc_id", "start").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
