"""Benchmark passages in documents, by greedy string tiling.

A document's words are compared with each item that shares a run of ``seed`` words with it. Hashes of all runs
are rolled over the document's words at once (Karp-Rabin), looked up among the items' runs and confirmed by their words. A maximal match
starts where the words before a shared run differ and ends where those after one do, so its ends are found without listing the runs
inside; the longest match is marked first, and what overlaps marked words is cut back, until no match of ``seed``
words is left. The marked share of the item's words is its coverage, so a passage whose parts stand in
another order is covered all the same. An item whose shared runs together can't reach the coverage isn't tiled.

Repetitive texts can have very many maximal matches. Beyond ``MOST`` of them, each tile is found by a pass over the document that
keeps a number for each word of the item, so memory stays in proportion to the texts; the tiles are the same.

Items are taken in blocks of at most ``BLOCK`` characters, each sent to the tasks that read the documents; every
document is compared with every block. Where there are several, each one's result is written by itself. Documents aren't shuffled, and a
task holds one document's matches at a time.

Defined cases: words are runs of letters, digits and underscores, lower-cased; an item with fewer words than a seed
must occur as a whole; null and empty items match nothing and null and empty documents hold nothing; of equally long matches the
one earlier in the item, then in the document, is marked; null ids are kept; repeated items
and repeated documents are separate rows; empty tables give an empty result; input columns besides the id and the
text aren't read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import tidied
from tessera.llm.names import own_columns, unused
from tessera.llm.scratch import materialise

SEED, COVERED = 5, 0.8
#: Characters of items that a task holds at a time, and items that are read from the table at a time.
BLOCK = 8_000_000
#: Maximal matches of a document and an item that are held at a time.
MOST = 300_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
PAIRS = "doc_id long, item_id long, item_words int, covered int, coverage double, tiles int, longest int"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rolled(ids: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` ids."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * base + ids[k : k + n]
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of ``first`` to ``first + count``, one range after another."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class Items:
    """Items' words as numbers from 1, and where their runs stand."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.known: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            got = words(text)
            if got:
                self.items.append((item_id, np.array([self.known.setdefault(w, len(self.known) + 1) for w in got], dtype=np.uint64)))
        self.flat = np.concatenate([ids for _, ids in self.items]) if self.items else np.zeros(0, dtype=np.uint64)
        offset = np.cumsum([0] + [len(ids) for _, ids in self.items])
        self.runs: dict[int, tuple] = {}
        by_width: dict[int, list[int]] = {}
        for k, (_, ids) in enumerate(self.items):
            by_width.setdefault(min(seed, len(ids)), []).append(k)
        for width, found in by_width.items():
            item = np.concatenate([np.full(len(self.items[k][1]) - width + 1, k) for k in found])
            at = np.concatenate([np.arange(len(self.items[k][1]) - width + 1) for k in found])
            place = offset[item] + at
            base = _BASE
            while True:
                hashes = np.concatenate([rolled(self.items[k][1], width, base) for k in found])
                order = np.argsort(hashes, kind="stable")
                unique, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
                one = np.repeat(place[order][first], count)
                if all((self.flat[place[order] + d] == self.flat[one + d]).all() for d in range(width)):
                    break
                base += np.uint64(2)  # two runs have one hash
            self.runs[width] = (base, unique, first, count, item[order], at[order], place[order][first])

    def shared(self, ids: np.ndarray, covered: float) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
        """Each item whose shared runs cover enough of it, the width of runs, and each run's places in the document and in the item."""
        for width, (base, unique, first, count, item, at, place) in self.runs.items():
            hashes = rolled(ids, width, base)
            if not len(hashes):
                continue
            i = np.minimum(np.searchsorted(unique, hashes), len(unique) - 1)
            hit = np.flatnonzero(unique[i] == hashes)
            for d in range(width):
                hit = hit[ids[hit + d] == self.flat[place[i[hit]] + d]]
            if not len(hit):
                continue
            order = np.argsort(i[hit], kind="stable")
            run, start, n = np.unique(i[hit][order], return_index=True, return_counts=True)
            in_doc = hit[order]
            which = np.repeat(np.arange(len(run)), count[run])
            entry = _ranges(first[run], count[run])
            order = np.lexsort((at[entry], which, item[entry]))
            which, k, q = which[order], item[entry][order], at[entry][order]
            for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k)) + 1):
                n_item = len(self.items[int(k[part[0]])][1])
                seen = np.zeros(n_item + 1, dtype=np.int64)
                seen[: n_item - width + 1] = np.bincount(q[part], minlength=n_item - width + 1)
                seen[width:] -= np.bincount(q[part], minlength=n_item - width + 1)
                if (np.cumsum(seen[:-1]) > 0).sum() >= covered * n_item:
                    cuts = np.flatnonzero(np.diff(which[part])) + 1
                    yield int(k[part[0]]), width, [(in_doc[start[w[0]] : start[w[0]] + n[w[0]]], own) for w, own in zip(np.split(which[part], cuts), np.split(q[part], cuts))]


def _differing(runs: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of the places of each run whose neighbours differ; none if they are more than ``most``. Runs are places and neighbours, twice."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for p, beside_p, q, beside_q in runs:
        for word in np.unique(beside_p):
            a, b = p[beside_p == word], q[beside_q != word]
            held += len(a) * len(b)
            if held > most:
                return None
            out.append((np.repeat(a, len(b)), np.tile(b, len(a))))
    p, q = (np.concatenate([x[k] for x in out]) for k in (0, 1))
    order = np.lexsort((p, p - q))
    return p[order], q[order]


def maximal(ids: np.ndarray, own: np.ndarray, width: int, runs: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, ...] | None:
    """Places in the document and in the item, and lengths, of all maximal matches; none if they are more than ``most``."""
    # No neighbour at an end of either: numbers that no word has.
    doc = np.concatenate(([2**63], ids, [2**63])).astype(np.uint64)
    item = np.concatenate(([2**63 + 1], own, [2**63 + 1])).astype(np.uint64)
    starts = _differing([(p, doc[p], q, item[q]) for p, q in runs], most)
    if starts is None:
        return None
    ends = _differing([(p, doc[p + width + 1], q, item[q + width + 1]) for p, q in runs], most)
    # On each diagonal starts and ends take turns.
    return None if ends is None else (*starts, ends[0] - starts[0] + width)


def tile(p: np.ndarray, q: np.ndarray, length: np.ndarray, width: int, n_doc: int, n_item: int) -> list[tuple[int, int, int]]:
    """Tiles (place in document, place in item, length) among maximal matches, longest first."""
    heap = [(-n, b, a) for n, a, b in zip(length.tolist(), p.tolist(), q.tolist())]
    heapq.heapify(heap)
    in_item, in_doc, left, out = np.zeros(n_item, dtype=bool), np.zeros(n_doc, dtype=bool), n_item, []
    while heap and left >= width:
        n, b, a = heapq.heappop(heap)
        free = ~(in_doc[a : a - n] | in_item[b : b - n])
        if free.all():
            out.append((a, b, -n))
            in_doc[a : a - n] = in_item[b : b - n] = True
            left += n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False]))))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - start >= width:
                heapq.heappush(heap, (start - stop, b + start, a + start))
    return out


def tile_by_passes(ids: np.ndarray, own: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """The same tiles, each by a pass over the document with the lengths of the matches that end at each word of the item."""
    ids, own, out = ids.copy(), own.copy(), []
    while True:
        best, length = (0, 0, 0), np.zeros(len(own) + 1, dtype=np.int64)
        for a in np.flatnonzero(ids).tolist():
            if a == 0 or not ids[a - 1]:
                length[:] = 0
            length[1:] = np.where(own == ids[a], length[:-1] + 1, 0)
            n = int(length.max())
            if n >= max(width, -best[0]):
                b = int(length.argmax()) - n
                best = min(best, (-n, b, a + 1 - n))
        n, b, a = -best[0], best[1], best[2]
        if not n:
            return out
        out.append((a, b, n))
        # Marked words match nothing: numbers that no word has.
        ids[a : a + n], own[b : b + n] = 0, 2**63


def _matcher(block: Items, covered: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, names = block.known.get, [x.split()[0] for x in PAIRS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Words of no item are 0, and no item's run has a 0.
                ids = np.array([get(w, 0) for w in words(text.as_py())], dtype=np.uint64)
                for k, width, runs in block.shared(ids, covered):
                    item_id, own = block.items[k]
                    found = maximal(ids, own, width, runs, MOST)
                    tiles = tile_by_passes(ids, own, width) if found is None else tile(*found, width, len(ids), len(own))
                    n = sum(t[2] for t in tiles)
                    if n >= covered * len(own):
                        rows.append((doc_id, item_id, len(own), n, n / len(own), len(tiles), max(t[2] for t in tiles)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)

    return match


def blocks(items: DataFrame, seed: int, size: int = BLOCK) -> Iterator[Items]:
    """Items in blocks of at most ``size`` characters, or one item; the driver holds one at a time."""
    held, n = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").filter("text is not null").toLocalIterator():
        if held and n + len(row.text) > size:
            yield Items(held, seed)
            held, n = [], 0
        held.append((row.item_id, row.text))
        n += len(row.text)
    if held:
        yield Items(held, seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, covered: float = COVERED, size: int = BLOCK) -> DataFrame:
    """A row for each document and item of which it covers at least the share ``covered``; see ``PAIRS``."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rest = blocks(benchmark, seed, size)
    out = ids.mapInArrow(_matcher(next(rest, None) or Items([], seed), covered), PAIRS)
    for block in rest:
        out = out.union(materialise(ids.mapInArrow(_matcher(block, covered), PAIRS), "contaminated"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, covered: float = COVERED, size: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that cover no item to the share ``covered``, with their columns.

    Of a benchmark of one block, it is decided where a row is read; of several, the keys of what goes are written for each.
    """

    def masked(match, batch: pa.RecordBatch) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], names=["doc_id", "text"])
        mask = np.ones(batch.num_rows, dtype=bool)
        for found in match(iter([rows])):
            mask[found.column("doc_id").to_numpy()] = False
        return pa.array(mask)

    def clean(block: Items):
        match = _matcher(block, covered)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(masked(match, batch))

        return keep

    def dirty(block: Items):
        match = _matcher(block, covered)

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pc.invert(masked(match, batch))).select(["_hash"])

        return keys

    rest = blocks(benchmark, seed, size)
    first, second = next(rest, None), next(rest, None)
    if second is None:
        # All columns travel in one, so that no name matters.
        rows = docs.select("text", F.struct(*own_columns(docs)).alias("row"))
        return rows.mapInArrow(tidied(clean(first)), rows.schema).select("row.*") if first else docs
    keyed = docs.select("text", F.sha2("text", 256).alias("_hash"))
    gone = None
    for block in chain((first, second), rest):
        found = materialise(keyed.mapInArrow(dirty(block), "_hash string").distinct(), "contaminated")
        gone = found if gone is None else gone.union(found)
    key = unused(docs, "key")
    return docs.withColumn(key, F.sha2("text", 256)).join(gone.withColumnRenamed("_hash", key), key, "left_anti").select(*own_columns(docs))
