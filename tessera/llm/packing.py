"""Hierarchical packing of documents into windows of several context sizes.

Each task tokenises its documents once and packs as it reads. A document first fills whole windows of the
longest size. What is left of it is routed to the shortest tier (256, 512, 1024 or 2048 ids) that holds it.
From time to time the waiting pieces are packed, long tiers first: a window of a tier takes one of its
pieces, then the longest whole pieces of shorter tiers that fit the gap, and for the last gap the front of a
piece that is cut there. So every window is exactly full. At the end of a task less than one window is
left; it is cut at powers of two. Windows are dealt to step groups of equal numbers of ids.

Only Arrow batches and at most ``waiting`` ids of waiting pieces are held at a time; no row leaves its task,
so nothing is shuffled. Window and group numbers hold the task's partition in their high bits.

Defined cases: null and empty texts are one piece with the end id; repeated rows are separate documents;
null ids are kept; an empty table gives an empty result; input columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.memory import tidied
from tessera.llm.tokens import Encoder, crc32

END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs the documents of one task; ``rows`` holds finished pieces."""

    def __init__(self, tiers: tuple[int, ...], waiting: int, step: int, first: int):
        self.tiers, self.longest, self.limit, self.step = sorted(tiers, reverse=True), max(tiers), waiting, step
        self.stacks: list[list[tuple]] = [[] for _ in range(self.longest + 1)]
        self.mask, self.held, self.window, self.group = 0, 0, first, first
        self.open: list[list[int]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids as little-endian unsigned 32-bit integers."""
        n, at = len(ids) // 4, 0
        while n - at >= self.longest:
            self._close([(doc_id, n, at, ids[4 * at : 4 * (at + self.longest)])])
            at += self.longest
        if at < n:
            self._wait((doc_id, n, at, ids[4 * at :]))
        if self.held >= self.limit:
            self.drain(False)

    def _wait(self, piece: tuple) -> None:
        n = len(piece[3]) // 4
        self.stacks[n].append(piece)
        self.mask |= 1 << n
        self.held += n

    def _take(self, n: int) -> tuple:
        piece = self.stacks[n].pop()
        if not self.stacks[n]:
            self.mask &= ~(1 << n)
        self.held -= n
        return piece

    def _close(self, pieces: list[tuple]) -> None:
        """Pieces become a window, and the window goes to the fullest step group that has room."""
        size = sum(len(p[3]) for p in pieces) // 4
        fits = [g for g in self.open if g[1] + size <= self.step]
        if not fits:
            self.open.append([self.group, 0])
            self.group += 1
        group = max(fits, key=lambda g: g[1]) if fits else self.open[-1]
        group[1] += size
        if group[1] >= self.step:
            self.open.remove(group)
        offset = 0
        for doc_id, total, start, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, crc32(ids), total, self.window, offset, size, group[0]))
            offset += n
        self.window += 1

    def drain(self, final: bool) -> None:
        """Pack what waits, long tiers first; short of a window's ids, keep it or, at the end, cut at powers of two."""
        low = 0
        for tier in self.tiers:
            low = tier // 2 if tier != self.tiers[-1] else 0
            while n := (self.mask & ((1 << (tier + 1)) - 1)).bit_length() - 1 if self.mask & ((1 << (tier + 1)) - 1) else 0:
                if n <= low:
                    break
                if self.held < tier:
                    break
                pieces, gap = [self._take(n)], tier - n
                while gap:
                    under = self.mask & ((1 << (gap + 1)) - 1)
                    if under:
                        m = under.bit_length() - 1
                        pieces.append(self._take(m))
                        gap -= m
                    else:  # the shortest of the longer pieces gives its front
                        doc_id, total, start, ids = self._take((self.mask & -self.mask).bit_length() - 1)
                        pieces.append((doc_id, total, start, ids[: 4 * gap]))
                        self._wait((doc_id, total, start + gap, ids[4 * gap :]))
                        gap = 0
                self._close(pieces)
        if final:
            rest = [self._take(n) for n in range(self.longest, 0, -1) for _ in range(len(self.stacks[n]))]
            left = sum(len(p[3]) for p in rest) // 4
            while left:
                size = gap = min(1 << (left.bit_length() - 1), self.longest)
                pieces = []
                while gap:
                    doc_id, total, start, ids = rest.pop()
                    n = min(gap, len(ids) // 4)
                    pieces.append((doc_id, total, start, ids[: 4 * n]))
                    if 4 * n < len(ids):
                        rest.append((doc_id, total, start + n, ids[4 * n :]))
                    gap -= n
                self._close(pieces)
                left -= size

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 9
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)


def pack_documents(docs: DataFrame, vocabulary: str, tiers: tuple[int, ...] = (256, 512, 1024, 2048), waiting: int = 4_000_000, step: int = 32_768) -> DataFrame:
    """A row for each piece of each document: see ``SCHEMA``. ``step``: ids in a step group."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.shared(vocabulary), np.array([END], dtype="<u4").tobytes()
        packer = Packer(tiers, waiting, step, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encoder.ids(text.as_py()) + end)
                if len(packer.rows) > 20_000:
                    yield packer.taken()
        encoder.forget()
        packer.drain(True)
        yield packer.taken()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidied(packed), SCHEMA)
