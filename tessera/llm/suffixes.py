"""Exact removal of repeated byte strings, by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.

Sorting every suffix would move every byte many times. So suffixes start at anchors only: in each string of ``LENGTH``
bytes, the ``GRAM``-byte sequence with the least hash. Equal strings have equal anchors, so every repeated string is
seen at an anchor, with what stands within reach before and behind it. Texts are written once in blocks of several documents.
Four steps follow.

1. Blocks send the distinct hashes of their anchors, sorted, with how often each occurs; ranges of hashes reply with a bit for
   each that other blocks have too, and one for each that occurs more than ``HOT`` times. Unique text, most of a corpus, ends here.
2. The other anchors' contexts (the sequence, what follows, then what precedes backwards) are made distinct in their
   block, with the smallest doc_id, sorted, front-coded (each entry keeps only what differs from the entry before) and
   exchanged.
3. A bucket combines its runs with a loser tree. Entries carry the length of the prefix that they share with the last
   winner, so known prefixes are never compared again. Neighbours that share the sequence form groups; in a group,
   each string around the anchor gets its smallest doc_id. The reply is a bit for each string of each context.
4. Blocks mark the bytes of repeated strings and drop them.

A sequence that is hot could have more contexts than a task should hold. Its strings don't go to a bucket: each
distinct string of a block is a row, and the smallest doc_id of each is found by an aggregate, which is combined before it is shuffled.

A context that an earlier document has is wholly repeated in all later ones, so copies, however many, are one entry for each block.
A task holds one block, or one range of hashes, or a bucket's runs; no row is gathered by document or passage. Ranges grow with the
bytes of the input. Hashes only choose what is compared: strings are equal if their bytes are.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows with equal ids do not
count as earlier than each other; null ids come last; an empty table gives an empty result; input columns besides
doc_id and text aren't read. A document is never split over blocks, so a task holds its longest one, at about thirty times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import forget, materialise
from tessera.llm.skew import even_keys, spread_join

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM
WIDE = GRAM + 2 * REACH + 2
#: Bytes of text in a block, about; for each range of hashes; buckets of contexts for each range.
BLOCK, RANGE, BUCKETS = 2_000_000, 32_000_000, 2
#: A sequence that occurs more often is hot.
HOT = 100_000
#: Bytes of replies that are broadcast to the tasks that read the blocks, at most.
BROADCAST = 32_000_000
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.iinfo(np.int64).max
BLOCKS = "block long, size long, ids binary, ends binary, body binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``BLOCK`` bytes of text: ids, ends and texts of several documents."""
    import zstandard

    part, nth, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0

    def taken() -> pa.RecordBatch:
        nonlocal ids, texts, held, nth
        raw = np.array(ids, dtype="<i8").tobytes()
        ends = np.cumsum([len(t) for t in texts]).astype("<i8").tobytes()
        row = [(part << 32) | nth, held, raw, ends, pack.compress(b"".join(texts))]
        ids, texts, held, nth = [], [], 0, nth + 1
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])], names=["block", "size", "ids", "ends", "body"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = text.as_py()
            ids.append(_LAST if doc_id is None else doc_id)
            texts.append(b"" if body is None else body.encode("utf-8", "surrogatepass"))
            held += len(texts[-1])
            if held >= BLOCK or len(ids) >= 20_000:
                yield taken()
    if ids:
        yield taken()


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Block, ids, ends and bytes of each row."""
    import zstandard

    for block, ids, ends, body in zip(*[batch.column(k).to_pylist() for k in ("block", "ids", "ends", "body")]):
        yield block, np.frombuffer(ids, "<i8"), np.frombuffer(ends, "<i8"), np.frombuffer(zstandard.decompress(body), np.uint8)


def anchors(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors, and the hashes of their sequences."""
    n = len(body) - GRAM + 1
    if n < REACH + 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def power(k: int) -> np.uint32:
        return np.uint32(pow(_BASE, k, 1 << 32))

    h = (body.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h = h[:-1] * power(1) + h[1:]
    four = h[:-2] * power(2) + h[2:]
    h = four[:-1] * power(1) + ((body[4:].astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1))
    h = h[:-5] * power(5) + h[5:]
    h = h[:-10] * power(10) + h[10:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    # Zero marks strings that don't count, so no hash is zero.
    h |= np.uint32(1)
    del four
    least, width = h, 1
    while 2 * width <= REACH + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < REACH + 1:
        least = np.minimum(least[: n - REACH], least[REACH + 1 - width :])
    # Strings that cross a document's end don't count.
    most = np.zeros(n + REACH, dtype=np.uint32)
    most[REACH : REACH + len(least)] = least
    for e in ends[:-1].tolist():
        most[REACH + max(0, e - LENGTH + 1) : REACH + e] = 0
    width = 1
    while 2 * width <= REACH + 1:
        most, width = np.maximum(most[:-width], most[width:]), 2 * width
    if width < REACH + 1:
        most = np.maximum(most[:n], most[REACH + 1 - width :])
    at = np.flatnonzero(most == h)
    text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(body, GRAM)[at]).view("<u4").reshape(len(at), GRAM // 4).astype(np.uint64)
    key = np.zeros(len(at), dtype=np.uint64)
    for k in range(GRAM // 4):
        key = (key ^ text[:, k]) * _MIX
        key ^= key >> np.uint64(29)
    return at, key


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _sorted_keys(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (range in the high bits, 32 bits of hash below), and each anchor's place among them."""
    return np.unique((_range(h, ranges) << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)


def _doc_of(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, at, "right")


def _sender(ranges: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, ends, body in _opened(batch):
                keys, where = _sorted_keys(anchors(body, ends)[1], ranges)
                times = np.minimum(np.bincount(where, minlength=len(keys)), 65_535).astype("<u2")
                edges = np.searchsorted(keys >> 32, np.arange(ranges + 1))
                low = (keys & 0xFFFFFFFF).astype("<u4")
                got = [(r, block, low[a:b].tobytes(), times[a:b].tobytes()) for r, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), [pa.int64()] * 2 + [pa.binary()] * 2)], names=["range", "block", "keys", "times"])

    return send


def _replier(hot: int):
    def reply(group: pd.DataFrame) -> pd.DataFrame:
        """For each block of a range of hashes, two bits for each of its keys: whether another block has it, and whether it is hot."""
        parts = [np.frombuffer(k, "<u4") for k in group["keys"]]
        times = np.concatenate([np.frombuffer(t, "<u2") for t in group["times"]]).astype(np.int64)
        _, where, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        total = np.bincount(where, weights=times)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        shared, often = np.split(count[where] > 1, cuts), np.split(total[where] > hot, cuts)
        return pd.DataFrame({"block": group["block"], "range": group["range"], "bits": [np.packbits(x).tobytes() for x in shared], "hot": [np.packbits(x).tobytes() if x.any() else b"" for x in often]})

    return reply


def _front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Shared prefix lengths, and the rest of each row."""
    shared = np.zeros(len(rows), dtype=np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), WIDE)
    return shared.tobytes(), rows[np.arange(WIDE)[None, :] >= shared[:, None]].tobytes()


def _name(rows: np.ndarray) -> np.ndarray:
    """A hash of each context."""
    return np.concatenate([(rows[a : a + 10_000].astype(np.uint64) * _WEIGHTS).sum(1, dtype=np.uint64) for a in range(0, len(rows), 10_000)])


def _decoded(shared: np.ndarray, rest: np.ndarray) -> np.ndarray:
    n = len(shared)
    out = np.zeros((n, WIDE), dtype=np.uint8)
    own = np.arange(WIDE)[None, :] >= shared[:, None]
    out[own] = rest
    rows = np.arange(n)
    for c in range(WIDE):
        out[:, c] = out[np.maximum.accumulate(np.where(own[:, c], rows, 0)), c]
    return out


def contexts(body: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sequence at each anchor, what follows, what precedes backwards, and how much of both lies in the document."""
    doc = _doc_of(at, ends)
    start, end = np.concatenate(([0], ends))[doc], ends[doc]
    left, right = np.minimum(at - start, REACH), np.minimum(end - at - GRAM, REACH)
    padded = np.concatenate((np.zeros(REACH, np.uint8), body, np.zeros(REACH, np.uint8)))
    out = np.zeros((len(at), WIDE), dtype=np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(padded, LENGTH + REACH)[at]
    out[:, : GRAM + REACH] = view[:, REACH:]
    out[:, GRAM : GRAM + REACH][np.arange(REACH)[None, :] >= right[:, None]] = 0
    out[:, GRAM + REACH : GRAM + 2 * REACH] = view[:, :REACH][:, ::-1]
    out[:, GRAM + REACH : GRAM + 2 * REACH][np.arange(REACH)[None, :] >= left[:, None]] = 0
    out[:, -2], out[:, -1] = left, right
    return out


_WEIGHTS = np.cumprod(np.full(WIDE, _BASE, dtype=np.uint64)) ^ np.uint64(0x5555555555555555)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct context, and which of them each is: by hash if no two contexts share one, else by their bytes."""
    _, first, same = np.unique(_name(rows), return_index=True, return_inverse=True)
    if any((rows[a : a + 10_000] != rows[first[same[a : a + 10_000]]]).any() for a in range(0, len(rows), 10_000)):
        _, first, same = np.unique(np.ascontiguousarray(rows).view(f"S{WIDE}").ravel(), return_index=True, return_inverse=True)
    return first, same


def _hot_strings(block: int, body: np.ndarray, ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each distinct string around the anchors ``at``: its smallest doc_id in the block, places, and how many are in later documents."""
    doc = _doc_of(at, ends)
    start = np.concatenate(([0], ends))[doc]
    begin = (at[:, None] - np.arange(REACH + 1)[None, :]).ravel()
    inside = (begin >= np.repeat(start, REACH + 1)) & (begin + LENGTH <= np.repeat(ends[doc], REACH + 1))
    begin = np.unique(begin[inside])
    if not len(begin):
        return
    text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(body, LENGTH)[begin]).view(f"S{LENGTH}").ravel()
    _, first, same = np.unique(text, return_index=True, return_inverse=True)
    own = ids[_doc_of(begin, ends)]
    least = np.full(len(first), _LAST, dtype=np.int64)
    np.minimum.at(least, same, own)
    later = np.bincount(same, weights=own > least[same], minlength=len(first)).astype(np.int64)
    order = np.argsort(same, kind="stable")
    cuts = np.searchsorted(same[order], np.arange(len(first) + 1))
    places = begin[order].astype("<u4")
    raw = [body[begin[k] : begin[k] + LENGTH].tobytes() for k in first.tolist()]
    for a in range(0, len(first), 20_000):
        n = len(raw[a : a + 20_000])
        none = pa.nulls(n, pa.binary())
        held = [places[i:j].tobytes() for i, j in zip(cuts[a : a + n].tolist(), cuts[a + 1 : a + n + 1].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(later[a : a + n]), none, pa.array(raw[a : a + n], pa.binary()), none, none, pa.array(held, pa.binary()), pa.array(least[a : a + n])], names=[x.split()[0] for x in RUNS.split(", ")])


def _runner(ranges: int, names: list[int]):
    """Front-coded sorted runs of a block's shared contexts, by bucket, and where each context stands; and its hot strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for (block, ids, ends, body), replies in zip(_opened(batch), batch.column("replies").to_pylist()):
                at, h = anchors(body, ends)
                keys, where = _sorted_keys(h, ranges)
                shared, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
                edges = np.searchsorted(keys >> 32, np.arange(ranges + 1))
                for reply in replies:
                    a, b = edges[reply["range"]], edges[reply["range"] + 1]
                    for bits, out in ((reply["bits"], shared), (reply["hot"], hot)):
                        if bits:
                            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
                doc = _doc_of(at, ends)
                # Also what several documents of this block share.
                order = np.lexsort((doc, where))
                again = np.flatnonzero((np.diff(where[order]) == 0) & (np.diff(doc[order]) != 0))
                shared[where[order][again]] = True
                if hot.any():
                    yield from _hot_strings(block, body, ids, ends, at[(shared & hot)[where]])
                keep = (shared & ~hot)[where]
                at, doc, bucket = at[keep], doc[keep], _range(h[keep], BUCKETS * ranges)
                if not len(at):
                    continue
                rows = contexts(body, ends, at)
                first, same = _distinct(rows)
                text = np.ascontiguousarray(rows[first]).view(f"S{WIDE}").ravel()
                rank = np.lexsort((text, bucket[first]))
                least = np.full(len(first), _LAST, dtype=np.int64)
                np.minimum.at(least, same, ids[doc])
                place = np.empty(len(rank), dtype=np.int64)
                place[rank] = np.arange(len(rank))
                # Occurrences in the order of their contexts.
                same = place[same]
                occurs = np.argsort(same, kind="stable")
                starts = np.searchsorted(same[occurs], np.arange(len(rank) + 1))
                sorted_rows, least, own = rows[first][rank], least[rank], bucket[first][rank]
                del rows, text
                cut = np.searchsorted(own, np.arange(BUCKETS * ranges + 1))
                out = []
                for r in range(BUCKETS * ranges):
                    a, b = cut[r], cut[r + 1]
                    if b > a:
                        lengths, rest = _front_coded(sorted_rows[a:b])
                        out.append((names[r], block, int(b - a), pack.compress(lengths), pack.compress(rest), pack.compress(least[a:b].astype("<i8").tobytes()), np.diff(starts[a : b + 1]).astype("<u4").tobytes(), at[occurs[starts[a] : starts[b]]].astype("<u4").tobytes(), None))
                kinds = [pa.int64()] * 3 + [pa.binary()] * 5 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in RUNS.split(", ")])

    return run


#: Rows of bucket -1 are hot strings: ``rest`` is the string, ``first`` its smallest doc_id in the block, ``n`` how often it is in later documents.
RUNS = "bucket long, block long, n long, shared binary, rest binary, least binary, counts binary, places binary, first long"


def loser_tree(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Run, place in it and length of the prefix shared with the entry before, for the entries of sorted runs in order.

    Each run has its entries and what each shares with the one before it. A waiting entry's shared length is that with the last
    winner, so of two entries the one that shares more is smaller, and bytes are compared only where they share
    equally much, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    entry: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    shares, at = [0] * k, [0] * k

    def beats(a: int, b: int) -> bool:
        x, y = entry[a], entry[b]
        if x is None or y is None:
            return y is None
        p, q = shares[a], shares[b]
        if p != q:
            return p > q
        i, j = int.from_bytes(x[p:]), int.from_bytes(y[p:])
        n = len(x) - ((i ^ j).bit_length() + 7) // 8
        if i <= j:
            shares[b] = n
            return True
        shares[a] = n
        return False

    losers, level = [0] * k, list(range(k))
    size = k
    while size > 1:  # the first round, from the leaves up
        above = []
        for m in range(0, size, 2):
            a, b = level[m], level[m + 1]
            win, lose = (a, b) if beats(a, b) else (b, a)
            losers[(size + m) // 2] = lose
            above.append(win)
        level, size = above, size // 2
    winner = level[0]
    while entry[winner] is not None:
        n = at[winner]
        yield winner, n, shares[winner]
        texts, common = runs[winner]
        n += 1
        at[winner] = n
        if n < len(texts):
            entry[winner], shares[winner] = texts[n], common[n]
        else:
            entry[winner] = None
        node = (winner + k) // 2
        while node:
            other = losers[node]
            if not beats(winner, other):
                losers[node], winner = winner, other
            node //= 2


def repeated(rows: np.ndarray, group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each context a bit for each string around its anchor (bit o: it starts o bytes before) that an earlier document has."""
    left, right = rows[:, -2].astype(int), rows[:, -1].astype(int)
    text = np.concatenate((rows[:, GRAM + REACH : GRAM + 2 * REACH][:, ::-1], rows[:, : GRAM + REACH]), axis=1)
    total = np.zeros((len(rows), text.shape[1] + 1), dtype=np.uint64)
    down = np.uint64(pow(_BASE, -1, 1 << 64))
    powers = np.cumprod(np.full(text.shape[1], down, dtype=np.uint64))
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=total[:, 1:])
    seed = group.astype(np.uint64) * _MIX
    out = np.zeros(len(rows), dtype=np.uint32)
    for o in range(REACH, -1, -1):
        a = REACH - o
        ok = np.flatnonzero((left >= o) & (right >= REACH - o))
        if len(ok):
            name = ((total[ok, a + LENGTH] - total[ok, a]) * np.uint64(pow(_BASE, a, 1 << 64))) ^ seed[ok]
            order = np.argsort(name, kind="stable")
            new = np.concatenate(([True], np.diff(name[order]) != 0))
            again = np.flatnonzero(~new)
            one, two = ok[order[again]], ok[order[again - 1]]
            if (group[one] != group[two]).any() or (text[one, a : a + LENGTH] != text[two, a : a + LENGTH]).any():
                # Different strings of one hash: sort the strings themselves.
                string = np.ascontiguousarray(text[ok, a : a + LENGTH]).view(f"S{LENGTH}").ravel()
                order = np.lexsort((string, group[ok]))
                new = np.concatenate(([True], (string[order][1:] != string[order][:-1]) | (np.diff(group[ok][order]) != 0)))
            smallest = np.minimum.reduceat(least[ok][order], np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = ok[order][smallest < least[ok][order]]
            out[hit] |= np.uint32(1 << o)
    return out


#: All bits of a context.
WHOLE = (1 << (REACH + 1)) - 1
#: Contexts whose strings are compared at a time, in whole groups.
TOGETHER = 20_000


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """Combine a bucket's runs and reply to each block with the bits of its contexts."""
    import zstandard

    def opened(column: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join([zstandard.decompress(x) for x in group[column]]), kind)

    n = group["n"].to_numpy()
    shared = opened("shared", np.uint8)
    rows = _decoded(shared, opened("rest", np.uint8))
    least = opened("least", "<i8")
    starts = [0, *np.cumsum(n).tolist()]
    raw = rows.tobytes()
    lengths = shared.tolist()
    runs = [([raw[i : i + WIDE] for i in range(WIDE * a, WIDE * b, WIDE)], lengths[a:b]) for a, b in zip(starts, starts[1:])]
    del raw
    bits = np.zeros(len(rows), dtype="<u4")
    order: list[int] = []
    common: list[int] = []

    def settle() -> None:
        at, same = np.array(order), np.array(common)
        same[0] = 0
        # Equal contexts are one, with the smallest doc_id of all; in later documents they are repeated as a whole.
        kind = np.cumsum(same < WIDE) - 1
        first = np.flatnonzero(np.concatenate(([True], np.diff(kind) != 0)))
        smallest = np.minimum.reduceat(least[at], first)
        name = np.cumsum(same < GRAM)[first]
        own = np.zeros(len(first), dtype=np.uint32)
        many = np.flatnonzero(np.bincount(name)[name] > 1)
        if len(many):
            own[many] = repeated(rows[at[first[many]]], name[many], smallest[many])
        bits[at] = np.where(least[at] > smallest[kind], np.uint32(WHOLE), own[kind])
        order.clear()
        common.clear()

    for r, k, length in loser_tree(runs):
        if length < GRAM and len(order) >= TOGETHER:
            settle()
        order.append(starts[r] + k)
        common.append(length)
    if order:
        settle()
    parts = np.split(bits, starts[1:-1])
    return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "bits": [p.tobytes() for p in parts]})


def _dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for batch in batches:
        for (_, ids, ends, body), replies in zip(_opened(batch), batch.column("replies").to_pylist()):
            change = np.zeros(len(body) + 1, dtype=np.int64)
            hot, replies = [r for r in replies or () if r["bits"] is None], [r for r in replies or () if r["bits"] is not None]
            joined = lambda rs, k, kind: np.frombuffer(b"".join([r[k] for r in rs]), kind)
            if hot:
                s = joined(hot, "places", "<u4").astype(np.int64)
                least = np.repeat([r["first"] for r in hot], [len(r["places"]) // 4 for r in hot])
                s = s[ids[_doc_of(s, ends)] > least]
                change += np.bincount(s, minlength=len(change)) - np.bincount(s + LENGTH, minlength=len(change))
            if replies:
                # All buckets of a block at once.
                bits, counts, places = joined(replies, "bits", "<u4"), joined(replies, "counts", "<u4"), joined(replies, "places", "<u4").astype(np.int64)
                first = np.frombuffer(b"".join([zstandard.decompress(r["least"]) for r in replies]), "<i8")
                own = np.repeat(np.arange(len(bits)), counts)
                doc = _doc_of(places, ends)
                start, end = np.concatenate(([0], ends))[doc], ends[doc]
                # In documents after the first of its block that has it, a context is repeated as a whole.
                mine = np.where(ids[doc] > first[own], np.uint32(WHOLE), bits[own])
                low, high = np.maximum(0, places + LENGTH - end), np.minimum(REACH, places - start)
                whole = mine == WHOLE
                ok = whole & (low <= high)
                change += np.bincount((places - high)[ok], minlength=len(change)) - np.bincount((places - low)[ok] + LENGTH, minlength=len(change))
                some = np.flatnonzero((mine > 0) & ~whole)
                for o in range(REACH + 1):
                    hit = some[(mine[some] >> np.uint32(o)) & 1 > 0]
                    s = places[hit] - o
                    s = s[(s >= start[hit]) & (s + LENGTH <= end[hit])]
                    change += np.bincount(s, minlength=len(change)) - np.bincount(s + LENGTH, minlength=len(change))
            gone = np.cumsum(change[:-1]) > 0
            rows, last = [], 0
            for doc_id, e in zip(ids.tolist(), ends.tolist()):
                own, text = gone[last:e], body[last:e]
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                rows.append((None if doc_id == _LAST else doc_id, e - last, int(own.sum()), spans, text[~own].tobytes() if spans else text.tobytes()))
                last = e
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, ranges: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of each row; ``hot``: see ``HOT``."""
    blocks = materialise(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_blocks, BLOCKS), "blocks")
    if ranges is None:
        size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    sent = blocks.mapInArrow(_sender(ranges), "range long, block long, keys binary, times binary")
    replies = sent.groupBy("range").applyInPandas(_replier(hot), "block long, range long, bits binary, hot binary")
    # A block's replies are as many as ranges at most.
    by_block = materialise(replies.groupBy("block").agg(F.collect_list(F.struct("range", "bits", "hot")).alias("replies")), "shared-anchors")
    size = by_block.agg(F.sum(F.aggregate("replies", F.lit(0).cast("long"), lambda a, r: a + F.octet_length(r["bits"]) + F.octet_length(r["hot"]) + 16))).first()[0] or 0
    few = F.broadcast(by_block) if size <= BROADCAST else by_block
    runs = materialise(blocks.join(few, "block").mapInArrow(_runner(ranges, even_keys(blocks.sparkSession, BUCKETS * ranges)), RUNS), "runs")
    cold = runs.filter("bucket >= 0")
    merged = cold.select("bucket", "block", "n", "shared", "rest", "least").groupBy("bucket").applyInPandas(_merged, "block long, bucket long, bits binary")
    answers = merged.join(cold.select("bucket", "block", "least", "counts", "places", "first"), ["bucket", "block"]).select("block", "bits", "least", "counts", "places", "first")
    strings = runs.filter("bucket < 0").select("block", F.col("rest").alias("string"), F.col("first").alias("own"), "n", "places")
    if not strings.isEmpty():
        least = materialise(strings.groupBy("string").agg(F.min("own").alias("first")), "hot-strings")
        hit = spread_join(strings, least, "string").filter("first < own or n > 0")
        none = F.lit(None).cast("binary")
        answers = answers.union(hit.select("block", none.alias("bits"), none.alias("least"), none.alias("counts"), "places", "first"))
    by_block = materialise(answers.groupBy("block").agg(F.collect_list(F.struct("bits", "least", "counts", "places", "first")).alias("replies")), "repeated")
    forget(runs)
    return blocks.join(by_block, "block", "left").mapInArrow(_dropped, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest_repeats(docs: DataFrame, ranges: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    return remove_repeats(docs, ranges, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
