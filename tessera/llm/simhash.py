"""SimHash near-duplicates, found exactly by vantage-point trees.

A text's fingerprint has a bit set if more than half of its shingles' XXH64 values have it set. Equal
fingerprints become one node. Two fingerprints at ``distance`` or fewer differing bits are linked.

The 64 bits are cut into bands. If two fingerprints differ in at most 4 bits, then in one of three bands they
differ in at most 1, so three trees of that small radius together lose no pair, where a tree over all
bits and radius 4 would visit most of itself. Within a band, a tree splits fingerprints by their
Hamming distance to a vantage point: at most ``mu`` inside, else outside. By the triangle bound, a fingerprint
can have neighbours beyond the split only if its distance is within the radius of ``mu``; such ones also visit the
other side. The upper levels are chosen on a bounded sample of fingerprints, drawn by hash, which decides only how
even the shards are; their leaves are the shards. Each shard goes on splitting its own fingerprints the same way. In a leaf,
fingerprints are sorted by their bits of the band, those within the radius are looked up, and compared over all 64 bits;
small leaves are compared directly. A shard with too many fingerprints, such as a
large group of near copies, is cut into blocks, and each pair of blocks is a task.

A task returns a spanning forest of its links, so results stay as many as fingerprints. Components are
joined over all links by :mod:`tessera.llm.components`. Nothing but the sample and counts of shards
reaches the driver.

Near copies of the pipeline (``drop_near_duplicates``) are decided by the Jaccard similarity of the texts' sets of
distinct shingles; fingerprints only find candidates. A node is a set. Candidate links join nodes to coarse groups,
so each set goes to one group instead of to each band; within a group all pairs of sets are compared exactly, except
those that are joined already, and components are made of exact links only. Small groups share tasks; a group of more
than ``SETS`` sets is cut into blocks, and each pair of blocks is a task.

Defined cases: words are runs without ASCII white space, ASCII letters are lower-cased; a text with fewer
words than a shingle has one shingle of all; null, empty and blank texts have fingerprint zero, linked like any
other; repeated rows share their fingerprint; an empty table gives an empty result; input columns besides
doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.components import components
from tessera.llm.memory import tidied, tidy
from tessera.llm.names import own_columns, unused
from tessera.llm.scratch import materialise
from tessera.llm.skew import spread_join

SEED = 42
#: Fingerprints in a shard, about; most in a block of a task; in a leaf that isn't split.
SHARD, BLOCK, LEAF = 16_384, 65_536, 8_192
#: Pairs that are looked at together.
PAIRS = 1 << 18
#: Most fingerprints on which the upper levels are chosen.
SAMPLE = 262_144


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of a text's shingles of ``width`` words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A 64-bit integer with the bits that are set in over half of ``hashes``."""
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 65_536):
        part = hashes[a : a + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of a text's shingles of ``width`` words as an unsigned 64-bit integer."""
    return majority(shingle_hashes(text, width))


#: Constants that make further independent hashes of a shingle's hash.
_FURTHER = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _rehash(h: np.ndarray, k: int) -> np.ndarray:
    x = (h ^ np.uint64(k)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprints(docs: DataFrame, width: int, wide: bool = False) -> DataFrame:
    """doc_id, text_key, node, fp and further 64-bit words w1 to w3 of each row, all signed.

    Unless ``wide``, the further words are zero, repeated shingles count and the node is the fingerprint. With ``wide``, shingles
    are distinct and the node is the hash of their set.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 5), dtype=np.uint64)
            for k, text in enumerate(batch.column(2)):
                h = shingle_hashes(text.as_py(), width)
                if wide:
                    h = np.unique(h)
                out[k, 0] = out[k, 4] = majority(h)
                if wide:
                    out[k, 4] = xxh64_intdigest(h.tobytes(), SEED)
                    if len(h):
                        out[k, 1:4] = [majority(_rehash(h, c)) for c in _FURTHER]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(5)]], names=["doc_id", "text_key", "fp", "w1", "w2", "w3", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text").mapInArrow(tidied(hashed), "doc_id long, text_key long, fp long, w1 long, w2 long, w3 long, node long")


WORDS = ("fp", "w1", "w2", "w3")
Band = tuple[str, np.uint64, int]


def bands(distance: int) -> list[Band]:
    """Column, mask and radius of nearly equal bands of ``fp``."""
    n = 3 if distance >= 2 else distance + 1
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [("fp", np.uint64(sum(1 << b for b in range(lo, hi))), distance // n) for lo, hi in zip(edges, edges[1:])]


#: Bits of a band and how many bands there are; a band of ``b`` bits serves up to 2 ** (b + 2) nodes. The numbers keep the share of pairs at a
#: similarity of 0.8 (15 % of the bits differ) that no band holds below 1e-4, were bands independent.
WIDE = {16: 32, 20: 48, 24: 84, 28: 144, 32: 252}


def wide_bands(n: int) -> list[Band]:
    """Bands of radius 1 over all four words for ``n`` nodes: a word is cut into runs of bits, then runs of its bits in other orders."""
    bits = next((b for b in WIDE if n <= 1 << (b + 2)), max(WIDE))
    out: list[Band] = []
    for nth in range(WIDE[bits] // (4 * (64 // bits)) + 1):
        order = np.arange(64) if nth == 0 else np.random.default_rng(nth).permutation(64)
        cuts = [sum(1 << int(k) for k in order[a : a + bits]) for a in range(0, 64 - bits + 1, bits)]
        out += [(w, np.uint64(cut), 1) for w in WORDS for cut in cuts]
    return out[: WIDE[bits]]


def _far(x: np.ndarray, v: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ v) & mask)


def _split(x: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage point and ``mu`` that leave the smaller work among a few, and the distances; none if nothing is gained."""
    best, cost = None, 0.95 * len(x)
    for k in np.linspace(0, len(x) - 1, 5).astype(int).tolist():
        d = _far(x, x[k], mask)
        below = np.cumsum(np.bincount(d, minlength=66))
        for mu in range(64):
            inside, outside = below[mu], below[-1] - below[mu]
            if inside and outside:
                visits = (below[mu] - (below[mu - radius] if mu >= radius else 0)) + (below[min(mu + radius, 65)] - below[mu]) if radius else 0
                if (c := max(inside, outside) + visits) < cost:
                    best, cost = (x[k], mu, d), c
    return best


class Tree:
    """The upper levels over one band: arrays of vantage points, ``mu`` and children; a negative child is a leaf."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, radius: int, leaves: int):
        self.mask, self.radius, self.nodes, self.leaves = mask, radius, [], 0
        self.root = self._grow(sample, max(1, len(sample) // max(1, leaves)))

    def _grow(self, x: np.ndarray, least: int) -> int:
        found = _split(x, self.mask, self.radius) if len(x) > least else None
        if found is None:
            self.leaves += 1
            return -self.leaves
        v, mu, d = found
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (v, mu, self._grow(x[d <= mu], least), self._grow(x[d > mu], least))
        return at

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each leaf with the indexes that live there and those that visit it."""
        todo = [(self.root, np.arange(len(x)), np.arange(0))]
        while todo:
            at, home, visit = todo.pop()
            if at < 0:
                yield -at - 1, home, visit
                continue
            v, mu, inner, outer = self.nodes[at]
            d, e, r = _far(x[home], v, self.mask), _far(x[visit], v, self.mask), self.radius
            # One of each pair that is split here visits: the inner one.
            todo.append((inner, home[d <= mu], visit[e <= mu + r]))
            todo.append((outer, home[d > mu], np.concatenate((home[(d <= mu) & (d.astype(int) > mu - r)], visit[e.astype(int) > mu - r]))))


class Forest:
    """Union-find over the fingerprints of a task."""

    def __init__(self, n: int, wide: np.ndarray | None = None, most: int = 0):
        self.label, self.wide, self.most = np.arange(n), wide, most
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link indexes pairwise; remember only links that join components."""
        label = self.label
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        while len(a):
            i, j = int(a[0]), int(b[0])
            self.links.append((i, j))
            old, new = label[j], label[i]
            label[label == old] = new
            differ = label[a] != label[b]
            a, b = a[differ], b[differ]


def _flips(mask: np.uint64, radius: int) -> list[np.uint64]:
    """All ways to change at most ``radius`` bits of ``mask``."""
    bits = [1 << k for k in range(64) if int(mask) >> k & 1]
    return [np.uint64(sum(c)) for r in range(radius + 1) for c in combinations(bits, r)]


def _dense(x: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within ``distance``, all being compared, some at a time."""
    for a in range(0, len(left), 512):
        i = left[a : a + 512]
        for b in range(0, len(right), 4096):
            j = right[b : b + 4096]
            p, q = np.nonzero(np.bitwise_count(x[i][:, None] ^ x[j][None, :]) <= distance)
            yield i[p], j[q]


def _banded(x: np.ndarray, left: np.ndarray, right: np.ndarray, mask: np.uint64, flips: list[np.uint64], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within ``distance`` that differ in at most the band's radius: equal values after each flip, looked up among the sorted values."""

    def valued(idx: np.ndarray) -> tuple[np.ndarray, ...]:
        v = x[idx] & mask
        order = np.argsort(v, kind="stable")
        return idx[order], *np.unique(v[order], return_index=True, return_counts=True)

    same = left is right
    p, u, first, n = valued(left)
    q, v, at, m = (p, u, first, n) if same else valued(right)
    for flip in flips:
        other = u ^ flip
        found = np.minimum(np.searchsorted(v, other), len(v) - 1)
        # Of a pair of the same set, one order is enough.
        hit = np.flatnonzero((v[found] == other) & (u <= other) if same else v[found] == other)
        partner = found[hit]
        # A left value's indexes are cut so that none of its parts has much more than ``PAIRS`` pairs.
        step = np.maximum(PAIRS // m[partner], 1)
        parts = -(-n[hit] // step)
        which = np.repeat(np.arange(len(hit)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        a, b = first[hit][which] + nth * step[which], at[partner][which]
        na, nb = np.minimum(step[which], n[hit][which] - nth * step[which]), m[partner][which]
        size = na * nb
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            row = np.repeat(np.arange(lo, hi), size[lo:hi])
            k = np.arange(len(row)) - (ends[row] - size[row] - (ends[lo - 1] if lo else 0))
            i, j = p[a[row] + k // nb[row]], q[b[row] + k % nb[row]]
            near = np.bitwise_count(x[i] ^ x[j]) <= distance
            yield i[near], j[near]
            lo = hi


def _compare(x: np.ndarray, left: np.ndarray, right: np.ndarray, mask: np.uint64, flips: list[np.uint64], distance: int, forest: Forest) -> None:
    """Link the band's pairs within ``distance`` and, with further words, within ``forest.most`` bits of all."""
    if not len(left) or not len(right):
        return
    small = len(left) * len(right) <= 64 * len(flips) * (len(left) + len(right))
    for p, q in _dense(x, left, right, distance) if small else _banded(x, left, right, mask, flips, distance):
        if forest.wide is not None:
            open_ = forest.label[p] != forest.label[q]
            p, q = p[open_], q[open_]
            near = np.bitwise_count(x[p] ^ x[q]) + np.bitwise_count(forest.wide[p] ^ forest.wide[q]).sum(1) <= forest.most
            p, q = p[near], q[near]
        forest.join(p, q)


def _local(x: np.ndarray, home: np.ndarray, visit: np.ndarray, mask: np.uint64, radius: int, distance: int, forest: Forest) -> None:
    """Links between ``home`` and itself and ``visit``, splitting down to leaves while that gains."""
    todo, flips = [(home, visit)], _flips(mask, radius)
    while todo:
        home, visit = todo.pop()
        if not len(home):
            continue
        found = _split(x[home], mask, radius) if len(home) > LEAF else None
        if found is None:
            _compare(x, home, home, mask, flips, distance, forest)
            _compare(x, home, visit, mask, flips, distance, forest)
            continue
        v, mu, d = found
        d, e = d.astype(int), _far(x[visit], v, mask).astype(int)
        todo.append((home[d <= mu], visit[e <= mu + radius]))
        todo.append((home[d > mu], np.concatenate((home[(d <= mu) & (d > mu - radius)], visit[e > mu - radius]))))


def _linker(masks: list[Band], distance: int, most: int | None):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        column, mask, radius = masks[int(group["task"].iat[0]) >> 52]
        x, role = group[column].to_numpy(np.int64).view(np.uint64), group["role"].to_numpy()
        wide = None if most is None else np.column_stack([group[w].to_numpy(np.int64).view(np.uint64) for w in WORDS if w != column])
        forest = Forest(len(x), wide, most or 0)
        left, right = np.flatnonzero(role & 1), np.flatnonzero(role == 2)
        _local(x, left, right, mask, radius, distance, forest)
        node, pairs = group["node"].to_numpy(np.int64), np.array(forest.links, dtype=np.int64).reshape(-1, 2)
        tidy()
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return links


def link_fingerprints(fps: DataFrame, distance: int, most: int | None = None, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct nodes that join all pairs within ``distance``: one row for each link of spanning forests.

    With ``most``, pairs are found in bands of all four words instead; they are linked if they differ in at most ``distance`` bits
    of the band's word and ``most`` of all.
    """
    n = fps.count()
    leaves = max(1, -(-n // shard))
    masks = bands(distance) if most is None else wide_bands(n)
    columns = [m[0] for m in masks]
    carried = ["fp", "node"] if most is None else [*WORDS, "node"]
    fps = fps.select(*carried)
    share = min(1.0, min(SAMPLE, max(1024, 64 * leaves)) / max(n, 1))
    drawn = fps.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(*carried).toPandas()
    trees = [Tree(np.sort(drawn[c].to_numpy(np.int64)).view(np.uint64), mask, radius, leaves) for c, mask, radius in masks]

    def words(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(c).to_numpy().view(np.uint64) for c in columns]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, leaf, len(home), len(visit)) for k, (tree, x) in enumerate(zip(trees, words(batch))) for leaf, home, visit in tree.route(x)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["band", "leaf", "home", "visit"]).astype("int64"))

    sizes = fps.select(*carried).mapInArrow(counted, "band long, leaf long, home long, visit long").groupBy("band", "leaf").agg(F.sum("home").alias("home"), F.sum("visit").alias("visit"))
    # At most as many rows as leaves, whose number the sample bounds.
    blocks = {(r.band, r.leaf): (-(-r.home // block), -(-(r.home + r.visit) // block)) for r in sizes.filter(F.col("home") + F.col("visit") > block).collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mix = (batch.column("node").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            tasks, who, roles = [], [], []

            def put(task: np.ndarray, idx: np.ndarray, role: int) -> None:
                tasks.append(task)
                who.append(idx)
                roles.append(np.full(len(idx), role, dtype=np.int32))

            for k, (tree, x) in enumerate(zip(trees, words(batch))):
                for leaf, home, visit in tree.route(x):
                    base, cut = (k << 52) | (leaf << 32), blocks.get((k, leaf))
                    if cut is None:
                        put(np.full(len(home), base), home, 1)
                        put(np.full(len(visit), base), visit, 2)
                        continue
                    rows, parts = cut
                    both = np.concatenate((home, visit))
                    for i in range(rows):
                        put(base | (i << 16) | (mix[both] % np.uint64(parts)).astype(np.int64), both, 2)
                    for j in range(parts):
                        put(base | ((mix[home] % np.uint64(rows)).astype(np.int64) << 16) | j, home, 1)
            idx = np.concatenate(who)
            rest = [c.take(pa.array(idx)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tasks).astype(np.int64)), pa.array(np.concatenate(roles)), *rest], names=["task", "role", *carried])

    schema = "task long, role int, " + ", ".join(f"{c} long" for c in carried)
    return fps.select(*carried).mapInArrow(tidied(dealt), schema).groupBy("task").applyInPandas(_linker(masks, distance, most), "a long, b long")


def _named(known: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``known`` with the ``root`` of each row's node over ``links``; ``nodes`` are the distinct nodes."""
    joined = components(links).withColumnRenamed("node", "_node")
    named = nodes.join(joined, nodes["node"] == joined["_node"], "left").select("node", F.coalesce("root", "node").alias("root"))
    return materialise(spread_join(known, materialise(named, "roots"), "node"), "named")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) of each row."""
    known = materialise(fingerprints(docs, width).select("doc_id", "fp", "node"), "fingerprints")
    nodes = materialise(known.groupBy("node").agg(F.first("fp").alias("fp")), "representatives")
    named = _named(known, link_fingerprints(nodes, distance, None, shard, block), nodes.select("node"))
    least = materialise(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return spread_join(named, least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Candidates differ in at most so many bits of a band's word and of all 256. For a similarity of 0.8 of sets of shingles
#: about 39 of 256 bits differ with a deviation of 6, and up to 48 in sets of a few shingles.
NEAR_WORD, NEAR_ALL = 24, 64
SIMILAR = 0.8
#: Sets in a task of exact comparison, about, and in a block of a large group.
SETS = 1024
#: Keys of dropped rows (16 bytes each) that are broadcast, at most.
FEW = 500_000


def _alike(sets: list[np.ndarray], root: np.ndarray, role: np.ndarray, similar: float) -> Forest:
    """Links between the sets of a root at ``similar`` or more: of role 1 with role 2, of role 3 with each other."""
    forest = Forest(len(sets))
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    order = np.lexsort((np.arange(len(root)), root))
    for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        if len(own) < 2:
            continue
        _, ids = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True)
        n, starts = size[own], np.concatenate(([0], np.cumsum(size[own])))
        marked = np.zeros(len(ids) + 1, dtype=bool)
        for k, i in enumerate(own):
            if role[i] == 2 or not n[k]:
                continue
            open_ = (n > 0) & (n >= similar * n[k] - 1e-9) & (n * similar <= n[k] + 1e-9) & (forest.label[own] != forest.label[i])
            open_ &= (role[own] == 2) if role[i] == 1 else (np.arange(len(own)) > k)
            j = np.flatnonzero(open_)
            if not len(j):
                continue
            mine = ids[starts[k] : starts[k + 1]]
            marked[mine] = True
            a, some = 0, 4
            while a < len(j):
                # A hit joins whole components, so few are looked at first, and what they have joined is passed over.
                part, a, some = j[a : a + some], a + some, min(256, 4 * some)
                part = part[forest.label[own[part]] != forest.label[i]]
                if not len(part):
                    continue
                each = n[part]
                first = np.concatenate(([0], np.cumsum(each)[:-1]))
                at = np.repeat(starts[part] - first, each) + np.arange(each.sum())
                shared = np.add.reduceat(marked[ids[at]].astype(np.int64), first)
                hit = own[part[shared >= similar * (each + n[k] - shared) - 1e-9]]
                forest.join(np.full(len(hit), i), hit)
            marked[mine] = False
    return forest


def _exact_links(docs: DataFrame, known: DataFrame, coarse: DataFrame, width: int, similar: float, sets: int) -> DataFrame:
    """Links (a, b) that join all pairs of nodes of a coarse group (node, root) whose sets are at ``similar`` or more."""
    sizes = materialise(coarse.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    tasks = max(1, -(-(sizes.filter(F.col("n") <= sets).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]) // sets))
    # Roots of groups over ``sets``: at most a share of 1 / ``sets`` of the nodes.
    large = sizes.filter(F.col("n") > sets).select(F.col("root").alias("_root"), F.ceil(F.col("n") / sets).cast("int").alias("parts"))
    dealt = coarse.join(large, coarse["root"] == large["_root"], "left")
    slot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(slot, o).alias("i"), F.greatest(slot, o).alias("j"), F.when(slot == o, 3).when(slot < o, 1).otherwise(2).alias("role")))
    one = F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(tasks)).cast("int").alias("i"), F.lit(-1).alias("j"), F.lit(3).alias("role")))
    # One row of each node's copies lends its text.
    lent = known.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k")).join(coarse, "node", "left_semi").select("node", F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key.alias("text_key"), "text")
    held = texts.join(lent, texts["doc_id"].eqNullSafe(lent["_id"]) & (texts["text_key"] == lent["_key"])).select("node", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "shingles"])

    # Repeated rows of a lent text give one set.
    of_node = materialise(held.dropDuplicates(["node"]).mapInArrow(tidied(hashed), "node long, shingles binary"), "sets")
    spread = dealt.select("node", "root", F.inline(F.when(F.col("parts").isNull(), one).otherwise(pairs)))
    # Groups in one task share no root with a block of a large one.
    grouped = of_node.join(spread, "node").withColumn("task", F.when(F.col("j") < 0, F.xxhash64("i")).otherwise(F.xxhash64("root", "i", "j")))

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
        pairs = np.array(_alike(held, group["root"].to_numpy(), group["role"].to_numpy(), similar).links, dtype=np.int64).reshape(-1, 2)
        node = group["node"].to_numpy(np.int64)
        tidy()
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return grouped.select("task", "root", "role", "node", "shingles").groupBy("task").applyInPandas(linked, "a long, b long")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similar: float = SIMILAR, shard: int = 4 * SHARD, block: int = 4 * BLOCK, sets: int = SETS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id, then hash of the text.

    Texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least ``similar``, which may
    not be much below the default: candidates are found for it. Texts without words are one group. Rows with equal ids and
    texts count as one document, of which one row stays.
    """
    known = materialise(fingerprints(docs, width, wide=True), "fingerprints")
    nodes = materialise(known.groupBy("node").agg(*[F.first(c).alias(c) for c in WORDS]), "representatives")
    coarse = materialise(components(link_fingerprints(nodes, NEAR_WORD, NEAR_ALL, shard, block)), "coarse")
    keys = known.select("doc_id", "text_key", "node")
    named = _named(keys, _exact_links(docs, known, coarse, width, similar, sets), nodes.select("node"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k")
    kept = materialise(named.groupBy("root").agg(least, F.count("*").alias("n")).filter("n > 1").select("root", "k", "n"), "kept")
    others = spread_join(named, kept, "root")
    same = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_key") == F.col("k.text_key"))
    gone = materialise(others.filter(~same).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "gone")
    again = others.filter(same).groupBy("root").agg(F.count("*").alias("copies")).filter("copies > 1")
    key = unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    few = F.broadcast(gone) if gone.count() <= FEW else gone
    out = keyed.join(few, keyed["doc_id"].cast("long").eqNullSafe(few["_id"]) & (keyed[key] == few["_key"]), "left_anti")
    return (out if again.isEmpty() else out.dropDuplicates(["doc_id", key])).select(*own_columns(docs))
