"""Chunks from ordered segments (C1-C8) and batches by a budget (I5, I6): folds whose state resets, one document at a time."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import words

CHUNKS = "doc string, chunk_id string, chunk_type string, text string, page int, page_method string, units string, section string, first_seq int, last_seq int"


def word_split(text: Column, n: int) -> Column:
    """Pieces of at most ``n`` words, joined by single spaces."""
    w = words(text)
    count = F.ceil(F.size(w) / n).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(w, i * n + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def token_estimate(text: Column, per_token: float = 3.5) -> Column:
    """Tokens from characters."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / per_token)).cast("int")


def windows(sizes: list[int], cuts: list[int], most: int, overlap: int, compat: bool = False) -> Iterator[tuple[int, int, int]]:
    """Half-open ranges of items in windows of at most ``most`` words, and how many cuts came before each.

    ``cuts`` says how many times a window must end before each item, and at the end (one more number than items). A window starts with the
    items before it that hold at most ``overlap`` words together. Windows of such items only are left out unless ``compat``.
    """
    total = list(accumulate(sizes, initial=0))
    first = fresh = 0
    for k, forced in enumerate(cuts):
        nth = 0
        while nth < forced or (nth == forced and k < len(sizes) and first < k and total[k + 1] - total[first] > most):
            if first < k and (fresh < k or compat):
                yield first, k, nth
            first, fresh, nth = max(first, bisect_left(total, total[k] - overlap, 0, k + 1)), k, nth + 1


def islands(sections: list[str], sizes: list[int], apart: list[bool], most: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of rows of one section, ``most`` words at most, none across a row that is ``apart`` from the one before."""
    first = held = 0
    for k, n in enumerate(sizes):
        if first < k and (apart[k] or sections[k] != sections[first] or held + n > most):
            yield first, k
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def fold(doc: str, rows: list[dict], window: int = 400, overlap: int = 50, budget: int = 800, compat: bool = False) -> list[tuple]:
    """The chunks of one document's segments in order.

    Prose goes into :func:`windows`, table rows into :func:`islands`; both are cut independently. A footnote stands alone, ends both and is
    split beyond ``window`` words. Longer prose is split too, after what waits. Ids count each type, and each part of split prose or rows; parts of a
    footnote share a number. Only rows that stand together are joined, under the name of their section.
    """
    out: list[tuple] = []

    def emit(kind: str, nth: int | str, parts: list[dict], text: str, section: str) -> None:
        units = next((p["units"] for p in parts if p["units"]), None)
        out.append((doc, f"{doc}::{kind}::{nth}", kind, text, parts[0]["page"], parts[0]["page_method"], units, section, parts[0]["seq"], parts[-1]["seq"]))

    def pieces(row: dict, size: int) -> list[str]:
        w = row["text"].split()
        return [" ".join(w[a : a + size]) for a in range(0, len(w), size)] or [""]

    sizes = [len(r["text"].split()) for r in rows]
    kinds = ["long" if r["kind"] == "prose" and n > window else r["kind"] for r, n in zip(rows, sizes)]

    # Prose: a cut where a footnote or long prose stands, and at the end.
    own = [k for k, kind in enumerate(kinds) if kind == "prose"]
    cuts, longs, at = [0] * (len(own) + 1), {}, 0
    for k, kind in enumerate(kinds):
        if kind == "prose":
            at += 1
        elif kind in ("footnote", "long"):
            if kind == "long":
                longs.setdefault(at, {}).setdefault(cuts[at], []).append(k)
            cuts[at] += 1
    cuts[-1] += 1
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for first, stop, nth in windows([sizes[k] for k in own], cuts, window, overlap, compat):
        found[stop, nth] = (first, stop)
    nth = 0
    for at in range(len(own) + 1):
        for cut in range(cuts[at] + 1):
            if (at, cut) in found:
                parts = [rows[k] for k in own[slice(*found[at, cut])]]
                emit("prose", nth, parts, " ".join(p["text"] for p in parts), parts[0]["section"])
                nth += 1
            for k in longs.get(at, {}).get(cut, ()):
                for text in pieces(rows[k], window):
                    emit("prose", nth, [rows[k]], text, rows[k]["section"])
                    nth += 1

    # Rows of tables: apart where prose or a footnote, or a row over the budget, stands between.
    own = [k for k, kind in enumerate(kinds) if kind == "table_row"]
    over = [sizes[k] > budget for k in own]
    apart = [i == 0 or own[i] != own[i - 1] + 1 or over[i] or over[i - 1] for i in range(len(own))]
    nth = 0
    for first, stop in islands([rows[k]["section"] for k in own], [sizes[k] for k in own], apart, budget):
        parts = [rows[k] for k in own[first:stop]]
        section = parts[0]["section"]
        label = "" if section == "other" else f"[{section.replace('_', ' ').title()}]\n"
        for text in pieces(parts[0], budget) if over[first] else [label + "\n".join(p["text"] for p in parts)]:
            emit("table_row", nth, parts, text, section)
            nth += 1

    for nth, k in enumerate(k for k, kind in enumerate(kinds) if kind == "footnote"):
        split = pieces(rows[k], window) if sizes[k] > window else [rows[k]["text"]]
        for part, text in enumerate(split):
            emit("footnote", f"{nth}_p{part}" if len(split) > 1 else nth, [rows[k]], text, rows[k]["section"])
    return out


def chunks(segments: DataFrame, **sizes: int) -> DataFrame:
    """Chunks of each document (C2-C8). Segments have doc, seq, sub, kind (prose, table_row, footnote), text, page, page_method, units, section.

    Documents are dealt to tasks and sorted; a task holds the segments of one document at a time.
    """
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = {"page": pa.int32(), "first_seq": pa.int32(), "last_seq": pa.int32()}
    columns = ["doc", "seq", "sub", "kind", "text", "page", "page_method", "units", "section"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=kinds.get(n, pa.string())) for c, n in zip(zip(*rows), names)], names=names)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        for part in batches:
            for row in part.to_pylist():
                if held and held[0]["doc"] != row["doc"]:
                    out += fold(held[0]["doc"], held, **sizes)
                    held = []
                    if len(out) >= 2_000:
                        yield batch(out)
                        out = []
                held.append(row)
        if held:
            out += fold(held[0]["doc"], held, **sizes)
        if out:
            yield batch(out)

    return segments.select(*columns).repartition("doc").sortWithinPartitions("doc", "seq", "sub").mapInArrow(folded, CHUNKS)


def budget_batches(texts: DataFrame, key: str, order: str, budget: int = 40_000) -> DataFrame:
    """key, order, batch: consecutive texts of at most ``budget`` estimated tokens together, a longer one alone."""
    rows = texts.select(key, order, token_estimate(F.col("text")).alias("n"))

    def batched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, batch, held = None, 0, 0
        for frame in frames:
            out = []
            for k, n in zip(frame[key], frame["n"]):
                if k != own:
                    own, batch, held = k, 0, 0
                elif held + n > budget:
                    batch, held = batch + 1, 0
                held += n
                out.append(batch)
            yield frame.assign(batch=out)

    schema = f"{key} {dict(rows.dtypes)[key]}, {order} {dict(rows.dtypes)[order]}, n int, batch int"
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(batched, schema)
