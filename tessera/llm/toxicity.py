"""Toxicity from two Kneser-Ney language models, one of toxic and one of ordinary texts.

The models predict the characters of words, each from up to four before it, so that counts stay dense and new
forms of a word are recognised. The highest order is counted for each class; what a class discounts goes, through that class's
back-off weight, to one lower-order distribution, made of the continuation counts of both classes. A sequence that neither
class has seen has the probability of the shared counts in both: the back-off weight of its context in both classes together times
the lower order's, and so on down. (With weights of their own, the class with fewer rows would find every new word likelier.)
Characters up to ``PLAIN`` are one unit, all others two, so no two are taken for each other.

A word has a log-likelihood in each class. A text has two features, both differences of the classes' log-likelihoods divided by length in
units: the highest over ``WINDOW`` words in a row, and that of the whole text. A logistic
curve turns them into a probability.

Counts are aggregated before they are shuffled, and all of them are kept. If they are at most ``GRAMS`` sequences, the model
is made on the driver and broadcast. Beyond, it stays a table: totals, continuation counts and ratios are made by aggregation
and joins, the sequences of the texts' distinct words are joined with it, and the words' scores with the texts. The logistic curve is fitted on
about ``CALIBRATION`` labelled rows of fold 3 at most, scored by a model of the counts of all other labelled training rows; the
model that scores is then made of the counts of all labelled training rows, those included. Labels are joined to texts by
broadcast if they are at most ``BROADCAST`` rows, else by shuffle.

Defined cases: null and empty texts have features of zero; several labels of a doc_id count as their maximum,
null labels as none; without labels of both classes every score is the share of toxic labels; null ids are not
held out; repeated rows are scored alike; words may be of any length; an empty table gives an empty result; input columns
besides doc_id and text aren't read, and :func:`drop_toxic` keeps them whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.llm.memory import tidied
from tessera.llm.names import own_columns
from tessera.llm.scratch import materialise

ORDER, BITS, DISCOUNT, WINDOW = 5, 12, 0.75, 6
GRAMS, CALIBRATION, BROADCAST = 1_000_000, 50_000, 2_000_000
#: A task counts and remembers so many words at a time, and words of so many characters; characters that are worked on at a time.
WORDS, REMEMBERED, TOGETHER = 100_000, 64, 2_000_000
_WORD = re.compile(r"[^\W_]+")
_FIRST, _LAST = 1, 2
#: Characters below this are their own unit. Others are two: one of 544 above it for the high bits, one of 2048 for the low eleven.
PLAIN = (1 << BITS) - 544 - 2048


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; 2 is held out."""
    return F.crc32(doc_id.cast("string")) % 4


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def units(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The units of all words one after another, and how many each word has."""
    lengths = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
    chars = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    wide = chars >= PLAIN
    if not wide.any():
        return chars, lengths
    word = np.repeat(np.arange(len(distinct)), lengths)
    out = np.repeat(np.where(wide, PLAIN + (chars >> 11), chars), 1 + wide)
    second = np.flatnonzero(wide) + np.arange(1, wide.sum() + 1)
    out[second] = PLAIN + 544 + (chars[wide] & 2047)
    return out, lengths + np.bincount(word, weights=wide, minlength=len(distinct)).astype(np.int64)


def grams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each position's sequence of up to ``ORDER`` units, packed, newest lowest; and the number of its word."""
    chars, lengths = units(distinct)
    ends = np.cumsum(lengths + 2)
    starts = ends - lengths - 2
    codes = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    inner = np.ones(len(codes), dtype=bool)
    inner[starts], inner[ends - 1] = False, False
    codes[inner], codes[starts], codes[ends - 1] = chars, _FIRST, _LAST
    word = np.repeat(np.arange(len(distinct)), lengths + 2)
    at = np.arange(len(codes)) - starts[word] if len(codes) else np.zeros(0, dtype=np.int64)
    keys = codes.copy()
    for k in range(1, ORDER):
        keys[k:] |= np.where(at[k:] >= k, codes[:-k], 0) << (BITS * k)
    predicted = at > 0
    return keys[predicted], word[predicted]


def _portions(all_words: list[str]) -> Iterator[list[str]]:
    """The words in lists of about ``TOGETHER`` characters."""
    part, held = [], 0
    for w in all_words:
        part.append(w)
        held += len(w)
        if held >= TOGETHER:
            yield part
            part, held = [], 0
    if part:
        yield part


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the sequences of a task's texts, by class, and of those by which the curve is fitted."""
    held = {(label, fitted): Counter() for label in (0, 1) for fitted in (False, True)}

    def taken() -> Iterator[pa.RecordBatch]:
        for (label, fitted), counts in held.items():
            for part in _portions(list(counts)):
                key, word = grams(part)
                n = np.fromiter(map(counts.__getitem__, part), dtype=np.int64, count=len(part))[word]
                unique, where = np.unique(key, return_inverse=True)
                n = np.bincount(where, weights=n, minlength=len(unique)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (unique, n * label, n * (1 - label), np.full(len(unique), fitted))], names=["gram", "toxic", "other", "fitted"])
            counts.clear()

    read = 0
    for batch in batches:
        for text, label, fitted in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = words(text.as_py())
            held[1 if label else 0, fitted].update(found)
            read += sum(map(len, found))
            if sum(map(len, held.values())) > WORDS or read > 8 * TOGETHER:
                yield from taken()
                read = 0
    yield from taken()


def _found(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``asked`` would stand among the sorted ``known``, and whether it does."""
    i = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return i, known[i] == asked


def _mask(k: int) -> int:
    return (1 << (BITS * k)) - 1


class Model:
    """Log probabilities of both classes for sequences, and the shared lower orders, made from packed counts."""

    def __init__(self, gram: np.ndarray, toxic: np.ndarray, other: np.ndarray):
        order = np.argsort(gram)
        self.gram, counts = gram[order], (toxic[order].astype(float), other[order].astype(float))
        #: For each lower order, longest last: its sequences and their probabilities, its contexts and their back-off weights.
        self.levels: list[tuple[np.ndarray, ...]] = []
        at, seen = self.gram, []
        for k in range(ORDER - 1, 0, -1):
            at, n = np.unique(at & _mask(k), return_counts=True)
            seen.append((at, n.astype(float)))
        at, n = seen.pop()
        self.floor = 1 / (n.sum() + len(at) + 1)
        self.levels.append((at, (n + 1) * self.floor))
        while seen:
            at, n = seen.pop()
            context, where = np.unique(at >> BITS, return_inverse=True)
            total, back = self._weights(n, where)
            rest = self.shared(at, len(self.levels))
            self.levels.append((at, (n - DISCOUNT) / total[where] + back[where] * rest, context, back))
        rest = self.shared(self.gram, ORDER - 1)
        self.context, where = np.unique(self.gram >> BITS, return_inverse=True)
        self.back = self._weights(counts[0] + counts[1], where)[1]
        logs = []
        for n in counts:
            total, back = self._weights(n, where)
            logs.append(np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[where] + back[where] * rest))
        self.toxic, self.other = logs

    @staticmethod
    def _weights(n: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each context's count, and its back-off weight: one if it wasn't seen."""
        total = np.bincount(where, weights=n)
        return total, np.where(total > 0, DISCOUNT * np.bincount(where, weights=n > 0) / np.maximum(total, 1), 1.0)

    def shared(self, key: np.ndarray, orders: int) -> np.ndarray:
        """The probability of each sequence's last unit by the lowest ``orders`` orders."""
        at, p = self.levels[0]
        i, has = _found(at, key & _mask(1))
        out = np.where(has, p[i], self.floor)
        for k in range(2, orders + 1):
            at, p, context, back = self.levels[k - 1]
            i, has = _found(at, key & _mask(k))
            j, after = _found(context, (key & _mask(k)) >> BITS)
            out = np.where(has, p[i], np.where(after, back[j], 1.0) * out)
        return out

    def scores(self, distinct: list[str]) -> np.ndarray:
        """A row for each word: its log-likelihoods, toxic and other, and its number of predicted units."""
        key, word = grams(distinct)
        if not len(key):
            return np.zeros((len(distinct), 3)) + (0, 0, 1)
        unique, where = np.unique(key, return_inverse=True)
        i, has = _found(self.gram, unique)
        j, after = _found(self.context, unique >> BITS)
        unseen = np.log(np.where(after, self.back[j], 1.0) * self.shared(unique, ORDER - 1))
        logs = [np.where(has, x[i], unseen)[where] for x in (self.toxic, self.other)]
        return np.column_stack([np.bincount(word, weights=w, minlength=len(distinct)) for w in (*logs, np.ones(len(word)))])


Tables = dict[str, DataFrame]


def _tables(counts: DataFrame) -> tuple[Tables, float]:
    """The arrays of :class:`Model` as tables (``at1`` to ``at4``, ``back2`` to ``back5``, ``top``), and its floor."""
    out: Tables = {}
    seen = counts.select(F.col("gram").alias("at"))
    for k in range(ORDER - 1, 0, -1):
        out[f"at{k}"] = seen = materialise(seen.groupBy(F.col("at").bitwiseAND(F.lit(_mask(k))).alias("at")).agg(F.count("*").cast("double").alias("n")), "continuations")
    size = seen.agg(F.sum("n").alias("n"), F.count("*").alias("k")).head()
    floor = 1 / (size.n + size.k + 1)
    out["at1"] = seen.select("at", ((F.col("n") + 1) * floor).alias("p"))
    weight = lambda kinds, total: F.when(F.col(total) > 0, DISCOUNT * F.col(kinds) / F.col(total)).otherwise(1.0)
    for k in range(2, ORDER):
        rows = out[f"at{k}"].withColumn("context", F.shiftright("at", BITS))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        lower = out[f"at{k - 1}"].select(F.col("at").alias("down"), F.col("p").alias("rest"))
        rows = rows.join(sums, "context").withColumn("down", F.col("at").bitwiseAND(F.lit(_mask(k - 1)))).join(lower, "down")
        out[f"at{k}"] = materialise(rows.select("at", ((F.col("n") - DISCOUNT) / F.col("total") + weight("kinds", "total") * F.col("rest")).alias("p")), "lower")
        out[f"back{k}"] = materialise(sums.select("context", weight("kinds", "total").alias("back")), "weights")
    both = counts.withColumn("both", F.col("toxic") + F.col("other")).withColumn("context", F.shiftright("gram", BITS))
    classes = ("toxic", "other", "both")
    sums = both.groupBy("context").agg(*[x for c in classes for x in (F.sum(c).alias(f"{c}_total"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))])
    lower = out[f"at{ORDER - 1}"].select(F.col("at").alias("down"), F.col("p").alias("rest"))
    rows = both.join(sums, "context").withColumn("down", F.col("gram").bitwiseAND(F.lit(_mask(ORDER - 1)))).join(lower, "down")
    p = lambda c: F.log(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"{c}_total"), F.lit(1)) + weight(f"{c}_kinds", f"{c}_total") * F.col("rest")).alias(c)
    out["top"] = materialise(rows.select("gram", p("toxic"), p("other")), "sequences")
    out[f"back{ORDER}"] = materialise(sums.select("context", weight("both_kinds", "both_total").alias("back")), "weights")
    return out, floor


def _by_tables(sequences: DataFrame, model: Tables, floor: float) -> DataFrame:
    """``gram``, toxic and other (log probabilities) of distinct sequences, as :meth:`Model.scores` finds them."""
    # Lowest order first: at most 2 ** BITS rows.
    rows = sequences.withColumn("at", F.col("gram").bitwiseAND(F.lit(_mask(1)))).join(F.broadcast(model["at1"]), "at", "left").select("gram", F.coalesce("p", F.lit(floor)).alias("rest"))
    for k in range(2, ORDER):
        at = F.col("gram").bitwiseAND(F.lit(_mask(k)))
        rows = rows.withColumn("at", at).withColumn("context", F.shiftright(at, BITS)).join(model[f"at{k}"], "at", "left").join(model[f"back{k}"], "context", "left")
        rows = rows.select("gram", F.coalesce("p", F.coalesce("back", F.lit(1.0)) * F.col("rest")).alias("rest"))
    rows = rows.withColumn("context", F.shiftright("gram", BITS)).join(model[f"back{ORDER}"], "context", "left").join(model["top"], "gram", "left")
    unseen = F.log(F.coalesce("back", F.lit(1.0)) * F.col("rest"))
    return rows.select("gram", F.coalesce("toxic", unseen).alias("toxic"), F.coalesce("other", unseen).alias("other"))


#: Features of a text: see :func:`_features`.
FEATURES = ("_peak", "_mean", "_toxic", "_other")


def _features(known: list[dict[str, tuple]], texts: list[list[str]]) -> np.ndarray:
    """A row for each list of words: the peak and mean difference of log-likelihoods, and both log-likelihoods, by length."""
    out = np.zeros((len(texts), 4))
    for k, (t, scores) in enumerate(zip(texts, known)):
        if t:
            each = np.array([scores[w] for w in t])
            total = np.vstack((np.zeros((1, 3)), np.cumsum(each, axis=0)))
            n = min(WINDOW, len(t))
            part = total[n:] - total[:-n]
            toxic, other, length = total[-1]
            out[k] = ((part[:, 0] - part[:, 1]) / part[:, 2]).max(), (toxic - other) / length, toxic / length, other / length
    return out


def _cached(model: Model, cache: dict[str, tuple], texts: list[list[str]]) -> np.ndarray:
    new = list({w for t in texts for w in t if w not in cache})
    if len(cache) + len(new) > WORDS:
        cache.clear()
        new = list({w for t in texts for w in t})
    for part in _portions(new):
        cache.update(zip(part, map(tuple, model.scores(part).tolist())))
    out = _features([cache] * len(texts), texts)
    for w in new:
        if len(w) > REMEMBERED:
            del cache[w]
    return out


def _by_model(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                x = _cached(model, cache, [words(t.as_py()) for t in part.column(0)])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(c) for c in x.T]], names=names)

    return run


def _by_scores(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [words(t.as_py()) for t in part.column(0)]
                seen = [{x["word"]: (x["toxic"], x["other"], x["n"]) for x in s or ()} for s in part.column(1).to_pylist()]
                x = _features(seen, texts)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *[pa.array(c) for c in x.T]], names=names)

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's key with each of its distinct words."""
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            rows = [(key, w) for text, key in zip(part.column(0), part.column(1).to_pylist()) for w in set(words(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["_hash", "word"])


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with each of its sequences."""
    for batch in batches:
        for part in _portions(batch.column(0).to_pylist()):
            key, word = grams(part)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()).take(pa.array(word)), pa.array(key)], names=["word", "gram"])


def _featured(model, source: DataFrame) -> DataFrame:
    """``source`` (texts as ``_text``, then other columns) with ``FEATURES`` instead of _text; ``model`` is broadcast or :func:`_tables`."""
    rest = [c for c in source.columns if c != "_text"]
    schema = StructType([source.schema[c] for c in rest])
    for name in FEATURES:
        schema = schema.add(name, DoubleType())
    if not isinstance(model, tuple):
        return source.select("_text", *rest).mapInArrow(tidied(_by_model(model, schema.names)), schema)
    keyed = source.withColumn("_hash", F.md5(F.coalesce("_text", F.lit(""))))
    pairs = keyed.select("_text", "_hash").mapInArrow(_words_of, "_hash string, word string")
    sequences = materialise(pairs.select("word").distinct().mapInArrow(_grams_of, "word string, gram long"), "words")
    logs = _by_tables(sequences.select("gram").distinct(), *model)
    sums = [F.sum(c).alias(c) for c in ("toxic", "other")]
    scores = materialise(sequences.join(logs, "gram").groupBy("word").agg(*sums, F.count("*").cast("double").alias("n")), "scores")
    of_text = pairs.join(scores, "word").groupBy("_hash").agg(F.collect_set(F.struct("word", "toxic", "other", "n")).alias("_scores"))
    return keyed.join(of_text, "_hash", "left").select("_text", "_scores", *rest).mapInArrow(_by_scores(schema.names), schema)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset by Newton's method, with a weak pull to zero."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _model(counts: DataFrame):
    """A broadcast model if the sequences are at most ``GRAMS``, else tables; none without toxic ones."""
    size = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).head()
    if not size.toxic:
        return None
    if size.n > GRAMS:
        return _tables(counts)
    held = counts.toPandas()
    return counts.sparkSession.sparkContext.broadcast(Model(held["gram"].to_numpy(), held["toxic"].to_numpy(), held["other"].to_numpy()))


def _scorer(docs: DataFrame, labels: DataFrame) -> float | tuple:
    """The share of toxic labels if nothing can be learnt, else the model and the weights of the features."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")).withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 2")
    known = materialise(known, "labels")
    stats = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k"), F.count_if(F.col("fold") == 3).alias("curve")).head()
    if stats.k in (0, stats.n):
        return stats.k / max(stats.n, 1)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Drawn by hash, so that no task has to sort the rows.
    share = min(1.0, CALIBRATION / max(stats.curve, 1))
    fitted = (F.col("fold") == 3) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    marked = known.select("doc_id", "toxic", fitted.alias("fitted"))
    train = ids.join(F.broadcast(marked) if stats.n <= BROADCAST else marked, "doc_id").select("text", "toxic", "fitted")
    rest = lambda c: F.sum(F.when(F.col("fitted"), 0).otherwise(F.col(c))).alias(f"{c}_rest")
    counts = train.mapInArrow(tidied(_counter), "gram long, toxic long, other long, fitted boolean").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), rest("toxic"), rest("other"))
    counts = materialise(counts, "sequences")
    trial = _model(counts.filter("toxic_rest + other_rest > 0").select("gram", F.col("toxic_rest").alias("toxic"), F.col("other_rest").alias("other")))
    if trial is None:
        return stats.k / stats.n
    some = marked.filter("fitted").select("doc_id", "toxic")
    rows = ids.join(F.broadcast(some), "doc_id").select(F.col("text").alias("_text"), "toxic")
    seen = _featured(trial, rows).toPandas()
    if not isinstance(trial, tuple):
        trial.unpersist()
    if seen["toxic"].nunique() < 2:
        return stats.k / stats.n
    return _model(counts.select("gram", "toxic", "other")), _logistic(seen[["_peak", "_mean"]].to_numpy(), seen["toxic"].to_numpy(float))


def _scored(docs: DataFrame, labels: DataFrame, source: DataFrame, threshold: float) -> DataFrame:
    """``source`` (texts as ``_text``, then other columns) with _score, _predicted and both log-likelihoods instead of _text."""
    found = _scorer(docs, labels)
    rest = [c for c in source.columns if c != "_text"]
    if not isinstance(found, tuple):
        none = [F.lit(0.0).alias(c) for c in FEATURES[2:]]
        return source.select(*rest, F.lit(float(found)).alias("_score"), F.lit(int(found >= threshold)).alias("_predicted"), *none)
    model, w = found
    peak, mean, offset = (float(x) for x in w)
    z = F.col("_peak") * peak + F.col("_mean") * mean + offset
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    scored = _featured(model, source).withColumn("_score", score)
    return scored.select(*rest, "_score", (F.col("_score") >= threshold).cast("int").alias("_predicted"), *FEATURES[2:])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the length-normalised log-likelihoods toxic_ll and other_ll of each row of ``docs``.

    ``labels`` has doc_id and toxic.
    """
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    source = docs.select(F.col("text").alias("_text"), F.col("doc_id").cast("long").alias("doc_id"), held)
    out = _scored(docs, labels, source, threshold)
    return out.select("doc_id", "held_out", F.col("_score").alias("score"), F.col("_predicted").alias("predicted"), F.col("_toxic").alias("toxic_ll"), F.col("_other").alias("other_ll"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    # All columns travel in one, so that none can clash.
    source = docs.select(F.col("text").alias("_text"), F.struct(*own_columns(docs)).alias("_row"))
    return _scored(docs, labels, source, threshold).filter("_predicted = 0").select("_row.*")
