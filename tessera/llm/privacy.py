"""Personal data and the terms that reveal it [native].

Four kinds are found by their form: e-mail and IP addresses, card and telephone numbers. The patterns say the
same as the contract's and take time in proportion to the text: a match can start only where a run of its
characters starts, and repetitions don't give back.

Terms reveal protected data by co-occurrence, with a kind or with one protected value (an entity: the digits or the
lower-cased text of a hit). An occurrence is a word in a document. A term's disclosure is the pointwise mutual information between
"this word" and "the kind (or value) within ``near`` words", over all occurrences: log2 of P(near | term) over
P(near | any occurrence). As a document has far more words than stand near a value, a kind that is in every document
can be disclosed too. A term that stands near it in the share ``share`` or more of all documents that have the term, whose
disclosure is at least ``bits``, and that does so in two documents or more with ``evidence`` bits against chance, is generalised wherever
it stands. The evidence is the documents with the term times the divergence of the share from P(near | any occurrence), which bounds
the chance of so many (Chernoff) by 2 ** -``evidence``: a rare term counts if it is exclusive. Base spans stay. The thresholds are
arguments (:class:`Disclosure`).

Words near values come from documents with values; how many documents have a word is counted over all. Disclosing
terms and the documents that have them are broadcast if they are at most ``BROADCAST`` bytes, else they are joined by
shuffle. Texts are read where they lie. Spans of a text are put together in runs of ``RUN``, so that a text full of matches takes
hardly more time for each.

Defined cases: a null text is empty; repeated rows are found alike; null ids are kept; an empty table gives an empty
result; the kinds are matched independently and may overlap; input columns besides doc_id and text aren't read, and
:func:`sanitise` keeps them whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.names import own_columns
from tessera.llm.scratch import materialise

KINDS = ("email", "ip", "card", "phone", "term")
_NAME = "[A-Za-z0-9._%+-]"
#: A name starts where no character of a name stands before it, or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?:[0-9][ -]?){15,18}[0-9](?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for its kind's pattern to be tried.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
BROADCAST, RUN = 16_000_000, 512
_FOUND = "array<struct<kind:int,start:int,end:int,hit:string>>"
_SPAN = "array<struct<kind:int,start:int,end:int>>"
_WORD = r"\p{L}{3,40}"


class Disclosure(NamedTuple):
    """What makes a term disclosing: see the module."""

    near: int = 3
    #: Characters on each side of a span in which words are looked for.
    reach: int = 100
    share: float = 0.8
    bits: float = 2.0
    evidence: float = 16.0


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _folded(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The last state of a fold over ``items`` whose state has ``at`` and ``out``, an array that grows: in runs, each added as a whole."""

    def runs(held: Column) -> Column:
        def run(a: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(held, i * RUN + 1, F.lit(RUN)), F.struct(a["at"].alias("at"), F.slice(a["out"], 1, 0).alias("out")), step)
            return _bound(part, lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], x["out"]).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / RUN).cast("int")), start, run)

    return _bound(items, runs)


def _spans(text: Column, found: Column, pattern: Column, kind: int) -> Column:
    """Spans of ``found``, the matches of ``pattern`` in order: what stands between them is the text split by it."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    none = F.array().cast(_FOUND)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("hit")))).alias("out"))

    spans = _folded(F.arrays_zip(between.alias("p"), found.alias("m")), F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(F.size(found) > 0, spans).otherwise(none)


def _slim(spans: Column) -> Column:
    """Spans without their hits."""
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = F.reverse(_digits(hit))

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _small(part: Column) -> Column:
    rest = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(rest) <= 3) & (F.substring(rest, 1, 3).cast("int") <= 255)


_VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["hit"], r"\."), _small),
    "card": lambda s: _luhn(s["hit"]),
    "phone": lambda s: F.length(_digits(s["hit"])).between(8, 15),
}


def _is(kind: int):
    return lambda s: s["kind"] == kind


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: kind (place in ``KINDS``), start, end (code points, end exclusive) and hit, in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_text", text)
    for k, pattern in PATTERNS.items():
        found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        none = F.array().cast("array<string>")
        out = out.withColumn(f"_{k}", F.when(F.contains("_text", F.lit(HINTS[k])), found).otherwise(none) if k in HINTS else found)
    kinds = [F.filter(_spans(F.col("_text"), F.col(f"_{k}"), F.lit(p), i), _VALID[k]) for i, (k, p) in enumerate(PATTERNS.items())]
    return out.withColumn("spans", F.concat(*kinds)).drop(*[f"_{k}" for k in PATTERNS])


def _near(text: Column, spans: Column, n: int, reach: int) -> Column:
    """Distinct (kind, value, term) of the ``n`` words next to each span on both sides; value is the hash of the entity."""

    def words(s: Column) -> Column:
        before = F.regexp_extract_all(F.lower(F.substring(text, F.greatest(s["start"] - reach, F.lit(0)) + 1, F.least(s["start"], F.lit(reach)))), F.lit(_WORD), F.lit(0))
        after = F.regexp_extract_all(F.lower(F.substring(text, s["end"] + 1, F.lit(reach))), F.lit(_WORD), F.lit(0))
        last = F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), F.lit(n))
        value = F.xxhash64(F.when(s["kind"] >= 2, _digits(s["hit"])).otherwise(F.lower(s["hit"])))
        return F.transform(F.concat(last, F.slice(after, F.lit(1), F.lit(n))), lambda w: F.struct(s["kind"].alias("kind"), value.alias("value"), w.alias("term")))

    return F.array_distinct(F.flatten(F.transform(spans, words)))


def _sized(df: DataFrame, size: Column) -> DataFrame:
    """A written table, broadcast only if its rows, each of ``size`` bytes, are small together."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).head()[0] or 0) <= BROADCAST else df


def annotate(docs: DataFrame, limits: Disclosure = Disclosure()) -> tuple[DataFrame, DataFrame]:
    """Two written tables by (doc_id, ``_key``: the text's hash): base spans of each row; term spans of each text that has any."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", F.xxhash64("text"))
    based = base_spans(ids)
    near = F.when(F.size("spans") > 0, _near(F.col("_text"), F.col("spans"), limits.near, limits.reach))
    based = materialise(based.select("doc_id", "_key", _slim(F.col("spans")).alias("spans"), near.alias("near")), "spans")
    # The value of a kind as a whole is null. A document counts once for each.
    of_kind = F.array_distinct(F.transform("near", lambda x: F.struct(x["kind"].alias("kind"), F.lit(None).cast("long").alias("value"), x["term"].alias("term"))))
    joint = materialise(based.filter(F.size("near") > 0).select(F.inline(F.concat(of_kind, "near"))).groupBy("term", "kind", "value").agg(F.count("*").alias("joint")), "joint")
    near = joint.groupBy("kind", "value").agg(F.sum("joint").alias("near"))
    words = ids.select("doc_id", "_key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("term"))
    # Counts are made in each task before they are shuffled.
    df = materialise(words.groupBy("term").agg(F.count("*").alias("df")), "df")
    occurrences = df.agg(F.sum("df")).head()[0] or 0
    near = near.select(F.col("kind").alias("_kind"), F.col("value").alias("_value"), (F.col("near") / F.lit(float(max(occurrences, 1)))).alias("any"))
    # A part of a word at the edge of ``reach`` is counted near only, so a share is held to one.
    several = joint.filter("joint >= 2")
    # Of a term's kinds and values with equal counts, the one that is least often near decides: a common term has few rows.
    rated = several.join(near, (several["kind"] == near["_kind"]) & several["value"].eqNullSafe(near["_value"]))
    rated = rated.groupBy("term", "joint").agg(F.min("any").alias("any")).join(df, "term")
    share = F.least(F.col("joint") / F.col("df"), F.lit(1.0))
    other = F.when(share < 1, (1 - share) * F.log2((1 - share) / F.greatest(1 - F.col("any"), F.lit(1e-12)))).otherwise(0.0)
    lift = F.log2(share / F.col("any"))
    disclosing = rated.filter((share >= limits.share) & (lift >= limits.bits) & (F.col("df") * (share * lift + other) >= limits.evidence))
    disclosing = materialise(disclosing.select("term").distinct(), "disclosing")
    hits = words.join(_sized(disclosing, F.octet_length("term") + 16), "term")
    by_text = materialise(hits.groupBy("doc_id", "_key").agg(F.sort_array(F.collect_set("term")).alias("terms")), "by_text")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    keyed = ids.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_hash"), "text")
    few = _sized(by_text, F.octet_length(F.array_join("terms", "|")) + 32)
    located = keyed.join(few, keyed["_id"].eqNullSafe(few["doc_id"]) & (keyed["_hash"] == few["_key"])).select("doc_id", "_key", "text", pattern.alias("_p"))
    located = located.withColumn("_m", F.regexp_extract_all("text", F.col("_p"), F.lit(0)))
    terms = located.select("doc_id", "_key", _slim(_spans(F.col("text"), F.col("_m"), F.col("_p"), KINDS.index("term"))).alias("terms"))
    # Repeated rows have equal keys and equal spans.
    return based.select("doc_id", "_key", "spans"), materialise(terms.dropDuplicates(["doc_id", "_key"]), "terms")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _with_terms(base: DataFrame, terms: DataFrame) -> DataFrame:
    few = _sized(terms.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_hash"), "terms"), 32 + 24 * F.size("terms"))
    joined = base.join(few, base["doc_id"].eqNullSafe(few["_id"]) & (base["_key"] == few["_hash"]), "left")
    return joined.withColumn("terms", F.coalesce("terms", F.array().cast(_SPAN))).drop("_id", "_hash")


def find_personal_data(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each row."""
    base, terms = annotate(docs, limits)
    n = [F.size(F.filter("spans", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return _with_terms(base, terms).select("doc_id", *n, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(F.concat("spans", "terms")).alias("spans"))


def sanitise(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with base values replaced by their kind and disclosing terms by [TERM]; n_chars, if there, is counted again."""
    base, terms = annotate(docs, limits)
    placed = F.sort_array(F.transform(F.concat("spans", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = _with_terms(base, terms).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_hash"), placed.alias("_spans"))
    spans = materialise(spans.filter(F.size("_spans") > 0).dropDuplicates(["_id", "_hash"]), "replaced")
    # All columns travel in one, so that none can clash.
    rows = docs.select(F.struct(*own_columns(docs)).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.col("text").alias("_text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    few = _sized(spans, 32 + 24 * F.size("_spans"))
    joined = rows.join(few, rows["_doc"].eqNullSafe(few["_id"]) & (rows["_key"] == few["_hash"]), "left")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(text: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            piece = F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(tags, s["kind"] + 1))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

        last = _folded(F.col("_spans"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
        return _bound(last, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))

    out = joined.withColumn("_new", F.when(F.col("_spans").isNotNull(), replaced(F.col("_text"))).otherwise(F.col("_text")))
    names = [c.lower() for c in docs.columns]
    values = []
    for c in docs.columns:
        value = F.col("_row").getField(c)
        if c.lower() == "text":
            value = F.col("_new")
        elif c.lower() == "n_chars" and names.count("n_chars") == 1:
            value = F.when(F.col("_spans").isNotNull(), F.length("_new").cast(docs.schema[c].dataType)).otherwise(value)
        values.append(value.alias(c))
    return out.select(*values)
