"""Analytics of a filing: tone, red flags, contradictions, history, conviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def occurrences(text: Column, vocabulary: list[str]) -> Column:
    """Non-overlapping substrings, for each entry of a vocabulary."""
    low = F.lower(text)
    return sum((((F.length(low) - F.length(F.replace(low, F.lit(v), F.lit("")))) / len(v)).cast("int") for v in vocabulary), F.lit(0))


def tone(text: Column, confident: list[str], hedging: list[str]) -> Column:
    """0 to 100, 50 for short texts: difference of the vocabularies for a thousand words, which are runs of letters, digits and underscores (K1)."""
    n = F.greatest(F.lit(1), F.size(tokens(text)))
    score = 50 + 2 * (occurrences(text, confident) * 1000.0 / n - occurrences(text, hedging) * 1000.0 / n)
    return F.when(F.length(F.coalesce(text, F.lit(""))) < 50, 50).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int"))))


def discussion(segments: DataFrame, keywords: list[str], most: int = 20_000, separator: str = " ") -> DataFrame:
    """doc, text: from the first segment with a keyword on, joined segments that aren't tables until they exceed ``most`` characters (K2).

    The segment that crosses the length is the last. ``is_table`` may be absent.
    """
    w = Window.partitionBy("doc").orderBy("seq")
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.lower("text"), F.lit(k))
    begun = segments.withColumn("begun", F.max(hit.cast("int")).over(w)).filter("begun = 1")
    begun = begun.filter(~F.col("is_table")) if "is_table" in segments.columns else begun
    # The length of what is joined already, its separators included.
    before = F.coalesce(F.sum(F.length("text") + len(separator)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = begun.withColumn("before", before).filter(F.col("before") - len(separator) <= most)
    return kept.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), separator).alias("text"))


def growth(now: str, before: str) -> Column:
    return (F.col(now) - F.col(before)) / F.abs(F.nullif(F.col(before), F.lit(0.0)))


def red_flags(metrics: DataFrame, key: str) -> DataFrame:
    """key, rule, severity of each of twelve rules that fires; missing inputs skip a rule (K3). Absent columns count as missing."""
    need = ["ar", "revenue", "goodwill", "assets", "net_income", "ocf", "related_party", "risk_factors", "inventory", "cogs", "dso"]
    doubles = [x for n in need for x in (n, f"{n}_prior")]
    flags = ["auditor_changed", "going_concern", "revenue_recognition_changed", "non_gaap_reconciled"]
    m = metrics.select(key, *[(F.col(c).cast("double") if c in metrics.columns else F.lit(None).cast("double")).alias(c) for c in doubles], *[(F.col(c) if c in metrics.columns else F.lit(None)).cast("boolean").alias(c) for c in flags], *[(F.col(c) if c in metrics.columns else F.lit(None)).cast("int").alias(c) for c in ("segments", "segments_prior")])
    nonzero = (F.col("ar") != 0) & (F.col("ar_prior") != 0) & (F.col("revenue") != 0) & (F.col("revenue_prior") != 0)
    rules = [
        ("receivables", "medium", nonzero & (growth("ar", "ar_prior") > growth("revenue", "revenue_prior") + 0.05)),
        ("auditor", "high", F.col("auditor_changed")),
        ("going_concern", "critical", F.col("going_concern")),
        ("related_party", "medium", growth("related_party", "related_party_prior") > 0.25),
        ("goodwill", "medium", F.col("goodwill") / F.nullif("assets", F.lit(0.0)) > 0.4),
        ("cash_conversion", "high", (F.col("net_income") > 0) & (F.col("ocf") < 0)),
        ("revenue_recognition", "medium", F.col("revenue_recognition_changed")),
        ("segments", "low", F.col("segments") != F.col("segments_prior")),
        ("non_gaap", "low", ~F.col("non_gaap_reconciled")),
        ("risk_factors", "low", growth("risk_factors", "risk_factors_prior") > 0.15),
        ("inventory", "medium", growth("inventory", "inventory_prior") > growth("cogs", "cogs_prior") + 0.1),
        ("dso", "medium", F.col("dso") > 1.15 * F.col("dso_prior")),
    ]
    fired = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, c in rules]))
    return m.select(key, F.inline(fired))


def section(text: Column, keywords: dict[str, list[str]], other: str = "other") -> Column:
    """The first section, in order, one of whose keywords a text holds (K4)."""
    out = None
    for name, words_ in keywords.items():
        hit = F.lit(False)
        for k in words_:
            hit = hit | F.contains(F.lower(text), F.lit(k))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def section_texts(segments: DataFrame, keywords: dict[str, list[str]], other: str = "other") -> DataFrame:
    """doc, section, text: the segments of each section in order, joined (K4)."""
    named = segments.select("doc", "seq", "text", section(F.col("text"), keywords, other).alias("section"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")
    return named.groupBy("doc", "section").agg(joined.alias("text"))


def profile(docs: DataFrame, tones: DataFrame, flags: DataFrame, conflicts: DataFrame, outliers: DataFrame, ocf: DataFrame, key: str = "doc") -> DataFrame:
    """All analytics of each document (K10): key, status, tone, n_flags, n_contradictions, n_anomalies, score, label.

    ``flags``, ``conflicts`` and ``outliers`` have key and severity, ``tones`` tone, ``ocf`` ocf_ratio; what is missing counts as none, 50 or 1.0.
    """
    count = lambda s: F.count_if(F.col("severity") == s)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias(f"n_{name}"), *[count(s).alias(f"{name}_{s}") for s in ("critical", "high", "medium")])

    out = docs.select(key).distinct().join(tones.select(key, "tone"), key, "left").join(ocf.select(key, "ocf_ratio"), key, "left")
    for rows, name in ((flags, "flags"), (conflicts, "contradictions"), (outliers, "anomalies")):
        out = out.join(counted(rows, name), key, "left")
    out = out.fillna(0, [c for c in out.columns if c.startswith(("n_", "flags_", "contradictions_", "anomalies_"))]).fillna({"tone": 50, "ocf_ratio": 1.0})
    of = lambda name: tuple(F.col(f"{name}_{s}") for s in ("critical", "high", "medium"))
    score = conviction(F.col("ocf_ratio"), F.col("tone"), of("contradictions"), of("flags"))
    return out.withColumn("score", score).select(key, F.lit("complete").alias("status"), "tone", "n_flags", "n_contradictions", "n_anomalies", "score", conviction_label(F.col("score")).alias("label"))


def value_near(text: Column, patterns: list[str], reach: int = 100) -> Column:
    """The first number within ``reach`` characters of the first match of a pattern, times its scale word (K5).

    Patterns are tried in order; one without a match, without a number near, or with one that can't be read gives way to the next. Null if
    none is left.
    """
    # Words are ASCII: Java's \b also stands beside accented letters, and its \s holds a vertical tab.
    edge = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
    found = rf"(?i){edge}(\$?[\t\n\f\r ]*[0-9,]+(?:\.[0-9]+)?)[\t\n\f\r ]*(million|billion|thousand)?{edge}"

    def by(pattern: str) -> Column:
        at = F.regexp_instr(text, F.lit(f"(?i){pattern}"))
        hit = F.regexp_extract(text, f"(?i)({pattern})", 1)
        start = F.greatest(F.lit(1), at - reach)
        window = F.substring(text, start, at + F.length(hit) + reach - start)
        number = F.trim(F.translate(F.regexp_extract(window, found, 1), ",$", "")).try_cast("double")
        scale = F.lower(F.regexp_extract(window, found, 2))
        return F.when(at > 0, number * F.when(scale == "thousand", 1e3).when(scale == "million", 1e6).when(scale == "billion", 1e9).otherwise(1.0))

    return F.coalesce(*[by(p) for p in patterns])


def rounded(value: Column, digits: int) -> Column:
    """Halves of the scaled double go up; ``round`` would take halves of its shortest decimal form."""
    return F.round(value * 10.0**digits) / 10.0**digits


def sums_in_order(rows: DataFrame, key: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """key and the sums of doubles, each added row by row in ``order``: partial sums of a split input end in other last bits, which decide halves of cents."""
    own = Window.partitionBy(*key).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select(*key, *[F.sum(c).over(upto).alias(c) for c in sums], F.lead(F.lit(True)).over(own).alias("_more"))
    return running.filter(F.col("_more").isNull()).drop("_more")


def contradictions(values: DataFrame, key: list[str], least: float = 0.005, high: float = 0.02) -> DataFrame:
    """Pairs of sections that state different values (K6). ``values`` has key, section, ord, value; sections of a key are few."""
    positive = values.filter("value > 0")
    a, b = positive.alias("a"), positive.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("a.ord") < F.col("b.ord")]
    gap = F.abs(F.col("a.value") - F.col("b.value")) / F.greatest("a.value", "b.value")
    pairs = a.join(b, on).withColumn("gap", gap).filter(F.col("gap") > least)
    return pairs.select(*[F.col(f"a.{k}") for k in key], F.col("a.section").alias("section_a"), F.col("b.section").alias("section_b"), rounded(F.col("gap") * 100, 2).alias("pct"), F.when(F.col("gap") > high, "high").otherwise("medium").alias("severity"))


def metric_range(history: DataFrame, key: list[str]) -> DataFrame:
    """Smallest, largest and mean value of metrics with two observations or more (K7)."""
    return history.groupBy(*key).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count("*").alias("n")).filter("n >= 2")


def anomalies(current: DataFrame, ranges: DataFrame, key: list[str], band: float = 0.1, high: float = 25.0) -> DataFrame:
    """Values outside the historical range widened by ``band`` of it (K8)."""
    width = (F.col("high") - F.col("low")) * band
    scale = F.when(F.col("mean") == 0, 1.0).otherwise(F.abs("mean"))
    out = current.join(ranges, key).filter((F.col("value") < F.col("low") - width) | (F.col("value") > F.col("high") + width))
    return out.withColumn("deviation", F.round(F.abs(F.col("value") - F.col("mean")) / scale * 100, 1)).withColumn("severity", F.when(F.col("deviation") > high, "high").otherwise("medium"))


def conviction(ocf_ratio: Column, tone_: Column, contradictions_: tuple[Column, Column, Column], flags: tuple[Column, Column, Column]) -> Column:
    """Score 0 to 100 of earnings quality, tone, consistency and red flags, each (critical, high, medium) in counts (K9)."""
    eq = F.least(F.lit(100), (F.greatest(F.lit(0.0), ocf_ratio) / 1.5 * 100).cast("int"))
    (c, h, m), (fc, fh, fm) = contradictions_, flags
    dt, rfd = F.greatest(F.lit(0), 100 - 30 * c - 15 * h - 7 * m), F.greatest(F.lit(0), 100 - 25 * fc - 10 * fh - 5 * fm)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(0.30 * eq + 0.25 * tone_ + 0.25 * dt + 0.20 * rfd, 6).cast("int")))


def conviction_label(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 55, "moderate").when(score >= 35, "low").otherwise("very low")
