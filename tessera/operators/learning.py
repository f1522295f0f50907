"""State learned from use: feedback weights, similar questions, rephrasings, keyed upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens

UP, DOWN, LOW, HIGH = 0.1, 0.15, 0.1, 2.0
#: Words that say nothing about a question.
STOP = ["the", "a", "an", "is", "was", "were", "what", "how", "much", "did", "does", "in", "of", "for", "and", "or", "to", "from"]


def feedback_weights(events: DataFrame, key: str, order: list[str], verdict: str, run: int = 10_000) -> DataFrame:
    """key, weight, correct, wrong: an ordered fold of verdicts, clamped at each step (L1).

    The fold does not commute, so a key's verdicts are numbered in order first. What ``run`` of them do to any weight is adding a number and
    clamping the sum, so each run is folded to three numbers, and those of a key are applied one after another: no row holds a whole log.
    """
    nth = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / run)
    log = events.select(key, *order, F.col(verdict).alias("v")).withColumn("run", nth).groupBy(key, "run").agg(
        F.sort_array(F.collect_list(F.struct(*order, "v"))).alias("log"), F.count_if(F.col("v") == "correct").cast("int").alias("correct"), F.count_if(F.col("v") == "wrong").cast("int").alias("wrong"))
    inf = F.lit(float("inf"))
    start = F.struct(F.lit(0.0).alias("add"), (-inf).alias("low"), inf.alias("high"))

    def moved(f: Column, by: float, bound: Callable[[Column], Column]) -> Column:
        return F.struct((f["add"] + by).alias("add"), bound(f["low"] + by).alias("low"), bound(f["high"] + by).alias("high"))

    def step(f: Column, x: Column) -> Column:
        up, down = moved(f, UP, lambda w: F.least(F.lit(HIGH), w)), moved(f, -DOWN, lambda w: F.greatest(F.lit(LOW), w))
        return F.when(x["v"] == "correct", up).when(x["v"] == "wrong", down).otherwise(f)

    folded = log.select(key, "run", "correct", "wrong", F.aggregate("log", start, step).alias("f"))
    runs = folded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run", "f"))).alias("runs"), F.sum("correct").cast("int").alias("correct"), F.sum("wrong").cast("int").alias("wrong"))
    weight = F.aggregate("runs", F.lit(1.0), lambda w, r: F.least(r["f"]["high"], F.greatest(r["f"]["low"], w + r["f"]["add"])))
    return runs.select(key, F.round(weight, 6).alias("weight"), "correct", "wrong")


def feedback_summary(weights: DataFrame) -> DataFrame:
    """Weights that have moved (L4)."""
    return weights.filter(F.col("weight") != 1.0)


def question_tokens(text: Column, stop: list[str] = STOP) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), F.array(*[F.lit(s) for s in stop]))


def similar_pattern(history: DataFrame, question: str, order: list[str], recent: int = 200, least: float = 0.6) -> DataFrame:
    """The most similar of the latest questions by Jaccard of tokens, the latest first among equals."""
    latest = history.orderBy(*[F.col(c).desc() for c in order]).limit(recent)
    own, theirs = question_tokens(F.lit(question)), question_tokens(F.col("question"))
    both = F.size(F.array_intersect(own, theirs)) / F.greatest(F.lit(1), F.size(F.array_union(own, theirs)))
    found = latest.filter(F.size(theirs) > 0).withColumn("_both", both).filter(F.col("_both") >= least).orderBy(F.col("_both").desc(), *[F.col(c).desc() for c in order]).limit(1)
    return found.withColumn("similarity", F.round("_both", 3)).drop("_both")


def question_log(answers: DataFrame) -> DataFrame:
    """What is remembered of each answered question (L5): question, doc_name, outcome, ts. ``answers`` has question, doc_name, abstained, ts."""
    return answers.select("question", "doc_name", F.when(F.col("abstained"), "abstained").otherwise("answered").alias("outcome"), "ts")


def remember(answers: DataFrame, path: str) -> None:
    """Append the questions to the stored log."""
    question_log(answers).write.mode("append").parquet(path)


def rephrasings(turns: DataFrame, session: str, order: str) -> DataFrame:
    """original, rephrased: an abstained question followed by an answered one with new tokens of four or more characters.

    ``turns`` has question and outcome.
    """
    w = Window.partitionBy(session).orderBy(order)
    pairs = turns.withColumn("next", F.lead("question").over(w)).withColumn("then", F.lead("outcome").over(w)).filter("outcome = 'abstained' and then = 'answered'")
    novel = F.array_sort(F.filter(F.array_except(F.array_distinct(tokens(F.col("next"))), tokens(F.col("question"))), lambda t: F.length(t) >= 4))
    return pairs.withColumn("rephrased", F.array_join(novel, " ")).filter("rephrased <> ''").select(F.col("question").alias("original"), "rephrased")


def pair_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of normalised pairs."""
    return pairs.groupBy(F.lower(F.trim(a)).alias(a), F.lower(F.trim(b)).alias(b)).agg(F.count("*").alias("hits"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*key, "_v.*")
