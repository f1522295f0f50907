"""Scoring, splits and threshold search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import decided_match, page_match, rubric
from tessera.operators.answering import guarded, json_reply, with_replies


def score_answers(records: DataFrame, judge: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Records with match, page_ok and score; needs predicted, truth, page, evidence, abstained.

    A ``judge`` decides what rules leave open (E6): it takes prompts and replies with JSON; what isn't {"match": true} is false.
    """
    records = records.withColumn("match", decided_match(F.col("predicted"), F.col("truth")))
    if judge is not None:
        # Only open records reach the judge; abstentions score zero without one.
        open_ = F.col("match").isNull() & ~F.col("abstained")
        prompt = F.concat(F.lit("Predicted: "), F.coalesce("predicted", F.lit("")), F.lit("\nGround truth: "), F.coalesce("truth", F.lit("")))
        judged = with_replies(records.filter(open_).withColumn("prompt", prompt), guarded(judge)).withColumn("match", json_reply(F.col("reply"), "match boolean")["match"]).drop("prompt", "reply")
        records = records.filter(~open_).unionByName(judged)
    return records.withColumn("match", F.coalesce("match", F.lit(False))).withColumn("page_ok", page_match(F.col("page"), F.col("evidence"))).withColumn("score", rubric(F.col("match"), F.col("page_ok"), F.col("abstained")))


def summary(records: DataFrame, group: list[str] | None = None, no_answers: float = 0.0) -> DataFrame:
    """Totals of score and abstained (E10); ``no_answers``: precision without any."""
    right, wrong = F.count_if(F.col("score") == 1), F.count_if(F.col("score") == -1)
    precision = F.when(right + wrong > 0, F.round(right / (right + wrong), 4)).otherwise(no_answers)
    return records.groupBy(*(group or [])).agg(F.count("*").alias("total"), F.sum("score").alias("net"), right.alias("correct"), F.count_if("abstained").alias("abstained"), wrong.alias("wrong"), precision.alias("precision"))


def running_tally(records: DataFrame, group: list[str], order: str, every: int = 5) -> DataFrame:
    """The net score of each group after every ``every`` records and the last."""
    w = Window.partitionBy(*group).orderBy(order)
    whole = Window.partitionBy(*group)
    out = records.withColumn("i", F.row_number().over(w)).withColumn("net", F.sum("score").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.count("*").over(whole))
    return out.filter((F.col("i") % every == 0) | (F.col("i") == F.col("n"))).select(*group, "i", "net")


def stratified_split(records: DataFrame, strata: list[str], key: Column, share: float = 0.75, reserved: DataFrame | None = None, doc: str = "doc") -> DataFrame:
    """Records with ``part``: in the order of ``key`` the first max(1, round(share n)) of a stratum tune, the rest are held out.

    Records of ``reserved`` documents (column ``doc``) are all held out and count in no stratum.
    """
    kept = records
    if reserved is not None:
        away = records.join(reserved.select(doc).distinct(), doc, "left_semi").withColumn("part", F.lit("held_out"))
        kept = records.join(reserved.select(doc).distinct(), doc, "left_anti")
    w = Window.partitionBy(*strata)
    n = F.count("*").over(w)
    nth = F.row_number().over(w.orderBy(key))
    out = kept.withColumn("part", F.when(nth <= F.greatest(F.lit(1), F.bround(n * share, 0).cast("int")), "tune").otherwise("held_out"))
    return out if reserved is None else out.unionByName(away)


def weighted_sample(rows: DataFrame, weight: str, uniform: Column, n: int, order: Column) -> DataFrame:
    """``n`` rows without replacement in proportion to ``weight``: the smallest -ln(u) / w."""
    return rows.withColumn("draw", F.round(-F.log(uniform) / F.col(weight), 9)).orderBy("draw", order).limit(n)


def holdout(documents: DataFrame, counts: DataFrame, key: str, uniform: Column, n: int = 10) -> DataFrame:
    """``n`` documents to reserve, by the number of their questions (E15): key, n, draw.

    Only documents with questions are eligible, or all, weighted alike, if none has any. ``counts`` has key and n.
    """
    counted = documents.select(key).distinct().join(counts.select(key, "n"), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Whether any is eligible is one value, for all rows.
    some = counted.join(F.broadcast(counted.agg(F.max("n").alias("_most")))).filter((F.col("n") >= 1) | (F.col("_most") == 0))
    return weighted_sample(some.withColumn("n", F.greatest("n", F.lit(1))).drop("_most"), "n", uniform, n, F.col(key))


#: Part of the split and scope of each mode (E19): before a held-out filing is indexed, its questions are asked of all others.
MODES = {"tune": ("tune", "filing"), "before": ("held_out", "global"), "after": ("held_out", "filing")}


def evaluate(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], mode: str = "tune", judge: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Records of a run over questions (E12, E19): id, question, doc_name, predicted, truth, page, evidence, abstained, match, page_ok, score.

    ``questions`` has id, question, answer, doc_name, evidence (structs with evidence_page_num) and, if split, part. ``answer`` takes id,
    question and doc_name ("ALL" in the global scope) and returns id, answer, page_num and abstained.
    """
    part, scope = MODES[mode]
    asked = questions.filter(F.col("part") == part) if "part" in questions.columns else questions
    pages = F.filter(F.transform(F.coalesce("evidence", F.array().cast(questions.schema["evidence"].dataType)), lambda e: e["evidence_page_num"]), lambda p: p.isNotNull())
    asked = asked.select("id", "question", F.col("answer").alias("truth"), (F.lit("ALL") if scope == "global" else F.col("doc_name")).alias("doc_name"), pages.alias("evidence"))
    replies = answer(asked.select("id", "question", "doc_name")).select("id", F.col("answer").alias("predicted"), F.col("page_num").alias("page"), "abstained")
    return score_answers(asked.join(replies, "id"), judge)


def threshold_grid(records: DataFrame, thetas: list[float], boosts: list[float]) -> DataFrame:
    """Metrics at each point of a grid (E17): records have confidence, agree and right. The grid's points are literals."""
    points = [F.struct(F.lit(i).alias("grid"), F.lit(t).alias("theta"), F.lit(b).alias("boost")) for i, (t, b) in enumerate((t, b) for t in thetas for b in boosts)]
    each = records.select("confidence", "agree", "right", F.inline(F.array(*points)))
    sure = F.least(F.lit(1.0), F.when(F.col("agree"), F.col("confidence") * F.col("boost")).otherwise(F.col("confidence")))
    scored = each.withColumn("abstained", F.round(sure, 9) < F.col("theta")).withColumn("score", F.when(F.col("abstained"), 0).when(F.col("right"), 1).otherwise(-1))
    return summary(scored, ["grid", "theta", "boost"], no_answers=1.0)


def best_point(grid: DataFrame) -> DataFrame:
    """The first point with the highest net score."""
    return grid.orderBy(F.col("net").desc(), "grid").limit(1)
