"""From context to gated answers (A1-A8, N1-N3, F1-F3): models are injected callables, everything else is DataFrame work."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def gate_batch(theta: float = 0.55) -> Column:
    """Abstain where nothing is found nor verified, or where an unverified draft lacks confidence (A4)."""
    v = F.col("verified")
    return (~F.col("found") & ~v) | (~v & (F.col("draft_confidence") < theta))


def gate_stream(theta: float = 0.55) -> Column:
    """Abstain where unverified, or where either confidence is too low (A5)."""
    return ~F.col("verified") | (F.least("draft_confidence", "verify_confidence") < theta)


def confidence() -> Column:
    return F.least("draft_confidence", "verify_confidence")


def answer_page() -> Column:
    """The corrected page unless missing or zero, else the draft's."""
    return F.coalesce(F.nullif("correct_page", F.lit(0)), F.col("draft_page"))


def stream_answer() -> Column:
    """Corrected value, else the draft's value, else its answer; empty strings count as missing."""
    return F.coalesce(F.nullif("correct_value", F.lit("")), F.nullif("draft_value", F.lit("")), F.col("draft_answer"))


def json_reply(text: Column, schema: str) -> Column:
    """A model's reply as a struct: without code fences, else its first brace to its last (A6); null if invalid."""
    plain = F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    span = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.from_json(F.nullif(span, F.lit("")), schema)


#: Columns of a typed draft and of a typed check.
DRAFT = ["draft_answer", "draft_value", "draft_page", "draft_confidence", "found"]
VERIFY = ["verified", "correct_value", "correct_page", "verify_confidence"]
NOT_FOUND, UNAVAILABLE = "not found in this filing", "model unavailable: raw evidence only, unverified"


def _field(reply: Column, name: str) -> Column:
    """A field of a JSON object as text, whatever it is; null if missing."""
    span = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.get_json_object(F.nullif(span, F.lit("")), f"$.{name}")


def _page(reply: Column, name: str) -> Column:
    """A page number; the first of a list of them."""
    return F.coalesce(_field(reply, f"{name}[0]"), _field(reply, name)).try_cast("int")


def draft_record(reply: Column) -> dict[str, Column]:
    """The typed record of a draft's reply (A2): scalars become text, a list of pages its first; no answer, no record."""
    return {
        "draft_answer": _field(reply, "answer"), "draft_value": _field(reply, "value"), "draft_page": _page(reply, "page_num"),
        "draft_confidence": F.coalesce(_field(reply, "confidence").try_cast("double"), F.lit(0.0)), "found": F.coalesce(_field(reply, "found").try_cast("boolean"), F.lit(True)),
    }


def verify_record(reply: Column) -> dict[str, Column]:
    """The typed record of a check's reply (A3); without ``verified``, no record."""
    return {
        "verified": _field(reply, "verified").try_cast("boolean"), "correct_value": _field(reply, "correct_value"), "correct_page": _page(reply, "correct_page"),
        "verify_confidence": F.coalesce(_field(reply, "confidence").try_cast("double"), F.lit(0.0)),
    }


def answer_batch(records: DataFrame, theta: float = 0.55) -> DataFrame:
    """Records with answer, page_num, abstained, confidence (A4).

    Needs context, first_page and the columns of ``DRAFT`` and ``VERIFY``. Without context nothing is found; without one of the typed records only
    evidence is given, at the page of its first chunk; else the gate decides.
    """
    empty, failed = F.coalesce(F.col("context"), F.lit("")) == "", F.col("draft_answer").isNull() | F.col("verified").isNull()
    shut = gate_batch(theta)
    return (
        records.withColumn("answer", F.when(empty, NOT_FOUND).when(failed, UNAVAILABLE).when(shut, NOT_FOUND).otherwise(F.col("draft_answer")))
        .withColumn("page_num", F.when(empty, None).when(failed, F.col("first_page")).when(~shut, answer_page()))
        .withColumn("abstained", empty | failed | shut).withColumn("confidence", F.when(empty | failed, 0.0).otherwise(confidence()))
    )


def extractive(prompts: list[str]) -> list[str]:
    """A draft without a model: the excerpt that shares most words with the question, as sure as the share is large (A2's default)."""
    out = []
    for prompt in prompts:
        question, _, rest = prompt.partition("\n\nExcerpts:\n")
        asked = set(re.findall(r"\w+", question.removeprefix("Question: ").lower()))
        best = (0.0, "", None)
        for head, text in re.findall(r"(?s)\[Excerpt ([^\]]*)\]\n(.*?)(?=\n\n\[|\Z)", rest):
            share = len(asked & set(re.findall(r"\w+", text.lower()))) / max(len(asked), 1)
            page = re.search(r"page (\d+)", head)
            if share > best[0]:
                best = (share, text, int(page[1]) if page else None)
        out.append(json.dumps({"answer": best[1] or NOT_FOUND, "value": None, "page_num": best[2], "confidence": round(best[0], 6), "found": bool(best[1])}))
    return out


def supported(prompts: list[str]) -> list[str]:
    """A check without a model: the drafted answer stands in the excerpts (A3's default)."""
    out = []
    for prompt in prompts:
        head, _, excerpts = prompt.partition("\n\nExcerpts:\n")
        answer = re.search(r"(?s)Draft answer: (.*?)\nDraft value:", head)
        ok = bool(answer and answer[1] and answer[1] in excerpts)
        out.append(json.dumps({"verified": ok, "correct_value": None, "correct_page": None, "confidence": float(ok), "issues": []}))
    return out


def guarded(call: Callable[[list[str]], list[str]]) -> Callable[[list[str]], list[str]]:
    """A model whose failure is an empty reply for each prompt."""

    def run(prompts: list[str]) -> list[str]:
        try:
            return call(prompts)
        except Exception:
            return [""] * len(prompts)

    return run


def first_that_works(*calls: Callable[[list[str]], list[str]]) -> Callable[[list[str]], list[str]]:
    """A model that falls back to the next one when one fails (A7); the last one's failure is its own."""

    def run(prompts: list[str]) -> list[str]:
        for call in calls[:-1]:
            try:
                return call(prompts)
            except Exception:
                continue
        return calls[-1](prompts)

    return run


def ask(contexts: DataFrame, draft: Callable[[list[str]], list[str]] = extractive, verify: Callable[[list[str]], list[str]] = supported, per_minute: int = 60_000, theta: float = 0.55) -> DataFrame:
    """Two passes and the gate (A2-A4) for rows with question, context and first_page."""
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n\nExcerpts:\n"), F.coalesce("context", F.lit("")))
    drafted = with_replies(contexts.withColumn("prompt", prompt), guarded(draft), per_minute)
    drafted = drafted.select(*contexts.columns, *[c.alias(k) for k, c in draft_record(F.col("reply")).items()])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    prompt = F.concat(
        F.lit("Question: "), "question", F.lit("\n\nDraft answer: "), text("draft_answer"), F.lit("\nDraft value: "), text("draft_value"),
        F.lit("\nDraft page: "), text("draft_page"), F.lit("\n\nExcerpts:\n"), F.coalesce("context", F.lit("")),
    )
    checked = with_replies(drafted.withColumn("prompt", prompt), guarded(verify), per_minute)
    return answer_batch(checked.select(*drafted.columns, *[c.alias(k) for k, c in verify_record(F.col("reply")).items()]), theta)


def context(chunks: DataFrame, key: list[str], most: int = 8, notes: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """key, context, first_page: numbered excerpts of the best ``most`` chunks in rank order (A1, R15). Needs rank0, text, page_num, chunk_type.

    ``notes`` (key, notes) stand after them and ``facts`` (key, block) before them.
    """
    line = F.format_string("[Excerpt %d | page %s | %s]\n%s", F.col("rank0") + 1, F.col("page_num").cast("string"), F.col("chunk_type"), F.col("text"))
    kept = chunks.filter(F.col("rank0") < most).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank0", line.alias("line")))).alias("l"), F.min_by("page_num", "rank0").alias("first_page"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n\n")
    if notes is not None:
        kept = kept.join(notes.select(*key, "notes"), key, "left")
        text = F.concat(text, F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit("\n\n[Resolved footnotes]\n"), "notes")).otherwise(""))
    if facts is not None:
        kept = kept.join(facts.select(*key, "block"), key, "left")
        text = F.when(F.coalesce("block", F.lit("")) != "", F.concat(F.lit("[Statement facts]\n"), "block", F.lit("\n\n[Retrieved excerpts]\n"), text)).otherwise(text)
    return kept.select(*key, text.alias("context"), "first_page")


def footnotes(segments: DataFrame) -> DataFrame:
    """doc, footnote_id, text, page: the last of each id."""
    return segments.filter("footnote_id is not null").groupBy("doc", "footnote_id").agg(F.max_by(F.struct("text", "page"), "seq").alias("v")).select("doc", "footnote_id", "v.*")


def callouts(text: Column) -> Column:
    """Distinct ids of "(n)" and "Note n", sorted as strings."""
    return F.array_sort(F.array_union(F.regexp_extract_all(text, F.lit(r"\((\d{1,2})\)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?i)\bnote (\d{1,2})\b"), F.lit(1))))


def resolve_footnotes(chunks: DataFrame, notes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key, notes: the resolved notes of each chunk (or, with ``key``, of all its chunks in the order of rank0) in callout order, repeated texts once."""
    ranked = chunks if key else chunks.withColumn("rank0", F.lit(0))
    key = key or ["id"]
    asked = ranked.select(*key, "doc", "rank0", F.posexplode(callouts(F.col("text"))).alias("pos", "footnote_id"))
    found = asked.join(notes.select("doc", "footnote_id", F.col("text").alias("note")), ["doc", "footnote_id"])
    listed = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank0", "pos", "note"))).alias("l"))
    return listed.select(*key, F.array_join(F.array_distinct(F.transform("l", lambda x: x["note"])), "\n").alias("notes"))


def facts_table(facts: DataFrame, key: list[str]) -> DataFrame:
    """key, statement_type, block: first unit, most common page (the smallest of equals), then a line for each fact in order."""
    line = F.concat_ws(" | ", "row_label", F.coalesce("column_header", F.lit("")), "value_text")
    rows = facts.groupBy(*key, "statement_type").agg(F.sort_array(F.collect_list(F.struct("fact_id", line.alias("line")))).alias("l"), F.min_by("units", F.when(F.col("units").isNotNull(), F.col("fact_id"))).alias("units"), F.mode("page_num", True).alias("page_num"))
    return rows.select(*key, "statement_type", "page_num", F.concat_ws("\n", F.concat(F.col("statement_type"), F.coalesce(F.concat(F.lit(" ("), F.col("units"), F.lit(")")), F.lit(""))), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("block"))


def facts_for(facts: DataFrame, asked: DataFrame, needed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The facts of the statements that each question asks for (F2); a question without any has no rows. ``asked`` has doc and question."""
    wanted = asked.select("doc", F.explode((needed or statements_needed)(F.col("question"))).alias("statement_type")).distinct()
    return facts.join(wanted, ["doc", "statement_type"], "left_semi")


def statements_needed(question: Column) -> Column:
    """The statements that a question asks for, by keyword rules (F1's deterministic default)."""
    low = F.lower(question)
    rule = lambda name, pattern: F.when(low.rlike(pattern), F.lit(name))
    return F.array_compact(F.array(rule("income_statement", "revenue|income|margin|earnings|sales"), rule("balance_sheet", "asset|liabilit|equity|debt|inventor"), rule("cash_flow", "cash flow|capital expenditure|capex|dividend")))


def token_gap(budget: int, per_minute: int, utilisation: float = 0.7) -> float:
    """Seconds between batches of ``budget`` tokens that use the share ``utilisation`` of a quota of tokens a minute."""
    return budget / (per_minute * utilisation) * 60


def paced(batches: Iterator[pd.DataFrame], call: Callable[[list[str]], list[str]], per_minute: int, attempts: int = 10, wait: float = 30.0, sleep: Callable[[float], None] = time.sleep, gap: float | None = None) -> Iterator[pd.DataFrame]:
    """Add ``reply`` by calling a model for batches of prompts, evenly spaced or ``gap`` seconds apart, with retries (A7, A8, I7). For use in mapInPandas."""
    gap, last = 60.0 / per_minute if gap is None else gap, float("-inf")
    for batch in batches:
        for attempt in range(attempts):
            sleep(max(0.0, last + gap - time.monotonic()))
            last = time.monotonic()
            try:
                yield batch.assign(reply=call(batch["prompt"].tolist()))
                break
            except Exception:
                if attempt == attempts - 1:
                    raise
                sleep(wait)


def with_replies(prompts: DataFrame, call: Callable[[list[str]], list[str]], per_minute: int = 60_000, attempts: int = 10, gap: float | None = None) -> DataFrame:
    """``prompts`` (with prompt) and the model's reply (A2, A3). Tasks pace themselves, so a quota holds for each of them."""
    schema = StructType([*prompts.schema.fields]).add("reply", "string")
    return prompts.mapInPandas(lambda it: paced(it, call, per_minute, attempts, gap=gap), schema)


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
