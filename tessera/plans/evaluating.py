"""Scoring, gating and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answering as A
from tessera.operators import evaluation as E
from tessera.plans.registry import cases, query, stated, table

#: Predicted, truth, page, first evidence page, abstained, and what must come of it: match, score. Both directions of each rule.
ANSWERS = [
    ("$2468.00", "2468", 60, 59, False, True, 1), ("$2468.00", "2300", 60, 59, False, False, -1), ("2468", "2468", 500, 59, False, True, 0), ("not found in this filing", "2468", None, 59, True, False, 0), ("as we read it, sales increased", "increased", 61, 59, False, True, 1),
    ("8.7", "8738", 10, 12, False, False, -1), ("(3,021)", "-3021", 40, 12, False, True, 0), ("12.5%", "12.53", 5, 5, False, True, 1), ("No, it did not", "none was reported", 5, 5, False, True, 1), ("sales increased", "revenue decreased", 5, 5, False, False, -1),
    ("margins grew while costs fell", "growth in volume and higher prices", 5, 5, False, False, -1), ("margins grew", "sales were higher", 5, 5, False, True, 1), ("it fell", "it worsened", 5, 5, False, True, 1), ("costs fell but sales rose", "cash declined", 5, 5, False, False, -1),
    ("in 2019", "2020", 5, 5, False, False, -1), ("", "12", 5, 5, False, False, -1), ("the board approved it", "approved", None, 5, False, True, 0), ("-4.2", "4.2", 20, 9, False, True, 1), ("1000", "994.1", 5, 5, False, True, 1), ("1000", "993", 5, 5, False, False, -1),
    ("paid dividends in Q2 of FY2022", "paid 0.55 each quarter of FY2022", 5, 5, False, False, -1), ("**1,204** million", "(1,204)", 5, 5, False, True, 1), ("0.004", "0", 5, 5, False, True, 1),
]


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf, ANSWERS, ["predicted", "truth", "page", "ev", "abstained"]).withColumn("evidence", F.array("ev"))


@query(f"select doc_id, match, page is not null and abs(page - ev) <= 12 as page_ok, score from ({stated(ANSWERS, 'predicted, truth, page, ev, abstained, match, score')})")
def score_answers(spark: SparkSession, sf: str) -> DataFrame:
    """E1-E9 on stated cases, one for each document."""
    return E.score_answers(_answers(spark, sf)).select("doc_id", "match", "page_ok", "score")


_OPEN = [k for k, r in enumerate(ANSWERS) if r[:2] in (("margins grew while costs fell", "growth in volume and higher prices"), ("paid dividends in Q2 of FY2022", "paid 0.55 each quarter of FY2022"), ("in 2019", "2020"))]


def _judge(prompts: list[str]) -> list[str]:
    """Stands for a model: true where both answers have a word of five letters in common, and no answer at all for years alone."""
    out = []
    for prompt in prompts:
        a, b = prompt.removeprefix("Predicted: ").split("\nGround truth: ")
        out.append("no idea" if a == "in 2019" else 'Sure: {"match": %s}' % str(bool({w for w in a.split() if len(w) > 4} & {w for w in b.split() if len(w) > 4} or "paid" in a)).lower())
    return out


@query(f"select doc_id, case when doc_id % {len(ANSWERS)} in ({', '.join(map(str, _OPEN))}) then contains(predicted, 'paid') else match end as match, case when abstained then 0 when case when doc_id % {len(ANSWERS)} in ({', '.join(map(str, _OPEN))}) then contains(predicted, 'paid') else match end then case when abs(coalesce(page, 1000) - ev) <= 12 then 1 else 0 end else -1 end as score from ({stated(ANSWERS, 'predicted, truth, page, ev, abstained, match, score')})")
def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A judge is asked only where the rules decide nothing; an unreadable reply is false."""
    return E.score_answers(_answers(spark, sf), _judge).select("doc_id", "match", "score")


_RUN = """select doc_id as id, 'What is it of ' || source || '?' as question, case doc_id % 4 when 0 then 'it rose by ' || doc_id else doc_id::varchar end as answer, source as doc_name, case when coalesce(toxic, 0) = 1 then 'held_out' else 'tune' end as part, (doc_id % 40)::int as page from documents left join labels using (doc_id)"""


def _run(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    d = F.col("doc_id")
    text, page = d.cast("string"), (d % 40).cast("int")
    evidence = F.array(F.struct(F.lit(None).cast("int").alias("evidence_page_num")), F.struct(page.alias("evidence_page_num")))
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    questions = docs.select(d.alias("id"), F.concat(F.lit("What is it of "), "source", F.lit("?")).alias("question"), F.when(d % 4 == 0, F.concat(F.lit("it rose by "), text)).otherwise(text).alias("answer"), F.col("source").alias("doc_name"), F.when(F.coalesce("toxic", F.lit(0)) == 1, "held_out").otherwise("tune").alias("part"), evidence.alias("evidence"))

    def answer(asked: DataFrame) -> DataFrame:
        i = F.col("id")
        return asked.select("id", F.when(i % 5 == 0, "1e9").otherwise(i.cast("string")).alias("answer"), (i % 7 * 10).cast("int").alias("page_num"), ((F.col("doc_name") == "ALL") & (i % 3 > 0)).alias("abstained"))

    return E.evaluate(questions, answer, mode).select("id", "doc_name", "match", "page_ok", "abstained", "score")


def _run_sql(part: str, everything: bool) -> str:
    doc, gone = ("'ALL'", "id % 3 > 0") if everything else ("doc_name", "false")
    return f"""with q as ({_RUN}), r as (select id, {doc} as doc_name, id % 5 > 0 or regexp_matches(answer, '^(1|9)$') and false as match, abs(page - (id % 7) * 10) <= 12 as page_ok, {gone} as abstained from q where part = '{part}')
    select *, case when abstained then 0 when not match then -1 when page_ok then 1 else 0 end as score from r"""


@query(_run_sql("tune", False))
def eval_tune(spark: SparkSession, sf: str) -> DataFrame:
    """A run over the tuning part, each question in its filing."""
    return _run(spark, sf, "tune")


@query(_run_sql("held_out", True))
def eval_before(spark: SparkSession, sf: str) -> DataFrame:
    """A run over the held-out part, all questions over everything."""
    return _run(spark, sf, "before")


#: Answers of the labels: quality as right, toxic as abstained.
_RECORDS = "r as (select doc_id, doc_id % 7 as grp, case when toxic = 1 then 0 when quality = 1 then 1 else -1 end as score, toxic = 1 as abstained from labels)"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return labels.select("doc_id", (F.col("doc_id") % 7).alias("grp"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(-1).alias("score"), (F.col("toxic") == 1).alias("abstained"), (F.col("quality") == 1).alias("right"))


_SUMMARY = "count(*) as total, sum(score)::bigint as net, count_if(score = 1)::bigint as correct, count_if(abstained)::bigint as abstained, count_if(score = -1)::bigint as wrong"


@query(f"with {_RECORDS} select {_SUMMARY}, case when count_if(score <> 0) > 0 then round(count_if(score = 1) / count_if(score <> 0), 4) else 0 end as precision from r")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    """E10."""
    return E.summary(_records(spark, sf))


@query(f"with {_RECORDS}, w as (select grp, row_number() over (partition by grp order by doc_id)::int as i, sum(score) over (partition by grp order by doc_id rows unbounded preceding)::bigint as net, count(*) over (partition by grp) as n from r) select grp, i, net from w where i % 5 = 0 or i = n")
def running_tally(spark: SparkSession, sf: str) -> DataFrame:
    """E11 by group."""
    return E.running_tally(_records(spark, sf), ["grp"], "doc_id")


@query("select doc_id, exists(select 1 from embeddings e where e.label = doc_id % 10 and abs(e.vec_id - doc_id) <= 12) as page_ok from labels")
def page_match(spark: SparkSession, sf: str) -> DataFrame:
    """Pages are ids, evidence those of the embeddings with the same last digit as label that are in the same or the next run of 25 ids."""
    run = lambda c: F.floor(F.col(c) / 25)
    evidence = table(spark, sf, "embeddings").select("label", run("vec_id").alias("run"), "vec_id")
    labels = table(spark, sf, "labels").select("doc_id", (F.col("doc_id") % 10).cast("int").alias("label"), F.explode(F.array(run("doc_id") - 1, run("doc_id"), run("doc_id") + 1)).alias("run"))
    near = labels.join(evidence, ["label", "run"], "left").groupBy("doc_id").agg(F.collect_list("vec_id").alias("evidence"))
    return near.select("doc_id", T.page_match(F.col("doc_id"), F.col("evidence")).alias("page_ok"))


@query("""with s as (select doc_id, lang, source, quality, (doc_id * 7919 + 42) % 10007 as k, source in (select source from documents where doc_id % 97 = 0) as away from labels join documents using (doc_id)),
    w as (select *, row_number() over (partition by lang, quality order by k, doc_id) as nth, count(*) over (partition by lang, quality) as n from s where not away)
    select doc_id, lang, quality, case when nth <= greatest(1, round_even(n * 0.75, 0)::int) then 'tune' else 'held_out' end as part from w union all select doc_id, lang, quality, 'held_out' from s where away""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """E14 with an order by arithmetic; all records of reserved sources are held out."""
    docs = table(spark, sf, "documents")
    rows = table(spark, sf, "labels").join(docs.select("doc_id", "lang", "source"), "doc_id")
    order = F.struct((F.col("doc_id") * 7919 + 42) % 10007, "doc_id")
    return E.stratified_split(rows, ["lang", "quality"], order, reserved=docs.filter("doc_id % 97 = 0"), doc="source").select("doc_id", "lang", "quality", "part")


_COUNTS = "q as (select source as doc, count(*) as n from documents group by source)"


@query("select source as doc, count(*) as n from documents group by source")
def question_counts(spark: SparkSession, sf: str) -> DataFrame:
    """E16."""
    return table(spark, sf, "documents").groupBy(F.col("source").alias("doc")).agg(F.count("*").alias("n"))


@query(f"with {_COUNTS} select doc, n, round(-ln(((n * 7919 + length(doc) * 31 + ascii(right(doc, 1)) * 17) % 1009 + 1) / 1010.0::double) / n, 9) as draw from q order by draw, doc limit 10")
def holdout_select(spark: SparkSession, sf: str) -> DataFrame:
    """Ten of the sources with questions, by weight."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("doc")).union(spark.createDataFrame([("nobody asks",)], "doc string"))
    u = ((F.col("n") * 7919 + F.length("doc") * 31 + F.ascii(F.substring("doc", -1, 1)) * 17) % 1009 + 1) / F.lit(1010.0)
    return E.holdout(docs, question_counts(spark, sf), "doc", u, 10)


_THETAS, _BOOSTS = [0.3, 0.45, 0.55, 0.65, 0.75, 0.9], [1.0, 1.25, 1.5, 2.0]
_GRID = f"""g as (select t.i * 4 + b.i as grid, theta, boost from (values {', '.join(f'({i}, {t}::double)' for i, t in enumerate(_THETAS))}) t(i, theta), (values {', '.join(f'({i}, {b}::double)' for i, b in enumerate(_BOOSTS))}) b(i, boost)),
    c as (select (doc_id % 100) / 100.0::double as confidence, doc_id % 3 = 0 as agree, quality = 1 as ok from labels),
    s as (select grid::int as grid, theta, boost, round(least(1.0, case when agree then confidence * boost else confidence end), 9) < theta as abstained, ok from g, c), r as (select *, case when abstained then 0 when ok then 1 else -1 end as score from s),
    m as (select grid, theta, boost, {_SUMMARY}, case when count_if(score <> 0) > 0 then round(count_if(score = 1) / count_if(score <> 0), 4) else 1 end as precision from r group by all)"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "labels").select(((F.col("doc_id") % 100) / F.lit(100.0)).alias("confidence"), (F.col("doc_id") % 3 == 0).alias("agree"), (F.col("quality") == 1).alias("right"))
    return E.threshold_grid(records, _THETAS, _BOOSTS)


@query(f"with {_GRID} select * from m")
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    """E17."""
    return _grid(spark, sf)


@query(f"with {_GRID} select * from m order by net desc, grid limit 1")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """E18."""
    return E.best_point(_grid(spark, sf))


_DRAFTS = "d as (select doc_id, quality = 1 as found, toxic = 1 as verified, (doc_id % 10) / 10.0::double as draft_confidence, (doc_id % 7) / 7.0::double as verify_confidence, (doc_id % 50)::int as draft_page, case when doc_id % 4 = 0 then null else (doc_id % 3)::int end as correct_page, 'a' || doc_id as draft_answer, case when doc_id % 2 = 0 then '' else 'v' || doc_id end as draft_value, case when doc_id % 5 = 0 then 'c' || doc_id end as correct_value from labels)"


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    name = lambda p: F.concat(F.lit(p), d.cast("string"))
    return table(spark, sf, "labels").select(
        d, (F.col("quality") == 1).alias("found"), (F.col("toxic") == 1).alias("verified"), ((d % 10) / F.lit(10.0)).alias("draft_confidence"), ((d % 7) / F.lit(7.0)).alias("verify_confidence"), (d % 50).cast("int").alias("draft_page"),
        F.when(d % 4 != 0, (d % 3).cast("int")).alias("correct_page"), name("a").alias("draft_answer"), F.when(d % 2 == 0, "").otherwise(name("v")).alias("draft_value"), F.when(d % 5 == 0, name("c")).alias("correct_value"),
    )


@query(f"with {_DRAFTS} select doc_id, (not found and not verified) or (not verified and draft_confidence < 0.55) as abstained, least(draft_confidence, verify_confidence) as confidence, coalesce(nullif(correct_page, 0), draft_page) as page from d")
def gate_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A4."""
    return _drafts(spark, sf).select("doc_id", A.gate_batch().alias("abstained"), A.confidence().alias("confidence"), A.answer_page().alias("page"))


@query(f"with {_DRAFTS} select doc_id, not verified or least(draft_confidence, verify_confidence) < 0.55 as abstained, coalesce(nullif(correct_value, ''), nullif(draft_value, ''), draft_answer) as answer from d")
def gate_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A5."""
    return _drafts(spark, sf).select("doc_id", A.gate_stream().alias("abstained"), A.stream_answer().alias("answer"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def parse_llm_json(spark: SparkSession, sf: str) -> DataFrame:
    """Replies in a code fence, in prose or bare."""
    n = F.col("event_id") % 3
    reply = F.when(n == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as asked"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", A.json_reply(reply, "k long")["k"].alias("k"))


@query(f"with {_DRAFTS}, x as (select *, case when doc_id % 11 = 0 then '' else 'some text' end as context, doc_id % 13 = 0 as failed, (doc_id % 50 + 1)::int as first_page from d), g as (select *, (not found and not verified) or (not verified and draft_confidence < 0.55) as shut from x) select doc_id, case when context = '' then 'not found in this filing' when failed then 'model unavailable: raw evidence only, unverified' when shut then 'not found in this filing' else draft_answer end as answer, case when context = '' then null when failed then first_page when not shut then coalesce(nullif(correct_page, 0), draft_page) end as page_num, context = '' or failed or shut as abstained, case when context = '' or failed then 0.0 else least(draft_confidence, verify_confidence) end as confidence from g")
def answer_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A4 with all its branches: no context, no reply of a model, shut and open gates."""
    d = F.col("doc_id")
    rows = _drafts(spark, sf).withColumn("context", F.when(d % 11 == 0, "").otherwise("some text")).withColumn("first_page", (d % 50 + 1).cast("int"))
    rows = rows.withColumn("draft_answer", F.when(d % 13 != 0, F.col("draft_answer")))
    return A.answer_batch(rows).select("doc_id", "answer", "page_num", "abstained", "confidence")


#: Replies of models and the typed records that they make: answer, value, page, confidence, found.
REPLIES = [
    ('```json\n{"answer": "12", "value": 12, "page_num": 7, "confidence": 0.5, "found": false}\n```', "12", "12", 7, 0.5, False), ('Here: {"answer": 8.5, "page_num": [3, 4]} as asked', "8.5", None, 3, 0.0, True), ("no object", None, None, None, 0.0, True),
    ('{"answer": "a", "value": null, "page_num": [], "confidence": "0.25"}', "a", None, None, 0.25, True), ('{"value": "x"}', None, "x", None, 0.0, True), ('{"answer": true, "page_num": "9"}', "true", None, 9, 0.0, True),
]


@query(stated(REPLIES, "reply, draft_answer, draft_value, draft_page, draft_confidence, found"))
def draft_records(spark: SparkSession, sf: str) -> DataFrame:
    """Typed records of stated replies, one for each document."""
    return cases(spark, sf, REPLIES, ["reply"]).select("doc_id", "reply", *[c.alias(k) for k, c in A.draft_record(F.col("reply")).items()])


CHECKS = [
    ('{"verified": true, "correct_value": 5, "correct_page": [2], "confidence": 0.9, "issues": ["x"]}', True, "5", 2, 0.9), ('{"verified": false}', False, None, None, 0.0), ("broken {", None, None, None, 0.0), ('{"correct_page": 0, "verified": "true"}', True, None, 0, 0.0),
]


@query(stated(CHECKS, "reply, verified, correct_value, correct_page, verify_confidence"))
def verify_records(spark: SparkSession, sf: str) -> DataFrame:
    """Typed records of stated checks, one for each document."""
    return cases(spark, sf, CHECKS, ["reply"]).select("doc_id", "reply", *[c.alias(k) for k, c in A.verify_record(F.col("reply")).items()])


_CONTEXT = """r as (select lang, doc_id as id, text, n_chars, source, row_number() over (partition by lang order by n_chars, doc_id) - 1 as rank0 from documents),
    c as (select lang, string_agg('[Excerpt ' || (rank0 + 1) || ' | page ' || n_chars || ' | prose]' || chr(10) || text, chr(10) || chr(10) order by rank0) as context, min_by(n_chars, rank0)::int as first_page from r where rank0 < 8 group by lang)"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.retrieval import top

    docs = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("id"), F.col("source").alias("doc"), "text", F.col("n_chars").cast("int").alias("page_num"), F.lit("prose").alias("chunk_type"))
    return top(docs, [F.col("page_num"), F.col("id")], 8, ["lang"])


@query(f"with {_CONTEXT} select lang, context, first_page from c")
def context_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """The eight shortest texts of each language."""
    return A.context(_ranked(spark, sf), ["lang"])


@query(f"""with {_CONTEXT} select lang, case when lang in ('en', 'de') then '[Statement facts]' || chr(10) || 'facts of ' || lang || chr(10) || chr(10) || '[Retrieved excerpts]' || chr(10) else '' end || context || case when lang in ('en', 'fr') then chr(10) || chr(10) || '[Resolved footnotes]' || chr(10) || 'note ' || lang else '' end as context, first_page from c""")
def context_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """A1 with notes after the excerpts and facts before them, where there are any."""
    ranked = _ranked(spark, sf)
    langs = ranked.select("lang").distinct()
    notes = langs.filter("lang in ('en', 'fr')").withColumn("notes", F.concat(F.lit("note "), "lang")).union(langs.filter("lang = 'es'").withColumn("notes", F.lit("")))
    facts = langs.filter("lang in ('en', 'de')").withColumn("block", F.concat(F.lit("facts of "), "lang"))
    return A.context(ranked, ["lang"], notes=notes, facts=facts)


_NOTES = "s as (select source as doc, doc_id as seq, (doc_id % 12)::varchar as footnote_id, text, (doc_id % 90)::int as page from documents)"


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return A.footnotes(d.select(F.col("source").alias("doc"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 12).cast("string").alias("footnote_id"), "text", (F.col("doc_id") % 90).cast("int").alias("page")))


@query(f"with {_NOTES} select doc, footnote_id, max_by(text, seq) as text, max_by(page, seq) as page from s group by all")
def footnote_build(spark: SparkSession, sf: str) -> DataFrame:
    """N1 with whole texts as notes."""
    return _notes(spark, sf)


_CALLED = f"""{_NOTES}, n as (select doc, footnote_id, max_by(text, seq) as note from s group by all),
    c as (select doc_id as id, source as doc, lang, (doc_id % 8)::int as rank0, list_sort(list_distinct([(doc_id % 5)::varchar, (doc_id % 11)::varchar, '10'])) as ids from documents), e as (select id, doc, lang, rank0, unnest(ids) as footnote_id from c)"""


def _callers(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat(F.lit("see ("), (d % 5).cast("string"), F.lit(") and Note "), (d % 11).cast("string"), F.lit(" and (10)"))
    return table(spark, sf, "documents").select(d.alias("id"), F.col("source").alias("doc"), "lang", (d % 8).cast("int").alias("rank0"), text.alias("text"))


@query(f"""with {_CALLED}, f as (select id, footnote_id, note, row_number() over (partition by id, note order by footnote_id) as rn from e join n using (doc, footnote_id)) select id, string_agg(note, chr(10) order by footnote_id) as notes from f where rn = 1 group by id""")
def footnote_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The notes of each chunk."""
    return A.resolve_footnotes(_callers(spark, sf).drop("rank0"), _notes(spark, sf))


@query(f"""with {_CALLED}, o as (select *, row_number() over (partition by doc, id order by footnote_id) - 1 as pos from e), f as (select doc, rank0, pos, note, row_number() over (partition by doc, note order by rank0, pos) as rn from o join n using (doc, footnote_id)) select doc, string_agg(note, chr(10) order by rank0, pos, note) as notes from f where rn = 1 group by doc""")
def footnote_context(spark: SparkSession, sf: str) -> DataFrame:
    """The notes of all chunks of a context, in the order of chunks and callouts, each once."""
    return A.resolve_footnotes(_callers(spark, sf), _notes(spark, sf), ["doc"])
