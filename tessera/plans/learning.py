"""Feedback, history and rephrasing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import learning as L
from tessera.operators import retrieval as R
from tessera.plans.registry import query, table

_WEIGHTS = """w as (select user_id as chunk_id, round(list_reduce(list_prepend(1.0::double, list(case event_type when 'purchase' then 0.1::double when 'error' then -0.15::double else 0::double end order by ts, event_id)),
    lambda a, x: case when x > 0 then least(2.0, a + x) when x < 0 then greatest(0.1, a + x) else a end), 6) as weight, count_if(event_type = 'purchase')::int as correct, count_if(event_type = 'error')::int as wrong from events group by user_id)"""


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "error", "wrong").otherwise("clarify")
    events = table(spark, sf, "events").select(F.col("user_id").alias("chunk_id"), "ts", "event_id", verdict.alias("verdict"))
    return L.feedback_weights(events, "chunk_id", ["ts", "event_id"], "verdict")


@query(f"with {_WEIGHTS} select * from w")
def memory_weights(spark: SparkSession, sf: str) -> DataFrame:
    """L1: ordered, clamped fold."""
    return _weights(spark, sf)


@query(f"with {_WEIGHTS} select * from w where weight <> 1.0")
def feedback_summary(spark: SparkSession, sf: str) -> DataFrame:
    """L4."""
    return L.feedback_summary(_weights(spark, sf))


@query(f"with {_WEIGHTS} select doc_id as id, coalesce(weight, 1.0) as weight, round(n_chars::double * coalesce(weight, 1.0), 9) as score from documents left join w on doc_id = chunk_id")
def weighted_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """R9, L2, L3."""
    ranked = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return R.weighted(ranked, _weights(spark, sf).select(F.col("chunk_id").alias("id"), "weight"))


@query(r"""with h as (select conv_id, turn, text from conversations where role = 'user' order by conv_id desc, turn desc limit 200),
    s as (select *, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), lambda x: x not in ('the', 'a', 'an', 'is', 'was', 'were', 'what', 'how', 'much', 'did', 'does', 'in', 'of', 'for', 'and', 'or', 'to', 'from')) as t from h),
    q as (select list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), lambda x: x not in ('the', 'a', 'an', 'is', 'was', 'were', 'what', 'how', 'much', 'did', 'does', 'in', 'of', 'for', 'and', 'or', 'to', 'from')) as qt from conversations where role = 'user' order by conv_id desc, turn desc limit 1),
    j as (select conv_id, turn, len(list_intersect(t, qt)) / greatest(1, len(list_distinct(list_concat(t, qt)))) as j from s, q where len(t) > 0)
    select conv_id, turn, round(j, 3) as similarity from j where j >= 0.6 order by j desc, conv_id desc, turn desc limit 1""")
def similar_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """The latest question against the latest 200."""
    turns = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    last = turns.orderBy(F.col("conv_id").desc(), F.col("turn").desc()).first()
    return L.similar_pattern(turns, last["question"] if last else "", ["conv_id", "turn"]).select("conv_id", "turn", "similarity")


@query("select text as question, 'DOC_' || conv_id as doc_name, case when turn % 4 = 0 then 'abstained' else 'answered' end as outcome, conv_id * 100 + turn as ts from conversations where role = 'user'")
def question_log(spark: SparkSession, sf: str) -> DataFrame:
    """What is remembered of each question."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    return L.question_log(turns.select(F.col("text").alias("question"), F.concat(F.lit("DOC_"), F.col("conv_id").cast("string")).alias("doc_name"), (F.col("turn") % 4 == 0).alias("abstained"), (F.col("conv_id") * 100 + F.col("turn")).alias("ts")))


@query(r"""with t as (select *, case when turn % 4 = 0 then 'abstained' else 'answered' end as outcome from conversations where role = 'user'),
    p as (select text as original, outcome, lead(text) over w as nxt, lead(outcome) over w as thn from t window w as (partition by conv_id order by turn)),
    r as (select original, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(nxt), '[\p{L}\p{N}_]+')), lambda x: length(x) >= 4 and not list_contains(regexp_extract_all(lower(original), '[\p{L}\p{N}_]+'), x))), ' ') as rephrased from p where outcome = 'abstained' and thn = 'answered')
    select lower(trim(original)) as original, lower(trim(rephrased)) as rephrased, count(*) as hits from r where rephrased <> '' group by all""")
def rephrase_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """L7, L8."""
    turns = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("turn") % 4 == 0, "abstained").otherwise("answered").alias("outcome"))
    return L.pair_counts(L.rephrasings(turns, "conv_id", "turn"), "original", "rephrased")


@query("select o_custkey as company, o_orderpriority as metric, max_by(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) as value from orders group by all")
def latest_metric(spark: SparkSession, sf: str) -> DataFrame:
    """L9, L10."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"), "o_orderdate", "o_orderkey")
    return L.latest(rows, ["company", "metric"], ["o_orderdate", "o_orderkey"]).select("company", "metric", "value")


@query("select distinct o_custkey as doc from orders")
def cached_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with metrics."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc")).distinct()
