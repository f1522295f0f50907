"""Search, fusion, routing and expansion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.plans.registry import cases, query, stated, table

#: The question's tokens, one of them twice, and the vector that stands for it.
QUERY, VECTOR, K = ["the", "anea", "ention", "the"], 0, 10

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _bm25_sql(group: str = "") -> str:
    g, on = (f"{group}, ", f"using ({group})") if group else ("", "on true")
    by = f"group by {group}" if group else ""
    return rf"""
    chunks as (select {g}doc_id as id, text, {TOKENS} as toks from documents),
    terms as (select {g}id, len(toks) as n_tokens, term, count(*) as tf from (select {g}id, toks, unnest(toks) as term from chunks) group by all),
    sizes as (select {g}count(*) as n, avg(len(toks)) as mean from chunks {by}),
    df as (select {g}term, count(*) as df from terms group by all),
    idf as (select df.*, n, mean, ln(n - df + 0.5) - ln(df + 0.5) as idf from df join sizes {on}),
    floors as (select {g}0.25 * avg(idf) as floor from idf {by}),
    asked as (select * from (values ('the', 2), ('anea', 1), ('ention', 1)) t(term, times)),
    weights as (select {g}term, times * case when idf < 0 then floor else idf end as w, mean from idf join asked using (term) join floors {on}),
    scored as (select {g}id, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_tokens / mean))), 6) as score from terms join weights using ({g}term) group by all having score > 0),
    named as (select scored.*, text from scored join chunks using ({g}id)),
    uniq as (select *, row_number() over (partition by {g}trim(text) order by score desc, id) as rn from named),
    ranked as (select *, (row_number() over ({f'partition by {group} ' if group else ''}order by score desc, id) - 1)::int as rank0 from uniq where rn = 1)
    """


_DENSE = """
    q as (select embedding::double[] as qv from embeddings where vec_id = 0),
    dist as (select vec_id as id, round(1 - list_inner_product(embedding::double[], qv) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product(qv, qv))), 6) as distance from embeddings, q),
    dense as (select *, (row_number() over (order by distance, id) - 1)::int as rank0 from dist qualify rank0 < {k})
"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _vector(spark: SparkSession, sf: str) -> list[float]:
    # One row.
    return table(spark, sf, "embeddings").filter(F.col("vec_id") == VECTOR).first()["embedding"]


@query(f"with {_bm25_sql()} select id, score, rank0 from ranked where rank0 < 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """I1-I3, R2, R3."""
    return R.sparse_top(_chunks(spark, sf), QUERY, K)


@query(f"with {_bm25_sql('source')} select source, id, score, rank0 from ranked where rank0 < 3")
def bm25_topk_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of each group; R12: three for each group."""
    return R.sparse_top(_chunks(spark, sf), QUERY, 3, ["source"])


@query(f"with {_DENSE.format(k=10)} select id, distance, rank0 from dense")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """R1."""
    return R.dense_top(_vectors(spark, sf), _vector(spark, sf), K)


@query(f"with {_DENSE.format(k=5).replace('from embeddings, q)', 'from embeddings, q where label = 3)')} select id, distance, rank0 from dense")
def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """R1 with a filter that reaches the scan, S9."""
    rows = table(spark, sf, "embeddings").filter("label = 3").select(F.col("vec_id").alias("id"), "embedding")
    return R.dense_top(rows, _vector(spark, sf), 5)


def _fused_sql(weight: float) -> str:
    return f"""with {_bm25_sql()}, {_DENSE.format(k=200)}, sparse as (select id, rank0 from ranked where rank0 < 200),
    fused as (select coalesce(d.id, s.id) as id, d.rank0 as dense_rank, s.rank0 as bm25_rank, d.id is not null and s.id is not null as dual_agreement,
      coalesce(1.0::double / (60 + d.rank0 + 1), 0) + coalesce({weight}::double / (60 + s.rank0 + 1), 0) as raw from dense d full join sparse s on d.id = s.id),
    scored as (select id, dense_rank, bm25_rank, dual_agreement, round(case when dual_agreement then raw * 1.5 else raw end, 9) as score from fused)"""


def _fused_sql_2(weight: float) -> str:
    return _fused_sql(weight).replace("scored as (select id, dense_rank", "final as (select id, dense_rank")


#: Each trimmed text once, the best first.
_ONCE = "once as (select f.*, row_number() over (partition by trim(text) order by score desc, dense_rank nulls last, bm25_rank nulls last, f.id) as rn from final f join documents d on d.doc_id = f.id)"


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return R.dense_top(_vectors(spark, sf), _vector(spark, sf), 200), R.sparse_top(_chunks(spark, sf), QUERY, 200)


@query(f"{_fused_sql_2(1.0)}, {_ONCE} select id, dense_rank, bm25_rank, dual_agreement, score from once where rn = 1 order by score desc, dense_rank nulls last, bm25_rank nulls last, id limit 8")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """R7, R8, R10, R15."""
    return R.hybrid(*_lists(spark, sf), _chunks(spark, sf), 8)


@query(f"{_fused_sql_2(2.0)}, {_ONCE} select id, dense_rank, bm25_rank, dual_agreement, score from once where rn = 1 order by score desc, dense_rank nulls last, bm25_rank nulls last, id limit 8")
def hybrid_rrf_calc_bias(spark: SparkSession, sf: str) -> DataFrame:
    """R6 with R7."""
    return R.hybrid(*_lists(spark, sf), _chunks(spark, sf), 8, 2.0)


@query(f"""{_fused_sql_2(1.0).replace("final as (select id, dense_rank, bm25_rank, dual_agreement, round(case when dual_agreement then raw * 1.5 else raw end, 9) as score from fused)", "rrf as (select id, dense_rank, bm25_rank, dual_agreement, round(case when dual_agreement then raw * 1.5 else raw end, 9) as score from fused), final as (select rrf.* replace (round(score * coalesce(quality + 0.5::double, 1.0), 9) as score) from rrf left join labels on doc_id = id)")}, {_ONCE}
    select id, dense_rank, bm25_rank, dual_agreement, score from once where rn = 1 order by score desc, dense_rank nulls last, bm25_rank nulls last, id limit 8""")
def hybrid_memory(spark: SparkSession, sf: str) -> DataFrame:
    """R9 in R10: fused scores times learned weights, those of the labels here."""
    weights = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + 0.5).alias("weight"))
    return R.hybrid(*_lists(spark, sf), _chunks(spark, sf), 8, weights=weights)


@query(f"{_fused_sql_2(1.0)} select round(count_if(dual_agreement) / greatest(1, least(count(dense_rank), count(bm25_rank))), 6) as agreement_ratio from final")
def agreement_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """R11."""
    return R.agreement(R.fuse(*_lists(spark, sf), ["id"]))


@query(rf"""with {_bm25_sql('source')}, q as (select embedding::double[] as qv from embeddings where vec_id = 0),
    dist as (select d.source, vec_id as id, round(1 - list_inner_product(embedding::double[], qv) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product(qv, qv))), 6) as distance from embeddings join documents d on d.doc_id = vec_id, q),
    per as (select greatest(3, 40 // count(distinct source)) as k from documents),
    dense as (select *, row_number() over (partition by source order by distance, id) - 1 as rank0 from dist, per qualify rank0 < k),
    sparse as (select source, id, rank0 from ranked, per where rank0 < k),
    fused as (select coalesce(d.source, s.source) as source, coalesce(d.id, s.id) as id, d.id is not null and s.id is not null as both_lists, coalesce(1.0::double / (61 + d.rank0), 0) + coalesce(1.0::double / (61 + s.rank0), 0) as raw from dense d full join sparse s on d.id = s.id and d.source = s.source)
    select source, id, round(case when both_lists then raw * 1.5 else raw end, 9) as score from fused order by score desc, source, id limit 40""")
def hybrid_all_scope(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over all groups, each giving its share, then one list of forty."""
    chunks = _chunks(spark, sf)
    share = R.per_group(40, chunks.select("source").distinct().count())
    vectors = _vectors(spark, sf).join(chunks.select("id", "source"), "id")
    near = vectors.select("source", "id", F.round(R.cosine_distance(F.col("embedding"), _vector(spark, sf)), 6).alias("distance"))
    dense = R.top(near, [F.col("distance"), F.col("id")], share, ["source"])
    fused = R.fuse(dense, R.sparse_top(chunks, QUERY, share, ["source"]), ["source", "id"])
    return fused.select("source", "id", "score").orderBy(F.col("score").desc(), "source", "id").limit(40)


_TURNS = "select conv_id, turn, text from conversations where role = 'user'"


@query(f"select conv_id, turn, concat_ws(' ', text, case when contains(lower(text), 'anea') then 'ention thanea' end, case when contains(lower(text), 'eaux') then 'leaux ouair' end) as expanded from ({_TURNS})")
def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """R4 over user turns, by terms of the data."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", T.expand_question(F.col("text"), {"anea": "ention thanea", "eaux": "leaux ouair"}).alias("expanded"))


_PAIRS = [("anea", "ention", 5), ("eaux", "leaux", 3), ("th", "tion", 9), ("ver", "zu", 2), ("de", "la", 7), ("er", "re", 1), ("st", "ts", 4)]
_PAIRS_SQL = ", ".join(f"('{a}', '{b}', {n})" for a, b, n in _PAIRS)


@query(f"""with p(original, expansion, hits) as (values {_PAIRS_SQL}), j as (select conv_id, turn, expansion, hits, row_number() over (partition by conv_id, turn order by hits desc, original) as rn from ({_TURNS}) join p on contains(lower(text), original))
    select conv_id, turn, string_agg(expansion, ' ' order by rn) as expansions from j where rn <= 5 group by all""")
def learned_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """A theta join with a handful of learned pairs, the five with most hits."""
    pairs = F.broadcast(spark.createDataFrame(_PAIRS, "original string, expansion string, hits int"))
    turns = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    hit = turns.join(pairs, F.contains(F.lower("text"), F.col("original"))).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("h"), "original", "expansion"))).alias("l"))
    return hit.select("conv_id", "turn", F.array_join(F.transform(F.slice("l", 1, 5), lambda x: x["expansion"]), " ").alias("expansions"))


@query(r"""select conv_id, turn, case when regexp_matches(lower(text), '\b(fy|q[1-4]|fiscal|year|quarter)\s*\d{4}\b|\b20\d{2}\b') then 'temporal'
    when (contains(lower(text), 'the')::int + contains(lower(text), 'le ')::int) > (contains(lower(text), 'ention')::int + contains(lower(text), 'que')::int) then 'simple' else 'complex' end as class from conversations""")
def classify_query(spark: SparkSession, sf: str) -> DataFrame:
    """R14 with phrases of the data."""
    return table(spark, sf, "conversations").select("conv_id", "turn", T.question_class(F.col("text"), ["the", "le "], ["ention", "que"]).alias("class"))


#: Questions and their class by the default phrases, both ways.
CLASSES = [
    ("What was capex in FY2019?", "temporal"), ("revenue of fy2019", "temporal"), ("How did Q2 2020 go?", "temporal"), ("which quarter was best", "complex"), ("q1 results", "complex"), ("What is total revenue?", "simple"), ("Why did revenue fall?", "complex"),
    ("year 2021", "temporal"), ("the year of change", "complex"), ("explain the 2019 trend", "temporal"), ("what was the total of net income", "simple"), ("discuss the outlook and total risk", "complex"), ("in 1999 it was how much", "simple"), ("fiscal1998 sales", "temporal"),
]


@query(stated(CLASSES, "question, class"))
def classify_stated(spark: SparkSession, sf: str) -> DataFrame:
    """R14 on stated cases, one for each document."""
    return cases(spark, sf, CLASSES, ["question"]).withColumn("class", T.question_class(F.col("question")))


@query("""select doc_id::varchar as chunk_id, source as doc_name, n_chars::int as page_num, case when doc_id % 3 = 0 then 'marker' else 'unknown' end as page_num_method, case when doc_id % 4 = 0 then 'table_row' else 'prose' end as chunk_type, text, case when doc_id % 5 = 0 then 'in millions' end as units, 'other' as section_type from documents""")
def typed_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with absent fields and columns."""
    d = F.col("doc_id")
    hits = table(spark, sf, "documents").select(d.cast("string").alias("chunk_id"), F.col("source").alias("doc_name"), F.col("n_chars").cast("int").alias("page_num"), F.when(d % 3 == 0, "marker").alias("page_num_method"), F.when(d % 4 == 0, "table_row").otherwise("").alias("chunk_type"), "text", F.when(d % 5 == 0, "in millions").alias("units"))
    return R.typed_hits(hits)


@query(rf"""with t as (select doc_id, unnest({TOKENS}) as token from documents), h as (select doc_id, ('0x' || left(md5(token), 4))::int % 64 as dim, case when ('0x' || substr(md5(token), 5, 2))::int < 128 then 1 else -1 end as s from t),
    v as (select doc_id, dim, sum(s)::double as v from h group by all), n as (select doc_id, sqrt(sum(v * v)) as n from v group by doc_id) select doc_id, dim, round(v / n, 9) as value from v join n using (doc_id) where v <> 0""")
def embed_hashing(spark: SparkSession, sf: str) -> DataFrame:
    """I4: the default embedding of whole texts, its places that aren't zero."""
    vectors = R.embed(table(spark, sf, "documents").select("doc_id", "text"))
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0").withColumn("value", F.round("value", 9))


@query(f"with {_bm25_sql('source')} select source as doc, id, score from scored")
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    """All positive scores from postings and sizes as they are stored."""
    chunks = _chunks(spark, sf).withColumnRenamed("source", "doc")
    return R.from_postings(R.postings(chunks, ["doc"]), chunks.select("doc", "id", F.size(T.tokens(F.col("text"))).alias("n_tokens")), QUERY)


@query("select conv_id, turn, case when contains(lower(text), 'anea') or contains(lower(text), 'note ') then 'footnote' when contains(lower(text), 'ention') or contains(lower(text), 'que') then 'narrative' else 'simple' end as question_type from conversations")
def question_type(spark: SparkSession, sf: str) -> DataFrame:
    """E13 with phrases of the data."""
    return table(spark, sf, "conversations").select("conv_id", "turn", T.question_type(F.col("text"), ["anea", "note "], ["ention", "que"]).alias("question_type"))


@query("select conv_id, turn, case when contains(lower(text), 'ation') or contains(lower(text), 'ver') then 2.0::double else 1.0::double end as bm25_weight from conversations")
def calculation_weight(spark: SparkSession, sf: str) -> DataFrame:
    """R6."""
    w = F.when(T.contains_any(F.lower("text"), ["ation", "ver"]), F.lit(2.0)).otherwise(F.lit(1.0))
    return table(spark, sf, "conversations").select("conv_id", "turn", w.alias("bm25_weight"))


@query("""with m as (select o_custkey as doc, o_orderpriority as metric, max_by(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) as value from orders group by all),
    kw(nth, keyword, metric) as (values (0, 'urgent', '1-URGENT'), (1, 'low', '5-LOW'), (2, 'medium', '3-MEDIUM')),
    q as (select c_custkey as doc, case c_custkey % 4 when 0 then 'the urgent total' when 1 then 'low and medium' when 2 then 'medium' else 'none of these' end as question from customer),
    k as (select doc, question, arg_min(metric, nth) as metric from q join kw on contains(question, keyword) group by all)
    select k.doc, question, metric, value, 2.0::double as score from k join m using (doc, metric)""")
def cache_fast_path(spark: SparkSession, sf: str) -> DataFrame:
    """The first keyword's latest metric, else nothing."""
    from tessera.operators.learning import latest

    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"), "o_orderdate", "o_orderkey")
    metrics = latest(orders, ["doc", "metric"], ["o_orderdate", "o_orderkey"]).select("doc", "metric", "value")
    nth = F.col("c_custkey") % 4
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"), F.when(nth == 0, "the urgent total").when(nth == 1, "low and medium").when(nth == 2, "medium").otherwise("none of these").alias("question"))
    first = F.when(F.contains("question", F.lit("urgent")), "1-URGENT").when(F.contains("question", F.lit("low")), "5-LOW").when(F.contains("question", F.lit("medium")), "3-MEDIUM")
    return q.withColumn("metric", first).join(metrics, ["doc", "metric"]).select("doc", "question", "metric", "value", F.lit(2.0).alias("score"))


@query("""with q(asked) as (values ('ALL'), (''), ('Customer#000000001'), ('customer#000000002.htm'), ('CUSTOMER#000000003'), ('nobody'))
    select asked, case when trim(asked) in ('', 'ALL') then 'ALL' else coalesce(e.c_name, s.c_name, asked) end as doc from q left join customer e on e.c_name = asked left join customer s on lower(s.c_name) = regexp_replace(lower(asked), '\\.html?$', '')""".replace("\\\\", "\\"))
def resolve_doc(spark: SparkSession, sf: str) -> DataFrame:
    """R16."""
    asked = spark.createDataFrame([("ALL",), ("",), ("Customer#000000001",), ("customer#000000002.htm",), ("CUSTOMER#000000003",), ("nobody",)], "asked string")
    names = table(spark, sf, "customer").select("c_name", F.lower("c_name").alias("low"))
    return asked.join(names, names.low == F.regexp_replace(F.lower("asked"), r"\.html?$", ""), "left").select("asked", F.when(F.trim("asked").isin("", "ALL"), "ALL").otherwise(F.coalesce("c_name", "asked")).alias("doc"))


@query(f"""select doc_id, source, nth::int as nth, array_to_string(list_slice(w, nth * 60 + 1, nth * 60 + 60), ' ') as piece from (select doc_id, source, w, unnest(range(ceil(len(w) / 60.0)::int)) as nth from (select doc_id, source, list_filter(regexp_split_to_array(text, '[\\s]+'), lambda x: x <> '') as w from documents))""")
def word_split(spark: SparkSession, sf: str) -> DataFrame:
    """C1."""
    from tessera.operators.chunking import word_split as split

    return table(spark, sf, "documents").select("doc_id", "source", F.posexplode(split(F.col("text"), 60)).alias("nth", "piece"))


@query("select doc_id, greatest(1, floor(length(text) / 3.5))::int as tokens from documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """I5."""
    from tessera.operators.chunking import token_estimate as estimate

    return table(spark, sf, "documents").select("doc_id", estimate(F.col("text")).alias("tokens"))


@query("""with recursive t as (select source, doc_id, greatest(1, floor(length(text) / 3.5))::int as n, row_number() over (partition by source order by doc_id) as i from documents),
    b as (select source, doc_id, i, n, n::bigint as held, 0 as batch from t where i = 1 union all select t.source, t.doc_id, t.i, t.n, case when b.held + t.n > 20000 then t.n else b.held + t.n end, b.batch + (b.held + t.n > 20000)::int from b join t on t.source = b.source and t.i = b.i + 1) select source, doc_id, n, batch from b""")
def token_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Resetting fold."""
    from tessera.operators.chunking import budget_batches

    return budget_batches(table(spark, sf, "documents"), "source", "doc_id", 20_000)
