"""Analytics and maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import intelligence as K
from tessera.operators import maintenance as M
from tessera.plans.registry import cases, query, stated, table

#: Vocabularies that occur in the data.
CONFIDENT, HEDGING = ["the", "ent", "que"], ["anea", "or", "eu"]


def _occurs(word: str) -> str:
    return f"((length(lower(text)) - length(replace(lower(text), '{word}', ''))) // {len(word)})"


def _per_thousand(words: list[str]) -> str:
    return f"({' + '.join(_occurs(w) for w in words)}) * 1000.0::double / greatest(1, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')))"


@query(f"select doc_id, case when length(text) < 50 then 50 else greatest(0, least(100, trunc(50 + 2 * ({_per_thousand(CONFIDENT)} - {_per_thousand(HEDGING)}))::int)) end as tone from documents")
def tone_score(spark: SparkSession, sf: str) -> DataFrame:
    """K1."""
    return table(spark, sf, "documents").select("doc_id", K.tone(F.col("text"), CONFIDENT, HEDGING).alias("tone"))


@query("""with s as (select source as doc, doc_id as seq, text, doc_id % 7 = 3 as is_table, max(contains(lower(text), 'anea')::int) over (partition by source order by doc_id) as begun from documents),
    b as (select *, coalesce(sum(length(text) + 1) over (partition by doc order by seq rows between unbounded preceding and 1 preceding), 0) as bef from s where begun = 1 and not is_table)
    select doc, string_agg(text, ' ' order by seq) as text from b where bef - 1 <= 20000 group by doc""")
def mda_extract(spark: SparkSession, sf: str) -> DataFrame:
    """K2 with documents as segments of their source, some of them tables."""
    segments = table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("seq"), "text", (F.col("doc_id") % 7 == 3).alias("is_table"))
    return K.discussion(segments, ["anea"])


_YEARS = """y as (select o_custkey % 500 as company, year(o_orderdate) as yr, sum(o_totalprice) as revenue, sum(case when o_orderstatus = 'O' then o_totalprice else 0 end) as ar, count(*) as segments from orders group by all),
    p as (select a.company, a.yr, a.revenue, b.revenue as revenue_prior, a.ar, b.ar as ar_prior, a.segments, b.segments as segments_prior, a.revenue - b.revenue as net_income, b.ar - a.ar as ocf from y a left join y b on b.company = a.company and b.yr = a.yr - 1)"""


def _years(spark: SparkSession, sf: str) -> DataFrame:
    open_ = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0)
    y = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 500).alias("company"), F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("revenue"), F.sum(open_).alias("ar"), F.count("*").alias("segments"))
    prior = y.select("company", (F.col("yr") + 1).alias("yr"), *[F.col(c).alias(f"{c}_prior") for c in ("revenue", "ar", "segments")])
    return y.join(prior, ["company", "yr"], "left").withColumn("net_income", F.col("revenue") - F.col("revenue_prior")).withColumn("ocf", F.col("ar_prior") - F.col("ar"))


@query(f"""with {_YEARS}, r as (
    select company || '.' || yr as filing, 'receivables' as rule, 'medium' as severity from p where ar <> 0 and ar_prior <> 0 and revenue <> 0 and revenue_prior <> 0 and (ar - ar_prior) / abs(ar_prior) > (revenue - revenue_prior) / abs(revenue_prior) + 0.05
    union all select company || '.' || yr, 'cash_conversion', 'high' from p where net_income > 0 and ocf < 0
    union all select company || '.' || yr, 'segments', 'low' from p where segments <> segments_prior) select * from r""")
def red_flags(spark: SparkSession, sf: str) -> DataFrame:
    """K3 over the totals of every company and year."""
    years = _years(spark, sf).withColumn("filing", F.concat_ws(".", F.col("company").cast("string"), F.col("yr").cast("string")))
    return K.red_flags(years, "filing")


@query("""with v as (select o_orderkey as k, 'orders' as section, 0 as ord, o_totalprice as value from orders union all select l_orderkey, 'lines', 1, round(sum(l_extendedprice * (1 - l_discount)), 2) from lineitem group by l_orderkey union all select l_orderkey, 'gross', 2, round(sum(l_extendedprice), 2) from lineitem group by l_orderkey),
    p as (select a.k, a.section as section_a, b.section as section_b, abs(a.value - b.value) / greatest(a.value, b.value) as gap from v a join v b on a.k = b.k and a.ord < b.ord where a.value > 0 and b.value > 0)
    select k, section_a, section_b, round(gap * 100, 2) as pct, case when gap > 0.02 then 'high' else 'medium' end as severity from p where gap > 0.005""")
def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """K6: totals against sums of lines."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("orders").alias("section"), F.lit(0).alias("ord"), F.col("o_totalprice").alias("value"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_extendedprice").alias("gross"), *place)
    of = lambda section, ord_, c: F.struct(F.lit(section).alias("section"), F.lit(ord_).alias("ord"), K.rounded(F.col(c), 2).alias("value"))
    sums = K.sums_in_order(lines, ["k"], ["file", "row"], ["net", "gross"]).select("k", F.inline(F.array(of("lines", 1, "net"), of("gross", 2, "gross"))))
    return K.contradictions(orders.union(sums), ["k"])


#: Text beside each document's own, and the value of the metric in it: the first pattern with a number near wins; years and words count as they stand.
VALUES = [
    ("Net sales were $1,250.5 million in the year.", 1250500000.0), ("net   sales of many kinds; total revenue: 12 thousand", 12000.0), ("No metric stands here, 55 times.", None), ("Revenues rose. " + "x" * 120 + " 77", None),
    ("About 3 billion of total revenue", 3e9), ("revenue 8 and net sales 9", 8.0), ("In all, 40 of them. " + "y" * 90 + " net sales 5", 5.0), ("total revenue , was 6,5 Million", None), ("total revenue was 6,5 Million", 65000000.0),
]
_METRIC = ["net\\s+sales", "total\\s+revenue", "revenues?"]


@query(stated(VALUES, "text, value"))
def extract_value(spark: SparkSession, sf: str) -> DataFrame:
    """K5 on stated cases, one for each document."""
    return cases(spark, sf, VALUES, ["text"]).withColumn("value", K.value_near(F.col("text"), _METRIC))


@query(r"""with w as (select doc_id, lower(text) as low, text, strpos(lower(text), 'the') as pos from documents),
    x as (select doc_id, substr(text, greatest(1, pos - 100), pos + 3 + 100 - greatest(1, pos - 100)) as win from w where pos > 0)
    select doc_id, try_cast(trim(replace(replace(regexp_extract(win, '(?i)\b(\$?\s*[0-9,]+(?:\.[0-9]+)?)\s*(million|billion|thousand)?\b', 1), ',', ''), '$', '')) as double) as value from x""")
def value_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """K5 over whole texts: the number near a frequent word."""
    return table(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", K.value_near(F.col("text"), ["the"]).alias("value"))


@query("""select source as doc, case when contains(lower(text), 'anea') then 'mda' when contains(lower(text), 'ention') then 'notes' when contains(lower(text), 'que') then 'segment' else 'other' end as section, string_agg(text, ' ' order by doc_id) as text from documents group by all""")
def section_texts(spark: SparkSession, sf: str) -> DataFrame:
    """K4: the ordered text of each section of each source."""
    segments = table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("seq"), "text")
    return K.section_texts(segments, {"mda": ["anea"], "notes": ["ention"], "segment": ["que"]})


@query("""with c as (select distinct o_custkey as doc from orders), t as (select o_custkey as doc, (sum(o_orderkey) % 101)::int as tone from orders where o_custkey % 3 > 0 group by all), e as (select o_custkey as doc, (count(*) % 4)::double / 2 as r from orders where o_custkey % 5 > 0 group by all),
    sev as (select o_custkey as doc, o_orderstatus as s, case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' else 'low' end as severity from orders),
    n as (select doc, count_if(s = 'P') as nf, count_if(s = 'F') as nc, count_if(s = 'O') as na, count_if(s = 'P' and severity = 'critical') as fc, count_if(s = 'P' and severity = 'high') as fh, count_if(s = 'P' and severity = 'medium') as fm, count_if(s = 'F' and severity = 'critical') as cc, count_if(s = 'F' and severity = 'high') as ch, count_if(s = 'F' and severity = 'medium') as cm from sev group by doc),
    x as (select doc, coalesce(tone, 50) as tone, nf, nc, na, greatest(0, least(100, trunc(round(0.30 * least(100, trunc(greatest(0.0, coalesce(r, 1.0)) / 1.5 * 100)::int) + 0.25 * coalesce(tone, 50) + 0.25 * greatest(0, 100 - 30 * cc - 15 * ch - 7 * cm) + 0.20 * greatest(0, 100 - 25 * fc - 10 * fh - 5 * fm), 6))::int)) as score from c left join t using (doc) left join e using (doc) left join n using (doc))
    select doc, 'complete' as status, tone, nf as n_flags, nc as n_contradictions, na as n_anomalies, score, case when score >= 75 then 'high' when score >= 55 then 'moderate' when score >= 35 then 'low' else 'very low' end as label from x""")
def intelligence_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Analytics of each customer, by orders that stand for flags, contradictions and anomalies."""
    doc, p = F.col("o_custkey").alias("doc"), F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low").alias("severity")
    orders = table(spark, sf, "orders")
    of = lambda s: orders.filter(F.col("o_orderstatus") == s).select(doc, severity)
    tones = orders.filter("o_custkey % 3 > 0").groupBy(doc).agg((F.sum("o_orderkey") % 101).cast("int").alias("tone"))
    ocf = orders.filter("o_custkey % 5 > 0").groupBy(doc).agg((F.count("*") % 4 / 2).alias("ocf_ratio"))
    return K.profile(orders.select(doc), tones, of("P"), of("F"), of("O"), ocf)


@query("select source, case when contains(lower(text), 'anea') then 'mda' when contains(lower(text), 'ention') then 'notes' when contains(lower(text), 'que') then 'segment' else 'other' end as section, count(*) as n from documents group by all")
def section_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """K4."""
    return table(spark, sf, "documents").groupBy("source", K.section(F.col("text"), {"mda": ["anea"], "notes": ["ention"], "segment": ["que"]}).alias("section")).agg(F.count("*").alias("n"))


_HISTORY = "h as (select o_custkey as company, o_orderpriority as metric, year(o_orderdate) as yr, max(o_totalprice) as value from orders group by all)"


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("yr")).agg(F.max("o_totalprice").alias("value"))


@query(f"with {_HISTORY} select company, metric, min(value) as low, max(value) as high, round(avg(value), 6) as mean, count(*) as n from h where yr < 2000 group by all having n >= 2")
def metric_range(spark: SparkSession, sf: str) -> DataFrame:
    """K7, L10."""
    return K.metric_range(_history(spark, sf).filter("yr < 2000"), ["company", "metric"]).withColumn("mean", F.round("mean", 6))


@query(f"""with {_HISTORY}, r as (select company, metric, min(value) as low, max(value) as high, avg(value) as mean, count(*) as n from h where yr < 2000 group by all having n >= 2)
    select company, metric, value, round(abs(value - mean) / case when mean = 0 then 1 else abs(mean) end * 100, 1) as deviation, case when round(abs(value - mean) / case when mean = 0 then 1 else abs(mean) end * 100, 1) > 25 then 'high' else 'medium' end as severity
    from h join r using (company, metric) where yr = 2000 and (value < low - (high - low) * 0.1 or value > high + (high - low) * 0.1)""")
def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """K8."""
    h = _history(spark, sf)
    return K.anomalies(h.filter("yr = 2000"), K.metric_range(h.filter("yr < 2000"), ["company", "metric"]), ["company", "metric"]).select("company", "metric", "value", "deviation", "severity")


@query("""with c as (select o_custkey as company, count_if(o_orderpriority = '1-URGENT') as c, count_if(o_orderpriority = '2-HIGH') as h, count_if(o_orderpriority = '3-MEDIUM') as m, count_if(o_orderstatus = 'P') as fc, count_if(o_orderstatus = 'F') as fm, count(*) as n from orders group by all),
    s as (select company, greatest(0, least(100, trunc(round(0.30 * least(100, trunc(greatest(0.0, (n % 4)::double / 2) / 1.5 * 100)::int) + 0.25 * (company % 101) + 0.25 * greatest(0, 100 - 30 * c - 15 * h - 7 * m) + 0.20 * greatest(0, 100 - 25 * fc - 5 * fm), 6))::int)) as score from c)
    select company, score, case when score >= 75 then 'high' when score >= 55 then 'moderate' when score >= 35 then 'low' else 'very low' end as label from s""")
def conviction(spark: SparkSession, sf: str) -> DataFrame:
    """K9."""
    of = lambda col, v: F.count_if(F.col(col) == v)
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("company")).agg(
        of("o_orderpriority", "1-URGENT").alias("c"), of("o_orderpriority", "2-HIGH").alias("h"), of("o_orderpriority", "3-MEDIUM").alias("m"), of("o_orderstatus", "P").alias("fc"), of("o_orderstatus", "F").alias("fm"), F.count("*").alias("n")
    )
    score = K.conviction((F.col("n") % 4) / 2, F.col("company") % 101, (F.col("c"), F.col("h"), F.col("m")), (F.col("fc"), F.lit(0), F.col("fm")))
    return c.select("company", score.alias("score")).withColumn("label", K.conviction_label(F.col("score")))


@query("select doc_id from (select doc_id, row_number() over (partition by lang, text order by doc_id) as rn from documents) where rn > 1")
def dedupe_count(spark: SparkSession, sf: str) -> DataFrame:
    """M1."""
    return M.duplicates(table(spark, sf, "documents").select("lang", "text", "doc_id"), ["lang", "text"], "doc_id").select("doc_id")


@query("select min(doc_id) as doc_id, lang from documents group by lang, text")
def dedupe_keep(spark: SparkSession, sf: str) -> DataFrame:
    """M2."""
    return M.without_duplicates(table(spark, sf, "documents").select("lang", "text", "doc_id"), ["lang", "text"], "doc_id").select("doc_id", "lang")


@query("select lang, count(*) as total, count(*) - count(distinct text) as duplicates from documents group by lang having duplicates > 0 order by duplicates desc, lang limit 20")
def dedupe_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    """M3: a report of at most twenty groups."""
    return M.duplicates_by(table(spark, sf, "documents"), "lang", "text")


@query("select doc_id, coalesce(quality, n_chars::int) as page_num from documents left join labels using (doc_id)")
def reparse_update(spark: SparkSession, sf: str) -> DataFrame:
    """M5."""
    stored = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("int").alias("page_num"))
    return M.update_pages(stored, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("page_num")), "doc_id")


@query("select doc_id from documents where doc_id in (select doc_id from labels) and doc_id not in (select item_id from benchmark) and doc_id not in (select vec_id from embeddings where label = 1)")
def ingest_selection(spark: SparkSession, sf: str) -> DataFrame:
    """M8: a semi and two anti joins."""
    reserved = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    indexed = table(spark, sf, "embeddings").filter("label = 1").select(F.col("vec_id").alias("doc_id"))
    return M.select_ingest(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), reserved, indexed, "doc_id")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def migrate_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """S13."""
    return M.migrate(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("select distinct source as doc_name from documents")
def list_docs(spark: SparkSession, sf: str) -> DataFrame:
    """S14."""
    from tessera.sources.files import document_names

    return document_names(table(spark, sf, "documents").withColumnRenamed("source", "doc_name"))


@query("select doc_id, case when toxic is null then 'pending' else 'done' end as status from documents left join labels using (doc_id)")
def intel_pending(spark: SparkSession, sf: str) -> DataFrame:
    """S5, K10."""
    done = table(spark, sf, "labels").select("doc_id", F.lit("done").alias("status"))
    return M.with_status(table(spark, sf, "documents").select("doc_id"), done, "doc_id")
