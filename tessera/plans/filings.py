"""Parsing, paging, table and chunk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answering as A
from tessera.operators import chunking as C
from tessera.operators import dom as D
from tessera.operators import filings as P
from tessera.plans.registry import cases, query, stated, table

# Stated cases: what the operators must say, written from the survey and not from the code. Each document of the table gets one of them.

#: Cell text, whether numeric, normalised, whether a spacer.
CELLS = [
    ("(2,345)", True, "-2345", False), ("(2,345", True, "(2345", False), ("$ 1,204", True, " 1204", False), ("$1,204.50", True, "1204.50", False), ("12.5%", True, "12.5%", False), ("-", False, "-", False), ("\u2014", False, "\u2014", False),
    ("$", False, "", True), ("", False, "", True), (" ", False, "", True), ("%", False, "%", True), (")", False, ")", False), ("Net sales", False, "Net sales", False), ("-42", True, "-42", False), ("+42", False, "+42", False), ("$(77.5)", True, "-77.5", False), ("see (3)", False, "-3", False),
]
HEADINGS_ = [
    ("Consolidated Statements of Income", "income_statement", "income_statement"), ("Consolidated Statements of Cash Flows", "cash_flow", "cash_flow"), ("Consolidated Balance Sheets", "balance_sheet", "balance_sheet"), ("Notes to Financial Statements", "other", "other"),
    ("Statement of Income", "income_statement", "income_statement"), ("Consolidated Statement of Financial Position", "balance_sheet", "balance_sheet"), ("CONSOLIDATED STATEMENTS OF OPERATIONS", "income_statement", "income_statement"),
    ("See Consolidated Statement of Cash Flows for detail", "cash_flow", "other"), ("See the balance sheet", "balance_sheet", "other"), ("Statement of operations and balance sheet", "income_statement", "income_statement"), ("Balance sheet and statement of cash flows", "cash_flow", "balance_sheet"),
    ("Management's discussion of financial condition", "other", "other"), ("Cash Flows from Operations", "other", "other"), ("  cash flow statement", "cash_flow", "cash_flow"), ("Income statement", "other", "other"),
]
UNITS = [("(in millions, except per share)", "in millions"), ("Amounts in thousands", "in thousands"), ("in  billions", "in billions"), ("In Millions", "in millions"), ("invested millions", None), ("dollars in million", None), ("in thousands, then in millions", "in thousands")]
PAGES = [("see page 17 of 20", 17), ("text\n 42 \nmore", 42), ("page 0\n7", 0), ("no number 5 here", None), ("1000", None), ("Page 999", 999), ("Page 1204", 1204), ("0\nx\n 8 \n", 8), ("61", 61), ("pages 3", None)]
NAMES = [("ACME_2022_10K", "ACME", 2022, None, "annual", "10K"), ("acme_2023Q2_10Q.htm", "ACME", 2023, 2, "quarterly", "10Q"), ("A_B_2021_8-K.html", "A_B", 2021, None, "annual", "8-K"), ("notes", "notes", 0, None, "unknown", "unknown"), ("x.html", "x", 0, None, "unknown", "unknown")]


@query(f"select * from ({stated(CELLS, 'cell, is_numeric, number, spacer')}) union all select l_orderkey * 10 + l_linenumber, '(' || l_quantity::bigint || ')', true, '-' || l_quantity::bigint, false from lineitem")
def numeric_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Stated cells, and quantities written as accounting text."""
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.concat(F.lit("("), F.col("l_quantity").cast("long").cast("string"), F.lit(")")).alias("text"))
    c = F.col("text")
    return cases(spark, sf, CELLS, ["text"]).union(lines).select("doc_id", c.alias("cell"), T.is_numeric(c).alias("is_numeric"), T.accounting_number(c).alias("number"), T.is_spacer(c).alias("spacer"))


@query(stated(HEADINGS_, "heading, broad, strict"))
def statement_type(spark: SparkSession, sf: str) -> DataFrame:
    """P17, both directions."""
    c = F.col("text")
    return cases(spark, sf, HEADINGS_, ["text"]).select("doc_id", c.alias("heading"), T.statement_type(c).alias("broad"), T.statement_type(c, strict=True).alias("strict"))


@query(stated(UNITS, "heading, units"))
def unit_headers(spark: SparkSession, sf: str) -> DataFrame:
    """P14."""
    return cases(spark, sf, UNITS, ["text"]).select("doc_id", F.col("text").alias("heading"), T.unit_header(F.col("text")).alias("units"))


@query(stated(PAGES, "text, page"))
def printed_page(spark: SparkSession, sf: str) -> DataFrame:
    """P22."""
    return cases(spark, sf, PAGES, ["text"]).select("doc_id", "text", T.printed_page(F.col("text")).alias("page"))


@query(stated(NAMES, "name, company, fiscal_year, fiscal_quarter, period_type, filing_type"))
def document_names(spark: SparkSession, sf: str) -> DataFrame:
    """P23, D10."""
    return cases(spark, sf, NAMES, ["text"]).select("doc_id", F.col("text").alias("name"), *[c.alias(k) for k, c in T.document_name(F.col("text")).items()])


@query("""with e as (select user_id as doc, event_id as seq, event_type in ('error', 'signup') as brk from events), n as (select doc, count_if(brk) as b from e group by doc)
    select doc, seq, case when b >= 5 then 'marker' else 'word_count' end as page_method, (1 + sum(brk::int) over (partition by doc order by seq rows unbounded preceding))::bigint as page from e join n using (doc)""")
def pages_marker(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and sign-ups as page breaks of a user's events."""
    style = F.when(F.col("event_type").isin("error", "signup"), "page-break-before: always").otherwise("color: red")
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), style.alias("style"))
    return e.join(P.page_method(e), "doc").select("doc", "seq", "page_method", P.marker_page(P.is_break(F.col("style"))).alias("page"))


_LINES = "l as (select doc_id as doc, unnest(range(len(string_split(text, chr(10)))))::int as seq, unnest(string_split(text, chr(10))) as line from documents)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))


@query(f"with {_LINES} select doc, seq, greatest(1, floor(sum(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''))) over (partition by doc order by seq rows unbounded preceding) / 550)::int + 1) as page from l")
def pages_wordcount(spark: SparkSession, sf: str) -> DataFrame:
    """P5: a document's lines as segments."""
    return _lines(spark, sf).select("doc", "seq", P.word_page(F.size(T.words(F.col("line")))).alias("page"))


@query("""with f as (select l_suppkey as doc, l_linenumber as page, l_orderkey as seq, case when l_suppkey % 3 = 0 then l_linenumber + 7 else (l_orderkey % 9)::int end as number from lineitem),
    l as (select doc, page, max_by(number, seq) as number from f group by all),
    o as (select a.doc, min_by(a.number - a.page, a.page) as off from l a join l b on b.doc = a.doc and b.page = a.page + 1 and b.number = a.number + 1 join l c on c.doc = a.doc and c.page = a.page + 2 and c.number = a.number + 2 group by a.doc)
    select doc, coalesce(off, 0) as page_offset from (select distinct doc from l) left join o using (doc)""")
def page_offset(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's lines as pages with printed numbers."""
    number = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber") + 7).otherwise((F.col("l_orderkey") % 9).cast("int"))
    return P.page_offset(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("seq"), number.alias("number")))


@query("select user_id as doc, event_id as seq, last_value(case event_type when 'purchase' then 'in millions' when 'signup' then 'in thousands' end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as units from events")
def units_locf(spark: SparkSession, sf: str) -> DataFrame:
    """Units carried forward over a user's events."""
    text = F.when(F.col("event_type") == "purchase", "(in millions)").when(F.col("event_type") == "signup", "amounts in thousands").otherwise("")
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), T.unit_header(text).alias("own"))
    return e.select("doc", "seq", P.carried(F.col("own"), "doc", "seq").alias("units"))


@query("""with e as (select user_id as doc, event_id as seq, case event_type when 'purchase' then 'balance_sheet' when 'signup' then 'cash_flow' else 'other' end as named, floor(value / 10)::int + (event_id / 400)::int as page from events),
    w as (select *, last_value(case when named <> 'other' then named end ignore nulls) over o as s, last_value(case when named <> 'other' then page end ignore nulls) over o as p from e window o as (partition by doc order by seq rows unbounded preceding))
    select doc, seq, case when page - p <= 1 then s else 'other' end as section from w""")
def section_asof_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """The section in force expires after a page."""
    named = F.when(F.col("event_type") == "purchase", "balance_sheet").when(F.col("event_type") == "signup", "cash_flow").otherwise("other")
    page = F.floor(F.col("value") / 10).cast("int") + F.rint(F.col("event_id") / 400).cast("int")
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), named.alias("named"), page.alias("page"))
    return e.select("doc", "seq", P.section_in_force(F.col("named"), F.col("page"), "doc", "seq").alias("section"))


#: A table for each order: a header row of years with spans, then a row for each line.
_GRID = """li as (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_returnflag) as l_returnflag from lineitem group by all), c as (select l_orderkey as t, 0 as row_idx, 0 as cell_idx, 'Item' as text, 1 as colspan from li group by l_orderkey
    union all select l_orderkey, 0, 1, '1998', 1 + (l_orderkey % 2)::int from li group by l_orderkey union all select l_orderkey, 0, 2, '1999', 2 from li group by l_orderkey
    union all select l_orderkey, l_linenumber, 0, 'Line ' || l_linenumber, 1 from li union all select l_orderkey, l_linenumber, 1, case when l_linenumber % 2 = 0 then '$' else '' end, 1 from li
    union all select l_orderkey, l_linenumber, 2, '(' || l_quantity::bigint || ')', 1 from li union all select l_orderkey, l_linenumber, 3, l_returnflag, 3 from li),
    k as (select *, coalesce(sum(colspan) over (partition by t, row_idx order by cell_idx rows between unbounded preceding and 1 preceding), 0)::int as col, text in ('', '$', '%') as spacer from c)"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("t"), "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"))
    cell = lambda i, text, span: F.struct(F.lit(i).alias("cell_idx"), text.alias("text"), span.cast("int").alias("colspan"))
    head = line.select("t").distinct().select("t", F.lit(0).alias("row_idx"), F.inline(F.array(cell(0, F.lit("Item"), F.lit(1)), cell(1, F.lit("1998"), 1 + F.col("t") % 2), cell(2, F.lit("1999"), F.lit(2)))))
    n = F.col("l_linenumber")
    body = line.select("t", n.alias("row_idx"), F.inline(F.array(cell(0, F.concat(F.lit("Line "), n.cast("string")), F.lit(1)), cell(1, F.when(n % 2 == 0, "$").otherwise(""), F.lit(1)), cell(2, F.concat(F.lit("("), F.col("l_quantity").cast("long").cast("string"), F.lit(")")), F.lit(1)), cell(3, F.col("l_returnflag"), F.lit(3)))))
    return head.union(body)


@query(f"with {_GRID} select t, row_idx, cell_idx, col, spacer from k")
def colspan_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """P8, P9."""
    return P.logical_columns(_grid(spark, sf), ["t"]).select("t", "row_idx", "cell_idx", "col", "spacer")


@query(r"select l_orderkey as t, coalesce(min(case when l_linenumber <= 5 and l_quantity between 19 and 20 then l_linenumber end), 0) as header_row from lineitem group by l_orderkey")
def header_row(spark: SparkSession, sf: str) -> DataFrame:
    """P10: a line with quantity 19 or 20 has a year."""
    text = F.when(F.col("l_quantity").between(19, 20), F.concat(F.lit("FY "), F.col("l_quantity").cast("long").cast("string"), F.lit("21"))).otherwise("none")
    return P.header_rows(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("row_idx"), text.alias("text")), ["t"])


@query(rf"""with {_GRID}, h as (select t, col, col + colspan as stop, text as head from k where row_idx = 0 and not spacer),
    b as (select *, row_number() over (partition by t, row_idx order by cell_idx) as nth, first_value(text) over (partition by t, row_idx order by cell_idx) as row_label from k where row_idx > 0 and not spacer)
    select b.t, row_idx, cell_idx, row_label, coalesce(head, 'col_' || b.col) as column_header, case when text like '(%' then '-' || trim(text, '()') else text end as value_text, case when text like '(%' then -trim(text, '()')::double end as value_numeric
    from b left join h on h.t = b.t and h.col <= b.col and b.col < h.stop where nth > 1""")
def table_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Values and their headers by interval."""
    return P.table_facts(_grid(spark, sf), ["t"])


_FACTS = """f as (select l_orderkey % 200 as doc, l_orderkey * 100 + l_linenumber * 10 + m as fact_id, ['income_statement', 'balance_sheet', 'cash_flow'][m] as statement_type, 'Part ' || l_partkey as row_label, case when l_linenumber % 3 = 0 then null else 'FY' || year(l_shipdate) end as column_header,
    case m when 1 then l_quantity when 2 then l_extendedprice else l_tax end::decimal(18, 2)::varchar as value_text, case when l_linenumber % 2 = 0 then 'in millions' end as units, l_linenumber as page_num from lineitem, (values (1), (2), (3)) v(m))"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    part = lambda m, s, v: F.struct((F.col("l_orderkey") * 100 + n * 10 + m).alias("fact_id"), F.lit(s).alias("statement_type"), F.col(v).cast("decimal(18,2)").cast("string").alias("value_text"))
    wide = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).alias("doc"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("row_label"), F.when(n % 3 != 0, F.concat(F.lit("FY"), F.year("l_shipdate").cast("string"))).alias("column_header"), F.when(n % 2 == 0, "in millions").alias("units"), n.alias("page_num"), F.array(part(1, "income_statement", "l_quantity"), part(2, "balance_sheet", "l_extendedprice"), part(3, "cash_flow", "l_tax")).alias("p"))
    return wide.select("doc", "row_label", "column_header", "units", "page_num", F.inline("p"))


@query(f"with {_FACTS} select doc, fact_id, statement_type, row_label, column_header, value_text, units, page_num from f")
def facts_long(spark: SparkSession, sf: str) -> DataFrame:
    """P13's long table, unpivoted."""
    return _facts(spark, sf)


#: Each document's question, and what it needs.
_ASKED = [("How did debt and dividends develop?", ["balance_sheet", "cash_flow"]), ("What drove revenue?", ["income_statement"]), ("Who chairs the board?", [])]


@query(f"""with {_FACTS}, q(k, statement_type) as (values (0, 'balance_sheet'), (0, 'cash_flow'), (1, 'income_statement'))
    select doc, fact_id, statement_type, value_text from f semi join q on k = doc % 3 and q.statement_type = f.statement_type""")
def facts_statement(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the statements that a question about each document asks for; none for one that needs no statement."""
    facts = _facts(spark, sf)
    asked = facts.select("doc").distinct().select("doc", F.element_at(F.array(*[F.lit(q) for q, _ in _ASKED]), (F.col("doc") % 3 + 1).cast("int")).alias("question"))
    return A.facts_for(facts, asked).select("doc", "fact_id", "statement_type", "value_text")


@query(f"""with {_FACTS}, p as (select doc, statement_type, page_num, row_number() over (partition by doc, statement_type order by count(*) desc, page_num) as rn from f group by doc, statement_type, page_num),
    u as (select doc, statement_type, min_by(units, fact_id) filter (units is not null) as units, string_agg(line, chr(10) order by fact_id, line) as lines from (select *, row_label || ' | ' || coalesce(column_header, '') || ' | ' || value_text as line from f) group by doc, statement_type)
    select u.doc, u.statement_type, page_num, u.statement_type || coalesce(' (' || units || ')', '') || chr(10) || lines as block from u join p on p.doc = u.doc and p.statement_type = u.statement_type and rn = 1""")
def facts_format(spark: SparkSession, sf: str) -> DataFrame:
    """F3, D16."""
    return A.facts_table(_facts(spark, sf), ["doc"])


def _dom(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc"), "html")
    return D.dom(pages, spark.sparkContext.defaultParallelism)


@query(r"select page_id::varchar as doc, count(*) as n from (select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>', '', 'g'), '(?i)<h1[\s>]')) from pages) group by all")
def html_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Main headings of each page, scripts and styles dropped."""
    return _dom(spark, sf).filter("tag = 'h1'").groupBy("doc").agg(F.count("*").alias("n"))


def _numbered(segments: DataFrame) -> DataFrame:
    """Segments by their place in the document."""
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("seq", "sub")).alias("n")
    return segments.select("doc", nth, "kind", "text", "page", "page_method", "units", "section", "footnote_id")


#: The pages' own markup: lists, divisions and paragraphs without others inside; open paragraphs end where the next begins.
_PAGE_SEGMENTS = r"""plain as (select page_id::varchar as doc, regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') as html from pages),
    found as (select doc, regexp_extract_all(html, '(?is)<(?:p|li|div|span)(?:\s[^>]*)?>(?:[^<]|<(?:/?(?:b|i|a|em|br|strong|u|small|code|h[1-6])\b)[^>]*>)*', 0) as parts from plain),
    piece as (select doc, unnest(parts) as part, generate_subscripts(parts, 1) as i from found),
    clean as (select doc, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) as text from piece),
    s as (select doc, row_number() over (partition by doc order by i) as n, text, sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) over (partition by doc order by i rows unbounded preceding) as words from clean where length(text) >= 2)"""


@query(f"with {_PAGE_SEGMENTS} select doc, n::int as n, 'prose' as kind, text, (words // 550 + 1)::int as page, 'word_count' as page_method, null::varchar as units, 'other' as section, null::varchar as footnote_id from s")
def html_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The segments of pages."""
    return _numbered(P.segments(_dom(spark, sf)))


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    """A filing for each order: prose, a statement with a line for each item, a note with its definition, and a printed page for each item."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("i"))
    n = F.col("i").cast("string")
    row = F.concat(F.lit("<tr><td>Line "), n, F.lit("</td><td>$</td><td>("), F.col("l_quantity").cast("long").cast("string"), F.lit(")</td><td colspan=3>"), F.col("l_returnflag"), F.lit("</td></tr>"))
    page = F.concat(F.lit("<p>What page "), n, F.lit(" says.<div><p>"), (F.col("i") + 10).cast("string"), F.lit('</p></div><hr style="page-break-after: always">'))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", c.alias("x")))), lambda s: s["x"]), "")
    o = line.groupBy("l_orderkey").agg(joined(row).alias("rows"), joined(page).alias("pages"))
    start = "<html><body><p>See the consolidated balance sheets (1) and (2).</p><h2>Consolidated Statements of Income</h2><div>Amounts in thousands</div><table><tr><td></td></tr><tr><td>Item</td><td colspan=2>1998</td><td>1999</td></tr>"
    end = "<p><b>Consolidated Balance Sheets</b></p><table><tr><td>Total</td><td>7</td></tr><tr><td>Rest</td><td>2,000</td></tr></table><pre>Notes:\n2. what the second note has to say\n1) short\n</pre>"
    html = F.concat(F.lit(start), "rows", F.lit("</table><ul><li>(2) as told</li><li>(3) is nowhere</li></ul>"), "pages", F.lit(end))
    return o.select(F.concat(F.lit("ORDER_1998_"), F.col("l_orderkey").cast("string")).alias("doc"), html.alias("html"))


#: Each segment with its place: ``a`` orders the parts of a filing, ``b`` the lines in one.
_FILING = """li as (select l_orderkey as o, l_quantity::bigint as q, l_returnflag as f, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i from lineitem),
    t as (select o, count(*) as m, count(*) >= 5 as marked from li group by o),
    r as (select o, 0 as a, 0 as b, 'prose' as kind, 'See the consolidated balance sheets (1) and (2).' as text, 1 as page, null as units, 'other' as section from t
    union all select o, 1, 0, 'prose', 'Amounts in thousands', 1, 'in thousands', 'other' from t
    union all select o, 2, i * 2 + x, 'table_row', 'Line ' || i || ', ' || case x when 0 then '1998: -' || q else '1999: ' || f end || ' (in thousands)', 1, 'in thousands', 'income_statement' from li, (values (0), (1)) y(x)
    union all select o, 3, 0, 'footnote', '(2) as told', 1, 'in thousands', 'other' from t union all select o, 4, 0, 'prose', '(3) is nowhere', 1, 'in thousands', 'other' from t
    union all select o, 5, i * 2 + x, 'prose', case x when 0 then 'What page ' || i || ' says.' else '' || (i + 10) end, case when marked then i else 1 end, 'in thousands', 'other' from li join t using (o), (values (0), (1)) y(x)
    union all select o, 6, 0, 'prose', 'Consolidated Balance Sheets', case when marked then m + 1 else 1 end, 'in thousands', 'other' from t
    union all select o, 7, 0, 'table_row', 'Rest, 7: 2000 (in thousands)', case when marked then m + 1 else 1 end, 'in thousands', 'balance_sheet' from t)"""


@query(f"""with {_FILING} select 'ORDER_1998_' || o as doc, row_number() over (partition by o order by a, b)::int as n, kind, text, (page + case when marked then 10 else 0 end)::int as page, case when marked then 'marker' else 'word_count' end as page_method, units, section, case when kind = 'footnote' then '2' end as footnote_id from r join t using (o)""")
def filing_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Whole filings made of orders, with breaks, printed pages, units, sections, tables and notes."""
    return _numbered(P.segments(D.dom(_filings(spark, sf), said=True)))


@query(f"""with {_FILING}, s as (select *, row_number() over (partition by o order by a, b) as n from r),
    p as (select o, 0 as nth, string_agg(text, ' ' order by n) as text, min(page) as page from s where a < 2 group by o
    union all select o, 1, string_agg(text, ' ' order by n), min(page) from s where a in (0, 1, 4, 5, 6) group by o)
    select 'ORDER_1998_' || o as doc, 'ORDER_1998_' || o || '::' || kind || '::' || nth as chunk_id, kind as chunk_type, text, (page + case when marked then 10 else 0 end)::int as page, section from (
    select o, 'prose' as kind, nth, text, page, 'other' as section from p
    union all select o, 'footnote', 0, text, page, section from s where a = 3
    union all select o, 'table_row', case a when 2 then 0 else 1 end, case a when 2 then '[Income Statement]' else '[Balance Sheet]' end || chr(10) || string_agg(text, chr(10) order by n), min(page), min(section) from s where kind = 'table_row' group by o, a) join t using (o)""")
def filing_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """C2-C8 over whole filings: prose is carried over a footnote, rows are joined under their statement."""
    return C.chunks(P.segments(D.dom(_filings(spark, sf), said=True))).select("doc", "chunk_id", "chunk_type", "text", "page", "section")


@query(f"""with {_FILING}, x as (select o, 1 as k, i as row_idx, 'Line ' || i as row_label, unnest(['1998', '1999']) as column_header, unnest(['-' || q, f]) as value_text, unnest([-q::double, null]) as value_numeric, 1 as page, 'income_statement' as statement_type from li
    union all select o, 2, 1, 'Rest', '7', '2000', 2000.0, case when marked then m + 1 else 1 end, 'balance_sheet' from t)
    select 'ORDER_1998_' || o as doc, (row_idx + case k when 1 then 1 else 0 end)::int as row_idx, row_label, column_header, value_text || ' (in thousands)' as value_text, value_numeric, 'in thousands' as units, statement_type, (page + case when marked then 10 else 0 end)::int as page_num, 'ORDER' as company, 1998 as fiscal_year, 'annual' as period_type, o::varchar as filing_type from x join t using (o)""")
def filing_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of whole filings by their own traversal."""
    return P.facts(D.dom(_filings(spark, sf), said=True)).select("doc", "row_idx", "row_label", "column_header", "value_text", "value_numeric", "units", "statement_type", "page_num", "company", "fiscal_year", "period_type", "filing_type")


def _line_segments(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("seq") % 11 == 10, "footnote").when(F.col("seq") % 5 == 4, "table_row").otherwise("prose")
    named = F.when(F.col("seq") % 2 == 0, "balance_sheet").otherwise("other")
    return _lines(spark, sf).filter(F.trim("line") != "").select(F.col("doc").cast("string").alias("doc"), "seq", kind.alias("kind"), F.col("line").alias("text"), F.lit(0).alias("sub"), F.lit(1).alias("page"), F.lit("word_count").alias("page_method"), F.lit(None).cast("string").alias("units"), named.alias("section"))


def _chunk_sql(kind: str = "'prose'", pages: bool = False) -> str:
    """Chunks of lines, or of the segments of ``pages``. Prose: a recursion over the items of a document with the window's first item and the first that is new; ``t`` sums the words before an item.
    Rows of tables: runs that stand together in one section; lines stay below their budget, which the recursion of :func:`token_batches` shows instead."""
    lines = rf"{_LINES}, s as (select doc::varchar as doc, seq, line as text, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') as w, {kind} as kind, case when seq % 2 = 0 then 'balance_sheet' else 'other' end as section, row_number() over (partition by doc order by seq) as place from l where trim(line) <> '')"
    parts = _PAGE_SEGMENTS.replace("s as (", "page as (") + ", s as (select doc, n as seq, text, list_filter(string_split(text, ' '), lambda x: x <> '') as w, 'prose' as kind, 'other' as section, n as place from page)"
    places = "" if pages else ", first_seq::int as first_seq, last_seq::int as last_seq"
    return rf"""with recursive {parts if pages else lines},
    k as (select *, case when kind = 'prose' and len(w) > 400 then 'long' else kind end as k from s),
    i as (select *, row_number() over (partition by doc order by seq) - 1 as p, coalesce(sum(len(w)) over (partition by doc order by seq rows between unbounded preceding and 1 preceding), 0) as t from k where k = 'prose'),
    e as (select doc, p, t, text, len(w) as n, seq, section from i union all select k.doc, coalesce(max(p) + 1, 0), coalesce(max(t + len(i.w)), 0), null, null, null, null from (select distinct doc from k) k left join i using (doc) group by k.doc),
    a as (select k.doc, k.seq, k.w, k.k, k.section, k.text, (select count(*) from i where i.doc = k.doc and i.seq < k.seq) as p from k where k in ('long', 'footnote')),
    c as (select e.*, n is null or exists(select 1 from a where a.doc = e.doc and a.p = e.p) as cut, (select min(x.p) from e x where x.doc = e.doc and x.t >= e.t - 50) as carried, coalesce(lead(t) over (partition by doc order by p), t) as after from e),
    r as (select doc, p, 0::bigint as first, 0::bigint as fresh, 0::bigint as w0, 0::bigint as w1, false as put from c where p = 0
    union all select c.doc, c.p + 1, case when f.over then greatest(f.f1, c.carried) else f.f1 end, case when c.cut or f.over then c.p else r.fresh end, r.first, c.p, (c.cut or f.over) and r.first < c.p and r.fresh < c.p
        from r join c on c.doc = r.doc and c.p = r.p, lateral (select f1, c.n is not null and f1 < c.p and c.after - (select x.t from c x where x.doc = c.doc and x.p = f1) > 400 as over from (select case when c.cut then greatest(r.first, c.carried) else r.first end as f1)) f),
    o as (select doc, w1 as p, 0 as q, 0 as part, (select string_agg(text, ' ' order by p) from i where i.doc = r.doc and i.p >= w0 and i.p < w1) as text, (select min(seq) from i where i.doc = r.doc and i.p >= w0 and i.p < w1) as first_seq, (select max(seq) from i where i.doc = r.doc and i.p >= w0 and i.p < w1) as last_seq from r where put
    union all select doc, p, 1 + seq, part, array_to_string(list_slice(w, part * 400 + 1, part * 400 + 400), ' '), seq, seq from (select *, unnest(range((len(w) + 399) // 400)) as part from a where k = 'long')),
    g as (select *, place - row_number() over (partition by doc, section order by seq) as run, place - row_number() over (partition by doc order by seq) as stand from k where k = 'table_row'),
    h as (select doc, section, string_agg(text, chr(10) order by seq) as text, min(seq) as first_seq, max(seq) as last_seq from g group by doc, section, run, stand),
    f as (select *, row_number() over (partition by doc order by seq) - 1 as nth from a where k = 'footnote'),
    z as (select doc, doc || '::prose::' || (row_number() over (partition by doc order by p, q, part) - 1) as chunk_id, 'prose' as chunk_type, text, first_seq, last_seq from o
    union all select doc, doc || '::table_row::' || (row_number() over (partition by doc order by first_seq) - 1), 'table_row', case section when 'other' then '' else '[Balance Sheet]' || chr(10) end || text, first_seq, last_seq from h
    union all select doc, doc || '::footnote::' || nth || case when len(w) > 400 then '_p' || part else '' end, 'footnote', case when len(w) > 400 then array_to_string(list_slice(w, part * 400 + 1, part * 400 + 400), ' ') else text end, seq, seq from (select *, unnest(range(greatest(1, (len(w) + 399) // 400))) as part from f))
    select doc, chunk_id, chunk_type, text{places} from z"""


def _chunked(segments: DataFrame) -> DataFrame:
    return C.chunks(segments).select("doc", "chunk_id", "chunk_type", "text", "first_seq", "last_seq")


@query(_chunk_sql(pages=True))
def html_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """C2-C8 over the pages' segments."""
    return C.chunks(P.segments(_dom(spark, sf))).select("doc", "chunk_id", "chunk_type", "text")


@query(_chunk_sql())
def chunk_prose(spark: SparkSession, sf: str) -> DataFrame:
    """A document's lines as prose."""
    return _chunked(_line_segments(spark, sf).withColumn("kind", F.lit("prose")))


@query(_chunk_sql("case when seq % 11 = 10 then 'footnote' when seq % 5 = 4 then 'table_row' else 'prose' end"))
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Prose, rows and footnotes."""
    return _chunked(_line_segments(spark, sf))


_SHELL = "<html><head><link href=report.css></head><body>viewer</body></html>"


@query(f"""select page_id, case page_id % 6 when 1 then ltrim(h) when 2 then ltrim(h) || chr(10) || ltrim(h) when 3 then ltrim(h) when 4 then substr(html, strpos(html, '<html')) when 5 then '{_SHELL}' else html end as html
    from (select *, '<html>' || html || '</html>' as h from pages)""")
def sgml_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    """Pages bare; one block, and one left open; two blocks beside a viewer's shell; one beside a shell; a shell in the block and the page outside, within a
    submission's own html; a shell alone."""
    n, html = F.col("page_id") % 6, F.concat(F.lit("<html>"), "html", F.lit("</html>"))
    block = lambda x: F.concat(F.lit("<DOCUMENT>\n<TEXT>\n"), x, F.lit("</TEXT>\n</DOCUMENT>"))
    shell = block(F.lit(_SHELL))
    raw = (
        F.when(n == 1, F.concat(F.lit("<TYPE>10-K\n<text>\n "), html)).when(n == 2, F.concat(block(html), shell, block(html))).when(n == 3, F.concat(shell, block(html)))
        .when(n == 4, F.concat(F.lit("<HTML title='SEC EDGAR submission'>"), shell, F.lit("</HTML>"), "html")).when(n == 5, shell).otherwise(F.col("html"))
    )
    return table(spark, sf, "pages").select("page_id", T.markup_blocks(raw).alias("html"))


#: Definitions in the lines of a text; \s spans lines, so blank lines before a number count.
_NUMBERED = r"(?m)^\s*\(?(\d{1,2})\)?\s*[.\-:]\s*(.+)$"


@query(rf"""with d as (select doc_id as doc, text || chr(10) || '3. ' || regexp_replace(text, '\s+', ' ', 'g') || chr(10) || '(4): short' || chr(10) || '(5) - ' || source || ' has the last word' as t from documents),
    p as (select doc, unnest(regexp_extract_all(t, '{_NUMBERED}', 1)) as footnote_id, unnest(regexp_extract_all(t, '{_NUMBERED}', 2)) as body, unnest(range(len(regexp_extract_all(t, '{_NUMBERED}', 1)))) as pos from d)
    select doc, footnote_id, trim(max_by(body, pos)) as body from p where length(trim(body)) > 15 group by all""")
def footnote_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """P20: definitions in the lines of whole texts, and each whole text as a definition."""
    text = F.concat("text", F.lit("\n3. "), F.regexp_replace("text", r"\s+", " "), F.lit("\n(4): short\n(5) - "), "source", F.lit(" has the last word"))
    return P.footnote_definitions(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), text.alias("text")))


@query(r"""with c as (select doc_id as doc, nullif(regexp_extract(text || ' (' || (doc_id % 3) || ') and (1)', '\((\d{1,2})\)', 1), '') as id from documents) select doc, case when id in ('1', '2') then id end as footnote_id from c""")
def footnote_tagging(spark: SparkSession, sf: str) -> DataFrame:
    """Only the first callout of a text counts, and only where it is defined."""
    d = F.col("doc_id")
    prose = table(spark, sf, "documents").select(d.alias("doc"), F.concat("text", F.lit(" ("), (d % 3).cast("string"), F.lit(") and (1)")).alias("text"))
    defs = table(spark, sf, "documents").select(d.alias("doc"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("footnote_id"), F.lit("x").alias("body"))
    return P.tag_footnotes(prose, defs).select("doc", "footnote_id")
