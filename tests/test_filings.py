"""Elements, pages, sections, tables, facts and chunks."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators import dom as D
from tessera.operators import filings as P

PAGE = """<html><script>var a='<p>no</p>'</script><p>See the balance sheet of last year.</p><h2>Consolidated Statements of Cash Flows</h2><div>(in millions)</div>
<table><tr><td></td><td>2021</td><td>2020</td></tr><tr><td>Capital expenditures</td><td>(2,468)</td><td>(1,420)</td></tr></table><h2>Notes</h2><p>unclosed<b>bold<br><p>next</html>"""


def test_elements():
    rows = D.elements("d", PAGE)
    assert not [r for r in rows if r[4] == "script"] and max(r[5] for r in rows) <= 4
    assert [r[8] for r in rows if r[16] == "prose"] == ["See the balance sheet of last year.", "(in millions)", "unclosed bold", "next"]


def test_row_closed_by_row():
    rows = D.elements("d", "<table><tr><td>a<td>b<tr><td>c</table>")
    assert [(r[10], r[11], r[8]) for r in rows if r[4] == "td"] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]


def test_nested_table_is_no_leaf():
    rows = D.elements("d", "<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>")
    assert [r[16] for r in rows if r[4] == "table"] == [None, "table"]


def dom(spark, html, name="ACME_2021_10K"):
    return D.dom(spark.createDataFrame([(name, html)], "doc string, html string"))


def test_facts(spark):
    rows = P.facts(dom(spark, PAGE)).orderBy("sub").collect()
    assert [(r.row_label, r.column_header, r.value_text, r.value_numeric, r.units, r.statement_type, r.company) for r in rows] == [
        ("Capital expenditures", "2021", "-2468 (in millions)", -2468.0, "in millions", "cash_flow", "ACME"),
        ("Capital expenditures", "2020", "-1420 (in millions)", -1420.0, "in millions", "cash_flow", "ACME"),
    ]


def test_facts_have_a_traversal_of_their_own(spark):
    """h5 is no heading and any heading replaces the last; tables name themselves; prose under 300 characters may be a heading; inline facts are leaves."""
    table = "<table><tr><td>{}</td><td>2020</td></tr><tr><td>a</td><td>1</td></tr></table>".format
    html = f"<h5>Balance sheet</h5>{table('')}<h2>Balance sheet</h2>{table('x')}<h3>Notes</h3>{table('y')}<p>Statement of income {'z' * 220}</p>{table('z')}<h4>Other</h4>{table('Cash flow statement')}<div>Balance sheet <ix:nonfraction>1</ix:nonfraction></div>{table('i')}"
    facts = P.facts(dom(spark, html)).orderBy("table_seq").collect()
    assert [r.statement_type for r in facts] == ["other", "balance_sheet", "other", "income_statement", "cash_flow", "balance_sheet"]
    rows = P.segments(dom(spark, html)).filter("kind = 'table_row'").orderBy("seq").collect()
    assert [r.section for r in rows] == ["balance_sheet"] * 6


def test_segments(spark):
    rows = P.segments(dom(spark, PAGE)).orderBy("seq", "sub").collect()
    assert [(r.kind, r.text, r.units, r.section) for r in rows] == [
        ("prose", "See the balance sheet of last year.", None, "other"), ("prose", "(in millions)", "in millions", "other"),
        ("table_row", "Capital expenditures, 2021: -2468 (in millions)", "in millions", "cash_flow"), ("table_row", "Capital expenditures, 2020: -1420 (in millions)", "in millions", "cash_flow"),
        ("prose", "unclosed bold", "in millions", "other"), ("prose", "next", "in millions", "other"),
    ]


def test_heading_or_cross_reference(spark):
    table = "<table><tr><td>Header</td><td>2018</td></tr><tr><td>{}</td><td>1</td></tr></table>".format
    html = f"<p>See Consolidated Statement of Cash Flows for additional detail.</p>{table('Some other row')}<p><b>Consolidated Statement of Income</b></p>{table('Revenue')}"
    rows = P.segments(dom(spark, html)).filter("kind = 'table_row'").orderBy("seq").collect()
    assert [(r.text, r.section) for r in rows] == [("Some other row, 2018: 1", "other"), ("Revenue, 2018: 1", "income_statement")]


def test_page_breaks(spark):
    html = "".join(f'<div style="page-break-after:always">p{i}</div>' for i in range(6))
    seg = P.segments(dom(spark, html)).orderBy("seq").collect()
    assert [s.page for s in seg] == [2, 3, 4, 5, 6, 7] and {s.page_method for s in seg} == {"marker"}
    assert {s.page for s in P.segments(dom(spark, html.replace("p4", "44").replace("<div", "<p", 2).replace("</div", "</p", 2)[:200])).collect()} == {1}


def test_printed_pages(spark):
    """Three pages in a row with consecutive numbers give the offset; the last number of a page counts."""
    pages = "".join(f"<p>text {i}</p><div><span>{n}</span></div><div>{m}</div><hr style='break-before: always'>" for i, (n, m) in enumerate([(9, 3), (1, 50), (7, 51), (2, 52), (3, 80), (1, 2)]))
    seg = P.segments(dom(spark, pages)).filter("text like 'text%'").orderBy("seq").collect()
    assert [s.page for s in seg] == [49, 50, 51, 52, 53, 54]
    assert D.printed_offset({1: 3, 2: 50, 3: 51, 4: 52}) == 48 and D.printed_offset({1: 1, 2: 2}) == 0 and D.printed_offset({}) == 0
    footers = spark.createDataFrame([("d", p, s, n) for p, ns in enumerate([(9, 3), (1, 50), (7, 51), (2, 52)], 1) for s, n in enumerate(ns)], "doc string, page int, seq int, number int")
    assert P.page_offset(footers).first().page_offset == 48


def test_footnotes(spark):
    """The first callout decides; definitions stand at the start of lines, with . - or : and more than 15 characters."""
    html = "<pre>1. a definition of some length\n(2) - another one that is long\n3: too short\n4) no punctuation after this\n</pre><p>as in (1) and (9)</p><p>see (9) and (1)</p><p>and (2)</p><p>but (3)</p><p>nor (4)</p>"
    rows = P.segments(dom(spark, html)).orderBy("seq").collect()
    assert [(r.kind, r.footnote_id) for r in rows] == [("footnote", "1"), ("prose", None), ("footnote", "2"), ("prose", None), ("prose", None)]


def test_each_page_is_parsed_once(spark):
    for found in (P.facts(dom(spark, PAGE)), P.segments(dom(spark, PAGE))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_section_expires(spark):
    rows = spark.createDataFrame([("d", 1, "cash_flow", 1), ("d", 2, "other", 2), ("d", 3, "other", 3)], "doc string, seq int, named string, page int")
    out = rows.select("seq", P.section_in_force(F.col("named"), F.col("page"), "doc", "seq").alias("s")).orderBy("seq").collect()
    assert [r.s for r in out] == ["cash_flow", "cash_flow", "other"]


def seg(n, kind="prose", words=10, section="other"):
    return {"seq": n, "kind": kind, "text": f"w{n} " * words, "page": 1, "page_method": "marker", "units": None, "section": section}


def test_chunk_windows():
    two = C.fold("d", [seg(0, words=300), seg(1, words=300)])
    assert [(c[2], c[8], c[9]) for c in two] == [("prose", 0, 0), ("prose", 1, 1)]
    assert C.fold("d", []) == [] and C.fold("DOC", [seg(0) | {"page": 5}])[0][:5] == ("DOC", "DOC::prose::0", "prose", "w0 " * 10, 5)


def test_overlap_is_carried():
    out = C.fold("d", [seg(0, words=380), seg(1, words=20), seg(2, words=100)])
    assert [(c[8], c[9]) for c in out] == [(0, 1), (1, 2)]


def test_long_prose_takes_numbers():
    out = C.fold("d", [seg(0), seg(1, words=900), seg(2)])
    assert [c[1] for c in out] == [f"d::prose::{k}" for k in range(5)] and [len(c[3].split()) for c in out] == [10, 400, 400, 100, 20]


def test_rows_by_section():
    rows = [seg(k, "table_row", 30, "cash_flow" if k < 3 else "other") for k in range(5)]
    out = C.fold("d", rows)
    assert len(out) == 2 and out[0][3].startswith("[Cash Flow]\nw0") and out[1][3].startswith("w3") and [c[2] for c in out] == ["table_row"] * 2
    assert len(C.fold("d", [seg(k, "table_row", 30, "cash_flow") for k in range(30)])) == 2
    assert [c[1] for c in C.fold("d", [seg(0, "table_row"), seg(1, "table_row", 1700), seg(2, "table_row"), seg(3), seg(4, "table_row")])] == ["d::prose::0"] + [f"d::table_row::{k}" for k in range(6)]


def test_footnote_stands_alone():
    out = C.fold("d", [seg(0), seg(1, "footnote", 450), seg(2)])
    assert sorted(c[1] for c in out) == ["d::footnote::0_p0", "d::footnote::0_p1", "d::prose::0", "d::prose::1"]
    assert [c[8] for c in C.fold("d", [seg(0), seg(1, "footnote"), seg(2, "footnote")], compat=True) if c[2] == "prose"] == [0, 0, 0]


def simulated(rows, window, overlap, budget, compat):
    """Chunk ids with their segments, found one segment at a time from the rules of the survey."""
    found, prose, fresh, table, n = [], [], False, [], Counter()

    def put(kind, seqs):
        found.append((f"{kind}::{n[kind]}", tuple(seqs)))
        n[kind] += 1

    def end_prose():
        nonlocal prose, fresh
        if prose and (fresh or compat):
            put("prose", [r["seq"] for r in prose])
        while prose and sum(r["n"] for r in prose) > overlap:
            prose = prose[1:]
        fresh = False

    def end_table():
        nonlocal table
        if table:
            put("table_row", [r["seq"] for r in table])
        table = []

    for r in rows:
        r = r | {"n": len(r["text"].split())}
        if r["kind"] == "table_row":
            if table and (table[0]["section"] != r["section"] or sum(x["n"] for x in table) + r["n"] > budget):
                end_table()
            table.append(r)
            if r["n"] > budget:
                table = table[:-1]
                end_table()
                for _ in range(0, r["n"], budget):
                    put("table_row", [r["seq"]])
            continue
        if r["kind"] == "footnote":
            end_prose()
            end_table()
            put("footnote", [r["seq"]])
            continue
        end_table()
        if r["n"] > window:
            end_prose()
            for _ in range(0, r["n"], window):
                put("prose", [r["seq"]])
            continue
        if prose and sum(x["n"] for x in prose) + r["n"] > window:
            end_prose()
        prose, fresh = prose + [r], True
    end_prose()
    end_table()
    return sorted(found)


def test_chunks_follow_the_rules():
    g = random.Random(4)
    for _ in range(400):
        rows = [seg(k, g.choice(["prose", "prose", "table_row", "table_row", "footnote"]), g.choice([1, 3, 5, 9, 14, 25]), g.choice(["other", "cash_flow"])) for k in range(g.randrange(0, 30))]
        for compat in (False, True):
            got = C.fold("d", rows, 20, 6, 16, compat)
            assert sorted((c[1].removeprefix("d::").split("_p")[0], c[8], c[9]) for c in got if "_p1" not in c[1]) == [(i, s[0], s[-1]) for i, s in simulated(rows, 20, 6, 16, compat)]


def test_chunks_of_documents(spark):
    rows = [(d, s["seq"], 0, s["kind"], s["text"], 1, "marker", None, "other") for d in ("a", "b", None) for s in (seg(1, words=300), seg(0, words=300), seg(2, "footnote"))]
    df = spark.createDataFrame(rows, "doc string, seq int, sub int, kind string, text string, page int, page_method string, units string, section string")
    got = sorted((r.doc or "", r.chunk_type, r.first_seq) for r in C.chunks(df).collect())
    assert got == sorted((d, k, s) for d in ("", "a", "b") for k, s in (("prose", 0), ("prose", 1), ("footnote", 2)))


def test_batches_follow_the_budget(spark):
    g = random.Random(2)
    rows = [(k % 3, k, "x" * g.randrange(1, 400)) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, k int, text string").repartition(5)
    got = {(r.g, r.k): r.batch for r in C.budget_batches(df, "g", "k", 150).collect()}
    for own in range(3):
        batch = held = 0
        for _, k, t in (r for r in rows if r[0] == own):
            n = max(1, int(len(t) / 3.5))
            if held and held + n > 150:
                batch, held = batch + 1, 0
            held += n
            assert got[own, k] == batch


def test_plain_tags_are_read_as_by_the_library():
    class Whole(D._Tree):
        def read(self, html):
            self.feed(html)
            self.close()

    g, own = random.Random(5), D._Tree
    parts = ["<p>", "</p>", "<div>", "</div >", "<table>", "</table>", "<tr>", "<TD ColSpan='2'>", "<td colspan=0>", "<li>", "<h2>", "</h2>", "<br/>", '<hr style="page-break-after: always">', "<p style='break-before:always'/>"]
    parts += ["words", " 12 ", "a &amp; b", "&", "a < b", "<!-- c -->", "<script>x<y</script>", "<style>", "<title>", "<noscript>", "<ix:nonFraction a='1>2'>", "<a href=/x/>", '<p a="b"c>', "<div", "<plaintext>"]
    for k in range(2_000):
        html = "".join(g.choice(parts[: 17 if k % 2 else None]) for _ in range(g.randrange(20)))
        got = D.elements("d", html)
        D._Tree = Whole
        want = D.elements("d", html)
        D._Tree = own
        assert got == want, html
        assert D.elements("d", html, said=True) == [r for r in want if r[1] == 0 or r[16] is not None or r[17]], html


def test_scaffolding_says_nothing(spark):
    pages = spark.createDataFrame([("A_2022_10K", PAGE)], "doc string, html string")
    for what in (P.segments, P.facts):
        assert what(D.dom(pages, said=True)).collect() == what(D.dom(pages)).collect() != []
