"""Queries against their SQL on rows where engines round, trim and bound words differently."""

import duckdb

from tessera.plans import ORACLES, QUERIES


def same(spark, folder, name, **tables):
    """The query gives the rows of its SQL over ``tables``, SQL each."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"copy ({sql}) to '{folder}/{t}.parquet'")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = c.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    want = sorted(got.fetchall(), key=repr)
    assert want and sorted((tuple(r) for r in QUERIES[name](spark, str(folder)).select(*names).collect()), key=repr) == want


def test_halves_of_pages_are_even(spark, tmp_path):
    same(spark, tmp_path, "section_asof_expiry", events="select * from (values (1, 200, 'purchase', 5.0), (1, 600, 'view', 5.0), (2, 28200, 'view', 5.0), (2, 28199, 'purchase', 0.0), (2, 28600, 'view', 5.0)) t(user_id, event_id, event_type, value)")


def test_definitions_keep_digits_at_their_ends(spark, tmp_path):
    same(spark, tmp_path, "footnote_definitions", documents="select * from (values (1, '0997 and more digits after 10', 's'), (2, e'1. what the first note says  \\n2. 1 and what the second says 1', 's'), (3, '', 's')) t(doc_id, text, source)")


def test_definitions_of_whole_texts(spark, tmp_path):
    """Bodies of any length and definitions behind 200,000 characters, also behind as many blank lines."""
    texts = "(1, repeat('word ', 50000) || chr(10) || '7. a definition far behind', 's'), (2, 'x' || repeat(chr(10), 400000) || '8. one behind blank lines' || repeat(chr(10), 300000) || 'y', 's')"
    same(spark, tmp_path, "footnote_definitions", documents=f"select * from (values {texts}) t(doc_id, text, source)")
    got = {(r.doc, r.footnote_id): r.body for r in QUERIES["footnote_definitions"](spark, str(tmp_path)).collect()}
    assert got[1, "7"] == "a definition far behind" and got[2, "8"] == "one behind blank lines" and got[1, "5"] == got[2, "5"] == "s has the last word"
    assert got[1, "3"] == "word " * 50000 + "7. a definition far behind"


def test_numbers_beside_accented_letters(spark, tmp_path):
    texts = ["the hean. ç les, èréan étre. CC BY-NC 4.0.", "the é5 6", "thé_8 the é 8", "the 5é 7", "the é,5 7", "the x\x0b5 7", "the $ 1,204.50 in all", "the"]
    same(spark, tmp_path, "value_in_texts", documents="select * from (values " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(texts)) + ") t(doc_id, text)")


def test_halves_of_cents(spark, tmp_path):
    lines = "select * from (values (1, 57107.25, 0.02), (2, 54535.75, 0.02), (3, 33449.75, 0.02), (4, 70048.75, 0.02), (5, 100.0, 0.5)) t(l_orderkey, l_extendedprice, l_discount)"
    as_doubles = "select l_orderkey::bigint as l_orderkey, l_extendedprice::double as l_extendedprice, l_discount::double as l_discount from"
    same(spark, tmp_path, "contradictions", lineitem=f"{as_doubles} ({lines})", orders="select o::bigint as o_orderkey, 100.0::double as o_totalprice from range(1, 7) t(o)")


def test_sums_in_the_order_of_the_table(spark, tmp_path):
    """Lines of an order in two files: their sums by file round to other cents than the sum of all, row by row."""
    orders = [(0.381, 0.761, 0.324, 0.149), (0.737, 0.599, 0.317, 0.222), (0.522, 0.651, 0.304, 0.828), (0.493, 0.385, 0.679, 0.578)]
    (tmp_path / "lineitem.parquet").mkdir()
    c = duckdb.connect()
    c.execute("set threads = 1")
    for name, own in (("lineitem.parquet/a", slice(0, 2)), ("lineitem.parquet/b", slice(2, 4))):
        lines = ", ".join(f"({k}, {p})" for k, prices in enumerate(orders) for p in prices[own])
        c.execute(f"copy (select k::bigint as l_orderkey, p::double as l_extendedprice, 0.0::double as l_discount from (values {lines}) t(k, p)) to '{tmp_path}/{name}.parquet'")
    c.execute(f"copy (select k as o_orderkey, 1.0::double as o_totalprice from range({len(orders)}) t(k)) to '{tmp_path}/orders.parquet'")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    want = sorted(c.execute(ORACLES["contradictions"]).fetchall())
    got = QUERIES["contradictions"](spark, str(tmp_path)).select("k", "section_a", "section_b", "pct", "severity").collect()
    assert len(want) == 2 * len(orders) and sorted(map(tuple, got)) == want
    assert [r[3] for r in want if r[2] == "lines"] == [round((1 - 1 / v) * 100, 2) for v in (1.62, 1.87, 2.31, 2.13)]
