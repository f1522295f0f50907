"""Numbers, headings, names, answers: the column functions on stated cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("value,want", [("(in millions)", "in millions"), ("Amounts in  thousands", "in thousands"), ("millions", None)])
def test_units(spark, value, want):
    assert one(spark, T.unit_header, value) == want


@pytest.mark.parametrize("value,numeric,number", [("(2,468)", True, "-2468"), ("(2,468", True, "(2468"), ("$ 12", True, " 12"), ("12.5%", True, "12.5%"), ("-", False, "-"), ("+3", False, "+3"), ("", False, "")])
def test_numbers(spark, value, numeric, number):
    assert (one(spark, T.is_numeric, value), one(spark, T.accounting_number, value)) == (numeric, number)


@pytest.mark.parametrize("value,want", [("page 17", 17), ("a\n42\nb", 42), ("page 0", 0), ("Page 1300", 1300), ("1300\nx\n9", 9), ("none", None)])
def test_printed_page(spark, value, want):
    assert one(spark, T.printed_page, value) == want


@pytest.mark.parametrize(
    "value,broad,strict",
    [("Statements of Cash Flows", "cash_flow", "cash_flow"), ("see the balance sheet", "balance_sheet", "other"), ("Consolidated Statements of Operations", "income_statement", "income_statement"), ("liquidity and financial condition", "other", "other"), ("Statement of income and statement of cash flows", "income_statement", "income_statement")],
)
def test_headings(spark, value, broad, strict):
    assert (one(spark, T.statement_type, value), one(spark, lambda c: T.statement_type(c, strict=True), value)) == (broad, strict)
    assert one(spark, lambda c: T.statement_type(c, statements={"mine": ["see"]}), "see it") == "mine"


@pytest.mark.parametrize("question,want", [("capex of fy2019", "temporal"), ("which quarter", "complex"), ("q1 results", "complex"), ("Q1 2020", "temporal"), ("what is total revenue", "simple"), ("why total", "complex")])
def test_classes(spark, question, want):
    assert one(spark, T.question_class, question) == want


MATCHES = [
    ("$8,738 million", "8738", True), ("8.7", "8738", False), ("(5)", "-5", True), ("2019", "2020", None), ("no", "never", True), ("rose", "fell", False), ("", "1", False), ("yes it is", "yes", True),
    ("rose but later fell", "rose and improved", False), ("fell", "rose and fell", True), ("sales rose", "margins were higher", True), ("sales rose", "they fell and grew", False), ("one thing", "another", None), ("Paid in Q2 of the year", "paid 55 cents", None),
]


@pytest.mark.parametrize("a,b,want", MATCHES)
def test_answers(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.decided_match(F.col("a"), F.col("b")).alias("d"), T.answers_match(F.col("a"), F.col("b")).alias("m")).first()
    assert (row.d, row.m) == (want, bool(want))


@pytest.mark.parametrize("match,page,abstained,want", [(True, True, False, 1), (True, False, False, 0), (False, True, False, -1), (True, True, True, 0)])
def test_rubric(spark, match, page, abstained, want):
    assert spark.range(1).select(T.rubric(F.lit(match), F.lit(page), F.lit(abstained)).alias("o")).first().o == want


def test_document_name(spark):
    row = spark.createDataFrame([("acme_2023Q2_10Q.htm",)], "v string").select(*[c.alias(k) for k, c in T.document_name(F.col("v")).items()]).first()
    assert tuple(row) == ("ACME", 2023, 2, "quarterly", "10Q")


def test_markup_blocks(spark):
    block = "<DOCUMENT><TEXT>\n{}</TEXT></DOCUMENT>".format
    shell, real = block("<html><link href='Report.css'></html>"), "<html>a</html>"
    assert one(spark, T.markup_blocks, block(real) + shell) == real
    assert one(spark, T.markup_blocks, block(real) + shell + block("<HTML>b</HTML>\n")) == "<html>a</html>\n<HTML>b</HTML>\n"
    assert one(spark, T.markup_blocks, "<html><title>SEC EDGAR submission</title>" + shell + "</html><html x>out</html><html>open") == "<html x>out</html>\n<html>open"
    assert one(spark, T.markup_blocks, shell) == "<html><link href='Report.css'></html>"
    assert one(spark, T.markup_blocks, "<TEXT>no markup</TEXT><html>b</html>") == "<TEXT>no markup</TEXT><html>b</html>"
    assert one(spark, T.markup_blocks, "<html>b</html>") == "<html>b</html>"
    assert one(spark, lambda c: T.markup_blocks(c, viewer="a"), block(real) + block("<html>z</html>")) == "<html>z</html>"
