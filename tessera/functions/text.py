"""Column functions over strings: tokens, numbers, headings, names and question classes.

Patterns are Unicode-aware where the semantics are; vocabularies are parameters with defaults below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What results depend on. All are defaults of arguments.

#: Phrases that name a statement; the first type in this order wins.
STATEMENTS = {
    "income_statement": [
        "statements of operations", "statement of operations", "statements of income", "statement of income", "statements of earnings", "statement of earnings",
        "consolidated statements of income", "consolidated statement of income", "consolidated statements of operations", "consolidated statement of operations",
        "consolidated statements of earnings", "consolidated statement of earnings",
    ],
    "cash_flow": ["statements of cash flows", "statement of cash flows", "cash flow statement", "consolidated statements of cash flows", "consolidated statement of cash flows"],
    "balance_sheet": [
        "balance sheet", "statements of financial position", "statement of financial position", "consolidated balance sheets", "consolidated balance sheet",
        "consolidated statements of financial position", "consolidated statement of financial position",
    ],
}
#: Expansions of terms in questions.
GLOSSARY = {"capex": "capital expenditures property plant equipment", "eps": "earnings per share", "fcf": "free cash flow operating activities", "sales": "net revenue"}
CALCULATION = ["ratio", "percent", "growth", "change", "average", "margin"]
#: A question with a period is temporal; else it counts phrases.
PERIODS = r"\b(fy|q[1-4]|fiscal|year|quarter)\s*\d{4}\b|\b20\d{2}\b"
SIMPLE = ["what was", "what is", "how much", "total", "revenue", "net income", "capex", "eps", "earnings per share"]
COMPLEX = ["why", "explain", "describe", "discuss", "risk", "strategy", "outlook", "guidance", "compared to", "trend"]
FOOTNOTE = ["footnote", "note "]
NARRATIVE = ["why", "describe", "explain", "discuss", "risk"]
NEGATIONS = r"(?i)\b(no|none|not|never|zero|did not|no acquisitions?|no major)\b"
UP = r"(?i)\b(increas|grew|growth|higher|rose|improv)\w*"
DOWN = r"(?i)\b(decreas|declin|fell|lower|drop|reduc|worsen)\w*"
#: What a viewer's shell names near its start, and what the wrapper of a whole submission does.
VIEWER, SUBMISSION = "report.css", "sec edgar submission"


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase is a substring."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words(text: Column) -> Column:
    """White-space words, no empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def is_spacer(text: Column) -> Column:
    """A blank cell, or one with only a currency or percent sign."""
    return F.translate(text, "  \t\n", "").isin("", "$", "%")


def is_numeric(text: Column) -> Column:
    """An accounting number: sign, currency, parentheses, digits and commas, decimals, percent, with blanks between; no dash alone."""
    return F.trim(text).rlike(r"^-?\$?\s*\(?\s*[\d,]+(?:\.\d+)?\s*\)?%?$")


def accounting_number(text: Column) -> Column:
    """A parenthesised number is negative; commas and currency signs go."""
    inner = F.regexp_extract(text, r"\(\s*([\d,]+(?:\.\d+)?)\s*\)", 1)
    return F.when(inner != "", F.concat(F.lit("-"), F.translate(inner, ",", ""))).otherwise(F.translate(F.trim(text), ",$", ""))


def unit_header(text: Column) -> Column:
    """The unit that a table's heading declares, as "in millions"; null if none."""
    unit = F.regexp_extract(F.lower(text), r"in\s+(millions|thousands|billions)", 1)
    return F.when(unit != "", F.concat(F.lit("in "), unit))


def printed_page(text: Column) -> Column:
    """The page number that a text prints: the one after "page", else the first from 1 to 999 alone on its line."""
    named = F.regexp_extract(F.lower(text), r"\bpage\s+(\d{1,4})\b", 1)
    alone = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|\n)\s*(\d{1,4})\s*(?:\n|$)"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.nullif(named, F.lit("")).cast("int"), F.get(F.filter(alone, lambda n: n.between(1, 999)), F.lit(0)))


def statement_type(text: Column, strict: bool = False, statements: dict[str, list[str]] = STATEMENTS) -> Column:
    """The statement that a heading names: anywhere, or at its start if ``strict``."""
    low = F.lower(F.trim(text))
    out = None
    for name, phrases in statements.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | (F.startswith(low, F.lit(p)) if strict else F.contains(low, F.lit(p)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def calculation_weight(question: Column, weight: float = 2.0) -> Column:
    """Weight of sparse ranks: higher for questions that ask to calculate."""
    return F.when(contains_any(F.lower(question), CALCULATION), F.lit(weight)).otherwise(F.lit(1.0))


def question_class(question: Column, simple: list[str] = SIMPLE, complex_: list[str] = COMPLEX) -> Column:
    """temporal, simple or complex."""
    low = F.lower(question)
    count = lambda phrases: sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))
    return F.when(low.rlike(PERIODS), "temporal").when(count(simple) > count(complex_), "simple").otherwise("complex")


def question_type(question: Column, footnote: list[str] = FOOTNOTE, narrative: list[str] = NARRATIVE) -> Column:
    """footnote, narrative or simple."""
    low = F.lower(question)
    return F.when(contains_any(low, footnote), "footnote").when(contains_any(low, narrative), "narrative").otherwise("simple")


def expand_question(question: Column, glossary: dict[str, str] = GLOSSARY) -> Column:
    """The question and the expansion of each glossary term that it contains."""
    low = F.lower(question)
    return F.concat_ws(" ", question, *[F.when(F.contains(low, F.lit(k)), v) for k, v in glossary.items()])


def normal_answer(text: Column) -> Column:
    """An answer without markup, currency, commas and percent signs; parenthesised numbers are negative."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[*_`]", "")
    signed = F.regexp_replace(plain, r"\(\s*([\d,]+(?:\.\d+)?)\s*\)", "-$1")
    return F.lower(F.trim(F.translate(signed, "$,%", "")))


def numbers(text: Column) -> Column:
    """All signed decimals of a normalised answer as doubles."""
    return F.transform(F.regexp_extract_all(normal_answer(text), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.try_cast("double"))


def values(text: Column) -> Column:
    """The numbers of an answer that don't look like years."""
    return F.filter(numbers(text), lambda x: ~x.between(1900, 2100))


def numbers_match(a: Column, b: Column, rel: float = 0.006, abs_: float = 0.01) -> Column:
    """Whether any pair agrees within the tolerances, relative to the larger, signs apart."""

    def close(x: Column, y: Column) -> Column:
        scale = F.greatest(F.abs(x), F.abs(y), F.lit(1e-9))
        return (F.abs(x - y) / scale <= rel) | (F.abs(x - y) <= abs_) | (F.abs(F.abs(x) - F.abs(y)) / scale <= rel)

    return F.exists(a, lambda x: F.exists(b, lambda y: close(x, y)))


def is_bare(text: Column, most: int = 12) -> Column:
    """Hardly more than numbers and punctuation: at most ``most`` characters besides."""
    left = F.regexp_replace(F.regexp_replace(normal_answer(text), r"-?\d+(?:\.\d+)?", ""), r"[\s.,;:()\-]", "")
    return F.length(left) <= most


def text_match(a: Column, b: Column) -> Column:
    """Containment, negation, direction: true, false, or null if undecided (E5). A direction agrees if neither answer has the other one too."""
    x, y = normal_answer(a), normal_answer(b)
    ux, uy, dx, dy = a.rlike(UP), b.rlike(UP), a.rlike(DOWN), b.rlike(DOWN)
    return (
        F.when((x == "") | (y == ""), F.lit(False)).when(F.contains(x, y) | F.contains(y, x), F.lit(True)).when(a.rlike(NEGATIONS) & b.rlike(NEGATIONS), F.lit(True))
        .when((ux & uy & ~dx & ~dy) | (dx & dy & ~ux & ~uy), F.lit(True)).when((ux & dy) | (dx & uy), F.lit(False))
    )


def decided_match(a: Column, b: Column) -> Column:
    """Numbers first; a mismatch decides only between bare numbers; else the text rules; null where a judge is needed."""
    x, y = values(a), values(b)
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(both & numbers_match(x, y), True).when(both & is_bare(a) & is_bare(b), False).otherwise(text_match(a, b))


def answers_match(a: Column, b: Column) -> Column:
    """:func:`decided_match`, undecided being false."""
    return F.coalesce(decided_match(a, b), F.lit(False))


def page_match(page: Column, evidence: Column, tolerance: int = 12) -> Column:
    """Within ``tolerance`` of any evidence page; false without pages."""
    return F.coalesce(F.exists(evidence, lambda p: F.abs(p - page) <= tolerance), F.lit(False))


def rubric(match: Column, page_ok: Column, abstained: Column) -> Column:
    """Abstained 0, wrong -1, right 1 with the page and 0 without."""
    return F.when(abstained, 0).when(~match, -1).when(page_ok, 1).otherwise(0)


def document_name(name: Column) -> dict[str, Column]:
    """Company, year, quarter, period and filing type from COMPANY_YEAR[Qn]_TYPE; else the stem and unknowns."""
    stem = F.regexp_replace(name, r"(?i)\.html?$", "")
    pattern = r"(?i)^(.+?)_([0-9]{4})(?:Q([1-4]))?_([A-Za-z0-9-]+)$"
    ok = stem.rlike(pattern)
    part = lambda k: F.regexp_extract(stem, pattern, k)
    quarter = F.nullif(part(3), F.lit("")).cast("int")
    return {
        "company": F.when(ok, F.upper(part(1))).otherwise(stem), "fiscal_year": F.when(ok, part(2).cast("int")).otherwise(0), "fiscal_quarter": F.when(ok, quarter),
        "period_type": F.when(~ok, "unknown").when(quarter.isNull(), "annual").otherwise("quarterly"), "filing_type": F.when(ok, F.upper(part(4))).otherwise("unknown"),
    }


def markup_blocks(raw: Column, viewer: str = VIEWER, submission: str = SUBMISSION) -> Column:
    """The html that a wrapped filing holds.

    Its text blocks that start with html are the candidates; without any, or without both tags, the input stays. Those that don't name a
    viewer in their first 600 characters are joined by lines; else html anywhere that names neither viewer nor submission in its first 400; else
    the longest candidate.
    """
    named = lambda b, n, what: F.contains(F.lower(F.substring(b, 1, n)), F.lit(what))
    blocks = F.filter(F.regexp_extract_all(raw, F.lit(r"(?is)<text>\s*(.*?)(?:</text>|\z)"), F.lit(1)), lambda b: F.lower(F.substring(b, 1, 5)) == "<html")
    good = F.filter(blocks, lambda b: ~named(b, 600, viewer))
    # Each html tag starts one, also inside another.
    outer = F.filter(F.regexp_extract_all(raw, F.lit(r"(?is)(?=(<html[^>]*>.*?(?:</html>|\z)))<"), F.lit(1)), lambda b: ~named(b, 400, viewer) & ~named(b, 400, submission))
    longest = F.reduce(blocks, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    wrapped = F.contains(F.lower(raw), F.lit("<text>")) & F.contains(F.lower(raw), F.lit("<html"))
    return F.when(~wrapped | (F.size(blocks) == 0), raw).when(F.size(good) > 0, F.array_join(good, "\n")).when(F.size(outer) > 0, F.array_join(outer, "\n")).otherwise(longest)
