"""Pages, units, sections, tables and facts over the relation of elements (P2-P24): windows over document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import accounting_number, document_name, is_numeric, is_spacer, statement_type, unit_header, words


#: A year in a header.
YEAR = r"\b(19|20)\d{2}\b"
#: A footnote's definition: a number at a line's start, punctuation, and what it says. Lines without one match too, with empty groups, so that a run of blank lines is read once.
DEFINITION = r"(?md)^\s*+(?:\(?(\d{1,2})\)?\s*[.\-:]\s*(.+)$)?"


def is_break(style: Column) -> Column:
    """An inline style that breaks the page."""
    s = F.lower(style)
    return (F.contains(s, F.lit("break-before")) | F.contains(s, F.lit("break-after"))) & F.contains(s, F.lit("always"))


def page_method(dom: DataFrame, least: int = 5) -> DataFrame:
    """doc, n_breaks, page_method: markers where there are enough, else word counts."""
    n = F.count_if(is_break(F.col("style")))
    return dom.groupBy("doc").agg(n.alias("n_breaks")).withColumn("page_method", F.when(F.col("n_breaks") >= least, "marker").otherwise("word_count"))


def marker_page(breaks: Column, key: str = "doc", order: str = "seq") -> Column:
    """One more than the breaks so far."""
    return 1 + F.sum(breaks.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def word_page(n_words: Column, key: str = "doc", order: str = "seq", per_page: int = 550) -> Column:
    """Running words by page (P5)."""
    total = F.sum(n_words).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return F.greatest(F.lit(1), (F.floor(total / per_page) + 1).cast("int"))


def page_offset(footers: DataFrame) -> DataFrame:
    """doc, page_offset: printed minus electronic page at the first of three pages in a row with consecutive numbers, else 0.

    ``footers`` has doc, page, seq, number: bare numbers; the last of a page counts.
    """
    last = footers.groupBy("doc", "page").agg(F.max_by("number", "seq").alias("number"))
    w = Window.partitionBy("doc").orderBy("page")
    step = lambda k: (F.lead("page", k).over(w) == F.col("page") + k) & (F.lead("number", k).over(w) == F.col("number") + k)
    first = last.withColumn("ok", step(1) & step(2)).groupBy("doc").agg(F.min_by(F.when(F.col("ok"), F.col("number") - F.col("page")), F.when(F.col("ok"), F.col("page"))).alias("page_offset"))
    return first.withColumn("page_offset", F.coalesce("page_offset", F.lit(0)))


def carried(value: Column, key: str, order: str) -> Column:
    """The last value that isn't null, the row's own included."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def section_in_force(section: Column, page: Column, key: str, order: str, scope: int = 1) -> Column:
    """The last heading's section unless it is more than ``scope`` pages back, else other."""
    last = carried(F.when(section != "other", F.struct(section.alias("section"), page.alias("page"))), key, order)
    return F.when(page - last["page"] <= scope, last["section"]).otherwise("other")


def _traversed(dom: DataFrame, key: str, prose: Column, turns: Column, heading: Column, named: Column, per_page: int, least_breaks: int, scope: int) -> DataFrame:
    """Elements with a kind, with ``page``, ``page_method``, ``units`` and ``section``: windows over one order, so one shuffle and one sort.

    ``prose`` are the leaves of prose, ``turns`` the elements that turn pages, ``heading`` those that may name a section, and ``named`` that name.
    """
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = F.col("n_breaks") >= least_breaks
    n = F.when(prose, F.size(words(F.col("text")))).otherwise(0)
    page = F.when(marked, 1 + F.sum(turns.cast("int")).over(w)).otherwise(F.greatest(F.lit(1), (F.floor(F.sum(n).over(w) / per_page) + 1).cast("int"))).cast("int")
    own = F.when(prose | (F.col("kind") == "table"), unit_header(F.col("text")))
    d = dom.withColumn("page", page).withColumn("page_method", F.when(marked, "marker").otherwise("word_count")).withColumn("units", F.last(own, ignorenulls=True).over(w))
    last = F.last(F.when(heading, F.struct(named.alias("section"), F.col("page").alias("page"))), ignorenulls=True).over(w)
    # The page is printed as the offset says; sections expire by the page counted.
    return d.withColumn("_last", last).withColumn("section", F.when(F.col("page") - F.col("_last.page") <= scope, F.col("_last.section")).otherwise("other")).withColumn("page", F.col("page") + F.col("page_offset")).drop("_last")


def _rows_of_tables(d: DataFrame, scan: int = 6) -> DataFrame:
    """Rows of tables as facts, beside all other rows: ``sub``, ``row_idx``, ``row_label``, ``column_header``, ``value_text``, ``value_numeric``.

    A table's cells are an array of its row, so header and intervals are found in it; labels come from a window over rows that lie together.
    """
    seen = F.transform("cells", lambda c: F.struct(c["row_idx"].alias("row_idx"), c["col"].alias("col"), (c["col"] + c["colspan"]).alias("stop"), F.trim(F.translate(c["text"], "\u00a0", " ")).alias("text")))
    full = d.withColumn("_cells", F.filter(seen, lambda c: ~is_spacer(c["text"])))
    year = F.filter("_cells", lambda c: (c["row_idx"] < scan) & c["text"].rlike(YEAR))
    full = full.withColumn("_head", F.coalesce(F.array_min(F.transform(year, lambda c: c["row_idx"])), F.lit(0)))
    full = full.withColumn("_heads", F.filter("_cells", lambda c: c["row_idx"] == F.col("_head"))).withColumn("_body", F.filter("_cells", lambda c: c["row_idx"] != F.col("_head")))
    each = full.select("*", F.posexplode_outer("_body").alias("sub", "_cell")).drop("cells", "_cells", "_body")
    w = Window.partitionBy("doc", "seq", "_cell.row_idx").orderBy("sub")
    each = each.withColumn("row_label", F.first("_cell.text").over(w)).withColumn("_nth", F.row_number().over(w)).filter((F.col("kind") != "table") | (F.col("_nth") > 1))
    head = F.get(F.filter("_heads", lambda h: (h["col"] <= F.col("_cell.col")) & (F.col("_cell.col") < h["stop"])), F.lit(0))["text"]
    numeric = is_numeric(F.col("_cell.text"))
    value = F.when(numeric, accounting_number(F.col("_cell.text"))).otherwise(F.col("_cell.text"))
    return (
        each.withColumn("row_idx", F.col("_cell.row_idx")).withColumn("column_header", F.coalesce(head, F.concat(F.lit("col_"), F.col("_cell.col"))))
        .withColumn("value_text", value).withColumn("value_numeric", F.when(numeric, F.trim(value)).try_cast("double")).drop("_cell", "_head", "_heads", "_nth")
    )


def segments(dom: DataFrame, per_page: int = 550, least_breaks: int = 5, heading_most: int = 200, scope: int = 1) -> DataFrame:
    """doc, seq, sub, kind (prose, table_row, footnote), text, page, page_method, units, section, footnote_id of what a document says, in order.

    Tables are a row for each fact sentence (P12); pages are printed ones where an offset is found (P6); prose whose first callout has a
    definition is a footnote (P20, P21). Only tables carry a section (P2-P5, P14, P17-P19).
    """
    prose = (F.col("kind") == "prose") & ~F.col("has_ix_child")
    turns = F.col("breaks") & (F.col("tag") != "table") & ~F.coalesce(F.col("kind") == "heading", F.lit(False)) & ~F.col("in_leaf_table")
    name = F.when(F.col("kind") == "heading", statement_type(F.col("text"))).when(prose & (F.length("text") <= heading_most), statement_type(F.col("text"), strict=True)).otherwise("other")
    d = _traversed(dom.withColumn("named", name), "doc", F.coalesce(prose, F.lit(False)), turns, F.col("named") != "other", F.col("named"), per_page, least_breaks, scope)
    whole = Window.partitionBy("doc")
    d = d.withColumn("_defined", F.first(F.when(F.col("seq") == 0, defined_footnotes(F.col("lines"))), ignorenulls=True).over(whole)).filter((F.col("kind") == "table") | prose)
    called = F.nullif(F.regexp_extract("text", r"\((\d{1,2})\)", 1), F.lit(""))
    d = d.withColumn("footnote_id", F.when((F.col("kind") == "prose") & F.array_contains("_defined", called), called))
    rows = _rows_of_tables(d.select("doc", "seq", "kind", "text", "cells", "page", "page_method", "units", "section", "footnote_id"))
    is_table = F.col("kind") == "table"
    return rows.select(
        "doc", "seq", F.coalesce("sub", F.lit(0)).alias("sub"), F.when(is_table, "table_row").when(F.col("footnote_id").isNotNull(), "footnote").otherwise("prose").alias("kind"),
        F.when(is_table, fact_sentence()).otherwise(F.col("text")).alias("text"), "page", "page_method", "units", F.when(is_table, F.col("section")).otherwise("other").alias("section"), "footnote_id",
    )


def logical_columns(cells: DataFrame, table: list[str]) -> DataFrame:
    """Cells with ``col``, where they start when spans are laid out (P8), and ``spacer`` (P9). Cells have row_idx, cell_idx, colspan, text."""
    before = Window.partitionBy(*table, "row_idx").orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("col", F.coalesce(F.sum("colspan").over(before), F.lit(0)).cast("int")).withColumn("text", F.trim(F.translate("text", " ", " "))).withColumn("spacer", is_spacer(F.col("text")))


def header_rows(cells: DataFrame, table: list[str], scan: int = 6) -> DataFrame:
    """table, header_row: the first of the first ``scan`` rows with a year, else 0 (P10)."""
    year = F.col("text").rlike(YEAR) & (F.col("row_idx") < scan)
    return cells.groupBy(*table).agg(F.coalesce(F.min(F.when(year, F.col("row_idx"))), F.lit(0)).alias("header_row"))


def table_facts(cells: DataFrame, table: list[str]) -> DataFrame:
    """table, row_idx, cell_idx, row_label, column_header, value_text, value_numeric of each value cell.

    A value's header is the first header cell whose span covers its column: the header row is a small array of each table.
    """
    laid = logical_columns(cells, table).join(header_rows(cells, table), table)
    head = laid.filter((F.col("row_idx") == F.col("header_row")) & ~F.col("spacer")).groupBy(*table).agg(F.sort_array(F.collect_list(F.struct("col", (F.col("col") + F.col("colspan")).alias("stop"), F.col("text").alias("head")))).alias("heads"))
    body = laid.filter((F.col("row_idx") != F.col("header_row")) & ~F.col("spacer"))
    w = Window.partitionBy(*table, "row_idx").orderBy("cell_idx")
    body = body.withColumn("nth", F.row_number().over(w)).withColumn("row_label", F.first("text").over(w)).filter("nth > 1").join(head, table, "left")
    found = F.filter("heads", lambda h: (h["col"] <= F.col("col")) & (F.col("col") < h["stop"]))
    value = F.when(is_numeric(F.col("text")), accounting_number(F.col("text"))).otherwise(F.col("text"))
    header = F.coalesce(F.get(found, F.lit(0))["head"], F.concat(F.lit("col_"), F.col("col")))
    return body.select(*table, "row_idx", "cell_idx", "row_label", header.alias("column_header"), value.alias("value_text"), F.when(is_numeric(F.col("text")), F.trim(value)).try_cast("double").alias("value_numeric"))


def with_units() -> Column:
    """A value with its unit, if it has one."""
    return F.concat(F.col("value_text"), F.coalesce(F.concat(F.lit(" ("), F.col("units"), F.lit(")")), F.lit("")))


def fact_sentence() -> Column:
    """label, header: value (units)."""
    return F.concat(F.col("row_label"), F.lit(", "), F.col("column_header"), F.lit(": "), with_units())


def facts(dom: DataFrame, per_page: int = 550, least_breaks: int = 5, heading_most: int = 300, scope: int = 1, headings: tuple[str, ...] = ("h1", "h2", "h3", "h4"), caption: int = 800) -> DataFrame:
    """Structured facts of whole filings with units, section, page and what the name says.

    The traversal differs from that of :func:`segments` (P24): only ``headings`` are headings, and any text of theirs takes the place of the last
    one; they turn pages too; prose shorter than ``heading_most`` names a section, and inline facts don't keep it from being a leaf; a table without a
    section in force is named by its first ``caption`` characters.
    """
    prose = F.coalesce(F.col("kind") == "prose", F.lit(False))
    turns = F.col("breaks") & (F.col("tag") != "table") & ~F.col("in_leaf_table")
    head = (F.col("kind") == "heading") & F.col("tag").isin(*headings) & (F.col("text") != "")
    strict = statement_type(F.col("text"), strict=True)
    short = prose & (F.length("text") < heading_most) & (strict != "other")
    # The buffer is classified as a whole when a table asks.
    d = dom.withColumn("named", F.when(head | short, statement_type(F.col("text")))).withColumn("_names", F.coalesce(head | short, F.lit(False)))
    d = _traversed(d, "doc", prose, turns, F.col("_names"), F.col("named"), per_page, least_breaks, scope).filter("kind = 'table'")
    d = d.withColumn("section", F.when(F.col("section") == "other", statement_type(F.substring("text", 1, caption))).otherwise(F.col("section")))
    rows = _rows_of_tables(d.select("doc", "seq", "kind", "text", "cells", "page", "units", "section"))
    return rows.select(
        "doc", F.col("seq").alias("table_seq"), "sub", "row_idx", "row_label", "column_header", with_units().alias("value_text"), "value_numeric", "units", F.col("section").alias("statement_type"),
        F.col("page").alias("page_num"), *[c.alias(k) for k, c in document_name(F.col("doc")).items()],
    )


def footnote_definitions(texts: DataFrame) -> DataFrame:
    """doc, footnote_id, body: lines of whole texts that start with a number, punctuation and more than 15 characters; the last of an id (P20)."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(DEFINITION), F.lit(1)).alias("id"), F.transform(F.regexp_extract_all("text", F.lit(DEFINITION), F.lit(2)), lambda x: F.trim(x)).alias("body"))
    each = texts.select("doc", F.posexplode(pairs).alias("pos", "p")).filter(F.length("p.body") > 15)
    return each.groupBy("doc", F.col("p.id").alias("footnote_id")).agg(F.max_by("p.body", "pos").alias("body"))


def defined_footnotes(lines: Column) -> Column:
    """The ids that have a definition in a text (P20)."""
    pairs = F.arrays_zip(F.regexp_extract_all(lines, F.lit(DEFINITION), F.lit(1)).alias("id"), F.regexp_extract_all(lines, F.lit(DEFINITION), F.lit(2)).alias("body"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: F.length(F.trim(p["body"])) > 15), lambda p: p["id"]))


def tag_footnotes(prose: DataFrame, definitions: DataFrame) -> DataFrame:
    """Prose with ``footnote_id`` where its first "(n)" has a definition."""
    called = prose.withColumn("_id", F.nullif(F.regexp_extract("text", r"\((\d{1,2})\)", 1), F.lit("")))
    known = definitions.select("doc", F.col("footnote_id").alias("_id"), F.col("footnote_id"))
    return called.join(known, ["doc", "_id"], "left").drop("_id")
