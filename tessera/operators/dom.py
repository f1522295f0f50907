"""HTML to a relation of elements (P1, P7, P19): the one step that needs a parser, run in Arrow batches.

Recovery rules: void elements have no content; a block element closes an open paragraph, a list item an open one, a cell
an open cell, a row an open row, through any inline elements between, but never through an enclosing table or list; end tags close the nearest open
element of their name and what is in it; script, style and noscript are dropped with their content.

An element's text is kept where something reads it: headings, tables and their cells, and elements of prose until a child of prose starts
(a division that holds no more than a number keeps it). So rows hold hardly more text than the page. What needs the whole page, the number of
breaks, the printed offset and the ids of footnotes' definitions, is found in the same pass: the page is parsed once.

Tags repeat, so the library's parser reads each plain one once, and pages of plain tags and text are split by them. Any other page
(comments, declarations, scripts, loose angle brackets) goes through the library's parser whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "div", "span", "li"}
#: Inline facts: what holds one isn't a leaf of prose.
LINKED = {"ix:nonfraction", "ix:nonnumeric", "ix:fraction"}
#: Elements that end an open paragraph.
BLOCK = {"p", "div", "ul", "ol", "table", "section", "article", "nav", "header", "footer", "blockquote", "pre", "form", "hr"} | HEADINGS
#: What an element closes, and what stops the search for it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
SCHEMA = (
    "doc string, seq int, parent_seq int, end_seq int, tag string, depth int, style string, colspan int, text string, table_seq int, row_idx int, cell_idx int, "
    "in_leaf_table boolean, has_nested_table boolean, has_child_prose boolean, has_ix_child boolean, kind string, breaks boolean, "
    "n_breaks int, page_offset int, cells array<struct<row_idx:int,cell_idx:int,col:int,colspan:int,text:string>>, lines string"
)
#: Elements whose text is read; characters of a container that may still be a page number; breaks from which pages are marked; characters of lines that are kept.
KEPT = PROSE | HEADINGS | {"table", "td", "th"}
SAID = PROSE | HEADINGS | {"table"}
NUMBER, LEAST_BREAKS, LINES = 8, 5, 200_000
#: Tags whose ends can't be mistaken, and how many of them are remembered.
TAG = re.compile(r"""(<(?:[a-zA-Z][a-zA-Z0-9:]*(?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_:-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^ \t\n\r\f"'<>=`/]+))?)*[ \t\n\r\f]*/?|/[a-zA-Z][a-zA-Z0-9:]*[ \t\n\r\f]*)>)""")
REMEMBERED = 10_000
_TAGS: dict[str, tuple | None] = {}


def _looks(attrs: list[tuple[str, str | None]]) -> tuple[str, int, bool]:
    """Style, span and whether the page breaks, of a tag's attributes."""
    attributes = dict(attrs)
    style, span = (attributes.get("style") or "").lower(), attributes.get("colspan") or "1"
    return style, int(span) if span.isdigit() and int(span) > 0 else 1, ("break-before" in style or "break-after" in style) and "always" in style


class _Single(HTMLParser):
    """Reads one tag: whether it starts, ends or does both, its name and looks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("start", tag, _looks(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.found.append(("both", tag, _looks(attrs)))

    def handle_endtag(self, tag):
        self.found.append(("end", tag, None))

    def handle_data(self, data):
        self.found.append(("text", data, None))


def _tag(text: str) -> tuple | None:
    """What a tag says; None if it changes how what follows is read."""
    if text not in _TAGS:
        parser = _Single()
        parser.feed(text)
        plain = len(parser.found) == 1 and parser.found[0][0] != "text" and not parser.rawdata and parser.cdata_elem is None
        if len(_TAGS) >= REMEMBERED:
            _TAGS.clear()
        _TAGS[text] = parser.found[0] if plain else None
    return _TAGS[text]


class _Element:
    def __init__(self, seq: int, parent: _Element | None, tag: str, looks: tuple[str, int, bool]):
        self.seq, self.parent, self.tag = seq, parent, tag
        self.depth = parent.depth + 1 if parent else 0
        self.style, self.colspan, self.breaks = looks
        self.parts: list[str] | None = [] if tag in KEPT else None
        self.size = 0
        self.end = seq
        self.table = parent.table if parent else None
        self.row = self.cell = None
        self.rows = self.cells = self.columns = self.col = 0
        self.nested = self.prose = self.ix = False

    def hold(self, text: str) -> None:
        """Keep ``text`` where it is read."""
        self.parts.append(text)
        self.size += len(text)
        self.trim()

    def trim(self) -> None:
        contains = self.nested if self.tag in ("table", "td", "th") else self.prose or self.nested
        if contains and self.parts is not None and self.tag not in HEADINGS and self.size > NUMBER:
            self.parts = None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.all: list[_Element] = []
        self.open: list[_Element] = []
        self.dropped = 0

    def read(self, html: str) -> None:
        """The whole page, by its tags where they are plain."""
        parts = TAG.split(html)
        tags = [_tag(x) for x in parts[1::2]]
        if None in tags or html.count("<") != len(tags) or "&" in parts[-1]:
            self.feed(html)
            self.close()
            return
        for text, (kind, tag, looks) in zip(parts[::2], tags):
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if kind == "start":
                self.begin(tag, looks)
            elif kind == "end":
                self.handle_endtag(tag)
            else:
                self.begin_and_end(tag, looks)
        self.handle_data(parts[-1])

    def handle_starttag(self, tag, attrs):
        self.begin(tag, _looks(attrs))

    def handle_startendtag(self, tag, attrs):
        self.begin_and_end(tag, _looks(attrs))

    def begin(self, tag, looks):
        if tag in DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        if tag in BLOCK:
            self._close({"p"}, {"td", "th", "table", "li", "div"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        e = _Element(len(self.all), self.open[-1] if self.open else None, tag, looks)
        up = e.parent
        if tag == "table":
            e.table = e
        elif tag == "tr" and e.table:
            e.row, e.table.rows = e.table.rows, e.table.rows + 1
        elif tag in ("td", "th") and e.table:
            row = next((x for x in reversed(self.open) if x.tag in ("tr", "table")), None)
            if row is not None and row.tag == "tr":
                e.row, e.cell, row.cells = row.row, row.cells, row.cells + 1
                # Where the cell starts when spans are laid out.
                e.col, row.columns = row.columns, row.columns + e.colspan
        if tag == "table" or tag in PROSE or tag in LINKED:
            while up:
                up.nested |= tag == "table"
                up.prose |= tag in PROSE
                up.ix |= tag in LINKED
                up.trim()
                up = up.parent
        self.all.append(e)
        if tag not in VOID:
            self.open.append(e)

    def begin_and_end(self, tag, looks):
        self.begin(tag, looks)
        if tag not in VOID and not self.dropped and self.open and self.open[-1].tag == tag:
            self._pop(len(self.open) - 1)
        if tag in DROPPED and self.dropped:
            self.dropped -= 1

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif not self.dropped:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag == tag:
                    self._pop(k)
                    break
                if self.open[k].tag == "table" and tag != "table":
                    break

    def handle_data(self, data):
        if not self.dropped and data.strip():
            self.lines.append(data.strip())
            text = " ".join(data.split())
            for e in self.open:
                if e.parts is not None:
                    e.hold(text)

    def _close(self, tags, stops):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag in tags:
                self._pop(k)
                if "tr" not in tags:
                    return
            elif self.open[k].tag in stops:
                return

    def _pop(self, k):
        for e in self.open[k:]:
            e.end = len(self.all) - 1
        del self.open[k:]


def printed_offset(numbers: dict[int, int]) -> int:
    """Printed minus electronic page at the first page whose number and those of the next two pages follow one another, else 0."""
    return next((n - page for page, n in sorted(numbers.items()) if numbers.get(page + 1) == n + 1 and numbers.get(page + 2) == n + 2), 0)


def elements(doc: str | None, html: str | None, said: bool = False) -> list[tuple]:
    """Rows of ``SCHEMA`` for one document, in document order. The first row has what is found of the whole page in ``lines``.

    With ``said``, only the first row and rows that have a kind or break the page.
    """
    tree = _Tree()
    tree.read(html or "")
    tree._pop(0)
    n_breaks = sum(e.breaks for e in tree.all)
    page, numbers, cells = 1, {}, {}
    for e in tree.all:
        page += n_breaks >= LEAST_BREAKS and e.breaks
        if e.tag == "div" and e.parts and e.size <= NUMBER:
            text = " ".join(e.parts)
            if text.isdigit() and len(text) <= 4:
                numbers[page] = int(text)
        if e.cell is not None and not e.table.nested:
            cells.setdefault(e.table.seq, []).append((e.row, e.cell, e.col, e.colspan, " ".join(e.parts or ())))
    offset = printed_offset(numbers)
    out = []
    for e in tree.all:
        leaf = e.table is not None and not e.table.nested
        inside = leaf and e.tag != "table"
        if said and e.seq and not e.breaks and (inside or e.tag not in SAID):
            continue
        text = " ".join(e.parts or ())
        # Cells have their text in their table's row.
        prose = e.tag in PROSE and not (e.prose or e.nested or inside) and len(text) >= 2
        kind = "heading" if e.tag in HEADINGS and not inside else "table" if e.tag == "table" and not e.nested else "prose" if prose else None
        if said and e.seq and not e.breaks and kind is None:
            continue
        grid = [dict(zip(("row_idx", "cell_idx", "col", "colspan", "text"), c)) for c in cells.get(e.seq, ())] if kind == "table" else None
        out.append((doc, e.seq, e.parent.seq if e.parent else None, e.end, e.tag, e.depth, e.style, e.colspan, text, e.table.seq if e.table else None, e.row, e.cell, leaf, e.nested, e.prose, e.ix, kind, e.breaks, n_breaks, offset, grid, " ".join(tree.lines)[:LINES] if e.seq == 0 else None))
    return out


def dom(pages: DataFrame, partitions: int | None = None, said: bool = False) -> DataFrame:
    """A row for each element of each page (columns doc, html); with ``partitions``, pages are dealt to so many tasks first.

    With ``said``, only the rows that segments and facts read (see :func:`elements`): all that a page says, without its scaffolding.
    """
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += elements(doc, html.as_py(), said)
                if len(rows) >= 5_000:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    source = pages.select("doc", "html")
    return (source.repartition(partitions) if partitions else source).mapInArrow(parse, SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
