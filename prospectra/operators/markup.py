"""Tables and links of HTML pages as rows.

Pages are parsed in Arrow batches, each page by itself; what follows (header rows, layouts, records)
are DataFrame expressions over the cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the widest span of a cell that browsers take.
WIDEST = 1000
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SILENT = {"script", "style", "template", "noscript"}
Cell = dict[str, object]


class _Table:
    def __init__(self, number: int, outer: int | None):
        self.number, self.outer = number, outer
        self.rows: list[list[Cell]] = []
        self.open: Cell | None = None


class Page(HTMLParser):
    """The tables of a page in document order, nested ones apart from the cell that holds them, and its links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[_Table] = []
        self.links: list[tuple[str, str]] = []
        self._stack: list[_Table] = []
        self._href: str | None = None
        self._label: list[str] = []
        self._silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        held = {k: v or "" for k, v in attrs}
        if tag in _SILENT:
            self._silent += 1
        elif tag == "table":
            self._stack.append(_Table(len(self.tables), self._stack[-1].number if self._stack else None))
            self.tables.append(self._stack[-1])
        elif tag == "tr" and self._stack:
            self._stack[-1].open = None
            self._stack[-1].rows.append([])
        elif tag in ("td", "th") and self._stack:
            top = self._stack[-1]
            if not top.rows:
                top.rows.append([])
            top.open = {"header": tag == "th", "colspan": span(held.get("colspan")), "rowspan": span(held.get("rowspan")), "text": [], "href": None}
            top.rows[-1].append(top.open)
        elif tag == "a":
            self._end_link()
            if "href" in held:
                self._href, self._label = held["href"], []
                cell = self._stack[-1].open if self._stack else None
                if cell is not None and cell["href"] is None:
                    cell["href"] = held["href"]
        elif tag == "br":
            self.handle_data(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self._silent = max(0, self._silent - 1)
        elif tag == "table" and self._stack:
            self._stack.pop()
        elif tag in ("td", "th", "tr") and self._stack:
            self._stack[-1].open = None
        elif tag == "a":
            self._end_link()

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if self._href is not None:
            self._label.append(data)
        if self._stack and self._stack[-1].open is not None:
            self._stack[-1].open["text"].append(data)

    def _end_link(self) -> None:
        if self._href is not None:
            self.links.append((self._href, " ".join("".join(self._label).split())))
            self._href = None

    def close(self) -> None:
        super().close()
        self._end_link()


def span(value: str | None) -> int:
    """A span attribute: at least 1 and at most what browsers take; what is no number counts as 1."""
    try:
        return min(WIDEST, max(1, int(value or "1")))
    except ValueError:
        return 1


def grid(rows: Sequence[Sequence[Cell]]) -> Iterator[tuple[int, int, Cell, bool]]:
    """(row, column, cell, own) of each place that cells cover; `own` is the cell's first place.

    A cell takes the next column that no cell from above reaches into, and covers what its spans
    say within the table's rows, over others where they overlap. Rows without any place keep their number.
    """
    reaching: dict[int, tuple[Cell, int]] = {}
    for at, cells in enumerate(rows):
        placed = {c: (cell, False) for c, (cell, last) in reaching.items() if last >= at}
        column = 0
        for cell in cells:
            while column in placed:
                column += 1
            for target in range(column, column + cell["colspan"]):
                placed[target] = (cell, target == column)
                if cell["rowspan"] > 1:
                    reaching[target] = (cell, at + cell["rowspan"] - 1)
                else:
                    reaching.pop(target, None)
            column += cell["colspan"]
        for c in sorted(placed):
            yield at, c, *placed[c]


def _parsed(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    return page


CELLS = "table int, outer int, row int, col int, header boolean, own boolean, text string, href string"


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The key and a row per place of each table's grid: table, outer (the table around it), row, col, header, own, text, href.

    Tables are numbered in document order; a nested table's text is not its outer cell's. Spans are
    carried; white space is folded; scripts and styles have no text. Null and empty pages, and pages
    without tables, give no rows; broken markup is read as far as it goes. Other columns are not read.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, source in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = [(t.number, t.outer, r, c, cell["header"], own, " ".join("".join(cell["text"]).split()), cell["href"]) for t in _parsed(source).tables for r, c, cell, own in grid(t.rows)]
                if found:
                    columns = [pa.array(list(x), kind_) for x, kind_ in zip(zip(*found, strict=True), _TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([one.as_py()] * len(found), batch.column(0).type), *columns], names)

    names = ["__key", "table", "outer", "row", "col", "header", "own", "text", "href"]
    return pages.select(F.col(key).alias("__key"), F.col(html).cast("string").alias("__html")).mapInArrow(run, f"__key {kind}, {CELLS}").withColumnRenamed("__key", key)


_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The key and a row per link of a page, in order: place (from 0), href, label. Links without a target are none; an open one ends at the next."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for one, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                links = _parsed(source).links
                keys += [one] * len(links)
                rows += [(i, h, t) for i, (h, t) in enumerate(links)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *columns], ["__key", "place", "href", "label"])

    return pages.select(F.col(key).alias("__key"), F.col(html).cast("string").alias("__html")).mapInArrow(run, f"__key {kind}, place int, href string, label string").withColumnRenamed("__key", key)


def header_key(text: Column) -> Column:
    """A header as layouts name it: lower-cased, without footnote marks, spaces folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\[[^\]]*\]", " "), r"\s+", " "))


def layout_records(cells: DataFrame, key: str, layouts: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """The records of the tables that have a layout: key, table, row, layout and the layouts' fields, null where a layout has no such field.

    A layout says for each field which headers name it. A table's header row is the first row in
    which every field of a layout has a column; of several layouts there the one with the most
    fields, then the first by name. Records are the rows below with a place of their own that is no
    header. Tables without any layout give none. Each table is one group of cells of one page.
    """
    fields = sorted({f for layout in layouts.values() for f in layout})
    known = header_key(F.col("text"))
    table = [key, "table"]
    # The column of each field of each layout, by row: the first that has one of its headers.
    columns = {(n, f): F.min(F.when(known.isin(*[h.lower() for h in names]), F.col("col"))) for n, layout in layouts.items() for f, names in layout.items()}
    by_row = cells.groupBy(*table, "row").agg(*[c.alias(f"c_{i}") for i, c in enumerate(columns.values())])
    order = sorted(layouts, key=lambda n: (-len(layouts[n]), n))
    places = {pair: f"c_{i}" for i, pair in enumerate(columns)}

    def fits(name: str) -> Column:
        whole = F.lit(True)
        for f in layouts[name]:
            whole = whole & F.col(places[name, f]).isNotNull()
        return whole

    chosen = F.coalesce(*[F.when(fits(n), F.struct(F.lit(n).alias("layout"), *[(F.col(places[n, f]) if f in layouts[n] else F.lit(None).cast("int")).alias(f) for f in fields])) for n in order])
    heads = by_row.withColumn("__chosen", chosen).where("__chosen IS NOT NULL").groupBy(*table).agg(F.min(F.struct("row", "__chosen")).alias("__head"))
    heads = heads.select(*[F.col(c).alias(f"__{c}") for c in table], F.col("__head.row").alias("__head_row"), F.col("__head.__chosen").alias("__layout"))
    below = cells.join(heads, F.col(key).eqNullSafe(F.col(f"__{key}")) & (F.col("table") == F.col("__table"))).where(F.col("row") > F.col("__head_row"))
    values = [F.max(F.when(F.col("col") == F.col(f"__layout.{f}"), F.col("text"))).alias(f) for f in fields]
    rows = below.groupBy(*table, "row", F.col("__layout.layout").alias("layout")).agg(*values, F.max(F.col("own") & ~F.col("header")).alias("__own"))
    return rows.where("__own").drop("__own")
