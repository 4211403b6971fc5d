"""Rows out of stored web pages: links by pattern expressions, tables by a scan of their tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed values of the page format: the largest spans, elements whose text is not shown, and those that end a line.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
UNSHOWN = ("script", "style", "template")
BREAKS = ("br", "p", "div", "li", "table", "tr", "td", "th", "hr")

ROWS_AT_ONCE = 5000

# Character entities and their text; the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def strip_tags(text: Column) -> Column:
    return F.trim(unescape(F.regexp_replace(text, "<[^>]*>", "")))


class TableGrid(HTMLParser):
    """The first table of a page as rows of cell texts.

    Tables inside a cell are part of its text. A cell or row ends where the next one begins, if its end tag is missing. A
    cell that spans columns or rows stands in each place it covers; a row span of 0 goes to the last row.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.hidden = 0, False, 0
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in UNSHOWN:
            self.hidden += 1
        elif self.done:
            return
        elif tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
            self.cell = None
        elif self.depth == 1 and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            spans = dict(attrs)
            self.cell = []
            self.rows[-1].append((self.cell, span(spans.get("colspan"), 1, MOST_COLUMNS), span(spans.get("rowspan"), 0, MOST_ROWS)))
        elif self.cell is not None and tag in BREAKS:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in UNSHOWN:
            self.hidden = max(0, self.hidden - 1)
        elif self.done or not self.depth:
            return
        elif tag == "table":
            self.depth -= 1
            self.done = not self.depth
        elif self.depth == 1 and tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            self.cell = None
        if self.cell is not None and tag in BREAKS:
            self.cell.append(" ")

    def handle_data(self, data):
        if self.cell is not None and not self.done and not self.hidden:
            self.cell.append(data)

    def grid(self) -> list[list[str | None]]:
        """The rows, places that no cell covers being None. Rows of a section that spans reach beyond are not made."""
        reaching: dict[int, tuple[str, int]] = {}  # by column: a text from an earlier row, and how many rows it still covers
        laid = []
        for row in self.rows:
            places: dict[int, str] = {}
            for column, (text, left) in list(reaching.items()):
                places[column] = text
                if left == 1:
                    del reaching[column]
                else:
                    reaching[column] = text, left - 1
            column = 0
            for parts, wide, high in row:
                text = " ".join("".join(parts).split())
                while column in places:
                    column += 1
                for _ in range(wide):
                    places[column] = text
                    if high != 1:
                        reaching[column] = text, high - 1 if high else len(self.rows)
                    column += 1
            laid.append([places.get(i) for i in range(max(places, default=-1) + 1)])
        return laid


def span(value: str | None, least: int, most: int) -> int:
    found = re.match(r"\s*\+?(\d+)", value or "")
    number = int(found[1]) if found else 1
    return min(number, most) if number >= least else 1


def table_grid(html: str) -> list[list[str | None]]:
    page = TableGrid()
    page.feed(html)
    page.close()
    return page.grid()


def first_table_rows(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """One row per body row of each page's first table: kept columns, row number, header and cells.

    The first row's cells are the header; every later row has its cells as an array. Pages without a table, or with a
    header alone, have no rows. A page is read in one piece, pages by any number of tasks.
    """
    layout = T.StructType([
        *pages.select(*keep).schema.fields, *T.StructType.fromDDL("header array<string>, row int, cells array<string>").fields])
    target = to_arrow_schema(layout)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column(0).to_pylist()):
                grid = table_grid(page) if page else []
                for first in range(1, len(grid), ROWS_AT_ONCE):
                    rows = grid[first:first + ROWS_AT_ONCE]
                    own = [batch.column(1 + k).slice(i, 1).take(pa.array([0] * len(rows))) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array([grid[0]] * len(rows), pa.list_(pa.string())),
                         pa.array(range(first, first + len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], schema=target)

    return pages.select(F.col(html), *keep).mapInArrow(read, layout)


def first_list_links(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """One row per link of each page's first list: kept columns, position, target and text."""
    block = F.regexp_extract(F.col(html), r"(?is)<ul[^>]*>(.*?)</ul>", 1)
    item = r'(?is)<li[^>]*><a href="([^"]*)"[^>]*>(.*?)</a></li>'
    pairs = F.transform(
        F.regexp_extract_all(block, F.lit(item), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, item, 1).alias("href"), F.regexp_extract(m, item, 2).alias("text")),
    )
    exploded = pages.select(*keep, F.posexplode(pairs).alias("position", "link"))
    return exploded.select(
        *keep,
        (F.col("position") + 1).alias("position"),
        unescape(F.col("link.href")).alias("href"),
        strip_tags(F.col("link.text")).alias("text"),
    )
