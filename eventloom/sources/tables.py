"""Tables in web pages as rows: spans laid out on a grid, header levels joined, parsed where the pages lie."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns and rows that one cell may span.
MOST_SPAN = 1000


class _Tables(HTMLParser):
    """Tables of a page in the order in which they begin; a table within a cell is one of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[dict]]] = []
        self.open: list[list[list[dict]]] = []
        self.cells: list[dict | None] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
            self.cells.append(None)
        elif self.open and tag == "tr":
            self.cells[-1] = None
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            spans = {k: v for k, v in attrs if k in ("rowspan", "colspan")}
            self.cells[-1] = {"header": tag == "th", "text": [], "down": _span(spans.get("rowspan")), "across": _span(spans.get("colspan")) or 1}
            self.open[-1][-1].append(self.cells[-1])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag == "table":
            self.open.pop()
            self.cells.pop()
        elif tag in ("td", "th", "tr"):
            self.cells[-1] = None

    def handle_data(self, data):
        if self.open and self.cells[-1] is not None:
            self.cells[-1]["text"].append(data)


def _span(value: str | None) -> int:
    """A span of 1 where it isn't a number; 0 stands for all rows that are left."""
    digits = (value or "").strip()
    return min(int(digits), MOST_SPAN) if digits.isdecimal() and len(digits) < 6 else 1


def layout(rows: list[list[dict]]) -> list[list[str]]:
    """The text of each place of the grid; a cell that spans fills all its places, a missing one is empty."""
    grid: list[dict[int, str]] = []
    for r, row in enumerate(rows):
        while len(grid) <= r:
            grid.append({})
        at = 0
        for cell in row:
            while at in grid[r]:
                at += 1
            value = " ".join("".join(cell["text"]).split())
            down = cell["down"] or len(rows) - r
            for y in range(r, min(r + down, len(rows))):
                while len(grid) <= y:
                    grid.append({})
                for x in range(at, at + cell["across"]):
                    grid[y].setdefault(x, value)
            at += cell["across"]
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    return [[g.get(x, "") for x in range(width)] for g in grid]


def joined_header(levels: list[str]) -> str:
    """The levels of a column's header, each text once whatever its case, joined by an underscore."""
    seen: dict[str, str] = {}
    for text in levels:
        if text:
            seen.setdefault(text.lower(), text)
    return "_".join(seen.values())


def page_tables(html: str | None) -> Iterator[tuple[int, list[str], list[list[str]]]]:
    """(number, names, rows) of each table; the header is the first rows that hold header cells alone."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    for number, rows in enumerate(parser.tables):
        grid = layout(rows)
        top = 0
        while top < len(rows) and rows[top] and all(cell["header"] for cell in rows[top]):
            top += 1
        names = [joined_header([level[x] for level in grid[:top]]) for x in range(len(grid[0]) if grid else 0)]
        yield number, names, grid[top:]


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, table_no, row_no, names, cells: a row for each row of each table of a page; a page without tables has none."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(page, number, k, names, cells) for page, text in zip(frame["_key"], frame["_html"], strict=True) for number, names, body in page_tables(text) for k, cells in enumerate(body)]
            yield pd.DataFrame(rows, columns=["_key", "table_no", "row_no", "names", "cells"])

    found = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html"))
    return found.mapInPandas(parse, f"_key {kind}, table_no int, row_no int, names array<string>, cells array<string>").withColumnRenamed("_key", key)


def _holds(parts: tuple[str, ...]):
    return lambda name: reduce(and_, [F.lower(name).contains(p) for p in parts])


def column_named(*parts: str):
    """The cell of the first column whose name holds all the parts, whatever their case; null without one."""
    at = F.array_position(F.transform("names", _holds(parts)), F.lit(True))
    return F.when(at > 0, F.get("cells", at - 1))


def change_log(rows: DataFrame) -> DataFrame:
    """date, added, removed of the rows of a table of changes (see html_tables): dots in tickers are dashes, blanks are null, rows without a date go.

    Fails where a table lacks one of the three columns.
    """
    ticker = lambda side: F.coalesce(column_named(side, "ticker"), column_named(side, "symbol"))
    known = F.exists("names", _holds(("date",))) & reduce(and_, [F.exists("names", _holds((side, "ticker"))) | F.exists("names", _holds((side, "symbol"))) for side in ("added", "removed")])
    whole = F.when(known, F.lit(True)).otherwise(F.raise_error(F.lit("a table lacks a date, an added or a removed ticker")).cast("boolean"))
    clean = lambda c: F.nullif(F.replace(F.trim(c), F.lit("."), F.lit("-")), F.lit(""))
    written = F.trim(column_named("date"))
    day = F.coalesce(*[F.try_to_timestamp(written, F.lit(form)) for form in ("yyyy-MM-dd", "MMMM d, yyyy")]).cast("date")
    found = rows.where(whole).select("*", day.alias("date"), clean(ticker("added")).alias("added"), clean(ticker("removed")).alias("removed"))
    return found.where("date is not null").select("date", "added", "removed", "table_no", "row_no")
