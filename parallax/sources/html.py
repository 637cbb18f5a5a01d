"""HTML tables to rows: a parser on the standard library, as a table function that is joined to pages.

Cells are keyed by their ``data-stat``. Tables inside comments count like live ones; of several with
one id the first counts. Body and foot rows are read, repeated headers inside the body are not.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ids in links, labels of rows that sum others, cells one of which a real row has.
PLAYER_LINK = r"player\.fcgi\?id=([^&\"']+)"
TEAM_LINK = r"team\.cgi\?id=([^&\"']+)"
SEASON_LINK = r"league\.cgi\?id=([^&\"']+)"
AGGREGATE_LABELS = ("team totals", "league totals", "league average", "team average", "totals", "average")
LABEL_COLUMNS = ("player", "name_display", "team_ID", "team_id", "team_name_abbr")
IDENTITY = (*LABEL_COLUMNS, "year_ID", "year_id")


#: Plain markup: a whole cell with its link; a tag in lower case with quoted attributes; a comment without hyphens in a row; text
#: without references. Of the tags, none whose content a parser takes as text. All else is the parser's.
PLAIN = re.compile(
    r'<t[dh] data-stat="([^"<>&]*)">(?:<a href="([^"<>&]*)">)?([^<&]*)(?:</a>)?</t[dh]>|<(/?)(table|thead|tbody|tfoot|tr|td|th|a|div|span|p|caption|strong|em|b|i|h[1-6])((?: [a-z][a-z-]*="[^"<>&]*")*)>|<!--([^->][^-]*(?:-[^-]+)*)-->|([^<&]+)'
)
ATTRIBUTE = re.compile(r'([a-z-]+)="([^"]*)"')


class _Tables(HTMLParser):
    """Collects tables as lists of rows; a row is a dict of cell texts with the links' targets."""

    def __init__(self, wanted: str | None = None):
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.tables: list[tuple[str | None, list[dict]]] = []
        self.comments: list[str] = []
        self.open: list[tuple[str | None, list[dict]]] = []
        self.section = self.row = self.cell = None

    def read_plain(self, text: str) -> bool:
        """Take a text of plain markup alone, several times faster than ``feed`` does; false, with a part of it taken, for any other."""
        end = 0
        for m in PLAIN.finditer(text):
            if m.start() != end:
                return False
            end = m.end()
            stat, href, inner, closing, tag, attrs, comment, data = m.groups()
            if stat is not None:
                if self.open and self.row is not None:
                    self.close_cell()
                    self.cell = [stat, inner.replace("\xa0", " "), href]
                    self.close_cell()
                else:
                    self.close_cell()
            elif tag is None:
                if comment is not None:
                    self.handle_comment(comment)
                else:
                    self.handle_data(data)
            elif not closing:
                self.handle_starttag(tag, ATTRIBUTE.findall(attrs) if attrs else ())
            elif attrs:
                return False
            else:
                self.handle_endtag(tag)
        return end == len(text)

    def handle_comment(self, data):
        if "<table" in data:
            self.comments.append(data)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "table":
            self.close_row()
            self.section = "tbody"
            self.open.append((a.get("id"), []))
        elif not self.open:
            return
        elif tag in ("thead", "tbody", "tfoot"):
            self.close_row()
            self.section = tag
        elif tag == "tr":
            self.close_row()
            if self.wanted is not None and self.open[-1][0] != self.wanted:
                return
            self.row = {"skip": self.section == "thead" or "thead" in a.get("class", "").split()}
        elif tag in ("td", "th") and self.row is not None:
            self.close_cell()
            self.cell = [a.get("data-stat"), "", None]
        elif tag == "a" and self.cell is not None and self.cell[2] is None:
            self.cell[2] = a.get("href")

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[1] += data.replace("\xa0", " ").strip() if not self.cell[1] else data.replace("\xa0", " ")

    def close_cell(self):
        if self.cell is not None:
            stat, text, link = self.cell
            if stat:
                self.row[stat] = text.strip()
                if link:
                    self.row[f"{stat}@href"] = link
        self.cell = None

    def close_row(self):
        self.close_cell()
        if self.row is not None and not self.row.pop("skip") and self.row:
            self.open[-1][1].append(self.row)
        self.row = None

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.close_cell()
        elif tag == "tr":
            self.close_row()
        elif tag == "table" and self.open:
            self.close_row()
            self.tables.append(self.open.pop())
        elif tag in ("thead", "tbody", "tfoot") and self.open:
            self.close_row()
            self.section = "tbody"


def parsed(text: str, wanted: str | None = None) -> _Tables:
    parser = _Tables(wanted)
    if not parser.read_plain(text):
        parser = _Tables(wanted)
        parser.feed(text)
        parser.close()
    return parser


def tables_of(html: str, wanted: str | None = None) -> list[tuple[str | None, list[dict]]]:
    """(id, rows) of a page's tables: live ones first, then those in comments, one for each id. Of a page with a ``wanted`` id
    the other tables' rows are not built."""
    parser = parsed(html or "", wanted)
    found, at = list(parser.tables), 0
    while at < len(parser.comments):
        inner = parsed(parser.comments[at], wanted)
        found += inner.tables
        parser.comments += inner.comments
        at += 1
    seen: set[str] = set()
    return [t for t in found if t[0] is None or not (t[0] in seen or seen.add(t[0]))]


class PageRows:
    """The rows of a page's tables, one by one; a page that cannot be read gives a row with an error alone."""

    def eval(self, html: str, wanted: str):
        if html is None:
            yield None, None, None, "no page"
            return
        try:
            found = tables_of(html, wanted)
        except (ValueError, AssertionError, RecursionError) as e:
            yield None, None, None, f"{type(e).__name__}: {e}"
            return
        for at, (table_id, rows) in enumerate(found):
            if wanted is None or table_id == wanted:
                for cells in rows:
                    yield table_id, at, cells, None


ROW = "table_id string, table_at int, cells map<string,string>, error string"


def page_rows(pages: DataFrame, table_id: str | None = None, html: str = "html") -> DataFrame:
    """``pages`` joined with the rows of their tables, or of the one with an id: table_id, table_at, cells (texts by name), error.

    A lateral join with a table function: a page's rows are streamed, never an array. Columns of these names are replaced.
    """
    rows = F.udtf(PageRows, returnType=ROW)
    page = F.col(f"_page.{html}")
    kept = [c for c in pages.columns if c.lower() not in ("table_id", "table_at", "cells", "error", html.lower())]
    nested = pages.select(F.struct(*[F.col(f"`{c}`") for c in [*kept, html]]).alias("_page"))
    return nested.lateralJoin(rows(page.outer(), F.lit(table_id).cast("string"))).select(*[F.col("_page")[c].alias(c) for c in kept], "table_id", "table_at", "cells", "error")


def rows(pages: DataFrame, table_id: str | None = None, html: str = "html") -> DataFrame:
    """A row for each table row of ``pages``, with table_id, table_at and cells (map of texts)."""
    return page_rows(pages, table_id, html).filter("error IS NULL").drop("error")


def cell(name: str) -> Column:
    return F.try_element_at("cells", F.lit(name))


def link_id(pattern: str) -> Column:
    """The id in the last link of a row that fits; null without one."""
    links = F.filter(F.map_entries("cells"), lambda e: F.endswith(e["key"], F.lit("@href")) & F.rlike(e["value"], F.lit(pattern)))
    return F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(links, F.lit(-1))["value"], F.lit("")), pattern, 1), F.lit(""))


def is_aggregate() -> Column:
    """Whether a row sums others, by the label in any of its naming cells."""
    out = F.lit(False)
    for c in LABEL_COLUMNS:
        out = out | F.coalesce(F.lower(F.btrim(cell(c))).isin(*AGGREGATE_LABELS), F.lit(False))
    return out


def identified() -> Column:
    """Whether a row names something; padding rows don't."""
    return F.coalesce(*[F.nullif(F.btrim(cell(c)), F.lit("")) for c in IDENTITY]).isNotNull()


def with_signature(all_rows: DataFrame, signature: tuple[str, ...], page: str) -> DataFrame:
    """Rows of each page's first table that has all columns of ``signature``."""
    has = F.size(F.array_except(F.array(*map(F.lit, signature)), F.map_keys("cells"))) == 0
    first = F.min(F.when(has, F.col("table_at"))).over(Window.partitionBy(page))  # pages are parsed once
    return all_rows.filter(F.col(page).isNotNull()).withColumn("_first", first).filter("table_at = _first").drop("_first")


def renamed_cells(names: dict[str, str]) -> Column:
    """Cells under canonical names; the first of several cells with one canonical name counts."""
    new = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map(F.lit(""), F.lit(""))
    entries = F.transform(F.map_entries("cells"), lambda e: F.struct(F.coalesce(F.try_element_at(new, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    keyed = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda b: b["key"] == e["key"]))
    return F.map_from_entries(keyed)


def season_rows(df: DataFrame, year: Column) -> DataFrame:
    return df.filter(F.rlike(F.coalesce(year, F.lit("")), F.lit(r"^(19|20)\d{2}$")))


def first_seen(lists: list[DataFrame], key: str, order: str) -> DataFrame:
    """Distinct keys of several tables, with the place of their first row."""
    out = lists[0].select(key, F.struct(F.lit(0).alias("t"), F.col(order).alias("o")).alias("seen"))
    for t, df in enumerate(lists[1:], 1):
        out = out.union(df.select(key, F.struct(F.lit(t).alias("t"), F.col(order).alias("o")).alias("seen")))
    return out.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("seen").alias("seen")).orderBy("seen")

