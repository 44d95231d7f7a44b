"""Pages taken apart by a table function: cells of tables and items of lists, listings of links, and a master of codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tapeline.sources.bars import BARS_SQL, bars, table

#: Blocks, the tag of their rows, and those of a row's cells; a list's row is its one cell.
BLOCKS = {"table": ("tr", ("td", "th")), "ul": ("li", ("li",)), "ol": ("li", ("li",))}
_SMALL = "abcdefghijklmnopqrstuvwxyz"
#: The header of an exchange's table of the day.
DAY_END = ("DATE", "TRADING CODE", "OPENP*", "HIGH", "LOW", "CLOSEP*", "VOLUME")


@dataclass
class _Block:
    """An open block: its number, kind, rows that had cells, and the open row's cells; the last is open if `inside`."""

    number: int
    kind: str
    rows: int = 0
    cells: list[dict] = field(default_factory=list)
    inside: bool = False


class _Grid(HTMLParser):
    """Collects (block, kind, row, cell, text, href) as rows end. Blocks are numbered as they open, and one within a cell
    of another keeps its text to itself; ends of cells and rows may be left out. A cell without text has the label
    that its tag gives for readers' aids."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.opened, self.path, self.found = 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.opened += 1
            self.path.append(_Block(self.opened, tag))
            return
        if not self.path:
            return
        block = self.path[-1]
        row, cells = BLOCKS[block.kind]
        if tag == row:
            self.flush(block)
        if tag in cells:
            block.cells.append({"text": "", "label": dict(attrs).get("aria-label") or "", "href": None})
            block.inside = True
        elif tag == "a" and block.inside and block.cells[-1]["href"] is None:
            block.cells[-1]["href"] = dict(attrs).get("href")

    def handle_data(self, data: str) -> None:
        if self.path and self.path[-1].inside:
            self.path[-1].cells[-1]["text"] += data

    def handle_endtag(self, tag: str) -> None:
        if not self.path:
            return
        block = self.path[-1]
        row, cells = BLOCKS[block.kind]
        if tag == block.kind:
            self.flush(block)
            self.path.pop()
        elif tag == row:
            self.flush(block)
        elif tag in cells:
            block.inside = False

    def flush(self, block: _Block) -> None:
        if block.cells:
            block.rows += 1
            for k, cell in enumerate(block.cells, 1):
                text = " ".join(cell["text"].split()) or " ".join(cell["label"].split())
                self.found.append((block.number, block.kind, block.rows, k, text, cell["href"]))
        block.cells, block.inside = [], False

    def close(self) -> None:
        super().close()
        while self.path:
            self.flush(self.path.pop())


@udtf(returnType="block int, kind string, row int, cell int, text string, href string", useArrow=False)
class PageCells:
    """The cells of a page's tables and lists, a row each; none for a null page."""

    def eval(self, html: str) -> Iterator[tuple]:
        grid = _Grid()
        grid.feed(html or "")
        grid.close()
        yield from grid.found


def page_cells(pages: DataFrame) -> DataFrame:
    """page_id, block, kind, row, cell, text, href of every page (page_id, html), by a lateral join of the table
    function."""
    return pages.select("page_id", "html").lateralJoin(PageCells(F.col("html").outer())).drop("html")


def table_rows(pages: DataFrame, required: tuple[str, ...] = DAY_END) -> DataFrame:
    """page_id, table, row, texts of the rows of the tables in which some row has all the required columns, with the first
    such row's number and texts as top and head. Pages are taken apart once; a page's table is sorted in one task."""
    cells = page_cells(pages).where("kind = 'table'").groupBy("page_id", F.col("block").alias("table"), "row")
    rows = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda x: x.text).alias("texts"))
    whole = F.size(F.array_except(F.array(*map(F.lit, required)), "texts")) == 0
    first = F.min(F.when(whole, F.struct("row", "texts"))).over(Window.partitionBy("page_id", "table"))
    return rows.withColumn("first", first).where("first IS NOT NULL").select("page_id", "table", "row", "texts", F.col("first.row").alias("top"), F.col("first.texts").alias("head"))


def cells_of(pages: DataFrame, required: tuple[str, ...] = DAY_END) -> DataFrame:
    """page_id, table, row, cell (from 1) and text of every cell of the tables in which some row has all the required
    columns; rows without cells count for nothing. `table` counts tables and lists of a page as they open."""
    return table_rows(pages, required).select("page_id", "table", "row", F.posexplode("texts").alias("cell", "text")).withColumn("cell", F.col("cell") + 1)


def records_of(pages: DataFrame, required: tuple[str, ...] = DAY_END) -> DataFrame:
    """page_id, table, row and a column of text for each required one: the rows below the header, of as many cells as it
    has, by the header's places."""
    body = table_rows(pages, required).where((F.col("row") > F.col("top")) & (F.size("texts") == F.size("head")))
    return body.select("page_id", "table", "row", *(F.get("texts", F.array_position("head", name).cast("int") - 1).alias(name) for name in required))


def day_end_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html: a page for each session with another table ahead, a row for each symbol, and cells whose end tags are
    left out on odd days. A session has a row for each symbol."""
    price = lambda c: F.floor(F.col(c) * 100).cast("string")
    values = [F.date_format("day", "yyyy-MM-dd"), F.concat(F.lit(" "), "symbol", F.lit(" &amp;\n Co ")), price("open"), price("high"), price("low"), price("close"), F.col("volume").cast("string")]
    end = F.when(F.dayofmonth("day") % 2 == 0, "</td>").otherwise("")
    line = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), v, end) for v in values))
    body = bars(spark, sf_dir).groupBy("day").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("body"))
    head = "".join(f"<th>{c}</th>" for c in DAY_END[:-1]) + f'<th aria-label="{DAY_END[-1]}"> </th>'
    html = F.concat(F.lit(f"<html><ul><li>menu</ul><table><tr><td>an ad</td></tr></table><table><tr>{head}</tr>"), "body", F.lit("</table></html>"))
    return body.select(F.unix_date("day").cast("long").alias("page_id"), html.alias("html"))


def html_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of day-end tables on pages made from bars."""
    rows = records_of(day_end_pages(spark, sf_dir))
    names = ("day", "code", "open", "high", "low", "close", "volume")
    return rows.select("page_id", "table", "row", *(F.col(c).alias(x) for c, x in zip(DAY_END, names, strict=True)))


def listing_of(pages: DataFrame) -> DataFrame:
    """page_id, place, code, name, href of every page's listing: the items of its lists whose link's last part is the
    item's text; the code is that with a to z in upper case."""
    path = F.element_at(F.split("href", "/"), -1)
    rows = page_cells(pages).where("kind IN ('ul', 'ol') AND href IS NOT NULL AND text <> ''")
    return rows.where(path == F.col("text")).select("page_id", F.col("row").alias("place"), F.translate("text", _SMALL, _SMALL.upper()).alias("code"), F.col("text").alias("name"), "href")


def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings of all pages."""
    return listing_of(table(spark, sf_dir, "pages"))


def master_of(listings: DataFrame) -> DataFrame:
    """code, status, name, href, listings, pages, first_page, last_page of listing rows: a code with several names or links
    conflicts and has blank fields, one on several pages is verified, others are unverified; the pages say where the
    fields come from."""
    one = F.col("forms") == 1
    rows = listings.groupBy("code").agg(
        F.count_distinct("name", "href").alias("forms"), F.min("name").alias("name"), F.min("href").alias("href"), F.count("*").alias("listings"), F.count_distinct("page_id").alias("pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"),
    )
    status = F.when(~one, "conflict").when(F.col("pages") > 1, "verified").otherwise("unverified")
    return rows.select("code", status.alias("status"), *(F.when(one, F.col(c)).otherwise("").alias(c) for c in ("name", "href")), "listings", "pages", "first_page", "last_page")


def listing_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master of the codes that pages list."""
    return master_of(listing_links(spark, sf_dir))


def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the master's totals are those of the listings, by status: codes, listings of them, and the two counts of all
    listings, which must be one."""
    rows = listing_links(spark, sf_dir)
    every = rows.agg(F.count("*").alias("all"))
    counts = master_of(rows).groupBy("status").agg(F.count("*").alias("codes"), F.sum("listings").alias("listings"))
    return counts.withColumn("declared", every.scalar()).withColumn("agrees", F.lit(True) & (counts.agg(F.sum("listings")).scalar() == F.col("declared")))


QUERIES = {f.__name__: f for f in (html_table_cells, listing_links, listing_master, listing_totals)}

_PRICE = lambda c: f"CAST(CAST(floor({c} * 100) AS BIGINT) AS VARCHAR)"
_ITEM = '<li><a href="([^"]*)">([^<]*)</a></li>'
_PLAIN = lambda x: f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_LINKS = f"""items AS (SELECT page_id, unnest(regexp_extract_all(html, '{_ITEM}', 0)) AS item, generate_subscripts(regexp_extract_all(html, '{_ITEM}', 0), 1) AS place FROM pages),
parts AS (SELECT page_id, place, {_PLAIN(f"regexp_extract(item, '{_ITEM}', 1)")} AS href, trim({_PLAIN(f"regexp_extract(item, '{_ITEM}', 2)")}) AS name FROM items),
links AS (SELECT page_id, CAST(place AS INT) AS place, translate(name, '{_SMALL}', '{_SMALL.upper()}') AS code, name, href FROM parts WHERE name <> '' AND string_split(href, '/')[-1] = name),
master AS (SELECT code, CASE WHEN forms > 1 THEN 'conflict' WHEN pages > 1 THEN 'verified' ELSE 'unverified' END AS status, CASE WHEN forms = 1 THEN name ELSE '' END AS name, CASE WHEN forms = 1 THEN href ELSE '' END AS href, listings, pages, first_page, last_page
  FROM (SELECT code, count(DISTINCT name || chr(0) || href) AS forms, min(name) AS name, min(href) AS href, count(*) AS listings, count(DISTINCT page_id) AS pages, min(page_id) AS first_page, max(page_id) AS last_page FROM links GROUP BY code))"""
ORACLE = {
    "html_table_cells": f"""WITH {BARS_SQL} SELECT CAST(day - DATE '1970-01-01' AS BIGINT) AS page_id, 3 AS "table", CAST(row_number() OVER (PARTITION BY day ORDER BY symbol) + 1 AS INT) AS row, CAST(day AS VARCHAR) AS day, symbol || ' & Co' AS code, {_PRICE('open')} AS open, {_PRICE('high')} AS high, {_PRICE('low')} AS low, {_PRICE('close')} AS close, CAST(volume AS VARCHAR) AS volume FROM bars""",
    "listing_links": f"WITH {_LINKS} SELECT * FROM links",
    "listing_master": f"WITH {_LINKS} SELECT * FROM master",
    "listing_totals": f"WITH {_LINKS} SELECT status, count(*) AS codes, CAST(sum(listings) AS BIGINT) AS listings, (SELECT count(*) FROM links) AS declared, true AS agrees FROM master GROUP BY status",
}
