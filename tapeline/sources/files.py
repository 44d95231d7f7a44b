"""File sources and sinks of bars: CSV folders, HTML tables, JSON lines, text claims, and writes that repeat safely."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.sources.bars import table

COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")
# Claims of market rules and their patterns, `key: value` to the end of the line.
CLAIMS = {
    "weekly_trading_days": r"(?i)(?:trading days?|weekdays?)\s*[:=-]\s*([^\n]+)",
    "market_sessions": r"(?i)(?:market|trading)\s*(?:hours?|time)\s*[:=-]\s*([^\n]+)",
    "tick_sizes": r"(?i)tick\s*size\s*[:=-]\s*([^\n]+)",
    "price_bands": r"(?i)price\s*(?:limit|band)\s*[:=-]\s*([^\n]+)",
    "settlement": r"(?i)settlement\s*[:=-]\s*([^\n]+)",
    "buy_brokerage": r"(?i)buy\s*brokerage\s*[:=-]\s*([^\n]+)",
    "sell_brokerage": r"(?i)sell\s*brokerage\s*[:=-]\s*([^\n]+)",
    "minimum_brokerage": r"(?i)minimum\s*(?:brokerage|charge)\s*[:=-]\s*([^\n]+)",
}
#: Kinds of lines: licence, copyright and contact.
KINDS = {"licence": r"(?i)licen[cs]e", "copyright": r"(?i)copyright", "contact": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+"}
_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def csv_bars(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None, *, attested: bool = False) -> DataFrame:
    """symbol (the file's name), day, open, high, low, close, volume of a folder of <SYMBOL>.csv, between two days.

    All columns are read as text; thousand separators go. A missing column or a repeated timestamp of a symbol is
    an error, and so is, with `attested`, a row whose provenance is not operator_attested. An empty folder or file
    gives no rows."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(f"{folder}/*.csv")
    missing = [c for c in COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = lambda c, kind: F.regexp_replace(F.trim(c), ",", "").cast(kind).alias(c)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("symbol"), F.to_date(F.substring("timestamp", 1, 10)).alias("day"), *(number(c, "decimal(18,4)") for c in COLUMNS[1:5]), number("volume", "bigint"), *(["provenance"] if attested else []))
    rows = rows.where(F.col("day").between(F.coalesce(F.lit(start).cast("date"), F.lit("0001-01-01").cast("date")), F.coalesce(F.lit(end).cast("date"), F.lit("9999-12-31").cast("date"))))
    if attested:
        rows = rows.withColumn("day", F.when(F.col("provenance") == "operator_attested", F.col("day")).otherwise(F.raise_error(F.lit("a row is not operator_attested")).cast("date"))).drop("provenance")
    several = F.count("*").over(Window.partitionBy("symbol", "day")) > 1
    return rows.withColumn("day", F.when(several, F.raise_error(F.concat(F.lit("duplicate timestamp of "), "symbol")).cast("date")).otherwise(F.col("day")))


def jsonl_bars(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit schema; prices stay text until they are cast, lineage is an array."""
    return spark.read.schema("symbol string, date string, open string, high string, low string, close string, volume string, adjustment_status string, selected_source string, source_row_ids array<string>").json(path)


def insert_absent(rows: DataFrame, target: str, keys: list[str]) -> None:
    """Appends the rows whose keys the Parquet table at `target` lacks; run twice it changes nothing."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(keys)
    try:
        there = spark.read.parquet(target).select(*keys)
    except Exception as missing:  # Spark raises AnalysisException for an absent path
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows.write.parquet(target)
        return
    rows.join(there, keys, "left_anti").write.mode("append").parquet(target)


def fingerprint(rows: DataFrame) -> DataFrame:
    """rows and a digest that does not depend on order: count, and the exact sum of the rows' hashes, so that equal rows
    count each. No rows give a null digest."""
    return rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")).cast("string").alias("digest"))


class _Tables(HTMLParser):
    """Counts rows and cells of each table of a page; nested tables count for themselves."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[int]] = []
        self.open: list[list[int]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.open.append([0, 0])
            self.tables.append(self.open[-1])
        elif self.open and tag == "tr":
            self.open[-1][0] += 1
        elif self.open and tag in ("td", "th"):
            self.open[-1][1] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()


def tables_of(pages: DataFrame) -> DataFrame:
    """page_id, tables, rows, cells of the HTML tables of every page; null and empty pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Tables()
                parser.feed(html or "")
                out.append((page, len(parser.tables), sum(t[0] for t in parser.tables), sum(t[1] for t in parser.tables)))
            yield pd.DataFrame(out, columns=["page_id", "tables", "rows", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, tables long, rows long, cells long")


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_of(table(spark, sf_dir, "pages"))


def text_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that state a licence, copyright or contact: document, line number and kind."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    kind = F.when(F.col("text").rlike(r"(?i)licen[cs]e"), "licence").when(F.col("text").rlike(r"(?i)copyright"), "copyright").when(F.col("text").rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+"), "contact")
    return lines.withColumn("kind", kind).where("kind is not null").select("doc_id", (F.col("line") + 1).cast("long").alias("line"), "kind")


def claims_of(documents: DataFrame) -> DataFrame:
    """doc_id, line (from 1), claim, value: a row for each pattern of CLAIMS that a line has, with the text after it."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", _LINES)).alias("line", "text"))
    found = [F.when(F.col("text").rlike(p), F.struct(F.lit(claim).alias("claim"), F.trim(F.regexp_extract("text", p, 1), F.lit(" \t")).alias("value"))) for claim, p in CLAIMS.items()]
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("doc_id", "line", "x.claim", "x.value")


def text_claim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of market rules in documents, with their values."""
    return claims_of(table(spark, sf_dir, "documents"))


def kinds_of(documents: DataFrame) -> DataFrame:
    """doc_id, line (from 1), kind: a row for each kind of KINDS that a line states."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = [F.when(F.col("text").rlike(p), F.lit(kind)) for kind, p in KINDS.items()]
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.explode(F.array_compact(F.array(*found))).alias("kind"))


def text_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds that lines of documents state."""
    return kinds_of(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (html_tables, text_claims, text_claim_values, text_line_kinds)}
ORACLE = {
    "text_claims": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
      k AS (SELECT doc_id, line, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licence' WHEN regexp_matches(text, '(?i)copyright') THEN 'copyright' WHEN regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+') THEN 'contact' END AS kind FROM l) SELECT * FROM k WHERE kind IS NOT NULL""",
    "text_claim_values": rf"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '{_LINES}')) AS text, generate_subscripts(string_split_regex(text, '{_LINES}'), 1) AS line FROM documents)
      """ + " UNION ALL ".join(f"SELECT doc_id, line, '{claim}' AS claim, trim(regexp_extract(text, '{p}', 1), ' ' || chr(9)) AS value FROM l WHERE regexp_matches(text, '{p}')" for claim, p in CLAIMS.items()),
    "text_line_kinds": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
      """ + " UNION ALL ".join(f"SELECT doc_id, line, '{kind}' AS kind FROM l WHERE regexp_matches(text, '{p}')" for kind, p in KINDS.items()),
}
