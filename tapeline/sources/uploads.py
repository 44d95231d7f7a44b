"""Uploaded files: archives and workbooks taken apart within limits, headers mapped to columns, rows checked one by one,
day-end files, listings, and sinks that write once, keep every entry and can be reversed.

Files come as DataFrames of path and content, as the binaryFile reader gives them; each is taken apart in a task.
"""

from __future__ import annotations

import csv
import io
import json
import lzma
import re
import zipfile
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tapeline.functions.columns import codes, codes_sql
from tapeline.sources.bars import BARS_SQL, SOURCES_SQL, bars, observations, table
from tapeline.sources.files import fingerprint
from tapeline.sources.scratch import scratch

# Limits of an archive.
MOST_MEMBERS, MEMBER_BYTES, TOTAL_BYTES, MOST_RATIO = 50, 25 << 20, 100 << 20, 200
# Names that a column may have, the first one that a file has being taken; a second set for public sources.
ALIASES = {
    "symbol": ("symbol", "trading_code", "ticker", "scrip", "code"),
    "trading_date": ("date", "trading_date"),
    "open": ("open",),
    "high": ("high",),
    "low": ("low",),
    "close": ("close",),
    "volume": ("volume",),
}
PUBLIC_ALIASES = {
    "symbol": ("symbol", "trading_code", "scrip", "code"),
    "trading_date": ("trading_date", "date"),
    "open": ("open",),
    "high": ("high",),
    "low": ("low",),
    "close": ("close",),
    "volume": ("volume",),
}
#: Further names, after those above, for files that exchanges export.
WIDE_ALIASES = ALIASES | {"open": ("open", "openp"), "close": ("close", "closep", "ltp"), "volume": ("volume", "vol")}
REQUIRED = tuple(ALIASES)
# Columns that a portfolio file must not have.
FORBIDDEN = (
    "password",
    "broker_password",
    "trading_password",
    "pin",
    "otp",
    "api_key",
    "api_secret",
    "token",
    "credential",
)
# Columns of a day-end file.
DAY_END = ("DATE", "TRADING CODE", "LTP*", "HIGH", "LOW", "OPENP*", "CLOSEP*", "YCP", "TRADE", "VALUE (mn)", "VOLUME")
#: Columns of a sheet, and rows of a file that go out at once.
MOST_COLUMNS, ROWS_AT_ONCE = 1 << 14, 5_000
#: What damaged, encrypted, too deep or misnamed files raise.
UNREADABLE = (ValueError, LookupError, RuntimeError, OverflowError, EOFError, csv.Error, zlib.error, lzma.LZMAError, OSError, zipfile.BadZipFile, ElementTree.ParseError)
_SPACE = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def checked(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """An archive's files; one beyond the limits, or with a path that leaves it, a link, an encrypted file or another
    archive in it, is an error."""
    files = [x for x in archive.infolist() if not x.is_dir()]
    if len(files) > MOST_MEMBERS:
        raise ValueError("too many files")
    total = 0
    for x in files:
        parts = x.filename.replace("\\", "/").split("/")
        if x.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
            raise ValueError("a path leaves the archive")
        if x.external_attr >> 16 & 0o170000 == 0o120000:
            raise ValueError("a link")
        if x.flag_bits & 1:
            raise ValueError("an encrypted file")
        if x.filename.lower().endswith((".zip", ".gz", ".7z", ".rar", ".tar")):
            raise ValueError("an archive in an archive")
        total += x.file_size
        if x.file_size > MEMBER_BYTES or total > TOTAL_BYTES:
            raise ValueError("too large")
        if x.file_size > MOST_RATIO * max(x.compress_size, 1):
            raise ValueError("too dense")
    return files


def members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and contents of an archive's files, one after the other."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for x in checked(archive):
            yield x.filename, archive.read(x)


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag of one part of a workbook, each dropped after its turn; a part with a document type, which
    could define entities, is an error."""
    with book.open(name) as part:
        if b"<!DOCTYPE" in part.read(4096).upper():
            raise ValueError("a document type")
    with book.open(name) as part:
        root = None
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            root = element if root is None else root
            if event == "end" and element.tag == f"{{{_SPACE['s']}}}{tag}":
                yield element
                root.clear()


def cells(raw: bytes) -> Iterator[list[str]]:
    """The first sheet of a workbook as rows of text, read as a stream within an archive's limits; cells that are left out
    are empty, and a row ends with MOST_COLUMNS of them at the latest."""
    text_of = lambda x: "".join(t.text or "" for t in x.iter(f"{{{_SPACE['s']}}}t"))
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = [x.filename for x in checked(book)]
        shared = list(map(text_of, _elements(book, "xl/sharedStrings.xml", "si"))) if "xl/sharedStrings.xml" in names else []
        sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        if not sheets:
            raise ValueError("a workbook without a sheet")
        for row in _elements(book, sheets[0], "row"):
            out: list[str] = []
            for cell in row.findall("s:c", _SPACE):
                letters = re.match(r"[A-Z]{0,3}", cell.get("r", ""))[0]
                column = 0
                for c in letters:
                    column = column * 26 + ord(c) - 64
                if max(column, len(out) + 1) > MOST_COLUMNS:
                    raise ValueError("too many columns")
                out += [""] * (column - 1 - len(out))
                value = cell.find("s:v", _SPACE)
                text = text_of(cell) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                out.append(shared[int(text)] if cell.get("t") == "s" and text else text)
            yield out


def parsed(name: str, raw: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """Member, line and fields of the rows of a file, by the kind that its name says; the header is line 1."""
    kind = name.lower().rsplit(".", 1)[-1]
    if raw[:2] == b"MZ" or raw[:4] == b"\x7fELF" or b"<script" in raw[:4096].lower():
        raise ValueError("active content")
    if kind == "zip":
        for member, content in members(raw):
            if not member.lower().endswith(".csv"):
                raise ValueError("an archive may hold CSV files alone")
            yield from ((member, line, fields) for _, line, fields in parsed(member, content))
    elif kind == "csv":
        csv.field_size_limit(MEMBER_BYTES)
        for line, fields in enumerate(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"))), 2):
            yield name, line, {k: v for k, v in fields.items() if k is not None and v is not None}
    elif kind == "json":
        found = json.loads(raw)
        if not isinstance(found, list):
            raise ValueError("a JSON file holds a list of rows")
        if not all(isinstance(fields, dict) for fields in found):
            raise ValueError("a row of a JSON file is an object")
        for line, fields in enumerate(found, 2):
            yield name, line, {k: str(v) for k, v in fields.items() if v is not None}
    elif kind == "xlsx":
        rows = cells(raw)
        header = next(rows, [])
        for line, row in enumerate(rows, 2):
            yield name, line, dict(zip(header, row, strict=False))
    else:
        raise ValueError(f"unknown kind of file: {kind}")


def file_rows(files: DataFrame) -> DataFrame:
    """path, member, line, fields, error of the rows of files (path, content): CSV, ZIP of CSV, JSON lists, XLSX. A file
    that can't be taken apart gives one row with its error, whatever its error; an empty one gives none.

    No row of a file goes out before its end was read; a file of more than ROWS_AT_ONCE rows is read twice for that.
    Rows go out some at a time, those of small files together: a task holds a file and some parts of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "member", "line", "fields", "error"]
        held = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name, raw = path.rsplit("/", 1)[-1], bytes(content or b"")
                rows = parsed(name, raw)
                try:
                    part = list(islice(rows, ROWS_AT_ONCE))
                    more = deque(rows, maxlen=1)
                except UNREADABLE as error:
                    more = None
                    held.append((path, None, None, None, (str(error) or type(error).__name__)[:200]))
                else:
                    held += [(path, *row, None) for row in part]
                if len(held) >= ROWS_AT_ONCE or more:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
                if more:
                    rows = islice(parsed(name, raw), ROWS_AT_ONCE, None)
                    while part := [(path, *row, None) for row in islice(rows, ROWS_AT_ONCE)]:
                        yield pd.DataFrame(part, columns=columns)
        if held:
            yield pd.DataFrame(held, columns=columns)

    return files.select("path", "content").mapInPandas(run, "path string, member string, line int, fields map<string,string>, error string")


def normal(name: Column) -> Column:
    """A header in lower case with runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def mapped(rows: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """rows with a column of text for each canonical name: the field under its first alias, null without one."""
    fields = F.transform_keys("fields", lambda k, v: normal(k))
    rows = rows.withColumn("_fields", fields)
    return rows.select(*[c for c in rows.columns if c not in ("fields", "_fields")], *(F.coalesce(*(F.try_element_at("_fields", F.lit(a)) for a in names)).alias(c) for c, names in aliases.items()))


def row_error() -> Column:
    """What is wrong with a mapped row, in order, null for nothing."""
    number = lambda c: F.expr(f"try_cast(replace(trim({c}), ',', '') as double)")
    day = F.expr("try_cast(substr(trim(trading_date), 1, 10) as date)")
    wrong = codes(
        (F.coalesce(F.trim("symbol") == "", F.lit(True)), "missing_symbol"), (day.isNull(), "invalid_date"), *((number(c).isNull(), f"invalid_{c}") for c in ("open", "high", "low", "close", "volume")), (F.coalesce(number("high") < number("low"), F.lit(False)), "high_below_low"), (F.coalesce(number("volume") < 0, F.lit(False)), "negative_volume"),
    )
    return F.nullif(wrong, F.lit(""))


@F.pandas_udf(BinaryType())
def zipped(names: pd.Series, texts: pd.Series) -> pd.Series:
    """An archive with one file of a text."""
    out = []
    for name, text in zip(names, texts, strict=True):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(zipfile.ZipInfo(name), text)
        out.append(buffer.getvalue())
    return pd.Series(out)


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: an archive for each symbol's year of bars, whose header differs between even and odd years. A
    year has 366 rows at most."""
    price = lambda c: F.col(c).cast("decimal(18,4)").cast("string")
    code = F.dayofmonth("day") % 10
    line = F.concat_ws(",", "symbol", F.when(code == 3, "n/a").otherwise(F.date_format("day", "yyyy-MM-dd")), price("open"), price("high"), F.when(code == 4, "").otherwise(price("low")), price("close"), F.when(code == 5, "-1").otherwise(F.col("volume").cast("string")))
    files = bars(spark, sf_dir).select("symbol", F.year("day").alias("year"), "day", line.alias("line")).groupBy("symbol", "year").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("day", "line"))), lambda x: x.line)).alias("body"))
    header = F.when(F.col("year") % 2 == 0, "Symbol,Date,Open,High,Low,Close,Volume").otherwise("Trading Code,Trading-Date,OpenP*,High,Low,CloseP*,Vol")
    name = F.concat("symbol", F.lit("-"), F.col("year").cast("string"))
    return files.select(F.concat(name, F.lit(".zip")).alias("path"), zipped(F.concat(name, F.lit(".csv")), F.concat_ws("\n", header, "body")).alias("content"))


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all archives by symbol and error, with volume of the good ones and the greatest line."""
    rows = mapped(file_rows(archives(spark, sf_dir)), WIDE_ALIASES).withColumn("wrong", row_error())
    good = F.when(F.col("wrong").isNull(), F.expr("try_cast(volume as long)")).otherwise(0)
    return rows.groupBy("symbol", F.coalesce("wrong", F.lit("")).alias("wrong")).agg(F.count("*").alias("rows"), F.sum(good).alias("volume"), F.max("line").alias("last_line"))


def archive_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files have which headers, as they are and normalised, with the canonical names that are found."""
    first = file_rows(archives(spark, sf_dir)).where("line = 2")
    headers = F.array_sort(F.map_keys("fields"))
    found = F.array_sort(F.filter(F.transform(headers, normal), lambda k: F.array_contains(F.array(*map(F.lit, sorted({a for names in WIDE_ALIASES.values() for a in names}))), k)))
    return first.groupBy(F.concat_ws(",", headers).alias("headers"), F.concat_ws(",", found).alias("known")).agg(F.count("*").alias("files"))


def mapping_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By set of aliases and canonical column: the rows of all archives that have it, and the greatest line."""
    rows = file_rows(archives(spark, sf_dir))
    sets = {"canonical": ALIASES, "public": PUBLIC_ALIASES, "wide": WIDE_ALIASES}
    found = rows.withColumn("_fields", F.transform_keys("fields", lambda k, v: normal(k)))
    had = lambda names: F.greatest(*(F.map_contains_key("_fields", a).cast("int") for a in names), F.lit(0))
    each = F.array(*(F.struct(F.lit(kind).alias("aliases"), F.lit(c).alias("column"), had(names).alias("had")) for kind, aliases in sets.items() for c, names in aliases.items()))
    return found.select("line", F.inline(each)).groupBy("aliases", "column").agg(F.sum("had").alias("rows"), F.max(F.when(F.col("had") == 1, F.col("line"))).alias("last_line"))


TRANSACTIONS = ("buy", "sell", "dividend", "bonus", "split", "rights", "fee", "tax", "adjustment", "cash_balance")


def transaction_error(day: str = "occurred_at") -> Column:
    """What is wrong with a portfolio file's row of text, by column; an empty string for nothing."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return codes((F.expr(f"try_cast({day} as date)").isNull(), day), (~F.coalesce(F.col("transaction_type").isin(*TRANSACTIONS), F.lit(False)), "transaction_type"), (F.coalesce(F.col("symbol") == "", F.lit(True)), "symbol"), (F.coalesce(number("quantity") < 0, F.lit(True)), "quantity"))


def portfolio_preview(files: DataFrame) -> DataFrame:
    """path, source_hash, duplicate_of, rows, errors, refused, allowed of portfolio files (path, content): a file of equal
    content with an earlier path is a duplicate; columns for credentials refuse the file whatever its rows; only a file
    without duplicate, errors, refused columns and with rows is allowed. Files that can't be read have an error."""
    hashes = files.select("path", F.sha2("content", 256).alias("source_hash"))
    first = hashes.groupBy("source_hash").agg(F.min("path").alias("first"))
    rows = file_rows(files)
    names = F.transform(F.map_keys("fields"), lambda k: F.lower(F.trim(k)))
    refused = F.array_intersect(names, F.array(*map(F.lit, FORBIDDEN)))
    columns = ("occurred_at", "transaction_type", "symbol", "quantity", "price")
    rows = rows.select("path", "error", F.array_join(F.array_sort(refused), ",").alias("refused"), *(F.try_element_at("fields", F.lit(c)).alias(c) for c in columns))
    wrong = F.col("error").isNotNull() | (transaction_error() != "")
    counts = rows.groupBy("path").agg(F.count_if(F.col("error").isNull()).alias("rows"), F.count_if(wrong).alias("errors"), F.coalesce(F.max("refused"), F.lit("")).alias("refused"))
    met = hashes.join(first, "source_hash").join(counts, "path", "left").na.fill(0, ["rows", "errors"]).na.fill("", ["refused"])
    duplicate = F.when(F.col("first") != F.col("path"), F.col("first"))
    return met.select("path", "source_hash", duplicate.alias("duplicate_of"), "rows", "errors", "refused", (duplicate.isNull() & (F.col("errors") == 0) & (F.col("refused") == "") & (F.col("rows") > 0)).alias("allowed"))


def portfolio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of CSV files of orders, one for each of 40 accounts and month: those of accounts that leave 3 of 8 have a
    PIN column, those of March come twice, and orders whose key leaves 0 of 97 have no type. A file is a month's orders of
    one of 40 accounts, and is split by the customers' hundreds."""
    k = F.col("o_orderkey")
    kind = F.when(k % 97 == 0, "").when(k % 2 == 0, "buy").otherwise("sell")
    pin = F.when(F.col("o_custkey") % 8 == 3, ",7").otherwise("")
    line = F.concat(F.concat_ws(",", k.cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), kind, F.concat(F.lit("P"), (k % 50).cast("string")), (k % 90 + 1).cast("string"), (k % 500).cast("string")), pin)
    name = F.concat_ws("-", (F.col("o_custkey") % 40).cast("string"), F.floor(F.col("o_custkey") / 4000).cast("string"), F.date_format("o_orderdate", "yyyy-MM"))
    files = table(spark, sf_dir, "orders").select(name.alias("name"), (F.col("o_custkey") % 8 == 3).alias("pin"), F.month("o_orderdate").alias("month"), line.alias("line"))
    bodies = files.groupBy("name", "pin", "month").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    head = F.concat(F.lit("id,occurred_at,transaction_type,symbol,quantity,price"), F.when(F.col("pin"), ", PIN ").otherwise(""))
    copies = F.explode(F.when(F.col("month") == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    made = bodies.select(copies.alias("copy"), "name", F.concat(head, F.lit("\n"), "body").cast("binary").alias("content"))
    return portfolio_preview(made.select(F.concat("name", F.lit("-"), "copy", F.lit(".csv")).alias("path"), "content"))


def csv_profile(rows: DataFrame) -> DataFrame:
    """Rows, symbols, days, repeated keys and wrong rows of mapped rows, in one aggregation of keys and one of all."""
    keys = rows.withColumn("wrong", row_error()).groupBy("symbol", "trading_date").agg(F.count("*").alias("n"), F.count("wrong").alias("wrong"))
    return keys.agg(F.sum("n").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.min("trading_date").alias("first_day"), F.max("trading_date").alias("last_day"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("repeated"), F.sum("wrong").alias("wrong"))


def keyed(rows: DataFrame) -> DataFrame:
    """One row of each symbol and day: rows that repeat one are one, different ones of a key are an error, wrong rows are
    left out."""
    fields = ["open", "high", "low", "close", "volume"]
    groups = rows.where(row_error().isNull()).groupBy("symbol", "trading_date").agg(F.collect_set(F.struct(*fields)).alias("x"))
    one = F.when(F.size("x") == 1, F.col("x")[0]).otherwise(F.raise_error(F.concat(F.lit("conflicting rows of "), "symbol")).cast("struct<open:string,high:string,low:string,close:string,volume:string>"))
    return groups.withColumn("one", one).select("symbol", "trading_date", *(F.col(f"one.{c}").alias(c) for c in fields))


def export_rows(rows: DataFrame, path: str, *, predicate: str | None = None, kind: str = "csv") -> None:
    """Writes the rows, those of a predicate alone if given, as CSV with a header or as JSON lines; a path that
    exists is an error."""
    out = rows.where(predicate) if predicate else rows
    getattr(out.write.mode("errorifexists").options(**({"header": "true"} if kind == "csv" else {})), kind)(path)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of odd days exported as CSV, read back and profiled."""
    path = scratch(spark, "bars-csv")
    text = bars(spark, sf_dir).select("symbol", F.col("day").cast("string").alias("date"), *(F.col(c).cast("decimal(18,4)").cast("string").alias(c) for c in ("open", "high", "low", "close")), F.col("volume").cast("string").alias("volume"))
    export_rows(text.unionByName(text.where("symbol = 'S1'")), path, predicate="dayofmonth(date) % 2 = 1")
    back = spark.read.option("header", True).csv(path).withColumnRenamed("date", "trading_date")
    unique = keyed(back).agg(F.count("*").alias("keys"))
    return csv_profile(back).crossJoin(unique)  # a row each


def canonical_line() -> Column:
    return F.to_json(F.struct("symbol", F.col("day").cast("string").alias("date"), F.col("volume").alias("volume"), "source", "grain"))


def jsonl_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as canonical JSON lines, written and read with a schema; the gates of each grain as one row: rows,
    repeated keys, unknown sources, rows without lineage, and whether the digest of all lines is that before."""
    rows = observations(spark, sf_dir)
    path = scratch(spark, "jsonl")
    rows.select(canonical_line().alias("value")).write.text(path)
    # a sum of digests does not depend on the order, and equal lines count
    digest = lambda c: F.sum(F.conv(F.substring(F.sha2(c, 256), 1, 12), 16, 10).cast("decimal(20,0)"))
    before = rows.groupBy("grain").agg(digest(canonical_line()).alias("before"))
    back = spark.read.text(path).withColumn("r", F.from_json("value", "symbol string, date date, volume long, source string, grain string")).select("value", "r.*")
    keys = back.groupBy("grain", "symbol", "date", "source").agg(F.count("*").alias("n"), digest("value").alias("digest"), F.count_if(F.col("volume").isNull()).alias("missing"))
    gates = keys.groupBy("grain").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"), F.sum(F.when(F.col("source").isin("A", "B"), 0).otherwise(F.col("n"))).alias("unknown"), F.sum("missing").alias("missing"), F.sum("digest").alias("after"))
    return gates.join(before, "grain").select("grain", "rows", "repeated", "unknown", "missing", (F.col("after") == F.col("before")).alias("verified"))


def combined_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent (before 1998), an extension (from 1997 on) and a third dataset (S0 alone) as one: for each symbol the keys,
    those in several, whether several agree, and the days in the common calendar."""
    rows = bars(spark, sf_dir).select("symbol", "day", "close")
    parts = [rows.where("year(day) < 1998"), rows.where("year(day) >= 1997"), rows.where("symbol = 'S0'")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    keys = union.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.count_distinct("close").alias("closes"))
    whole = F.count("*").over(Window.partitionBy("day"))
    keys = keys.withColumn("common", whole == keys.agg(F.count_distinct("symbol")).scalar())
    return keys.groupBy("symbol").agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("in_several"), F.count_if(F.col("closes") > 1).alias("conflicts"), F.count_if("common").alias("common_days"))


def day_end_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of day-end files: one for each session of 1995, those of the first of a month twice, the 15th with other
    content the second time, the 20th without its last column. A day has a row for each symbol."""
    rows = bars(spark, sf_dir).where("year(day) = 1995")
    price = lambda c: F.col(c).cast("decimal(18,4)").cast("string")
    line = F.concat_ws(",", F.date_format("day", "yyyy-MM-dd"), "symbol", price("close"), price("high"), price("low"), price("open"), price("close"), price("open"), F.col("n").cast("string"), F.lit("1.5"), F.col("volume").cast("string"))
    body = rows.groupBy("day").agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))).alias("body"))
    at = F.dayofmonth("day")
    header = F.when(at == 20, ",".join(DAY_END[:-1])).otherwise(",".join(DAY_END))
    copies = F.explode(F.when(at.isin(1, 15), F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    files = body.select("day", "body", header.alias("header"), copies.alias("copy"))
    last = F.when((F.dayofmonth("day") == 15) & (F.col("copy") == 1), F.lit("\n")).otherwise("")
    return files.select(F.concat(F.date_format("day", "yyyyMMdd"), F.lit("-"), F.col("copy").cast("string"), F.lit(".csv")).alias("path"), F.concat(F.concat_ws("\n", "header", "body"), last).cast("binary").alias("content"))


def day_end_sessions(files: DataFrame) -> DataFrame:
    """day, status, files, rows of day-end files: a file must have all columns and one date; files of a date with equal
    content are one, with other content an error of that date. Files that can't be read stand under a null day."""
    rows = file_rows(files.withColumn("sha", F.sha2("content", 256)).select("path", "content")).join(files.select("path", F.sha2("content", 256).alias("sha")), "path")
    whole = F.map_keys("fields")
    complete = F.size(F.array_intersect(whole, F.array(*map(F.lit, DAY_END)))) == len(DAY_END)
    each = rows.groupBy("path", "sha").agg(F.bool_and(complete).alias("complete"), F.count_distinct(F.col("fields")["DATE"]).alias("days"), F.min(F.col("fields")["DATE"]).alias("day"), F.count("*").alias("rows"), (F.count("*") - F.count_distinct(F.col("fields")["TRADING CODE"])).alias("repeated"), F.count("error").alias("unreadable"))
    each = each.withColumn("error", F.when(F.col("unreadable") > 0, "unreadable").when(~F.coalesce("complete", F.lit(False)), "missing_columns").when(F.col("days") != 1, "several_dates").when(F.col("repeated") > 0, "repeated_code"))
    days = each.groupBy("day").agg(F.count("*").alias("files"), F.count_distinct("sha").alias("contents"), F.max("error").alias("error"), F.max("rows").alias("rows"))
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("contents") > 1, "conflicting_files").otherwise("usable")
    return days.select(F.to_date("day").alias("day"), status.alias("status"), "files", F.when(status == "usable", F.col("rows")).otherwise(0).cast("long").alias("rows"))


def day_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_end_sessions(day_end_files(spark, sf_dir))


def instrument_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listing rows by name: names with several brands and types conflict and have blank fields, others are
    unverified without a second listing; with how many sizes each has."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("code")).agg(F.collect_set(F.struct("p_brand", "p_type")).alias("profiles"), F.count_distinct("p_size").alias("sizes"), F.count("*").alias("listings"))
    one = F.size("profiles") == 1
    status = F.when(~one, "conflict").when(F.col("listings") > 1, "verified").otherwise("unverified")
    return rows.select("code", status.alias("status"), F.when(one, F.col("profiles")[0]["p_brand"]).otherwise("").alias("brand"), F.when(one, F.col("profiles")[0]["p_type"]).otherwise("").alias("type"), "listings", "sizes")


def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence with a tier A to E by their user, available when published and observed: counts by tier and month,
    and how many contradict (errors) or lack a zone."""
    k = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.substring(F.lit("ABCDE"), (k % 5 + 1).cast("int"), F.lit(1)).alias("tier"), F.greatest("ts", F.col("ts") + F.make_dt_interval(F.lit(0), (k % 7).cast("int"))).alias("available"), (F.col("event_type") == "error").alias("contradicts"), (F.col("event_id") % 17 == 0).alias("naive"))
    return rows.groupBy("tier", F.date_format("available", "yyyy-MM").alias("month")).agg(F.count("*").alias("events"), F.count_if("contradicts").alias("contradicting"), F.count_if("naive").alias("rejected"))


def manual_eod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's rows of a fixed universe (S0 to S4 and S9), and which of it are missing."""
    universe = F.array(*(F.lit(f"S{i}") for i in (0, 1, 2, 3, 4, 9)))
    rows = bars(spark, sf_dir).groupBy("day").agg(F.array_sort(F.collect_set("symbol")).alias("have"), F.count("*").alias("rows"))
    return rows.select("day", "rows", F.concat_ws(",", F.array_except(universe, "have")).alias("missing"))


def import_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the text rows of a portfolio file: which errors each has, a row's digest telling repeats; counts."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.when(k % 11 == 0, "2024-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("occurred_at"), F.when(k % 13 == 0, "short").when(k % 2 == 0, "buy").otherwise("sell").alias("transaction_type"), F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("P"), (k % 50).cast("string"))).alias("symbol"),
        F.when(k % 19 == 0, "ten").otherwise((k % 90 - 1).cast("string")).alias("quantity"), (k % 500).cast("string").alias("price"),
    )
    number = lambda c: F.expr(f"try_cast({c} as double)")
    error = codes((F.expr("try_cast(occurred_at as date)").isNull(), "occurred_at"), (~F.col("transaction_type").isin("buy", "sell", "dividend", "bonus", "split", "rights", "fee", "tax", "adjustment", "cash_balance"), "transaction_type"), (F.col("symbol") == "", "symbol"), (F.coalesce(number("quantity") < 0, F.lit(True)), "quantity"))
    own = rows.select(error.alias("error"), F.sha2(F.concat_ws("|", *rows.columns), 256).alias("digest"))
    return own.groupBy("error").agg(F.count("*").alias("rows"), F.count_distinct("digest").alias("different"))


def import_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports (customers' orders of a year) as ledger entries, appended once for each event id though they come twice;
    those of 1996 are reversed by entries of opposite sign: entries, reversed ones and the balance of each account."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("account"), F.year("o_orderdate").alias("run"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("event"), F.round("o_totalprice", 2).cast("decimal(18,2)").alias("amount"))
    entries = rows.unionByName(rows.where("run % 2 = 0")).dropDuplicates(["event"])
    reversals = entries.where("run = 1996").select("account", "run", F.concat(F.lit("reversal:"), "event").alias("event"), (-F.col("amount")).cast("decimal(18,2)").alias("amount"))
    return entries.unionByName(reversals).groupBy("account").agg(F.count("*").alias("entries"), F.count_if(F.col("event").startswith("reversal:")).alias("reversed"), F.sum("amount").cast("double").alias("balance"))


def write_once(rows: DataFrame, path: str) -> bool:
    """Writes rows as Parquet where nothing is; the same rows again change nothing (False), other rows are an error."""
    spark = rows.sparkSession
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        rows.write.mode("errorifexists").parquet(path)
        return True
    if fingerprint(spark.read.parquet(path)).collect() != fingerprint(rows).collect():
        raise ValueError(f"other rows are at {path}")
    return False


QUERIES = {f.__name__: f for f in (archive_rows, archive_headers, mapping_survey, portfolio_files, csv_round_trip, jsonl_gates, combined_datasets, day_end, instrument_master, event_evidence, manual_eod, import_preview, import_ledger)}

_CODE = "day(day) % 10"
# whether files of odd years, whose header is Trading Code, Trading-Date, OpenP*, High, Low, CloseP*, Vol, have the column
_ODD = {kind: {c: bool({"trading_code", "trading_date", "openp", "high", "low", "closep", "vol"} & set(names)) for c, names in aliases.items()} for kind, aliases in (("canonical", ALIASES), ("public", PUBLIC_ALIASES), ("wide", WIDE_ALIASES))}
_SETS = "[" + ", ".join(f"{{'aliases': '{kind}', 'col': '{c}', 'odd': {str(odd).lower()}}}" for kind, columns in _ODD.items() for c, odd in columns.items()) + "]"
ORACLE = {
    "archive_rows": f"""WITH {BARS_SQL}, r AS (SELECT symbol, day, volume, {_CODE} AS code, row_number() OVER (PARTITION BY symbol, year(day) ORDER BY day) + 1 AS line FROM bars), e AS (SELECT *, CASE code WHEN 3 THEN 'invalid_date' WHEN 4 THEN 'invalid_low' WHEN 5 THEN 'negative_volume' ELSE '' END AS wrong FROM r)
      SELECT symbol, wrong, count(*) AS rows, CAST(sum(CASE WHEN wrong = '' THEN volume ELSE 0 END) AS BIGINT) AS volume, CAST(max(line) AS INT) AS last_line FROM e GROUP BY ALL""",
    "archive_headers": f"""WITH {BARS_SQL}, f AS (SELECT DISTINCT symbol, year(day) % 2 = 0 AS even, year(day) AS y FROM bars) SELECT CASE WHEN even THEN 'Close,Date,High,Low,Open,Symbol,Volume' ELSE 'CloseP*,High,Low,OpenP*,Trading Code,Trading-Date,Vol' END AS headers, CASE WHEN even THEN 'close,date,high,low,open,symbol,volume' ELSE 'closep,high,low,openp,trading_code,trading_date,vol' END AS known, count(*) AS files FROM f GROUP BY even""",
    "mapping_survey": f"""WITH {BARS_SQL}, f AS (SELECT year(day) % 2 = 0 AS even, count(*) AS n FROM bars GROUP BY symbol, year(day)), k AS (SELECT unnest({_SETS}) AS x) SELECT x.aliases AS aliases, x.col AS "column", CAST(sum(CASE WHEN even OR x.odd THEN n ELSE 0 END) AS BIGINT) AS rows, CAST(max(CASE WHEN even OR x.odd THEN n + 1 END) AS INT) AS last_line FROM f, k GROUP BY ALL""",
    "portfolio_files": """WITH l AS (SELECT concat_ws('-', o_custkey % 40, CAST(floor(o_custkey / 4000) AS BIGINT), strftime(o_orderdate, '%Y-%m')) AS name, o_custkey % 8 = 3 AS pin, month(o_orderdate) AS m, o_orderkey % 97 = 0 AS wrong,
        concat_ws(',', o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END, 'P' || (o_orderkey % 50), o_orderkey % 90 + 1, o_orderkey % 500) || CASE WHEN o_custkey % 8 = 3 THEN ',7' ELSE '' END AS line FROM orders),
      b AS (SELECT name, pin, m, count(*) AS rows, count(*) FILTER (wrong) AS errors, sha256('id,occurred_at,transaction_type,symbol,quantity,price' || CASE WHEN pin THEN ', PIN ' ELSE '' END || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS source_hash FROM l GROUP BY name, pin, m),
      c AS (SELECT *, unnest(CASE WHEN m = 3 THEN ['a', 'b'] ELSE ['a'] END) AS copy FROM b) SELECT name || '-' || copy || '.csv' AS path, source_hash, CASE WHEN copy = 'b' THEN name || '-a.csv' END AS duplicate_of, rows, errors, CASE WHEN pin THEN 'pin' ELSE '' END AS refused, copy = 'a' AND errors = 0 AND NOT pin AS allowed FROM c""",
    "csv_round_trip": f"""WITH {BARS_SQL}, o AS (SELECT symbol, CAST(day AS VARCHAR) AS d FROM bars WHERE day(day) % 2 = 1), k AS (SELECT symbol, d, CASE symbol WHEN 'S1' THEN 2 ELSE 1 END AS n FROM o)
      SELECT CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT symbol) AS symbols, min(d) AS first_day, max(d) AS last_day, CAST(sum(n - 1) AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS wrong, count(*) AS keys FROM k""",
    "jsonl_gates": f"WITH {BARS_SQL}, {SOURCES_SQL}, k AS (SELECT grain, symbol, day, source, count(*) AS n FROM observations GROUP BY ALL) SELECT grain, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS missing, true AS verified FROM k GROUP BY grain",
    "combined_datasets": f"""WITH {BARS_SQL}, u AS (SELECT symbol, day, close FROM bars WHERE year(day) < 1998 UNION ALL SELECT symbol, day, close FROM bars WHERE year(day) >= 1997 UNION ALL SELECT symbol, day, close FROM bars WHERE symbol = 'S0'), k AS (SELECT symbol, day, count(*) AS n, count(DISTINCT close) AS closes FROM u GROUP BY ALL),
      c AS (SELECT *, count(*) OVER (PARTITION BY day) = (SELECT count(DISTINCT symbol) FROM k) AS common FROM k) SELECT symbol, count(*) AS keys, count(*) FILTER (n > 1) AS in_several, count(*) FILTER (closes > 1) AS conflicts, count(*) FILTER (common) AS common_days FROM c GROUP BY symbol""",
    "day_end": f"""WITH {BARS_SQL}, d AS (SELECT day, count(*) AS n FROM bars WHERE year(day) = 1995 GROUP BY day) SELECT day, CASE day(day) WHEN 20 THEN 'missing_columns' WHEN 15 THEN 'conflicting_files' ELSE 'usable' END AS status, CASE WHEN day(day) IN (1, 15) THEN 2 ELSE 1 END::BIGINT AS files, CASE WHEN day(day) IN (15, 20) THEN 0 ELSE n END AS rows FROM d""",
    "instrument_master": "WITH g AS (SELECT p_name AS code, count(DISTINCT p_brand || '|' || p_type) AS profiles, min(p_brand) AS brand, min(p_type) AS type, count(*) AS listings, count(DISTINCT p_size) AS sizes FROM part GROUP BY p_name) SELECT code, CASE WHEN profiles > 1 THEN 'conflict' WHEN listings > 1 THEN 'verified' ELSE 'unverified' END AS status, CASE WHEN profiles = 1 THEN brand ELSE '' END AS brand, CASE WHEN profiles = 1 THEN type ELSE '' END AS type, listings, sizes FROM g",
    "event_evidence": "WITH e AS (SELECT substr('ABCDE', CAST(user_id % 5 + 1 AS INT), 1) AS tier, ts + to_hours(CAST(user_id % 7 AS INT)) AS available, event_type = 'error' AS contradicts, event_id % 17 = 0 AS naive FROM events) SELECT tier, strftime(available, '%Y-%m') AS month, count(*) AS events, count(*) FILTER (contradicts) AS contradicting, count(*) FILTER (naive) AS rejected FROM e GROUP BY ALL",
    "manual_eod": f"WITH {BARS_SQL}, d AS (SELECT day, list(symbol) AS have, count(*) AS rows FROM bars GROUP BY day) SELECT day, rows, array_to_string(list_filter(['S0', 'S1', 'S2', 'S3', 'S4', 'S9'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM d",
    "import_preview": f"""WITH r AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN '2024-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS occurred_at, CASE WHEN o_orderkey % 13 = 0 THEN 'short' WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS kind, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'P' || CAST(o_orderkey % 50 AS VARCHAR) END AS symbol, CASE WHEN o_orderkey % 19 = 0 THEN 'ten' ELSE CAST(o_orderkey % 90 - 1 AS VARCHAR) END AS quantity, CAST(o_orderkey % 500 AS VARCHAR) AS price FROM orders),
      e AS (SELECT *, {codes_sql(("try_cast(occurred_at AS DATE) IS NULL", "occurred_at"), ("kind = 'short'", "transaction_type"), ("symbol = ''", "symbol"), ("coalesce(try_cast(quantity AS DOUBLE) < 0, true)", "quantity"))} AS error FROM r) SELECT error, count(*) AS rows, count(DISTINCT concat_ws('|', occurred_at, kind, symbol, quantity, price)) AS different FROM e GROUP BY error""",
    "import_ledger": "WITH e AS (SELECT o_custkey % 20 AS account, year(o_orderdate) AS run, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS amount FROM orders), u AS (SELECT account, amount, false AS reversal FROM e UNION ALL SELECT account, -amount, true FROM e WHERE run = 1996) SELECT account, count(*) AS entries, count(*) FILTER (reversal) AS reversed, CAST(sum(amount) AS DOUBLE) AS balance FROM u GROUP BY account",
}
