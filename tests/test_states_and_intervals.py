"""Replay, outbox, versions, pending rebalances, intervals, claims, chains, pages and uploads on literal rows."""

import datetime as dt
import io
import random
import zipfile
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tapeline.functions.intervals import covering, merged, points_within, subtracted
from tapeline.operators import evidence
from tapeline.plans import pending
from tapeline.sources import listings, uploads, versions
from tapeline.streaming import outbox, replay

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def sessions(spark):
    """Two runs over 26 months, three symbols that rise, fall and swing, a session each second day."""
    rng = random.Random(4)
    rows = []
    for run in ("a", "b"):
        price = {"X": 100.0, "Y": 80.0, "Z": 50.0}
        for k in range(0, 800, 2):
            for s, drift in (("X", 1.004), ("Y", 0.998), ("Z", 1.001)):
                price[s] *= drift * rng.uniform(0.97, 1.03)
            rows.append((run, day(k), [(s, p * 0.99, p, rng.choice([None, 50, 900, 100_000])) for s, p in price.items()]))
    return spark.createDataFrame(rows, "run string, day date, market array<struct<symbol:string,open:double,close:double,volume:long>>")


def test_a_stopped_replay_goes_on_and_equals_the_fold(spark, sessions, tmp_path):
    folder, state, out = (f"file://{tmp_path}/{x}" for x in ("in", "state", "out"))
    early, late = (sessions.where(c) for c in ("day < '2021-03-01'", "day >= '2021-03-01'"))
    replay.stored(early, folder)
    first = replay.followed(spark, folder, state, out, files=1).count()
    assert first == early.count()
    early.where("day > '2021-01-01'").coalesce(1).write.mode("append").parquet(folder)  # delivered again
    replay.stored(late, folder)
    found = replay.followed(spark, folder, state, out, files=1)
    assert sorted(map(tuple, found.select("run", *replay._NAMES).collect())) == sorted(map(tuple, replay.folded(sessions).select("run", *replay._NAMES).collect()))
    last = found.groupBy("run").agg(F.max("executions").alias("n"), F.max("rejected").alias("r"), F.min("drawdown").alias("d"), F.min("cash").alias("cash")).collect()
    assert all(r["n"] >= 7 and r["r"] > 0 and r["d"] < 0 and r["cash"] >= 0 for r in last)
    assert replay.followed(spark, folder, state, out).count() == found.count()


def test_rebalances_wait_for_bars_and_volume(spark):
    bars = [("A", 0, 10.0, 10.0, 10**6), ("A", 1, 10.0, 10.0, 10**6), ("B", 3, 20.0, 20.0, 1_000), ("A", 31, 10.0, 10.0, 10**6), ("B", 33, 40.0, 40.0, 10**6)]
    series = spark.createDataFrame([(s, day(k), o, c, v) for s, k, o, c, v in bars], "symbol string, day date, open double, close double, volume long")
    symbols = spark.createDataFrame([("r", "A"), ("r", "B")], "run string, symbol string")
    found = [r.asDict() for r in pending.rebalanced(series, symbols, capital=100_000.0, fee=0.0, slippage=0.0).orderBy("day").collect()]
    assert [(r["waiting"], r["trades"], r["cash"]) for r in found] == [(1, 1, 50_000.0), (1, 1, 50_000.0), (0, 2, 30_000.0), (1, 2, 30_000.0), (0, 3, 10_000.0)]
    assert [r["equity"] for r in found] == [100_000.0, 100_000.0, 100_000.0, 100_000.0, 120_000.0]


def test_effects_count_once_and_dead_letters_stay(spark, tmp_path):
    rows = spark.createDataFrame([(k, "k", float(k), 1) for k in range(12)], "event_id long, kind string, value double, version int")
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    consumers = [("ledger", F.col("value"), F.lit(False)), ("alarm", F.col("kind"), F.col("attempt") <= F.col("event_id") % 6)]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    box = outbox.delivered(stream, f"file://{tmp_path}/box", f"file://{tmp_path}/state", consumers, most=4)
    events = {r["event_id"]: (r["state"], r["attempts"], r["due"]) for r in box.events().collect()}
    assert events == {k: ("delivered", k % 6 + 1, 2.0 ** (k % 6) - 1) if k % 6 < 4 else ("dead_letter", 4, 7.0) for k in range(12)}
    effects = sorted(map(tuple, box.effects().collect()))
    assert len(effects) == 16 and len({e[0] for e in effects}) == 16
    box.take(rows, 0)  # the first batch again, with all events
    box.replay(box.events().where("state = 'delivered'"), 50)
    box.drain(51)
    assert sorted(e for e in map(tuple, box.effects().collect())) == effects
    assert {r["event_id"] for r in box.events().where("state = 'dead_letter'").collect()} == {4, 5, 10, 11}


def test_versions_are_whole_or_not_there(spark, tmp_path):
    schema = "scope string, k int, v string"
    table = versions.Versions(spark, f"file://{tmp_path}/t", schema, "scope", ["scope", "k"])
    read = lambda: sorted(map(tuple, table.read().collect()))
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    assert read() == []
    table.upsert("one", rows(("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z")))
    assert read() == [("a", 1, "y"), ("b", 2, "z")]
    for _ in range(2):
        table.upsert("two", rows(("a", 1, "new"), ("a", 3, "more")))
    assert read() == [("a", 1, "new"), ("a", 3, "more"), ("b", 2, "z")]
    rows(("a", 1, "lost")).withColumns({"run": F.lit("broken"), "part": F.lit("a")}).write.mode("append").partitionBy("run", "part").parquet(f"{table.path}/rows")
    assert read() == [("a", 1, "new"), ("a", 3, "more"), ("b", 2, "z")]
    table.roll_back("two")
    assert read() == [("a", 1, "y"), ("b", 2, "z")]
    with pytest.raises(ValueError, match="not active"):
        table.roll_back("two")
    table.upsert("three", rows(("b", 2, None)))
    assert read() == [("a", 1, "y"), ("b", 2, None)]


def test_intervals_equal_going_over_days(spark):
    rng = random.Random(7)
    bounds = [(k, day(rng.randint(0, 5)), day(rng.randint(20, 40))) for k in range(40)]
    holes = [(rng.randint(0, 35), day(a := rng.randint(-10, 45)), day(a + rng.randint(-2, 8))) for _ in range(90)] + [(36, day(-5), day(60)), (37, day(2), day(6)), (37, day(7), day(9)), (38, day(50), day(55))]
    ranges = lambda rows: spark.createDataFrame(rows, "k int, first date, last date").repartition(3)
    gone = {k: {d for h, a, b in holes if h == k for d in range((a - DAY).days, (b - DAY).days + 1)} for k in range(40)}
    left = {k: [] for k in range(40)}
    for r in subtracted(ranges(bounds), ranges(holes), ["k"]).collect():
        left[r["k"]] += range((r["first"] - DAY).days, (r["last"] - DAY).days + 1)
    assert {k: sorted(x) for k, x in left.items()} == {k: [d for d in range((a - DAY).days, (b - DAY).days + 1) if d not in gone[k]] for k, a, b in bounds}
    unions = {(r["k"], (r["last"] - r["first"]).days + 1) for r in merged(ranges(holes), ["k"]).where("k = 37").collect()}
    assert unions == {(37, 8)}
    points = [(rng.randint(0, 39), day(rng.randint(-5, 50)), i) for i in range(200)] + [(1, None, 999)]
    spots = spark.createDataFrame(points, "k int, day date, i int").repartition(2)
    spans = ranges(bounds).withColumn("last", F.when(F.col("k") != 5, F.col("last")))
    found = {r["k"]: (r["inside"], r["early"]) for r in points_within(spans, spots, ["k"], inside=(F.col("first"), F.col("last")), early=(F.date_sub("first", 3), F.date_sub("first", 1))).collect()}
    inside = lambda k, a, b: sum(1 for q, d, _ in points if q == k and d is not None and a <= d <= b)
    assert found == {k: (0 if k == 5 else inside(k, a, b), inside(k, a - dt.timedelta(3), a - dt.timedelta(1))) for k, a, b in bounds}
    covers = {r["i"]: r["covers"] for r in covering(spots.where("day is not null"), ranges(holes), ["k"]).collect()}
    assert covers == {i: sum(1 for h, a, b in holes if h == k and a <= d <= b) for k, d, i in points if d is not None}


def test_conflicting_claims_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 30), rng.choice(["x", "x", "y", None]), rng.choice([DAY, DAY, None]), rank := rng.choice([None, 1, 1, 2]), rank and rng.choice(["p", "p", "q"])) for i in range(110)]
    frame = spark.createDataFrame(rows, "claim int, claim_type int, value string, effective date, rank int, accounts string").repartition(3)
    found = {r["claim"]: (r["reasons"], r["partners"]) for r in evidence.conflicting_claims(frame).collect()}
    plain = {}
    for a in rows:
        reasons, partners = set(), 0
        for b in rows:
            if a[0] != b[0] and a[1] == b[1]:
                own = {evidence.REASONS[k] for k, c in ((0, 2), (1, 3)) if a[c] != b[c]}
                if a[4] and b[4]:
                    own |= {evidence.REASONS[k] for k, c in ((2, 4), (3, 5)) if a[c] != b[c]}
                reasons |= own
                partners += bool(own)
        if partners:
            plain[a[0]] = (",".join(x for x in evidence.REASONS if x in reasons), partners)
    assert found == plain


def test_an_early_alteration_breaks_what_follows(spark):
    rows = spark.createDataFrame([(c, k, f"event {k}") for c in (1, 2, 3) for k in range(1, 21)], "chain int, sequence long, content string")
    stored = evidence.chained(rows).cache()
    changed = stored.where("NOT (chain = 3 AND sequence = 5)").withColumn("content", F.when(F.expr("chain = 2 AND sequence = 4"), "other").otherwise(F.col("content")))
    found = {r["chain"]: tuple(r)[1:] for r in evidence.verified(changed).collect()}
    assert found == {1: (20, 0, 0, 0, 0, None), 2: (20, 0, 0, 1, 17, 4), 3: (19, 1, 1, 0, 15, 6)}


class Plain(HTMLParser):
    """Items with their first link, by plain state."""

    def __init__(self):
        super().__init__()
        self.items, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self.items.append(["", None])
            self.depth = 1
        elif tag == "a" and self.depth and self.items[-1][1] is None:
            self.items[-1][1] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == "li":
            self.depth = 0

    def handle_data(self, data):
        if self.depth:
            self.items[-1][0] += data


def test_items_of_pages_equal_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    cells = [tuple(r) for r in listings.page_cells(pages).where("kind <> 'table'").select("page_id", "row", "text", "href").collect()]
    plain = []
    for r in pages.collect():
        parser = Plain()
        parser.feed(r["html"])
        plain += [(r["page_id"], k, " ".join(text.split()), href) for k, (text, href) in enumerate(parser.items, 1)]
    assert len(cells) > 100 and sorted(map(str, cells)) == sorted(map(str, plain))


def test_pages_of_odd_kinds(spark):
    pages = [(1, None), (2, ""), (3, "<ol><li>a<li><a href='/b'>b</a> c<ul><li>in"), (4, "</table></td><tr><td>x"), (5, "<table><tr><th aria-label=' Code '> </th><td>1")]
    found = listings.page_cells(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert sorted(tuple(r) for r in found if r["page_id"] == 3) == [(3, 1, "ol", 1, 1, "a", None), (3, 1, "ol", 2, 1, "b c", "/b"), (3, 2, "ul", 1, 1, "in", None)]
    assert [tuple(r)[4:6] for r in found if r["page_id"] == 5] == [(1, "Code"), (2, "1")] and {r["page_id"] for r in found} == {3, 5}
    master = listings.master_of(spark.createDataFrame([(1, 1, "A", "a", "/a"), (2, 1, "A", "a", "/a"), (2, 2, "B", "b", "/b"), (3, 1, "B", "B", "/B"), (3, 2, "C", "c", "/c")], "page_id long, place int, code string, name string, href string"))
    assert sorted(tuple(r)[:3] for r in master.collect()) == [("A", "verified", "a"), ("B", "conflict", ""), ("C", "unverified", "c")]


def zipped(*entries, **options):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in entries:
            out.writestr(name, content, **options)
    return buffer.getvalue()


def sheet(body):
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def test_unreadable_files_are_rows_with_their_error(spark):
    good = bytearray(zipped(("a.csv", "Symbol,Close\nA,1\n" * 50)))
    damaged, encrypted = bytearray(good), bytearray(good)
    damaged[45:60] = b"\xff" * 15
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        encrypted[good.find(mark) + at] |= 1
    dense = zipped(("xl/worksheets/sheet1.xml", sheet(f'<row><c t="inlineStr"><is><t>{"x" * (20 << 20)}</t></is></c></row>')))
    wide = zipped(("xl/worksheets/sheet1.xml", sheet('<row><c r="ZZZ1"><v>1</v></c></row>')))
    entity = zipped(("xl/worksheets/sheet1.xml", '<!DOCTYPE x [<!ENTITY a "b">]>' + sheet("")))
    files = [
        ("list.json", b"[1, 2]"), ("deep.json", b"[" * 200_000), ("text.csv", b"\xff\xfe\x00"), ("damaged.zip", bytes(damaged)), ("encrypted.zip", bytes(encrypted)), ("dense.xlsx", dense), ("wide.xlsx", wide),
        ("entity.xlsx", entity), ("none.xlsx", zipped(("x.txt", "a"))), ("null.csv", None), ("torn.xlsx", zipped(("xl/worksheets/sheet1.xml", "<worksheet>"))), ("long.csv", b"Symbol,Close\n" + b"y" * 300_000 + b",1\n"),
    ]
    found = uploads.file_rows(spark.createDataFrame(files, "path string, content binary")).collect()
    errors = {r["path"]: r["error"] for r in found}
    assert all(errors[name] for name, _ in files if name not in ("null.csv", "long.csv")) and "null.csv" not in errors
    assert "encrypted" in errors["encrypted.zip"] and "dense" in errors["dense.xlsx"] and "columns" in errors["wide.xlsx"] and "document type" in errors["entity.xlsx"]
    assert [(len(r["fields"]["Symbol"]), r["fields"]["Close"]) for r in found if r["path"] == "long.csv"] == [(300_000, "1")] and len(found) == len(files) - 1
    first = uploads.mapped(spark.createDataFrame([({"Ticker": "t", "Trading Code": "c"},)], "fields map<string,string>")).collect()[0]
    assert first["symbol"] == "c"


def test_portfolio_files_with_credentials_or_twice_are_refused(spark):
    head, row = "occurred_at,transaction_type,symbol,quantity,price", "2024-01-01,buy,A,1,2"
    files = [("a.csv", f"{head}\n{row}"), ("b.csv", f"{head}\n{row}"), ("c.csv", f"{head}, API_Key \n{row},k"), ("d.csv", f"{head}\n2024-01-01,steal,A,1,2"), ("e.csv", ""), ("f.json", "{")]
    frame = spark.createDataFrame([(p, c.encode()) for p, c in files], "path string, content binary")
    found = {r["path"]: (r["duplicate_of"], r["rows"], r["errors"], r["refused"], r["allowed"]) for r in uploads.portfolio_preview(frame).collect()}
    assert found == {"a.csv": (None, 1, 0, "", True), "b.csv": ("a.csv", 1, 0, "", False), "c.csv": (None, 1, 0, "api_key", False), "d.csv": (None, 1, 1, "", False), "e.csv": (None, 0, 0, "", False), "f.json": (None, 0, 1, "", False)}


def test_subtracted_sorts_holes_once_in_all_tasks(spark):
    ranges = spark.createDataFrame([(k, DAY, DAY + dt.timedelta(9)) for k in [None, *range(40)]], "k int, first date, last date")
    holes = spark.createDataFrame([(k, DAY + dt.timedelta(2), DAY + dt.timedelta(3)) for k in [None, *range(40)]], "k int, first date, last date")
    left = subtracted(ranges, holes, ["k"])
    assert "Join" not in left._jdf.queryExecution().optimizedPlan().toString()
    rows = left.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) == 4 and len(rows) == 81 and [r["last"] for r in rows if r["k"] is None] == [DAY + dt.timedelta(9)]
