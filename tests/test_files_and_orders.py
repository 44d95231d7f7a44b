"""Uploads, archives, sinks, order fills, rules and the golden cycle on literal rows."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tapeline.operators import backtest, curves, orders
from tapeline.plans import rotation
from tapeline.sources import bars as source
from tapeline.sources import files, uploads


def archive(entries, kind=zipfile.ZIP_DEFLATED):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", kind) as out:
        for name, content in entries:
            out.writestr(name, content)
    return buffer.getvalue()


def workbook(rows, shared=True):
    strings = sorted({x for row in rows for x in row if isinstance(x, str)})
    cell = lambda r, c, x: f'<c r="{chr(65 + c)}{r}" t="s"><v>{strings.index(x)}</v></c>' if isinstance(x, str) and shared else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{x}</t></is></c>' if isinstance(x, str) else f'<c r="{chr(65 + c)}{r}"><v>{x}</v></c>'
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "".join(f'<row r="{i}">' + "".join(cell(i, c, x) for c, x in enumerate(row) if x is not None) + "</row>" for i, row in enumerate(rows, 1))
    return archive([("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>"), ("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{sheet}</sheetData></worksheet>")])


def test_files_of_all_kinds_give_the_same_rows(spark):
    text = "\ufeffSymbol,Date,Close\nAA,2024-01-01,10\nBB,2024-01-02,\n"
    rows = [("Symbol", "Date", "Close"), ("AA", "2024-01-01", 10), ("BB", "2024-01-02", None)]
    made = [
        ("a.csv", text.encode()), ("b.zip", archive([("in/b.csv", text)])), ("c.json", json.dumps([{"Symbol": "AA", "Date": "2024-01-01", "Close": 10}, {"Symbol": "BB", "Date": "2024-01-02", "Close": None}]).encode()),
        ("d.xlsx", workbook(rows)), ("e.xlsx", workbook(rows, shared=False)), ("empty.csv", b""),
    ]
    frame = spark.createDataFrame([(f"file:/x/{n}", c) for n, c in made], "path string, content binary")
    found = uploads.mapped(uploads.file_rows(frame)).select(F.element_at(F.split("path", "/"), -1).alias("f"), "line", "symbol", "trading_date", F.nullif("close", F.lit("")).alias("close")).collect()
    for name in ("a.csv", "b.zip", "c.json", "d.xlsx", "e.xlsx"):
        assert sorted((r["line"], r["symbol"], r["trading_date"], r["close"]) for r in found if r["f"] == name) == [(2, "AA", "2024-01-01", "10"), (3, "BB", "2024-01-02", None)], name
    assert not [r for r in found if r["f"] == "empty.csv"]


@pytest.mark.parametrize(
    ("entries", "message"),
    [
        ([("../x.csv", "a")], "leaves"), ([("/x.csv", "a")], "leaves"), ([("C:/x.csv", "a")], "leaves"), ([("x.zip", "a")], "archive in an archive"), ([(f"{i}.csv", "a") for i in range(51)], "too many"), ([("x.csv", b"0" * (26 << 20))], "too large"),
        ([("x.csv", b"0" * (5 << 20))], "too dense"), ([("x.exe", "a")], "CSV files alone"), ([("x.csv", "MZ rest")], "active content"),
    ],
)
def test_unsafe_archives_are_errors(spark, entries, message):
    frame = spark.createDataFrame([("x/up.zip", archive(entries))], "path string, content binary")
    found = uploads.file_rows(frame).collect()
    assert len(found) == 1 and message in found[0]["error"]


def test_active_content_and_unknown_kinds_are_errors(spark):
    made = [("a.csv", b"\x7fELF.."), ("b.csv", b"x <SCRIPT>"), ("c.pdf", b"x"), ("d.zip", b"no archive"), ("e.json", b'{"a": 1}'), ("f.xlsx", b"PK")]
    frame = spark.createDataFrame(made, "path string, content binary")
    assert all(r["error"] for r in uploads.file_rows(frame).collect())


def test_rows_are_checked_and_keyed(spark):
    schema = "symbol string, trading_date string, open string, high string, low string, close string, volume string"
    good = ("AA", "2024-01-01", "1,000", "1100", "900", "1,050", "10")
    rows = spark.createDataFrame([good, good, ("AA", "2024-13-01", *good[2:]), (" ", *good[1:]), ("BB", "2024-01-01", "1", "2", "3", "1", "-5"), ("CC", None, None, None, None, None, None)], schema)
    wrong = [r["wrong"] for r in rows.select(uploads.row_error().alias("wrong")).collect()]
    assert wrong == [None, None, "invalid_date", "missing_symbol", "high_below_low,negative_volume", "invalid_date,invalid_open,invalid_high,invalid_low,invalid_close,invalid_volume"]
    assert [r["close"] for r in uploads.keyed(rows).collect()] == ["1,050"]
    with pytest.raises(Exception, match="conflicting rows"):
        uploads.keyed(rows.unionByName(spark.createDataFrame([(*good[:5], "999", "10")], schema))).collect()


def test_writes_are_once(spark, tmp_path):
    rows, path = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string"), f"file://{tmp_path}/once"
    assert uploads.write_once(rows, path) and not uploads.write_once(rows.orderBy(F.desc("k")), path)
    with pytest.raises(ValueError, match="other rows"):
        uploads.write_once(rows.where("k = 1"), path)
    pairs = [spark.createDataFrame([(x,) for x in xs], "v string") for xs in (["a", "a", "b"], ["c", "c", "b"])]
    assert files.fingerprint(pairs[0]).collect() != files.fingerprint(pairs[1]).collect()
    uploads.export_rows(rows, f"{path}-csv", predicate="k > 1")
    with pytest.raises(Exception, match="exists"):
        uploads.export_rows(rows, f"{path}-csv")
    assert spark.read.option("header", True).csv(f"{path}-csv").count() == 2


def test_order_fills(spark):
    rows = [(1, 1, 1, "buy", 100, 10.0, 10.0, 5_000), (1, 2, 2, "buy", 100, 9.0, 10.0, 5_000), (1, 3, 3, "buy", 100, 11.0, 10.0, 300), (1, 4, 4, "sell", 200, 9.0, 10.0, 5_000), (1, 5, 5, "sell", 120, 9.99, 10.0, 5_000), (1, 6, 6, "buy", 200_000, 20.0, 10.0, 9_000_000)]
    frame = spark.createDataFrame(rows, "account int, day int, o_orderkey long, side string, quantity long, limit_price double, price double, volume long")
    found = [(r["status"], r["filled"], r["at"], r["fee"]) for r in orders.filled_orders(frame).orderBy("o_orderkey").collect()]
    assert found == [("filled", 100, 10.0, 4.0), ("submitted", 0, 0.0, 0.0), ("partially_filled", 30, 10.01, 1.2), ("rejected", 0, 0.0, 0.0), ("filled", 120, 9.99, 4.8), ("rejected", 0, 0.0, 0.0)]


def test_each_scenario_breaks_its_rule_alone(spark):
    rows = [("SAFE", *orders.SAFE.values())] + [(rule, *(orders.SAFE | change).values()) for rule, change in zip(orders.RULES, orders.BREAKS, strict=True)]
    kinds = {str: "string", bool: "boolean", float: "double"}
    frame = spark.createDataFrame(rows, "scenario string, " + ", ".join(f"`{c}` {kinds[type(v)]}" for c, v in orders.SAFE.items()))
    found = orders.scenario_verdicts(frame).collect()
    assert len(found) == 20 and all(r["passed"] for r in found)


def test_golden_cycle(spark):
    """The figures that are known of the four strategies on the cycle, as printed; deviations are read on twelve places,
    so that a Sortino ratio over a deviation of a millionth holds to one in ten million."""
    known = {
        "hold": (249.46, 4.51, 328161.16, 6.28, -13.99, 1), "ma_20_50": (203.29, 4.01, 221114.34, 5.35, -13.99, 1), "momentum": (107.69, 2.41, 23.28, 3.18, -13.99, 23), "breakout": (101.94, 3.10, 5.43, 14.33, -2.97, 24),
    }
    found = {r["run"]: r for r in backtest.engine_golden(spark, "").collect()}
    for run, (total, sharpe, sortino, calmar, drawdown, trades) in known.items():
        r = found[run]
        assert tuple(round(r[c], 2) for c in ("total_percent", "sharpe", "calmar", "max_drawdown_percent")) == (total, sharpe, calmar, drawdown) and r["trades"] == trades
        assert r["sortino"] == pytest.approx(sortino, abs=0.005, rel=2e-7)


def test_combined_curve_of_flat_and_doubled(spark):
    rows = [(s, f"2024-01-0{d}", c) for s, closes in (("A1", (10.0, 10.0, 10.0)), ("A2", (10.0, 20.0))) for d, c in enumerate(closes, 1)]
    own = curves.curves(spark.createDataFrame(rows, "symbol string, day string, close double"))
    assert {(r["symbol"], r["day"][-1]): r["equity"] for r in own.collect()}[("A2", "2")] == 2 * curves.CAPITAL


def test_rebalances_keep_cash_and_whole_shares(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 9)]
    series = spark.createDataFrame([(s, d, p, p, 1_000_000) for s, p in (("A", 10.0), ("B", 7.0), ("C", 3.0)) for d in days], "symbol string, day string, open double, close double, volume int").withColumn("day", F.to_date("day"))
    plan = spark.createDataFrame([("r", "2024-01-02", "A", 1, 0.5), ("r", "2024-01-02", "B", 2, 0.5), ("r", "2024-01-05", "C", 1, 1.0)], "run string, execution_date string, symbol string, rank int, weight double").withColumn("execution_date", F.to_date("execution_date"))
    held = rotation.simulated(series, plan, capital=1_000.0, fee=0.0, slippage=0.0)
    found = {(str(r["execution_date"]), r["symbol"]): (r["quantity"], r["cash"]) for r in held.collect()}
    assert found[("2024-01-02", "A")] == (50.0, 3.0) and found[("2024-01-02", "B")] == (71.0, 3.0) and found[("2024-01-05", "C")] == (333.0, 1.0) and found[("2024-01-05", "A")][0] == 0.0
    equity = {str(r["day"]): r["equity"] for r in rotation.curve(series, held).collect()}
    assert equity == {d: 1_000.0 for d in days[1:]}
    assert source.cyclic_bars(spark, 2).select("close").first()[0] == pytest.approx(201.0)


def test_rows_of_small_files_go_out_together():
    """An Arrow batch holds many small files' rows; a file whose end can't be read gives its error alone."""
    import pandas as pd

    from tapeline.sources import uploads

    class Direct:
        select = lambda self, *_: self
        mapInPandas = lambda self, run, schema: list(run(iter([pd.DataFrame(files, columns=["path", "content"])])))

    files = [(f"{k}.csv", b"a,b\n1,2\n3,4") for k in range(900)] + [("bad.csv", b"a\n1\n\xff"), ("none.csv", None), ("long.csv", b"a\n" + b"7\n" * 12_000), ("last.csv", b"a\n1")]
    out = uploads.file_rows(Direct())
    assert len(out) <= 5 and max(map(len, out)) < 2 * uploads.ROWS_AT_ONCE
    every = [tuple(r) for part in out for r in part[["path", "line", "error"]].astype(object).where(lambda x: x.notna(), None).itertuples(index=False)]
    assert [r[:2] for r in every if r[0] == "long.csv"] == [("long.csv", k) for k in range(2, 12_002)]
    assert [r[:2] for r in every if r[0] not in ("long.csv", "bad.csv")] == [(f"{k}.csv", line) for k in range(900) for line in (2, 3)] + [("last.csv", 2)]
    assert [r[1] for r in every if r[0] == "bad.csv"] == [None] and all((r[2] is not None) == (r[0] == "bad.csv") for r in every)
