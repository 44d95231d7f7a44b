"""The library against DuckDB on the smallest tables, and properties of its operators on literal rows."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeline import registry
from tapeline.functions.folds import fold
from tapeline.operators import backtest, ledger, reconcile, validate
from tapeline.plans import rotation
from tapeline.sources import bars as source
from tapeline.sources import files, listings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e6 else f"{round(v, 5) + 0.0:.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    cursor = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_synthetic_bars_are_deterministic_weekdays(spark):
    rows = source.synthetic_bars(spark, ["AA", "BB"], "2024-01-01", "2024-02-29")
    assert rows.where("weekday(day) > 4 or high < low or close > high or open < low").isEmpty()
    again = source.synthetic_bars(spark, ["AA", "BB"], "2024-01-01", "2024-02-29")
    assert files.fingerprint(rows).collect() == files.fingerprint(again).collect()


def test_buy_and_hold_of_the_cycle_holds_whole_shares(spark):
    series = source.cyclic_bars(spark)
    curve = backtest.backtest(backtest.signalled(series, {"hold": backtest.hold_signal(), "ma": backtest.ma_signal(20, 50)}), capital=1_000_000.0)
    assert curve.where("cash < -1e-7").isEmpty()
    trades = {r["run"]: r["n"] for r in curve.groupBy("run").agg(F.count("side").alias("n")).collect()}
    assert trades == {"hold": 1, "ma": 1}


def test_costs_lower_equity(spark):
    series = backtest.signalled(source.cyclic_bars(spark), {"ma": backtest.ma_signal(5, 20)})  # volume never binds
    end = lambda **c: {r["symbol"]: r["e"] for r in backtest.backtest(series, **c).groupBy("symbol").agg(F.max_by("equity", "day").alias("e")).collect()}
    free, dear = end(fee=0.0, slippage=0.0), end(fee=0.01, slippage=0.0)
    assert all(dear[s] <= free[s] + 1e-6 for s in free)


def test_ledger_of_all_kinds(spark):
    rows = [("X", i, *r) for i, r in enumerate([("buy", 10.0, 5.0, 1.0), ("bonus", 2.0, 0.0, 0.0), ("split", 0.0, 2.0, 0.0), ("sell", 12.0, 4.0, 0.5), ("dividend", 0.0, 7.0, 0.0), ("fee", 0.0, 3.0, 0.0), ("sell", 99.0, 1.0, 0.0)])]
    found = ledger.holdings(spark.createDataFrame(rows, "symbol string, k int, kind string, quantity double, price double, fees double"), ["k"]).collect()
    assert len(found) == 1 and found[0]["held"] == 0.0 and found[0]["income"] == 7.0 and found[0]["oversold"] == 1
    assert found[0]["realised"] == pytest.approx(12 * 4 - 0.5 - 51 / 2 - 3 + 12 - 51 / 2)


def test_fold_of_nothing_and_of_long_keys(spark):
    rows = spark.range(30_000).select((F.col("id") % 2).cast("string").alias("k"), "id")
    step = lambda state, i: (state.__setitem__(0, state[0] + i) or state[0],)
    found = fold(rows, ["k"], ["id"], ["id"], lambda: [0], step, "total long", last_only=True)
    assert {r["k"]: r["total"] for r in found.collect()} == {"0": sum(range(0, 30_000, 2)), "1": sum(range(1, 30_000, 2))}
    assert fold(rows.where("id < 0"), ["k"], ["id"], ["id"], lambda: [0], step, "total long", last_only=True).count() == 0


def test_classes_of_raw_rows(spark):
    rows = [("GP", "2024-01-01", "100", "105", "99", "103", "1,000"), (None, "x", "", "1", "2", "abc", None), ("A", "5/1/2024", "0", "0", "0", "0", "0"), ("A", "2024-1-5", "1", "2", "1", "-1", "-1")]
    found = validate.classified(spark.createDataFrame(rows, "symbol string, day string, open string, high string, low string, close string, volume string")).collect()
    assert found[0]["accepted"] and found[0]["date_"] == dt.date(2024, 1, 1)
    assert "suspected_source_corruption" in found[1]["categories"] and "symbol_missing" in found[1]["categories"]
    assert found[2]["categories"] == "zero_price" and found[3]["categories"] == "close_outside_range,negative_price,negative_volume"


def test_weights_under_a_cap(spark):
    rows = spark.createDataFrame([(1, s, float(w)) for s, w in zip("abc", (8, 1, 1))] + [(2, s, 1.0) for s in "abc"], "signal_date int, symbol string, raw double")
    found = {(r["signal_date"], r["symbol"]): r["weight"] for r in rotation.capped_weights(rows, "raw").collect()}
    assert found[1, "a"] == 0.35 and sum(found[1, s] for s in "abc") == pytest.approx(1.0) and found[2, "b"] == pytest.approx(1 / 3)


def test_rotation_keeps_cash_and_order(spark):
    series = source.synthetic_bars(spark, ["AA", "BB", "CC", "DD"], "2021-01-01", "2023-12-31")
    plan = rotation.momentum_plan(series).withColumn("run", F.lit("m"))
    assert plan.where("execution_date <= signal_date").isEmpty() and not plan.isEmpty()
    holdings = rotation.simulated(series, plan)
    assert holdings.where("cash < -1e-7 or quantity < 0 or quantity <> floor(quantity)").isEmpty()
    assert rotation.curve(series, holdings).where("equity <= 0").isEmpty()


def test_csv_folder(spark, tmp_path):
    (tmp_path / "GP.csv").write_text('timestamp,open,high,low,close,volume\n2024-01-01T10:00:00+06:00,"1,000.5",1001,999,1000,10\n2024-01-02,1,2,1,2,5\n')
    found = files.csv_bars(spark, str(tmp_path), "2024-01-01", "2024-01-01").collect()
    assert len(found) == 1 and found[0]["symbol"] == "GP" and float(found[0]["open"]) == 1000.5
    (tmp_path / "GP.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01,1,1,1,1,1\n2024-01-01,1,1,1,1,1\n")
    with pytest.raises(Exception, match="duplicate timestamp"):
        files.csv_bars(spark, str(tmp_path)).collect()
    (tmp_path / "GP.csv").write_text("timestamp,open\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.csv_bars(spark, str(tmp_path))


def test_insert_absent_twice(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        files.insert_absent(rows, f"file://{tmp_path}/t", ["k"])
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2


def test_empty_tables(spark):
    none = source.observations(spark, SF).where("source = 'C'")
    assert reconcile.compared_sources(none).count() == 0 and reconcile.collapsed(none).count() == 0
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<table><tr><td>a<table><tr><td>b</table></table>")], "page_id long, html string")
    assert [tuple(r) for r in files.tables_of(pages).orderBy("page_id").collect()] == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 2, 2, 2)]


def test_html_tables_of_pages(spark):
    found = registry.QUERIES["html_tables"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and found.where("rows < 0 or cells < 0").isEmpty()


def test_cells_of_tables_with_the_header(spark):
    head = "<tr><th>Code</th><th aria-label='Close'> </th></tr>"
    pages = [
        (1, f"<table>{head}<tr><td> A &amp;  B </td><td>1<b>.5</b></td></tr></table><table><tr><td>other</td></tr></table>"),
        (2, f"<table><tr><td>x<table>{head}<tr><td>C<td>2<tr></table></td></tr></table>"),
        (3, None),
    ]
    found = listings.cells_of(spark.createDataFrame(pages, "page_id long, html string"), ("Code", "Close"))
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, 1, 1, 1, "Code"), (1, 1, 1, 2, "Close"), (1, 1, 2, 1, "A & B"), (1, 1, 2, 2, "1.5"), (2, 2, 1, 1, "Code"), (2, 2, 1, 2, "Close"), (2, 2, 2, 1, "C"), (2, 2, 2, 2, "2"),
    ]


def test_all_claims_and_kinds_of_a_line(spark):
    text = "Trading days: Sun-Thu\nmarket hours = 10:00-14:30 \r\nTick size: 0.1; settlement: T+2\nprice band - 10%\nBuy brokerage: 0.4%\nsell  brokerage: 0.3%\nMinimum charge: 5\nnothing here"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "Copyright a@b.org, MIT licence\nno")], "doc_id long, text string")
    assert sorted(tuple(r) for r in files.claims_of(rows).collect()) == [
        (1, 1, "weekly_trading_days", "Sun-Thu"), (1, 2, "market_sessions", "10:00-14:30"), (1, 3, "settlement", "T+2"), (1, 3, "tick_sizes", "0.1; settlement: T+2"), (1, 4, "price_bands", "10%"),
        (1, 5, "buy_brokerage", "0.4%"), (1, 6, "sell_brokerage", "0.3%"), (1, 7, "minimum_brokerage", "5"),
    ]
    assert sorted(tuple(r) for r in files.kinds_of(rows).collect()) == [(3, 1, "contact"), (3, 1, "copyright"), (3, 1, "licence")]


def test_momentum_needs_a_rising_index(spark):
    series = source.cyclic_bars(spark, 200)
    falling = series.select("day", (1000 - F.col("close")).alias("close"))
    for index, some in ((series, True), (falling, False), (series.limit(0), False)):
        rows = backtest.signalled(backtest.with_index(series, index.select("day", "close")), {"momentum": backtest.momentum_signal()})
        assert rows.count() == 200 and rows.where("desired").isEmpty() != some
    figures = backtest.metrics(backtest.backtest(backtest.signalled(series, {"hold": backtest.hold_signal()})))
    closes = [r["close"] for r in series.orderBy("day").collect()]
    row = backtest.with_alpha(figures, series.select("day", "close")).first()
    assert abs(row["benchmark_alpha_percent"] - (row["annual_percent"] - (closes[-1] / closes[0] - 1) * 100)) < 1e-5
    assert backtest.with_alpha(figures, series.limit(0)).first()["benchmark_alpha_percent"] == 0.0


def test_holdouts_and_thirds_cut_by_bars(spark):
    curve = backtest.backtest(backtest.signalled(source.cyclic_bars(spark, 101), {"hold": backtest.hold_signal()}))
    sizes = {r["part"]: r["bars"] for r in backtest.window_metrics(curve).collect()}
    assert sizes == {"holdout_1": 20, "holdout_2": 20, "holdout_3": 21, "holdouts": 61, "third_1": 33, "third_2": 34, "third_3": 34}
