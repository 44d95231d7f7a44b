"""Trade-offs, qualities of datasets, diversity and certification on literal rows, against plain versions."""

import datetime as dt
import itertools
import random

import pytest

from tapeline.operators import tradeoffs as t

D = dt.date(2024, 1, 1)  # a Monday
BARS = "symbol string, day date, open double, high double, low double, close double, volume long"
DATA = "dataset string, symbol string, day date, open double, high double, low double, close double, factor double"
T = dt.datetime(2024, 1, 1, 12)


def day(k):
    return D + dt.timedelta(days=k)


def matched_plainly(rows, part):
    """Equity and trades of a symbol whose part is spent once."""
    cash, quantity, out = t.CAPITAL, 0, []
    for i, (_, _, open_, _, _, close, volume) in enumerate(rows):
        price, traded = open_ * (1 + t.SLIPPAGE), 0
        size = int(t.CAPITAL * (part or 0.0) / (price * (1 + t.FEE)))
        if i and not quantity and size > 0 and (volume or 0) >= size:
            traded, quantity = size, size
            cash -= size * price + size * price * t.FEE
        out.append((traded, cash + quantity * close))
    return out


def test_a_part_of_the_capital_is_spent_once_and_kept(spark):
    rng = random.Random(5)
    series = {s: [(s, day(k), *(x := rng.uniform(50, 150),) * 3, x * rng.uniform(0.9, 1.1), rng.choice([None, 10, 100, 1000])) for k in range(30)] for s in "abcd"}
    parts = {"a": 0.5, "b": 1.0, "c": 0.0001}
    got = t.held_in_part(spark.createDataFrame([r for rows in series.values() for r in rows], BARS), spark.createDataFrame(list(parts.items()), "symbol string, part double")).orderBy("symbol", "day").collect()
    want = [(s, *x) for s, rows in series.items() for x in matched_plainly(rows, parts.get(s))]
    assert [(g.symbol, g.traded) for g in got] == [(s, traded) for s, traded, _ in want]
    assert [g.equity for g in got] == pytest.approx([equity for *_, equity in want])
    assert {g.symbol for g in got if g.desired} == {"a", "b"}


def good(k, symbol="a", **other):
    row = dict(open=100.0, high=110.0, low=90.0, close=100.0, factor=1.0) | other
    return ("x", symbol, day(k), *row.values())


def test_sound_weekdays_pass(spark):
    rows = [good(k, s) for s in "ab" for k in range(40) if k % 7 < 5]
    assert tuple(t.dataset_quality(spark.createDataFrame(rows, DATA)).first()) == ("x", len(rows), 2, 0, 0, 0, 0, 0, True)


@pytest.mark.parametrize(
    ("rows", "name", "count"),
    [
        ([good(0), good(0)], "duplicates", 1), ([good(0), good(9)], "missing_days", 6), ([good(4), good(7)], "missing_days", 0), ([good(0), good(1, close=150.0, high=160.0)], "outliers", 0), ([good(0), good(1, close=151.0, high=160.0)], "outliers", 1),
        ([good(0, low=101.0)], "errors", 1), ([good(0, open=None)], "errors", 1), ([good(0, factor=0.0)], "errors", 1), ([("x", None, D, 1.0, 1.0, 1.0, 1.0, 1.0), ("x", "a", None, 1.0, 1.0, 1.0, 1.0, 1.0)], "errors", 2), ([good(0, factor=0.5)], "corporate_actions_applied", 1),
    ],
)
def test_each_fault_of_a_dataset_is_counted(spark, rows, name, count):
    got = t.dataset_quality(spark.createDataFrame(rows, DATA)).first()
    assert got[name] == count
    assert got.passed == (count == 0 or name == "corporate_actions_applied")


def test_missing_weekdays_are_those_of_a_calendar(spark):
    rng = random.Random(7)
    days = sorted(rng.sample(range(400), 90))
    want = sum(day(k).weekday() < 5 for a, b in itertools.pairwise(days) for k in range(a + 1, b))
    assert t.dataset_quality(spark.createDataFrame([good(k) for k in days], DATA)).first().missing_days == want


def test_prices_are_adjusted_by_their_factor(spark):
    row = t.adjusted(spark.createDataFrame([good(0, factor=0.5)], DATA)).first()
    assert (row.open, row.high, row.low, row.close) == (50.0, 55.0, 45.0, 50.0)


def test_diversity(spark):
    schema = "portfolio long, symbol string, sector string, source string, first date, last date, held long, liquidity double"
    rows = [(1, "a", "bank", "P", day(0), day(9), 2, 0.5), (1, "b", "bank", "Q", day(3), day(7), 0, 0.25), (1, "c", None, "Q", day(1), day(8), 1, None), (2, "d", "food", None, None, None, None, None)]
    got = {x.portfolio: tuple(x)[1:] for x in t.diversity(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (3, 33.3333, "bank:2,unknown:1", 66.6667, "P:1,Q:2", 66.6667, day(3), day(7), 3, 0.25)
    assert got[2] == (1, 100.0, "food:1", 100.0, "unknown:1", 100.0, None, None, None, None)
    assert t.diversity(spark.createDataFrame([], schema)).count() == 0


QUOTES = "provider string, asked string, symbol string, at timestamp, now timestamp, latency_ms long, stale boolean, trust string"
HISTORY = "provider string, symbol string, place int, at timestamp, close double"


def certify(spark, *, owner=None, quotes=None, history=None, again=None, requested=("a", "b")):
    own = ("p", *((dict(licensing="licensed", capabilities=list(t.CAPABILITIES), trust=t.TRUSTED) | (owner or {})).values()))
    quotes = [("p", s, s, T, T, 5, False, t.TRUSTED) for s in "ab"] if quotes is None else quotes
    history = [("p", s, k, T + dt.timedelta(days=k), 1.0) for s in "ab" for k in range(3)] if history is None else history
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (([own], "provider string, licensing string, capabilities array<string>, trust string"), ([(s,) for s in requested], "symbol string"), (quotes, QUOTES), (history, HISTORY), (history if again is None else again, HISTORY))]
    rows = t.certified(*frames).collect()
    assert [r.check for r in rows] == list(t.CHECKS)
    assert all(r.passed == (r.failures == 0) for r in rows) and {r.activation_allowed for r in rows} == {all(r.passed for r in rows)}
    return {r.check: r.failures for r in rows if r.failures}


def test_a_sound_provider_passes_all_checks(spark):
    assert certify(spark) == {}


def test_each_fault_of_a_provider_has_its_check(spark):
    quote = lambda **k: tuple((dict(provider="p", asked="a", symbol="a", at=T, now=T, latency_ms=5, stale=False, trust=t.TRUSTED) | k).values())
    b = quote(asked="b", symbol="b")
    assert certify(spark, owner={"licensing": None, "capabilities": ["polling_quotes"], "trust": "received"}) == {"licensed_for_operational_use": 1, "required_capabilities": 3, "timestamp_provenance": 1}
    assert certify(spark, owner={"capabilities": None}) == {"required_capabilities": 4}
    assert certify(spark, quotes=[quote(symbol=None), b]) == {"quote_schema": 1}
    assert certify(spark, quotes=[quote(at=None), b]) == {"freshness": 1, "quote_timestamp_provenance": 1}
    assert certify(spark, quotes=[quote(now=T + dt.timedelta(seconds=30)), b]) == {}
    assert certify(spark, quotes=[quote(now=T - dt.timedelta(seconds=31)), quote(asked="b", symbol="b", stale=True)]) == {"freshness": 2}
    assert certify(spark, quotes=[quote(trust=None, latency_ms=2001), b]) == {"quote_timestamp_provenance": 1, "latency": 1}
    assert certify(spark, quotes=[b, quote(asked="z", symbol="z", stale=True)]) == {"missing_updates": 1}
    assert certify(spark, quotes=[]) == {"missing_updates": 2, "latency": 1}
    at = lambda s, *ks: [("p", s, i, T + dt.timedelta(days=k), 1.0) for i, k in enumerate(ks)]
    assert certify(spark, history=at("a", 0, 2, 1) + at("b", 0, 1)) == {"event_ordering": 1}
    assert certify(spark, history=at("a", 0, 1, 1) + at("b", 0, 0)) == {"duplicate_handling": 2}
    assert certify(spark, history=at("a", 0, 1) + at("b", 0, 1), again=at("a", 0, 1) + at("b", 0)) == {"historical_consistency": 1}
    assert certify(spark, history=at("a", 0, 1) + at("z", 2, 1)) == {"symbol_coverage": 1, "historical_coverage": 1}
    assert certify(spark, history=[]) == {"symbol_coverage": 2, "historical_coverage": 2}
