"""The daily report on literal rows, held against a plain version of its rules."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapeline.operators import anomaly
from tapeline.operators import report as r

D = dt.date(2024, 1, 1)
ROWS = "symbol string, day date, open double, high double, low double, close double, was double, volume long, n long, value double"
MASTER, EVENTS = "symbol string, name string, sector string, kind string, listing string", "symbol string, available date, tier string, contradicts boolean"


def plain(symbol, k, **other):
    row = dict(open=100.0, high=102.0, low=99.0, close=101.0, was=100.0, volume=1000 + k % 7, n=10 + k % 3, value=5000.0) | other
    return (symbol, D + dt.timedelta(days=k), *row.values())


def found(spark, rows, master=(), events=()):
    return r.records(spark.createDataFrame(rows, ROWS), spark.createDataFrame(list(master), MASTER), spark.createDataFrame(list(events), EVENTS))


@pytest.mark.parametrize(
    ("fault", "status", "reason"),
    [
        ({}, "USABLE", None), ({"volume": 0, "n": 0, "value": 0.0}, "ZERO_ACTIVITY", r.ZERO), ({"volume": None, "n": None, "value": None}, "ZERO_ACTIVITY", r.ZERO), ({"volume": 0}, "DATA_ISSUE", r.INCONSISTENT), ({"n": None}, "DATA_ISSUE", r.INCONSISTENT),
        ({"was": 0.0}, "DATA_ISSUE", r.NONPOSITIVE), ({"open": None}, "DATA_ISSUE", r.NONPOSITIVE), ({"low": 100.5}, "DATA_ISSUE", r.MALFORMED), ({"high": 100.9}, "DATA_ISSUE", r.MALFORMED), ({"close": 99.0}, "USABLE", None),
    ],
)
def test_each_fault_of_a_row_has_its_reason(spark, fault, status, reason):
    row = r.with_data_status(spark.createDataFrame([plain("a", 0, **fault)], ROWS)).first()
    assert (row.data_status, row.reason) == (status, reason)


def test_labels_follow_identity_then_data_then_history_then_score(spark):
    names = {"fine": (r.VERIFIED, "ACTIVE"), "other": (r.NON_EQUITY, "ACTIVE"), "gone": (r.VERIFIED, "SUSPENDED"), "blank": (None, None), "unlisted": (r.VERIFIED, None)}
    rows = [plain(s, k) for s in (*names, "unknown") for k in range(45)] + [plain("fine", 45, volume=0)]
    rows += [plain(s, 46, open=108.0, high=130.0, low=100.0, close=125.0, volume=20_000) for s in (*names, "unknown")]
    master = [(s, s.upper(), "sector", *v) for s, v in names.items()]
    by = {(x.symbol, (x.day - D).days): x for x in found(spark, rows, master).collect()}
    assert (by["fine", 39].label, by["fine", 39].why, by["fine", 39].eligible) == ("INSUFFICIENT_HISTORY", r.SHORT, False)
    assert (by["fine", 40].label, by["fine", 40].eligible, by["fine", 40].score) == ("NORMAL", True, 0)
    assert (by["fine", 45].label, by["fine", 45].why, by["fine", 45].score) == ("DATA_ISSUE", r.INCONSISTENT, 0)
    last = by["fine", 46]
    assert (last.label, last.eligible) == ("HIGH_ATTENTION", True)
    assert last.why.split(",")[-1] == "recent_high_low_breakout:1_point" and "daily_return_pct:3_points" in last.why
    assert [(by[s, 46].label, by[s, 46].eligible, by[s, 46].why.split(",")[0]) for s in ("other", "gone", "unlisted", "blank", "unknown")] == [
        ("NORMAL", False, r.NOT_EQUITY), ("DATA_ISSUE", False, r.NOT_ACTIVE), ("DATA_ISSUE", False, r.NOT_ACTIVE), ("DATA_ISSUE", False, r.NOT_VERIFIED), ("DATA_ISSUE", False, r.NOT_VERIFIED),
    ]
    assert {x.score for k, x in by.items() if k[1] == 46} == {last.score}  # identity changes no score


def test_features_count_usable_rows_alone(spark):
    rows = [plain("a", k, volume=1000 + 10 * k) if k % 5 else plain("a", k, volume=0) for k in range(120)]
    got = {(x.day - D).days: x.volume_multiple for x in found(spark, rows).collect()}
    usable = [k for k in range(120) if k % 5]
    for i, k in enumerate(usable):
        past = [1000 + 10 * j for j in usable[max(i - 60, 0) : i]]
        want = (1000 + 10 * k) / statistics.median(past) if len(past) >= 40 else None
        assert got[k] == pytest.approx(want) if want else got[k] is None
    assert all(got[k] is None for k in range(0, 120, 5))


def test_events_are_used_from_the_day_they_were_available(spark):
    day = lambda k: D + dt.timedelta(days=k)
    events = [("a", day(2), "E", False), ("a", day(4), "D", True), ("a", day(6), "A", None), ("a", None, "A", True), (None, day(0), "A", True), ("b", day(0), "x", False)]
    got = {(x.symbol, (x.day - D).days): (x.event_status, x.contradicted) for x in found(spark, [plain(s, k) for s in "ab" for k in (1, 2, 4, 6)], events=events).collect()}
    assert [got["a", k] for k in (1, 2, 4, 6)] == [("NO_EXPLANATION_FOUND", False), ("RUMOUR_ONLY_INVESTIGATE", False), ("CORROBORATING_EVENT_PRESENT", True), ("OFFICIAL_EVENT_PRESENT", True)]
    assert {got["b", k] for k in (1, 2, 4, 6)} == {("NO_EXPLANATION_FOUND", False)}


def test_parts_of_an_empty_report_are_empty(spark):
    none = found(spark, [])
    assert [part(none).count() for part in (r.market, r.sectors, r.feature_statuses, r.rankings)] == [0, 0, 0, 0]


def records_frame(spark, rows):
    schema = "symbol string, day date, verification string, data_status string, status string, label string, eligible boolean, score int, name string, sector string, daily_return double, volume_multiple double, event_status string"
    return spark.createDataFrame(rows, schema)


def record(symbol, verification=r.VERIFIED, label="NORMAL", score=0, sector="x", ret=None, data="USABLE", status="AVAILABLE"):
    return (symbol, D, verification, data, status, label, verification == r.VERIFIED, score, None, sector, ret, None, "NO_EXPLANATION_FOUND")


def test_market_and_sectors(spark):
    rows = [record("a", ret=1.0), record("b", ret=2.0), record("c", ret=4.0), record("d", ret=-1.0, sector="y"), record("e", ret=0.0, sector="y"), record("f", ret=9.0, sector=""), record("g", r.UNVERIFIED, ret=-9.0, sector="y"), record("h", r.NON_EQUITY, data="ZERO_ACTIVITY")]
    frame = records_frame(spark, rows)
    m = r.market(frame).first()
    assert (m.observed, m.verified, m.unverified, m.non_equities, m.usable, m.zero_activity, m.up, m.down, m.unchanged, m.median_return, m.median_volume_multiple, m.verified_down) == (8, 6, 1, 1, 7, 1, 4, 2, 1, 1.0, None, 1)
    assert [(s.sector, s.members, s.advancing_share, s.median_return, s.label) for s in r.sectors(frame).collect()] == [("x", 3, 1.0, 2.0, "BROAD_STRENGTH")]
    weak = records_frame(spark, [record(s, ret=v) for s, v in zip("abcd", (-1.0, -2.0, -3.0, 1.0), strict=True)])
    assert r.sectors(weak).first().label == "BROAD_WEAKNESS"
    assert r.sectors(weak.withColumn("daily_return", -F.col("daily_return"))).first().label == "BROAD_STRENGTH"
    assert r.sectors(weak.withColumn("daily_return", F.lit(0.0))).first().label == "MIXED"


def test_the_watch_list_is_whole_and_raw_anomalies_are_twenty(spark):
    rows = [record(f"v{i:02}", label="WATCH", score=5) for i in range(30)] + [record(f"u{i:02}", r.UNVERIFIED, "DATA_ISSUE", i) for i in range(30)] + [record("n", score=3), record("e", r.NON_EQUITY, score=9)]
    got = r.rankings(records_frame(spark, rows)).collect()
    watch = sorted((x for x in got if x.ranking == "verified_watchlist"), key=lambda x: x.place)
    raw = sorted((x for x in got if x.ranking != "verified_watchlist"), key=lambda x: x.place)
    assert [x.symbol for x in watch] == [f"v{i:02}" for i in range(30)] and {x.missing_fields for x in watch} == {None}
    assert [x.symbol for x in raw] == [f"u{i:02}" for i in range(29, 9, -1)] and {x.missing_fields for x in raw} == {r.PROFILE_FIELDS}


def test_trailing_medians_come_from_one_sorted_stream(spark):
    """Medians and deviations by numpy equal a plain loop, with nulls and several batches, and no window sorts a list."""
    rng = random.Random(4)
    value = lambda: rng.choice([None, 1.0, 2.0, rng.random() * 9])
    names = ["high", "low", *anomaly.MIDDLES]
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), *(value() for _ in names)) for s, n in (("a", 150), ("b", 1), ("c", 61), ("d", 40)) for i in range(n)]
    series = spark.createDataFrame(rows, "symbol string, day date, " + ", ".join(f"{c} double" for c in names))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(x["symbol"], x["day"]): x for x in anomaly.with_history(series.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for symbol, day, *_ in rows:
        own = got[symbol, day]
        behind = [x for x in rows if x[0] == symbol and day - dt.timedelta(days=60) <= x[1] < day]
        assert own["i"] - 1 == (day - dt.date(2020, 1, 1)).days
        for k, c in enumerate(names, 2):
            have = [x[k] for x in behind if x[k] is not None]
            if c in anomaly.MIDDLES:
                assert own[f"n_{c}"] == len(have) and (not have or own[f"m_{c}"] == pytest.approx(statistics.median(have), abs=1e-12))
            if c in anomaly.DEVIATIONS and have:
                assert own[f"d_{c}"] == pytest.approx(statistics.median(abs(x - statistics.median(have)) for x in have), abs=1e-12)
            if c in ("high", "low") and have:
                assert own["top" if c == "high" else "bottom"] == (max if c == "high" else min)(have)
    bars = series.select("symbol", "day", "low", "high", F.col("low").alias("open"), F.col("high").alias("close"), F.col("move").alias("was"), "volume", F.lit(1).alias("n"))
    plan = anomaly.features_of(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan
