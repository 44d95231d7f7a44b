"""Campaigns, batches and expansions on literal rows, and their queries against plain versions."""

import datetime as dt
import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeline.operators import qualification as q

D = dt.date(2024, 1, 1)
CAMPAIGNS = "campaign string, evidence string, certified boolean, attested boolean"
DAYS = "campaign string, day date, done boolean, audit boolean, reconciled boolean, backed_up boolean, evidence string, eligible boolean, synthetic boolean, provenance string, mandatory boolean"
REVIEWS, REPORTS, INCIDENTS = "campaign string, day date, review string, at int", "campaign string, first date, last date, passed boolean", "campaign string, severity string, state string"


def of_campaigns(spark, campaigns, days, reviews, reports, incidents, target=2):
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((campaigns, CAMPAIGNS), (days, DAYS), (reviews, REVIEWS), (reports, REPORTS), (incidents, INCIDENTS))]
    return {(r.campaign, r.scope): r for r in q.qualified(*tables, target=target).collect()}


def sound(campaign, k, **other):
    row = dict(done=True, audit=True, reconciled=True, backed_up=True, evidence="real_market", eligible=True, synthetic=False, provenance="exchange_verified", mandatory=True) | other
    return (campaign, D + dt.timedelta(days=k), *row.values())


def test_a_sound_campaign_qualifies_in_both_scopes(spark):
    days = [sound("a", k) for k in range(3)]
    reviews = [("a", d[1], "accepted", 1) for d in days]
    found = of_campaigns(spark, [("a", "real_market", True, None)], days, reviews, [("a", D, D + dt.timedelta(days=9), True), ("a", D, D, True)], [("a", "critical", "resolved"), ("a", "minor", "open")])
    for scope in ("paper", "real_market"):
        row = found["a", scope]
        assert (row.completed, row.qualifying, row.remaining, row.missing, row.qualifies, row.failures) == (3, 3, 0, 0, True, "")


@pytest.mark.parametrize(
    ("fault", "paper", "real"),
    [
        ({"audit": None}, "audit_invalid_or_missing", ""), ({"reconciled": False}, "reconciliation_invalid_or_missing", ""), ({"backed_up": False}, "backup_invalid_or_missing", ""),
        ({"evidence": "paper"}, "", "qualification_target_not_met"), ({"provenance": "unknown"}, "", "qualification_target_not_met"), ({"synthetic": True}, "", "qualification_target_not_met"), ({"mandatory": None}, "", "qualification_target_not_met"),
    ],
)
def test_each_fault_of_a_day_has_its_reason(spark, fault, paper, real):
    days = [sound("a", 0), sound("a", 1, **fault)]
    reviews = [("a", d[1], "accepted", 1) for d in days]
    found = of_campaigns(spark, [("a", "real_market", None, True)], days, reviews, [("a", D, D + dt.timedelta(days=9), True)], [])
    want = [x for x in (paper, "qualification_target_not_met" if paper else "") if x]
    assert found["a", "paper"].failures == ",".join(want)
    assert found["a", "real_market"].failures == (real or ",".join(want))


def test_reviews_reports_and_incidents_count_as_they_stand(spark):
    days = [sound("b", k) for k in range(4)] + [sound("b", 9, done=None)]
    reviews = [("b", D, "rejected", 1), ("b", D, "accepted", 2), ("b", D + dt.timedelta(days=1), "requires_rerun", 1), ("b", D + dt.timedelta(days=2), "concerns_found", None)]
    row = of_campaigns(spark, [("b", "paper", False, False), ("none", None, None, None)], days, reviews, [("b", D, D + dt.timedelta(days=1), True), ("b", D, D + dt.timedelta(days=9), False), ("b", None, None, True)], [("b", "critical", "open")])
    b = row["b", "paper"]
    assert (b.completed, b.reviewed, b.accepted, b.rejected, b.rerun, b.concerns, b.quality, b.qualifying, b.unresolved) == (4, 3, 1, 0, 1, 1, 2, 1, 1)
    assert b.failures == "completed_day_missing_review,data_quality_unacceptable_or_missing,unresolved_critical_incidents,qualification_target_not_met"
    assert row["b", "real_market"].failures.endswith("campaign_not_real_market,approved_real_market_source_missing,qualification_target_not_met")
    none = row["none", "paper"]
    assert (none.completed, none.missing, none.failures) == (0, 2, "qualification_target_not_met")


def test_empty_tables_give_no_campaigns(spark):
    assert of_campaigns(spark, [], [], [], [], []) == {}


def test_a_batch_has_the_digest_of_its_evidence(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), k, rng.choice(["A", "B", None]), rng.choice([None, *(dt.datetime(2024, 1, 1, h) for h in range(4))]), rng.choice(["s", "t"]), rng.choice(["known", "known", "unknown", None])) for k in range(60)]
    rows += [("good", k, "A", dt.datetime(2024, 1, 1, k), "s", "known") for k in range(5)]
    found = {r.batch: r for r in q.batch_evidence(spark.createDataFrame(rows, "batch string, arrival long, symbol string, moment timestamp, source string, provenance string").repartition(4)).collect()}
    for batch in ("x", "y", "z", "good"):
        own = [r for r in rows if r[0] == batch]
        late = sum(a[3] is not None and b[3] is not None and b[3] < a[3] for a, b in zip(own, own[1:], strict=False))
        want = {"row_count": len(own), "duplicate_rows": len(own) - len({r[2:5] for r in own}), "out_of_order_events": late, "unknown_timestamp_rows": sum(r[5] != "known" for r in own), "sources": sorted({r[4] for r in own})}
        want["passed"] = not (want["duplicate_rows"] or late or want["unknown_timestamp_rows"])
        assert found[batch].integrity_hash == hashlib.sha256(json.dumps(want, sort_keys=True).encode()).hexdigest()
    assert found["good"].passed


@pytest.mark.parametrize("seed", range(4))
def test_the_expansion_equals_the_greedy_walk(spark, seed):
    rng = random.Random(seed)
    names = ["adjusted_rows", "tier_2_rows", "coverage_days", "conflicts", "invalid", "duplicates", "validation_days"]
    rows = [(f"s{k:02d}", rng.choice("pqrst"), 10_000, 10_000, rng.choice([1000, 2500, 3000]), rng.choice([4000, 6000, 7000]), rng.randint(1, 3), rng.choice([0, 5, 20]), rng.choice([0, 100, 300]), rng.choice([0, 50, 200]), rng.randint(1, 2)) for k in range(70)]
    active = [(f"a{k}", s) for k, s in enumerate(rng.choices("pqr", k=6))]
    table = spark.createDataFrame(rows, "symbol string, sector string, raw_rows long, logical_rows long, " + ", ".join(f"{n} long" for n in names))
    found = {r.symbol: r for r in q.expansion(table, spark.createDataFrame(active, "symbol string, sector string"), picks=8, per_sector=3).collect()}
    able = [r for r in rows if r[5] >= 5000 and r[4] >= 2000 and r[8] <= 200 and r[7] <= 10 and r[9] <= 100]
    order = sorted(able, key=lambda r: (-r[4], -r[5], -r[6], r[7], r[8], r[9], -r[10], r[0]))
    held, taken = Counter(s for _, s in active), []
    missing = sorted({r[1] for r in able} - set(held))
    for row in [next(r for r in order if r[1] == s) for s in missing] + order:
        if len(taken) < 8 and row[0] not in taken and held[row[1]] < 3:
            taken.append(row[0])
            held[row[1]] += 1
    assert [s for _, s in sorted((r.place, s) for s, r in found.items() if r.place)] == taken
    assert {s for s, r in found.items() if r.blockers == ""} == {r[0] for r in able} and len(found) == 70


def test_health_reads_the_newest_alone(spark, tmp_path):
    events = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), "old" if k < 20 else "ab"[k % 2], float(k)) for k in range(150)]
    orders = [(k, "F" if k % 3 else "O", dt.datetime(2024, 1, 1)) for k in range(300)]
    spark.createDataFrame(events, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    done = sorted(((k % 97 + 1, k) for k, s, _ in orders if s == "F"), reverse=True)[:100]
    want = {("metric", "a"): 148.0, ("metric", "b"): 149.0, ("orders", "queue_depth"): 100.0, ("orders", "order_latency_seconds"): round(sum(x for x, _ in done) / 100, 6)}
    assert {(r.kind, r.name): r.value for r in q.health(spark, str(tmp_path)).withColumn("value", F.col("value")).collect()} == want
