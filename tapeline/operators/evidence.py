"""Evidence as a whole: which claims conflict, how complete each item is, coverage of active rows, and hash chains."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import codes, codes_sql
from tapeline.functions.folds import fold
from tapeline.sources.bars import BARS_SQL, SOURCES_SQL, observations, table
from tapeline.sources.scratch import written

# Reasons of conflicts and steps of the completeness ladder, each in its order.
REASONS = ("different_values", "different_effective_dates", "source_hierarchy_difference", "account_specific_exception")
LADDER = ("missing", "document_received", "extracted", "reviewed", "conflicting", "decision_ready", "approved", "rejected", "expired")


def conflicting_claims(claims: DataFrame) -> DataFrame:
    """Of claims (claim, claim_type, value, effective, rank, accounts) those that contradict another of their type: the
    reasons, and with how many others. rank and accounts are null without a source profile, and then say nothing;
    values and dates may be null, which differs from any other.

    A claim differs from some other in a field if its type has two values there, and the claims that agree with it are
    those of its own values: counts by value, not pairs, so a type of any size is aggregated before its shuffle."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    rows = claims.withColumns({"v": told("value"), "d": told("effective"), "r": told("rank"), "a": told("accounts"), "known": F.col("rank").isNotNull()})
    kinds = rows.groupBy("claim_type", "v", "d", "r", "a", "known", "rank", "accounts").agg(F.count("*").alias("alike"))
    two = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    types = kinds.groupBy("claim_type").agg(F.sum("alike").alias("n"), two("v").alias("values"), two("d").alias("dates"), two("rank").alias("ranks"), two("accounts").alias("exceptions"))
    same = kinds.groupBy("claim_type", "v", "d").agg(F.sum("alike").alias("all_alike"), F.sum(F.when(~F.col("known"), F.col("alike")).otherwise(0)).alias("unknown"))
    counts = kinds.join(same, ["claim_type", "v", "d"]).join(types, "claim_type")
    agree = F.when(F.col("known"), F.col("alike") + F.col("unknown")).otherwise(F.col("all_alike"))
    reasons = codes((F.col("values"), REASONS[0]), (F.col("dates"), REASONS[1]), (F.col("known") & F.col("ranks"), REASONS[2]), (F.col("known") & F.col("exceptions"), REASONS[3]))
    keys = ["claim_type", "v", "d", "r", "a"]
    found = counts.select(*keys, reasons.alias("reasons"), (F.col("n") - agree).alias("partners")).where("reasons <> ''")
    return rows.select("claim", *keys).join(found, keys).select("claim", "claim_type", "reasons", "partners")


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of customers: an order's priority, from its month on; orders in progress have no source profile."""
    known = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select(
        F.col("o_orderkey").alias("claim"), F.col("o_custkey").alias("claim_type"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("value"), F.trunc("o_orderdate", "year").alias("effective"),
        F.when(known, F.when(F.col("o_orderstatus") == "F", 1).otherwise(2)).alias("rank"), F.when(known, F.when(F.col("o_orderkey") % 3 == 0, "margin").otherwise("cash")).alias("accounts"),
    )


def claim_conflict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's claim that contradicts another of its customer."""
    return conflicting_claims(order_claims(spark, sf_dir))


def completeness(items: DataFrame, claims: DataFrame) -> DataFrame:
    """kind, item, status of items (kind, item, decided, documents): the decision if there is one, else the highest step
    that the item's claims (item, review) reach, else whether it has documents. One aggregation of claims and a join."""
    has = lambda *reviews: F.max(F.col("review").isin(*reviews).cast("int")) == 1
    step = F.when(has("conflicting"), "conflicting").when(has("accepted", "corrected"), "reviewed").otherwise("extracted")
    reached = claims.groupBy("item").agg(step.alias("step"))
    received = F.when(F.col("documents") > 0, "document_received").otherwise("missing")
    return items.join(reached, "item", "left").select("kind", "item", F.coalesce("decided", "step", received).alias("status"))


def completeness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind (region) how many items (customers) stand on each step, as columns, and how many are past documents.
    Claims are orders: urgent ones conflict, finished ones are accepted; a balance below -900 rejects, above 9,500
    approves; documents are counted by the balance's thousands."""
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("kind"))
    decided = F.when(F.col("c_acctbal") < -900, "rejected").when(F.col("c_acctbal") > 9_500, "approved")
    items = table(spark, sf_dir, "customer").join(F.broadcast(regions), "c_nationkey").select("kind", F.col("c_custkey").alias("item"), decided.alias("decided"), F.floor(F.col("c_acctbal") / 1000).alias("documents"))  # 25 nations
    review = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 4 == 0), "conflicting").when(F.col("o_orderstatus") == "F", "accepted").otherwise("pending")
    claims = table(spark, sf_dir, "orders").where("o_orderkey % 6 = 0").select(F.col("o_custkey").alias("item"), review.alias("review"))
    rows = completeness(items, claims)
    wide = rows.groupBy("kind").pivot("status", list(LADDER)).count().na.fill(0)
    done = F.col("reviewed") + F.col("approved") + F.col("rejected")
    return wide.select("kind", *LADDER, done.alias("past_review"))


def activation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows of each symbol: their number, first and last day, adjusted and unadjusted ones, and by tier of quality;
    a row is active unless its day has closes that differ by more than a thousandth."""
    rows = observations(spark, sf_dir)
    days = rows.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_if(F.col("grain") == "adjusted").alias("adjusted"), F.round((F.max("close") - F.min("close")) / F.max("close"), 9).alias("spread"))
    active = days.where("spread <= 0.001")
    tier = lambda k: F.sum(F.when(F.col("sources") == k, F.col("n")).otherwise(0)).cast("long")
    return active.groupBy("symbol").agg(F.sum("n").cast("long").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("adjusted").cast("long").alias("adjusted"), F.sum(F.col("n") - F.col("adjusted")).cast("long").alias("unadjusted"), tier(2).alias("tier_1"), tier(1).alias("tier_2"))


def _digest(previous: str, sequence: int, content: str) -> str:
    return hashlib.sha256(f"{previous}|{sequence}|{content}".encode()).hexdigest()


def _link(state: list, sequence: int, content: str) -> tuple:
    previous, state[0] = state[0], _digest(state[0], sequence, content)
    return sequence, content, previous, state[0]


def chained(rows: DataFrame) -> DataFrame:
    """chain, sequence, content, previous, digest: each digest is of its predecessor's, the sequence and the content, so
    that a chain is a fold in order; `start` is before the first."""
    return fold(rows, ["chain"], ["sequence"], ["sequence", "content"], lambda: ["start"], _link, "sequence long, content string, previous string, digest string")


def _verify(state: list, sequence: int, content: str, previous: str, digest: str) -> tuple:
    """state: the stored and the recomputed digest so far, the last sequence, and the counts."""
    counts = state[3]
    own = _digest(state[1], sequence, content)
    counts["events"] += 1
    counts["gaps"] += sequence - state[2] - 1
    counts["links"] += previous != state[0]
    counts["altered"] += _digest(previous, sequence, content) != digest
    if own != digest:
        counts["broken"] += 1
        counts["first_broken"] = counts["first_broken"] or sequence
    state[:3] = [digest, own, sequence]
    return tuple(counts.values())


def verified(rows: DataFrame) -> DataFrame:
    """What a stored chain (chain, sequence, content, previous, digest) is worth: events; sequences that are missing; links
    to another digest than the one before; altered contents; and, from the start recomputed, the events whose digest
    is another one: all from the first alteration or gap on, which `first_broken` names."""
    counts = ("events", "gaps", "links", "altered", "broken")
    start = lambda: ["start", "start", 0, dict.fromkeys(counts, 0) | {"first_broken": None}]
    fields = ", ".join([*(f"{c} long" for c in counts), "first_broken long"])
    return fold(rows, ["chain"], ["sequence"], ["sequence", "content", "previous", "digest"], start, _verify, fields, last_only=True)


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of users' events, after every 97th event was altered and every 89th removed."""
    sequence = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), sequence.alias("sequence"), F.concat_ws("|", "event_id", "event_type").alias("content"))
    stored = written(chained(events), "chain")
    event = F.split_part("content", F.lit("|"), F.lit(1)).cast("long")
    changed: Column = F.when(event % 97 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return verified(stored.where(event % 89 != 5).withColumn("content", changed)).withColumnRenamed("chain", "user_id")


QUERIES = {f.__name__: f for f in (claim_conflict_reasons, completeness_matrix, activation_coverage, audit_chain)}

_REASONS_SQL = codes_sql(("v", REASONS[0]), ("d", REASONS[1]), ("r", REASONS[2]), ("a", REASONS[3]))
ORACLE = {
    "claim_conflict_reasons": f"""WITH c AS (SELECT o_orderkey AS claim, o_custkey AS claim_type, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS value, date_trunc('year', o_orderdate) AS effective, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 1 ELSE 2 END AS rank, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'margin' ELSE 'cash' END END AS accounts FROM orders WHERE o_orderkey % 10 <> 0),
      p AS (SELECT a.claim, a.claim_type, a.value IS DISTINCT FROM b.value AS v, a.effective IS DISTINCT FROM b.effective AS d, coalesce(a.rank <> b.rank, false) AS r, coalesce(a.accounts <> b.accounts, false) AS a FROM c a JOIN c b ON a.claim_type = b.claim_type AND a.claim <> b.claim),
      g AS (SELECT claim, claim_type, bool_or(v) AS v, bool_or(d) AS d, bool_or(r) AS r, bool_or(a) AS a, count(*) FILTER (v OR d OR r OR a) AS partners FROM p GROUP BY ALL) SELECT claim, claim_type, {_REASONS_SQL} AS reasons, partners FROM g WHERE partners > 0""",
    "completeness_matrix": f"""WITH q AS (SELECT o_custkey AS item, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0 THEN 'conflicting' WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'pending' END AS review FROM orders WHERE o_orderkey % 6 = 0),
      s AS (SELECT n_regionkey AS kind, CASE WHEN c_acctbal < -900 THEN 'rejected' WHEN c_acctbal > 9500 THEN 'approved' WHEN EXISTS (SELECT 1 FROM q WHERE item = c_custkey AND review = 'conflicting') THEN 'conflicting' WHEN EXISTS (SELECT 1 FROM q WHERE item = c_custkey AND review = 'accepted') THEN 'reviewed'
        WHEN EXISTS (SELECT 1 FROM q WHERE item = c_custkey) THEN 'extracted' WHEN floor(c_acctbal / 1000) > 0 THEN 'document_received' ELSE 'missing' END AS status FROM customer JOIN nation ON n_nationkey = c_nationkey)
      SELECT kind, {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in LADDER)}, count(*) FILTER (status IN ('reviewed', 'approved', 'rejected')) AS past_review FROM s GROUP BY kind""",
    "activation_coverage": f"""WITH {BARS_SQL}, {SOURCES_SQL}, d AS (SELECT symbol, day, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (grain = 'adjusted') AS adj, round((max(close) - min(close)) / max(close), 9) AS spread FROM observations GROUP BY ALL)
      SELECT symbol, CAST(sum(n) AS BIGINT) AS rows, min(day) AS first_day, max(day) AS last_day, CAST(sum(adj) AS BIGINT) AS adjusted, CAST(sum(n - adj) AS BIGINT) AS unadjusted, CAST(coalesce(sum(n) FILTER (sources = 2), 0) AS BIGINT) AS tier_1, CAST(coalesce(sum(n) FILTER (sources = 1), 0) AS BIGINT) AS tier_2 FROM d WHERE spread <= 0.001 GROUP BY symbol""",
    "audit_chain": """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s, CAST(event_id AS VARCHAR) || '|' || event_type AS content FROM events),
      c AS (SELECT user_id, s, event_id, content, 'start' AS previous, sha256('start|' || s || '|' || content) AS digest FROM e WHERE s = 1 UNION ALL SELECT e.user_id, e.s, e.event_id, e.content, c.digest, sha256(c.digest || '|' || e.s || '|' || e.content) FROM c JOIN e ON e.user_id = c.user_id AND e.s = c.s + 1),
      t AS (SELECT user_id, s, CASE WHEN event_id % 97 = 0 THEN content || '!' ELSE content END AS content, previous, digest, row_number() OVER (PARTITION BY user_id ORDER BY s) AS i, coalesce(lag(digest) OVER (PARTITION BY user_id ORDER BY s), 'start') AS behind, s - coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY s), 0) - 1 AS gap FROM c WHERE event_id % 89 <> 5),
      r AS (SELECT user_id, i, sha256('start|' || s || '|' || content) AS own FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, sha256(r.own || '|' || t.s || '|' || t.content) FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1)
      SELECT t.user_id, count(*) AS events, CAST(sum(gap) AS BIGINT) AS gaps, count(*) FILTER (previous <> behind) AS links, count(*) FILTER (sha256(previous || '|' || s || '|' || content) <> digest) AS altered, count(*) FILTER (own <> digest) AS broken, min(s) FILTER (own <> digest) AS first_broken FROM t JOIN r ON t.user_id = r.user_id AND t.i = r.i GROUP BY t.user_id""",
}
