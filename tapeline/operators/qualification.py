"""Roll-ups that decide: campaigns that qualify, evidence of a batch of rows, health of a service, and the universe
of an expansion by gates, eight keys and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import r6
from tapeline.functions.intervals import covering
from tapeline.sources.bars import table

# Reasons against a campaign and blockers of a candidate, in their order, and the bounds of the latter.
FAILURES = (
    "completed_day_missing_review", "audit_invalid_or_missing", "reconciliation_invalid_or_missing", "backup_invalid_or_missing", "data_quality_unacceptable_or_missing",
    "unresolved_critical_incidents", "campaign_not_real_market", "approved_real_market_source_missing", "qualification_target_not_met",
)
BLOCKERS = ("tier_2_rows_below_5000", "adjusted_tier_2_rows_below_2000", "invalid_rate_above_2_percent", "genuine_conflict_rate_above_0_1_percent", "duplicate_conflict_rate_above_1_percent")
TIER_2, ADJUSTED_TIER_2, INVALID, CONFLICTS, DUPLICATES = 5000, 2000, 0.02, 0.001, 0.01
PICKS, PER_SECTOR, TARGET_DAYS, LAST = 15, 5, 60, 100
TRUSTED = ("operator_attested", "exchange_verified")


def reasons(names: tuple[str, ...], *found: Column) -> Column:
    """The names whose condition holds, in their order, with commas; empty for none."""
    return F.concat_ws(",", *(F.when(c, F.lit(n)) for n, c in zip(names, found, strict=True)))


def qualified(campaigns: DataFrame, days: DataFrame, reviews: DataFrame, reports: DataFrame, incidents: DataFrame, target: int = TARGET_DAYS) -> DataFrame:
    """For every campaign and scope (paper, real_market) the counters of its days, what is left to the target, whether
    it qualifies, and the reasons against.

    campaigns: campaign, evidence, certified, attested. days: campaign, day, done, audit, reconciled, backed_up, evidence,
    eligible, synthetic, provenance, mandatory, one row a day. reviews: campaign, day, review, at; of several the latest
    counts. reports: campaign, first, last, passed. incidents: campaign, severity, state. A null flag is false, a
    day without review has none, a campaign without days has zeros. Days meet reports in one sweep of each campaign."""
    state = reviews.groupBy("campaign", "day").agg(F.max_by("review", F.struct("at", "review")).alias("review"))
    good = reports.where("passed").select("campaign", "first", "last")
    met = covering(days.where("day is not null"), good, ["campaign"]).join(state, ["campaign", "day"], "left").join(campaigns.withColumnRenamed("evidence", "class"), "campaign", "right")
    done, quality = F.coalesce("done", F.lit(False)), F.coalesce(F.col("covers") > 0, F.lit(False))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    source = has("certified") | has("attested")
    paper = done & (F.col("review") == "accepted") & has("audit") & has("reconciled") & has("backed_up") & quality
    real = (F.col("class") == "real_market") & source & (F.col("evidence") == "real_market") & has("eligible") & ~has("synthetic") & F.col("provenance").isin(*TRUSTED) & has("mandatory")
    days_of = lambda c: F.count_if(done & c)
    counted = met.groupBy("campaign", "class", source.alias("source")).agg(
        days_of(F.lit(True)).alias("completed"), days_of(F.col("review").isNotNull()).alias("reviewed"),
        *(days_of(F.col("review") == value).alias(name) for name, value in (("accepted", "accepted"), ("rejected", "rejected"), ("concerns", "concerns_found"), ("rerun", "requires_rerun"))),
        *(days_of(has(c)).alias(c) for c in ("audit", "reconciled", "backed_up")), days_of(quality).alias("quality"), F.count_if(quality).alias("quality_days"),
        days_of(F.col("evidence") == "real_market").alias("real_market"), F.count_if(paper).alias("paper_days"), F.count_if(paper & real).alias("real_days"),
    )
    critical = incidents.where("severity = 'critical' and state <> 'resolved'").groupBy("campaign").agg(F.count("*").alias("unresolved"))
    scopes = counted.join(critical, "campaign", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0))).withColumn("scope", F.explode(F.array(F.lit("paper"), F.lit("real_market"))))
    strict = F.col("scope") == "real_market"
    rows = scopes.withColumn("qualifying", F.when(strict, F.col("real_days")).otherwise(F.col("paper_days"))).withColumn("remaining", F.greatest(F.lit(target) - F.col("qualifying"), F.lit(0)))
    short = [F.col(c) < F.col("completed") for c in ("reviewed", "audit", "reconciled", "backed_up", "quality_days")]
    failures = reasons(FAILURES, *short, F.col("unresolved") > 0, strict & ~F.col("class").eqNullSafe("real_market"), strict & ~F.col("source"), F.col("remaining") > 0)
    return rows.select(
        "campaign", "scope", F.lit(target).cast("long").alias("planned"), "completed", "reviewed", "accepted", "rejected", "concerns", F.greatest(F.lit(target) - F.col("completed"), F.lit(0)).alias("missing"),
        "rerun", "audit", "reconciled", "backed_up", "quality", "qualifying", "unresolved", "real_market", "remaining", (failures == "").alias("qualifies"), failures.alias("failures"),
    )


def qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven campaigns of the orders' days, with reviews, monthly quality reports and incidents made of them; the first
    two are kept without faults."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("c"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    base = orders.groupBy("c", "day").agg(F.min("o_orderkey").alias("k"))
    sound = lambda expr: F.expr(f"c < 2 or {expr}")
    provenance = F.when(F.col("k") % 4 == 0, "unknown").when(F.col("k") % 4 == 1, "exchange_verified").otherwise("operator_attested")
    days = base.select(
        F.col("c").alias("campaign"), "day", F.expr("k % 11 <> 0").alias("done"), sound("k % 17 <> 0").alias("audit"), sound("k % 23 <> 0").alias("reconciled"), sound("k % 31 <> 0").alias("backed_up"),
        F.when(F.col("k") % 3 == 0, "paper").otherwise("real_market").alias("evidence"), F.expr("k % 5 <> 0").alias("eligible"), F.expr("k % 37 = 0").alias("synthetic"), provenance.alias("provenance"), F.expr("k % 29 <> 0").alias("mandatory"),
    )
    review = F.when(F.col("k") % 10 == 7, "rejected").when(F.col("k") % 10 == 8, "concerns_found").when(F.col("k") % 10 == 9, "requires_rerun").otherwise("accepted")
    reviews = base.where(sound("k % 19 <> 3")).select(F.col("c").alias("campaign"), "day", review.alias("review"), F.col("k").alias("at"))
    reports = base.groupBy(F.col("c").alias("campaign"), F.trunc("day", "month").alias("month")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.min("k").alias("k")).select("campaign", "first", "last", F.expr("campaign < 2 or k % 5 <> 0").alias("passed"))
    incidents = orders.select(F.col("c").alias("campaign"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("minor").alias("severity"), F.when((F.col("c") < 2) | (F.col("o_orderstatus") == "F"), "resolved").otherwise("open").alias("state"))
    campaigns = orders.select(F.col("c").alias("campaign")).distinct().select("campaign", F.when(F.col("campaign") % 2 == 0, "real_market").otherwise("paper").alias("evidence"), (F.col("campaign") % 4 == 0).alias("certified"), (F.col("campaign") == 3).alias("attested"))
    return qualified(campaigns, days, reviews, reports, incidents)


def batch_evidence(rows: DataFrame) -> DataFrame:
    """Evidence of each batch: rows, repeated identities, arrivals whose moment is before the one that came just before,
    rows of unknown provenance, sources, whether it passes, and the SHA-256 of these as JSON with sorted keys.

    rows: batch, arrival, symbol, moment, source, provenance; sources are codes without quotes or signs beyond ASCII.
    Nulls in an identity are values like others; a null moment is neither early nor late, a null provenance is unknown."""
    order = Window.partitionBy("batch").orderBy("arrival")
    early = F.coalesce(F.col("moment") < F.lag("moment").over(order), F.lit(False))
    each = rows.withColumn("early", early.cast("int")).withColumn("unknown", F.coalesce((F.col("provenance") == "unknown"), F.lit(True)).cast("int"))
    kinds = each.groupBy("batch", "symbol", "moment", "source").agg(F.count("*").alias("n"), F.sum("early").alias("early"), F.sum("unknown").alias("unknown"))
    found = kinds.groupBy("batch").agg(F.sum("n").alias("row_count"), F.sum(F.col("n") - 1).alias("duplicate_rows"), F.sum("early").alias("out_of_order_events"), F.sum("unknown").alias("unknown_timestamp_rows"), F.array_join(F.sort_array(F.collect_set("source")), '", "').alias("names"))
    passed = (F.col("duplicate_rows") == 0) & (F.col("out_of_order_events") == 0) & (F.col("unknown_timestamp_rows") == 0)
    names = F.when(F.col("names") == "", "").otherwise(F.concat(F.lit('"'), "names", F.lit('"')))
    text = F.format_string('{"duplicate_rows": %d, "out_of_order_events": %d, "passed": %s, "row_count": %d, "sources": [%s], "unknown_timestamp_rows": %d}', "duplicate_rows", "out_of_order_events", passed.cast("string"), "row_count", names, "unknown_timestamp_rows")
    return found.select("batch", "row_count", "duplicate_rows", "out_of_order_events", "unknown_timestamp_rows", F.replace("names", F.lit('", "'), F.lit(",")).alias("sources"), passed.alias("passed"), F.sha2(text, 256).alias("integrity_hash"))


def inline_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows that arrive by id in a batch an hour, some stamped late, to the minute, or by an unknown clock."""
    late = F.when(F.col("event_id") % 211 == 0, F.expr("ts - interval 10 minutes")).otherwise(F.col("ts"))
    rows = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH").alias("batch"), F.col("event_id").alias("arrival"), (F.col("user_id") % 40).alias("symbol"), F.date_trunc("minute", late).alias("moment"),
        F.col("event_type").alias("source"), F.when(F.col("event_id") % 307 == 0, "unknown").otherwise("operator_attested").alias("provenance"),
    )
    return batch_evidence(rows)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, name, value: of the LAST newest metrics each name's newest one; the number of open orders; and the mean latency
    of the LAST orders that were done last."""
    newest = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(LAST)
    metrics = newest.groupBy(F.col("event_type").alias("name")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")).select(F.lit("metric").alias("kind"), "name", r6("value").alias("value"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", (F.col("o_orderkey") % 97 + 1).alias("latency"))
    depth = orders.agg(F.count_if(F.col("o_orderstatus") != "F").cast("double").alias("value")).select(F.lit("orders").alias("kind"), F.lit("queue_depth").alias("name"), "value")
    done = orders.where("o_orderstatus = 'F'").orderBy(F.desc(F.expr("timestampadd(second, latency, o_orderdate)")), F.desc("o_orderkey")).limit(LAST)
    return metrics.unionAll(depth).unionAll(done.agg(r6(F.avg("latency")).alias("value")).select(F.lit("orders").alias("kind"), F.lit("order_latency_seconds").alias("name"), "value"))


_KEYS = (("adjusted_rows", True), ("tier_2_rows", True), ("coverage_days", True), ("conflicts", False), ("invalid", False), ("duplicates", False), ("validation_days", True), ("symbol", False))


def expansion(candidates: DataFrame, active: DataFrame, *, least: int = TIER_2, least_adjusted: int = ADJUSTED_TIER_2, picks: int = PICKS, per_sector: int = PER_SECTOR) -> DataFrame:
    """symbol, sector, blockers, place, status of every candidate: the best of each sector without an active symbol come
    first, then the best of all by the eight keys, per_sector of a sector at most with its active ones.

    candidates: symbol, sector, raw_rows, logical_rows and the eight keys, none null. active: symbol, sector. A sector's rank by
    the keys decides both rules, so that the greedy walk is one rank and one top-k of `picks` rows. Fewer eligible
    candidates than picks are all there is; the reference stops there, here the caller counts."""
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    gates = [F.col("tier_2_rows") < least, F.col("adjusted_rows") < least_adjusted, rate("invalid", "raw_rows") > INVALID, rate("conflicts", "logical_rows") > CONFLICTS, rate("duplicates", "logical_rows") > DUPLICATES]
    rows = candidates.withColumn("blockers", reasons(BLOCKERS, *gates))
    held = active.groupBy("sector").agg(F.count("*").alias("held"))
    keys = [F.desc(k) if down else F.asc(k) for k, down in _KEYS]
    able = rows.where("blockers = ''").join(held, "sector", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    able = able.withColumn("rank", F.row_number().over(Window.partitionBy("sector").orderBy(*keys))).where(F.col("rank") <= per_sector).where(F.col("rank") <= per_sector - F.col("held"))
    first = (F.col("held") == 0) & (F.col("rank") == 1)
    order = [F.desc(first), F.when(first, F.col("sector")), *keys]
    chosen = able.orderBy(*order).limit(picks)  # the feature: so many picks
    placed = chosen.select("symbol", F.row_number().over(Window.orderBy(*order)).alias("place"))  # at most `picks` rows
    status = F.when(F.col("place").isNotNull(), "recommended_pending_human_review_not_active").when(F.col("blockers") == "", "eligible_not_selected_under_size_and_sector_cap").otherwise("not_recommended")
    return rows.join(placed, "symbol", "left").select("symbol", "sector", "blockers", "place", status.alias("status"))


def independent_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates, their lines as rows of tiers and faults, nations' regions as sectors; suppliers of high
    balance among the first ten are the active ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").alias("raw_rows"), F.count_if(F.col("l_linestatus") == "F").alias("tier_2_rows"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")).alias("adjusted_rows"),
        (F.datediff(F.max("l_shipdate"), F.min("l_shipdate")) + 1).cast("long").alias("coverage_days"), F.count_if(F.expr("l_orderkey % 2003 = 0")).alias("conflicts"), F.count_if(F.expr("l_orderkey % 67 = 0")).alias("invalid"),
        F.count_if(F.expr("l_orderkey % 251 = 0")).alias("duplicates"), F.count_distinct(F.to_date("l_shipdate")).alias("validation_days"),
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("sector"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nations), "s_nationkey").select("s_suppkey", "sector", "s_acctbal")  # 25 nations
    candidates = suppliers.join(lines, "s_suppkey").withColumnRenamed("s_suppkey", "symbol").withColumn("logical_rows", F.col("raw_rows"))
    active = suppliers.where("s_suppkey < 10 and s_acctbal > 5000").select(F.col("s_suppkey").alias("symbol"), "sector")
    return expansion(candidates.join(active.select("symbol"), "symbol", "left_anti"), active, least=150, least_adjusted=60)


_SOUND = lambda c: f"(c < 2 OR {c})"
_NAMED = lambda names, found: "concat_ws(','," + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in zip(names, found, strict=True)) + ")"
_ORDER = ", ".join(f"{k} {'DESC' if down else 'ASC'}" for k, down in _KEYS)

QUERIES = {"qualification": qualification, "inline_evidence": inline_evidence, "health": health, "independent_universe": independent_universe}

ORACLE = {
    "qualification": f"""WITH o AS (SELECT o_custkey % 7 AS c, CAST(o_orderdate AS DATE) AS day, * FROM orders), b AS (SELECT c, day, min(o_orderkey) AS k FROM o GROUP BY c, day),
m AS (SELECT c, min(day) AS first, max(day) AS last, min(k) AS k FROM b GROUP BY c, date_trunc('month', day)),
d AS (SELECT c, day, k, k % 11 <> 0 AS done, {_SOUND('k % 17 <> 0')} AS audit, {_SOUND('k % 23 <> 0')} AS reconciled, {_SOUND('k % 31 <> 0')} AS backed_up, k % 3 <> 0 AS real,
  CASE WHEN {_SOUND('k % 19 <> 3')} THEN CASE k % 10 WHEN 7 THEN 'rejected' WHEN 8 THEN 'concerns_found' WHEN 9 THEN 'requires_rerun' ELSE 'accepted' END END AS review,
  EXISTS (SELECT 1 FROM m WHERE m.c = b.c AND b.day BETWEEN m.first AND m.last AND {_SOUND('m.k % 5 <> 0').replace('c <', 'm.c <')}) AS quality FROM b),
q AS (SELECT *, done AND coalesce(review = 'accepted', false) AND audit AND reconciled AND backed_up AND quality AS paper,
  c % 2 = 0 AND (c % 4 = 0 OR c = 3) AND real AND k % 5 <> 0 AND k % 37 <> 0 AND k % 4 <> 0 AND k % 29 <> 0 AS strict FROM d),
g AS (SELECT c AS campaign, count(*) FILTER (done) AS completed, count(review) FILTER (done) AS reviewed, count(*) FILTER (done AND review = 'accepted') AS accepted, count(*) FILTER (done AND review = 'rejected') AS rejected,
  count(*) FILTER (done AND review = 'concerns_found') AS concerns, count(*) FILTER (done AND review = 'requires_rerun') AS rerun, count(*) FILTER (done AND audit) AS audit, count(*) FILTER (done AND reconciled) AS reconciled,
  count(*) FILTER (done AND backed_up) AS backed_up, count(*) FILTER (done AND quality) AS quality, count(*) FILTER (quality) AS quality_days, count(*) FILTER (done AND real) AS real_market,
  count(*) FILTER (paper) AS paper_days, count(*) FILTER (paper AND strict) AS real_days FROM q GROUP BY c),
u AS (SELECT g.*, scope, (SELECT count(*) FROM o WHERE o.c = g.campaign AND c >= 2 AND o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT') AS unresolved,
  CASE WHEN scope = 'paper' THEN paper_days ELSE real_days END AS qualifying FROM g, (VALUES ('paper'), ('real_market')) s(scope)),
r AS (SELECT *, greatest({TARGET_DAYS} - qualifying, 0) AS remaining FROM u),
f AS (SELECT *, {_NAMED(FAILURES, ('reviewed < completed', 'audit < completed', 'reconciled < completed', 'backed_up < completed', 'quality_days < completed', 'unresolved > 0', "scope <> 'paper' AND campaign % 2 <> 0", "scope <> 'paper' AND campaign % 4 <> 0 AND campaign <> 3", 'remaining > 0'))} AS failures FROM r)
SELECT campaign, scope, CAST({TARGET_DAYS} AS BIGINT) AS planned, completed, reviewed, accepted, rejected, concerns, greatest({TARGET_DAYS} - completed, 0) AS missing, rerun, audit, reconciled, backed_up, quality, qualifying, unresolved, real_market, remaining, failures = '' AS qualifies, failures FROM f""",
    "inline_evidence": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d %H') AS batch, event_id, user_id % 40 AS symbol, date_trunc('minute', CASE WHEN event_id % 211 = 0 THEN ts - INTERVAL 10 MINUTE ELSE ts END) AS moment, event_type AS source, event_id % 307 = 0 AS unknown FROM events),
w AS (SELECT *, moment < lag(moment) OVER (PARTITION BY batch ORDER BY event_id) AS early FROM e),
g AS (SELECT batch, count(*) AS row_count, count(*) - count(DISTINCT (symbol, moment, source)) AS duplicate_rows, count(*) FILTER (early) AS out_of_order_events, count(*) FILTER (unknown) AS unknown_timestamp_rows, list_sort(list(DISTINCT source)) AS names FROM w GROUP BY batch),
p AS (SELECT *, duplicate_rows = 0 AND out_of_order_events = 0 AND unknown_timestamp_rows = 0 AS passed FROM g)
SELECT batch, row_count, duplicate_rows, out_of_order_events, unknown_timestamp_rows, array_to_string(names, ',') AS sources, passed,
  sha256('{"duplicate_rows": ' || duplicate_rows || ', "out_of_order_events": ' || out_of_order_events || ', "passed": ' || passed || ', "row_count": ' || row_count || ', "sources": ["' || array_to_string(names, '", "') || '"], "unknown_timestamp_rows": ' || unknown_timestamp_rows || '}') AS integrity_hash FROM p""",
    "health": f"""WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT {LAST}), d AS (SELECT o_orderkey % 97 + 1 AS latency FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate + to_seconds(o_orderkey % 97 + 1) DESC, o_orderkey DESC LIMIT {LAST})
SELECT 'metric' AS kind, event_type AS name, round(last(value ORDER BY ts, event_id), 6) AS value FROM n GROUP BY event_type UNION ALL SELECT 'orders', 'queue_depth', CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'orders', 'order_latency_seconds', round(avg(latency), 6) FROM d""",
    "independent_universe": f"""WITH s AS (SELECT s_suppkey AS symbol, n_regionkey AS sector, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey), a AS (SELECT * FROM s WHERE symbol < 10 AND s_acctbal > 5000),
l AS (SELECT l_suppkey AS symbol, count(*) AS raw_rows, count(*) FILTER (l_linestatus = 'F') AS tier_2_rows, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A') AS adjusted_rows,
  date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) + 1 AS coverage_days, count(*) FILTER (l_orderkey % 2003 = 0) AS conflicts, count(*) FILTER (l_orderkey % 67 = 0) AS invalid, count(*) FILTER (l_orderkey % 251 = 0) AS duplicates,
  count(DISTINCT CAST(l_shipdate AS DATE)) AS validation_days FROM lineitem GROUP BY l_suppkey),
c AS (SELECT s.sector, l.*, {_NAMED(BLOCKERS, ('tier_2_rows < 150', 'adjusted_rows < 60', f'invalid / raw_rows > {INVALID}', f'conflicts / raw_rows > {CONFLICTS}', f'duplicates / raw_rows > {DUPLICATES}'))} AS blockers FROM s JOIN l USING (symbol) WHERE symbol NOT IN (SELECT symbol FROM a)),
r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY {_ORDER}) AS rank, (SELECT count(*) FROM a WHERE a.sector = c.sector) AS held FROM c WHERE blockers = ''),
k AS (SELECT *, held = 0 AND rank = 1 AS first FROM r WHERE rank <= {PER_SECTOR} - held),
p AS (SELECT symbol, row_number() OVER (ORDER BY first DESC, CASE WHEN first THEN sector END, {_ORDER}) AS place FROM k QUALIFY place <= {PICKS})
SELECT symbol, sector, blockers, CAST(place AS INT) AS place, CASE WHEN place IS NOT NULL THEN 'recommended_pending_human_review_not_active' WHEN blockers = '' THEN 'eligible_not_selected_under_size_and_sector_cap' ELSE 'not_recommended' END AS status FROM c LEFT JOIN p USING (symbol)""",
}
