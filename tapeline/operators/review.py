"""Evidence review: which rows may be compared, why pairs conflict, dispositions, lineage, claims, statements, intervals
and the selection of a universe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import codes, codes_sql, r6
from tapeline.sources.bars import BARS_SQL, SOURCES_SQL, bars, observations, table

# Grains that rows may be compared in, and the approvals that bar a mapping.
GRAINS, BARRED = ("adjusted", "unadjusted"), ("rejected", "under_review")
TOLERANCE = 0.001
# Weights of a source's quality.
WEIGHTS = {"valid": 40, "complete": 25, "unique": 20, "continuous": 15}
ANCHORS, PER_SECTOR, TARGET = 3, 3, 12


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observations with a mapping: its confidence and approval, the source's hash and whether it repeats a day."""
    rows = observations(spark, sf_dir)
    number = F.substring("symbol", 2, 1).cast("int")
    repeated = F.count("*").over(Window.partitionBy("source", "symbol", "day", "grain")) > 1
    return rows.select(
        "*", F.when((number == 4) & (F.col("source") == "B"), "low").otherwise("high").alias("confidence"), F.when(number == 3, "under_review").when((number == 2) & (F.col("source") == "A"), "rejected").otherwise("approved").alias("approval"),
        F.sha2("source", 256).alias("source_hash"), repeated.alias("repeats"),
    )


def eligibility(a: str = "_a", b: str = "_b") -> Column:
    """Reason codes against the comparison of two rows, in their order; empty where they may be compared."""
    col = lambda name, side: F.col(name + side)
    known = col("grain", a).isin(*GRAINS) & col("grain", b).isin(*GRAINS)
    return codes(
        ((col("confidence", a) != "high") | (col("confidence", b) != "high"), "mapping_confidence_insufficient"), (col("approval", a).isin(*BARRED) | col("approval", b).isin(*BARRED), "mapping_approval_insufficient"), (~known, "unknown_adjustment_grain"),
        (known & (col("grain", a) != col("grain", b)), "adjustment_grain_mismatch"), (col("source", a) == col("source", b), "same_source_dataset"), (col("source_hash", a) == col("source_hash", b), "duplicate_logical_dataset"), (col("repeats", a) | col("repeats", b), "source_has_conflicting_duplicates"),
    )


_PAIRED = ("row_id", "source", "grain", "close", "volume", "confidence", "approval", "source_hash", "repeats")


def pairs(rows: DataFrame) -> DataFrame:
    """Unordered pairs of the rows of a symbol's day; a day has at most a few rows, one for each source and repeat."""
    a, b = (rows.select("symbol", "day", *(F.col(c).alias(f"{c}_{x}") for c in _PAIRED)) for x in "ab")
    return a.join(b, ["symbol", "day"]).where("row_id_a < row_id_b")


def comparison_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by symbol and reasons against their comparison; of eligible ones, how many agree within the tolerance."""
    rows = pairs(mapped(spark, sf_dir)).withColumn("reasons", eligibility())
    off = F.round(F.abs(F.col("close_a") - F.col("close_b")) / F.greatest("close_a", "close_b"), 9)
    return rows.groupBy("symbol", "reasons").agg(F.count("*").alias("pairs"), F.count_if((F.col("reasons") == "") & (off <= TOLERANCE)).alias("agreeing"), F.count_if((F.col("reasons") == "") & (off > TOLERANCE)).alias("conflicting"))


def conflict_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs outside the tolerance of price or volume, by the first segment that explains them; days with a move of half or more
    of the first source's close count as action periods."""
    rows = mapped(spark, sf_dir)
    first = rows.where("source = 'A'").select("symbol", "day", "close").withColumn("was", F.lag("close").over(Window.partitionBy("symbol").orderBy("day")))
    actions = first.where(F.round(F.abs(F.col("close") / F.col("was") - 1), 9) >= 0.5).select("symbol", "day", F.lit(True).alias("action"))
    met = pairs(rows).join(actions, ["symbol", "day"], "left")
    price = F.round(F.abs(F.col("close_a") - F.col("close_b")) / F.greatest("close_a", "close_b"), 9) > TOLERANCE
    ratio = F.greatest("volume_a", "volume_b") / F.nullif(F.least("volume_a", "volume_b"), F.lit(0))
    volume = F.coalesce(F.round(ratio - 1, 9) > TOLERANCE, F.lit(False))
    segment = (
        F.when(F.col("grain_a") != F.col("grain_b"), "adjusted_versus_unadjusted_comparison").when((F.col("approval_a") == "under_review") & (F.col("approval_b") == "under_review"), "symbol_mapping_problem").when(F.col("source_a") == F.col("source_b"), "duplicate_source_conflict")
        .when(~price & volume & (ratio >= 10), "volume_unit_mismatch").when(~price & volume, "rounding_difference").when(F.coalesce("action", F.lit(False)), "corporate_action_period").otherwise("real_unexplained_conflict")
    )
    return met.where(price | volume).groupBy(segment.alias("segment")).agg(F.count("*").alias("pairs"), F.count_distinct("symbol").alias("symbols"), F.min("day").alias("first_day"))


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's rows by their one disposition, the first that fits, and whether they add up to all its rows."""
    rows = mapped(spark, sf_dir)
    day = Window.partitionBy("symbol", "day", "grain")
    peer = rows.withColumn("sources", F.size(F.collect_set("source").over(day))).withColumn("spread", F.round((F.max("close").over(day) - F.min("close").over(day)) / F.max("close").over(day), 9))
    valid = (F.least("open", "close") >= F.col("low")) & (F.greatest("open", "close") <= F.col("high"))
    kind = (
        F.when(~valid, "rejected_invalid").when((F.col("confidence") != "high") | F.col("approval").isin(*BARRED), "held_mapping").when((F.col("sources") > 1) & (F.col("spread") > TOLERANCE), "held_genuine_conflict")
        .when(F.col("repeats"), "rejected_duplicate_conflict").when(F.col("sources") > 1, "tier_1_cross_source_confirmed").when(F.col("source") == "A", "tier_2_single_source_high_quality").otherwise("tier_3_research_only")
    )
    counts = peer.withColumn("kind", kind).groupBy("symbol").agg(F.count("*").alias("rows"), *(F.count_if(F.col("kind") == k).alias(k) for k in DISPOSITIONS))
    return counts.withColumn("reconciled", F.col("rows") == reduce(lambda x, y: x + y, (F.col(k) for k in DISPOSITIONS)))


# Dispositions in their order.
DISPOSITIONS = ("rejected_invalid", "held_mapping", "held_genuine_conflict", "rejected_duplicate_conflict", "tier_1_cross_source_confirmed", "tier_2_single_source_high_quality", "tier_3_research_only")


def activity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as usable, without activity, or with an issue, and why; some have their volume or trades blanked."""
    code = F.dayofmonth("day") % 9
    rows = bars(spark, sf_dir).select("close", "open", "high", "low", F.when(code.isin(0, 1), 0).otherwise(F.col("volume")).alias("volume"), F.when(code.isin(0, 2), 0).otherwise(F.col("n")).alias("trades"), F.when(code == 3, -1.0).otherwise(F.col("close")).alias("last"), F.when(code == 4, F.col("high") * 2).otherwise(F.col("open")).alias("previous"))
    none, some = (F.col("volume") == 0) & (F.col("trades") == 0), (F.col("volume") == 0) | (F.col("trades") == 0)
    least, most = F.least("open", "close", "last"), F.greatest("open", "close", "last", "previous")
    reason = F.when(none, "source_reports_zero_activity").when(some, "inconsistent_activity_fields").when(F.least("open", "high", "low", "close", "last") <= 0, "nonpositive_price_on_active_row").when((least < F.col("low")) | (most > F.col("high")), "malformed_ohlc_or_ltp")
    status = F.when(none, "ZERO_ACTIVITY").when(reason.isNotNull(), "DATA_ISSUE").otherwise("USABLE")
    return rows.groupBy(status.alias("status"), reason.alias("reason")).agg(F.count("*").alias("rows"))


def lineage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source whose lineage (source, hash, row id, name) is complete, and which field is blank in others."""
    code = F.dayofmonth("day") % 7
    rows = observations(spark, sf_dir).select("source", F.when(code == 1, " ").otherwise(F.col("row_id")).alias("row_id"), F.when(code == 2, None).otherwise(F.sha2("source", 256)).alias("hash"), F.when(code == 3, "").otherwise(F.concat(F.lit("source "), "source")).alias("name"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    missing = codes(*((blank(c), c) for c in ("row_id", "hash", "name")))
    return rows.groupBy("source", missing.alias("missing")).agg(F.count("*").alias("rows")).withColumn("complete", F.col("missing") == "")


def grain_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted rows against unadjusted ones of the same symbol and day: equal closes, closes within a thousandth,
    volumes in hundredths, and adjusted rows without a peer."""
    rows = observations(spark, sf_dir)
    side = lambda grain, x: rows.where(F.col("grain") == grain).groupBy("symbol", "day").agg(F.min("close").alias(f"close_{x}"), F.max("volume").alias(f"volume_{x}"))
    met = side("adjusted", "a").join(side("unadjusted", "u"), ["symbol", "day"], "left")
    off = F.round(F.abs(F.col("close_a") / F.col("close_u") - 1), 9)
    return met.groupBy("symbol").agg(F.count("*").alias("days"), F.count_if(off == 0).alias("equal"), F.count_if(off <= TOLERANCE).alias("near"), F.count_if(F.col("volume_u") == F.col("volume_a") * 100).alias("hundredfold"), F.count_if(F.col("close_u").isNull()).alias("without_peer"))


def volume_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of source B, as text, that equal a volume of source A of that day once both are numbers."""
    rows = observations(spark, sf_dir)
    peers = rows.where("source = 'A'").groupBy("symbol", "day").agg(F.collect_set(F.col("volume").cast("string").cast("double")).alias("peers"))
    met = rows.where("source = 'B'").withColumn("text", F.concat(F.col("volume").cast("string"), F.lit(".0"))).join(peers, ["symbol", "day"], "left")
    same = F.coalesce(F.array_contains("peers", F.col("text").cast("double")), F.lit(False))
    return met.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(same).alias("equal"), F.count_if(F.col("peers").isNull()).alias("without_peer"))


def action_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose JSON evidence names a supplier (by key k): a semi-join after the JSON is taken apart, by type."""
    evidence = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("e")).select("event_type", F.explode(F.array(F.col("e.k"), F.col("e.k") + 50)).alias("s_suppkey"))
    known = table(spark, sf_dir, "supplier").select("s_suppkey")
    return evidence.join(known, "s_suppkey", "left_semi").groupBy("event_type").agg(F.count("*").alias("named"), F.count_distinct("s_suppkey").alias("suppliers"))


def top_by_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's three events of greatest k in their JSON; ties by event."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("k"), "event_id"))
    return rows.where("k is not null").withColumn("place", rank).where("place <= 3")


def statement_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order (a statement) with the latest earlier one that is not reversed (status P), and the change."""
    rows = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    days = rows.withColumn("day_number", F.unix_date("day"))
    kept = F.when(F.col("o_orderstatus") != "P", F.struct("day_number", "o_orderkey", "o_totalprice"))
    met = days.withColumn("was", F.max(kept).over(Window.partitionBy("o_custkey").orderBy("day_number").rangeBetween(Window.unboundedPreceding, -1)))
    return met.select("o_orderkey", F.col("was.o_orderkey").alias("previous"), r6(F.col("o_totalprice") - F.col("was.o_totalprice")).alias("change"))


def active_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's life from first to last day less its suspensions (gaps of more than 3 days between bars)."""
    window = Window.partitionBy("symbol").orderBy("day")
    rows = bars(spark, sf_dir).withColumn("new", F.coalesce(F.datediff("day", F.lag("day").over(window)) > 3, F.lit(True)))
    rows = rows.withColumn("part", F.sum(F.col("new").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("symbol", "part").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("bars"))


def decision_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a ledger of decisions on customers (those whose key leaves 1 of 3 have none): approved, held
    and unmatched ones, and whether the counts are those of the ledger."""
    decisions = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, "approved").otherwise("held").alias("decision"))
    met = table(spark, sf_dir, "orders").join(decisions, "o_custkey", "left")
    return met.groupBy(F.coalesce("decision", F.lit("unmatched")).alias("decision")).agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), r6(F.sum("o_totalprice") / F.count("*")).alias("mean_price"))


def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims (customers' segments and balances) of one nation and segment that contradict each other, in pairs of
    neighbours by key, with the nation's name and reasons: balances of opposite sign, or far apart."""
    claims = table(spark, sf_dir, "customer")
    after = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    rows = claims.select("c_nationkey", "c_custkey", "c_acctbal", F.lead("c_custkey").over(after).alias("other"), F.lead("c_acctbal").over(after).alias("balance")).where("other is not null")
    reasons = codes((F.signum("c_acctbal") != F.signum("balance"), "opposite"), (F.round(F.abs(F.col("c_acctbal") - F.col("balance")), 6) > 5000, "far_apart"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return rows.withColumn("reasons", reasons).where("reasons <> ''").join(names, "c_nationkey", "left").select("n_name", "c_custkey", "other", "reasons")


def default_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their supplier's nation; suppliers with an odd key are not in the dimension and get the default row."""
    dimension = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines")).join(dimension, "l_suppkey", "left")
    return rows.groupBy(F.coalesce("nation", F.lit(-1)).alias("nation")).agg(F.sum("lines").alias("lines"))


def symbol_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts, extremes, distinct days and sums of each symbol over both sources."""
    rows = observations(spark, sf_dir)
    adjusted = F.col("grain") == "adjusted"
    return rows.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.count_if(adjusted).alias("adjusted"), F.count_distinct("day").alias("days"), F.count_distinct(F.when(adjusted, F.col("day"))).alias("adjusted_days"), F.min(F.when(~adjusted, F.col("day"))).alias("first_day"), F.max(F.when(~adjusted, F.col("day"))).alias("last_day"),
        F.sum(F.when(F.col("volume") > 1000, 1).otherwise(0)).alias("busy"), F.count_distinct("source").alias("sources"),
    )


def universe_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ladder over each symbol's profile: which step it reaches."""
    rows = symbol_profile(spark, sf_dir)
    step = F.when(F.col("sources") < 2, "single_source").when(F.col("days") < 252, "insufficient_history").when(F.col("adjusted_days") * 12 < F.col("days"), "insufficient_adjusted").otherwise("ready")
    return rows.select("symbol", "days", step.alias("status"))


def weighted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's quality of 100: shares of valid, complete and unique rows and of days without a gap, weighted;
    and the simpler score that takes a point for each percent of rows with an issue."""
    rows = observations(spark, sf_dir)
    valid = (F.least("open", "close") >= F.col("low")) & (F.greatest("open", "close") <= F.col("high"))
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("source", "symbol", "grain").orderBy("day", "row_id")))
    sums = rows.withColumn("gap", gap).groupBy("source").agg(F.avg(valid.cast("double")).alias("valid"), F.avg((F.col("volume") > 0).cast("double")).alias("complete"), (F.count_distinct("symbol", "day", "grain") / F.count("*")).alias("unique"), F.avg(F.coalesce((F.col("gap") <= 3).cast("double"), F.lit(1.0))).alias("continuous"))
    score = reduce(lambda x, y: x + y, (F.col(c) * w for c, w in WEIGHTS.items()))
    return sums.select("source", F.round(score, 4).alias("score"), F.round(F.greatest(F.lit(0.0), 100 - (1 - F.col("valid")) * 100 - (1 - F.col("unique")) * 100), 4).alias("simple"))


def mapping_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's close is among the other's closes of that day, by symbol: shares and a class."""
    rows = observations(spark, sf_dir).withColumn("text", F.round("close", 4))
    known = rows.groupBy("source", "symbol", "day").agg(F.collect_set("text").alias("known")).withColumn("source", F.when(F.col("source") == "A", "B").otherwise("A"))
    met = rows.join(known, ["source", "symbol", "day"], "left")
    found = F.coalesce(F.array_contains("known", F.col("text")), F.lit(False))
    sums = met.groupBy("source", "symbol").agg(F.count("*").alias("rows"), F.count_if(found).alias("found"), F.count_if(F.col("known").isNull()).alias("unmatched"))
    share = F.col("found") / F.col("rows")
    return sums.withColumn("kind", F.when(share >= 0.7, "same_series").when(share >= 0.3, "mixed").otherwise("other_series"))


def rounding_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes as a coarse and a fine source print them: greatest difference, whether the number of decimals differs,
    and what that means."""
    close = F.col("close").cast("decimal(18,4)")
    coarse = F.when(F.dayofmonth("day") % 2 == 0, F.round(close, 1).cast("decimal(18,1)").cast("string")).otherwise(F.round(close, 2).cast("decimal(18,2)").cast("string"))
    rows = bars(spark, sf_dir).select("symbol", close.cast("string").alias("fine"), coarse.alias("coarse"))
    digits = lambda c: F.length(F.split_part(F.col(c), F.lit("."), F.lit(2)))
    off = F.abs(F.col("fine").cast("decimal(18,4)") - F.col("coarse").cast("decimal(18,4)")).cast("double")
    kind = F.when(off == 0, "equal").when((digits("fine") != digits("coarse")) & (off <= 0.05), "rounding_of_source").when(off <= 0.05, "small_difference").otherwise("conflict")
    return rows.groupBy("symbol", kind.alias("kind")).agg(F.count("*").alias("rows"), F.round(F.max(off), 4).alias("greatest"))


def universe_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of positive balance as a universe of TARGET: the first ANCHORS by key, one for each region without
    any, then the best by balance, PER_SECTOR at most of a region."""
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("sector"))
    rows = table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(F.broadcast(regions), "s_nationkey").select("s_suppkey", "sector", "s_acctbal")  # 25 rows
    anchors = rows.orderBy("s_suppkey").limit(ANCHORS)  # the feature: a fixed number of anchors
    taken = anchors.select("s_suppkey", F.row_number().over(Window.partitionBy("sector").orderBy("s_suppkey")).alias("k")).where(F.col("k") <= PER_SECTOR).select("s_suppkey", F.lit(True).alias("anchor"))
    met = rows.join(taken, "s_suppkey", "left").withColumn("held", F.count("anchor").over(Window.partitionBy("sector")))
    best = F.row_number().over(Window.partitionBy("sector", F.col("anchor").isNull()).orderBy(F.desc("s_acctbal"), "s_suppkey"))
    ranked = met.withColumn("best", best)
    kind = F.when(F.col("anchor"), 0).when((F.col("held") == 0) & (F.col("best") == 1), 1).otherwise(2)
    open_ = ranked.withColumn("kind", kind).where((F.col("kind") == 0) | (F.col("best") <= PER_SECTOR - F.col("held")))
    return open_.orderBy("kind", F.when(F.col("kind") == 2, -F.col("s_acctbal")).otherwise(F.lit(0.0)), "s_suppkey").limit(TARGET).select("s_suppkey", "sector", "kind")


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, days and last day of each tier of a symbol: both sources, one source, adjusted alone."""
    rows = observations(spark, sf_dir).groupBy("symbol", "day").agg(F.count_distinct("source").alias("sources"), F.bool_and(F.col("grain") == "adjusted").alias("adjusted"))
    tier = F.when(F.col("adjusted"), "adjusted_only").when(F.col("sources") > 1, "both").otherwise("single")
    return rows.groupBy("symbol", tier.alias("tier")).agg(F.count("*").alias("days"), F.max("day").alias("last_day"))


def scale_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as text without trailing zeros, and prefix ids of their keys: how many distinct ones, and the longest."""
    rows = bars(spark, sf_dir).select("symbol", F.col("close").cast("decimal(18,4)").cast("string").alias("text"), F.substring(F.sha2(F.concat_ws("|", "symbol", F.col("day").cast("string")), 256), 1, 24).alias("id"))
    plain = F.regexp_replace(F.regexp_replace("text", "0+$", ""), r"\.$", "")
    return rows.groupBy("symbol").agg(F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max(F.length(plain)).alias("longest"), F.sum(F.length(plain)).alias("characters"))


def weight_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of each day's symbols and volume shares: those above a fifth, the share of S0 or 0, and their number."""
    rows = bars(spark, sf_dir)
    share = F.round(F.col("volume") / F.sum("volume").over(Window.partitionBy("day")), 6)
    maps = rows.select("day", "symbol", share.alias("share")).groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "share")))).alias("shares"))
    large = F.map_filter("shares", lambda k, v: v > 0.2)
    return maps.select("day", F.concat_ws(",", F.map_keys(large)).alias("large"), F.coalesce(F.try_element_at("shares", F.lit("S0")), F.lit(0.0)).alias("s0"), F.size("shares").alias("symbols"), F.round(F.aggregate(F.map_values("shares"), F.lit(0.0), lambda a, x: a + x * x), 6).alias("concentration"))


QUERIES = {
    f.__name__: f
    for f in (
        comparison_eligibility, conflict_segments, dispositions, activity_status, lineage_gaps, grain_facts, volume_peers, action_evidence, top_by_json, statement_asof, active_intervals, decision_join,
        claim_conflicts, default_dimension, symbol_profile, universe_readiness, weighted_quality, mapping_review, rounding_review, universe_selection, tier_counts, scale_digits, weight_maps,
    )
}

_MAPPED = f"""WITH {BARS_SQL}, {SOURCES_SQL}, mapped AS (SELECT *, CASE WHEN symbol = 'S4' AND source = 'B' THEN 'low' ELSE 'high' END AS confidence, CASE WHEN symbol = 'S3' THEN 'under_review' WHEN symbol = 'S2' AND source = 'A' THEN 'rejected' ELSE 'approved' END AS approval, count(*) OVER (PARTITION BY source, symbol, day, grain) > 1 AS repeats FROM observations),
pairs AS (SELECT a.symbol, a.day, """ + ", ".join(f"{x}.{c} AS {c}_{x}" for c in ("row_id", "source", "grain", "close", "volume", "confidence", "approval", "repeats") for x in "ab") + " FROM mapped a JOIN mapped b ON a.symbol = b.symbol AND a.day = b.day AND a.row_id < b.row_id)"
_BARRED = "('rejected', 'under_review')"
_REASONS = codes_sql(
    ("confidence_a <> 'high' OR confidence_b <> 'high'", "mapping_confidence_insufficient"), (f"approval_a IN {_BARRED} OR approval_b IN {_BARRED}", "mapping_approval_insufficient"), ("grain_a <> grain_b", "adjustment_grain_mismatch"),
    ("source_a = source_b", "same_source_dataset"), ("source_a = source_b", "duplicate_logical_dataset"), ("repeats_a OR repeats_b", "source_has_conflicting_duplicates"),
)
_OBS = f"WITH {BARS_SQL}, {SOURCES_SQL}"
_OFF = "round(abs(close_a - close_b) / greatest(close_a, close_b), 9)"
_RATIO = "greatest(volume_a, volume_b) / nullif(least(volume_a, volume_b), 0)"
_PROFILE = f"""{_OBS}, prof AS (SELECT symbol, count(*) AS rows, count(*) FILTER (grain = 'adjusted') AS adjusted, count(DISTINCT day) AS days, count(DISTINCT day) FILTER (grain = 'adjusted') AS adjusted_days, min(day) FILTER (grain <> 'adjusted') AS first_day, max(day) FILTER (grain <> 'adjusted') AS last_day,
  CAST(sum(CASE WHEN volume > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS busy, count(DISTINCT source) AS sources FROM observations GROUP BY symbol)"""
_VALID = "least(open, close) >= low AND greatest(open, close) <= high"
ORACLE = {
    "comparison_eligibility": f"{_MAPPED}, r AS (SELECT *, {_REASONS} AS reasons, {_OFF} AS off FROM pairs) SELECT symbol, reasons, count(*) AS pairs, count(*) FILTER (reasons = '' AND off <= {TOLERANCE}) AS agreeing, count(*) FILTER (reasons = '' AND off > {TOLERANCE}) AS conflicting FROM r GROUP BY ALL",
    "conflict_segments": f"""{_MAPPED}, act AS (SELECT symbol, day, true AS action FROM (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS move FROM mapped WHERE source = 'A') WHERE round(abs(move), 9) >= 0.5),
      k AS (SELECT p.*, action, {_OFF} > {TOLERANCE} AS price, coalesce(round({_RATIO} - 1, 9) > {TOLERANCE}, false) AS vol, {_RATIO} AS ratio FROM pairs p LEFT JOIN act USING (symbol, day)),
      s AS (SELECT *, CASE WHEN grain_a <> grain_b THEN 'adjusted_versus_unadjusted_comparison' WHEN approval_a = 'under_review' AND approval_b = 'under_review' THEN 'symbol_mapping_problem' WHEN source_a = source_b THEN 'duplicate_source_conflict' WHEN NOT price AND vol AND ratio >= 10 THEN 'volume_unit_mismatch' WHEN NOT price AND vol THEN 'rounding_difference' WHEN coalesce(action, false) THEN 'corporate_action_period' ELSE 'real_unexplained_conflict' END AS segment FROM k WHERE price OR vol)
      SELECT segment, count(*) AS pairs, count(DISTINCT symbol) AS symbols, min(day) AS first_day FROM s GROUP BY segment""",
    "dispositions": f"""{_MAPPED}, d AS (SELECT symbol, day, grain, count(DISTINCT source) AS sources, round((max(close) - min(close)) / max(close), 9) AS spread FROM mapped GROUP BY ALL),
      k AS (SELECT m.symbol, CASE WHEN NOT ({_VALID}) THEN 'rejected_invalid' WHEN confidence <> 'high' OR approval IN {_BARRED} THEN 'held_mapping' WHEN sources > 1 AND spread > {TOLERANCE} THEN 'held_genuine_conflict' WHEN repeats THEN 'rejected_duplicate_conflict' WHEN sources > 1 THEN 'tier_1_cross_source_confirmed' WHEN source = 'A' THEN 'tier_2_single_source_high_quality' ELSE 'tier_3_research_only' END AS kind FROM mapped m JOIN d USING (symbol, day, grain))
      SELECT symbol, count(*) AS rows, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in DISPOSITIONS)}, true AS reconciled FROM k GROUP BY symbol""",
    "activity_status": f"""WITH {BARS_SQL}, c AS (SELECT *, day(day) % 9 AS code FROM bars), r AS (SELECT open, high, low, close, CASE WHEN code IN (0, 1) THEN 0 ELSE volume END AS volume, CASE WHEN code IN (0, 2) THEN 0 ELSE n END AS trades, CASE WHEN code = 3 THEN -1.0 ELSE close END AS last, CASE WHEN code = 4 THEN high * 2 ELSE open END AS previous FROM c),
      s AS (SELECT CASE WHEN volume = 0 AND trades = 0 THEN 'source_reports_zero_activity' WHEN volume = 0 OR trades = 0 THEN 'inconsistent_activity_fields' WHEN least(open, high, low, close, last) <= 0 THEN 'nonpositive_price_on_active_row' WHEN least(open, close, last) < low OR greatest(open, close, last, previous) > high THEN 'malformed_ohlc_or_ltp' END AS reason FROM r)
      SELECT CASE WHEN reason = 'source_reports_zero_activity' THEN 'ZERO_ACTIVITY' WHEN reason IS NOT NULL THEN 'DATA_ISSUE' ELSE 'USABLE' END AS status, reason, count(*) AS rows FROM s GROUP BY ALL""",
    "lineage_gaps": f"""{_OBS}, c AS (SELECT source, day(day) % 7 AS code FROM observations), m AS (SELECT source, {codes_sql(("code = 1", "row_id"), ("code = 2", "hash"), ("code = 3", "name"))} AS missing FROM c) SELECT source, missing, count(*) AS rows, missing = '' AS complete FROM m GROUP BY ALL""",
    "grain_facts": f"""{_OBS}, a AS (SELECT symbol, day, min(close) AS close, max(volume) AS volume FROM observations WHERE grain = 'adjusted' GROUP BY ALL), u AS (SELECT symbol, day, min(close) AS close, max(volume) AS volume FROM observations WHERE grain = 'unadjusted' GROUP BY ALL), j AS (SELECT a.symbol, round(abs(a.close / u.close - 1), 9) AS off, u.volume = a.volume * 100 AS h, u.close AS uc FROM a LEFT JOIN u ON a.symbol = u.symbol AND a.day = u.day)
      SELECT symbol, count(*) AS days, count(*) FILTER (off = 0) AS equal, count(*) FILTER (off <= {TOLERANCE}) AS near, count(*) FILTER (h) AS hundredfold, count(*) FILTER (uc IS NULL) AS without_peer FROM j GROUP BY symbol""",
    "volume_peers": f"{_OBS}, p AS (SELECT symbol, day, list(DISTINCT CAST(volume AS DOUBLE)) AS peers FROM observations WHERE source = 'A' GROUP BY ALL), j AS (SELECT o.symbol, peers, coalesce(list_contains(peers, CAST(CAST(volume AS VARCHAR) || '.0' AS DOUBLE)), false) AS same FROM observations o LEFT JOIN p USING (symbol, day) WHERE source = 'B') SELECT symbol, count(*) AS rows, count(*) FILTER (same) AS equal, count(*) FILTER (peers IS NULL) AS without_peer FROM j GROUP BY symbol",
    "action_evidence": "WITH e AS (SELECT event_type, unnest([CAST(json_extract_string(props, '$.k') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT) + 50]) AS k FROM events) SELECT event_type, count(*) AS named, count(DISTINCT k) AS suppliers FROM e WHERE k IN (SELECT s_suppkey FROM supplier) GROUP BY event_type",
    "top_by_json": "WITH r AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT user_id, event_id, k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) AS INT) AS place FROM r WHERE k IS NOT NULL QUALIFY place <= 3",
    "statement_asof": """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders), k AS (SELECT o_custkey, day, max(o_orderkey) AS o_orderkey FROM o WHERE o_orderstatus <> 'P' GROUP BY ALL)
      SELECT o.o_orderkey, k.o_orderkey AS previous, round(o.o_totalprice - p.o_totalprice, 6) AS change FROM o ASOF LEFT JOIN k ON o.o_custkey = k.o_custkey AND o.day > k.day LEFT JOIN o p ON p.o_orderkey = k.o_orderkey""",
    "active_intervals": f"WITH {BARS_SQL}, g AS (SELECT symbol, day, coalesce(day - lag(day) OVER (PARTITION BY symbol ORDER BY day) > 3, true) AS new FROM bars), p AS (SELECT symbol, day, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM g) SELECT symbol, part, min(day) AS first_day, max(day) AS last_day, count(*) AS bars FROM p GROUP BY ALL",
    "decision_join": "WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'approved' ELSE 'held' END AS decision FROM customer WHERE c_custkey % 3 <> 1) SELECT coalesce(decision, 'unmatched') AS decision, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice) / count(*), 6) AS mean_price FROM orders LEFT JOIN d ON c_custkey = o_custkey GROUP BY ALL",
    "claim_conflicts": f"""WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, lead(c_custkey) OVER w AS other, lead(c_acctbal) OVER w AS balance FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)), k AS (SELECT *, {codes_sql(("sign(c_acctbal) <> sign(balance)", "opposite"), ("round(abs(c_acctbal - balance), 6) > 5000", "far_apart"))} AS reasons FROM r WHERE other IS NOT NULL)
      SELECT n_name, c_custkey, other, reasons FROM k LEFT JOIN nation ON n_nationkey = c_nationkey WHERE reasons <> ''""",
    "default_dimension": "SELECT coalesce(s_nationkey, -1) AS nation, count(*) AS lines FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = l_suppkey GROUP BY ALL",
    "symbol_profile": f"{_PROFILE} SELECT * FROM prof",
    "universe_readiness": f"{_PROFILE} SELECT symbol, days, CASE WHEN sources < 2 THEN 'single_source' WHEN days < 252 THEN 'insufficient_history' WHEN adjusted_days * 12 < days THEN 'insufficient_adjusted' ELSE 'ready' END AS status FROM prof",
    "weighted_quality": f"""{_OBS}, g AS (SELECT *, day - lag(day) OVER (PARTITION BY source, symbol, grain ORDER BY day, row_id) AS gap FROM observations), s AS (SELECT source, avg(CAST(({_VALID}) AS DOUBLE)) AS valid, avg(CAST((volume > 0) AS DOUBLE)) AS complete, count(DISTINCT symbol || CAST(day AS VARCHAR) || grain)::DOUBLE / count(*) AS uniq, avg(coalesce(CAST((gap <= 3) AS DOUBLE), 1.0)) AS cont FROM g GROUP BY source)
      SELECT source, round(valid * {WEIGHTS['valid']} + complete * {WEIGHTS['complete']} + uniq * {WEIGHTS['unique']} + cont * {WEIGHTS['continuous']}, 4) AS score, round(greatest(0.0, 100 - (1 - valid) * 100 - (1 - uniq) * 100), 4) AS simple FROM s""",
    "mapping_review": f"""{_OBS}, k AS (SELECT CASE source WHEN 'A' THEN 'B' ELSE 'A' END AS source, symbol, day, list(DISTINCT round(close, 4)) AS known FROM observations GROUP BY ALL), j AS (SELECT o.source, o.symbol, known, coalesce(list_contains(known, round(close, 4)), false) AS hit FROM observations o LEFT JOIN k USING (source, symbol, day)),
      s AS (SELECT source, symbol, count(*) AS rows, count(*) FILTER (hit) AS found, count(*) FILTER (known IS NULL) AS unmatched FROM j GROUP BY ALL) SELECT *, CASE WHEN found / rows >= 0.7 THEN 'same_series' WHEN found / rows >= 0.3 THEN 'mixed' ELSE 'other_series' END AS kind FROM s""",
    "rounding_review": f"""WITH {BARS_SQL}, t AS (SELECT symbol, CAST(CAST(close AS DECIMAL(18,4)) AS VARCHAR) AS fine, CASE WHEN day(day) % 2 = 0 THEN CAST(CAST(CAST(close AS DECIMAL(18,4)) AS DECIMAL(18,1)) AS VARCHAR) ELSE CAST(CAST(CAST(close AS DECIMAL(18,4)) AS DECIMAL(18,2)) AS VARCHAR) END AS coarse FROM bars),
      k AS (SELECT symbol, fine, coarse, CAST(abs(CAST(fine AS DECIMAL(18,4)) - CAST(coarse AS DECIMAL(18,4))) AS DOUBLE) AS off FROM t), c AS (SELECT symbol, off, CASE WHEN off = 0 THEN 'equal' WHEN length(split_part(fine, '.', 2)) <> length(split_part(coarse, '.', 2)) AND off <= 0.05 THEN 'rounding_of_source' WHEN off <= 0.05 THEN 'small_difference' ELSE 'conflict' END AS kind FROM k) SELECT symbol, kind, count(*) AS rows, round(max(off), 4) AS greatest FROM c GROUP BY ALL""",
    "universe_selection": f"""WITH r AS (SELECT s_suppkey, n_regionkey AS sector, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0), a AS (SELECT s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY s_suppkey) AS k FROM (SELECT * FROM r ORDER BY s_suppkey LIMIT {ANCHORS})) WHERE k <= {PER_SECTOR}),
      m AS (SELECT r.*, a.s_suppkey IS NOT NULL AS anchor, count(a.s_suppkey) OVER (PARTITION BY sector) AS held, row_number() OVER (PARTITION BY sector, a.s_suppkey IS NULL ORDER BY s_acctbal DESC, r.s_suppkey) AS best FROM r LEFT JOIN a ON a.s_suppkey = r.s_suppkey),
      k AS (SELECT *, CASE WHEN anchor THEN 0 WHEN held = 0 AND best = 1 THEN 1 ELSE 2 END AS kind FROM m) SELECT s_suppkey, sector, kind FROM k WHERE kind = 0 OR best <= {PER_SECTOR} - held ORDER BY kind, CASE WHEN kind = 2 THEN -s_acctbal ELSE 0 END, s_suppkey LIMIT {TARGET}""",
    "tier_counts": f"{_OBS}, d AS (SELECT symbol, day, count(DISTINCT source) AS sources, bool_and(grain = 'adjusted') AS adj FROM observations GROUP BY ALL) SELECT symbol, CASE WHEN adj THEN 'adjusted_only' WHEN sources > 1 THEN 'both' ELSE 'single' END AS tier, count(*) AS days, max(day) AS last_day FROM d GROUP BY ALL",
    "scale_digits": f"WITH {BARS_SQL}, t AS (SELECT symbol, regexp_replace(regexp_replace(CAST(CAST(close AS DECIMAL(18,4)) AS VARCHAR), '0+$', ''), '\\.$', '') AS plain, substr(sha256(symbol || '|' || CAST(day AS VARCHAR)), 1, 24) AS id FROM bars) SELECT symbol, count(DISTINCT id) AS ids, min(id) AS first_id, CAST(max(length(plain)) AS INT) AS longest, CAST(sum(length(plain)) AS BIGINT) AS characters FROM t GROUP BY symbol",
    "weight_maps": f"WITH {BARS_SQL}, s AS (SELECT day, symbol, round(volume / sum(volume) OVER (PARTITION BY day), 6) AS share FROM bars) SELECT day, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (share > 0.2), '') AS large, coalesce(max(share) FILTER (symbol = 'S0'), 0.0) AS s0, CAST(count(*) AS INT) AS symbols, round(sum(share * share), 6) AS concentration FROM s GROUP BY day",
}
