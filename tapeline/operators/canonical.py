"""Canonical research rows as a whole: duplicates with their ids, lineage, segments, scores, roles and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.columns import codes, codes_sql, r6
from tapeline.operators.reconcile import FIELDS, fingerprint, valid
from tapeline.operators.review import _REASONS, _VALID, TOLERANCE, eligibility, mapped
from tapeline.operators.validate import _RAW, classified, raw_rows
from tapeline.sources.bars import BARS_SQL, SOURCES_SQL, observations, table

# Weights of a source's quality, which add up to 100, and points by provenance.
WEIGHTS = {
    "schema_completeness": 12,
    "duplicate_rate": 12,
    "invalid_row_rate": 12,
    "conflict_rate": 14,
    "date_coverage": 8,
    "symbol_coverage": 8,
    "adjustment_documentation": 8,
    "licensing_clarity": 8,
    "timestamp_provenance": 8,
    "reproducibility": 6,
    "cross_source_agreement": 4,
}
PROVENANCE = {"exchange_verified": 100.0, "licensed_vendor": 75.0, "provider_asserted": 40.0, "operator_attested": 25.0, "receipt_only": 10.0, "unknown": 0.0}
# Segments of conflicts in their order.
SEGMENTS = ("adjusted_versus_unadjusted_comparison", "price_scale_mismatch", "rounding_difference", "date_alignment_mismatch", "duplicate_source_conflict", "corporate_action_period", "symbol_mapping_problem", "volume_unit_mismatch", "real_unexplained_conflict")
# Scales that prices or volumes may be in, how near a ratio comes to one, and the share of ratios that must.
SCALES, NEAR, STABLE = (10, 100, 1000), 0.02, 0.95
# Rows that a primary source needs, and the most that coverage adds and faults take.
PRIMARY_ROWS, FULL_ROWS, COVERAGE, CONFLICTS, INVALID = 252, 2500, 25, 10, 20
#: What each source says of itself.
SOURCES = {"A": ("CC BY 4.0", "licensed_vendor", True), "B": ("no explicit licence", "operator_attested", False)}


def original_symbol() -> Column:
    """The symbol as its file has it: in small letters in some repeats."""
    return F.when((F.col("symbol") == "S2") & F.col("row_id").startswith("B2"), F.lower("symbol")).otherwise(F.col("symbol"))


def duplicate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several rows: their sorted ids, distinct values, the first kind of repetition that fits and what to do with
    it. The ids of a key are the result, so they stand in one row."""
    rows = observations(spark, sf_dir).withColumns({"fp": fingerprint(), "prices": F.concat_ws("|", *(F.format_number(F.col(f), 6) for f in FIELDS[:4])), "original": original_symbol()})
    n = {c: F.count_distinct(c).alias(f"n_{c}") for c in ("fp", "grain", "original", "prices", "volume")}
    groups = rows.groupBy("symbol", "day").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_list("row_id")), ",").alias("ids"), *n.values()).where("rows > 1")
    kind = (
        F.when(F.col("n_grain") > 1, "adjusted_unadjusted_duplicate").when(F.col("n_original") > 1, "multiple_instruments_malformed_symbol").when(F.col("n_fp") == 1, "duplicate_exact")
        .when((F.col("n_prices") == 1) & (F.col("n_volume") > 1), "same_price_different_volume").when(F.col("n_prices") > 1, "conflicting_ohlc").otherwise("unresolved_conflict")
    )
    treatment = F.when(F.col("n_grain") > 1, "adjusted_unadjusted_split").when(kind == "duplicate_exact", "safe_exact_deduplication").when(kind == "unresolved_conflict", "unresolved").otherwise("manual_review_required")
    return groups.select("symbol", "day", "rows", "ids", F.col("n_fp").alias("fingerprints"), kind.alias("kind"), treatment.alias("treatment"))


def category_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each category with five examples (symbol@day) at most, the first in order: a ranking that keeps five rows a
    category before it is shuffled."""
    rows = classified(raw_rows(spark, sf_dir)).where("categories <> ''").select(F.explode(F.split("categories", ",")).alias("category"), F.concat_ws("@", "symbol", "day").alias("example"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("example"))).where("k <= 5")
    shown = first.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("example")), ",").alias("examples"))
    return rows.groupBy("category").agg(F.count("*").alias("rows")).join(shown, "category")


def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's weighted score over eleven components of 0 to 100, with those that rows decide."""
    rows = observations(spark, sf_dir)
    keys = rows.groupBy("symbol", "day").agg(F.count_distinct("source").alias("sources"), F.round((F.max("close") - F.min("close")) / F.max("close"), 9).alias("spread"))
    met = rows.join(keys, ["symbol", "day"])
    shared = F.when(F.col("sources") > 1, (F.col("spread") <= TOLERANCE).cast("double"))
    all_keys = keys.agg(F.struct(F.count_distinct("day").alias("days"), F.count_distinct("symbol").alias("symbols")))
    sums = met.groupBy("source").agg(
        (1 - F.count_distinct("symbol", "day") / F.count("*")).alias("duplicates"), F.avg((~valid()).cast("double")).alias("invalid"), F.avg(((F.col("sources") > 1) & (F.col("spread") > TOLERANCE)).cast("double")).alias("conflicts"), F.count_distinct("day").alias("days"), F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("grain").alias("grains"), F.avg(shared).alias("agreement"),
    ).withColumn("all", all_keys.scalar())
    told = lambda k: F.element_at(F.create_map(*(F.lit(x) for s, v in SOURCES.items() for x in (s, v[k]))), F.col("source"))
    rate = lambda c, most: F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col(c) / most))
    share = lambda a, b: F.least(F.lit(100.0), F.col(a) / F.col(f"all.{b}") * 100)
    licence = told(0)
    parts = {
        "schema_completeness": F.lit(100.0), "duplicate_rate": rate("duplicates", 0.10), "invalid_row_rate": rate("invalid", 0.05), "conflict_rate": rate("conflicts", 0.25), "date_coverage": share("days", "days"), "symbol_coverage": share("symbols", "symbols"),
        "adjustment_documentation": F.when(F.col("grains") > 1, 75.0).otherwise(100.0), "licensing_clarity": F.when(licence.contains("CC BY"), 100.0).when(F.lower(licence).contains("no explicit"), 25.0).otherwise(50.0),
        "timestamp_provenance": F.element_at(F.create_map(*(F.lit(x) for pair in PROVENANCE.items() for x in pair)), told(1)), "reproducibility": F.when(told(2), 100.0).otherwise(0.0), "cross_source_agreement": F.coalesce(F.col("agreement") * 100, F.lit(50.0)),
    }
    score = sum((parts[c] * w for c, w in WEIGHTS.items()), F.lit(0.0)) / 100
    return sums.select("source", F.round(score, 6).alias("score"), *(F.round(parts[c], 6).alias(c) for c in ("duplicate_rate", "conflict_rate", "date_coverage", "licensing_clarity", "timestamp_provenance", "cross_source_agreement")))


def canonical_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key and grain: held if a row's mapping is under review, rejected if values differ, else accepted by what
    stands behind it; the rows that it comes from, the first one's id and close."""
    rows = mapped(spark, sf_dir).withColumn("fp", fingerprint())
    groups = rows.groupBy("symbol", "day", "grain").agg(
        F.count("*").alias("rows"), F.count_distinct("fp").alias("fps"), F.count_distinct("source").alias("sources"), F.bool_or(F.col("approval") == "under_review").alias("review"), F.min(F.struct("row_id", "close")).alias("first"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "source", F.substring("source_hash", 1, 8), "row_id"))), ",").alias("lineage"),
    )
    status = F.when(F.col("review"), "held_for_review").when(F.col("fps") != 1, "rejected_conflicting").when(F.col("sources") > 1, "accepted_candidate").when(F.col("rows") > 1, "accepted_exact_deduplicated").otherwise("accepted_single_source_low_confidence")
    taken = status.startswith("accepted")
    confidence = F.when(status == "accepted_single_source_low_confidence", "low").when(taken, "medium")
    return groups.select("symbol", "day", "grain", status.alias("status"), confidence.alias("confidence"), F.when(taken, F.col("lineage")).alias("lineage"), F.when(taken, F.col("first.row_id")).alias("row_id"), F.when(taken, F.floor(F.col("first.close") * 10_000 + 0.5) / 10_000).alias("close"))


def positional_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th row of each symbol in source A with the n-th in source B (of S0 for S4), by all nine reasons against their
    comparison: how many pairs have which reasons."""
    n = F.row_number().over(Window.partitionBy("source", "symbol").orderBy("day", "row_id"))
    rows = mapped(spark, sf_dir).withColumn("n", n)
    side = lambda source, x, key: rows.where(F.col("source") == source).select(key.alias("key"), "n", *(F.col(c).alias(f"{c}_{x}") for c in ("symbol", "day", "source", "grain", "confidence", "approval", "source_hash", "repeats")))
    met = side("A", "a", F.when(F.col("symbol") == "S4", "S0").otherwise(F.col("symbol"))).join(side("B", "b", F.col("symbol")), ["key", "n"])
    apart = codes((F.col("day_a") != F.col("day_b"), "date_not_aligned"), (F.col("symbol_a") != F.col("symbol_b"), "symbol_not_aligned"))
    reasons = F.concat_ws(",", F.nullif(apart, F.lit("")), F.nullif(eligibility(), F.lit("")))
    return met.groupBy(F.col("symbol_a").alias("symbol"), reasons.alias("reasons")).agg(F.count("*").alias("pairs"))


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine segments with the pairs of a day's rows that they explain, none left out: the first that fits a pair outside
    the tolerance of prices (a thousandth) or volume counts. On the 13th of a month S1's second source is in hundredths."""
    scaled = (F.col("symbol") == "S1") & (F.col("source") == "B") & (F.dayofmonth("day") == 13)
    prices = ("open", "high", "low", "close")
    rows = mapped(spark, sf_dir).withColumns({c: F.col(c) * F.when(scaled, 100.0).otherwise(1.0) for c in prices})
    first = rows.where("source = 'A'").withColumn("was", F.lag("close").over(Window.partitionBy("symbol").orderBy("day")))
    actions = first.where(F.round(F.abs(F.col("close") / F.col("was") - 1), 9) >= 0.5).select("symbol", "day", F.lit(True).alias("action"))
    names = ("row_id", "source", "grain", "approval", "volume", *prices)
    a, b = (rows.select("symbol", "day", *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "ab")
    met = a.join(b, ["symbol", "day"]).where("row_id_a < row_id_b").join(actions, ["symbol", "day"], "left")
    ratio = lambda c: F.greatest(f"{c}_a", f"{c}_b") / F.nullif(F.least(f"{c}_a", f"{c}_b"), F.lit(0))
    near_scale = lambda c: F.greatest(*(F.round(F.abs(ratio(c) - k) / k, 9) <= NEAR for k in SCALES))
    price = F.greatest(*(F.round(1 - 1 / ratio(c), 9) > TOLERANCE for c in prices))
    volume = F.coalesce(F.round(ratio("volume") - 1, 9) > TOLERANCE, F.lit(False))
    segment = (
        F.when(F.col("grain_a") != F.col("grain_b"), SEGMENTS[0]).when((F.col("approval_a") == "under_review") & (F.col("approval_b") == "under_review"), SEGMENTS[6]).when(F.col("source_a") == F.col("source_b"), SEGMENTS[4]).when(F.least(*map(near_scale, prices)), SEGMENTS[1])
        .when(~price & volume & (ratio("volume") >= 10), SEGMENTS[7]).when(~price & volume, SEGMENTS[2]).when(F.coalesce("action", F.lit(False)), SEGMENTS[5]).otherwise(SEGMENTS[8])
    )
    counts = met.where(price | volume).groupBy(segment.alias("segment")).agg(F.count("*").alias("pairs"), F.count_distinct("symbol").alias("symbols"))
    every = spark.createDataFrame([(s, k) for k, s in enumerate(SEGMENTS, 1)], "segment string, place int")
    return every.join(counts, "segment", "left").na.fill(0, ["pairs", "symbols"])


def volume_unit_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a symbol's volumes in source B are in other units where they are larger than A's: the nearest scale of the
    median ratio, the share of ratios within 2 % of it, extremes, and the factor if 95 % are. S4's odd days are 1.3 times
    as large."""
    of = lambda s: F.min(F.when(F.col("source") == s, F.col("volume")))
    rows = observations(spark, sf_dir).groupBy("symbol", "day").agg(of("A").alias("a"), of("B").alias("b")).where("a > 0 AND b > a")
    wild = (F.col("symbol") == "S4") & (F.dayofmonth("day") % 2 == 1)
    ratios = rows.select("symbol", (F.col("b") / F.col("a") * F.when(wild, 1.3).otherwise(1.0)).alias("ratio"))
    middle = ratios.groupBy("symbol").agg(F.median("ratio").alias("median_ratio"))
    scale = F.array_min(F.array(*(F.struct((F.abs(F.col("median_ratio") - k) / F.greatest("median_ratio", F.lit(float(k)))).alias("off"), F.lit(k).alias("scale")) for k in SCALES)))
    off = lambda c: F.round(F.abs(F.col(c) - F.col("scale")) / F.greatest(F.col(c), F.col("scale").cast("double")), 9)
    met = ratios.join(middle.withColumn("scale", scale["scale"]), "symbol")
    sums = met.groupBy("symbol", "median_ratio", "scale").agg(F.count("*").alias("days"), F.avg((off("ratio") <= NEAR).cast("double")).alias("stable"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))
    good = (F.col("stable") >= STABLE) & (off("median_ratio") <= NEAR)
    return sums.select("symbol", "days", *(r6(c).alias(c) for c in ("median_ratio", "least", "most", "stable")), F.when(good, F.col("scale")).alias("factor"), F.when(good, "medium").otherwise("low").alias("confidence"))


def source_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of each symbol's sources and grains by score (quality of 80 for A and 60 for B, coverage, less conflicts and
    invalid rows): the best of a grain with a year of rows is its primary source, the next two stand by; the last with
    an invalid row is rejected, the first with a conflict unresolved. A role without a source has none."""
    keys = observations(spark, sf_dir).withColumn("spread", F.round((F.max("close").over(_day()) - F.min("close").over(_day())) / F.max("close").over(_day()), 9))
    sums = keys.groupBy("symbol", "source", "grain").agg(F.count("*").alias("rows"), F.count_if(~valid()).alias("invalid"), F.count_if(F.col("spread") > TOLERANCE).alias("conflicts"))
    part = lambda c, most: F.least(F.col(c) / F.col("rows"), F.lit(1.0)) * most
    score = F.round(F.when(F.col("source") == "A", 80.0).otherwise(60.0) + F.least(F.col("rows") / FULL_ROWS, F.lit(1.0)) * COVERAGE - part("conflicts", CONFLICTS) - part("invalid", INVALID), 4)
    own = Window.partitionBy("symbol")
    ranked = sums.withColumn("score", score).withColumn("place", F.row_number().over(own.orderBy(F.desc("score"), "invalid", "conflicts", "source", "grain")))
    first = lambda c: F.min(F.when(c, F.col("place"))).over(own)
    year = F.col("rows") >= PRIMARY_ROWS
    marked = ranked.withColumns({"adjusted": first((F.col("grain") == "adjusted") & year), "unadjusted": first((F.col("grain") == "unadjusted") & year)})
    left = ~F.coalesce(F.col("place") == F.col("adjusted"), F.lit(False)) & ~F.coalesce(F.col("place") == F.col("unadjusted"), F.lit(False))
    marked = marked.withColumn("rest", F.when(left, F.sum(F.when(left, 1).otherwise(0)).over(own.orderBy("place"))))
    rejected = F.max(F.when(F.col("invalid") > 0, F.col("place"))).over(own)
    marked = marked.withColumns({"rejected": rejected, "unresolved": first(F.col("conflicts") > 0)})
    is_ = lambda c: F.col("place") == F.col(c)
    roles = {"primary_adjusted_source": is_("adjusted"), "primary_unadjusted_source": is_("unadjusted"), "secondary_validation_source": F.col("rest") == 1, "fallback_source": F.col("rest") == 2, "rejected_source": is_("rejected"), "unresolved_source": is_("unresolved")}
    name = F.concat_ws("/", "source", "grain")
    wide = marked.groupBy("symbol").agg(*(F.max(F.when(c, name)).alias(role) for role, c in roles.items()))
    return wide.unpivot("symbol", list(roles), "role", "source")


def _day():
    return Window.partitionBy("symbol", "day")


def statement_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a statement of its customer's quantities against the latest earlier one that is not reversed (status P):
    by statement and symbol the previous and the current quantity where they differ, 0 for a symbol that one lacks. Both
    sides are summed in one stream, which is the full outer join."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    kept = F.when(F.col("o_orderstatus") != "P", F.struct("day", "o_orderkey"))
    was = F.max(kept).over(Window.partitionBy("o_custkey").orderBy("day").rangeBetween(Window.unboundedPreceding, -1))
    known = order.withColumn("was", was).where("was IS NOT NULL").select("o_orderkey", F.col("was.o_orderkey").alias("before"))
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("P"), (F.col("l_partkey") % 20).cast("string")).alias("symbol")).agg(F.sum("l_quantity").alias("quantity"))
    zero = F.lit(0.0)
    now = held.join(known, held["l_orderkey"] == known["o_orderkey"]).select("o_orderkey", "symbol", F.col("quantity").alias("current"), zero.alias("previous"))
    old = held.join(known, held["l_orderkey"] == known["before"]).select("o_orderkey", "symbol", zero.alias("current"), F.col("quantity").alias("previous"))
    sums = now.unionByName(old).groupBy("o_orderkey", "symbol").agg(F.sum("previous").alias("previous"), F.sum("current").alias("current"))
    return sums.where("previous <> current").withColumn("difference", F.col("current") - F.col("previous"))


QUERIES = {f.__name__: f for f in (duplicate_table, category_examples, source_scores, canonical_lineage, positional_eligibility, segment_table, volume_unit_decision, source_roles, statement_changes)}

_OBS = f"WITH {BARS_SQL}, {SOURCES_SQL}"
_MAP = f"""{_OBS}, m AS (SELECT *, CASE WHEN symbol = 'S4' AND source = 'B' THEN 'low' ELSE 'high' END AS confidence, CASE WHEN symbol = 'S3' THEN 'under_review' WHEN symbol = 'S2' AND source = 'A' THEN 'rejected' ELSE 'approved' END AS approval, count(*) OVER (PARTITION BY source, symbol, day, grain) > 1 AS repeats FROM observations)"""
_FP = "CAST(round(open, 6) AS VARCHAR) || '|' || round(high, 6) || '|' || round(low, 6) || '|' || round(close, 6)"
_R = lambda c: f"greatest({c}_a, {c}_b) / nullif(least({c}_a, {c}_b), 0)"
_SCALED = lambda c: "(" + " OR ".join(f"round(abs({_R(c)} - {k}) / {k}, 9) <= {NEAR}" for k in SCALES) + ")"
_PRICES = ("open", "high", "low", "close")
_OFF = lambda x: f"round(abs({x} - scale) / greatest({x}, scale::DOUBLE), 9)"
_SCORE_PARTS = {
    "schema_completeness": "100.0::DOUBLE", "duplicate_rate": "greatest(0.0::DOUBLE, 100.0::DOUBLE * (1 - duplicates / 0.10::DOUBLE))", "invalid_row_rate": "greatest(0.0::DOUBLE, 100.0::DOUBLE * (1 - invalid / 0.05::DOUBLE))", "conflict_rate": "greatest(0.0::DOUBLE, 100.0::DOUBLE * (1 - conflicts / 0.25::DOUBLE))",
    "date_coverage": "days / all_days * 100.0::DOUBLE", "symbol_coverage": "symbols / all_symbols * 100.0::DOUBLE", "adjustment_documentation": "CASE WHEN grains > 1 THEN 75.0::DOUBLE ELSE 100.0::DOUBLE END", "licensing_clarity": "CASE source WHEN 'A' THEN 100.0::DOUBLE ELSE 25.0::DOUBLE END",
    "timestamp_provenance": "CASE source WHEN 'A' THEN 75.0::DOUBLE ELSE 25.0::DOUBLE END", "reproducibility": "CASE source WHEN 'A' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END", "cross_source_agreement": "coalesce(agreement * 100, 50.0::DOUBLE)",
}
_NINE = codes_sql(("day_a <> day_b", "date_not_aligned"), ("symbol_a <> symbol_b", "symbol_not_aligned"))
_ROLES = {"primary_adjusted_source": "place = adjusted", "primary_unadjusted_source": "place = unadjusted", "secondary_validation_source": "rest = 1", "fallback_source": "rest = 2", "rejected_source": "place = rejected", "unresolved_source": "place = unresolved"}
ORACLE = {
    "duplicate_table": f"""{_OBS}, r AS (SELECT *, CASE WHEN symbol = 'S2' AND row_id LIKE 'B2%' THEN lower(symbol) ELSE symbol END AS original, {_FP} AS prices FROM observations),
      g AS (SELECT symbol, day, count(*) AS rows, string_agg(row_id, ',' ORDER BY row_id) AS ids, count(DISTINCT prices || '|' || volume) AS fingerprints, count(DISTINCT grain) AS gs, count(DISTINCT original) AS os, count(DISTINCT prices) AS ps, count(DISTINCT volume) AS vs FROM r GROUP BY ALL HAVING count(*) > 1),
      k AS (SELECT *, CASE WHEN gs > 1 THEN 'adjusted_unadjusted_duplicate' WHEN os > 1 THEN 'multiple_instruments_malformed_symbol' WHEN fingerprints = 1 THEN 'duplicate_exact' WHEN ps = 1 AND vs > 1 THEN 'same_price_different_volume' WHEN ps > 1 THEN 'conflicting_ohlc' ELSE 'unresolved_conflict' END AS kind FROM g)
      SELECT symbol, day, rows, ids, fingerprints, kind, CASE WHEN gs > 1 THEN 'adjusted_unadjusted_split' WHEN kind = 'duplicate_exact' THEN 'safe_exact_deduplication' WHEN kind = 'unresolved_conflict' THEN 'unresolved' ELSE 'manual_review_required' END AS treatment FROM k""",
    "category_examples": f"""{_RAW}, e AS (SELECT unnest(string_split(categories, ',')) AS category, symbol || '@' || day AS example FROM c WHERE categories <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY example) AS k FROM e)
      SELECT category, count(*) AS rows, string_agg(example, ',' ORDER BY example) FILTER (k <= 5) AS examples FROM r GROUP BY category""",
    "source_scores": f"""{_OBS}, k AS (SELECT symbol, day, count(DISTINCT source) AS sources, round((max(close) - min(close)) / max(close), 9) AS spread FROM observations GROUP BY ALL), t AS (SELECT count(DISTINCT day) AS all_days, count(DISTINCT symbol) AS all_symbols FROM k),
      s AS (SELECT source, 1 - count(DISTINCT (symbol, day)) / count(*) AS duplicates, avg(CAST(NOT ({_VALID}) AS INT)) AS invalid, avg(CAST(sources > 1 AND spread > {TOLERANCE} AS INT)) AS conflicts, count(DISTINCT day) AS days, count(DISTINCT symbol) AS symbols, count(DISTINCT grain) AS grains, avg(CASE WHEN sources > 1 THEN CAST(spread <= {TOLERANCE} AS INT) END) AS agreement FROM observations JOIN k USING (symbol, day) GROUP BY source)
      SELECT source, round(({" + ".join(f"{_SCORE_PARTS[c]} * {w}" for c, w in WEIGHTS.items())}) / 100, 6) AS score, {", ".join(f"round({_SCORE_PARTS[c]}, 6) AS {c}" for c in ("duplicate_rate", "conflict_rate", "date_coverage", "licensing_clarity", "timestamp_provenance", "cross_source_agreement"))} FROM s, t""",
    "canonical_lineage": f"""{_MAP}, g AS (SELECT symbol, day, grain, count(*) AS rows, count(DISTINCT {_FP} || '|' || volume) AS fps, count(DISTINCT source) AS sources, bool_or(approval = 'under_review') AS review, min(row_id) AS row_id, first(close ORDER BY row_id) AS close, string_agg(source || '/' || substr(sha256(source), 1, 8) || '/' || row_id, ',' ORDER BY source || '/' || substr(sha256(source), 1, 8) || '/' || row_id) AS lineage FROM m GROUP BY ALL),
      k AS (SELECT *, CASE WHEN review THEN 'held_for_review' WHEN fps <> 1 THEN 'rejected_conflicting' WHEN sources > 1 THEN 'accepted_candidate' WHEN rows > 1 THEN 'accepted_exact_deduplicated' ELSE 'accepted_single_source_low_confidence' END AS status FROM g)
      SELECT symbol, day, grain, status, CASE WHEN status LIKE '%low_confidence' THEN 'low' WHEN status LIKE 'accepted%' THEN 'medium' END AS confidence, CASE WHEN status LIKE 'accepted%' THEN lineage END AS lineage, CASE WHEN status LIKE 'accepted%' THEN row_id END AS row_id, CASE WHEN status LIKE 'accepted%' THEN floor(close * 10000 + 0.5) / 10000 END AS close FROM k""",
    "positional_eligibility": f"""{_MAP}, n AS (SELECT *, row_number() OVER (PARTITION BY source, symbol ORDER BY day, row_id) AS n FROM m), p AS (SELECT {", ".join(f"{x}.{c} AS {c}_{x}" for c in ("symbol", "day", "source", "grain", "confidence", "approval", "repeats") for x in "ab")} FROM n a JOIN n b ON a.source = 'A' AND b.source = 'B' AND a.n = b.n AND b.symbol = CASE a.symbol WHEN 'S4' THEN 'S0' ELSE a.symbol END)
      SELECT symbol_a AS symbol, concat_ws(',', nullif({_NINE}, ''), nullif({_REASONS}, '')) AS reasons, count(*) AS pairs FROM p GROUP BY ALL""",
    "segment_table": f"""{_MAP}, s AS (SELECT symbol, day, row_id, source, grain, approval, volume, {", ".join(f"{c} * CASE WHEN symbol = 'S1' AND source = 'B' AND day(day) = 13 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS {c}" for c in _PRICES)} FROM m),
      act AS (SELECT symbol, day, true AS action FROM (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS move FROM s WHERE source = 'A') WHERE round(abs(move), 9) >= 0.5),
      p AS (SELECT a.symbol, a.day, {", ".join(f"{x}.{c} AS {c}_{x}" for c in ("source", "grain", "approval", "volume", *_PRICES) for x in "ab")} FROM s a JOIN s b ON a.symbol = b.symbol AND a.day = b.day AND a.row_id < b.row_id),
      k AS (SELECT p.*, action, ({" OR ".join(f"round(1 - 1 / ({_R(c)}), 9) > {TOLERANCE}" for c in _PRICES)}) AS price, coalesce(round({_R("volume")} - 1, 9) > {TOLERANCE}, false) AS vol FROM p LEFT JOIN act USING (symbol, day)),
      g AS (SELECT symbol, CASE WHEN grain_a <> grain_b THEN '{SEGMENTS[0]}' WHEN approval_a = 'under_review' AND approval_b = 'under_review' THEN '{SEGMENTS[6]}' WHEN source_a = source_b THEN '{SEGMENTS[4]}' WHEN {" AND ".join(map(_SCALED, _PRICES))} THEN '{SEGMENTS[1]}'
        WHEN NOT price AND vol AND {_R("volume")} >= 10 THEN '{SEGMENTS[7]}' WHEN NOT price AND vol THEN '{SEGMENTS[2]}' WHEN coalesce(action, false) THEN '{SEGMENTS[5]}' ELSE '{SEGMENTS[8]}' END AS segment FROM k WHERE price OR vol)
      SELECT e.segment, CAST(e.place AS INT) AS place, count(g.symbol) AS pairs, count(DISTINCT g.symbol) AS symbols FROM (SELECT unnest({list(SEGMENTS)}) AS segment, generate_subscripts({list(SEGMENTS)}, 1) AS place) e LEFT JOIN g USING (segment) GROUP BY ALL""",
    "volume_unit_decision": f"""{_OBS}, d AS (SELECT symbol, day, min(volume) FILTER (source = 'A') AS a, min(volume) FILTER (source = 'B') AS b FROM observations GROUP BY ALL), r AS (SELECT symbol, b / a * CASE WHEN symbol = 'S4' AND day(day) % 2 = 1 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS ratio FROM d WHERE a > 0 AND b > a), m AS (SELECT symbol, median(ratio) AS median_ratio FROM r GROUP BY symbol),
      k AS (SELECT *, list_sort([{", ".join(f"{{'off': abs(median_ratio - {x}) / greatest(median_ratio, {x}::DOUBLE), 'scale': {x}}}" for x in SCALES)}])[1].scale AS scale FROM m), s AS (SELECT symbol, median_ratio, scale, count(*) AS days, avg(CAST({_OFF("ratio")} <= {NEAR} AS INT)) AS stable, min(ratio) AS least, max(ratio) AS most FROM r JOIN k USING (symbol) GROUP BY ALL),
      g AS (SELECT *, stable >= {STABLE} AND {_OFF("median_ratio")} <= {NEAR} AS good FROM s) SELECT symbol, days, round(median_ratio, 6) AS median_ratio, round(least, 6) AS least, round(most, 6) AS most, round(stable, 6) AS stable, CASE WHEN good THEN scale END AS factor, CASE WHEN good THEN 'medium' ELSE 'low' END AS confidence FROM g""",
    "source_roles": f"""{_OBS}, k AS (SELECT *, round((max(close) OVER w - min(close) OVER w) / max(close) OVER w, 9) AS spread FROM observations WINDOW w AS (PARTITION BY symbol, day)), s AS (SELECT symbol, source, grain, count(*) AS rows, count(*) FILTER (NOT ({_VALID})) AS invalid, count(*) FILTER (spread > {TOLERANCE}) AS conflicts FROM k GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(CASE source WHEN 'A' THEN 80.0::DOUBLE ELSE 60.0::DOUBLE END + least(rows / {FULL_ROWS}, 1.0) * {COVERAGE} - least(conflicts / rows, 1.0) * {CONFLICTS} - least(invalid / rows, 1.0) * {INVALID}, 4) DESC, invalid, conflicts, source, grain) AS place FROM s),
      a AS (SELECT *, min(place) FILTER (grain = 'adjusted' AND rows >= {PRIMARY_ROWS}) OVER w AS adjusted, min(place) FILTER (grain = 'unadjusted' AND rows >= {PRIMARY_ROWS}) OVER w AS unadjusted, max(place) FILTER (invalid > 0) OVER w AS rejected, min(place) FILTER (conflicts > 0) OVER w AS unresolved FROM r WINDOW w AS (PARTITION BY symbol)),
      b AS (SELECT *, CASE WHEN left_ THEN sum(CAST(left_ AS INT)) OVER (PARTITION BY symbol ORDER BY place) END AS rest FROM (SELECT *, NOT coalesce(place = adjusted, false) AND NOT coalesce(place = unadjusted, false) AS left_ FROM a))
      {" UNION ALL ".join(f"SELECT symbol, '{role}' AS role, max(source || '/' || grain) FILTER ({c}) AS source FROM b GROUP BY symbol" for role, c in _ROLES.items())}""",
    "statement_changes": """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders), k AS (SELECT o_custkey, day, max(o_orderkey) AS before FROM o WHERE o_orderstatus <> 'P' GROUP BY ALL),
      s AS (SELECT o.o_orderkey, k.before FROM o ASOF JOIN k ON o.o_custkey = k.o_custkey AND o.day > k.day), h AS (SELECT l_orderkey, 'P' || (l_partkey % 20) AS symbol, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
      a AS (SELECT s.o_orderkey, h.symbol, h.quantity FROM s JOIN h ON h.l_orderkey = s.o_orderkey), b AS (SELECT s.o_orderkey, h.symbol, h.quantity FROM s JOIN h ON h.l_orderkey = s.before)
      SELECT o_orderkey, symbol, coalesce(b.quantity, 0.0::DOUBLE) AS previous, coalesce(a.quantity, 0.0::DOUBLE) AS current, coalesce(a.quantity, 0.0::DOUBLE) - coalesce(b.quantity, 0.0::DOUBLE) AS difference FROM a FULL JOIN b USING (o_orderkey, symbol) WHERE coalesce(a.quantity, 0) <> coalesce(b.quantity, 0)""",
}
