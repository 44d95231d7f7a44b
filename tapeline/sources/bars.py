"""Daily bars derived from lineitem, two sources of them that disagree in known ways, and calendars.

Each table has its SQL twin, a CTE that the queries' oracles start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS_SQL = """priced AS (SELECT 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_quantity, l_extendedprice / l_quantity AS price FROM lineitem),
bars AS (SELECT symbol, day, first(price ORDER BY l_orderkey, l_linenumber, price) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY l_orderkey, l_linenumber, price) AS close,
  CAST(round(sum(l_quantity)) AS BIGINT) AS volume, count(*) AS n FROM priced GROUP BY symbol, day)"""

CALENDAR_SQL = """sessions AS (SELECT day FROM bars GROUP BY day HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)),
common AS (SELECT bars.* FROM bars JOIN sessions USING (day))"""

CODE_SQL = "(year(day) * 372 + month(day) * 31 + day(day)) % 11"
SOURCES_SQL = f"""coded AS (SELECT *, {CODE_SQL} AS code FROM bars),
observations AS (
  SELECT 'A' AS source, 'unadjusted' AS grain, symbol, day, open, high, low, close, volume, 'A:' || symbol || ':' || CAST(day AS VARCHAR) AS row_id FROM coded WHERE code <> 4
  UNION ALL SELECT 'B', CASE WHEN code = 6 THEN 'adjusted' ELSE 'unadjusted' END, symbol, day, open, high, low, close * CASE code WHEN 1 THEN 1.0005 WHEN 2 THEN 1.5 ELSE 1.0 END, volume * CASE WHEN code = 5 THEN 100 ELSE 1 END, 'B:' || symbol || ':' || CAST(day AS VARCHAR) FROM coded WHERE code <> 0
  UNION ALL SELECT 'B', 'unadjusted', symbol, day, open, high, low, close, volume, 'B2:' || symbol || ':' || CAST(day AS VARCHAR) FROM coded WHERE code = 3)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, supplier: str = "l_suppkey % 5") -> DataFrame:
    """symbol, day, open, high, low, close, volume, n: one aggregation over lineitem, partial before its shuffle. Suppliers
    share five symbols unless another expression of their key is given."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.expr(supplier).cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("day"),
        F.struct("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")).alias("tick"), "l_quantity",
    )
    return rows.groupBy("symbol", "day").agg(
        F.min("tick").getField("price").alias("open"), F.max("tick.price").alias("high"), F.min("tick.price").alias("low"), F.max("tick").getField("price").alias("close"),
        F.round(F.sum("l_quantity")).cast("long").alias("volume"), F.count("*").alias("n"),
    )


def sessions(series: DataFrame) -> DataFrame:
    """The days on which every symbol has a bar."""
    symbols = series.agg(F.count_distinct("symbol"))
    return series.groupBy("day").agg(F.count("*").alias("have")).where(F.col("have") == symbols.scalar()).select("day")


def common(series: DataFrame) -> DataFrame:
    """The bars of common sessions; nothing is filled forward."""
    return series.join(sessions(series), "day", "left_semi")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, grain, symbol, day, open, high, low, close, volume, row_id: bars twice, the second source with a day's
    row missing, moved slightly or by half, repeated, of another grain, or with the volume in hundredths."""
    code = (F.year("day") * 372 + F.month("day") * 31 + F.dayofmonth("day")) % 11
    base = bars(spark, sf_dir).withColumn("code", code)
    row = lambda source, prefix, grain, close, volume: F.struct(
        F.lit(source).alias("source"), grain.alias("grain"), close.alias("close"), volume.cast("long").alias("volume"), F.concat(F.lit(prefix + ":"), "symbol", F.lit(":"), F.col("day").cast("string")).alias("row_id")
    )
    plain, close, volume = F.lit("unadjusted"), F.col("close"), F.col("volume")
    moved = close * F.when(F.col("code") == 1, 1.0005).when(F.col("code") == 2, 1.5).otherwise(1.0)
    rows = F.array(
        F.when(F.col("code") != 4, row("A", "A", plain, close, volume)), F.when(F.col("code") != 0, row("B", "B", F.when(F.col("code") == 6, "adjusted").otherwise(plain), moved, volume * F.when(F.col("code") == 5, 100).otherwise(1))), F.when(F.col("code") == 3, row("B", "B2", plain, close, volume))
    )
    found = base.withColumn("x", F.explode(F.array_compact(rows)))  # one scan and one aggregation for both sources
    return found.select("x.source", "x.grain", "symbol", "day", "open", "high", "low", "x.close", "x.volume", "x.row_id")


def synthetic_bars(spark: SparkSession, symbols: list[str], start: str, end: str) -> DataFrame:
    """Deterministic weekday bars: a base from the symbol's digest, a small trend and a sine wave; no randomness."""
    names = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    days = F.explode(F.expr(f"filter(sequence(DATE'{start}', DATE'{end}'), d -> weekday(d) < 5)"))
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("day")) - 1
    base = F.lit(50) + F.conv(F.substring(F.sha2("symbol", 256), 1, 4), 16, 10).cast("long") % 450
    rows = names.withColumn("day", days).withColumn("i", i).withColumn("base", base)
    close = F.col("base") * (1 + 0.0008 * F.col("i") + 0.025 * F.sin(F.col("i") / 8))
    rows = rows.withColumn("close", F.round(close, 4)).withColumn("open", F.round(close * 0.998, 4))
    return rows.select(
        "symbol", "day", "open", F.round(F.greatest("open", "close") * 1.006, 4).alias("high"), F.round(F.least("open", "close") * 0.994, 4).alias("low"), "close", (10_000 + F.col("i") * 37 % 5_000).cast("long").alias("volume"),
    )


# The 500-bar series of 40-day cycles, its volumes, and its steady index.
CYCLE = {"start": 200.0, "steps": ((20, 1.005, 10_000), (25, 1.03, 50_000), (40, 0.99, 8_000)), "open": 0.995, "high": 1.01, "low": 0.99, "index": 6000.0, "index_step": 1.001}


def cyclic_bars(spark: SparkSession, n: int = 500) -> DataFrame:
    """A series of 40-day cycles (20 bars up 0.5 %, 5 up 3 % on high volume, 15 down 1 % on low volume)."""
    (a, up, plain), (b, leap, high), (_, down, low) = CYCLE["steps"]
    at = F.col("i") % 40
    grown = F.expr(f"aggregate(sequence(0, i), {CYCLE['start']}D, (p, k) -> p * CASE WHEN k % 40 < {a} THEN {up}D WHEN k % 40 < {b} THEN {leap}D ELSE {down}D END)")
    rows = spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("close", grown)
    volume = F.when(at < a, plain).when(at < b, high).otherwise(low).cast("long")
    return rows.select(F.lit("CYCLE").alias("symbol"), F.expr("date_add(DATE'2023-01-01', i)").alias("day"), *((F.col("close") * CYCLE[c]).alias(c) for c in ("open", "high", "low")), "close", volume.alias("volume"))


def cyclic_index(spark: SparkSession, n: int = 500) -> DataFrame:
    """day, close of the index of cyclic_bars: 0.1 % up each bar."""
    grown = F.expr(f"aggregate(sequence(0, i), {CYCLE['index']}D, (p, k) -> p * {CYCLE['index_step']}D)")
    return spark.range(n).select(F.col("id").cast("int").alias("i")).select(F.expr("date_add(DATE'2023-01-01', i)").alias("day"), grown.alias("close"))
