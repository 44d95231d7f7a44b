"""Intervals and points by sweeps: starts, ends and points in one sorted stream of a key, never a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _swept(marks: DataFrame, keys: list[str], weight: str) -> Column:
    """The sum of weights up to and with a row's place; at equal places the marks count before the questions."""
    return F.sum(weight).over(Window.partitionBy(*keys).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))


def points_within(ranges: DataFrame, points: DataFrame, keys: list[str], **bounds: tuple[Column, Column]) -> DataFrame:
    """The ranges with a column for each bound (first, last): how many points `day` of the key lie in it, ends included.

    Bounds are dates of a range's row. Each is two questions to the running count of points, so a row of ranges
    gives two rows for each bound and the work is one sort; a bound with a null or an end before its start counts 0.
    Keys must not be null, points without a day count for nothing."""
    asked = ranges.select("*", F.monotonically_increasing_id().alias("range_id"))
    ends = [F.struct(F.lit(name).alias("bound"), F.lit(sign).alias("sign"), F.when(first <= last, at).alias("at")) for name, (first, last) in bounds.items() for sign, at in ((-1, F.date_sub(first, 1)), (1, last))]
    whole = F.struct(*(F.col(c).alias(c) for c in ranges.columns)).alias("row")
    questions = asked.select(*keys, whole, "range_id", F.inline(F.array(*ends)))
    marks = points.where("day is not null").select(*keys, F.lit(None).cast(asked.select(whole).schema["row"].dataType).alias("row"), F.lit(None).cast("long").alias("range_id"), F.lit(None).cast("string").alias("bound"), F.lit(0).alias("sign"), F.col("day").alias("at"))
    stream = questions.unionByName(marks).withColumn("asks", F.col("bound").isNotNull()).withColumn("point", (~F.col("asks")).cast("int"))
    counted = stream.withColumn("so_far", _swept(stream, keys, "point")).where("asks")
    sums = [F.coalesce(F.sum(F.when(F.col("bound") == name, F.col("sign") * F.col("so_far"))), F.lit(0)).alias(name) for name in bounds]
    return counted.groupBy(*keys, "range_id").agg(F.first("row").alias("row"), *sums).select("row.*", *bounds)


def covering(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The points (keys, day, ...) with `covers`: how many ranges (first, last) of the key hold their day."""
    rest = [c for c in points.columns if c not in [*keys, "day"]]
    asked = points.select(*keys, F.col("day").alias("at"), F.lit(True).alias("asks"), F.lit(0).alias("step"), F.struct(F.lit(1).alias("_"), *rest).alias("row"))
    steps = F.inline(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.struct(F.date_add("last", 1).alias("at"), F.lit(-1).alias("step"))))
    marks = ranges.where("first <= last").select(*keys, steps).select(*keys, "at", F.lit(False).alias("asks"), "step", F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    stream = asked.unionByName(marks)
    return stream.withColumn("covers", _swept(stream, keys, "step")).where("asks").select(*keys, F.col("at").alias("day"), *(f"row.{c}" for c in rest), "covers")


def merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, last of the unions of ranges that overlap or follow each other without a day between."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("first") > F.date_add(reach, 1), F.lit(True))
    parts = ranges.where("first <= last").withColumn("new", new).withColumn("part", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, "part").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("part")


def subtracted(bounds: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, last: what is left of each key's one range when the days of all its holes go.

    Holes follow each other by their starts, the days before and behind the range are holes too, and a part is what lies
    between a hole and the furthest end so far: one sort of a key's holes, whatever their number, and nothing is gathered.
    Holes may lie outside, touch each other or hold the range. Rows are dealt to the session's number of tasks: few bytes
    when shuffled, they grow in a sort, and Spark would put all of them into one task."""
    parts = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = bounds.where("first <= last")
    before = ranges.select(*keys, F.lit(None).cast("date").alias("first"), F.date_sub("first", 1).alias("last"), F.col("last").alias("high"))
    behind = ranges.select(*keys, F.date_add("last", 1).alias("first"), F.date_add("last", 1).alias("last"), F.lit(None).cast("date").alias("high"))
    inner = holes.where("first <= last").dropna(subset=keys).select(*keys, "first", "last", F.lit(None).cast("date").alias("high"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("first"), "last")
    marks = before.unionByName(behind).unionByName(inner).repartition(parts, *keys)
    so_far = marks.withColumns({"_reach": F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_high": F.max("high").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    left = so_far.where("first IS NOT NULL AND _high IS NOT NULL").select(*keys, F.date_add("_reach", 1).alias("_first"), F.least(F.date_sub("first", 1), F.col("_high")).alias("_last"))
    return left.where("_first <= _last").select(*keys, F.col("_first").alias("first"), F.col("_last").alias("last"))
