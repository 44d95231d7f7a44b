"""Quotes as a stream: hourly counts, exactly-once identities and staleness flags, each with a checkpoint.

The source is a folder of Parquet files. The queries here run what is there and end (availableNow); the same
functions run without end under another trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.sources.bars import table
from tapeline.sources.scratch import scratch


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table's file as a file source; event time is a timestamp."""
    rows = spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(rows: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Events in tumbling hours by type; state of hours before the watermark is dropped."""
    counted = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"))
    return counted.select(F.col("window.start").alias("hour"), "event_type", "events")


def received(rows: DataFrame) -> DataFrame:
    """Events with the moment of their receipt, up to a minute and a half after their own."""
    return rows.withColumn("received", F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") * 7 % 90).cast("decimal(18,6)")))


def flagged(rows: DataFrame, most: int = 30) -> DataFrame:
    """Each quote (event_id, ts, received) with its delay in seconds and whether it is stale: late rows are marked,
    never dropped."""
    delay = F.floor((F.unix_micros("received") - F.unix_micros("ts")) / 1_000_000)
    return rows.select("event_id", delay.alias("delay"), (delay > most).alias("stale"))


def identified(rows: DataFrame, within: str = "2 days") -> DataFrame:
    """One row for each content digest, however often it is delivered. A digest names a day, so that its repeats come
    within the watermark's time and older state is dropped."""
    digest = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")), 256)
    return rows.withWatermark("ts", within).select("ts", digest.alias("identity")).dropDuplicatesWithinWatermark(["identity"]).select("identity")


def run_now(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What the stream gives for the data that is there, through a Parquet sink with a checkpoint. With keys, the stream
    runs in update mode, keeps no finished state, and the last update of each key counts."""
    spark = rows.sparkSession
    path, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    writer = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", state)
    if not keys:
        writer.outputMode("append").format("parquet").option("path", path).start().awaitTermination()
        return spark.read.parquet(path)

    def update(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # again gives the same

    writer.outputMode("update").foreachBatch(update).start().awaitTermination()
    updates = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in keys]
    return updates.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in others))


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_now(hourly(stream(spark, sf_dir)), ["hour", "event_type"]).select(F.unix_micros("hour").alias("hour_us"), "event_type", "events")


def stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_now(flagged(received(stream(spark, sf_dir))))


def stream_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_now(identified(stream(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (stream_hourly, stream_stale, stream_identities)}
ORACLE = {
    "stream_hourly": "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS events FROM events GROUP BY ALL",
    "stream_stale": "SELECT event_id, event_id * 7 % 90 AS delay, event_id * 7 % 90 > 30 AS stale FROM events",
    "stream_identities": "SELECT DISTINCT sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, strftime(ts, '%Y-%m-%d'))) AS identity FROM events",
}
