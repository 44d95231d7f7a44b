"""An outbox: events reach every consumer at least once, and each effect counts once.

Events come as a stream into rounds of delivery. An attempt at an event runs all consumers; if one fails none of the
attempt's effects stay, and the event is due again 2^(n - 1) seconds after its n-th attempt, until it has had the most
attempts and is a dead letter. An effect's key names event, consumer and version, and effects are kept by key, so
that a batch that is delivered again, after a lost executor or a restart, adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.sources.scratch import scratch, written
from tapeline.streaming.quotes import stream

MOST_ATTEMPTS = 4
#: A consumer: its name, the effect of an event, and whether it fails at an attempt (a column `attempt` is there).
Consumer = tuple[str, Column, Column]
_STATE = "event_id long, kind string, value double, version int, state string, attempts int, due double"


class Outbox:
    """Events and effects as tables of rounds below a path; a round is written once for each number."""

    def __init__(self, spark: SparkSession, path: str, consumers: list[Consumer], most: int = MOST_ATTEMPTS) -> None:
        self.spark, self.path, self.consumers, self.most = spark, path, consumers, most

    def events(self) -> DataFrame:
        """Every event's last state: pending, retry, delivered or dead_letter, its attempts, and when it is due."""
        rounds = self.spark.read.schema(f"{_STATE}, round long").option("basePath", f"{self.path}/events").parquet(f"{self.path}/events")
        columns = [x.split()[0] for x in _STATE.split(", ")]
        return rounds.groupBy("event_id").agg(F.max_by(F.struct(*columns[1:]), "round").alias("x")).select("event_id", "x.*")

    def effects(self) -> DataFrame:
        """effect_key, event_id, consumer, effect: one row for each key, whichever round made it."""
        rounds = self.spark.read.parquet(f"{self.path}/effects")
        return rounds.groupBy("effect_key").agg(F.min(F.struct("event_id", "consumer", "effect")).alias("x")).select("effect_key", "x.*")

    def take(self, batch: DataFrame, number: int) -> None:
        """A batch of the stream, for foreachBatch: new events (event_id, kind, value, version) and their first attempt."""
        fresh = batch.select("event_id", "kind", "value", "version", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(0.0).alias("due"))
        self._attempt(fresh.dropDuplicates(["event_id"]), number)

    def _attempt(self, due: DataFrame, number: int) -> None:
        tried = due.withColumn("attempt", F.col("attempts") + 1)
        failed = F.lit(False)
        for _, _, fails in self.consumers:
            failed = failed | F.coalesce(fails, F.lit(False))
        tried = written(tried.withColumn("failed", failed), "attempt")
        over = F.col("attempt") >= self.most
        state = F.when(~F.col("failed"), "delivered").when(over, "dead_letter").otherwise("retry")
        wait = F.when(F.col("failed") & ~over, F.pow(F.lit(2.0), F.col("attempt") - 1)).otherwise(0.0)
        after = tried.select("event_id", "kind", "value", "version", state.alias("state"), F.col("attempt").alias("attempts"), (F.col("due") + wait).alias("due"))
        made = F.array(*(F.struct(F.lit(name).alias("consumer"), effect.cast("string").alias("effect")) for name, effect, _ in self.consumers))
        done = tried.where("NOT failed").select("event_id", "version", F.inline(made))
        done = done.withColumn("effect_key", F.concat_ws(":", "event_id", "consumer", F.concat(F.lit("v"), "version")))
        done.write.mode("overwrite").parquet(f"{self.path}/effects/round={number}")
        after.write.mode("overwrite").parquet(f"{self.path}/events/round={number}")

    def drain(self, number: int) -> int:
        """Further rounds until no event waits for a retry; returns the next free number. There are no more of them than
        attempts, as each round tries all events that are left."""
        while True:
            waiting = written(self.events().where("state = 'retry'"), "waiting")
            if waiting.isEmpty():
                return number
            self._attempt(waiting, number)
            number += 1

    def replay(self, events: DataFrame, number: int) -> None:
        """Delivers events again from their first attempt, whatever their state; effects that are there stay one."""
        again = self.events().join(events.select("event_id"), "event_id", "left_semi")
        self._attempt(written(again.withColumns({"attempts": F.lit(0), "due": F.lit(0.0)}), "again"), number)


def delivered(rows: DataFrame, path: str, checkpoint: str, consumers: list[Consumer], most: int = MOST_ATTEMPTS, watch: Callable[[int], None] | None = None) -> Outbox:
    """The outbox of a stream of events, all of it delivered; `watch` is called after each batch of the stream."""
    box, last = Outbox(rows.sparkSession, path, consumers, most), [0]

    def batch(frame: DataFrame, number: int) -> None:
        box.take(frame, number)
        last[0] = max(last[0], number)
        if watch:
            watch(number)

    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start().awaitTermination()
    box.drain(last[0] + 1)
    return box


def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users delivered to a ledger and to an alarm. The alarm fails at an event's first attempts, as many as its
    number leaves of 13, less 8; of each event its state, attempts, delay and effects, after dead letters were replayed once."""
    rows = stream(spark, sf_dir).select("event_id", F.col("event_type").alias("kind"), "value", F.lit(1).alias("version"))
    alarm = F.col("attempt") <= F.col("event_id") % 13 - 8
    consumers = [("ledger", F.round("value", 2), F.lit(False)), ("alarm", F.upper("kind"), alarm)]
    box = delivered(rows, scratch(spark, "outbox"), scratch(spark, "outbox-state"), consumers, most=3)
    box.replay(box.events().where("state = 'delivered' AND event_id % 2 = 0"), 1_000)
    effects = box.effects().groupBy("event_id").agg(F.count("*").alias("effects"), F.max(F.when(F.col("consumer") == "alarm", F.col("effect"))).alias("alarm"))
    return box.events().join(effects, "event_id", "left").select("event_id", "state", "attempts", "due", F.coalesce("effects", F.lit(0)).cast("long").alias("effects"), "alarm")


QUERIES = {"stream_outbox": stream_outbox}
_FAILS = "greatest(0, event_id % 13 - 8)"
ORACLE = {
    "stream_outbox": f"""WITH e AS (SELECT event_id, event_type, {_FAILS} AS fails, event_id % 2 = 0 AND {_FAILS} < 3 AS again FROM events)
      SELECT event_id, CASE WHEN fails >= 3 THEN 'dead_letter' WHEN again AND fails > 0 THEN 'retry' ELSE 'delivered' END AS state, CAST(CASE WHEN again THEN 1 ELSE least(fails + 1, 3) END AS INT) AS attempts,
        CAST(CASE WHEN again THEN least(fails, 1) ELSE pow(2, least(fails, 2)) - 1 END AS DOUBLE) AS due, CASE WHEN fails >= 3 THEN 0 ELSE 2 END AS effects, CASE WHEN fails < 3 THEN upper(event_type) END AS alarm FROM e""",
}
