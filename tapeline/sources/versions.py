"""A table of versions in the shared folder: upsert by key within scopes, activation by run, and rollback.

Each upsert writes whole new versions of the scopes that it touches, below `run=.../scope=...`, and then one line of a
log; a reader takes each scope's version from the last run in the log that touched it and was not rolled back. What a
failed run left behind is in no line of the log, so that readers see a run whole or not at all; a run that is
repeated overwrites its own partitions alone and a second line of the log is the same as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.sources.bars import BARS_SQL, bars
from tapeline.sources.scratch import scratch, written

_LOG = "number long, run string, action string, scope string"


class Versions:
    """Rows with the columns of `schema`, `scope` (a string column) and `keys` among them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, scope: str, keys: list[str]) -> None:
        self.spark, self.path, self.schema, self.scope, self.keys = spark, path, schema, scope, keys

    def log(self) -> DataFrame:
        """number, run, action, scope in the order of `number`; empty before the first run."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except Exception as failure:  # a table without a run has no folder
            if "PATH_NOT_FOUND" not in str(failure):
                raise
            return self.spark.createDataFrame([], _LOG)

    def _next(self) -> int:
        return (self.log().agg(F.max("number")).first()[0] or 0) + 1

    def active(self) -> DataFrame:
        """scope, run: the version of each scope that readers see."""
        gone = self.log().where("action = 'rolled_back'").select("run").distinct()
        kept = self.log().where("action = 'activated'").join(gone, "run", "left_anti")
        return kept.groupBy("scope").agg(F.max_by("run", "number").alias("run"))

    def _read(self, versions: DataFrame) -> DataFrame:
        names = self.spark.createDataFrame([], self.schema).columns
        if self.log().isEmpty():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, run string, part string").option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return rows.join(versions.select("run", F.col("scope").alias("part")), ["run", "part"], "left_semi").select(names)

    def read(self) -> DataFrame:
        return self._read(self.active())

    def upsert(self, run: str, rows: DataFrame) -> None:
        """Adds rows or replaces those of equal keys, in the scopes that they name; other scopes are not read. Of rows of
        one key within a run the greatest counts. A run that is active already, or was rolled back, changes nothing."""
        if not self.log().where(F.col("run") == run).isEmpty():
            return
        struct = F.struct(*(c for c in rows.columns if c not in self.keys))
        new = rows.groupBy(*self.keys).agg(F.max(struct).alias("x")).select(*self.keys, "x.*").select(rows.columns)
        new = written(new.withColumn("part", F.col(self.scope)), "upsert")
        touched = new.select("part").distinct()
        before = self._read(self.active().join(touched.select(F.col("part").alias("scope")), "scope", "left_semi"))
        kept = before.join(new.select(self.keys), self.keys, "left_anti").withColumn("part", F.col(self.scope))
        whole = kept.select(new.columns).unionByName(new).withColumn("run", F.lit(run))
        whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "part").parquet(f"{self.path}/rows")
        self._append(run, "activated", touched.select(F.col("part").alias("scope")))

    def roll_back(self, run: str) -> None:
        """Takes the run out of what readers see: its scopes go back to the run before. An unknown run is an error, a
        second rollback too."""
        actions = {r["action"] for r in self.log().where(F.col("run") == run).select("action").distinct().collect()}
        if actions != {"activated"}:
            raise ValueError(f"{run} is not active")
        self._append(run, "rolled_back", self.spark.createDataFrame([(None,)], "scope string"))

    def _append(self, run: str, action: str, scopes: DataFrame) -> None:
        line = scopes.select(F.lit(self._next()).cast("long").alias("number"), F.lit(run).alias("run"), F.lit(action).alias("action"), "scope")
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/log")


def dataset_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of bars sees, by symbol and year, after four runs: all bars; those of odd days again with their
    close raised; the bars of 1999 with a close of 0, rolled back; and those of S1 in 2000 with a volume of 1."""
    series = written(bars(spark, sf_dir).select("symbol", "day", "close", "volume", F.concat_ws("-", "symbol", F.year("day").cast("string")).alias("scope")), "activation-bars")
    table = Versions(spark, scratch(spark, "activation"), "symbol string, day date, close double, volume long, scope string", "scope", ["scope", "symbol", "day"])
    table.upsert("first", series)
    table.upsert("raised", series.where("day(day) % 2 = 1 AND year(day) < 1998").withColumn("close", F.col("close") + 1))
    table.upsert("zero", series.where("year(day) = 1999").withColumn("close", F.lit(0.0)))
    table.upsert("raised", series.withColumn("close", F.lit(-1.0)))  # an active run changes nothing
    table.roll_back("zero")
    table.upsert("one", series.where("scope = 'S1-2000'").withColumn("volume", F.lit(1).cast("long")))
    return table.read().groupBy("scope").agg(F.count("*").alias("rows"), F.round(F.sum("close"), 4).alias("close"), F.sum("volume").alias("volume"), F.max("day").alias("last_day"))


def quality_reports(rows: DataFrame) -> DataFrame:
    """scope, period, passed, json, csv, svg, integrity_hash of observations (scope, period, passed, covered, stale): a
    report of each scope and period as canonical JSON with its SHA-256, as CSV, and as a chart of bars."""
    sums = rows.groupBy("scope", "period").agg(F.count("*").alias("observations"), F.count_if("passed").alias("passing"), F.round(100 * F.avg("covered"), 1).alias("coverage"), F.count_if("stale").alias("stale_intervals"))
    passed = (F.col("observations") > 0) & (F.col("passing") == F.col("observations"))
    metrics = sorted(["observations", "passing", "coverage", "stale_intervals"])
    values = [F.format_string("%.1f", F.col("coverage")) if c == "coverage" else F.col(c).cast("string") for c in metrics]
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{c}":'), v) for c, v in zip(metrics, values, strict=True)))
    json = F.concat(F.lit('{"metrics":{'), body, F.lit('},"passed":'), passed.cast("string"), F.lit(',"period":"'), "period", F.lit('","scope":"'), "scope", F.lit('"}'))
    csv = F.concat(F.lit("metric,value"), *(F.concat(F.lit(f"\n{c},"), v) for c, v in zip(metrics, values, strict=True)))
    bar = lambda y, v: F.concat(F.lit(f'<rect x="90" y="{y}" height="20" width="'), F.format_string("%.1f", F.round(F.greatest(v, F.lit(0.0)) * 2, 1)), F.lit('"/>'))
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="360" height="140">'), bar(20, F.col("coverage")), bar(55, 100.0 * F.col("passing") / F.col("observations")), F.lit("</svg>"))
    return sums.select("scope", "period", passed.alias("passed"), json.alias("json"), csv.alias("csv"), svg.alias("svg"), F.sha2(json, 256).alias("integrity_hash"))


def report_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports that a reader sees after all of them were made twice, the second time for the last two years and with
    days of fewer than three prices as stale ones; a report is one of its scope and period however often it is made."""
    days = written(bars(spark, sf_dir), "report-bars")
    rows = days.select(F.col("symbol").alias("scope"), F.year("day").cast("string").alias("period"), (F.col("volume") > 20).alias("passed"), (F.col("n") > 1).cast("double").alias("covered"), F.lit(False).alias("stale"), "n")
    columns = "scope string, period string, passed boolean, json string, csv string, svg string, integrity_hash string"
    table = Versions(spark, scratch(spark, "reports"), columns, "period", ["period", "scope"])
    table.upsert("first", quality_reports(rows))
    table.upsert("second", quality_reports(rows.where("period >= '2000'").withColumn("stale", F.col("n") < 3)))
    return table.read()


QUERIES = {f.__name__: f for f in (dataset_activation, report_upserts)}

_FORMAT = "printf('%.1f', {})"
_JSON = f"""'{{"metrics":{{"coverage":' || {_FORMAT.format("coverage")} || ',"observations":' || observations || ',"passing":' || passing || ',"stale_intervals":' || stale_intervals || '}},"passed":' || CAST(passing = observations AS VARCHAR) || ',"period":"' || period || '","scope":"' || scope || '"}}'"""
ORACLE = {
    "dataset_activation": f"""WITH {BARS_SQL} SELECT symbol || '-' || year(day) AS scope, count(*) AS rows, round(sum(CASE WHEN day(day) % 2 = 1 AND year(day) < 1998 THEN close + 1 ELSE close END), 4) AS close, CAST(sum(CASE WHEN symbol = 'S1' AND year(day) = 2000 THEN 1 ELSE volume END) AS BIGINT) AS volume, max(day) AS last_day FROM bars GROUP BY 1""",
    "report_upserts": f"""WITH {BARS_SQL}, s AS (SELECT symbol AS scope, CAST(year(day) AS VARCHAR) AS period, count(*) AS observations, count(*) FILTER (volume > 20) AS passing, round(100 * avg(CAST(n > 1 AS DOUBLE)), 1) AS coverage, count(*) FILTER (year(day) >= 2000 AND n < 3) AS stale_intervals FROM bars GROUP BY ALL)
      SELECT scope, period, passing = observations AS passed, {_JSON} AS json, 'metric,value' || chr(10) || 'coverage,' || {_FORMAT.format("coverage")} || chr(10) || 'observations,' || observations || chr(10) || 'passing,' || passing || chr(10) || 'stale_intervals,' || stale_intervals AS csv,
        '<svg xmlns="http://www.w3.org/2000/svg" width="360" height="140"><rect x="90" y="20" height="20" width="' || {_FORMAT.format("round(greatest(coverage, 0.0) * 2, 1)")} || '"/><rect x="90" y="55" height="20" width="' || {_FORMAT.format("round(greatest(100.0::DOUBLE * passing / observations, 0.0) * 2, 1)")} || '"/></svg>' AS svg, sha256({_JSON}) AS integrity_hash FROM s""",
}
