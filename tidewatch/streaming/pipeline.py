"""Streams: ingest with deduplication, archive and alerts; work queues; rate limits and budgets as state machines over ordered events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewatch.functions.scalar import severity_max
from tidewatch.functions.text import Rule, is_junk, match
from tidewatch.operators.upsert import insert_ignore

FINDING_STREAM = "id string, source string, source_id string, source_name string, content string, content_hash string, author string, timestamp timestamp, collected_at timestamp, metadata map<string,string>"


def read_findings(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Findings that collectors put down as JSON files; the trigger size is the back-pressure."""
    return spark.readStream.schema(FINDING_STREAM).option("maxFilesPerTrigger", files_per_trigger).json(path)


def fan_in(streams: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), streams)


def hashed(findings: DataFrame) -> DataFrame:
    """Findings with the hash of their content. No watermark: a late row is as good as any, the archive decides what is new."""
    return findings.withColumn("content_hash", F.sha2("content", 256))


def enriched(batch: DataFrame, rules: list[Rule], classify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rule match, classification (a pluggable DataFrame -> DataFrame that adds category, confidence, severity) and the alert flag.
    Default classifier: the rule's severity, no category."""
    x = batch.withColumn("match", match(F.col("content"), rules)).withColumn("junk", is_junk(F.col("content")))
    if classify:
        x = classify(x)
    else:
        x = x.withColumn("category", F.lit(None).cast("string")).withColumn("severity", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    severity = F.when(F.col("category") == "irrelevant", "info").otherwise(severity_max(F.col("match.severity"), F.col("severity")))
    return x.withColumn("severity", severity).withColumn("alert", F.col("match.matched") & F.coalesce(F.col("category") != "irrelevant", F.lit(True)) & ~F.col("junk"))


class Ingest:
    """foreachBatch: archive what is new, alert on what matches. Paths lie in storage that all executors share.

    A batch that is run again after a failure overwrites its own folder, so nothing is archived twice."""

    def __init__(self, archive: str, alerts: str, rules: list[Rule], classify=None, extract=None, summarize=None, iocs: str | None = None):
        """``extract`` (records -> record_id, type, value, context) fills ``iocs``; ``summarize`` adds the summary."""
        self.archive, self.alerts, self.rules, self.classify, self.extract, self.summarize, self.iocs = archive, alerts, rules, classify, extract, summarize, iocs

    def known(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Hashes of what other batches archived. Only a missing folder means none; any other fault ends the batch."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.archive)
        if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return spark.createDataFrame([], "content_hash string")
        done = spark.read.schema("content_hash string, batch_id bigint").parquet(self.archive)
        return done.where(F.col("batch_id") != batch_id).select("content_hash")
    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = insert_ignore(self.known(spark, batch_id), batch, ["content_hash"], ["collected_at", "id"])
        out = enriched(new, self.rules, self.classify)
        if self.summarize:
            out = self.summarize(out)
        at = f"{self.archive}/batch_id={batch_id}"
        out.write.mode("overwrite").parquet(at)
        kept = spark.read.schema(out.schema).parquet(at)
        kept.where("alert").write.mode("overwrite").parquet(f"{self.alerts}/batch_id={batch_id}")
        if self.extract and self.iocs:
            self.extract(kept).write.mode("overwrite").parquet(f"{self.iocs}/batch_id={batch_id}")


def run_ingest(findings: DataFrame, sink: Ingest, checkpoint: str):
    return hashed(findings).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics(findings: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counters of a batch by source: collected, matched, dropped without a match, junk."""
    x = findings.withColumn("m", match(F.col("content"), rules)["matched"]).withColumn("j", is_junk(F.col("content")))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("collected"), F.count_if("m").alias("matched"), F.count_if(~F.col("m")).alias("dropped"), F.count_if("j").alias("junk"))


def latency_histogram(events: DataFrame, bounds=(0.5, 1, 2, 4, 8, 16, 32, 64)) -> DataFrame:
    """Cumulative counts by upper bound."""
    each = [F.count_if(F.col("seconds") <= b).alias(str(b)) for b in bounds]
    row = events.agg(*each, F.count(F.lit(1)).alias("+Inf"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("le"), F.col(f"`{c}`").alias("count")) for c in row.columns])).alias("x")).select("x.*")


def poisoned(errors: DataFrame, most: int = 5) -> DataFrame:
    """Records that failed ``most`` times and are to be marked done."""
    return errors.groupBy("id").agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= most)


def token_bucket(requests: DataFrame, per_minute: float, per_day: int = 0) -> DataFrame:
    """(client, at double seconds, tokens) -> granted_at: when each request passes a bucket that refills evenly, in the order of
    arrival, with a daily cap that starts anew at midnight UTC. Clients are independent; a client's requests are one state."""
    rate = per_minute / 60.0

    def simulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "tokens"], kind="stable").reset_index(drop=True)
        level, last, now, used, day, out = per_minute, None, 0.0, 0, None, []
        for at, n in zip(pdf["at"], pdf["tokens"]):
            n = min(max(float(n), 1.0), per_minute)
            now = max(now, at)
            last = now if last is None else last
            if int(now // 86400) != day:
                day, used = int(now // 86400), 0
            if per_day and used + int(n) > per_day and n <= per_day:
                now, day, used = (day + 1) * 86400.0, day + 1, 0
            level, last = min(per_minute, level + (now - last) * rate), now
            if level < n - 1e-9:
                # One wait, not a loop until the level is enough: a double of today's seconds has steps of 2e-7, so a smaller
                # remainder would be waited for without end. What rounding leaves stays in the level and doesn't add up.
                now += (n - level) / rate
                level, last = level + (now - last) * rate, now
                if int(now // 86400) != day:
                    day, used = int(now // 86400), 0
            level, used = level - n, used + int(n)
            out.append(now)
        return pdf.assign(granted_at=out)

    return requests.select("client", "at", "tokens").groupBy("client").applyInPandas(simulate, "client string, at double, tokens double, granted_at double")


def spending(usage: DataFrame, budget: float, rate_per_million: float, tie: tuple[str, ...] = ()) -> DataFrame:
    """(client, at, tokens) -> running cost of the month and whether the budget still holds. Rows of one instant are ordered by
    ``tie``. Days are summed first, so a busy client is sorted day by day."""
    x = usage.withColumns({"month": F.trunc("at", "month"), "_day": F.to_date("at"), "cost": F.col("tokens") / 1e6 * rate_per_million})
    days = x.groupBy(F.col("client").alias("_c"), F.col("month").alias("_m"), "_day").agg(F.sum("cost").alias("_cost"))
    w = Window.partitionBy("_c", "_m").orderBy("_day")
    days = days.select("_c", F.col("_day").alias("_d"), (F.sum("_cost").over(w) - F.col("_cost")).alias("_before"))
    x = x.join(days, F.col("client").eqNullSafe(F.col("_c")) & F.col("_day").eqNullSafe(F.col("_d")))
    w = Window.partitionBy("client", "_day").orderBy("at", *tie).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("spent", F.col("_before") + F.sum("cost").over(w)).withColumn("within_budget", F.col("spent") <= budget).drop("_c", "_d", "_day", "_before")


def due(last_success, as_of, every_seconds: int) -> bool:
    """Whether a periodic job is to run."""
    return last_success is None or (as_of - last_success).total_seconds() >= every_seconds


#: Seconds between runs of the periodic jobs (fixed values).
SCHEDULE = {"correlate": 900, "decay": 3600, "source_value": 21_600, "vulnerabilities": 21_600, "epss": 86_400, "kev": 86_400, "enrich": 1800, "triage": 300}


def vulnerability_steps(last: dict, as_of) -> list[str]:
    """Steps of a vulnerability cycle in their order; the daily ones only when due."""
    daily = [s for s in ("epss", "kev") if due(last.get(s), as_of, SCHEDULE[s])]
    return ["nvd", *daily, "cross_reference", "priorities"]
