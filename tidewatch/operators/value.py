"""Worth of sources and daily briefs, one grouped pass per metric instead of a loop over sources."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import micros, severity_rank, source_value_score
from tidewatch.operators.graph import trending
from tidewatch.operators.reads import counts_by, top_findings

DAY = 86_400_000_000


def unique_iocs(sightings: DataFrame, key: str = "source_id", days: int = 7) -> DataFrame:
    """Per source, indicators sighted there with no sighting elsewhere in the ``days`` before.

    Per indicator the instants are ordered once. The latest earlier instant decides if another source (or more than one) was
    seen then; else it was the source itself, and the instant before its unbroken run does. So two values carried along
    replace a join of all pairs, and a hot indicator costs one sort."""
    s = sightings.where(f"{key} is not null").select("ioc_type", "ioc_value", F.col(key).alias("src"), micros(F.col("created_at")).alias("at")).distinct()
    instants = s.groupBy("ioc_type", "ioc_value", "at").agg(F.min("src").alias("low"), F.max("src").alias("high"), F.collect_set("src").alias("srcs"))
    alone = F.when(F.col("low") == F.col("high"), F.col("low"))  # null: more than one source
    w = Window.partitionBy("ioc_type", "ioc_value").orderBy("at")
    x = instants.withColumn("alone", alone).withColumn("last_at", F.lag("at").over(w)).withColumn("last_alone", F.lag("alone").over(w))
    starts = F.col("last_at").isNotNull() & (F.col("alone").isNull() | F.col("last_alone").isNull() | (F.col("alone") != F.col("last_alone")))
    x = x.withColumn("before_run", F.last(F.when(starts, F.col("last_at")), ignorenulls=True).over(w))
    x = x.withColumn("before_last_run", F.lag("before_run").over(w)).select("ioc_value", "at", "last_at", "last_alone", "before_last_run", F.explode("srcs").alias("src"))
    other = F.when(F.col("last_alone") == F.col("src"), F.col("before_last_run")).otherwise(F.col("last_at"))
    first = x.where(other.isNull() | (other <= F.col("at") - days * DAY))
    return first.groupBy("src").agg(F.countDistinct("ioc_value").alias("unique_iocs"))


def correlation_contributions(correlations: DataFrame, raw: DataFrame, key: str = "source_id") -> DataFrame:
    x = correlations.select("cluster_id", F.explode("finding_ids").alias("id")).distinct().join(raw.select("id", F.col(key).alias("src")), "id")
    return x.where("src is not null").groupBy("src").agg(F.countDistinct("cluster_id").alias("contributions"))


def source_metrics(raw: DataFrame, key: str = "source_id") -> DataFrame:
    """Classified and relevant records, mean severity of the relevant ones, and the latest collection."""
    relevant = F.col("classified") & F.col("category").isNotNull() & (F.col("category") != "irrelevant")
    return (
        raw.where(f"{key} is not null")
        .groupBy(F.col(key).alias("src"))
        .agg(
            F.count_if("classified").alias("total"),
            F.count_if(relevant).alias("relevant"),
            F.coalesce(F.avg(F.when(relevant, F.coalesce(severity_rank(F.col("severity")), F.lit(0)).cast("double"))), F.lit(0.0)).alias("avg_severity"),
            F.max("collected_at").alias("last_collected"),
        )
    )


def source_values(raw: DataFrame, sightings: DataFrame, correlations: DataFrame, as_of: Column, key: str = "source_id") -> DataFrame:
    x = source_metrics(raw, key).join(unique_iocs(sightings, key), "src", "left").join(correlation_contributions(correlations, raw, key), "src", "left")
    x = x.withColumn("unique_iocs", F.coalesce("unique_iocs", F.lit(0))).withColumn("contributions", F.coalesce("contributions", F.lit(0)))
    x = x.withColumn("signal_to_noise", F.when(F.col("total") > 0, F.col("relevant") / F.col("total")).otherwise(0.0))
    x = x.withColumn("freshness", F.coalesce(F.exp(-(micros(as_of) - micros(F.col("last_collected"))) / F.lit(3.6e9) / 24), F.lit(0.0)))
    return x.withColumn("value_score", source_value_score(*[F.col(c) for c in ("unique_iocs", "contributions", "avg_severity", "signal_to_noise", "freshness", "total")]))


def content_counts(sources: DataFrame, raw: DataFrame) -> DataFrame:
    """Records of each source by name, by identifier, or by the channel number that its user name stands for; each once."""
    username = F.regexp_replace("identifier", r"^https?://t\.me/", "")
    s = sources.select("id", "name", "identifier", "type", username.alias("username"))
    channel = raw.where("source_type = 'telegram'").groupBy(F.col("source_name").alias("username")).agg(F.min("source_id").alias("channel"))
    s = s.join(channel, "username", "left")
    keys = s.select("id", F.explode(F.array(F.struct(F.lit("n").alias("k"), F.col("name").alias("v")), F.struct(F.lit("n").alias("k"), F.col("username").alias("v")), F.struct(F.lit("i").alias("k"), F.col("identifier").alias("v")), F.struct(F.lit("i").alias("k"), F.col("channel").alias("v")))).alias("x"))
    keys = keys.select("id", "x.k", "x.v").where("v is not null").distinct()
    r = raw.select(F.col("id").alias("rid"), F.explode(F.array(F.struct(F.lit("n").alias("k"), F.col("source_name").alias("v")), F.struct(F.lit("i").alias("k"), F.col("source_id").alias("v")))).alias("x")).select("rid", "x.k", "x.v").where("v is not null")
    n = keys.join(r, ["k", "v"]).groupBy("id").agg(F.countDistinct("rid").alias("content_count"))
    return sources.select("id", "name").join(n, "id", "left").select("id", "name", F.coalesce("content_count", F.lit(0)).alias("content_count"))


def source_activity(sources: DataFrame, raw: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Records of each registered source in the period, joined by name."""
    r = raw.where(F.col("collected_at").between(F.lit(start), F.lit(end))).groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return sources.select("name", "type").join(r, "name", "left").groupBy("name", "type").agg(F.sum(F.coalesce("n", F.lit(0))).alias("findings"))


def brief_metrics(raw: DataFrame, sightings: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """(metric, key, count) of a period: null severity counts as info, null category as uncategorized."""
    inside = lambda df, c: df.where(F.col(c).between(F.lit(start), F.lit(end)))
    r, s = inside(raw, "collected_at"), inside(sightings, "created_at")
    by = lambda df, name, c: counts_by(df, c.alias("key")).select(F.lit(name).alias("metric"), "key", "count")
    return by(r, "severity", F.coalesce("severity", F.lit("info"))).unionByName(by(r, "category", F.coalesce("category", F.lit("uncategorized")))).unionByName(by(s.select("ioc_type", "ioc_value").distinct(), "ioc", F.col("ioc_type")))


def daily_brief(raw: DataFrame, sightings: DataFrame, entities: DataFrame, edges: DataFrame, as_of: datetime) -> DataFrame:
    """One row for the 24 hours before ``as_of``, none without records: metrics map, top records and trending entities."""
    start = as_of - timedelta(days=1)
    metrics = brief_metrics(raw, sightings, start, as_of).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws(":", "metric", "key"), "count")))).alias("metrics"))
    top = top_findings(raw, start, as_of).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "summary"))).alias("top_findings"))
    hot = trending(entities, edges, start, start - timedelta(days=1), as_of).orderBy(F.desc("current"), "id").limit(10).agg(F.sort_array(F.collect_list(F.struct("id", "current", "previous"))).alias("trending"))
    some = raw.where(F.col("collected_at").between(F.lit(start), F.lit(as_of))).agg(F.count(F.lit(1)).alias("findings")).where("findings > 0")
    return some.select("findings", metrics.scalar().alias("metrics"), top.scalar().alias("top_findings"), hot.scalar().alias("trending"), F.lit(as_of).alias("period_end"))


def sum_map(c: Column) -> Column:
    return F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, v: a + v)


def brief_markdown(sections: dict[str, str]) -> str:
    """Sections in their fixed order."""
    order = ("executive_summary", "key_findings", "trending", "correlations", "recommendations")
    return "\n\n".join(f"## {k.replace('_', ' ').title()}\n\n{sections[k].strip()}" for k in order if sections.get(k, "").strip())
