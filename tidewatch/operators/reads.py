"""Read queries: filtered lists, pages, point look-ups, counts, time buckets. Absent filters never reach the plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import date_bin, normalize_limit, severity_sort


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, default: int = 50, most: int = 500) -> DataFrame:
    """One page in a total order (callers end ``order`` with a unique column)."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset > 0 else out).limit(normalize_limit(limit, default, most))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def like(c: Column, text: str) -> Column:
    """Case-blind containment; % and _ in ``text`` keep their meaning."""
    return c.ilike(f"%{text}%")


def at_least(c: Column, when: datetime | None) -> Column:
    return c >= F.lit(when)


# --- Lists ---
def findings(raw: DataFrame, category=None, sub_category=None, severity=None, source_type=None, since=None, q=None) -> DataFrame:
    for name, value in (("category", category), ("sub_category", sub_category), ("severity", severity), ("source_type", source_type)):
        if value:
            raw = raw.where(F.col(name) == value)
    if since:
        raw = raw.where(at_least(F.col("collected_at"), since))
    if q:
        raw = raw.where(like(F.col("content"), q) | like(F.col("summary"), q))
    return raw


def finding_rows(raw: DataFrame) -> DataFrame:
    return raw.select("id", "source_type", "source_name", "category", "sub_category", "severity", F.coalesce("summary", F.left("content", F.lit(120))).alias("summary"), "collected_at")


def findings_page(raw: DataFrame, limit=None, offset=0, **filters) -> DataFrame:
    return page(finding_rows(findings(raw, **filters)), [F.col("collected_at").desc_nulls_first(), F.col("id")], limit, offset)


def iocs(table: DataFrame, kind=None, q=None, active_only=False, enriched_only=False) -> DataFrame:
    if kind:
        table = table.where(F.col("type") == kind)
    if q:
        table = table.where(like(F.col("value"), q))
    if active_only:
        table = table.where("active")
    if enriched_only:
        table = table.where("enriched_at is not null")
    return table


def iocs_page(table: DataFrame, limit=None, offset=0, **filters) -> DataFrame:
    return page(iocs(table, **filters), [F.col("threat_score").desc_nulls_last(), F.col("type"), F.col("value")], limit, offset)


def sources(table: DataFrame, status: str = "", group: str = "") -> DataFrame:
    """``active`` also means approved, no status leaves out pending ones; group telegram, other or a literal type."""
    if status == "active":
        table = table.where(F.col("status").isin("active", "approved"))
    elif status:
        table = table.where(F.col("status") == status)
    else:
        table = table.where("status <> 'pending_triage'")
    telegram = F.col("type").isin("telegram_channel", "telegram_group")
    if group == "telegram":
        return table.where(telegram)
    if group == "other":
        return table.where(~F.col("type").isin("telegram_channel", "telegram_group", "rss", "web"))
    return table.where(F.col("type") == group) if group else table


def listed_sources(table: DataFrame, status: str = "", kind: str = "") -> DataFrame:
    if status:
        table = table.where(F.col("status") == status)
    if kind:
        table = table.where(F.col("type") == kind)
    return table


def entities(table: DataFrame, kind=None, q=None) -> DataFrame:
    if kind:
        table = table.where(F.col("type") == kind)
    if q:
        table = table.where(like(F.col("id"), q) | like(F.to_json("properties"), q))
    return table


def correlations(table: DataFrame, kind=None, min_confidence: float = 0, since=None) -> DataFrame:
    if kind:
        table = table.where(F.col("correlation_type") == kind)
    if min_confidence > 0:
        table = table.where(F.col("confidence") >= min_confidence)
    return table.where(at_least(F.col("created_at"), since)) if since else table


def notes(table: DataFrame, note_type=None, status: str = "active", entity_id=None) -> DataFrame:
    if note_type:
        table = table.where(F.col("note_type") == note_type)
    if status:
        table = table.where(F.col("status") == status)
    return table.where(F.col("entity_id") == entity_id) if entity_id else table


def decisions(table: DataFrame, decision=None) -> DataFrame:
    return table.where(F.col("decision") == decision) if decision else table


def vulnerabilities(table: DataFrame, min_priority=0.0, kev_only=False, min_epss=0.0, exploit_only=False, mentioned_only=False, q=None) -> DataFrame:
    for on, test in ((min_priority > 0, F.col("priority_score") >= min_priority), (kev_only, F.col("kev_listed")), (min_epss > 0, F.col("epss_score") >= min_epss), (exploit_only, F.col("exploit_available")), (mentioned_only, F.col("mention_count") > 0)):
        if on:
            table = table.where(test)
    return table.where(like(F.col("cve_id"), q)) if q else table


def archive_search(raw: DataFrame, text=None, category=None, tags: list[str] = (), since=None, author=None) -> DataFrame:
    """``tags`` must all be there."""
    raw = findings(raw, category=category, since=since)
    if text:
        raw = raw.where(like(F.col("content"), text))
    if tags:
        raw = raw.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    return raw.where(like(F.col("author"), author)) if author else raw


def work_queue(raw: DataFrame, stage: str) -> DataFrame:
    """Records that wait for classify, extract or subclassify, oldest first."""
    test = {
        "classify": ~F.col("classified"),
        "extract": F.col("classified") & ~F.col("entities_extracted"),
        "subclassify": F.col("classified") & ~F.col("sub_classified") & F.col("category").isNotNull() & ~F.col("category").isin("", "irrelevant"),
    }[stage]
    return raw.where(test).orderBy("collected_at", "id")


def public_recent(raw: DataFrame, limit: int = 4) -> DataFrame:
    x = raw.where("classified and category is not null and category <> 'irrelevant' and summary is not null")
    short = F.when(F.length("summary") > 100, F.concat(F.left("summary", F.lit(100)), F.lit("..."))).otherwise(F.col("summary"))
    return page(x.select("id", "category", "severity", short.alias("summary"), "collected_at"), [F.desc("collected_at"), F.col("id")], limit)


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the set."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def finding_with_iocs(raw: DataFrame, ioc_table: DataFrame, record_id: str) -> DataFrame:
    """One record with the indicators first seen in it, most seen first."""
    linked = ioc_table.where(F.col("source_content_id") == record_id).select(F.col("source_content_id").alias("id"), F.struct((-F.col("sighting_count")).alias("n"), "type", "value").alias("x"))
    linked = linked.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"), (-e["n"]).alias("sighting_count"))).alias("iocs"))
    return raw.where(F.col("id") == record_id).join(linked, "id", "left")


# --- Counts ---
def counts_by(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def stats(raw: DataFrame, sightings: DataFrame, registry: DataFrame) -> DataFrame:
    """(metric, key, count): totals and the counts by source type and severity; a severity not given is unclassified."""
    totals = raw.agg(F.count(F.lit(1)).alias("total"), F.count_if("classified").alias("classified"), F.countDistinct("source_name").alias("source_names"))
    totals = totals.select(F.explode(F.array(*[F.struct(F.lit("total").alias("metric"), F.lit(c).alias("key"), F.col(c).alias("count")) for c in totals.columns])).alias("x")).select("x.*")
    iocs_total = sightings.select("ioc_type", "ioc_value").distinct().agg(F.count(F.lit(1)).alias("count")).select(F.lit("total").alias("metric"), F.lit("iocs").alias("key"), "count")
    by = lambda name, c: counts_by(raw, c.alias("key")).select(F.lit(name).alias("metric"), "key", "count")
    states = counts_by(registry.where(F.col("status").isin("discovered", "paused")), F.col("status").alias("key")).select(F.lit("sources").alias("metric"), "key", "count")
    return totals.unionByName(iocs_total).unionByName(by("source", F.col("source_type"))).unionByName(by("severity", F.coalesce("severity", F.lit("unclassified")))).unionByName(states)


def zero_filled(df: DataFrame, key: Column, buckets: list[str]) -> DataFrame:
    """Counts for every bucket, 0 where there is nothing."""
    all_buckets = df.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    return all_buckets.join(counts_by(df, key.alias("bucket")), "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"))


def source_type_bucket(kind: Column) -> Column:
    return F.when(kind == "rss", "rss").when(kind.isin("telegram_channel", "telegram_group"), "telegram").when(kind == "web", "web").otherwise("other")


def category_shares(raw: DataFrame) -> DataFrame:
    c = counts_by(raw.where("category is not null"), F.col("category"))
    return c.withColumn("share", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 4))


def sub_categories(raw: DataFrame) -> DataFrame:
    return counts_by(raw.where("sub_category is not null"), F.col("category"), F.col("sub_category"))


def timeline(raw: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts by time bucket (empty ones absent); unknown widths mean one hour."""
    return counts_by(raw.where("collected_at is not null"), date_bin(F.col("collected_at"), width).alias("bucket"))


def top_findings(raw: DataFrame, start: datetime, end: datetime, limit: int = 10) -> DataFrame:
    x = raw.where(F.col("classified") & (F.col("category") != "irrelevant") & F.col("collected_at").between(F.lit(start), F.lit(end)))
    return x.withColumn("rank", severity_sort(F.col("severity"))).orderBy("rank", F.desc("collected_at"), "id").limit(limit)


def latest_per(df: DataFrame, key: str, order: list[Column], value: list[str]) -> DataFrame:
    return top_per(df, [key], order, 1).select(key, *value)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def posting_cadence(raw: DataFrame) -> DataFrame:
    """Posts of each author by hour of the day (UTC)."""
    x = raw.where("author is not null and trim(author) <> '' and collected_at is not null")
    return counts_by(x, F.col("author"), F.floor(F.pmod(F.unix_seconds("collected_at"), F.lit(86400)) / 3600).alias("hour"))


def statuses_by_category(modules: DataFrame) -> DataFrame:
    """(category, id, name, enabled) module states -> one row a category, modules sorted by name."""
    return modules.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("name", "id", "enabled"))).alias("modules"))


def briefs(table: DataFrame, kind: str = "", limit: int | None = None) -> DataFrame:
    """Briefs by type, the newest first."""
    rows = table.where(F.col("brief_type") == kind) if kind else table
    return page(rows, [F.desc("period_end"), F.col("id")], limit, 0, 20, 100)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes, decisions and briefs are only ever added."""
    return old.unionByName(new, allowMissingColumns=True)
