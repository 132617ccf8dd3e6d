"""All core queries by name, each with the SQL that gives the same rows on the same tables, where SQL can.

Arrays come out joined, times as microseconds, doubles rounded, so that rows compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalar as sc
from tidewatch.functions import text as tx
from tidewatch.functions import urls as ur
from tidewatch.operators import correlate as co
from tidewatch.operators import dataset as ds
from tidewatch.operators import graph as gr
from tidewatch.operators import reads as rd
from tidewatch.operators import upsert as up
from tidewatch.operators import value as va
from tidewatch.plans.adapters import AS_OF_SQL, CORRELATIONS, IOCS, NOTES, SHARED, VULNS, as_of, correlations, iocs, notes, vulnerabilities
from tidewatch.schemas import cluster_id, source_entity_id
from tidewatch.streaming import pipeline as st
from tidewatch.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
END = datetime(2026, 7, 1, tzinfo=timezone.utc)
START = datetime(2026, 6, 24, tzinfo=timezone.utc)
BEFORE = datetime(2026, 6, 17, tzinfo=timezone.utc)
END_SQL, START_SQL, BEFORE_SQL = AS_OF_SQL, "TIMESTAMPTZ '2026-06-24 00:00:00+00'", "TIMESTAMPTZ '2026-06-17 00:00:00+00'"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def us(c: str | Column, name: str | None = None) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    out = F.unix_micros(x)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def joined(c: str, name: str | None = None) -> Column:
    return F.array_join(c, ",").alias(name or c)


def rounded(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# --- Correlation rules ----------------------------------------------------------------------------------------------
@query("shared_ioc", f"WITH {CORRELATIONS} SELECT c.cluster_id, s.ioc_type, s.ioc_value, array_to_string(s.sources, ',') AS sources, array_to_string(s.finding_ids, ',') AS finding_ids, s.source_count, round(c.confidence, 6) AS confidence, c.is_correlation FROM shared s JOIN correlations c ON c.cluster_id = 'corr:shared_ioc:' || sha256(s.ioc_type || ':' || s.ioc_value)")
def shared_ioc(spark, d):
    x = co.shared_iocs(table(spark, d, "ioc_sightings"), table(spark, d, "raw_content"))
    return x.select(
        cluster_id("shared_ioc", F.concat_ws(":", "ioc_type", "ioc_value")).alias("cluster_id"), "ioc_type", "ioc_value", joined("sources"), joined("finding_ids"), "source_count",
        rounded(sc.correlation_confidence("shared_ioc", F.col("source_count")), "confidence"), (F.col("source_count") >= 3).alias("is_correlation"),
    )


HANDLES = """handles AS (
  SELECT author, coalesce(author_id, '') AS author_id, array_to_string(list_sort(list(DISTINCT source_name) FILTER (source_name IS NOT NULL)), ',') AS sources,
         array_to_string(list_sort(list(DISTINCT id)), ',') AS finding_ids, count(DISTINCT source_id) AS source_count
  FROM raw_content WHERE classified AND category <> 'irrelevant' AND provenance = 'first_party' AND author IS NOT NULL AND author <> ''
  GROUP BY author, raw_content.author_id HAVING count(DISTINCT source_id) >= 2)"""
GARBAGE = r"""(length(regexp_replace(lower(author), '[\p{Cf}\p{Cc}\s\p{Z}]', '', 'g')) < 3 OR regexp_replace(lower(author), '[\p{Cf}\p{Cc}\s\p{Z}]', '', 'g') LIKE '%\_bot' ESCAPE '\'
  OR lower(trim(author)) IN ('admin','support','bot','info','news','channel') OR regexp_replace(lower(author), '[\p{Cf}\p{Cc}\s\p{Z}]', '', 'g') IN ('admin','support','bot','info','news','channel'))"""


@query("handle_reuse", f"WITH {HANDLES} SELECT author, author_id, sources, finding_ids, source_count, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.2::DOUBLE * source_count + 0.4::DOUBLE)), 6) AS confidence FROM handles WHERE NOT {GARBAGE}")
def handle_reuse(spark, d):
    x = co.handle_reuse(table(spark, d, "raw_content")).where(~tx.garbage_handle(F.col("author")))
    return x.select("author", "author_id", joined("sources"), joined("finding_ids"), "source_count", rounded(sc.correlation_confidence("handle_reuse", F.col("source_count")), "confidence"))


def _temporal_sql(hours: int) -> str:
    return f"""WITH f AS (
  SELECT DISTINCT s.raw_content_id AS id, rc.source_id, rc.source_name, rc.collected_at, s.ioc_type || ':' || s.ioc_value AS k FROM ioc_sightings s JOIN raw_content rc ON rc.id = s.raw_content_id
  WHERE rc.classified AND rc.category <> 'irrelevant' AND rc.provenance = 'first_party')
SELECT a.id AS finding_a, b.id AS finding_b, a.source_name AS source_a, b.source_name AS source_b, array_to_string(list_sort(list(DISTINCT a.k)), ',') AS shared_iocs, count(DISTINCT a.k) AS shared_count
FROM f a JOIN f b ON a.k = b.k AND a.source_id <> b.source_id AND a.id < b.id AND abs(epoch_us(a.collected_at) - epoch_us(b.collected_at)) <= {hours}::BIGINT * 3600000000
GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT a.k) >= 2"""


@query("temporal_overlap", _temporal_sql(24 * 60))
def temporal_overlap(spark, d):
    x = co.temporal_overlap(table(spark, d, "ioc_sightings"), table(spark, d, "raw_content"), None, 24 * 60)
    return x.select("finding_a", "finding_b", "source_a", "source_b", joined("shared_iocs"), "shared_count")


CLUSTER = """WITH e AS (SELECT id, type, coalesce(properties['name'], id) AS name FROM entities),
m AS (SELECT DISTINCT g.source_id, e.name, g.target_id, t.name AS shared_name FROM edges g JOIN e ON e.id = g.source_id AND e.type = 'threat_actor' JOIN e t ON t.id = g.target_id)
SELECT a.source_id AS entity_a, a.name AS name_a, b.source_id AS entity_b, b.name AS name_b, array_to_string(list_sort(list(DISTINCT a.target_id)), ',') AS shared_ids,
       array_to_string(list_sort(list(DISTINCT a.shared_name)), ',') AS shared_names, count(DISTINCT a.target_id) AS shared_count
FROM m a JOIN m b ON a.target_id = b.target_id AND a.source_id < b.source_id GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT a.target_id) >= 1"""


@query("entity_cluster", CLUSTER)
def entity_cluster(spark, d):
    x = co.entity_clusters(table(spark, d, "entities"), table(spark, d, "edges"), "threat_actor", 1)
    return x.select("entity_a", "name_a", "entity_b", "name_b", joined("shared_ids"), joined("shared_names"), "shared_count")


@query("correlation_cycle")
def correlation_cycle(spark, d):
    x = co.cycle(*[table(spark, d, n) for n in ("ioc_sightings", "raw_content", "entities", "edges")], None, 24 * 60)
    return x.select("cluster_id", "correlation_type", "method", joined("entity_ids"), joined("finding_ids"), rounded(F.col("confidence"), "confidence"), "is_correlation")


@query("analyst_decisions", f"""WITH {CORRELATIONS}, c AS (SELECT cluster_id, source_count AS n, 'pending' AS status, CASE WHEN confidence >= 0.9 THEN 'promote' WHEN confidence < 0.81 AND substr(cluster_id, 17, 1) < '8' THEN 'reject' WHEN confidence < 0.81 THEN 'promote' END AS d, confidence - 0.2::DOUBLE AS dc FROM correlations)
SELECT cluster_id, CASE WHEN n >= 2 AND d = 'promote' AND dc >= 0.7 THEN 'promoted' WHEN n >= 2 AND d = 'reject' THEN 'rejected' ELSE status END AS status,
  CASE WHEN n >= 2 AND d = 'promote' AND dc >= 0.7 THEN 'promote' WHEN n >= 2 AND d = 'reject' THEN 'reject' WHEN n >= 2 AND d IS NOT NULL THEN 'defer' END AS outcome FROM c""")
def analyst_decisions(spark, d):
    c = correlations(spark, d)
    half = F.substring("cluster_id", 17, 1) < "8"
    low = F.col("confidence") < 0.81
    dec = c.select("cluster_id", F.when(F.col("confidence") >= 0.9, "promote").when(low & half, "reject").when(low, "promote").alias("decision"), (F.col("confidence") - 0.2).alias("confidence")).where("decision is not null")
    cand = co.shared_iocs(table(spark, d, "ioc_sightings"), table(spark, d, "raw_content")).select(cluster_id("shared_ioc", F.concat_ws(":", "ioc_type", "ioc_value")).alias("cluster_id"), F.col("source_count").alias("signal_count"), F.lit("pending").alias("status"))
    return co.apply_decisions(cand, dec).select("cluster_id", "status", "outcome")


# --- Lists and pages --------------------------------------------------------------------------------------------------
@query("findings_page", """SELECT id, source_type, source_name, category, sub_category, severity, coalesce(summary, left(content, 120)) AS summary, epoch_us(collected_at) AS collected_at
FROM raw_content WHERE category = 'vulnerability' AND source_type = 'telegram' AND (content ILIKE '%CVE%' OR summary ILIKE '%CVE%') ORDER BY raw_content.collected_at DESC, id LIMIT 50 OFFSET 20""")
def findings_page(spark, d):
    return rd.findings_page(table(spark, d, "raw_content"), 50, 20, category="vulnerability", source_type="telegram", q="CVE").withColumn("collected_at", us("collected_at"))


@query("findings_total", "SELECT count(*) AS total FROM raw_content WHERE severity = 'high' AND collected_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00'")
def findings_total(spark, d):
    return rd.total(rd.findings(table(spark, d, "raw_content"), severity="high", since=datetime(2026, 1, 1, tzinfo=timezone.utc)))


@query("ilike_wildcard", "SELECT id FROM raw_content WHERE author ILIKE '%a_k%'")
def ilike_wildcard(spark, d):
    return table(spark, d, "raw_content").where(rd.like(F.col("author"), "a_k")).select("id")


@query("iocs_page", f"WITH {IOCS} SELECT type, value, sighting_count, epoch_us(last_seen) AS last_seen FROM iocs WHERE type = 'domain' AND value ILIKE '%cdn%' AND active ORDER BY threat_score DESC NULLS LAST, type, value LIMIT 100")
def iocs_page(spark, d):
    return rd.iocs_page(iocs(spark, d), 100, kind="domain", q="cdn", active_only=True).select("type", "value", "sighting_count", us("last_seen"))


@query("sources_active", "SELECT id, type, identifier, name, status FROM sources WHERE status IN ('active', 'approved') AND type NOT IN ('telegram_channel', 'telegram_group', 'rss', 'web')")
def sources_active(spark, d):
    return rd.sources(table(spark, d, "sources"), "active", "other").select("id", "type", "identifier", "name", "status")


@query("sources_listed", "SELECT identifier, status FROM sources WHERE type = 'telegram_channel'")
def sources_listed(spark, d):
    return rd.listed_sources(table(spark, d, "sources"), "", "telegram_channel").select("identifier", "status")


@query("entities_degree", """SELECT e.id, e.type, coalesce(g.degree, 0) AS degree FROM entities e LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1) g ON g.id = e.id WHERE e.type = 'malware'""")
def entities_degree(spark, d):
    return gr.entities_with_degree(rd.entities(table(spark, d, "entities"), "malware"), table(spark, d, "edges")).select("id", "type", "degree")


@query("correlations_list", f"WITH {CORRELATIONS} SELECT cluster_id, round(confidence, 6) AS confidence FROM correlations WHERE correlation_type = 'shared_ioc' AND confidence >= 0.9")
def correlations_list(spark, d):
    x = correlations(spark, d).withColumn("created_at", as_of())
    return rd.correlations(x, "shared_ioc", 0.9).select("cluster_id", rounded(F.col("confidence"), "confidence"))


@query("notes_list", f"WITH {NOTES} SELECT id, note_type, entity_id, content FROM notes WHERE note_type = 'warning' AND status = 'active'")
def notes_list(spark, d):
    return rd.notes(notes(spark, d), "warning").select("id", "note_type", "entity_id", "content")


@query("vulnerabilities_list", f"WITH {VULNS} SELECT cve_id, round(priority_score, 6) AS priority_score, priority_label, mention_count FROM vulnerabilities WHERE priority_score >= 0.5 AND exploit_available AND mention_count > 0")
def vulnerabilities_list(spark, d):
    return rd.vulnerabilities(vulnerabilities(spark, d), min_priority=0.5, exploit_only=True, mentioned_only=True).select("cve_id", rounded(F.col("priority_score"), "priority_score"), "priority_label", "mention_count")


@query("tags_contains_all", "SELECT id FROM raw_content WHERE list_has_all(coalesce(tags, []), ['vulnerability', 'en'])")
def tags_contains_all(spark, d):
    return rd.archive_search(table(spark, d, "raw_content"), tags=["vulnerability", "en"]).select("id")


@query("work_queue", "SELECT id, epoch_us(collected_at) AS collected_at FROM raw_content WHERE classified AND NOT entities_extracted")
def work_queue(spark, d):
    return rd.work_queue(table(spark, d, "raw_content"), "extract").select("id", us("collected_at"))


@query("work_queue_subclassify", "SELECT id FROM raw_content WHERE classified AND NOT sub_classified AND category IS NOT NULL AND category NOT IN ('', 'irrelevant')")
def work_queue_subclassify(spark, d):
    return rd.work_queue(table(spark, d, "raw_content"), "subclassify").select("id")


@query("public_recent", """SELECT id, category, severity, CASE WHEN length(summary) > 100 THEN left(summary, 100) || '...' ELSE summary END AS summary, epoch_us(collected_at) AS collected_at FROM raw_content
WHERE classified AND category IS NOT NULL AND category <> 'irrelevant' AND summary IS NOT NULL ORDER BY raw_content.collected_at DESC, id LIMIT 4""")
def public_recent(spark, d):
    return rd.public_recent(table(spark, d, "raw_content")).withColumn("collected_at", us("collected_at"))


@query("semi_by_ids", "SELECT id, category FROM raw_content WHERE id IN (SELECT raw_content_id FROM ioc_sightings WHERE ioc_type = 'hash_sha256')")
def semi_by_ids(spark, d):
    keys = table(spark, d, "ioc_sightings").where("ioc_type = 'hash_sha256'").select(F.col("raw_content_id").alias("id"))
    return rd.semi(table(spark, d, "raw_content"), keys, "id").select("id", "category")


# --- Counts -------------------------------------------------------------------------------------------------------------
@query("stats", """SELECT 'total' AS metric, 'total' AS key, count(*) AS count FROM raw_content UNION ALL SELECT 'total', 'classified', count(*) FILTER (classified) FROM raw_content
UNION ALL SELECT 'total', 'source_names', count(DISTINCT source_name) FROM raw_content UNION ALL SELECT 'total', 'iocs', count(*) FROM (SELECT DISTINCT ioc_type, ioc_value FROM ioc_sightings)
UNION ALL SELECT 'source', source_type, count(*) FROM raw_content GROUP BY source_type UNION ALL SELECT 'severity', coalesce(severity, 'unclassified'), count(*) FROM raw_content GROUP BY 2
UNION ALL SELECT 'sources', status, count(*) FROM sources WHERE status IN ('discovered', 'paused') GROUP BY status""")
def stats(spark, d):
    return rd.stats(*[table(spark, d, n) for n in ("raw_content", "ioc_sightings", "sources")])


@query("category_shares", "SELECT category, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS share FROM raw_content WHERE category IS NOT NULL GROUP BY category")
def category_shares(spark, d):
    return rd.category_shares(table(spark, d, "raw_content"))


@query("sub_categories", "SELECT category, sub_category, count(*) AS count FROM raw_content WHERE sub_category IS NOT NULL GROUP BY ALL")
def sub_categories(spark, d):
    return rd.sub_categories(table(spark, d, "raw_content"))


@query("type_counts_zero_filled", "SELECT b.bucket, count(s.id) AS count FROM (VALUES ('rss'), ('telegram'), ('web'), ('other')) b(bucket) LEFT JOIN sources s ON b.bucket = CASE WHEN s.type = 'rss' THEN 'rss' WHEN s.type IN ('telegram_channel', 'telegram_group') THEN 'telegram' WHEN s.type = 'web' THEN 'web' ELSE 'other' END GROUP BY 1")
def type_counts(spark, d):
    return rd.zero_filled(table(spark, d, "sources"), rd.source_type_bucket(F.col("type")), ["rss", "telegram", "web", "other"])


def _timeline(width: str, interval: str):
    @query(f"timeline_{width.replace('1 ', '').replace(' ', '_')}", f"SELECT epoch_us(time_bucket(INTERVAL '{interval}', collected_at::TIMESTAMP, TIMESTAMP '2000-01-01')) AS bucket, count(*) AS count FROM (SELECT make_timestamp(epoch_us(collected_at)) AS collected_at FROM raw_content WHERE collected_at IS NOT NULL) GROUP BY 1")
    def run(spark, d):
        return rd.timeline(table(spark, d, "raw_content"), width).withColumn("bucket", us("bucket"))


for _w, _i in (("1 hour", "1 hour"), ("6 hours", "6 hours"), ("1 day", "1 day"), ("1 week", "7 days")):
    _timeline(_w, _i)


@query("top_findings", f"""SELECT id, severity, epoch_us(collected_at) AS collected_at FROM raw_content WHERE classified AND category <> 'irrelevant' AND collected_at BETWEEN {BEFORE_SQL} AND {END_SQL}
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, raw_content.collected_at DESC, id LIMIT 10""")
def top_findings(spark, d):
    return rd.top_findings(table(spark, d, "raw_content"), BEFORE, END).select("id", "severity", us("collected_at"))


@query("latest_per_entity", f"WITH {NOTES} SELECT entity_id, content, epoch_us(created_at) AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id) AS n FROM notes WHERE status = 'active') WHERE n = 1")
def latest_per_entity(spark, d):
    x = rd.latest_per(notes(spark, d).where("status = 'active'"), "entity_id", [F.desc("created_at"), F.col("id")], ["content", "created_at"])
    return x.withColumn("created_at", us("created_at"))


@query("topk_per_group", "SELECT category, id FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY collected_at, id) AS n FROM raw_content WHERE category IS NOT NULL) WHERE n <= 8")
def topk_per_group(spark, d):
    return rd.top_per(table(spark, d, "raw_content").where("category is not null").select("category", "id", "collected_at"), ["category"], [F.col("collected_at"), F.col("id")], 8).select("category", "id")


@query("posting_cadence", "SELECT author, ((epoch_us(collected_at) // 1000000) % 86400) // 3600 AS hour, count(*) AS count FROM raw_content WHERE author IS NOT NULL AND trim(author) <> '' AND collected_at IS NOT NULL GROUP BY ALL")
def posting_cadence(spark, d):
    return rd.posting_cadence(table(spark, d, "raw_content"))


@query("freshness", "SELECT source_id, epoch_us(min(collected_at)) AS first_seen, epoch_us(max(collected_at)) AS last_seen, count(DISTINCT author) AS authors FROM raw_content GROUP BY source_id")
def freshness(spark, d):
    return table(spark, d, "raw_content").groupBy("source_id").agg(us(F.min("collected_at"), "first_seen"), us(F.max("collected_at"), "last_seen"), F.countDistinct("author").alias("authors"))


# --- Mutations ------------------------------------------------------------------------------------------------------------
@query("insert_ignore", """SELECT id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY collected_at, id) AS n FROM findings f WHERE content_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_content r WHERE r.content_hash = f.content_hash)) WHERE n = 1
UNION ALL SELECT id, content_hash FROM findings WHERE content_hash IS NULL""")
def insert_ignore(spark, d):
    return up.insert_ignore(table(spark, d, "raw_content"), table(spark, d, "findings"), ["content_hash"], ["collected_at", "id"]).select("id", "content_hash")


@query("finding_to_raw", "SELECT id, source AS source_type, source_id, sha256(content) AS content_hash, epoch_us(CASE WHEN posted_at > TIMESTAMPTZ '0001-01-02 00:00:00+00' THEN posted_at END) AS posted_at FROM findings")
def finding_to_raw(spark, d):
    return up.finding_to_raw(table(spark, d, "findings")).select("id", "source_type", "source_id", "content_hash", us("posted_at"))


@query("reset_old", "SELECT id, CASE WHEN classification_version IS NULL OR classification_version < 3 THEN false ELSE classified END AS classified FROM raw_content")
def reset_old(spark, d):
    return up.reset_old(table(spark, d, "raw_content")).select("id", "classified")


@query("upsert_iocs", f"""WITH {IOCS}, o AS (SELECT ioc_type AS type, ioc_value AS value, count(*) AS n, min(created_at) AS a, max(created_at) AS b FROM ioc_sightings WHERE created_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' GROUP BY ALL),
n AS (SELECT ioc_type AS type, ioc_value AS value, count(*) AS n, min(created_at) AS a, max(created_at) AS b FROM ioc_sightings WHERE created_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00' GROUP BY ALL)
SELECT coalesce(o.type, n.type) AS type, coalesce(o.value, n.value) AS value, coalesce(o.n, 0) + coalesce(n.n, 0) AS sighting_count, epoch_us(least(o.a, n.a)) AS first_seen, epoch_us(greatest(o.b, n.b)) AS last_seen, n.type IS NOT NULL OR o.type IS NOT NULL AS active
FROM o FULL JOIN n ON o.type = n.type AND o.value = n.value""")
def upsert_iocs(spark, d):
    s = table(spark, d, "ioc_sightings")
    edge = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    x = up.upsert_iocs(up.iocs_from_sightings(s.where(F.col("created_at") < edge)), s.where(F.col("created_at") >= edge))
    return x.select("type", "value", "sighting_count", us("first_seen"), us("last_seen"), "active")


@query("distinct_sightings", "SELECT ioc_type, ioc_value, raw_content_id, epoch_us(min(created_at)) AS created_at FROM ioc_sightings GROUP BY 1, 2, 3")
def distinct_sightings(spark, d):
    return up.distinct_sightings(table(spark, d, "ioc_sightings")).select("ioc_type", "ioc_value", "raw_content_id", us("created_at"))


@query("upsert_candidates", f"""WITH {CORRELATIONS} SELECT cluster_id, 'pending' AS status, CASE WHEN source_count >= 3 THEN 2 ELSE 1 END AS seen_count, source_count AS signal_count FROM correlations""")
def upsert_candidates(spark, d):
    x = co.shared_iocs(table(spark, d, "ioc_sightings"), table(spark, d, "raw_content"))
    c = x.select(cluster_id("shared_ioc", F.concat_ws(":", "ioc_type", "ioc_value")).alias("cluster_id"), F.lit("shared_ioc").alias("candidate_type"), F.array("ioc_type").alias("entity_ids"), "finding_ids", F.col("source_count").alias("signal_count"), F.lit("").alias("signals"), F.lit("pending").alias("status"))
    old = c.withColumn("seen_count", F.lit(1)).withColumn("signal_count", F.lit(0).cast("bigint"))
    return up.upsert_candidates(old, c.where("signal_count >= 3")).select("cluster_id", "status", "seen_count", F.when(F.col("seen_count") == 1, 2).otherwise(F.col("signal_count")).cast("bigint").alias("signal_count"))


@query("json_merge", """WITH ev AS (SELECT target_id AS id, 'last_relationship' AS k, relationship AS v, created_at, id AS eid FROM edges UNION ALL SELECT target_id, relationship, source_id, created_at, id FROM edges),
l AS (SELECT id, k, arg_max(v, (created_at, eid)) AS v FROM ev GROUP BY 1, 2)
SELECT id, string_agg(k || '=' || v, ',' ORDER BY k) AS properties FROM l GROUP BY id""")
def json_merge(spark, d):
    ev = table(spark, d, "edges").select(F.col("target_id").alias("id"), F.lit("x").alias("type"), F.map_from_arrays(F.array(F.lit("last_relationship"), F.col("relationship")), F.array("relationship", "source_id")).alias("properties"), F.struct("created_at", F.col("id").alias("eid")).alias("at"))
    x = up.merge_properties(ev)
    return x.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("properties"))


@query("missing_entities", f"WITH {IOCS} SELECT 'ioc:' || type || ':' || value AS id, CASE WHEN type LIKE 'hash%' THEN 'hash' ELSE type END AS type FROM iocs WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = 'ioc:' || iocs.type || ':' || iocs.value)")
def missing_entities(spark, d):
    return up.backfill_entities(iocs(spark, d), table(spark, d, "entities"), table(spark, d, "raw_content"))[0].select("id", "type")


@query("relabel_associated", """WITH o AS (SELECT id, coalesce(properties['observed'], 'false') = 'false' AS unseen FROM entities)
SELECT g.id, CASE WHEN g.relationship = 'associated_with' AND a.unseen AND b.unseen THEN 'referenced_in' ELSE g.relationship END AS relationship FROM edges g LEFT JOIN o a ON a.id = g.source_id LEFT JOIN o b ON b.id = g.target_id""")
def relabel_associated(spark, d):
    return up.relabel_associated(table(spark, d, "edges"), table(spark, d, "entities")).select("id", "relationship")


@query("ioc_decay", f"""WITH {IOCS}, t AS (SELECT type, value, base_score * exp(-0.3::DOUBLE * ((epoch_us({END_SQL}) - epoch_us(last_seen)) / 86400e6::DOUBLE) / CASE type WHEN 'ip' THEN 30.0::DOUBLE WHEN 'domain' THEN 90 WHEN 'url' THEN 14 WHEN 'hash_md5' THEN 365 WHEN 'hash_sha256' THEN 365 WHEN 'email' THEN 180 WHEN 'cve' THEN 180 WHEN 'crypto_wallet' THEN 365 ELSE 90 END) AS s FROM iocs)
SELECT type, value, round(s, 6) AS threat_score, s >= 0.1 AS active FROM t""")
def ioc_decay(spark, d):
    return up.decay(iocs(spark, d), as_of()).select("type", "value", rounded(F.col("threat_score"), "threat_score"), "active")


@query("ioc_cleanup", f"""WITH {IOCS} SELECT type, value, NOT (regexp_matches(value, '\\s') OR contains(value, '*') OR contains(value, '[.]') OR contains(value, '[:]') OR (type IN ('domain', 'url') AND (regexp_matches(value, '(?i)(^|://|\\.)(example\\.com|example\\.org|example\\.net)(/|$|:)') OR regexp_matches(value, '(?i)\\.(test|invalid|localhost|example)(/|$|:)')))) AS active FROM iocs""")
def ioc_cleanup(spark, d):
    return up.deactivate_by_pattern(iocs(spark, d)).select("type", "value", "active")


@query("source_normalize", "SELECT id, CASE WHEN type = 'telegram_channel' THEN regexp_replace(identifier, '^https?://t\\.me/', '') ELSE identifier END AS identifier FROM sources WHERE NOT (status = 'discovered' AND identifier LIKE '%chat%')")
def source_normalize(spark, d):
    return up.normalized_identifiers(up.delete_matching(table(spark, d, "sources"), ["%chat%"])).select("id", "identifier")


@query("garbage_actors", r"""SELECT id, (length(s) < 3 OR s LIKE '%\_bot' ESCAPE '\' OR t IN ('admin','support','bot','info','news','channel') OR s IN ('admin','support','bot','info','news','channel')) AS garbage
FROM (SELECT id, lower(trim(n)) AS t, regexp_replace(lower(n), '[\p{Cf}\p{Cc}\s\p{Z}]', '', 'g') AS s FROM (SELECT id, coalesce(properties['name'], split_part(id, ':', 3)) AS n FROM entities WHERE type = 'threat_actor'))""")
def garbage_actors(spark, d):
    name = F.coalesce(F.col("properties")["name"], F.split_part("id", F.lit(":"), F.lit(3)))
    return table(spark, d, "entities").where("type = 'threat_actor'").select("id", tx.garbage_handle(name).alias("garbage"))


# --- Graph ------------------------------------------------------------------------------------------------------------------
START_NODE = "(SELECT source_id FROM edges WHERE relationship = 'uses' ORDER BY source_id LIMIT 1)"


def _start(spark, d) -> str:
    first = table(spark, d, "edges").where("relationship = 'uses'").agg(F.min("source_id")).first()[0]
    return first or ""


@query("degree", "SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1")
def degree(spark, d):
    return gr.degrees(table(spark, d, "edges"))


@query("k_hop_graph", f"""WITH RECURSIVE b AS (SELECT source_id AS u, target_id AS v FROM edges UNION SELECT target_id, source_id FROM edges),
r(id, depth) AS (SELECT {START_NODE}, 0 UNION SELECT b.v, r.depth + 1 FROM r JOIN b ON b.u = r.id WHERE r.depth < 2),
n AS (SELECT DISTINCT id FROM r) SELECT id FROM edges WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)""")
def k_hop_graph(spark, d):
    e = table(spark, d, "edges")
    return gr.k_hop_edges(e, _start(spark, d), 2).select("id")


@query("neighbors", f"""SELECT x.id, e.type, coalesce(e.properties['name'], e.id) AS name, x.relationship, x.direction FROM (SELECT target_id AS id, relationship, 'outgoing' AS direction FROM edges WHERE source_id = {START_NODE}
UNION ALL SELECT source_id, relationship, 'incoming' FROM edges WHERE target_id = {START_NODE}) x JOIN entities e ON e.id = x.id""")
def neighbors(spark, d):
    return gr.neighbours(table(spark, d, "edges"), table(spark, d, "entities"), _start(spark, d)).select("id", "type", "name", "relationship", "direction")


@query("trending", f"""WITH i AS (SELECT source_id AS id, source_id || target_id AS l, created_at FROM edges UNION ALL SELECT target_id, source_id || target_id, created_at FROM edges WHERE target_id <> source_id)
SELECT i.id, e.type, count(DISTINCT l) FILTER (i.created_at >= {START_SQL}) AS current, count(DISTINCT l) FILTER (i.created_at <= {START_SQL}) AS previous
FROM i JOIN entities e ON e.id = i.id WHERE i.created_at BETWEEN {BEFORE_SQL} AND {END_SQL} GROUP BY 1, 2 HAVING count(DISTINCT l) FILTER (i.created_at >= {START_SQL}) > 0""")
def trending(spark, d):
    return gr.trending(table(spark, d, "entities"), table(spark, d, "edges"), START, BEFORE, END).select("id", "type", "current", "previous")


@query("bridge_iocs", """SELECT DISTINCT 'edge:ioc:' || s.ioc_type || ':' || s.ioc_value || ':source:' || n || ':found_in' AS id, 'ioc:' || s.ioc_type || ':' || s.ioc_value AS source_id, 'source:' || n AS target_id
FROM ioc_sightings s JOIN (SELECT id, coalesce(nullif(source_name, ''), source_id) AS n FROM raw_content) r ON r.id = s.raw_content_id""")
def bridge_iocs(spark, d):
    i = table(spark, d, "ioc_sightings").select(F.col("raw_content_id").alias("record_id"), F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"), F.lit("").alias("context"))
    return gr.bridge_iocs(table(spark, d, "raw_content"), i)[1].select("id", "source_id", "target_id")


@query("resolved_names", f"""WITH {SHARED}, x AS (SELECT 'corr:shared_ioc:' || sha256(ioc_type || ':' || ioc_value) AS cluster_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS p FROM shared),
g AS (SELECT DISTINCT target_id AS id FROM edges WHERE target_id LIKE 'source:%') SELECT cluster_id, string_agg(g.id, ',' ORDER BY p) AS names FROM x JOIN g ON g.id = 'source:' || x.s GROUP BY 1""")
def resolved_names(spark, d):
    x = co.shared_iocs(table(spark, d, "ioc_sightings"), table(spark, d, "raw_content"))
    groups = x.select(cluster_id("shared_ioc", F.concat_ws(":", "ioc_type", "ioc_value")).alias("cluster_id"), F.transform("sources", lambda s: source_entity_id(s)).alias("entity_ids"))
    nodes = table(spark, d, "edges").where("target_id like 'source:%'").select(F.col("target_id").alias("id")).distinct().withColumn("properties", F.create_map(F.lit("name"), F.col("id")))
    return gr.resolved_names(groups, nodes).select("cluster_id", joined("names"))


RECORD = "(SELECT min(raw_content_id) FROM ioc_sightings)"


@query("names_for_record", f"""SELECT DISTINCT coalesce(e.properties['name'], x.id) AS name FROM (SELECT source_id AS id FROM edges WHERE properties['raw_content_id'] = {RECORD} UNION SELECT 'ioc:' || ioc_type || ':' || ioc_value FROM ioc_sightings WHERE raw_content_id = {RECORD}) x LEFT JOIN entities e ON e.id = x.id ORDER BY 1 LIMIT 50""")
def names_for_record(spark, d):
    rid = table(spark, d, "ioc_sightings").agg(F.min("raw_content_id")).first()[0]
    return gr.names_for_record(table(spark, d, "edges"), table(spark, d, "entities"), table(spark, d, "ioc_sightings"), rid or "")


@query("actor_dossier")
def actor_dossier(spark, d):
    actor = table(spark, d, "edges").where("source_id like 'entity:threat_actor:%'").agg(F.min("source_id")).first()[0]
    return gr.dossier(actor or "", table(spark, d, "entities"), table(spark, d, "edges"), table(spark, d, "raw_content"), correlations(spark, d), notes(spark, d))


@query("active_actors", """WITH a AS (SELECT id, created_at FROM entities WHERE type = 'threat_actor' AND NOT dismissed ORDER BY created_at DESC, id LIMIT 40),
r AS (SELECT g.source_id AS id, count(DISTINCT c.id) AS recent FROM edges g JOIN raw_content c ON c.id = g.properties['raw_content_id'] WHERE c.collected_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' GROUP BY 1)
SELECT a.id, r.recent FROM a JOIN r ON r.id = a.id ORDER BY a.created_at DESC, a.id LIMIT 10""")
def active_actors(spark, d):
    return gr.active_actors(table(spark, d, "entities"), table(spark, d, "edges"), table(spark, d, "raw_content"), datetime(2025, 6, 1, tzinfo=timezone.utc))


# --- Worth of sources, briefs, vulnerabilities --------------------------------------------------------------------------------
UNIQUE = """t AS (SELECT DISTINCT ioc_type, ioc_value, source_id AS src, epoch_us(created_at) AS at FROM ioc_sightings WHERE source_id IS NOT NULL),
uniq AS (SELECT src, count(DISTINCT ioc_value) AS unique_iocs FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.ioc_type = t.ioc_type AND o.ioc_value = t.ioc_value AND o.src <> t.src AND o.at < t.at AND o.at > t.at - 604800000000) GROUP BY src)"""


@query("unique_iocs", f"WITH {UNIQUE} SELECT src, unique_iocs FROM uniq")
def unique_iocs(spark, d):
    return va.unique_iocs(table(spark, d, "ioc_sightings"))


CONTRIB = "contrib AS (SELECT r.source_id AS src, count(DISTINCT cluster_id) AS contributions FROM (SELECT DISTINCT cluster_id, unnest(finding_ids) AS id FROM correlations) x JOIN raw_content r ON r.id = x.id WHERE r.source_id IS NOT NULL GROUP BY 1)"


@query("correlation_contrib", f"WITH {CORRELATIONS}, {CONTRIB} SELECT src, contributions FROM contrib")
def correlation_contrib(spark, d):
    return va.correlation_contributions(correlations(spark, d), table(spark, d, "raw_content"))


@query("source_value", f"""WITH {CORRELATIONS}, {CONTRIB}, {UNIQUE},
m AS (SELECT source_id AS src, count(*) FILTER (classified) AS total, count(*) FILTER (classified AND category IS NOT NULL AND category <> 'irrelevant') AS relevant,
  coalesce(avg(CASE severity WHEN 'critical' THEN 4.0::DOUBLE WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) FILTER (classified AND category IS NOT NULL AND category <> 'irrelevant'), 0) AS sev, max(collected_at) AS lc FROM raw_content WHERE source_id IS NOT NULL GROUP BY 1),
v AS (SELECT m.*, coalesce(unique_iocs, 0) AS unique_iocs, coalesce(contributions, 0) AS contributions, CASE WHEN total > 0 THEN relevant::DOUBLE / total ELSE 0 END AS s2n, coalesce(exp(-(epoch_us({END_SQL}) - epoch_us(lc)) / 3.6e9::DOUBLE / 24), 0) AS fresh FROM m LEFT JOIN uniq USING (src) LEFT JOIN contrib USING (src))
SELECT src, total, relevant, unique_iocs, contributions, round(sev, 6) AS avg_severity, round(least(1.0::DOUBLE, 0.3::DOUBLE * CASE WHEN total > 0 THEN unique_iocs::DOUBLE / total ELSE 0 END + 0.2::DOUBLE * CASE WHEN total > 0 THEN contributions::DOUBLE / total ELSE 0 END + 0.2::DOUBLE * sev / 4 + 0.15::DOUBLE * s2n + 0.15::DOUBLE * fresh), 6) AS value_score FROM v""")
def source_value(spark, d):
    x = va.source_values(table(spark, d, "raw_content"), table(spark, d, "ioc_sightings"), correlations(spark, d), as_of())
    return x.select("src", "total", "relevant", "unique_iocs", "contributions", rounded(F.col("avg_severity"), "avg_severity"), rounded(F.col("value_score"), "value_score"))


@query("content_count_or", """WITH s AS (SELECT id, name, identifier, regexp_replace(identifier, '^https?://t\\.me/', '') AS username FROM sources), c AS (SELECT source_name, min(source_id) AS ch FROM raw_content WHERE source_type = 'telegram' GROUP BY 1),
k AS (SELECT s.*, c.ch FROM s LEFT JOIN c ON c.source_name = s.username),
m AS (SELECT k.id, r.id AS rid FROM k JOIN raw_content r ON r.source_name = k.name UNION SELECT k.id, r.id FROM k JOIN raw_content r ON r.source_name = k.username UNION SELECT k.id, r.id FROM k JOIN raw_content r ON r.source_id = k.identifier UNION SELECT k.id, r.id FROM k JOIN raw_content r ON r.source_id = k.ch)
SELECT s.id, s.name, count(m.rid) AS content_count FROM sources s LEFT JOIN m ON m.id = s.id GROUP BY 1, 2""")
def content_count_or(spark, d):
    return va.content_counts(table(spark, d, "sources"), table(spark, d, "raw_content"))


@query("source_activity", f"SELECT s.name, s.type, count(r.id) AS findings FROM sources s LEFT JOIN raw_content r ON r.source_name = s.name AND r.collected_at BETWEEN {BEFORE_SQL} AND {END_SQL} GROUP BY 1, 2")
def source_activity(spark, d):
    return va.source_activity(table(spark, d, "sources"), table(spark, d, "raw_content"), BEFORE, END)


@query("brief_metrics", f"""SELECT 'severity' AS metric, coalesce(severity, 'info') AS key, count(*) AS count FROM raw_content WHERE collected_at BETWEEN {BEFORE_SQL} AND {END_SQL} GROUP BY 2
UNION ALL SELECT 'category', coalesce(category, 'uncategorized'), count(*) FROM raw_content WHERE collected_at BETWEEN {BEFORE_SQL} AND {END_SQL} GROUP BY 2
UNION ALL SELECT 'ioc', ioc_type, count(*) FROM (SELECT DISTINCT ioc_type, ioc_value FROM ioc_sightings WHERE created_at BETWEEN {BEFORE_SQL} AND {END_SQL}) GROUP BY 2""")
def brief_metrics(spark, d):
    return va.brief_metrics(table(spark, d, "raw_content"), table(spark, d, "ioc_sightings"), BEFORE, END)


@query("daily_brief")
def daily_brief(spark, d):
    return va.daily_brief(*[table(spark, d, n) for n in ("raw_content", "ioc_sightings", "entities", "edges")], datetime(2026, 6, 2, tzinfo=timezone.utc))


@query("vuln_priority", f"WITH {VULNS} SELECT cve_id, mention_count, kev_listed, round(priority_score, 6) AS priority_score, priority_label FROM vulnerabilities")
def vuln_priority(spark, d):
    return vulnerabilities(spark, d).select("cve_id", "mention_count", "kev_listed", rounded(F.col("priority_score"), "priority_score"), "priority_label")


@query("exploit_semi", "SELECT DISTINCT upper(ioc_value) AS cve_id FROM ioc_sightings s WHERE ioc_type = 'cve' AND EXISTS (SELECT 1 FROM raw_content r WHERE r.id = s.raw_content_id AND r.sub_category IN ('exploit_poc', 'exploit_weaponized'))")
def exploit_semi(spark, d):
    r = table(spark, d, "raw_content").where(F.col("sub_category").isin("exploit_poc", "exploit_weaponized")).select(F.col("id").alias("raw_content_id"))
    return table(spark, d, "ioc_sightings").where("ioc_type = 'cve'").join(r, "raw_content_id", "left_semi").select(F.upper("ioc_value").alias("cve_id")).distinct()


@query("upsert_vulnerabilities", f"WITH {VULNS} SELECT cve_id, epss_score, CASE WHEN cve_id LIKE '%1' THEN 5.0::DOUBLE ELSE cvss_v31_score END AS cvss_v31_score, kev_listed FROM vulnerabilities")
def upsert_vulnerabilities(spark, d):
    v = vulnerabilities(spark, d)
    new = v.select("cve_id", F.lit(None).cast("double").alias("epss_score"), F.lit(5.0).alias("cvss_v31_score"), F.lit(False).alias("kev_listed")).where("cve_id like '%1'")
    return up.upsert_vulnerabilities(v.select("cve_id", "epss_score", "cvss_v31_score", "kev_listed"), new, strict_parity=False)


# --- Text -----------------------------------------------------------------------------------------------------------------------
RULES = [
    tx.Rule("ransom", "keyword", ("ransomware", "locker"), "critical"),
    tx.Rule("cve", "regex", (r"CVE-\d{4}-\d{4,}",), "high"),
    tx.Rule("access", "keyword", ("vpn", "доступ"), "medium"),
]


@query("matcher", r"""SELECT id, array_to_string(list_filter([CASE WHEN a THEN 'ransom' END, CASE WHEN b THEN 'cve' END, CASE WHEN c THEN 'access' END], lambda x: x IS NOT NULL), ',') AS rules,
CASE WHEN a THEN 'critical' WHEN b THEN 'high' WHEN c THEN 'medium' ELSE 'info' END AS severity, CASE WHEN (a OR c) AND b THEN 'keyword+regex' WHEN a OR c THEN 'keyword' WHEN b THEN 'regex' ELSE '' END AS match_type
FROM (SELECT id, contains(lower(coalesce(content, '')), 'ransomware') OR contains(lower(coalesce(content, '')), 'locker') AS a, regexp_matches(coalesce(content, ''), 'CVE-\d{4}-\d{4,}') AS b, contains(lower(coalesce(content, '')), 'vpn') OR contains(lower(coalesce(content, '')), 'доступ') AS c FROM raw_content)""")
def matcher(spark, d):
    m = tx.match(F.col("content"), RULES)
    return table(spark, d, "raw_content").select("id", m.alias("m")).select("id", joined("m.rules", "rules"), "m.severity", "m.match_type")


_O = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
RESCUE = rf"""x AS (SELECT id, regexp_replace(coalesce(content, ''), '^[\s\x{{0b}}\x{{85}}\p{{Z}}]+|[\s\x{{0b}}\x{{85}}\p{{Z}}]+$', '', 'g') AS c FROM raw_content),
m AS (SELECT id, c, regexp_replace(regexp_replace(c, '(?i)\b(?:https?|hxxps?|ftp)://\S{{4,}}', ' ', 'g'), '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}\b', ' ', 'g') AS k FROM x),
r AS (SELECT id, c, regexp_matches(c, '(?i)\bCVE-[0-9]{{4}}-[0-9]{{4,}}\b') OR regexp_matches(c, '\b(?:[a-fA-F0-9]{{64}}|[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{32}})\b') OR regexp_matches(c, '\b(?:{_O}\.){{3}}{_O}(?::[0-9]{{1,5}})?\b')
  OR regexp_matches(c, '\b(?:bc1[a-z0-9]{{25,87}}|[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}|0x[a-fA-F0-9]{{40}})\b')
  OR len(list_filter(regexp_extract_all(c, '(?i)\b(?:https?|hxxps?|ftp)://\S{{4,}}'), lambda v: NOT regexp_matches(lower(v), 'example\.(com|org|net)'))) > 0
  OR len(list_filter(regexp_extract_all(c, '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}\b'), lambda v: NOT regexp_matches(lower(v), 'example\.(com|org|net)'))) > 0
  OR len(list_filter(regexp_extract_all(k, '[A-Za-z0-9._@-]{{3,}}:[^\s:]{{4,}}'), lambda v: lower(v) NOT IN ('user:pass', 'user:password', 'username:password'))) > 0
  OR len(list_filter(regexp_extract_all(k, '(?i)\b(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,24}}\b'), lambda v: NOT regexp_matches(lower(v), 'example\.(com|org|net)') AND NOT regexp_matches(lower(v), '\.(jpg|jpeg|png|gif|webp|bmp|svg|ico|mp4|avi|mov|webm|mp3)$'))) > 0 AS rescued FROM m)"""


@query("junk_gate", f"WITH {RESCUE} SELECT id, (length(regexp_replace(c, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) < 10 OR regexp_matches(c, '^@?[A-Za-z0-9_]{{3,32}}$')) AND NOT rescued AS junk, rescued FROM r")
def junk_gate(spark, d):
    return table(spark, d, "raw_content").select("id", tx.is_junk(F.col("content")).alias("junk"), tx.ioc_rescue(F.col("content")).alias("rescued"))


@query("extract_iocs")
def extract_iocs(spark, d):
    x = table(spark, d, "raw_content").select("id", F.explode(tx.extract_iocs(F.col("content"))).alias("kind", "values"))
    return x.select("id", "kind", F.explode("values").alias("value"))


@query("extract_cves", r"""WITH x AS (SELECT id, regexp_replace(regexp_replace(coalesce(content, ''), '(?i)\b(?:https?|hxxps?|ftp)://[^\s<>"'')]+', ' ', 'g'), '(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b', ' ', 'g') AS c FROM raw_content)
SELECT DISTINCT id, upper(unnest(regexp_extract_all(c, '(?i)\bCVE-\d{4}-\d{4,7}\b'))) AS cve FROM x""")
def extract_cves(spark, d):
    x = table(spark, d, "raw_content").select("id", F.explode(tx.extract_iocs(F.col("content"))["cve"]).alias("cve"))
    return x.select("id", "cve")


@query("junk_reason")
def junk_reason(spark, d):
    return table(spark, d, "raw_content").select("id", tx.junk_reason(F.col("content")).alias("reason"))


@query("rule_scan")
def rule_scan(spark, d):
    """Junk by reason with its share and up to eight samples of each."""
    x = table(spark, d, "raw_content").select("id", "category", tx.junk_reason(F.col("content")).alias("reason")).where("reason is not null")
    n = x.groupBy("reason").agg(F.count(F.lit(1)).alias("count"))
    return n.join(rd.top_per(x, ["reason"], [F.col("id")], 8).groupBy("reason").agg(F.sort_array(F.collect_list("id")).alias("s")), "reason").select("reason", "count", joined("s", "samples"))


@query("mask_iocs")
def mask_iocs(spark, d):
    return table(spark, d, "raw_content").select("id", tx.mask_iocs(F.col("content")).alias("masked"))


@query("ioc_validate", r"""SELECT DISTINCT ioc_type, ioc_value, (contains(v, ' ') OR contains(v, chr(9)) OR contains(v, '*') OR contains(v, '[.]') OR contains(v, '[:]') OR (ioc_type = 'ip' AND (NOT regexp_matches(v, '^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$') OR regexp_matches(v, '^(10\.|127\.|192\.168\.|169\.254\.|0\.0\.0\.0$|224\.0\.0\.|172\.(1[6-9]|2\d|3[01])\.)')))
OR (ioc_type IN ('domain', 'url') AND (h = '' OR h IN ('example.com', 'example.org', 'example.net') OR regexp_matches(h, '\.(example\.com|example\.org|example\.net)$') OR regexp_matches(h, '\.(test|invalid|localhost|example)$')))) AS rejected
FROM (SELECT ioc_type, ioc_value, ioc_value AS v, lower(CASE WHEN ioc_type = 'url' THEN regexp_replace(regexp_replace(regexp_extract(regexp_replace(ioc_value, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*'), '^[^@]*@', ''), ':\d*$', '') ELSE regexp_replace(ioc_value, ':\d+$', '') END) AS h FROM ioc_sightings)""")
def ioc_validate(spark, d):
    x = table(spark, d, "ioc_sightings").select("ioc_type", "ioc_value").distinct()
    return x.select("ioc_type", "ioc_value", tx.rejected_ioc(F.col("ioc_type"), F.col("ioc_value")).alias("rejected"))


@query("script_bucket", r"""SELECT id, CASE WHEN n = 0 THEN 'other' WHEN c = greatest(c, l, n - c - l) THEN 'cyrillic' WHEN l = greatest(c, l, n - c - l) THEN 'latin' ELSE 'other' END AS script FROM (SELECT id, length(x) AS n, length(regexp_replace(x, '[^\x{0400}-\x{052F}]', '', 'g')) AS c, length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS l FROM (SELECT id, regexp_replace(coalesce(content, ''), '[^\p{L}]', '', 'g') AS x FROM raw_content))""")
def script_bucket(spark, d):
    return table(spark, d, "raw_content").select("id", tx.script_of(F.col("content")).alias("script"))


@query("html_clean", r"SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[\s\x{0b}\x{85}\p{Z}]+', ' ', 'g')) AS cleaned FROM documents")
def html_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("url_discovery")
def url_discovery(spark, d):
    return ur.discover(table(spark, d, "raw_content"), ur.DiscoveryConfig(allow_patterns=("*.onion", "pastebin.com"), monitored=("padordor1",)))


@query("url_classify", r"""WITH u AS (SELECT DISTINCT ioc_value AS url, lower(ioc_value) AS l FROM ioc_sightings WHERE ioc_type = 'url')
SELECT url, CASE WHEN contains(l, 't.me/joinchat/') OR contains(l, 't.me/+') THEN 'telegram_group' WHEN contains(l, 't.me/') THEN 'telegram_channel' WHEN contains(l, '.onion') THEN 'forum' WHEN contains(l, 'pastebin.com') OR contains(l, 'ghostbin.') OR contains(l, 'privatebin.') OR contains(l, 'rentry.co') THEN 'paste_site'
WHEN l LIKE '%.xml' OR contains(l, '/feed') OR contains(l, '/rss') OR contains(l, '/atom') THEN 'rss' ELSE 'web' END AS type, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*'), '^[^@]*@', ''), ':\d*$', '')) ELSE '' END AS host FROM u""")
def url_classify(spark, d):
    u = table(spark, d, "ioc_sightings").where("ioc_type = 'url'").select(F.col("ioc_value").alias("url")).distinct()
    return u.select("url", ur.classify_source(F.col("url")).alias("type"), ur.host_of(F.col("url")).alias("host"))


# --- Dataset -----------------------------------------------------------------------------------------------------------------------
@query("dedup_first", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY content_hash ORDER BY collected_at, id) AS n FROM raw_content) WHERE n = 1")
def dedup_first(spark, d):
    return ds.first_by_hash(table(spark, d, "raw_content")).select("id")


@query("temporal_split", "SELECT id, CASE WHEN p <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (ORDER BY collected_at NULLS FIRST, id) AS p, count(*) OVER () AS n FROM raw_content)")
def temporal_split(spark, d):
    return ds.temporal_split(table(spark, d, "raw_content").select("id", "collected_at")).select("id", "split")


@query("label_conflicts", "SELECT content_hash, count(DISTINCT label) AS labels FROM stage1 GROUP BY 1 HAVING count(DISTINCT label) > 1")
def label_conflicts(spark, d):
    return ds.label_conflicts(table(spark, d, "stage1"))


@query("split_stats", "SELECT split, label, language, count(*) AS rows FROM stage1 GROUP BY ALL")
def split_stats(spark, d):
    return ds.split_stats(table(spark, d, "stage1"))


@query("macro_f1", """WITH p AS (SELECT label AS y, CASE WHEN language = 'cyrillic' THEN 'relevant' ELSE 'irrelevant' END AS z FROM stage1), c AS (SELECT y AS class FROM p UNION SELECT z FROM p),
m AS (SELECT class, (SELECT count(*) FROM p WHERE y = class AND z = class)::DOUBLE AS tp, (SELECT count(*) FROM p WHERE z = class)::DOUBLE AS pr, (SELECT count(*) FROM p WHERE y = class) AS support FROM c)
SELECT class, round(CASE WHEN pr > 0 THEN tp / pr ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / pr) * (tp / support) / (tp / pr + tp / support) ELSE 0 END, 6) AS f1, support FROM m""")
def macro_f1(spark, d):
    x = table(spark, d, "stage1").select(F.col("label").alias("y"), F.when(F.col("language") == "cyrillic", "relevant").otherwise("irrelevant").alias("z"))
    return ds.class_metrics(x).select("class", *[rounded(F.col(c), c) for c in ("precision", "recall", "f1")], "support")


@query("recall_sweep", """WITH s AS (SELECT length(text) AS score, label = 'relevant' AS pos FROM stage1), b AS (SELECT score, count(*) FILTER (pos) AS p, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS f, sum(p) OVER () AS a FROM b), t AS (SELECT * FROM c WHERE tp >= 0.97::DOUBLE * a ORDER BY score DESC LIMIT 1)
SELECT score::DOUBLE AS threshold, round(tp::DOUBLE / a, 6) AS recall, round(tp::DOUBLE / f, 6) AS precision FROM t""")
def recall_sweep(spark, d):
    x = table(spark, d, "stage1").select(F.length("text").cast("double").alias("score"), (F.col("label") == "relevant").alias("positive"))
    return ds.recall_threshold(x).select("threshold", rounded(F.col("recall"), "recall"), rounded(F.col("precision"), "precision"))


@query("verdict_summary", """WITH v AS (SELECT language AS sheet, CASE WHEN split = 'train' THEN 'pending' WHEN split = 'val' THEN 'correct' ELSE 'error' END AS k FROM stage1)
SELECT sheet, count(*) FILTER (k = 'correct') AS correct, count(*) FILTER (k = 'error') AS error, count(*) FILTER (k = 'pending') AS pending, round(count(*) FILTER (k = 'error')::DOUBLE / nullif(count(*) FILTER (k IN ('correct', 'error')), 0), 6) AS error_rate FROM v GROUP BY 1""")
def verdict_summary(spark, d):
    v = F.when(F.col("split") == "train", "").when(F.col("split") == "val", "OK").otherwise("wrong")
    x = ds.verdict_summary(table(spark, d, "stage1").select(F.col("language").alias("sheet"), v.alias("verdict")))
    return x.select("sheet", "correct", "error", "pending", rounded(F.col("error_rate"), "error_rate"))


@query("dataset_assembly")
def dataset_assembly(spark, d):
    r = table(spark, d, "raw_content").where("classified")
    rows = r.select("id", "content", "content_hash", "collected_at", tx.junk_reason(F.col("content")).isNotNull().alias("is_noise"), F.when(F.col("category") == "irrelevant", "irrelevant").otherwise("relevant").alias("label"))
    return ds.assemble(rows, table(spark, d, "stage1").where("split = 'test'").select("id"))


@query("stratified_sample")
def stratified_sample(spark, d):
    return ds.stratified_sample(table(spark, d, "stage1").select("id", "label"), {"relevant": 50, "irrelevant": 50})


@query("spending", """SELECT source_id AS client, epoch_us(collected_at) AS at, round(sum(tokens / 1e6::DOUBLE * 2.0::DOUBLE) OVER (PARTITION BY source_id, strftime(make_timestamp(epoch_us(collected_at)), '%Y-%m') ORDER BY collected_at, id ROWS UNBOUNDED PRECEDING), 6) AS spent
FROM (SELECT id, source_id, collected_at, floor(length(content) / 4) + 50 + 256 AS tokens FROM raw_content WHERE content IS NOT NULL)""")
def spending(spark, d):
    x = table(spark, d, "raw_content").where("content is not null").select(F.col("source_id").alias("client"), "id", F.col("collected_at").alias("at"), sc.token_estimate(F.length("content")).alias("tokens"))
    return st.spending(x, 1.0, 2.0, ("id",)).select("client", us("at"), rounded(F.col("spent"), "spent"))


@query("token_bucket")
def token_bucket(spark, d):
    x = table(spark, d, "raw_content").where("content is not null").select(F.col("source_id").alias("client"), (F.unix_micros("collected_at") / 1e6).alias("at"), sc.token_estimate(F.length("content")).cast("double").alias("tokens"))
    return st.token_bucket(x, 1500, 50_000)


@query("ingest_metrics", f"""WITH {RESCUE.replace("FROM raw_content", "FROM findings")},
j AS (SELECT id, (length(regexp_replace(c, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) < 10 OR regexp_matches(c, '^@?[A-Za-z0-9_]{{3,32}}$')) AND NOT rescued AS junk FROM r),
h AS (SELECT id, source, contains(l, 'ransomware') OR contains(l, 'locker') OR contains(l, 'vpn') OR contains(l, 'доступ') OR regexp_matches(o, 'CVE-\\d{{4}}-\\d{{4,}}') AS hit FROM (SELECT id, source, lower(coalesce(content, '')) AS l, coalesce(content, '') AS o FROM findings))
SELECT source, count(*) AS collected, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS dropped, count(*) FILTER (junk) AS junk FROM h JOIN j USING (id) GROUP BY 1""")
def ingest_metrics(spark, d):
    return st.metrics(table(spark, d, "findings"), RULES)


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


from tidewatch.plans import registry_more  # noqa: E402, F401
from tidewatch.plans import registry_fixtures  # noqa: E402, F401
