"""More queries with their SQL: pages of derived tables, state changes, classification helpers, discovery and counters."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewatch.functions import plug
from tidewatch.functions import scalar as sc
from tidewatch.functions import text as tx
from tidewatch.functions import urls as ur
from tidewatch.operators import dataset as ds
from tidewatch.operators import graph as gr
from tidewatch.operators import reads as rd
from tidewatch.operators import upsert as up
from tidewatch.operators import value as va
from tidewatch.plans.adapters import AS_OF_SQL, CORRELATIONS, IOCS, NOTES, VULNS, as_of, correlations, iocs, notes, vulnerabilities
from tidewatch.plans.registry import BEFORE, BEFORE_SQL, END, joined, query, rounded, us
from tidewatch.schemas import CATEGORY_TAG, SUB_CATEGORIES
from tidewatch.sources import feeds
from tidewatch.streaming import pipeline as st
from tidewatch.tables import table

RELEVANT = "classified AND category IS NOT NULL AND category <> 'irrelevant'"


# --- Counts and overviews ---
@query("public_stats", f"SELECT count(*) AS total, count(*) FILTER ({RELEVANT}) AS relevant, count(DISTINCT source_id) AS sources, count(DISTINCT author) AS authors FROM raw_content")
def public_stats(spark, d):
    return table(spark, d, "raw_content").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr(RELEVANT)).alias("relevant"), F.countDistinct("source_id").alias("sources"), F.countDistinct("author").alias("authors"))


@query("archive_stats", "SELECT source_type, coalesce(category, '') AS category, count(*) AS count FROM raw_content GROUP BY 1, 2")
def archive_stats(spark, d):
    return rd.counts_by(table(spark, d, "raw_content"), F.col("source_type"), F.coalesce("category", F.lit("")).alias("category"))


@query("overview_kpis", f"""WITH {CORRELATIONS} SELECT (SELECT count(*) FROM raw_content WHERE collected_at BETWEEN {BEFORE_SQL} AND {AS_OF_SQL}) AS findings, (SELECT count(*) FROM raw_content WHERE severity = 'critical' AND collected_at BETWEEN {BEFORE_SQL} AND {AS_OF_SQL}) AS critical,
(SELECT count(*) FROM entities WHERE type = 'threat_actor' AND NOT dismissed) AS actors, (SELECT count(*) FROM entities WHERE type = 'campaign' AND NOT dismissed) AS campaigns, (SELECT count(*) FROM correlations WHERE is_correlation) AS correlations, (SELECT count(*) FROM sources WHERE status IN ('active', 'approved')) AS sources""")
def overview_kpis(spark, d):
    recent = table(spark, d, "raw_content").where(F.col("collected_at").between(F.lit(BEFORE), F.lit(END)))
    e = table(spark, d, "entities").where("not dismissed")
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(
        count(recent).alias("findings"), count(recent.where("severity = 'critical'")).alias("critical"), count(e.where("type = 'threat_actor'")).alias("actors"), count(e.where("type = 'campaign'")).alias("campaigns"),
        count(correlations(spark, d).where("is_correlation")).alias("correlations"), count(table(spark, d, "sources").where(F.col("status").isin("active", "approved"))).alias("sources"),
    )


@query("campaigns_confident", f"WITH {CORRELATIONS} SELECT cluster_id, round(confidence, 6) AS confidence FROM correlations WHERE confidence > 0.5 ORDER BY correlations.confidence DESC, cluster_id LIMIT 20")
def campaigns_confident(spark, d):
    return rd.page(correlations(spark, d).where("confidence > 0.5"), [F.desc("confidence"), F.col("cluster_id")], 20).select("cluster_id", rounded(F.col("confidence"), "confidence"))


@query("notes_for_entities", f"WITH {NOTES} SELECT id, entity_id FROM notes WHERE status = 'active' AND entity_id IN (SELECT author FROM raw_content WHERE severity = 'critical') ORDER BY created_at DESC, id LIMIT 20")
def notes_for_entities(spark, d):
    some = table(spark, d, "raw_content").where("severity = 'critical'").select(F.col("author").alias("entity_id"))
    return rd.page(rd.semi(rd.notes(notes(spark, d)), some, "entity_id"), [F.desc("created_at"), F.col("id")], 20).select("id", "entity_id")


@query("pending_candidates", f"WITH {CORRELATIONS} SELECT cluster_id, source_count AS signal_count FROM correlations WHERE NOT is_correlation ORDER BY source_count DESC, cluster_id LIMIT 10")
def pending_candidates(spark, d):
    from tidewatch.operators.correlate import shared_iocs
    from tidewatch.schemas import cluster_id

    x = shared_iocs(table(spark, d, "ioc_sightings"), table(spark, d, "raw_content")).where("source_count < 3")
    return rd.page(x.select(cluster_id("shared_ioc", F.concat_ws(":", "ioc_type", "ioc_value")).alias("cluster_id"), F.col("source_count").alias("signal_count")), [F.desc("signal_count"), F.col("cluster_id")], 10)


@query("unenriched_iocs", f"WITH {IOCS} SELECT type, value FROM iocs WHERE active AND type IN ('ip', 'domain') ORDER BY type, value LIMIT 20")
def unenriched_iocs(spark, d):
    x = iocs(spark, d).withColumn("enriched_at", F.lit(None).cast("timestamp")).where("active and enriched_at is null").where(F.col("type").isin("ip", "domain"))
    return rd.page(x.select("type", "value"), [F.col("type"), F.col("value")], 20)


@query("iocs_of_finding", f"WITH {IOCS} SELECT source_content_id AS id, type, value, sighting_count FROM iocs WHERE source_content_id = (SELECT min(source_content_id) FROM iocs)")
def iocs_of_finding(spark, d):
    t = iocs(spark, d)
    rid = t.agg(F.min("source_content_id")).first()[0] or ""
    return rd.finding_with_iocs(table(spark, d, "raw_content"), t, rid).select("id", F.explode("iocs").alias("x")).select("id", "x.*")


# --- State changes ---
@query("mark_classified", "SELECT r.id, coalesce(CASE WHEN l.id IS NOT NULL THEN l.label END, r.category) AS category, r.classified OR l.id IS NOT NULL AS classified FROM raw_content r LEFT JOIN (SELECT DISTINCT id, label FROM stage1 WHERE split = 'val') l ON l.id = r.id")
def mark_classified(spark, d):
    new = table(spark, d, "stage1").where("split = 'val'").select("id", F.col("label").alias("category")).distinct()
    return up.update_from(table(spark, d, "raw_content"), new, "id", ["category"], "classified").select("id", "category", "classified")


@query("backfill_sightings", f"WITH {IOCS} SELECT i.type AS ioc_type, i.value AS ioc_value, r.id AS raw_content_id, r.source_id FROM iocs i JOIN raw_content r ON r.id = i.source_content_id WHERE NOT EXISTS (SELECT 1 FROM ioc_sightings s WHERE s.ioc_type = i.type AND s.ioc_value = i.value AND s.raw_content_id = r.id AND s.created_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00')")
def backfill_sightings(spark, d):
    late = table(spark, d, "ioc_sightings").where(F.col("created_at") >= F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return up.backfill_sightings(iocs(spark, d), table(spark, d, "raw_content"), late).select("ioc_type", "ioc_value", "raw_content_id", "source_id")


@query("upsert_correlations", f"WITH {CORRELATIONS} SELECT cluster_id, CASE WHEN source_count >= 3 THEN 'first' ELSE 'rule' END AS method, round(confidence, 6) AS confidence FROM correlations")
def upsert_correlations(spark, d):
    new = correlations(spark, d).withColumn("evidence", F.lit(""))
    old = new.where("is_correlation").withColumn("method", F.lit("first")).withColumn("confidence", F.lit(0.0))
    return up.upsert_correlations(old, new).select("cluster_id", "method", rounded(F.col("confidence"), "confidence"))


@query("upsert_edges", "SELECT source_id || target_id AS id, epoch_us(min(created_at)) AS created_at FROM edges GROUP BY 1")
def upsert_edges(spark, d):
    e = table(spark, d, "edges").withColumn("id", F.concat("source_id", "target_id"))
    return up.upsert_edges(e).select("id", us("created_at"))


@query("lifetime_defaults", f"WITH {IOCS} SELECT type, value, CASE type WHEN 'ip' THEN 30 WHEN 'domain' THEN 90 WHEN 'url' THEN 14 WHEN 'hash_md5' THEN 365 WHEN 'hash_sha256' THEN 365 WHEN 'email' THEN 180 WHEN 'cve' THEN 180 WHEN 'crypto_wallet' THEN 365 ELSE 90 END::INTEGER AS lifetime_days FROM iocs")
def lifetime_defaults(spark, d):
    return up.lifetime_defaults(iocs(spark, d)).select("type", "value", "lifetime_days")


@query("enrichment_boost", f"WITH {IOCS}, x AS (SELECT type, value, least(1.0::DOUBLE, sighting_count / 5.0::DOUBLE) AS s FROM iocs WHERE type IN ('ip', 'domain')) SELECT i.type, i.value, round(greatest(i.base_score, coalesce(0.8::DOUBLE * x.s, i.base_score)), 6) AS base_score FROM iocs i LEFT JOIN x ON x.type = i.type AND x.value = i.value")
def enrichment_boost(spark, d):
    t = iocs(spark, d)
    r = t.where(F.col("type").isin("ip", "domain")).select("type", "value", F.least(F.lit(1.0), F.col("sighting_count") / 5.0).alias("score"), F.lit("engines").alias("provider"))
    return up.mark_enriched(t, r).select("type", "value", rounded(F.col("base_score"), "base_score"))


@query("engine_lookup", f"WITH {IOCS} SELECT type, value, round(CASE WHEN type = 'domain' THEN 0 WHEN sighting_count > 0 THEN least(sighting_count, 70)::DOUBLE / 70 END, 6) AS score, CASE WHEN type = 'domain' THEN 'not_found' ELSE 'engines' END AS provider FROM iocs WHERE type IN ('ip', 'domain', 'hash_md5', 'hash_sha256')")
def engine_lookup(spark, d):
    t = iocs(spark, d)
    lookup = t.where("type <> 'domain'").select("value", F.least(F.col("sighting_count"), F.lit(70)).alias("malicious"), F.lit(70).alias("total")).dropDuplicates(["value"])
    return feeds.enrich_engines(t, lookup).select("type", "value", rounded(F.col("score"), "score"), "provider")


@query("source_events", "SELECT id, CASE WHEN error_count > 5 THEN 'paused' WHEN status = 'approved' THEN 'active' ELSE status END AS status, CASE WHEN error_count > 5 THEN error_count + 2 ELSE error_count END::INTEGER AS error_count FROM sources")
def source_events(spark, d):
    s = table(spark, d, "sources")
    at = F.to_timestamp(F.lit("2026-07-01 00:00:00"))
    bad = s.where("error_count > 5").select("identifier", F.explode(F.array(F.lit("pause"), F.lit("error"), F.lit("error"))).alias("action"), at.alias("at"))
    good = s.where("error_count <= 5 and status = 'approved'").select("identifier", F.lit("activate").alias("action"), at.alias("at"))
    return up.source_states(s, bad.unionByName(good)).select("id", "status", F.col("error_count").cast("int").alias("error_count"))


@query("channel_configs", "SELECT DISTINCT lower(regexp_replace(identifier, '^(https?://)?t\\.me/', '')) AS key, false AS configured FROM sources WHERE status IN ('approved', 'active') AND type IN ('telegram_channel', 'telegram_group')")
def channel_configs(spark, d):
    return feeds.channel_configs(table(spark, d, "sources"), spark.createDataFrame([], "identifier string")).select("key", "configured")


@query("noise_flags_whole")
def noise_flags_whole(spark, d):
    """All rows; the SQL of noise_flags covers contents that are null or made of spaces."""
    return up.flag_noise(table(spark, d, "raw_content"), tx.junk_reason(F.col("content"))).select("id", "is_noise")


# --- Classification helpers ---
_SUBS = " OR ".join(f"(category = '{k}' AND sub_category IN ({', '.join(repr(x) for x in v)}))" for k, v in SUB_CATEGORIES.items())
_TAGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_TAG.items())


@query("sub_category_valid", f"SELECT id, coalesce({_SUBS}, false) AS valid FROM raw_content")
def sub_category_valid(spark, d):
    return table(spark, d, "raw_content").select("id", sc.valid_sub_category(F.col("category"), F.col("sub_category")).alias("valid"))


@query("category_tags", f"SELECT id, array_to_string(list_filter([nullif(category, ''), CASE category {_TAGS} END, CASE WHEN severity IN ('low', 'info') THEN 'needs_review' END], lambda x: x IS NOT NULL), ',') AS tags, CASE WHEN provenance IN ('first_party', 'third_party_reporting') THEN provenance ELSE 'unknown' END AS provenance FROM raw_content")
def category_tags(spark, d):
    conf = F.when(F.col("severity").isin("low", "info"), 0.5).otherwise(0.9)
    return table(spark, d, "raw_content").select("id", F.array_join(sc.category_tags(F.col("category"), conf), ",").alias("tags"), sc.provenance_or_unknown(F.col("provenance")).alias("provenance"))


@query("severity_lattice", "SELECT id, CASE greatest(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END, 1) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM raw_content")
def severity_lattice(spark, d):
    return table(spark, d, "raw_content").select("id", sc.severity_max(F.col("severity"), F.lit("low")).alias("severity"))


@query("content_hash", "SELECT id, sha256(content) AS hash, lower(content_hash) = sha256(content) AS same FROM raw_content WHERE content IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "raw_content").where("content is not null").select("id", F.sha2("content", 256).alias("hash"), (F.lower("content_hash") == F.sha2("content", 256)).alias("same"))


_CLASSIFIED = r"""SELECT id, CASE WHEN regexp_matches(c, '(?i)\bCVE-\d{4}-\d{4,}|exploit') THEN 'vulnerability' WHEN regexp_matches(c, '(?i:password|combo|credential)|пароль|учётк|логин') THEN 'credential_leak'
WHEN regexp_matches(c, '(?i:trojan|loader|malware|botnet)|троян|загрузчик') THEN 'malware_sample' WHEN regexp_matches(c, '(?i:\bRDP\b|\bVPN\b|shell access)|доступ') THEN 'access_broker'
WHEN regexp_matches(c, '(?i:database|dump|leak)|слив|выгрузк') THEN 'data_dump' ELSE 'threat_actor_comms' END AS category FROM (SELECT id, coalesce(content, '') AS c FROM raw_content)"""


@query("default_classify", f"SELECT id, category, 'info' AS severity, array_to_string(list_filter([category, CASE category {_TAGS} END, 'needs_review'], lambda x: x IS NOT NULL), ',') AS tags, 'unknown' AS provenance FROM ({_CLASSIFIED})")
def default_classify(spark, d):
    return plug.post_process(plug.default_classify(table(spark, d, "raw_content").select("id", "content"))).select("id", "category", "severity", joined("tags"), "provenance")


@query("default_extract")
def default_extract(spark, d):
    return plug.default_extract(table(spark, d, "raw_content").select("id", "content"))


@query("json_recovery")
def json_recovery(spark, d):
    answer = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct("id", "category")), F.lit("\n``` done"))
    return table(spark, d, "raw_content").select("id", plug.recover_json(answer).alias("json"))


# --- Discovery ---
_X = r"flatten([regexp_extract_all(c, 'https?://[a-z2-7]{16,56}\.onion[/\S]*'), regexp_extract_all(c, '(?:https?://)?t\.me/(?:joinchat/|\+)?[A-Za-z0-9_]+'), regexp_extract_all(c, 'https?://(?:pastebin\.com|ghostbin\.\w+|privatebin\.\w+|rentry\.co)/[A-Za-z0-9]+'), regexp_extract_all(c, 'https?://[^\s<>\"{}|\\^`\[\]]+')])"
URLS = rf"""u AS (SELECT DISTINCT id, regexp_replace(unnest({_X}), '[.,;:!?)''\"]+$', '') AS url FROM (SELECT id, coalesce(content, '') AS c FROM raw_content))"""


@query("url_extract", f"WITH {URLS} SELECT id, url FROM u")
def url_extract(spark, d):
    return table(spark, d, "raw_content").select("id", F.explode(ur.extract_urls(F.col("content"))).alias("url"))


@query("url_skipped", rf"""WITH {URLS}, p AS (SELECT DISTINCT url, lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*'), '^[^@]*@', ''), ':\d*$', '')) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM u WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://'))
SELECT url, contains(url, 'FUZZ') OR contains(lower(url), 'localhost') OR regexp_matches(host, '^(10|127)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$') OR regexp_matches(host, '^\d+\.\d+(\.\d+)?$') OR regexp_matches(lower(path), '\.(png|jpg|jpeg|gif|svg|webp|ico|bmp)$')
OR regexp_matches(host, '(^|\.)(embedly\.com|safelinks\.protection\.outlook\.com|player\.vimeo\.com|t\.co|bit\.ly|tinyurl\.com|goo\.gl)$') OR length(q) > 256 OR (length(regexp_replace(path, '/+$', '')) < 2 AND q = '') AS skipped FROM p""")
def url_skipped(spark, d):
    u = table(spark, d, "raw_content").select(F.explode(ur.extract_urls(F.col("content"))).alias("url")).distinct().where(F.regexp_like("url", F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")))
    return u.select("url", ur.skipped(F.col("url")).alias("skipped"))


@query("source_kinds", "SELECT id, CASE WHEN type LIKE 'telegram%' THEN 'collector.telegram' WHEN type LIKE '%paste%' THEN 'collector.paste' WHEN type = 'forum' THEN 'collector.forum' ELSE 'collector.web' END AS module FROM sources")
def source_kinds(spark, d):
    return table(spark, d, "sources").select("id", ur.collector_module(F.col("type")).alias("module"))


# --- Dataset and counters ---
@query("plan_reasons", """SELECT id, CASE WHEN category IS NULL THEN 'no_verdict' WHEN category = 'irrelevant' THEN 'downgrade' WHEN provenance = 'unknown' THEN 'needs_review_not_adjudicated' WHEN category NOT IN ('credential_leak', 'malware_sample', 'threat_actor_comms', 'access_broker', 'data_dump', 'vulnerability') THEN 'final_label_not_a_class' ELSE 'actionable' END AS reason FROM raw_content""")
def plan_reasons(spark, d):
    x = table(spark, d, "raw_content").select("id", F.when(F.col("category").isNull(), "no_verdict_keep_groq").when(F.col("category") == "irrelevant", "downgrade").when(F.col("provenance") == "unknown", "reclassified").otherwise("agree").alias("source"), F.lit("0").alias("needs_review"), F.col("category").alias("final_label"))
    return x.select("id", ds.plan_reason().alias("reason"))


@query("exclusions", "SELECT excluded, count(*) AS count FROM (SELECT CASE WHEN s.id IS NOT NULL THEN 'gold_set' WHEN r.content IS NULL THEN 'content_missing_in_db' WHEN trim(r.content) = '' THEN 'empty_content' END AS excluded FROM raw_content r LEFT JOIN (SELECT DISTINCT id FROM stage1 WHERE split = 'test') s ON s.id = r.id) GROUP BY 1")
def exclusions(spark, d):
    rows = table(spark, d, "raw_content").select("id", "content", F.lit(False).alias("is_noise"))
    return rd.counts_by(ds.exclusion_reason(table(spark, d, "stage1").where("split = 'test'").select("id"), rows), F.col("excluded"))


@query("worksheet", "SELECT id, coalesce(nullif(trim(content), ''), 'snippet') AS content FROM raw_content WHERE category = 'data_dump'")
def worksheet(spark, d):
    r = table(spark, d, "raw_content").where("category = 'data_dump'")
    relabel = r.select("id", F.col("category").alias("groq_category"), F.col("category").alias("final_label"), F.lit("agree").alias("source"), F.lit("snippet").alias("content_snippet"))
    return ds.worksheet(relabel, r).select("id", "content")


@query("char_grams", "SELECT id, len(g) AS grams, len(list_distinct(g)) AS different FROM (SELECT id, flatten([list_transform(range(1, greatest(1, length(x) - n + 2)), lambda i: substr(x, i, n)) for n in [2, 3, 4, 5]]) AS g FROM (SELECT id, lower(coalesce(text, '')) AS x FROM stage1))")
def char_grams(spark, d):
    grams = F.array(ds.char_grams(F.col("text")))
    x = table(spark, d, "stage1").select("id", F.element_at(F.transform(grams, lambda g: F.struct(F.size(g).cast("bigint").alias("grams"), F.size(F.array_distinct(g)).cast("bigint").alias("different"))), 1).alias("x"))
    return x.select("id", "x.*")


@query("poisoned", "SELECT raw_content_id AS id, count(*) AS failures FROM ioc_sightings GROUP BY 1 HAVING count(*) >= 5")
def poisoned(spark, d):
    return st.poisoned(table(spark, d, "ioc_sightings").select(F.col("raw_content_id").alias("id")))


@query("latency_histogram", "SELECT le, count(*) FILTER (s <= b) AS count FROM (SELECT abs(epoch_us(collected_at) - epoch_us(posted_at)) / 1e6::DOUBLE / 60 AS s FROM raw_content WHERE posted_at IS NOT NULL), (VALUES ('0.5', 0.5), ('1', 1), ('2', 2), ('4', 4), ('8', 8), ('16', 16), ('32', 32), ('64', 64), ('+Inf', 1e300)) v(le, b) GROUP BY 1")
def latency_histogram(spark, d):
    x = table(spark, d, "raw_content").where("posted_at is not null").select((F.abs(F.unix_micros("collected_at") - F.unix_micros("posted_at")) / F.lit(1e6) / 60).alias("seconds"))
    return st.latency_histogram(x)


@query("brief_sums", f"WITH m AS (SELECT severity AS k, count(*) AS n FROM raw_content WHERE collected_at BETWEEN {BEFORE_SQL} AND {AS_OF_SQL} GROUP BY 1) SELECT sum(n)::BIGINT AS total FROM m")
def brief_sums(spark, d):
    x = va.brief_metrics(table(spark, d, "raw_content"), table(spark, d, "ioc_sightings"), BEFORE, END).where("metric = 'severity'")
    return x.agg(F.map_from_entries(F.collect_list(F.struct("key", "count"))).alias("m")).select(va.sum_map(F.col("m")).alias("total"))


@query("module_statuses", "SELECT type AS category, string_agg(name || ':' || status, ',' ORDER BY name) AS modules FROM sources GROUP BY 1")
def module_statuses(spark, d):
    x = rd.statuses_by_category(table(spark, d, "sources").select(F.col("type").alias("category"), "id", "name", F.col("status").alias("enabled")))
    return x.select("category", F.array_join(F.transform("modules", lambda m: F.concat(m["name"], F.lit(":"), m["enabled"])), ",").alias("modules"))


@query("label_statistics", "SELECT label, count(*) AS n, format('{:,}', count(*)) AS shown FROM stage1 GROUP BY 1")
def label_statistics(spark, d):
    return rd.counts_by(table(spark, d, "stage1"), F.col("label")).select("label", F.col("count").alias("n"), sc.thousands(F.col("count")).alias("shown"))


@query("mention_counts", f"WITH {VULNS} SELECT cve_id, mention_count, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen FROM vulnerabilities WHERE kev_listed")
def mention_counts(spark, d):
    return vulnerabilities(spark, d).where("kev_listed").select("cve_id", "mention_count", us("first_seen"), us("last_seen"))


@query("incident_edges", "SELECT e.id, count(*) AS edges FROM entities e JOIN edges g ON g.source_id = e.id OR g.target_id = e.id GROUP BY 1")
def incident_edges(spark, d):
    x = gr.incident(table(spark, d, "edges").select("source_id", "target_id")).select(F.col("id_of").alias("id"))
    return rd.counts_by(x.join(table(spark, d, "entities").select("id"), "id"), F.col("id")).withColumnRenamed("count", "edges")


@query("reactivate", f"WITH {IOCS} SELECT type, value, CASE WHEN type = 'ip' THEN 0.7::DOUBLE ELSE threat_score END AS threat_score, sighting_count + CASE WHEN type = 'ip' THEN 1 ELSE 0 END AS sighting_count FROM iocs")
def reactivate(spark, d):
    t = iocs(spark, d)
    e = t.where("type = 'ip'").select("type", "value", F.lit(0.7).alias("score"))
    return up.reactivate(t, e).select("type", "value", "threat_score", "sighting_count")


@query("source_values_page", "SELECT source_name, count(*) AS n, epoch_us(max(collected_at)) AS last FROM raw_content WHERE source_name IS NOT NULL AND collected_at <= TIMESTAMPTZ '2026-07-01 00:00:00+00' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def source_values_page(spark, d):
    x = table(spark, d, "raw_content").where("source_name is not null").where(F.col("collected_at") <= F.lit(datetime(2026, 7, 1, tzinfo=timezone.utc)))
    return rd.page(x.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), us(F.max("collected_at"), "last")), [F.desc("n"), F.col("source_name")], 25)


@query("as_of_decay_active", f"WITH {IOCS} SELECT type, count(*) AS n FROM iocs WHERE base_score * exp(-0.3::DOUBLE * ((epoch_us({AS_OF_SQL}) - epoch_us(last_seen)) / 86400e6::DOUBLE) / CASE type WHEN 'ip' THEN 30.0::DOUBLE WHEN 'domain' THEN 90 WHEN 'url' THEN 14 WHEN 'hash_md5' THEN 365 WHEN 'hash_sha256' THEN 365 WHEN 'email' THEN 180 WHEN 'cve' THEN 180 WHEN 'crypto_wallet' THEN 365 ELSE 90 END) >= 0.1 GROUP BY 1")
def as_of_decay_active(spark, d):
    return rd.counts_by(up.decay(iocs(spark, d), as_of()).where("active"), F.col("type")).withColumnRenamed("count", "n")


@query("candidate_context", f"""WITH {CORRELATIONS}, {NOTES}, x AS (SELECT cluster_id, unnest(finding_ids) AS id FROM correlations),
n AS (SELECT x.cluster_id, count(DISTINCT n.id) AS notes FROM x JOIN raw_content r ON r.id = x.id JOIN notes n ON n.entity_id = r.author AND n.status = 'active' GROUP BY 1),
t AS (SELECT cluster_id, least(count(*), 20) AS findings FROM x JOIN raw_content r ON r.id = x.id GROUP BY 1)
SELECT c.cluster_id, coalesce(t.findings, 0) AS findings, coalesce(n.notes, 0) AS notes FROM correlations c LEFT JOIN t USING (cluster_id) LEFT JOIN n USING (cluster_id)""")
def candidate_context(spark, d):
    from tidewatch.operators.correlate import candidate_context as context

    x = context(correlations(spark, d), table(spark, d, "raw_content"), notes(spark, d))
    return x.select("cluster_id", F.coalesce(F.size("findings"), F.lit(0)).cast("bigint").alias("findings"), "notes")


@query("resolved_iocs", f"""WITH {IOCS}, h AS (SELECT type, value, lower(CASE WHEN type = 'url' THEN regexp_replace(regexp_replace(regexp_extract(regexp_replace(value, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*'), '^[^@]*@', ''), ':\\d*$', '') ELSE regexp_replace(value, ':\\d+$', '') END) AS host FROM iocs)
SELECT type, value FROM h WHERE type NOT IN ('domain', 'url') OR host LIKE '%.onion' OR regexp_matches(host, '^\\d+(\\.\\d+){{3}}$|:') OR host LIKE '%.example'""")
def resolved_iocs(spark, d):
    t = iocs(spark, d).select("type", "value")
    hosts = t.select(tx.ioc_host(F.col("type"), F.col("value")).alias("host")).where("host like '%.example'")
    return tx.filter_resolved(t, hosts)


@query("briefs_list", "SELECT 'brief:' || c AS id, n FROM (SELECT category AS c, max(collected_at) AS e, count(*) AS n FROM raw_content WHERE category IS NOT NULL GROUP BY 1) ORDER BY e DESC, c LIMIT 20")
def briefs_list(spark, d):
    b = table(spark, d, "raw_content").where("category is not null").groupBy("category").agg(F.max("collected_at").alias("period_end"), F.count(F.lit(1)).alias("n"))
    return rd.briefs(b.select(F.concat(F.lit("brief:"), "category").alias("id"), F.lit("daily").alias("brief_type"), "period_end", "n"), "daily").select("id", "n")


@query("style", r"""SELECT id, len(w) AS words, len(list_distinct(w)) AS different, length(regexp_replace(x, '[^.!?]', '', 'g')) AS marks, round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, ''))::DOUBLE / len(w) ELSE 0 END, 6) AS word_length
FROM (SELECT id, coalesce(content, '') AS x, regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{N}]+') AS w FROM raw_content)""")
def style(spark, d):
    x = table(spark, d, "raw_content").select("id", tx.style(F.col("content")).alias("s"))
    return x.select("id", F.col("s.words").cast("bigint").alias("words"), F.col("s.different").cast("bigint").alias("different"), F.col("s.marks").cast("bigint").alias("marks"), rounded(F.col("s.word_length"), "word_length"))
