"""Mutations as functions (old rows, new rows) -> rows. Parquet has no MERGE; every result is written anew or appended.

Winner rules are explicit: within a batch the earliest (time, id) comes first. Joins are on the table's unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import lifetime_days, micros, vulnerability_priority
from tidewatch.functions.text import cleanup_pattern
from tidewatch.schemas import CLASSIFICATION_VERSION, edge_id, ioc_entity_type, ioc_id, source_entity_id


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``new`` rows whose key is not in ``old``, the first per key; null keys never conflict."""
    named = new.where(" and ".join(f"{k} is not null" for k in key))
    unnamed = new.where(" or ".join(f"{k} is null" for k in key))
    fresh = first_per(named, key, [F.col(o) for o in order]).join(old.select(*key).distinct(), key, "left_anti")
    return fresh.unionByName(unnamed)


def insert_with_ids(archive: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, archived_id, inserted) of every batch row: the id under which its content_hash stands in the archive."""
    fresh = insert_ignore(archive, batch, ["content_hash"], ["collected_at", "id"])
    kept = archive.select("content_hash", F.col("id").alias("archived_id")).unionByName(fresh.select("content_hash", F.col("id").alias("archived_id")))
    kept = kept.where("content_hash is not null").groupBy("content_hash").agg(F.min("archived_id").alias("archived_id"))
    return batch.join(kept, "content_hash", "left").select("id", F.coalesce("archived_id", "id").alias("archived_id"), (F.coalesce("archived_id", "id") == F.col("id")).alias("inserted"))


def finding_to_raw(findings: DataFrame) -> DataFrame:
    """Collected findings in the archive's form. The zero time becomes null, null metadata stays null."""
    return findings.select(
        "id", F.col("source").alias("source_type"), "source_id", "source_name", "content", F.sha2("content", 256).alias("content_hash"), "author", "collected_at",
        F.when(F.col("posted_at") > F.to_timestamp(F.lit("0001-01-02 00:00:00")), F.col("posted_at")).alias("posted_at"), "metadata",
        F.lit(False).alias("classified"), F.lit(False).alias("entities_extracted"),
    )


def raw_to_finding(raw: DataFrame, limit: int | None = None) -> DataFrame:
    content = F.left("content", F.lit(limit)) if limit else F.col("content")
    return raw.select("id", F.col("source_type").alias("source"), "source_id", "source_name", content.alias("content"), "content_hash", "author", F.col("posted_at").alias("timestamp"), "collected_at", "metadata")


def update_from(old: DataFrame, delta: DataFrame, key: str, columns: list[str], flag: str | None = None) -> DataFrame:
    """Rows of ``old`` with the columns of their ``delta`` row where it has one; ``flag`` is set on those."""
    d = delta.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = old.join(d, old[key] == F.col("_k"), "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_hit"), F.coalesce(f"_new_{c}", c) if c in old.columns else F.col(f"_new_{c}")).otherwise(F.col(c) if c in old.columns else F.lit(None)))
    if flag:
        out = out.withColumn(flag, F.coalesce("_hit", flag))
    return out.drop("_k", "_hit", *[f"_new_{c}" for c in columns])


def mark_classified(raw: DataFrame, results: DataFrame) -> DataFrame:
    return update_from(raw, results.withColumn("classification_version", F.lit(CLASSIFICATION_VERSION)), "id", ["category", "tags", "severity", "summary", "provenance", "classification_version"], "classified")


def reset_old(raw: DataFrame, target: int = CLASSIFICATION_VERSION) -> DataFrame:
    old = F.coalesce(F.col("classification_version") < target, F.lit(True))
    return raw.withColumn("classified", F.when(old, False).otherwise(F.col("classified"))).withColumn("entities_extracted", F.when(old, False).otherwise(F.col("entities_extracted")))


def iocs_from_sightings(sightings: DataFrame, base: float = 0.5) -> DataFrame:
    """Indicators of extraction events: every event counts, the first context and record stay."""
    first = F.min_by("raw_content_id", F.struct(F.col("created_at"), F.col("raw_content_id")))
    return sightings.groupBy(F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value")).agg(
        F.count(F.lit(1)).alias("sighting_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), first.alias("source_content_id"),
        F.lit(base).alias("base_score"), F.lit(base).alias("threat_score"), F.lit(True).alias("active"),
    )


def upsert_iocs(old: DataFrame, sightings: DataFrame) -> DataFrame:
    """Counts add up, last_seen moves on, scores never fall, the indicator is active again; first record stays."""
    new = iocs_from_sightings(sightings)
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.type") == F.col("n.type")) & (F.col("o.value") == F.col("n.value")), "full_outer")
    return both.select(
        F.coalesce("o.type", "n.type").alias("type"), F.coalesce("o.value", "n.value").alias("value"),
        (F.coalesce("o.sighting_count", F.lit(0)) + F.coalesce("n.sighting_count", F.lit(0))).alias("sighting_count"),
        F.least("o.first_seen", "n.first_seen").alias("first_seen"), F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        F.coalesce("o.source_content_id", "n.source_content_id").alias("source_content_id"),
        F.greatest("o.base_score", "n.base_score").alias("base_score"), F.greatest("o.threat_score", "n.threat_score").alias("threat_score"),
        F.when(F.col("n.type").isNotNull(), True).otherwise(F.col("o.active")).alias("active"),
    )


def distinct_sightings(sightings: DataFrame) -> DataFrame:
    return first_per(sightings, ["ioc_type", "ioc_value", "raw_content_id"], [F.col("created_at"), F.col("source_id")])


def backfill_sightings(iocs: DataFrame, raw: DataFrame, sightings: DataFrame) -> DataFrame:
    """Sightings that indicators imply and that are not there."""
    implied = iocs.where("source_content_id is not null").join(raw.select(F.col("id").alias("source_content_id"), "source_id", "source_name", "collected_at"), "source_content_id")
    implied = implied.select(F.col("type").alias("ioc_type"), F.col("value").alias("ioc_value"), F.col("source_content_id").alias("raw_content_id"), "source_id", "source_name", F.col("collected_at").alias("created_at"))
    return implied.join(sightings.select("ioc_type", "ioc_value", "raw_content_id").distinct(), ["ioc_type", "ioc_value", "raw_content_id"], "left_anti")


def upsert_correlations(old: DataFrame, new: DataFrame) -> DataFrame:
    """By cluster_id: members, confidence and evidence are the new ones, type and method the first ones."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col("o.cluster_id") == F.col("n.cluster_id"), "full_outer").select(
        F.coalesce("o.cluster_id", "n.cluster_id").alias("cluster_id"), F.coalesce("o.correlation_type", "n.correlation_type").alias("correlation_type"), F.coalesce("o.method", "n.method").alias("method"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("entity_ids", "finding_ids", "confidence", "evidence")],
    )


def upsert_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """By cluster_id: signals are the new ones, seen_count grows, members and status stay (a rejected one stays rejected)."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col("o.cluster_id") == F.col("n.cluster_id"), "full_outer").select(
        F.coalesce("o.cluster_id", "n.cluster_id").alias("cluster_id"),
        *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("candidate_type", "entity_ids", "finding_ids")],
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("signal_count", "signals")],
        F.coalesce("o.status", F.lit("pending")).alias("status"),
        (F.coalesce("o.seen_count", F.lit(0)) + F.when(F.col("n.cluster_id").isNotNull(), 1).otherwise(0)).alias("seen_count"),
    )


def merge_properties(events: DataFrame) -> DataFrame:
    """(id, type, properties, at) events -> entities: later properties win key by key, the first type stays. Keys are grouped
    one by one, so an entity with very many events is never gathered."""
    each = events.select("id", "at", F.explode("properties").alias("k", "v"))
    last = each.groupBy("id", "k").agg(F.max_by("v", "at").alias("v"))
    props = last.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("properties"))
    kinds = events.groupBy("id").agg(F.min_by("type", "at").alias("type"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    return kinds.join(props, "id", "left")


def upsert_edges(edges: DataFrame) -> DataFrame:
    return first_per(edges, ["id"], [F.col("created_at"), F.col("source_id"), F.col("target_id")])


def backfill_entities(iocs: DataFrame, entities: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities, and their found_in edges, of indicators that have none yet."""
    x = iocs.withColumn("id", ioc_id(F.col("type"), F.col("value"))).join(entities.select("id"), "id", "left_anti")
    nodes = x.select("id", ioc_entity_type(F.col("type"), keep_unmapped=True).alias("type"), F.create_map(F.lit("value"), F.col("value")).alias("properties"))
    named = x.join(raw.select(F.col("id").alias("source_content_id"), F.coalesce(F.nullif("source_name", F.lit("")), F.col("source_id")).alias("name")), "source_content_id")
    target = source_entity_id(F.col("name"))
    return nodes, named.select(edge_id(F.col("id"), target, F.lit("found_in")).alias("id"), F.col("id").alias("source_id"), target.alias("target_id"), F.lit("found_in").alias("relationship"))


def relabel_associated(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """associated_with between two entities never observed becomes referenced_in."""
    seen = entities.select(F.col("id").alias("_e"), (F.coalesce(F.col("properties")["observed"], F.lit("false")) != "false").alias("_o"))
    x = edges.join(seen.select(F.col("_e").alias("source_id"), F.col("_o").alias("_a")), "source_id", "left").join(seen.select(F.col("_e").alias("target_id"), F.col("_o").alias("_b")), "target_id", "left")
    weak = (F.col("relationship") == "associated_with") & (F.col("_a") == F.lit(False)) & (F.col("_b") == F.lit(False))
    return x.withColumn("relationship", F.when(weak, "referenced_in").otherwise(F.col("relationship"))).select(*edges.columns)


#: Columns that an update replaces where it has a value; identifiers, products and references are only set at first.
VULN_UPDATED = ("description", "cvss_v31_score", "cvss_v31_vector", "cvss_severity", "epss_score", "epss_percentile", "kev_date_added", "kev_due_date", "kev_ransomware_use", "exploit_available")
VULN_FIRST = ("cwe_ids", "affected_products", "reference_urls", "published_at", "last_modified_at")


def upsert_vulnerabilities(old: DataFrame, new: DataFrame, strict_parity: bool = True) -> DataFrame:
    """By cve_id. The KEV flag is that of the update; without ``strict_parity`` it sticks once set."""
    o, n = old.alias("o"), new.alias("n")
    have = lambda c: [F.col(f"{a}.{c}") for a, df in (("n", new), ("o", old)) if c in df.columns]
    kev = F.coalesce(*have("kev_listed")) if strict_parity else F.greatest(*[F.coalesce(c, F.lit(False)) for c in have("kev_listed")], F.lit(False))
    return o.join(n, F.col("o.cve_id") == F.col("n.cve_id"), "full_outer").select(
        F.coalesce("o.cve_id", "n.cve_id").alias("cve_id"), *[F.coalesce(*have(c)).alias(c) for c in VULN_UPDATED if have(c)], *[F.coalesce(*have(c)[::-1]).alias(c) for c in VULN_FIRST if have(c)],
        F.coalesce(kev, F.lit(False)).alias("kev_listed"),
    )


def with_priorities(vulns: DataFrame) -> DataFrame:
    score, label = vulnerability_priority(*[F.col(c) for c in ("kev_listed", "epss_score", "cvss_v31_score", "mention_count", "exploit_available")])
    return vulns.withColumn("priority_score", score).withColumn("priority_label", label)


def mention_counts(vulns: DataFrame, sightings: DataFrame) -> DataFrame:
    """Mentions, first and last sighting of each CVE, all in one aggregation."""
    seen = sightings.where("ioc_type = 'cve'").groupBy(F.upper("ioc_value").alias("cve_id")).agg(F.count(F.lit(1)).alias("mention_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return vulns.drop("mention_count", "first_seen", "last_seen").join(seen, "cve_id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))


def mark_enriched(iocs: DataFrame, results: DataFrame) -> DataFrame:
    """(type, value, score, provider) results: scores never fall, providers are listed."""
    r = results.groupBy("type", "value").agg(F.max("score").alias("_s"), F.sort_array(F.collect_set("provider")).alias("enrichment_sources"))
    x = iocs.drop("enrichment_sources").join(r, ["type", "value"], "left")
    for c in ("base_score", "threat_score"):
        x = x.withColumn(c, F.greatest(F.col(c), 0.8 * F.col("_s")))
    return x.drop("_s")


def decay(iocs: DataFrame, as_of: Column, threshold: float = 0.1) -> DataFrame:
    """Current threat scores; active indicators below the threshold are no longer."""
    own = F.col("lifetime_days") if "lifetime_days" in iocs.columns else None
    score = F.col("base_score") * F.exp(F.lit(-0.3) * ((micros(as_of) - micros(F.col("last_seen"))) / F.lit(86_400e6)) / lifetime_days(F.col("type"), own))
    out = iocs.withColumn("threat_score", F.when(F.col("active"), score).otherwise(F.col("threat_score")))
    return out.withColumn("active", F.col("active") & (F.col("threat_score") >= threshold))


def lifetime_defaults(iocs: DataFrame) -> DataFrame:
    own = F.col("lifetime_days") if "lifetime_days" in iocs.columns else F.lit(None).cast("int")
    return iocs.withColumn("lifetime_days", F.coalesce(own, lifetime_days(F.col("type")).cast("int")))


def deactivate_by_pattern(iocs: DataFrame) -> DataFrame:
    return iocs.withColumn("active", F.col("active") & ~cleanup_pattern(F.col("type"), F.col("value")))


def reactivate(iocs: DataFrame, events: DataFrame) -> DataFrame:
    """(type, value, score) events: the score is the new one and the count grows."""
    e = events.groupBy("type", "value").agg(F.max("score").alias("_s"), F.count(F.lit(1)).alias("_n"))
    x = iocs.join(e, ["type", "value"], "left")
    return x.withColumn("threat_score", F.coalesce("_s", "threat_score")).withColumn("sighting_count", F.col("sighting_count") + F.coalesce("_n", F.lit(0))).withColumn("active", F.col("active") | F.col("_n").isNotNull()).drop("_s", "_n")


def source_states(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Registry rows after (identifier, action, at) events: the latest status action wins, collections reset errors, errors add up."""
    status = {"approve": "approved", "reject": "rejected", "add": "active", "pause": "paused", "activate": "active", "remove": "removed"}
    mapped = F.lit(None).cast("string")
    for a, s in status.items():
        mapped = F.when(F.col("action") == a, s).otherwise(mapped)
    e = events.withColumn("s", mapped)
    last = e.groupBy("identifier").agg(
        F.max_by("s", F.when(F.col("s").isNotNull(), F.col("at"))).alias("_s"), F.max(F.when(F.col("action") == "collect", F.col("at"))).alias("_c"),
    )
    errors = e.where("action = 'error'").join(last.select("identifier", "_c"), "identifier").where("_c is null or at > _c").groupBy("identifier").agg(F.count(F.lit(1)).alias("_e"))
    x = sources.join(last, "identifier", "left").join(errors, "identifier", "left")
    x = x.withColumn("status", F.coalesce("_s", "status")).withColumn("error_count", F.when(F.col("_c").isNotNull(), 0).otherwise(F.col("error_count")) + F.coalesce("_e", F.lit(0))).withColumn("last_collected", F.greatest("last_collected", "_c"))
    return x.where("status <> 'removed'").select(*sources.columns)


def apply_triage(pending: DataFrame, answers: DataFrame, misses: DataFrame, least_trash: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pending sources after a triage round, and the learned blacklist.

    Answers (identifier form ``match``, verdict): investigate beats trash; a source not answered ``least_trash`` times is trash.
    Domains trashed ``least_trash`` times are listed and their pending sources go too."""
    from tidewatch.functions.urls import host_of, url_match_form

    a = answers.groupBy("match").agg(F.max((F.col("verdict") == "investigate").cast("int")).alias("keep"))
    x = pending.withColumn("match", url_match_form(F.col("identifier"))).join(a, "match", "left").join(misses, "identifier", "left")
    decided = x.withColumn("verdict", F.when(F.col("keep") == 1, "investigate").when((F.col("keep") == 0) | (F.coalesce("missed", F.lit(0)) >= least_trash), "trash").otherwise("pending"))
    trash = decided.where("verdict = 'trash'").groupBy(host_of(F.col("identifier")).alias("domain")).agg(F.count(F.lit(1)).alias("n")).where("domain <> ''")
    bad = trash.where(F.col("n") >= least_trash).select("domain")
    left = decided.where("verdict <> 'trash'").withColumn("domain", host_of(F.col("identifier"))).join(bad, "domain", "left_anti")
    return left.select("identifier", F.when(F.col("verdict") == "investigate", "discovered").otherwise("pending_triage").alias("status")), trash


def flag_noise(raw: DataFrame, reason: Column) -> DataFrame:
    return raw.withColumn("is_noise", reason.isNotNull())


def normalized_identifiers(sources: DataFrame) -> DataFrame:
    """Channel identifiers without the address in front."""
    return sources.withColumn("identifier", F.when(F.col("type") == "telegram_channel", F.regexp_replace("identifier", r"^https?://t\.me/", "")).otherwise(F.col("identifier")))


def delete_matching(sources: DataFrame, likes: list[str], patterns: list[str] = (), status: str = "discovered") -> DataFrame:
    """Sources without those of ``status`` whose identifier is like one of the texts."""
    hit = F.lit(False)
    for x in likes:
        hit = hit | F.col("identifier").like(x)
    for p in patterns:
        hit = hit | F.regexp_like("identifier", F.lit(p))
    return sources.where(~((F.col("status") == status) & hit))
