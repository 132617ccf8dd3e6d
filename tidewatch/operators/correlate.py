"""Correlation rules over sightings, authors and the graph, with their confidence and cluster ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import correlation_confidence, micros
from tidewatch.functions.text import garbage_handle
from tidewatch.operators.skew import dealt
from tidewatch.schemas import cluster_id, ioc_id, source_entity_id

#: Names that alone do not make a campaign (fixed values).
TOOL_WHITELIST = (
    "volatility", "dumpit", "autopsy", "ftk", "process monitor", "procmon", "wireshark", "tcpdump", "velociraptor", "mimikatz", "bloodhound", "sharphound", "rubeus", "impacket",
    "crackmapexec", "netexec", "responder", "hashcat", "john the ripper", "nmap", "burp suite", "metasploit", "nuclei", "credential_theft", "credential_dumping", "memory_dump",
    "lateral_movement", "privilege_escalation", "dll_sideloading", "phishing",
)
OUT = ["cluster_id", "correlation_type", "method", "entity_ids", "finding_ids", "confidence", "is_correlation"]


def first_party(raw: DataFrame) -> DataFrame:
    return raw.where("classified and category <> 'irrelevant' and provenance = 'first_party'")


def shared_iocs(sightings: DataFrame, raw: DataFrame, least: int = 2) -> DataFrame:
    """Indicators seen in several sources: sorted sources and records, and how many sources.

    Repeated sightings are dropped before the wide aggregation, so a very frequent value brings each record once."""
    x = sightings.join(first_party(raw).select(F.col("id").alias("raw_content_id")), "raw_content_id", "left_semi").select("ioc_type", "ioc_value", "source_name", "source_id", "raw_content_id").distinct()
    return (
        x.groupBy("ioc_type", "ioc_value")
        .agg(F.sort_array(F.collect_set("source_name")).alias("sources"), F.sort_array(F.collect_set("raw_content_id")).alias("finding_ids"), F.countDistinct("source_id").alias("source_count"))
        .where(F.col("source_count") >= least)
    )


def handle_reuse(raw: DataFrame, least: int = 2) -> DataFrame:
    """Authors active in several sources; a null author_id is a group of its own."""
    x = first_party(raw).where("author is not null and author <> ''")
    return (
        x.groupBy("author", "author_id")
        .agg(F.sort_array(F.collect_set("source_name")).alias("sources"), F.sort_array(F.collect_set("source_id")).alias("source_ids"), F.sort_array(F.collect_set("id")).alias("finding_ids"), F.countDistinct("source_id").alias("source_count"))
        .where(F.col("source_count") >= least)
        .withColumn("author_id", F.coalesce("author_id", F.lit("")))
    )


def temporal_overlap(sightings: DataFrame, raw: DataFrame, as_of: Column | None, window_hours: int = 48, least: int = 2) -> DataFrame:
    """Pairs of records of different sources, collected within the window, that share indicators. With ``as_of`` only records
    collected within the window before it take part.

    The join key holds the time bucket of one window; a record joins its own and the next bucket, so a frequent indicator
    pairs records that are near in time and not all of them; what is still frequent within a bucket is dealt into parts."""
    span = window_hours * 3600
    r = first_party(raw)
    if as_of is not None:
        r = r.where(micros(F.col("collected_at")) > micros(as_of) - F.lit(span * 1_000_000))
    r = r.select(F.col("id").alias("raw_content_id"), F.col("source_id").alias("sid"), F.col("source_name").alias("sname"), "collected_at")
    x = sightings.select("ioc_type", "ioc_value", "raw_content_id").distinct().join(r, "raw_content_id").withColumn("bucket", F.floor(F.unix_seconds("collected_at") / span))
    b, a = dealt(x, x.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1, F.col("bucket") - 1))), ["ioc_type", "ioc_value", "bucket"], "raw_content_id")
    a, b = a.alias("a"), b.alias("b")
    near = F.abs(micros(F.col("a.collected_at")) - micros(F.col("b.collected_at"))) <= F.lit(span * 1_000_000)
    same = (F.col("a.ioc_type") == F.col("b.ioc_type")) & (F.col("a.ioc_value") == F.col("b.ioc_value")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.part") == F.col("b.part"))
    pairs = a.join(b, same & (F.col("a.sid") != F.col("b.sid")) & (F.col("a.raw_content_id") < F.col("b.raw_content_id")) & near)
    key = F.concat(F.col("a.ioc_type"), F.lit(":"), F.col("a.ioc_value"))
    return (
        pairs.groupBy(F.col("a.raw_content_id").alias("finding_a"), F.col("b.raw_content_id").alias("finding_b"), F.col("a.sname").alias("source_a"), F.col("b.sname").alias("source_b"))
        .agg(F.sort_array(F.collect_set(key)).alias("shared_iocs"), F.countDistinct(key).alias("shared_count"))
        .where(F.col("shared_count") >= least)
    )


def display_name(entity: str) -> Column:
    return F.coalesce(F.col(f"{entity}.properties")["name"], F.col(f"{entity}.id"))


def entity_clusters(entities: DataFrame, edges: DataFrame, kind: str, least: int = 2) -> DataFrame:
    """Pairs of entities of one type that share targets.

    Edges are reduced to those of the type before the self-join. Targets that are channels are those of co-mention and
    can be very frequent; all of them count, as the rule says."""
    e = entities.select("id", F.coalesce(F.col("properties")["name"], F.col("id")).alias("name"), "type")
    mine = edges.select("source_id", "target_id").distinct().join(e.where(F.col("type") == kind).select(F.col("id").alias("source_id"), "name"), "source_id")
    shared = e.select(F.col("id").alias("target_id"), F.col("name").alias("shared_name"))
    mine = mine.join(shared, "target_id")
    a, b = dealt(mine, mine, ["target_id"], "source_id")
    a, b = a.alias("a"), b.alias("b")
    return (
        a.join(b, (F.col("a.target_id") == F.col("b.target_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.source_id") < F.col("b.source_id")))
        .groupBy(F.col("a.source_id").alias("entity_a"), F.col("a.name").alias("name_a"), F.col("b.source_id").alias("entity_b"), F.col("b.name").alias("name_b"))
        .agg(F.sort_array(F.collect_set("a.target_id")).alias("shared_ids"), F.sort_array(F.collect_set("a.shared_name")).alias("shared_names"), F.countDistinct("a.target_id").alias("shared_count"))
        .where(F.col("shared_count") >= least)
    )


def rule_shared_ioc(sightings: DataFrame, raw: DataFrame, threshold: int = 3) -> DataFrame:
    x = shared_iocs(sightings, raw)
    entities = F.concat(F.array(ioc_id(F.col("ioc_type"), F.col("ioc_value"))), F.transform("sources", lambda s: source_entity_id(s)))
    return x.select(
        cluster_id("shared_ioc", F.concat_ws(":", "ioc_type", "ioc_value")).alias("cluster_id"), F.lit("shared_ioc").alias("correlation_type"), F.lit("rule").alias("method"),
        entities.alias("entity_ids"), "finding_ids", correlation_confidence("shared_ioc", F.col("source_count")).alias("confidence"), (F.col("source_count") >= threshold).alias("is_correlation"),
    )


def rule_handle_reuse(raw: DataFrame, threshold: int = 3, blacklist: tuple[str, ...] = ()) -> DataFrame:
    x = handle_reuse(raw).where(~garbage_handle(F.col("author"), blacklist))
    actor = F.concat(F.lit("entity:threat_actor:"), F.lower(F.replace("author", F.lit(" "), F.lit("_"))))
    key = F.concat(F.col("author"), F.lit(":"), F.when(F.col("author_id") == "", "_").otherwise(F.col("author_id")))
    return x.select(
        cluster_id("handle_reuse", key).alias("cluster_id"), F.lit("handle_reuse").alias("correlation_type"), F.lit("rule").alias("method"),
        F.concat(F.array(actor), F.transform("sources", lambda s: source_entity_id(s))).alias("entity_ids"), "finding_ids",
        correlation_confidence("handle_reuse", F.col("source_count")).alias("confidence"), (F.col("source_count") >= threshold).alias("is_correlation"),
    )


def rule_temporal(sightings: DataFrame, raw: DataFrame, as_of: Column | None, window_hours: int = 48, threshold: int = 3) -> DataFrame:
    x = temporal_overlap(sightings, raw, as_of, window_hours)
    return x.select(
        cluster_id("temporal_overlap", F.concat_ws(":", "finding_a", "finding_b")).alias("cluster_id"), F.lit("temporal_overlap").alias("correlation_type"), F.lit("rule").alias("method"),
        F.transform("shared_iocs", lambda k: F.concat(F.lit("ioc:"), k)).alias("entity_ids"), F.array("finding_a", "finding_b").alias("finding_ids"),
        correlation_confidence("temporal_overlap", F.col("shared_count")).alias("confidence"), (F.col("shared_count") >= threshold).alias("is_correlation"),
    )


def rule_campaign(entities: DataFrame, edges: DataFrame, threshold: int = 3) -> DataFrame:
    x = entity_clusters(entities, edges, "threat_actor").unionByName(entity_clusters(entities, edges, "malware"))
    x = x.where(~F.forall("shared_names", lambda n: F.lower(n).isin(*TOOL_WHITELIST)))
    return x.select(
        cluster_id("campaign_cluster", F.concat_ws(":", "entity_a", "entity_b")).alias("cluster_id"), F.lit("campaign_cluster").alias("correlation_type"), F.lit("rule").alias("method"),
        F.concat(F.array("entity_a", "entity_b"), "shared_ids").alias("entity_ids"), F.array().cast("array<string>").alias("finding_ids"),
        correlation_confidence("campaign_cluster", F.col("shared_count")).alias("confidence"), (F.col("shared_count") >= threshold).alias("is_correlation"),
    )


def cycle(sightings: DataFrame, raw: DataFrame, entities: DataFrame, edges: DataFrame, as_of: Column | None, window_hours: int = 48, threshold: int = 3) -> DataFrame:
    """All four rules: strong results are correlations, weak ones candidates."""
    return (
        rule_shared_ioc(sightings, raw, threshold)
        .unionByName(rule_handle_reuse(raw, threshold))
        .unionByName(rule_temporal(sightings, raw, as_of, window_hours, threshold))
        .unionByName(rule_campaign(entities, edges, threshold))
    )


def apply_decisions(candidates: DataFrame, decisions: DataFrame, least_signals: int = 2, promote_at: float = 0.7) -> DataFrame:
    """Candidates after an analyst's round: promoted only with enough confidence (else deferred), rejected, or as they are."""
    d = decisions.select("cluster_id", F.col("decision").alias("_d"), F.col("confidence").alias("_c"))
    x = candidates.join(d, "cluster_id", "left")
    able = F.col("signal_count") >= least_signals
    outcome = F.when(able & (F.col("_d") == "promote") & (F.col("_c") >= promote_at), "promote").when(able & (F.col("_d") == "reject"), "reject").when(able & F.col("_d").isNotNull(), "defer")
    status = F.when(outcome == "promote", "promoted").when(outcome == "reject", "rejected").otherwise(F.col("status"))
    return x.withColumn("outcome", outcome).withColumn("status", status).drop("_d", "_c")


def candidate_context(candidates: DataFrame, raw: DataFrame, notes: DataFrame, per_candidate: int = 20) -> DataFrame:
    """What an analyst sees of each candidate: its first records (summary or start) and how many notes its records' authors have."""
    from tidewatch.operators.reads import top_per

    own = candidates.select("cluster_id", F.explode("finding_ids").alias("id")).join(raw.select("id", "author", "collected_at", F.coalesce("summary", F.left("content", F.lit(120))).alias("text")), "id")
    shown = top_per(own, ["cluster_id"], [F.col("collected_at"), F.col("id")], per_candidate)
    lists = shown.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("collected_at", "id", "text"))).alias("findings"))
    counts = own.select("cluster_id", F.col("author").alias("entity_id")).distinct().join(notes.where("status = 'active'").select("id", "entity_id"), "entity_id").groupBy("cluster_id").agg(F.countDistinct("id").alias("notes"))
    return candidates.select("cluster_id").join(lists, "cluster_id", "left").join(counts, "cluster_id", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))
