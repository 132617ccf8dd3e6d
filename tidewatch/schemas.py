"""Row types, closed vocabularies and id formats of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: vocabularies -------------------------------------------------------------------------------------
SOURCE_TYPES = ("telegram", "paste", "forum", "web")
REGISTRY_TYPES = ("telegram_channel", "telegram_group", "forum", "paste_site", "web", "rss")
SOURCE_STATUSES = ("discovered", "approved", "active", "paused", "dead", "banned", "rejected", "pending_triage")
SEVERITIES = ("info", "low", "medium", "high", "critical")
CATEGORIES = ("credential_leak", "malware_sample", "threat_actor_comms", "access_broker", "data_dump", "vulnerability", "canary_hit", "irrelevant")
SUB_CATEGORIES = {
    "malware_sample": ("malware_analysis", "malware_delivery", "c2_infrastructure", "malware_source_code", "malware_config"),
    "credential_leak": ("database_dump", "combo_list", "api_key_leak", "session_token", "stealer_log"),
    "vulnerability": ("vulnerability_disclosure", "exploit_poc", "exploit_weaponized", "patch_advisory", "vulnerability_discussion"),
    "threat_actor_comms": ("campaign_planning", "tool_discussion", "recruitment", "bragging"),
    "access_broker": ("rdp_access", "vpn_access", "shell_access", "database_access", "cloud_access"),
    "data_dump": ("corporate_data", "government_data", "personal_data", "healthcare_data"),
}
CATEGORY_TAG = {
    "credential_leak": "credentials",
    "malware_sample": "malware",
    "threat_actor_comms": "threat_actor",
    "access_broker": "access_sale",
    "data_dump": "data_breach",
    "vulnerability": "cve",
    "canary_hit": "canary",
}
PROVENANCES = ("first_party", "third_party_reporting", "unknown")
IOC_TYPES = ("ip", "domain", "url", "email", "cve", "hash_md5", "hash_sha1", "hash_sha256", "crypto_wallet")
IOC_ENTITY_TYPE = {"ip": "ip", "domain": "domain", "url": "url", "email": "email", "cve": "cve", "hash_md5": "hash", "hash_sha1": "hash", "hash_sha256": "hash"}
IOC_LIFETIME_DAYS = {"ip": 30, "domain": 90, "url": 14, "hash_md5": 365, "hash_sha256": 365, "email": 180, "cve": 180, "crypto_wallet": 365}
DEFAULT_LIFETIME_DAYS = 90
CANDIDATE_STATUSES = ("pending", "promoted", "rejected")
DECISIONS = ("promote", "reject", "defer")
CLASSIFICATION_VERSION = 3

S, TS, I, L, D, B = T.StringType(), T.TimestampType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
MAP, STRINGS = T.MapType(S, S), T.ArrayType(S)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FINDING = struct(id=S, source=S, source_id=S, source_name=S, content=S, content_hash=S, author=S, timestamp=TS, collected_at=TS, metadata=MAP)
RAW_CONTENT = struct(
    id=S, source_type=S, source_id=S, source_name=S, content=S, content_hash=S, author=S, author_id=S, url=S, language=S, collected_at=TS, posted_at=TS, metadata=MAP,
    classified=B, category=S, tags=STRINGS, severity=S, summary=S, entities_extracted=B, provenance=S, classification_version=I, sub_category=S, sub_metadata=MAP, sub_classified=B,
)
IOC = struct(
    type=S, value=S, context=S, source_content_id=S, first_seen=TS, last_seen=TS, sighting_count=L, threat_score=D, base_score=D, active=B, deactivated_at=TS, lifetime_days=I,
    enrichment=MAP, enriched_at=TS, enrichment_sources=STRINGS,
)
SIGHTING = struct(ioc_type=S, ioc_value=S, raw_content_id=S, source_id=S, source_name=S, created_at=TS)
ENTITY = struct(id=S, type=S, properties=MAP, dismissed=B, created_at=TS, updated_at=TS)
EDGE = struct(id=S, source_id=S, target_id=S, relationship=S, properties=MAP, created_at=TS)
CORRELATION = struct(cluster_id=S, correlation_type=S, method=S, entity_ids=STRINGS, finding_ids=STRINGS, confidence=D, evidence=S, created_at=TS)
CANDIDATE = struct(cluster_id=S, candidate_type=S, entity_ids=STRINGS, finding_ids=STRINGS, signal_count=L, signals=S, status=S, seen_count=L, created_at=TS)
NOTE = struct(id=S, note_type=S, status=S, entity_id=S, correlation_id=S, content=S, created_at=TS)
SOURCE = struct(id=S, type=S, identifier=S, name=S, status=S, last_collected=TS, error_count=I, created_at=TS)
VULNERABILITY = struct(
    cve_id=S, description=S, cvss_v31_score=D, cvss_v31_vector=S, cvss_severity=S, cwe_ids=STRINGS, affected_products=STRINGS, reference_urls=STRINGS, published_at=TS, last_modified_at=TS,
    epss_score=D, epss_percentile=D, kev_listed=B, kev_date_added=T.DateType(), kev_due_date=T.DateType(), kev_ransomware_use=B, exploit_available=B, mention_count=L, first_seen=TS, last_seen=TS,
    priority_score=D, priority_label=S,
)
TRAINING = struct(id=S, text=S, label=S, language=S, split=S, content_hash=S, collected_at=TS)
#: Declared by the reference's schema but never written there.
ARTIFACT = struct(id=S, finding_id=S, type=S, value=S, created_at=TS)
CANARY_TOKEN = struct(id=S, type=S, value=S, planted_where=S, planted_at=TS, triggered=B, triggered_at=TS)
ACTOR_PROFILE = struct(id=S, handles=STRINGS, platforms=STRINGS, threat_level=S, style_embedding=T.ArrayType(D), first_seen=TS, last_seen=TS)


def ioc_id(kind: Column, value: Column) -> Column:
    return F.concat(F.lit("ioc:"), kind, F.lit(":"), value)


def source_entity_id(name: Column) -> Column:
    return F.concat(F.lit("source:"), name)


def entity_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("entity:"), kind, F.lit(":"), F.lower(F.replace(name, F.lit(" "), F.lit("_"))))


def edge_id(source: Column, target: Column, relationship: Column) -> Column:
    return F.concat(F.lit("edge:"), source, F.lit(":"), target, F.lit(":"), relationship)


def cluster_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"corr:{kind}:"), F.sha2(key, 256))


def ioc_entity_type(kind: Column, keep_unmapped: bool = False) -> Column:
    """Graph type of an indicator type; unmapped ones are ``ioc``, or stay as they are in the backfill."""
    out = kind if keep_unmapped else F.lit("ioc")
    for k, v in IOC_ENTITY_TYPE.items():
        out = F.when(kind == k, v).otherwise(out)
    return out
