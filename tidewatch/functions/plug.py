"""Pluggable model steps with deterministic defaults, and recovery of JSON from model answers."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalar import category_tags, provenance_or_unknown
from tidewatch.functions.text import P_CVE, extract_iocs, found, garbage_handle, rejected_ioc
from tidewatch.functions.urls import classify_source

Step = Callable[[DataFrame], DataFrame]
#: Words by which the default classifier decides; the first category that hits wins (fixed values).
CATEGORY_WORDS = (
    ("vulnerability", r"(?i)\bCVE-\d{4}-\d{4,}|exploit"),
    ("credential_leak", r"(?i)password|combo|credential|пароль|учётк|логин"),
    ("malware_sample", r"(?i)trojan|loader|malware|троян|загрузчик|botnet"),
    ("access_broker", r"(?i)\bRDP\b|\bVPN\b|shell access|доступ"),
    ("data_dump", r"(?i)database|dump|leak|слив|выгрузк"),
)


def default_classify(df: DataFrame) -> DataFrame:
    category = F.lit("threat_actor_comms")
    for name, pattern in reversed(CATEGORY_WORDS):
        category = F.when(F.regexp_like("content", F.lit(pattern)), name).otherwise(category)
    return df.withColumn("category", category).withColumn("confidence", F.lit(0.5)).withColumn("provenance", F.lit("unknown")).withColumn("severity", F.lit("info"))


def default_extract(df: DataFrame) -> DataFrame:
    """(record_id, type, value, context): extracted indicators that pass validation."""
    x = df.select(F.col("id").alias("record_id"), F.explode(extract_iocs(F.col("content"))).alias("type", "vs")).select("record_id", "type", F.explode("vs").alias("value"))
    return x.where("type <> 'credential'").where(~rejected_ioc(F.col("type"), F.col("value"))).withColumn("context", F.lit(""))


def default_summarize(df: DataFrame) -> DataFrame:
    return df.withColumn("summary", F.left("content", F.lit(120)))


#: Words by which the default sub-classifier decides within a category; the first that hits wins (fixed values).
SUB_WORDS = (
    ("malware_sample", "c2_infrastructure", r"(?i)\bc2\b|command and control|panel"),
    ("malware_sample", "malware_source_code", r"(?i)source code|исходник"),
    ("malware_sample", "malware_delivery", r"(?i)loader|dropper|загрузчик"),
    ("credential_leak", "combo_list", r"(?i)combo"),
    ("credential_leak", "stealer_log", r"(?i)stealer|\blogs?\b"),
    ("credential_leak", "api_key_leak", r"(?i)api[ _-]?key"),
    ("vulnerability", "exploit_poc", r"(?i)\bpoc\b|proof of concept"),
    ("vulnerability", "patch_advisory", r"(?i)\bpatch"),
    ("access_broker", "rdp_access", r"(?i)\brdp\b"),
    ("access_broker", "vpn_access", r"(?i)\bvpn\b"),
    ("access_broker", "shell_access", r"(?i)\bshell\b"),
    ("threat_actor_comms", "recruitment", r"(?i)looking for|ищу|ищем"),
    ("data_dump", "government_data", r"(?i)government|ministry"),
    ("data_dump", "corporate_data", r"(?i)company|corporate|payroll"),
)


def default_sub_classify(df: DataFrame) -> DataFrame:
    """Rows with ``sub_category``: one of those of their category, or null."""
    sub = F.lit(None).cast("string")
    for category, name, pattern in reversed(SUB_WORDS):
        sub = F.when((F.col("category") == category) & F.regexp_like("content", F.lit(pattern)), name).otherwise(sub)
    return df.withColumn("sub_category", sub)


def default_severity(df: DataFrame) -> DataFrame:
    """Severity by the rules' rank in ``match.severity``; info without a match."""
    return df.withColumn("severity", F.coalesce("match.severity", F.lit("info")))


def default_entities(df: DataFrame) -> DataFrame:
    """(record_id, source, name, type, observed, confidence): authors that can be actors, and vulnerabilities named in the text."""
    base = df.select(F.col("id").alias("record_id"), F.coalesce(F.nullif("source_name", F.lit("")), "source_id").alias("source"), "author", "content")
    actors = base.where(~garbage_handle(F.col("author"))).select("record_id", "source", F.trim("author").alias("name"), F.lit("threat_actor").alias("type"), F.lit(True).alias("observed"), F.lit("high").alias("confidence"))
    cves = base.select("record_id", "source", F.explode(F.array_distinct(F.transform(found(F.coalesce("content", F.lit("")), P_CVE), F.upper))).alias("name"))
    return actors.unionByName(cves.select("record_id", "source", "name", F.lit("vulnerability").alias("type"), F.lit(False).alias("observed"), F.lit("medium").alias("confidence")))


def default_evaluate(df: DataFrame) -> DataFrame:
    """(cluster_id, signal_count, confidence) -> decision: promote what is strong, reject what is weak, defer the rest."""
    decision = F.when((F.col("signal_count") >= 2) & (F.col("confidence") >= 0.7), "promote").when(F.col("confidence") < 0.3, "reject").otherwise("defer")
    return df.withColumn("decision", decision)


def default_triage(df: DataFrame) -> DataFrame:
    """(identifier) -> verdict: onion addresses and paste sites are investigated, others are not answered (null)."""
    kind = classify_source(F.col("identifier"))
    return df.withColumn("verdict", F.when(kind.isin("forum", "paste_site", "telegram_channel", "telegram_group"), "investigate"))


def answered_iocs(answer: Column) -> Column:
    """Indicators of a model's answer: a bare array, or an object that wraps one as ``iocs`` or ``indicators``; none if neither."""
    item = "array<struct<type:string,value:string,context:string>>"
    x = recover_json(answer)
    wrapped = F.from_json(x, f"struct<iocs:{item},indicators:{item}>")
    bare = F.when(F.startswith(F.trim(x), F.lit("[")), F.from_json(x, item))
    return F.filter(F.coalesce(bare, wrapped["iocs"], wrapped["indicators"], F.array().cast(item)), lambda i: F.coalesce(i["value"], F.lit("")) != "")


def answered_triage(answer: Column) -> Column:
    """Verdicts of a model's answer: a bare array of (url, decision), or an object that wraps one as ``results`` or ``decisions``."""
    item = "array<struct<url:string,decision:string>>"
    x = recover_json(answer)
    wrapped = F.from_json(x, f"struct<results:{item},decisions:{item}>")
    bare = F.when(F.startswith(F.trim(x), F.lit("[")), F.from_json(x, item))
    return F.filter(F.coalesce(bare, wrapped["results"], wrapped["decisions"], F.array().cast(item)), lambda i: F.lower(i["decision"]).isin("investigate", "trash"))


@dataclass
class Plugins:
    """What a deployment replaces by its own models; each takes and returns a DataFrame."""

    classify: Step = default_classify
    extract: Step = default_extract
    summarize: Step = default_summarize
    sub_classify: Step = default_sub_classify
    assess_severity: Step = default_severity
    extract_entities: Step = default_entities
    evaluate: Step = default_evaluate
    triage: Step = default_triage
    enrichers: dict[str, Step] = field(default_factory=dict)
    collectors: dict[str, Callable] = field(default_factory=dict)
    #: Concurrent calls of a model step: the partitions its input gets.
    concurrency: int = 4

    def limited(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.concurrency)


def post_process(df: DataFrame) -> DataFrame:
    """White-listed provenance, tags with needs_review below 0.8, and info severity for irrelevant records."""
    return (
        df.withColumn("provenance", provenance_or_unknown(F.col("provenance")))
        .withColumn("tags", category_tags(F.col("category"), F.col("confidence")))
        .withColumn("severity", F.when(F.col("category") == "irrelevant", "info").otherwise(F.col("severity")))
    )


def recovered_json(text: str | None) -> str | None:
    """The first valid JSON object or array in an answer: bare, fenced, or somewhere in prose (objects before arrays)."""
    s = (text or "").strip()
    if not s:
        return None
    decoder = json.JSONDecoder()

    def at(i: int) -> str | None:
        try:
            return s[i : decoder.raw_decode(s, i)[1]]
        except ValueError:
            return None

    if s[0] in "{[" and (got := at(0)):
        return got
    if "```" in s:
        inner = s.split("```", 1)[1].partition("\n")[2]
        inner = inner.split("```", 1)[0].strip()
        for piece in (inner, inner[: inner.rfind("}") + 1].strip()):
            try:
                json.loads(piece)
                return piece
            except ValueError:
                pass
    for mark in "{[":
        i = s.find(mark)
        while i >= 0:
            if got := at(i):
                return got
            i = s.find(mark, i + 1)
    return None


def recover_json(c: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(recovered_json)

    return run(c)
