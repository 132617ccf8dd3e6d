"""Derived tables of the domain that the test data doesn't hold: indicators, correlations, candidates, vulnerabilities, notes.

Each has a Spark form and the same thing as a CTE, so queries over them can be compared with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalar import severity_rank
from tidewatch.operators.correlate import rule_shared_ioc
from tidewatch.operators.upsert import iocs_from_sightings, mention_counts, with_priorities
from tidewatch.tables import table

AS_OF = "2026-07-01 00:00:00"
AS_OF_SQL = "TIMESTAMPTZ '2026-07-01 00:00:00+00'"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def iocs(spark: SparkSession, d: str) -> DataFrame:
    return iocs_from_sightings(table(spark, d, "ioc_sightings"))


IOCS = """iocs AS (
  SELECT ioc_type AS type, ioc_value AS value, count(*) AS sighting_count, min(created_at) AS first_seen, max(created_at) AS last_seen,
         arg_min(raw_content_id, (created_at, raw_content_id)) AS source_content_id, 0.5::DOUBLE AS base_score, 0.5::DOUBLE AS threat_score, true AS active
  FROM ioc_sightings GROUP BY ALL)"""


def vulnerabilities(spark: SparkSession, d: str) -> DataFrame:
    """CVEs that were sighted; scores follow from the number, as there is no feed in the data."""
    s = table(spark, d, "ioc_sightings")
    n = F.regexp_extract("cve_id", r"(\d+)$", 1).cast("bigint")
    v = s.where("ioc_type = 'cve'").select(F.upper("ioc_value").alias("cve_id")).distinct()
    v = v.select(
        "cve_id", ((n % 1000) / 1000.0).alias("epss_score"), ((n % 101) / 10.0).alias("cvss_v31_score"), (n % 17 == 0).alias("kev_listed"), (n % 5 == 0).alias("exploit_available"),
    )
    return with_priorities(mention_counts(v, s))


VULNS = """seen AS (
  SELECT upper(ioc_value) AS cve_id, count(*) AS mention_count, min(created_at) AS first_seen, max(created_at) AS last_seen FROM ioc_sightings WHERE ioc_type = 'cve' GROUP BY 1),
vulns0 AS (
  SELECT cve_id, (n % 1000) / 1000.0::DOUBLE AS epss_score, (n % 101) / 10.0::DOUBLE AS cvss_v31_score, n % 17 = 0 AS kev_listed, n % 5 = 0 AS exploit_available, mention_count, first_seen, last_seen
  FROM (SELECT *, regexp_extract(cve_id, '(\\d+)$', 1)::BIGINT AS n FROM seen)),
vulns1 AS (
  SELECT *, CASE WHEN kev_listed THEN 1.0::DOUBLE ELSE 0.4::DOUBLE * epss_score + 0.3::DOUBLE * (cvss_v31_score / 10) + 0.2::DOUBLE * least(mention_count::DOUBLE / 10, 1.0::DOUBLE)
    + 0.1::DOUBLE * CASE WHEN exploit_available THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS priority_score FROM vulns0),
vulnerabilities AS (
  SELECT *, CASE WHEN priority_score >= 0.8 THEN 'critical' WHEN priority_score >= 0.6 THEN 'high' WHEN priority_score >= 0.3 THEN 'medium' WHEN priority_score >= 0.1 THEN 'low' ELSE 'info' END AS priority_label
  FROM vulns1)"""


def correlations(spark: SparkSession, d: str) -> DataFrame:
    return rule_shared_ioc(table(spark, d, "ioc_sightings"), table(spark, d, "raw_content"))


SHARED = """shared AS (
  SELECT s.ioc_type, s.ioc_value, list_sort(list(DISTINCT s.source_name) FILTER (s.source_name IS NOT NULL)) AS sources, list_sort(list(DISTINCT s.raw_content_id)) AS finding_ids, count(DISTINCT s.source_id) AS source_count
  FROM ioc_sightings s JOIN raw_content rc ON rc.id = s.raw_content_id
  WHERE rc.classified AND rc.category <> 'irrelevant' AND rc.provenance = 'first_party'
  GROUP BY 1, 2 HAVING count(DISTINCT s.source_id) >= 2)"""
CORRELATIONS = (
    SHARED
    + """,
correlations AS (
  SELECT 'corr:shared_ioc:' || sha256(ioc_type || ':' || ioc_value) AS cluster_id, 'shared_ioc' AS correlation_type, finding_ids,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.15::DOUBLE * source_count + 0.5::DOUBLE)) AS confidence, source_count >= 3 AS is_correlation, source_count
  FROM shared)"""
)


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Analytical notes made of classified records with a summary: one on the author of each."""
    r = table(spark, d, "raw_content").where("summary is not null and author is not null and trim(author) <> ''")
    kind = F.when(severity_rank(F.col("severity")) >= 3, "warning").otherwise("context")
    return r.select(F.concat(F.lit("note:"), "id").alias("id"), kind.alias("note_type"), F.when(F.col("sub_classified"), "active").otherwise("archived").alias("status"), F.col("author").alias("entity_id"), F.col("summary").alias("content"), F.col("collected_at").alias("created_at"))


NOTES = """notes AS (
  SELECT 'note:' || id AS id, CASE WHEN severity IN ('high', 'critical') THEN 'warning' ELSE 'context' END AS note_type, CASE WHEN sub_classified THEN 'active' ELSE 'archived' END AS status,
         author AS entity_id, summary AS content, collected_at AS created_at
  FROM raw_content WHERE summary IS NOT NULL AND author IS NOT NULL AND trim(author) <> '')"""
