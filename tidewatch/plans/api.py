"""The read routes as functions of (tables, parameters) -> DataFrame. ``Tables`` maps names to DataFrames; text parameters are
parsed as the routes do: bad numbers and times are ignored."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import float_param, int_param, parse_since
from tidewatch.operators import graph as gr
from tidewatch.operators import reads as rd
from tidewatch.operators import upsert as up
from tidewatch.operators import value as va

Tables = dict[str, DataFrame]
ROUTES: dict[str, Callable[..., DataFrame]] = {}


def route(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    ROUTES[f.__name__] = f
    return f


def _since(p: dict, as_of: datetime):
    return parse_since(p.get("since", ""), as_of)


def _page(p: dict, default: int = 50, most: int = 500) -> dict:
    return {"limit": int_param(p.get("limit")), "offset": int_param(p.get("offset")), "default": default, "most": most}


@route
def stats(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.stats(t["raw_content"], t["ioc_sightings"], t["sources"])


@route
def findings(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    rows = rd.findings(t["raw_content"], p.get("category"), p.get("sub_category"), p.get("severity"), p.get("source_type"), _since(p, as_of), p.get("q"))
    return rd.page(rd.finding_rows(rows), [F.col("collected_at").desc_nulls_first(), F.col("id")], **_page(p))


@route
def finding(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.finding_with_iocs(t["raw_content"], t["iocs"], p["id"])


@route
def iocs(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    rows = rd.iocs(t["iocs"], p.get("type"), p.get("q"), p.get("active") == "true", p.get("enriched") == "true")
    return rd.page(rows, [F.col("threat_score").desc_nulls_last(), F.col("type"), F.col("value")], **_page(p))


@route
def sources(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    rows = rd.sources(t["sources"], p.get("status", ""), p.get("type", ""))
    return rd.page(rows.join(va.content_counts(rows, t["raw_content"]).drop("name"), "id"), [F.desc("created_at"), F.col("id")], **_page(p))


@route
def source_type_counts(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.zero_filled(rd.sources(t["sources"], p.get("status", "")), rd.source_type_bucket(F.col("type")), ["rss", "telegram", "web", "other"])


@route
def source_values(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return va.source_values(t["raw_content"], t["ioc_sightings"], t["correlations"], F.lit(as_of)).orderBy(F.desc(F.coalesce("value_score", F.lit(0.0))), "src")


@route
def categories(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.category_shares(t["raw_content"]).orderBy(F.desc("count"), "category")


@route
def subcategories(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.sub_categories(t["raw_content"]).orderBy("category", F.desc("count"), "sub_category")


@route
def timeline(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    since = _since(p, as_of)
    rows = t["raw_content"].where(F.col("collected_at") >= F.lit(since)) if since else t["raw_content"]
    return rd.timeline(rows, p.get("interval", "1 hour")).orderBy("bucket")


@route
def entities(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    rows = gr.entities_with_degree(rd.entities(t["entities"].where("not dismissed"), p.get("type"), p.get("q")), t["edges"])
    return rd.page(rows, [F.desc("degree"), F.col("id")], **_page(p, 20, 100))


@route
def graph(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return gr.k_hop_edges(t["edges"], p["id"], int_param(p.get("hops"), 2) or 2)


@route
def actor_profile(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return gr.dossier(p["id"], t["entities"], t["edges"], t["raw_content"], t["correlations"], t["notes"])


@route
def correlations(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.page(rd.correlations(t["correlations"], p.get("type"), float_param(p.get("min_confidence")), _since(p, as_of)), [F.desc("confidence"), F.col("cluster_id")], **_page(p))


@route
def decisions(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.page(rd.decisions(t["decisions"], p.get("decision")), [F.desc("created_at"), F.col("cluster_id")], **_page(p, 20, 200))


@route
def notes(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.page(rd.notes(t["notes"], p.get("type"), p.get("status", "active"), p.get("entity_id")), [F.desc("created_at"), F.col("id")], **_page(p, 20, 200))


@route
def vulnerabilities(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    rows = rd.vulnerabilities(t["vulnerabilities"], float_param(p.get("min_priority")), p.get("kev") == "true", float_param(p.get("min_epss")), p.get("exploit") == "true", p.get("mentioned") == "true", p.get("q"))
    return rd.page(rows, [F.col("priority_score").desc_nulls_last(), F.col("cve_id")], **_page(p))


@route
def vulnerability(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return t["vulnerabilities"].where(F.col("cve_id") == p["id"])


@route
def brief(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return va.daily_brief(t["raw_content"], t["ioc_sightings"], t["entities"], t["edges"], as_of)


@route
def public_stats(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.stats(t["raw_content"], t["ioc_sightings"], t["sources"]).where("metric = 'total'")


@route
def public_recent(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return rd.public_recent(t["raw_content"])


@route
def search(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    rows = rd.archive_search(t["raw_content"], p.get("q"), p.get("category"), [x for x in p.get("tags", "").split(",") if x], _since(p, as_of), p.get("author"))
    return rd.page(rows.select("id", "collected_at", "category", "author", F.left("content", F.lit(80)).alias("content")), [F.desc("collected_at"), F.col("id")], **_page(p))


@route
def ioc_cleanup(t: Tables, p: dict, as_of: datetime) -> DataFrame:
    return up.deactivate_by_pattern(t["iocs"])
