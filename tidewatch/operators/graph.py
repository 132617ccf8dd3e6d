"""The property graph: neighbourhoods, degrees, trends, bridges and dossiers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schemas import edge_id, entity_id, ioc_entity_type, ioc_id, source_entity_id
from tidewatch.session import materialize


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def entities_with_degree(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def neighbours(edges: DataFrame, entities: DataFrame, of: str) -> DataFrame:
    """Outgoing and incoming edges of a node with the node at the other end, in a fixed order."""
    out = edges.where(F.col("source_id") == of).select(F.col("target_id").alias("id"), "relationship", F.lit("outgoing").alias("direction"))
    into = edges.where(F.col("target_id") == of).select(F.col("source_id").alias("id"), "relationship", F.lit("incoming").alias("direction"))
    return out.unionByName(into).join(entities.select("id", "type", F.coalesce(F.col("properties")["name"], F.col("id")).alias("name")), "id").orderBy("direction", "id", "relationship")


def reachable(edges: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """(id, depth) of nodes within ``hops`` (at most 5) of ``start``, itself at 0, edges in both directions.

    Each hop joins only the frontier and drops visited nodes, so the work is that of the edges met."""
    hops = min(max(hops, 1), 5)
    both = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionByName(edges.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"))).distinct()
    frontier = edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    seen = frontier
    for depth in range(1, hops + 1):
        step = both.join(frontier.select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = materialize(step.withColumn("depth", F.lit(depth)), "hop")
        seen = seen.unionByName(frontier)
    return seen


def k_hop_edges(edges: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """Edges between nodes within reach; a node without edges has none."""
    near = reachable(edges, start, hops).select("id")
    return edges.join(near.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(near.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def incident(edges: DataFrame) -> DataFrame:
    """Each edge once for each of its ends (a loop once)."""
    return edges.withColumn("id_of", F.explode(F.array_distinct(F.array("source_id", "target_id"))))


def trending(entities: DataFrame, edges: DataFrame, split: datetime, start: datetime, end: datetime) -> DataFrame:
    """Distinct connections of each entity in [split, end] against [start, split]; both hold the border instant."""
    x = incident(edges.select("source_id", "target_id", "created_at").where(F.col("created_at").between(F.lit(start), F.lit(end))))
    link = F.concat("source_id", "target_id")
    current, before = F.col("created_at") >= F.lit(split), F.col("created_at") <= F.lit(split)
    g = x.groupBy(F.col("id_of").alias("id")).agg(F.countDistinct(F.when(current, link)).alias("current"), F.countDistinct(F.when(before, link)).alias("previous"))
    return g.where("current > 0").join(entities.select("id", "type"), "id")


def bridge_iocs(records: DataFrame, iocs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph nodes and found_in edges of extracted indicators (record id, type, value, context)."""
    r = records.select(F.col("id").alias("record_id"), F.coalesce(F.nullif("source_name", F.lit("")), F.col("source_id")).alias("source"), "source_type")
    x = iocs.join(r, "record_id")
    ident = ioc_id(F.col("type"), F.col("value"))
    props = F.map_filter(F.create_map(F.lit("value"), F.col("value"), F.lit("context"), F.nullif("context", F.lit(""))), lambda k, v: v.isNotNull())
    nodes = x.select(ident.alias("id"), ioc_entity_type(F.col("type")).alias("type"), props.alias("properties"))
    hubs = r.select(source_entity_id(F.col("source")).alias("id"), F.lit("channel").alias("type"), F.create_map(F.lit("name"), F.col("source"), F.lit("source_type"), F.col("source_type")).alias("properties"))
    target = source_entity_id(F.col("source"))
    links = x.select(edge_id(ident, target, F.lit("found_in")).alias("id"), ident.alias("source_id"), target.alias("target_id"), F.lit("found_in").alias("relationship")).dropDuplicates(["id"])
    return nodes.unionByName(hubs), links


def bridge_entities(extracted: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``extracted`` (record_id, source, name, type, observed, confidence) and ``relations`` (record_id, source_name, target_name,
    relationship) -> nodes and edges. Low confidence is dropped, medium marked; a relation between two ends that were not
    observed is only a reference."""
    x = extracted.where("name is not null and name <> '' and confidence <> 'low'").withColumn("id", entity_id(F.col("type"), F.col("name")))
    props = F.map_filter(
        F.create_map(F.lit("name"), F.col("name"), F.lit("observed"), F.when(F.col("observed"), "true"), F.lit("needs_review"), F.when(F.col("confidence") == "medium", "true")), lambda k, v: v.isNotNull()
    )
    target = source_entity_id(F.col("source"))
    mentions = x.select(edge_id(F.col("id"), target, F.lit("mentioned_in")).alias("id"), F.col("id").alias("source_id"), target.alias("target_id"), F.lit("mentioned_in").alias("relationship"))
    ends = x.groupBy("record_id", "name").agg(F.max_by("id", "id").alias("id"), F.max("observed").alias("observed"))
    r = relations.where("relationship is not null and relationship <> ''")
    r = r.join(ends.select("record_id", F.col("name").alias("source_name"), F.col("id").alias("a"), F.col("observed").alias("oa")), ["record_id", "source_name"])
    r = r.join(ends.select("record_id", F.col("name").alias("target_name"), F.col("id").alias("b"), F.col("observed").alias("ob")), ["record_id", "target_name"])
    weak = ~F.coalesce("oa", F.lit(False)) & ~F.coalesce("ob", F.lit(False)) & ~F.col("relationship").isin("referenced_in", "mentioned_in")
    kind = F.when(weak, "referenced_in").otherwise(F.col("relationship"))
    links = r.select(edge_id(F.col("a"), F.col("b"), kind).alias("id"), F.col("a").alias("source_id"), F.col("b").alias("target_id"), kind.alias("relationship"))
    return x.select("id", "type", props.alias("properties")), mentions.unionByName(links).dropDuplicates(["id"])


def names_for_record(edges: DataFrame, entities: DataFrame, sightings: DataFrame, record_id: str) -> DataFrame:
    """Distinct names of the entities and indicators of a record."""
    own = edges.where(F.col("properties")["raw_content_id"] == record_id).select(F.col("source_id").alias("id"))
    seen = sightings.where(F.col("raw_content_id") == record_id).select(ioc_id(F.col("ioc_type"), F.col("ioc_value")).alias("id"))
    e = entities.select("id", F.coalesce(F.col("properties")["name"], F.col("id")).alias("name"))
    return own.unionByName(seen).distinct().join(e, "id", "left").select(F.coalesce("name", "id").alias("name")).distinct().orderBy("name").limit(50)


def ioc_values_for_record(sightings: DataFrame, record_id: str) -> DataFrame:
    return sightings.where(F.col("raw_content_id") == record_id).select(F.concat_ws(":", "ioc_type", "ioc_value").alias("value")).distinct().orderBy("value").limit(50)


def resolved_names(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """(cluster_id, entity_ids) -> names in the ids' order; unknown ids are left out."""
    x = groups.select("cluster_id", F.posexplode("entity_ids").alias("pos", "id")).join(entities.select("id", F.coalesce(F.col("properties")["name"], F.col("id")).alias("name")), "id")
    return x.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("names"))


def neighbour_bucket(kind: Column) -> Column:
    return F.when(kind == "malware", "malware").when(kind == "tool", "tools").when(kind.isin("ip", "domain", "url", "hash", "infrastructure"), "infrastructure").when(kind == "campaign", "campaigns").otherwise("targets")


def dossier(actor: str, entities: DataFrame, edges: DataFrame, raw: DataFrame, correlations: DataFrame, notes: DataFrame) -> DataFrame:
    """One row on an actor: neighbours by kind, records, first and last seen, correlations, notes."""
    n = neighbours(edges, entities, actor).select(neighbour_bucket(F.col("type")).alias("kind"), "name").distinct()
    lists = n.groupBy(F.lit(actor).alias("id")).agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in ("malware", "tools", "infrastructure", "campaigns", "targets")])
    records = edges.where(F.col("source_id") == actor).select(F.col("properties")["raw_content_id"].alias("rid")).where("rid is not null").distinct().join(raw.select(F.col("id").alias("rid"), "collected_at"), "rid")
    seen = records.agg(F.count(F.lit(1)).alias("findings"), F.min("collected_at").alias("first_seen"), F.max("collected_at").alias("last_seen")).withColumn("id", F.lit(actor))
    corr = correlations.where(F.array_contains("entity_ids", actor)).agg(F.count(F.lit(1)).alias("correlations")).withColumn("id", F.lit(actor))
    note = notes.where((F.col("entity_id") == actor) & (F.col("status") == "active")).agg(F.count(F.lit(1)).alias("notes"), F.max_by("content", "created_at").alias("latest_note")).withColumn("id", F.lit(actor))
    return entities.where(F.col("id") == actor).select("id", F.coalesce(F.col("properties")["name"], F.col("id")).alias("name"), "type").join(lists, "id", "left").join(seen, "id").join(corr, "id").join(note, "id")


def actor_counts(entities: DataFrame) -> DataFrame:
    """Dismissed and active threat actors."""
    return entities.where("type = 'threat_actor'").groupBy("dismissed").agg(F.count(F.lit(1)).alias("actors"))


def active_actors(entities: DataFrame, edges: DataFrame, raw: DataFrame, since: datetime, fetch: int = 40, keep: int = 10) -> DataFrame:
    """The ``fetch`` newest actors, of which the first ``keep`` with recent records or neighbours stay."""
    actors = entities.where("type = 'threat_actor' and not dismissed").orderBy(F.desc("created_at"), "id").limit(fetch)
    recent = edges.select(F.col("source_id").alias("id"), F.col("properties")["raw_content_id"].alias("rid")).join(raw.where(F.col("collected_at") >= F.lit(since)).select(F.col("id").alias("rid")), "rid")
    x = actors.join(recent.groupBy("id").agg(F.countDistinct("rid").alias("recent")), "id", "left").where("recent > 0")
    return x.orderBy(F.desc("created_at"), "id").limit(keep).select("id", "recent")
