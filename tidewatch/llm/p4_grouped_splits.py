"""Splits that keep related records together (problem 4).

Method: Borůvka-style minimum-edge contraction builds a persisted spanning forest (``forest``); the roots are stratified by
size band and dealt systematically to the splits.

The graph has the *keys* (source names, authors, entities) as nodes, not the records: a record only links its own keys, so
the graph is as large as the number of distinct links, and a key that a third of all records share is one node whose
records were counted before any shuffle. A link's weight is the negative number of records that carry it, so the forest
keeps the strongest links. Records without any key are groups of their own.

Names compare trimmed, in lower case and without one leading ``@``; null and blank ones link nothing, nor do authors that
name nobody. Repeated rows of one id are one record. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewatch.llm.forest import spanning_forest
from tidewatch.session import materialize
from tidewatch.tables import table

PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}
#: Groups of at least a thousandth of all records, at most a thousand of them, are dealt one by one.
LARGE = 1000
#: Buckets of hashed ids that a band is cumulated over.
BUCKETS = 1024


def name_form(c: Column) -> Column:
    """The compared form of a name; null if nothing is left."""
    x = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    x = F.regexp_replace(F.regexp_replace(x, "^@", ""), r"(?U)^\s+|\s+$", "")
    return F.when(x != "", x)


def key_of(kind: str, c: Column) -> Column:
    return F.xxhash64(F.lit(kind), c)


def record_keys(ids: DataFrame, raw: DataFrame, edges: DataFrame, generic: DataFrame) -> DataFrame:
    """(id, key, source): the keys of each id; source is the name if the key is one."""
    own = raw.select("id", "source_name", "author").join(ids.select("id").distinct(), "id", "left_semi").distinct()
    nobody = generic.select(name_form(F.col("handle")).alias("author")).where("author is not null").distinct()
    source = own.select("id", name_form(F.col("source_name")).alias("source")).where("source is not null").select("id", key_of("source", F.col("source")).alias("key"), "source")
    author = own.select("id", name_form(F.col("author")).alias("author")).where("author is not null").join(nobody, "author", "left_anti").select("id", key_of("author", F.col("author")).alias("key"), F.lit(None).cast("string").alias("source"))
    entity = (
        edges.select(F.col("properties").getItem("raw_content_id").alias("id"), F.col("source_id").alias("entity"))
        .where("id is not null and entity is not null")
        .join(ids.select("id").distinct(), "id", "left_semi")
        .select("id", key_of("entity", F.col("entity")).alias("key"), F.lit(None).cast("string").alias("source"))
    )
    return source.unionByName(author).unionByName(entity).distinct()


def linked_groups(ids: DataFrame, raw: DataFrame, edges: DataFrame, generic: DataFrame, forest_path: str | None = None) -> DataFrame:
    """(id, component, group_key) of every id; group_key is the group's smallest source name or null."""
    keys = materialize(record_keys(ids, raw, edges, generic), "p4-keys")
    least = keys.groupBy("id").agg(F.min("key").alias("u"))
    links = keys.join(least, "id").groupBy("u", F.col("key").alias("v")).agg((-F.count(F.lit(1))).alias("w"))
    labels, _ = spanning_forest(links, forest_path)
    names = keys.where("source is not null").select("key", "source").distinct().join(labels.withColumnRenamed("node", "key"), "key").groupBy("component").agg(F.min("source").alias("group_key"))
    of_key = labels.join(names, "component", "left").select(F.col("node").alias("u"), "component", "group_key")
    placed = least.join(of_key, "u").select("id", "component", "group_key")
    return (
        ids.select("id")
        .distinct()
        .join(placed, "id", "left")
        .select("id", F.coalesce("component", key_of("record", F.col("id"))).alias("component"), "group_key")
    )


def deal(groups: DataFrame, proportions: dict[str, float] = PROPORTIONS, seed: int = 7) -> DataFrame:
    """(component, size) -> (component, size, band, split), close to ``proportions`` of the summed sizes.

    Bands are powers of two of the size. Groups above 1 / LARGE of all records come first, each to the split that lacks
    most; the others are laid end to end within their band, in hashed order, and each goes to the split in whose share of the
    band its middle falls, the shares being what the large ones left open."""
    g = groups.select("component", "size", F.floor(F.log2(F.col("size").cast("double"))).cast("int").alias("band"))
    spark = groups.sparkSession
    total = g.agg(F.sum("size")).first()[0] or 0
    lack = {s: p * total for s, p in proportions.items()}
    dealt = []
    for row in g.where(F.col("size") * LARGE >= F.lit(total)).orderBy(F.desc("size"), "component").toLocalIterator():
        split = max(lack, key=lambda s: (lack[s] / (proportions[s] * total), lack[s]) if lack[s] >= row["size"] / 2 else (-1, lack[s]))
        lack[split] -= row["size"]
        dealt.append((row["component"], split))
    large = spark.createDataFrame(dealt, "component bigint, split string")
    left = {s: max(0.0, x) for s, x in lack.items()}
    whole = sum(left.values()) or 1.0
    small = g.where(F.col("size") * LARGE < F.lit(total)).withColumn("h", F.xxhash64("component", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    per = small.groupBy("band", "bucket").agg(F.sum("size").alias("s"))
    over = Window.partitionBy("band").orderBy("bucket")
    per = per.select("band", "bucket", (F.sum("s").over(over) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy("band")).alias("of"))
    inside = Window.partitionBy("band", "bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)
    place = small.withColumn("upto", F.sum("size").over(inside)).join(per, ["band", "bucket"])
    middle = (F.col("before") + F.col("upto") - F.col("size") / 2) / F.col("of")
    split, edge = F.lit(list(left)[-1]), 1.0
    for s in reversed(list(left)):
        split = F.when(middle < edge, F.lit(s)).otherwise(split)
        edge -= left[s] / whole
    return place.select("component", "size", "band", split.alias("split")).unionByName(g.join(large, "component").select("component", "size", "band", "split"))


def assign_splits(ids: DataFrame, raw: DataFrame, edges: DataFrame, generic: DataFrame, proportions: dict[str, float] = PROPORTIONS, forest_path: str | None = None) -> DataFrame:
    """(id, component, group_key, split): every id, whole groups in one split."""
    groups = materialize(linked_groups(ids, raw, edges, generic, forest_path), "p4-groups")
    dealt = deal(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")), proportions)
    return groups.join(dealt.select("component", "split"), "component").select("id", "component", "group_key", "split")


def _inputs(spark: SparkSession, sf_dir: str):
    return [table(spark, sf_dir, n) for n in ("stage1", "raw_content", "edges", "generic_handles")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(*_inputs(spark, sf_dir)).where("group_key is not null").select("id", "group_key")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(*_inputs(spark, sf_dir))
