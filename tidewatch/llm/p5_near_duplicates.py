"""Near-duplicate records with small edits (problem 5).

Method: pigeonhole blocks. The fingerprint of a record is the sparse bit vector of its words (``wordset``); it is split
into blocks such that two records within the Hamming bound share one, the records are joined on their blocks, and the
Hamming distance is verified on the whole vectors. The blocks are exact: no close pair is missed.

Copies of one word multiset form a class; only classes are compared, and copies are expanded at the very end and only by
``close_pairs``. Null, empty and short texts (under ``min_words`` words) are close to nothing; ``near_duplicate_classes``
gives them a class of their own and no links. Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import wordset as ws
from tidewatch.llm.forest import components
from tidewatch.session import materialize
from tidewatch.tables import table

#: Copies of one text that one task joins, and classes of more copies that are few enough to broadcast.
MOST_COPIES = 2048
MOST_LARGE = 100_000


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content) of raw_content and findings."""
    return table(spark, sf_dir, "raw_content").select("id", "content").unionByName(table(spark, sf_dir, "findings").select("id", "content"))


def rerank(candidates: DataFrame, fp: DataFrame, t: float) -> DataFrame:
    """Candidate class pairs (a, b) -> those within the Hamming bound, from the whole vectors. Vectors that no candidate
    needs are dropped before they are shuffled twice."""
    candidates = materialize(candidates, "candidates")
    ends = candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    vectors = materialize(ws.sifted(fp.select("cls", "vec"), ends).join(ends, "cls", "left_semi").groupBy("cls").agg(F.first("vec").alias("vec")), "vectors")
    both = candidates.join(vectors.select(F.col("cls").alias("a"), F.col("vec").alias("va")), "a").join(vectors.select(F.col("cls").alias("b"), F.col("vec").alias("vb")), "b")
    return ws.verified(both, "va", "vb", ["a", "b"], t)


def class_pairs(fp: DataFrame, t: float = ws.SIMILARITY, hot: int = ws.HOT, min_words: int = ws.MIN_WORDS) -> DataFrame:
    """(a, b, similarity) of different word multisets (classes, a < b) at least ``t`` similar, from their fingerprints."""
    freq = ws.frequency_table(fp)
    rows = ws.blocks(fp, freq, ws.find_splits(fp, freq, t, hot, min_words), t, min_words=min_words)
    return rerank(ws.met(rows, t), fp, t)


def fingerprint_table(df: DataFrame, id_col: str = "id", text_col: str = "content", min_words: int = ws.MIN_WORDS) -> DataFrame:
    return materialize(ws.fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"], min_words), "fingerprints")


def _dealt(members: DataFrame, name: str, own: str, other: str) -> DataFrame:
    """Members of a class with the number of their own part, and a row for each part they are joined with."""
    return (
        members.withColumn(own, F.pmod(F.xxhash64("id"), F.col("parts")))
        .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("cls", F.col("id").alias(name), own, other)
    )


def expand(pairs: DataFrame, members: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Pairs (id_a, id_b), smaller id first, of the members of paired classes and of each class.

    A class of many copies is dealt into parts of about ``most`` and joined part by part, so that no task has a whole one."""
    m = materialize(members.select("cls", "id").distinct(), "members")
    parts = m.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("parts"))
    large = parts.where("parts > 1")
    m = m.join(F.broadcast(large) if large.count() <= MOST_LARGE else large, "cls", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    left, right = _dealt(m, "p", "i", "j"), _dealt(m, "q", "j", "i")
    within = left.join(right, ["cls", "i", "j"]).where("p < q").select(F.col("p").alias("id_a"), F.col("q").alias("id_b"))
    # Across classes the parts of the two are different: each side has its own number, the other is counted on the pair.
    sizes = m.groupBy("cls").agg(F.max("parts").alias("parts"))
    ends = (
        pairs.select("a", "b")
        .join(sizes.select(F.col("cls").alias("a"), F.col("parts").alias("parts_a")), "a")
        .join(sizes.select(F.col("cls").alias("b"), F.col("parts").alias("parts_b")), "b")
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_a") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_b") - 1)))
        .select("a", "b", "i", "j")
    )
    part = m.select("cls", "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    across = (
        ends.join(part.select(F.col("cls").alias("a"), F.col("id").alias("x"), F.col("part").alias("i")), ["a", "i"])
        .join(part.select(F.col("cls").alias("b"), F.col("id").alias("y"), F.col("part").alias("j")), ["b", "j"])
        .where("x != y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return within.unionByName(across)


def close_pairs(df: DataFrame, id_col: str = "id", text_col: str = "content", t: float = ws.SIMILARITY, min_words: int = ws.MIN_WORDS, hot: int = ws.HOT) -> DataFrame:
    """All pairs (id_a, id_b) of close texts, copies expanded."""
    fp = fingerprint_table(df, id_col, text_col, min_words)
    return expand(class_pairs(fp, t, hot, min_words), fp).distinct()


def near_duplicate_classes(df: DataFrame, id_col: str = "id", text_col: str = "content", t: float = ws.SIMILARITY, min_words: int = ws.MIN_WORDS, hot: int = ws.HOT) -> DataFrame:
    """One row per id: class_id (smallest id of the same word multiset), group_id (smallest id reachable through close
    pairs) and n_links (other records it is close to, counted without expanding copies)."""
    fp = fingerprint_table(df, id_col, text_col, min_words)
    classes = materialize(fp.groupBy("cls").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("copies")), "p5-classes")
    pairs = materialize(class_pairs(fp, t, hot, min_words), "p5-pairs")
    ends = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    links = ends.join(classes.select(F.col("cls").alias("other"), "copies"), "other").groupBy("cls").agg(F.sum("copies").alias("links"))
    group = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = classes.join(group.select(F.col("node").alias("cls"), "component"), "cls", "left").join(links, "cls", "left")
    named = linked.withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    per_class = named.join(smallest, "component").select("cls", "class_id", "group_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = fp.select("id", "cls").distinct().join(per_class, "cls").select("id", "class_id", "group_id", "n_links")
    rest = df.select(F.col(id_col).alias("id")).distinct().join(own.select("id"), "id", "left_anti")
    return own.unionByName(rest.select("id", F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(0).cast("long").alias("n_links")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_pairs(records(spark, sf_dir))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(records(spark, sf_dir))
