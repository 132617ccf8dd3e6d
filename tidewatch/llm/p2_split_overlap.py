"""Same or near-same records across splits (problem 2).

Method: minwise hashing with banded buckets. Shingles are a text's words with their occurrence number (the similarity of
TESTDATA.md is the Jaccard similarity of just these). Each of ``BANDS`` x ``ROWS`` hash functions keeps a text's least shingle,
rare shingles being drawn in proportion to their inverse document frequency, such that texts made of the same stock
phrases don't meet; ``ROWS`` minima form a bucket key. Only a train row and a row of another split make a candidate, sizes
and parity bits prune it within the join, and the exact Jaccard similarity decides.

A pair shares a bucket with probability 1 - (1 - s^4)^40, where s is its similarity weighted by how often each element is
drawn: above 0.9999 for s = 0.7, but s may be far lower where the pair differs in rare words (weights differ up to 16-fold).
So the buckets alone guarantee nothing; the pigeonhole blocks of ``wordset.blocks``, joined across splits only, add every
close pair that the buckets miss, and the result is exact.

Rows with null, empty or short text (under ``min_words`` words) have no partner; rows with another or no split take part
as neither side. Copies are compared once and expanded in the output of ``overlap_pairs``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import wordset as ws
from tidewatch.llm.p5_near_duplicates import rerank
from tidewatch.llm.wordset import _mix, binary_values
from tidewatch.session import materialize
from tidewatch.tables import table

BANDS, ROWS = 40, 4
TRAIN, EVAL = "train", ("val", "test")


def band_keys(e: np.ndarray, off: np.ndarray, shift: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) bucket keys. An element's hash is divided by 2^shift, which draws it about 2^shift times as often.
    Every text has an element."""
    keys = np.zeros((len(off) - 1, bands), np.uint64)
    start = off[:-1]
    base = e.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(bands * rows):
        h = _mix(base + np.uint64((k + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> shift
        least = np.minimum.reduceat(h, start)
        keys[:, k // rows] = _mix(keys[:, k // rows] * np.uint64(31) + least + np.uint64(k // rows))
    return keys.view(np.int64)


def buckets(fp: DataFrame, freq: np.ndarray, total: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n, cls, s1, s2) of each text's bands; copies within a batch count once."""
    rarity = np.log2(np.maximum(2.0, max(2, total) / np.maximum(1, freq)))
    shifts = fp.sparkSession.sparkContext.broadcast(np.floor(np.log2(rarity)).astype(np.uint8))
    mask = np.uint32(ws.BUCKETS - 1)
    schema = T.StructType([T.StructField("key", T.LongType()), *[fp.schema[c] for c in ("n", "cls", "s1", "s2")]])
    names = [f.name for f in schema]

    def run(batches):
        table = shifts.value
        for whole in batches:
            _, first = np.unique(whole.column(2).to_numpy(), return_index=True)
            whole = whole.take(pa.array(np.sort(first)))
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                e, off = binary_values(pa.concat_arrays([b.column(0)]))
                keys = band_keys(e, off, table[e & mask].astype(np.uint64), bands, rows)
                at = pa.array(np.repeat(np.arange(b.num_rows), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *[c.take(at) for c in b.columns[1:]]], names=names)

    return fp.select("vec", "n", "cls", "s1", "s2").mapInArrow(run, schema)


def block_candidates(fp: DataFrame, freq: np.ndarray, t: float, hot: int = ws.HOT, min_words: int = ws.MIN_WORDS) -> DataFrame:
    """(a, b): classes of a train row and of another split's row that share a block; no close pair is missing."""
    splits = ws.find_splits(fp, freq, t, hot, min_words)
    train = ws.blocks(fp.where(F.col("split") == TRAIN), freq, splits, t, "stored", min_words=min_words)
    held = ws.blocks(fp.where(F.col("split") != TRAIN), freq, splits, t, "probe", min_words=min_words)
    return ws.met_across(held, train, t).select(F.col("b").alias("a"), F.col("a").alias("b"))


def spread(x: DataFrame, y: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The rows of two sides to be joined by ``key``, with a further key ``part``: the rows of ``x`` under a key that has more than
    ``hot`` of them are dealt into parts by cls, and the rows of ``y`` under it are repeated for each part."""
    large = materialize(x.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, hot))).cast("int").alias("parts")).where("parts > 1"), "large-keys")
    parts = F.coalesce("parts", F.lit(1))
    dealt = x.join(large, "key", "left").withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int")).drop("parts")
    return dealt, y.join(large, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")


def overlap_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str = "split", t: float = ws.SIMILARITY, min_words: int = ws.MIN_WORDS, bands: int = BANDS, rows: int = ROWS, hot: int = ws.HOT) -> DataFrame:
    """(train_id, eval_id, eval_split): every close pair of a train row and a row of another split."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(split_col).alias("split")).where(F.col("split").isin(TRAIN, *EVAL))
    fp = materialize(ws.fingerprints(src, "text", ["id", "split"], min_words), "p2-fingerprints")
    freq = ws.frequency_table(fp)
    total = fp.count()
    x, y = spread(buckets(fp.where(F.col("split") == TRAIN), freq, total, bands, rows), buckets(fp.where(F.col("split") != TRAIN), freq, total, bands, rows), hot)
    x, y = x.alias("x"), y.alias("y")
    n_a, n_b = F.col("x.n"), F.col("y.n")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.cls") != F.col("y.cls")) & (F.least(n_a, n_b) >= ws.needed(n_a, n_b, t)) & ws.sketch_filter("x", "y", n_a, n_b, t))
    candidates = met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).unionByName(block_candidates(fp, freq, t, hot, min_words)).distinct()
    close = rerank(candidates, fp, t).select("a", "b")
    members = fp.select("cls", "id", "split").distinct()
    # Equal texts are a pair of classes as well. Copies of one text are dealt into parts, so no task has all of a class's pairs.
    train = members.where(F.col("split") == TRAIN).select(F.col("cls").alias("key"), F.col("id").alias("cls"))
    held = members.where(F.col("split") != TRAIN).select(F.col("cls").alias("b"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"))
    wanted = close.unionByName(held.select(F.col("b").alias("a"), "b").distinct()).join(held, "b").select(F.col("a").alias("key"), "eval_id", "eval_split")
    train, wanted = spread(train, wanted, hot)
    return train.join(wanted, ["key", "part"]).select(F.col("cls").alias("train_id"), "eval_id", "eval_split").distinct()


def overlap_report(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per split and source of the held-out record: overlapping pairs and records. ``sources``: (id, source_name); a null,
    blank or unknown name is ''. Names compare trimmed and in lower case."""
    name = F.lower(F.trim(F.coalesce("source_name", F.lit(""))))
    return (
        pairs.join(sources.select(F.col("id").alias("eval_id"), name.alias("source_name")), "eval_id", "left")
        .groupBy(F.col("eval_split").alias("split"), F.coalesce("source_name", F.lit("")).alias("source_name"))
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_records"))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap_pairs(table(spark, sf_dir, "stage1"))
    return pairs.where("train_id <> eval_id").select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(overlap_pairs(table(spark, sf_dir, "stage1")), table(spark, sf_dir, "raw_content").select("id", "source_name"))
