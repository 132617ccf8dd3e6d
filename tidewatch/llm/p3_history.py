"""Deduplicating new batches against all history (problem 3).

Method: persisted inverted-file vector cells with full vectors. A record's vector is its sparse word-count vector (each
word and occurrence is a coordinate, hashed to 32 bits); the distance is the L1 distance, for which

    close  <=>  L1(q, x) <= (1 - t) / (1 + t) * (|q| + |x|)

In so many dimensions distances to centroids concentrate, and no ball around a centroid can be skipped by the triangle
inequality (``ball_cells_skipped`` measures it, the README has the figure), so the coarse quantiser is the inverted file
itself: a cell is a block of leading coordinates (in one global order, rare ones first; ``wordset``), and a vector stands in the
cells of its leading coordinates. A query is probed in order of the distance bound:

1. the class of its equal vectors (distance 0): where an earlier record has it, no nearer match is possible and the probe ends;
2. its cells in the coordinates' order. Each cell passed lowers the greatest overlap that an unseen vector can still have
   by one; the probe ends where that bound falls below the closeness wanted, so nothing close is left out. Norms, coordinates
   skipped and 128 parity bits stand in the cell and give three more bounds before the full vectors are read;
3. the candidates' full vectors are reranked exactly.

What a batch costs. History is never vectorised, sorted or shuffled again. Cells and first records lie bucketed and
sorted by key; row groups are small and carry a Bloom filter of their keys, those of the vectors of their
classes. A batch that wants at most ``FEW`` keys reads only the row groups that can hold one; a larger one joins the buckets in place. Only classes without an
earlier record are probed, and only new classes are appended. Once the index has doubled since its order was made,
``reorder`` makes order and cells anew from the stored vectors and merges the segments, so words that became frequent since
do not grow a cell without end; its cost is constant a record over the index's life.

Layout under the index's path: ``vectors/segment=K`` and, for each order G, ``order-G`` (counters), ``splits-G``, ``firsts-G``
(class, first record) and ``cells-G``.

Null, empty and short contents (under ``min_words`` words) are never repeats and never make others repeats. Ties in
(batch_no, collected_at) are ordered by id; a null collected_at comes first. All history stands before all batches; among
batches a null batch_no comes last, as in the SQL. Repeated rows of one id are one record. Batches may come in any order:
each is compared with what stands before it among all that was added so far.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import wordset as ws
from tidewatch.session import materialize, shared_path
from tidewatch.tables import table

ORDER = ["stage", "batch_no", "collected_at", "id"]
FIRST = "stage int, batch_no int, collected_at timestamp, id string"
#: ``stage``: what was accepted before the first batch, batches with a number, batches without one.
HISTORY, NUMBERED, UNNUMBERED = 0, 1, 2
#: Keys that are looked up one by one; more are joined bucket by bucket.
FEW = 20_000
#: Bytes of a row group, the least that a look-up reads.
GROUP_BYTES = 1 << 21
#: Classes a bucket is made for, and the most buckets.
BUCKET_CLASSES, MOST_BUCKETS = 8192, 8192


def _groups(key: str, size: int) -> dict[str, str]:
    """Parquet settings: small row groups, each with a Bloom filter of its keys."""
    return {"parquet.block.size": str(size), f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(max(64, size // 32))}


def few(wanted: DataFrame) -> list[int] | None:
    """The values of a one-column table if there are at most ``FEW``."""
    got = wanted.limit(FEW + 1).toArrow().column(0)
    return got.to_pylist() if len(got) <= FEW else None


class CellIndex:
    """The persisted cells. ``path`` lies in the folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, t: float = ws.SIMILARITY, min_words: int = ws.MIN_WORDS, hot: int = ws.HOT, buckets: int | None = None, group_bytes: int = GROUP_BYTES):
        self.spark, self.path, self.t, self.min_words, self.hot, self.buckets, self.group_bytes = spark, path, t, min_words, hot, buckets, group_bytes
        self._order: tuple[int, np.ndarray, list[ws.Splits], int, int] | None = None

    def _bucketed(self, name: str, columns: str, key: str, buckets: int) -> str:
        """A table of this session over the folder ``name``, bucketed and sorted by ``key``."""
        own = f"cell_index_{hashlib.md5(f'{self.path}/{name}'.encode()).hexdigest()}"
        options = ", ".join(f"'{k}' = '{v}'" for k, v in _groups(key, self.group_bytes).items())
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {own} ({columns}) USING parquet OPTIONS ({options}) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return own

    def _cells(self, order: int, buckets: int) -> str:
        return self._bucketed(f"cells-{order}", "key bigint, np bigint, cls bigint, s1 bigint, s2 bigint", "key", buckets)

    def _firsts(self, order: int, buckets: int) -> str:
        return self._bucketed(f"firsts-{order}", f"cls bigint, {FIRST}", "cls", buckets)

    def _load(self) -> tuple[int, np.ndarray, list[ws.Splits], int, int]:
        """The newest order: its number, counters, large blocks, the classes it was made from, and its buckets."""
        if self._order is None:
            number, classes, buckets = self.spark.read.parquet(f"{self.path}/orders").agg(F.max(F.struct("number", "classes", "buckets")).alias("x")).first()["x"]
            got = self.spark.read.parquet(f"{self.path}/order-{number}").toArrow()
            freq = np.zeros(ws.BUCKETS, np.int32)
            freq[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
            split = self.spark.read.parquet(f"{self.path}/splits-{number}").toPandas()
            levels = []
            for _, x in split.groupby("level"):
                order = np.argsort(x["key"].to_numpy().view(np.uint64))
                levels.append(ws.Splits(*[x[c].to_numpy()[order].view(np.uint64) if c == "key" else x[c].to_numpy()[order] for c in ws.Splits._fields]))
            self._order = number, freq, levels, classes, buckets
        return self._order

    def _save(self, number: int, freq: np.ndarray, splits: list[ws.Splits], classes: int, buckets: int) -> None:
        at = np.flatnonzero(freq)
        self.spark.createDataFrame(pa.table({"bucket": at.astype(np.int32), "n": freq[at]})).coalesce(1).write.parquet(f"{self.path}/order-{number}")
        columns = {c: np.concatenate([getattr(x, c) for x in splits]) if splits else np.empty(0, np.int64) for c in ws.Splits._fields}
        kept = {c: pa.array(v.view(np.int64) if c == "key" else v.astype(bool if c == "split" else np.int64)) for c, v in columns.items()}
        level = np.concatenate([np.full(len(x.key), i) for i, x in enumerate(splits)]) if splits else np.empty(0, np.int64)
        self.spark.createDataFrame(pa.table({"level": pa.array(level.astype(np.int64)), **kept})).coalesce(1).write.parquet(f"{self.path}/splits-{number}")
        self.spark.createDataFrame([(number, classes, buckets)], "number int, classes bigint, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/orders")
        self._order = number, freq, splits, classes, buckets

    def build(self, history: DataFrame) -> "CellIndex":
        """Index ``history`` (id, content, collected_at)."""
        self._vectors(history.withColumns({"stage": F.lit(HISTORY), "batch_no": F.lit(None).cast("int")}), 0)
        self.reorder(0)
        return self

    def reorder(self, number: int) -> None:
        """Make the order, the large blocks, first records and all cells from the stored vectors, in as many buckets as they need."""
        vectors = self.vectors()
        first = materialize(vectors.groupBy("cls").agg(F.min(F.struct(*ORDER)).alias("first")).select("cls", "first.*"), "firsts")
        classes = first.count()
        buckets = self.buckets or int(min(MOST_BUCKETS, max(8, classes // BUCKET_CLASSES)))
        first.repartition(buckets, "cls").write.insertInto(self._firsts(number, buckets))
        freq = ws.frequency_table(vectors)
        splits = ws.find_splits(vectors, freq, self.t, self.hot, self.min_words)
        ws.blocks(vectors, freq, splits, self.t, "stored", min_words=self.min_words).repartition(buckets, "key").write.insertInto(self._cells(number, buckets))
        self._hold(classes)
        self._save(number, freq, splits, classes, buckets)

    def _vectors(self, rows: DataFrame, segment: int) -> DataFrame:
        at = f"{self.path}/vectors/segment={segment}"
        fp = ws.fingerprints(rows.select(*[F.col(c) for c in ORDER], F.col("content").alias("text")), "text", ORDER, self.min_words)
        fp.write.options(**_groups("cls", self.group_bytes)).parquet(at)
        return self.spark.read.schema(fp.schema).parquet(at)

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def near(self, vectors: DataFrame) -> DataFrame:
        """(a, b): classes of ``vectors`` and close, different ones anywhere in the index, by the full vectors."""
        number, freq, splits, _, buckets = self._load()
        probes = materialize(ws.blocks(vectors, freq, splits, self.t, "probe", min_words=self.min_words), "probes")
        cells = self.spark.table(self._cells(number, buckets))
        keys = few(probes.select("key").distinct())
        candidates = materialize(ws.met_across(probes, cells if keys is None else cells.where(F.col("key").isin(keys)), self.t).distinct(), "candidates")
        ends = materialize(candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "ends")
        wanted, full = few(ends), self.vectors().select("cls", "vec")
        full = ws.sifted(full, ends).join(ends, "cls", "left_semi") if wanted is None else full.where(F.col("cls").isin(wanted))
        full = materialize(full.groupBy("cls").agg(F.first("vec").alias("vec")), "full")
        both = candidates.join(full.select(F.col("cls").alias("a"), F.col("vec").alias("va")), "a").join(full.select(F.col("cls").alias("b"), F.col("vec").alias("vb")), "b")
        return materialize(ws.verified(both, "va", "vb", ["a", "b"], self.t).select("a", "b"), "near")

    def _hold(self, classes: int) -> None:
        self.spark.createDataFrame([(classes,)], "classes bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/held")

    def _held(self) -> int:
        """Classes in the index."""
        return self.spark.read.parquet(f"{self.path}/held").agg(F.max("classes")).first()[0]

    def _first_of(self, classes: DataFrame) -> DataFrame:
        """(cls, first) of those of ``classes`` (cls) that the index holds."""
        number, *_, buckets = self._load()
        firsts = self.spark.table(self._firsts(number, buckets))
        wanted = few(classes)
        found = firsts.join(classes, "cls", "left_semi") if wanted is None else firsts.where(F.col("cls").isin(wanted))
        return materialize(found.groupBy("cls").agg(F.min(F.struct(*ORDER)).alias("first")), "firsts")

    def add(self, batches: DataFrame, segment: int) -> DataFrame:
        """Append one or more ``batches`` (id, content, collected_at, batch_no) as a segment and return the ids of their records
        that repeat, exactly or nearly, a record before them.

        Several batches may wait: each record is compared with history and with what precedes it in (batch_no,
        collected_at, id), so one call over all waiting batches gives what one call for each would."""
        vectors = self._vectors(batches.withColumn("stage", F.when(F.col("batch_no").isNull(), UNNUMBERED).otherwise(NUMBERED)), segment)
        own = materialize(vectors.groupBy("cls").agg(F.min(F.struct(*ORDER)).alias("own")), "own")
        known = own.join(self._first_of(own.select("cls")), "cls", "left")
        earlier = materialize(known.select("cls", "own", "first", (F.col("first").isNull()).alias("new"), (F.col("first").isNull() | (F.col("own") < F.col("first"))).alias("leads")), "earlier")
        leading = vectors.join(earlier.where("leads").select("cls", "new"), "cls").select("vec", "cls", "s1", "s2", "new")
        number, freq, splits, classes, buckets = self._load()
        ws.blocks(leading.where("new"), freq, splits, self.t, "stored", min_words=self.min_words).repartition(buckets, "key").write.insertInto(self._cells(number, buckets))
        earlier.where("leads").select("cls", "own.*").repartition(buckets, "cls").write.insertInto(self._firsts(number, buckets))
        near = self.near(leading)
        first_near = self._first_of(near.select(F.col("b").alias("cls")).distinct()).withColumnRenamed("cls", "b")
        by_near = near.join(first_near, "b").groupBy(F.col("a").alias("cls")).agg(F.min("first").alias("near"))
        earliest = earlier.join(by_near, "cls", "left").select("cls", F.least("own", "first", "near").alias("earliest"))
        repeats = materialize(vectors.join(earliest, "cls").where(F.col("earliest") < F.struct(*ORDER)).select("id").distinct(), "repeats")
        held = self._held() + earlier.where("new").count()
        self._hold(held)
        if held > 2 * classes + self.hot:
            self.reorder(number + 1)
        return repeats


def ball_cells_skipped(fp: DataFrame, pivots: int = 200, queries: int = 200, t: float = ws.SIMILARITY) -> float:
    """What share of (query, cell) pairs the triangle inequality would skip if cells were balls around ``pivots`` vectors (a bounded
    sample), each vector in its nearest one, in the metric 1 - similarity."""
    got = fp.orderBy("cls").select("vec").limit(pivots + 4 * queries).toArrow().column(0).to_pylist()
    sets = [frozenset(np.frombuffer(v, np.uint32).tolist()) for v in got]
    far = lambda a, b: 1 - len(a & b) / len(a | b)
    centre, rest, asked = sets[:pivots], sets[pivots + queries :], sets[pivots : pivots + queries]
    radius = [0.0] * len(centre)
    for x in rest:
        d, i = min((far(x, c), i) for i, c in enumerate(centre))
        radius[i] = max(radius[i], d)
    balls = [i for i, r in enumerate(radius) if r > 0]
    skipped = sum(far(q, centre[i]) - radius[i] > 1 - t for q in asked for i in balls)
    return skipped / max(1, len(asked) * len(balls))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that repeat a record of raw_content or a finding before them."""
    index = CellIndex(spark, shared_path(spark, "p3-index")).build(table(spark, sf_dir, "raw_content").select("id", "content", "collected_at"))
    return index.add(table(spark, sf_dir, "findings").select("id", "content", "collected_at", "batch_no"), 1)
