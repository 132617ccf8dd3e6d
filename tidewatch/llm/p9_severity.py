"""Abusive, hateful or sexual content (problem 9).

Method: cumulative-link ordinal regression. The severity grades are 0 (no rater objects), 1 (raters disagree) and 2 (all
object). P(grade > k) = sigmoid(f - theta_k) with one weight vector for both ordered thresholds; the score of a document is the
expected severity, the sum of these probabilities, between 0 and 2. The features are sparse: words and word pairs of a
sentence, hashed to ``DIMENSIONS``, after disguises have been undone (invisible characters, look-alike letters and digits,
stretched and spaced letters). One sentence is enough to make a document offensive, so f is the largest over its sentences,
and which sentences of a rated document are the offending ones is found in turns with the weights.

The model is fitted on the rated documents, at most ``MAX_RATED`` of them (those of smallest hash of doc_id); every document
is scored, whole. Null, empty and blank texts have the severity of a text without words, which is 0. Documents rated several times
count once. Without ratings of both kinds nothing can be learnt and every severity is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.wordset import _mix, list_values
from tidewatch.tables import table

DIMENSIONS = 1 << 18
MAX_RATED = 20_000
#: Documents at or above this expected severity are offending.
OFFENDING = 1.0
#: Look-alikes (fixed values): Cyrillic letters, digits and signs to the Latin letters they stand for.
LOOK_ALIKE = ("асеорхуктмвніїё@$3014!5€", "aceopxyktmbhiieaseoiaise")
END = "\u0001"
END_HASH = int(np.array([xxhash.xxh64(END.encode(), seed=42).intdigest()], np.uint64).view(np.int64)[0])


def plain(c: Column) -> Column:
    """The text in lower case with disguises undone."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\p{Cf}\p{Mn}]+", "")
    x = F.regexp_replace(x, r"[.!?…؟]+(?=\s|$)|[。！？；]|\n+", f" {END} ")
    x = F.regexp_replace(x, r"(?<![\p{L}@$\d])[\d.,:/]+(?![\p{L}@$\d])", " ")
    x = F.translate(x, *LOOK_ALIKE)
    x = F.regexp_replace(x, r"(?<!\p{L})(\p{L})[ ._\-](?=\p{L}(?!\p{L}))", "$1")
    return F.regexp_replace(x, r"([\p{L}])\1+", "$1")


def token_hashes(c: Column) -> Column:
    """Hashes of words, one character each for scripts without spaces, and of sentence ends, in text order."""
    return F.transform(F.regexp_extract_all(plain(c), F.lit(rf"\p{{IsHan}}|[\p{{L}}&&[^\p{{IsHan}}]]+|{END}"), F.lit(0)), lambda w: F.xxhash64(w))


def sentence_features(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices, the first of each sentence that has any, and each such sentence's text."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    is_end = values == END_HASH
    sentence = np.cumsum(is_end) + text  # changes at sentence ends and at texts
    word = ~is_end
    v, s, t = values[word].view(np.uint64), sentence[word], text[word]
    if not len(v):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    one = _mix(v)
    pair = _mix(v[:-1] * np.uint64(0x9E3779B97F4A7C15) + v[1:])
    near = (s[:-1] == s[1:]) & (t[:-1] == t[1:])
    idx = np.concatenate([one, pair[near]])
    at = np.concatenate([np.arange(len(v)), np.flatnonzero(near)])
    order = np.argsort(at, kind="stable")
    idx, at = idx[order], at[order]
    first = np.flatnonzero(np.r_[True, (s[at][1:] != s[at][:-1]) | (t[at][1:] != t[at][:-1])])
    return (idx & np.uint64(DIMENSIONS - 1)).astype(np.int64), first, t[at][first]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class OrdinalModel:
    """Weights, ordered thresholds; expected severity of texts given as token hashes."""

    def __init__(self, weights: np.ndarray | None = None, thresholds=(0.0, 0.0)):
        self.weights, self.thresholds = weights, np.array(thresholds, float)

    def severity(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        if self.weights is None:
            return out
        idx, first, text = sentence_features(values, offsets)
        if len(first):
            f = np.add.reduceat(self.weights[idx], first)
            best = np.full(len(out), -np.inf)
            np.maximum.at(best, text, f)
            has = np.isfinite(best)
            out[has] = sigmoid(best[has, None] - self.thresholds).sum(axis=1)
        return out

    @staticmethod
    def fit(values: np.ndarray, offsets: np.ndarray, grade: np.ndarray, turns: int = 5, steps: int = 40, l2: float = 3e-5) -> "OrdinalModel":
        idx, first, text = sentence_features(values, offsets)
        positive = grade > 0
        if not len(first) or positive.all() or not positive.any():
            return OrdinalModel()
        counts = np.diff(np.r_[first, len(idx)])
        row = np.repeat(np.arange(len(first)), counts)
        doc_grade = grade[text]
        # First guess: log odds of features in offending against other documents, by documents that hold them.
        def documents(of):
            k = np.unique(text[row[of]] * DIMENSIONS + idx[of])
            return np.bincount(k % DIMENSIONS, minlength=DIMENSIONS)

        there = positive[text[row]]
        n_pos, n_neg = documents(there), documents(~there)
        odds = np.log((n_pos + 0.1) / (positive.sum() + 0.2)) - np.log((n_neg + 0.1) / ((~positive).sum() + 0.2))
        odds[n_pos < 2] = 0
        score = np.add.reduceat(odds[idx], first) / np.sqrt(counts)
        w, theta, lean = np.zeros(DIMENSIONS), np.array([0.5, 1.0]), np.full(DIMENSIONS, 1e-3)
        m1 = np.zeros(DIMENSIONS)
        for turn in range(turns):
            # The offending sentences of rated documents: the best of each, and others as sure as it.
            best = np.full(len(grade), -np.inf)
            np.maximum.at(best, text, score)
            lead = score >= best[text] - 1e-9
            target = np.where(doc_grade > 0, np.where(lead | ((score > theta.mean()) if turn else False), doc_grade, 0), 0)
            weight = np.where((doc_grade > 0) & (target == 0), 0.3, 1.0)
            if turn >= 2:  # a best sentence that looks harmless against all evidence: the rating is doubted
                weight[(target > 0) & (score < theta[0] - 1.5)] = 0.1
            share = max(1.0, (target == 0).sum() / max(1, (target > 0).sum()) / 8)
            weight = np.where(target > 0, weight * share, weight)
            for _ in range(steps):
                f = np.add.reduceat(w[idx], first)
                p = sigmoid(f[:, None] - theta)
                y = target[:, None] > np.arange(2)
                g = (p - y) * weight[:, None]
                gf = g.sum(axis=1)
                gw = np.bincount(idx, weights=np.repeat(gf, counts), minlength=DIMENSIONS) / len(first) + l2 * w
                lean = lean + gw * gw
                m1 = 0.7 * m1 + 0.3 * gw
                w -= 0.5 * m1 / np.sqrt(lean)
                theta += 0.5 * g.sum(axis=0) / weight.sum() * 4
                theta = np.array([theta[0], max(theta[1], theta[0] + 0.05)])
            score = np.add.reduceat(w[idx], first)
        return OrdinalModel(w.astype(np.float32), theta)


def rated_documents(documents: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED) -> DataFrame:
    """(doc_id, grade, h): the rated documents' grades and token hashes, bounded by ``max_rated``."""
    grade = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.avg(F.col("toxic").cast("double")).alias("m"))
        .select("doc_id", F.when(F.col("m") <= 0, 0).when(F.col("m") >= 1, 2).otherwise(1).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rated)
    )
    return documents.select("doc_id", "text").where("text is not null").join(F.broadcast(grade), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "grade", token_hashes(F.col("text")).alias("h"))


def fitted(documents: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED) -> OrdinalModel:
    got = rated_documents(documents, labels, max_rated).toArrow()
    if not got.num_rows:
        return OrdinalModel()
    order = np.argsort(got.column("doc_id").to_numpy())
    got = got.take(pa.array(order)).combine_chunks()
    h = got.column("h").chunk(0) if got.column("h").num_chunks else pa.array([], pa.list_(pa.int64()))
    values, off = list_values(h)
    return OrdinalModel.fit(values, off, got.column("grade").to_numpy().astype(int))


def scored(documents: DataFrame, model: OrdinalModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and severity of every document."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    schema = T.StructType([*[documents.schema[c] for c in keep], T.StructField("severity", T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches):
        own = OrdinalModel(*shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                values, off = list_values(pa.concat_arrays([b.column(b.num_columns - 1)]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own.severity(values, off))], names=names)

    return documents.select(*keep, token_hashes(F.col("text")).alias("_h")).mapInArrow(run, schema)


def rates(scores: DataFrame, least: float = OFFENDING) -> DataFrame:
    """Per source (null counts as ''): documents, offending ones, their share and the mean severity."""
    return scores.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("severity") >= least).alias("offending"),
        F.avg((F.col("severity") >= least).cast("double")).alias("rate"),
        F.avg("severity").alias("mean_severity"),
    )


def _scores(spark: SparkSession, sf_dir: str, keep: tuple[str, ...]) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scored(documents, fitted(documents, table(spark, sf_dir, "labels")), keep)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, ("doc_id",)).where(F.col("severity") >= OFFENDING).select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, ("doc_id",))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(_scores(spark, sf_dir, ("doc_id", "source")))
