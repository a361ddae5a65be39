"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

Features say which byte n-grams (ASCII letters lower-cased, each white space as a space, one at each
end) a whole text has, hashed into ``2**BITS`` buckets. Each is scaled by its naive Bayes log-count
ratio between the classes, and logistic regression with an L2 penalty is fitted over the scaled
features. The features are counted on the executors; the driver only sees those that chi-squared
singles out, for a bounded sample of labelled rows. Scoring is one pass without an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import free_name
from ..plans.stage import materialize
from .wordids import byte_slices

ORDERS = (3, 4, 5, 6, 7, 8)
BITS = 20
#: Labelled rows that the classifier is fitted on, at most: those with the least hash of their id.
TRAIN_ROWS = 20_000
#: Features that the classifier may use.
FEATURES = 4096
#: Least chi-squared value of a feature.
LEAST_CHI2 = 12.0
PENALTY = 2e-4
STEPS = 400
#: Bytes of a text whose n-grams are looked at together.
STRETCH = 1 << 18
SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def ngram_buckets(text: str | None) -> Iterator[np.ndarray]:
    """The bucket of each n-gram of a whole text, repeats included, in arrays of bounded length."""
    raw = b" " + (text or "").encode().lower().translate(SPACE) + b" "
    whole = np.frombuffer(raw, np.uint8)
    for start in range(0, len(whole), STRETCH):
        b = whole[start : start + STRETCH + max(ORDERS) - 1].astype(np.uint64)
        key = np.zeros(len(b), np.uint64)
        for k in range(min(max(ORDERS), len(b))):
            key = key[: len(b) - k] | b[k:] << np.uint64(8 * k)
            if k + 1 in ORDERS:
                mixed = (key[:STRETCH] + np.uint64(k << 56)) * np.uint64(0x9E3779B97F4A7C15)
                yield (mixed >> np.uint64(64 - BITS)).astype(np.int32)


def distinct(parts: Iterator[np.ndarray]) -> np.ndarray:
    """Each value once, ascending."""
    own = [np.unique(p) for p in parts]
    return np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32)


@dataclass
class Model:
    """A weight for each bucket (zero for most) and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """The probability of label 1; an empty text has that of the bias alone."""
        at = distinct(p[self.weights[p] != 0] for p in ngram_buckets(text))
        z = self.bias + float(self.weights[at].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels aren't learned; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS) -> DataFrame:
    """``text, y`` of at most ``most`` labelled documents that aren't held out.

    Labels other than 0 and 1 and null ids are left out; of repeated labels the larger counts, and of
    rows that share an id the least text, so the bound holds for any input.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    usable = usable.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most ``most`` rows of 12 bytes.
    chosen = materialize(chosen, "toxicity-labels")
    rows = texts.join(F.broadcast(chosen), "doc_id")
    if rows.select("doc_id").count() > chosen.count():
        # Only where ids are repeated are texts exchanged.
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return rows.select("text", "y")


def fit(sample: DataFrame, features: int = FEATURES, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """A model from ``sample(text, y)``, a bounded number of rows. Without rows of both classes every score is one half or the only class's rate."""
    sample = materialize(sample, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        flag = np.zeros(1 << BITS, bool)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in ngram_buckets(text):
                    flag[at] = True
                own = np.flatnonzero(flag)
                flag[own] = False
                counts[y, own] += 1
        own = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(counts[y, own].astype(np.int64)) for y in (1, 0))], ["bucket", "pos", "neg"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return Model(weights, float(np.log((n1 + 1) / (n0 + 1))))
    counted = sample.mapInArrow(count, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counted = materialize(counted, "toxicity-counts")
    both = counted.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    n, with_it = float(n1 + n0), F.col("pos") + F.col("neg")
    off = F.col("pos") * float(n0) - F.col("neg") * float(n1)
    chi2 = off * off * n / (float(n1) * float(n0) * with_it * (n - with_it + 1))
    best = counted.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "bucket").limit(features).toPandas()
    if not len(best):
        return Model(weights, float(np.log(n1 / n0)))
    ratio = np.log((best["pos"] + 1) / (both["pos"] + (1 << BITS))) - np.log((best["neg"] + 1) / (both["neg"] + (1 << BITS)))
    ratio = ratio.to_numpy(np.float64)
    place = np.full(1 << BITS, -1, np.int32)
    place[best["bucket"].to_numpy()] = np.arange(len(best))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [distinct(place[p][place[p] >= 0] for p in ngram_buckets(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], ["at", "y"])

    rows = sample.mapInArrow(chosen, "at array<int>, y int").toArrow()
    at = rows["at"].combine_chunks()
    x, ends, y = at.values.to_numpy(), at.offsets.to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.float64)
    learned, bias = logistic(x, ends, ratio, y, penalty, steps)
    weights[best["bucket"].to_numpy()] = learned * ratio
    return Model(weights, bias)


def logistic(x: np.ndarray, ends: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-penalised logistic regression over binary features times ``scale``, by accelerated gradient."""
    n, sizes = len(y), np.diff(ends)
    row = np.repeat(np.arange(n), sizes)
    w, b = np.zeros(len(scale)), float(np.log(y.mean() / (1 - y.mean())))
    last, last_b = w, b
    # The gradient's Lipschitz constant is at most a quarter of the mean squared length of a row, for rows alike.
    length = np.bincount(row, scale[x] ** 2, n) + 1
    rate = 4.0 / (np.quantile(length, 0.99) + 4 * penalty)
    for k in range(steps):
        f = k / (k + 3)
        v, vb = w + f * (w - last), b + f * (b - last_b)
        z = np.bincount(row, (v * scale)[x], n) + vb
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.bincount(x, error[row], len(scale)) * scale / n + penalty * v
        last, last_b = w, b
        w, b = v - rate * slope, vb - rate * error.mean()
    return w, b


def score_documents(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from one half on); null text counts as empty.

    Columns of ``docs`` that have one of the two names are replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema if f.name.lower() not in (score.lower(), predicted.lower())]
    names = [f.name for f in fields]
    at = [n.lower() for n in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b in byte_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                scores = [model.score(t) for t in part.column(at).to_numpy(zero_copy_only=False).tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*names, score, predicted])

    schema = T.StructType([*fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def not_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with all their columns as they are."""
    score, predicted = free_name(docs.columns, "score"), free_name(docs.columns, "predicted")
    return score_documents(docs, model, score, predicted).where(F.col(predicted) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def scored(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``; repeated rows stay."""
    model = fit(training_rows(docs, labels, most=most))
    return score_documents(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
