"""Operator 7: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, held_out_column, map_rows, table, words

#: Dimensions of the hashed feature space, and the most labelled rows that a fit reads.
DIMENSIONS = 1 << 18
TRAIN_ROWS = 6000
#: A document is kept from this score on.
KEEP_FROM = 0.3

_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def _shape(word: bytes) -> bytes:
    """Letters as a or A, digits as 0, runs of one class once; other signs stay."""
    out, last = bytearray(), -1
    for c in word.translate(_SHAPE):
        if c != last:
            out.append(c)
            last = c
    return bytes(out)


def features(text: str | None, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- and 2-grams of the words and of their shapes: distinct indices and L2-normalised log counts.

    An empty or null text has the bias feature (index 0) only.
    """
    ws = words(text)
    shapes = {w: _shape(w) for w in set(ws)}
    seen: dict[int, int] = {}
    f, last, last_shape = xxhash.xxh3_64_intdigest, b"", b"^"
    for w in ws:
        s = b"=" if w == last else shapes[w]
        for h in (f(w), f(last + b" " + w), f(s, 1), f(last_shape + b" " + s, 1)):
            seen[h] = seen.get(h, 0) + 1
        last, last_shape = w, s
    if not seen:
        return np.zeros(1, np.int64), np.ones(1)
    index = np.fromiter(seen, np.uint64, len(seen)) % np.uint64(dimensions - 1) + np.uint64(1)
    index, place = np.unique(index.astype(np.int64), return_inverse=True)
    value = np.log1p(np.bincount(place, np.fromiter(seen.values(), float, len(seen))))
    return np.concatenate([[0], index]), np.concatenate([[1.0], value / np.sqrt(value @ value)])


def fit_ftrl(rows, dimensions: int = DIMENSIONS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, epochs: int = 6) -> np.ndarray:
    """Weights from [(index, value, label)], by per-coordinate FTRL-proximal, in the order given."""
    z, n = np.zeros(dimensions), np.zeros(dimensions)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in rows:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
    return weights(np.arange(dimensions)).astype(np.float32)


def training_sample(documents: DataFrame, labels: DataFrame, label: str, mod: int, limit: int) -> DataFrame:
    """At most `limit` labelled rows outside the held-out fold, in the order of a hash of their id.

    The bound is a parameter of the fit; scoring has none. Contradictory labels both count; an id that is repeated
    gives its smallest text, so that the sample stays bounded; null ids, labels and texts are left out of the fit.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isin(0, 1) & ~held_out_column("doc_id", mod))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    found = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.distinct()), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, limit: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Learn from a bounded sample. Its features are made on the executors and sent to the driver (TRAIN_ROWS rows at most)."""

    def hashed(rows):
        found = [features(t, dimensions) for t in rows["text"]]
        return {"key": [xxhash.xxh3_64_intdigest(str(i)) >> 1 for i in rows["doc_id"]], "label": rows["label"], "i": [i.astype("<i4").tobytes() for i, _ in found], "x": [x.astype("<f4").tobytes() for _, x in found]}

    sample = map_rows(training_sample(documents, labels, label, mod, limit), hashed, "key long, label int, i binary, x binary")
    rows = sorted(sample.collect())
    return fit_ftrl([(np.frombuffer(r.i, "<i4"), np.frombuffer(r.x, "<f4").astype(float), r.label) for r in rows], dimensions)


def score_texts(texts: list[str | None], weights: np.ndarray) -> list[float]:
    return [score_text(t, weights) for t in texts]


def score_text(text: str | None, weights: np.ndarray) -> float:
    i, x = features(text, len(weights))
    return 1 / (1 + np.exp(-np.clip(float(weights[i] @ x), -35, 35)))


def score(documents: DataFrame, weights: np.ndarray, mod: int = 5, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of documents; other columns are not read.

    Null and empty texts get the score of the bias alone; repeated rows are scored alike.
    """
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def scored(rows):
        out = score_texts(rows["text"], sent.value)
        return {"doc_id": rows["doc_id"], "held_out": [held_out(i, mod) for i in rows["doc_id"]], "score": out, "predicted": [int(s >= keep_from) for s in out]}

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "doc_id long, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels))


def op7_quality_classifier(spark, sf_dir):
    """Null and empty texts have the bias's score, repeated rows score alike, null ids are held out; see score()."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
