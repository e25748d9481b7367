"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, their stems (the first STEMS bytes, which inflected forms share), word
pairs and pairs with one or two words between, each present or not, in 2**BITS places. Every coordinate has its own learning rate, and the L1 term leaves weights at
zero until their gradients add up, so a model is a short list of places and weights, which goes
to the tasks with the scoring function. It is fitted on at most SAMPLE labelled
documents, half of them toxic where there are so many.

Edge cases: a null or empty text has the bias alone; with no labelled document in the learning
folds every score is 0; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, split_words, table, text_bytes
from .learning import SEPARATOR, hashes, mixed, sample, trained

BITS = 20
#: Bound of the labelled rows that the model is fitted on, and passes over them.
SAMPLE = 16_000
PASSES = 5
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """The places of all features, and the text of each; repeats included."""
    buf, off = text_bytes(texts)
    words = split_words(buf, off, SEPARATOR, lower=True)
    (h, *stems), mask = hashes(words, *STEMS), np.uint64((1 << BITS) - 1)
    places, owners = [h & mask], [words.text]
    with np.errstate(over="ignore"):
        for k, stem in zip(STEMS, stems):
            longer = np.diff(words.bounds) > k
            places.append((mixed(stem + np.uint64(k)) & mask)[longer])
            owners.append(words.text[longer])
        for gap in (1, 2, 3):
            if len(h) > gap:
                same = words.text[gap:] == words.text[:-gap]
                pair = mixed(h[:-gap] * np.uint64(3) + h[gap:] + np.uint64(gap))
                places.append((pair & mask)[same])
                owners.append(words.text[gap:][same])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners), words.n_texts


def features(texts: pa.Array) -> tuple[list, list]:
    places, owners, n = grams(texts)
    both = np.unique((owners << BITS) | places)
    parts = np.split((both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(1, n)))
    return parts, [np.zeros(0, np.float32)] * n


def fit(y: np.ndarray, ids: list, _) -> dict:
    """FTRL-proximal, one document after another."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _pass in range(PASSES):
        for label, own in zip(y, ids):
            at = np.append(np.asarray(own, np.int64), size - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size))
    at = np.flatnonzero(w[:-1])
    return {"bias": w[-1], "at": at.astype(np.int32), "w": w[at].astype(np.float32)}


def model(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict | None:
    return trained(sample(docs, labels, "toxic", most, features, balanced=True), fit)


def scores(texts: pa.Array, found: dict | None) -> np.ndarray:
    if found is None:
        return np.zeros(len(texts))
    dense = np.zeros(1 << BITS)
    dense[found["at"]] = found["w"]
    places, owners, n = grams(texts)
    some = dense[places] != 0
    both = np.unique((owners[some] << BITS) | places[some])
    total = found["bias"] + np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=n)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def scored(docs: DataFrame, found: dict | None) -> DataFrame:
    """doc_id and the score of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text"), found), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the toxicity of every document, learnt from the folds that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = model(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    return scored(docs, found).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
