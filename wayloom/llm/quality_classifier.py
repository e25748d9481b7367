"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector x: its words, hashed to 2**BITS places, each with the root of its
share of all words; and one place for each structure statistic and for the text's length, chosen
by the statistic's bin. The score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

the sum-of-squares form of all pairwise interactions, linear in the number of features. It is
fitted by AdaGrad on at most SAMPLE labelled documents.

Edge cases: a null or empty text has its statistics alone; with no labelled document in the
learning folds every score is 1, so that nothing is rejected; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, per_text, split_words, table, text_bytes
from .learning import SEPARATOR, hashes, sample, trained
from .quality_rules import counts

BITS = 16
FACTORS = 8
#: Bound of the labelled rows that the model is fitted on, and passes over them.
SAMPLE = 8_000
PASSES = 6
BINS = 24
RATE, DECAY, BATCH = 0.1, 1e-4, 64
THRESHOLD = 0.7


def structure(texts: pa.Array, n_distinct: np.ndarray) -> np.ndarray:
    """Bins of each text's statistics, a column each."""
    c = {k: v.astype(float) for k, v in counts(texts).items()}
    buf, off = text_bytes(texts)
    digits = per_text((buf >= 0x30) & (buf < 0x3A), off)
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    log = lambda x, k: np.minimum(np.log2(1 + x) * k, BINS - 1)
    share = lambda x: np.minimum(x * (BINS - 1), BINS - 1)
    stats = [
        log(c["n_words"], 1.5), log(np.diff(off), 1.2), log(c["n_lines"], 2), log(c["n_words"] / lines, 2), log(20 * c["n_punct"] / words, 3), log(50 * c["n_symbols"] / words, 3),
        share(c["n_caps"] / chars), share(c["n_dup_lines"] / lines), share(c["n_repeat_words"] / words), log(c["word_chars"] / words, 6), share(digits / chars), share(n_distinct / words),
    ]
    return np.stack(stats, 1).astype(np.int64)


N_STATS = 12
SIZE = (1 << BITS) + N_STATS * BINS


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of all texts' features, and where those of each text begin, with the end."""
    buf, off = text_bytes(texts)
    words = split_words(buf, off, SEPARATOR, lower=True)
    place = (hashes(words)[0] >> np.uint64(64 - BITS)).astype(np.int64)
    pairs, times = np.unique((words.text << BITS) | place, return_counts=True)
    owner = pairs >> BITS
    value = np.sqrt(times / np.maximum(words.counts(), 1)[owner])
    n = words.n_texts
    stats = structure(texts, np.bincount(owner, minlength=n)) + (1 << BITS) + BINS * np.arange(N_STATS)
    owner = np.concatenate([owner, np.repeat(np.arange(n), N_STATS)])
    order = np.argsort(owner, kind="stable")
    places = np.concatenate([pairs & ((1 << BITS) - 1), stats.ravel()])[order]
    values = np.concatenate([value, np.full(n * N_STATS, 1 / np.sqrt(N_STATS))])[order]
    return places, values.astype(np.float32), np.searchsorted(owner[order], np.arange(n + 1))


def features(texts: pa.Array) -> tuple[list, list]:
    places, values, at = vectors(texts)
    return np.split(places.astype(np.int32), at[1:-1]), np.split(values, at[1:-1])


def margins(m: dict, places: np.ndarray, values: np.ndarray, at: np.ndarray):
    """The machine's value for each text; and, for the gradient, v x of each feature and its sums."""
    vx = m["v"][places] * values[:, None]
    s, q = np.add.reduceat(vx, at[:-1]), np.add.reduceat(vx * vx, at[:-1])
    return m["w0"] + np.add.reduceat(m["w"][places] * values, at[:-1]) + 0.5 * (s * s - q).sum(1), vx, s


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(y: np.ndarray, ids: list, values: list) -> dict:
    random = np.random.default_rng(7)
    m = {"w0": 0.0, "w": np.zeros(SIZE, np.float32), "v": random.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32)}
    g0, gw, gv = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32)
    for _ in range(PASSES):
        order = random.permutation(len(y))
        for k in range(0, len(y), BATCH):
            own = order[k : k + BATCH]
            places, x = np.concatenate([ids[i] for i in own]).astype(np.int64), np.concatenate([values[i] for i in own])
            at = np.cumsum([0, *(len(ids[i]) for i in own)])
            out, vx, s = margins(m, places, x, at)
            g = ((logistic(out) - y[own]) / len(own)).astype(np.float32)
            each = np.repeat(np.arange(len(own)), np.diff(at))
            gx = g[each] * x
            sort = np.argsort(places, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(places[sort]) > 0))
            where = places[sort][first]
            dw = np.add.reduceat(gx[sort], first) + DECAY * m["w"][where]
            dv = np.add.reduceat((gx[:, None] * (s[each] - vx))[sort], first) + DECAY * m["v"][where]
            gw[where] += dw * dw
            gv[where] += dv * dv
            g0 += g.sum() ** 2
            m["w"][where] -= RATE * dw / np.sqrt(gw[where])
            m["v"][where] -= RATE * dv / np.sqrt(gv[where])
            m["w0"] -= RATE * g.sum() / np.sqrt(g0)
    return m


def model(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict | None:
    return trained(sample(docs, labels, "quality", most, features), fit)


def scores(texts: pa.Array, m: dict | None) -> np.ndarray:
    if m is None:
        return np.ones(len(texts))
    return logistic(margins(m, *vectors(texts))[0].astype(float))


def scored(docs: DataFrame, m: dict | None) -> DataFrame:
    """doc_id and the score of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text"), m), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, score double")


def learning_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(fold(F.col("doc_id"), 4) != 2)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of THRESHOLD or more, with their own columns."""
    m = model(docs, learning_labels(labels))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = pa.array(scores(batch.column("text"), m) >= THRESHOLD)
        return batch.select(["row"]).filter(keep)

    return map_batches(row, run, f"row {row.schema['row'].dataType.simpleString()}").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the quality of every document, learnt from the folds that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    m = model(docs, learning_labels(labels))
    return scored(docs, m).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
