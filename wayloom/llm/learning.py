"""What the two classifiers share: word hashes, the labelled sample and the path of a model.

Edge cases: labels without an id or a label are left out, of repeated labels the largest counts, and
of documents with one id the one with the least features; texts without words have no hashes; an
empty sample gives no model (None).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, map_batches

#: Features of a sample that a model is fitted on at most; a hundred million are 0.4 to 0.8 GB.
FEATURES = 100_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: The bytes that separate words of letters and digits; bytes above 127 belong to words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes(words: Words, *stems: int) -> list[np.ndarray]:
    """A 64-bit hash of each word and, for each of stems, of so many first bytes of it at most.

    All come from one running polynomial over all bytes.
    """
    n = len(words.values)
    if not n:
        return [np.zeros(0, np.uint64)] * (1 + len(stems))
    with np.errstate(over="ignore"):
        power = np.full(n, _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(power * (words.values.astype(np.uint64) + np.uint64(1)), out=total[1:])
        back = np.full(n + 1, _INVERSE, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        a, b = words.bounds[:-1], words.bounds[1:]
        ends = [b, *(np.minimum(b, a + k) for k in stems)]
        return [mixed((total[e] - total[a]) * back[a] + (e - a).astype(np.uint64)) for e in ends]


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, features: Callable[[pa.Array], tuple[list, list]], balanced: bool = False) -> DataFrame:
    """doc_id, y, ids and values of at most ``most`` labelled documents, those with the lowest hash of the id.

    If ``balanced``, at most half of them are of either label, so that a rare one is well shown.

    The ids alone, of a fixed number, are broadcast; the texts that they choose are turned into
    features where they are read. Documents with one id count once.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    lowest = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    if balanced:
        chosen = lowest(chosen.filter("y = 0"), most // 2).unionByName(lowest(chosen.filter("y <> 0"), most // 2))
    else:
        chosen = lowest(chosen, most)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, values = features(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["doc_id", "y", "ids", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(texts.select("doc_id", "y", "text"), run, f"doc_id {kind}, y int, ids array<int>, values array<float>").groupBy("doc_id", "y").agg(F.min(F.struct("ids", "values")).alias("x")).select("doc_id", "y", "x.ids", "x.values")


def trained(rows: DataFrame, fit: Callable[[np.ndarray, list, list], object], most: int = FEATURES):
    """The model that fit makes of a sample, in one task; only the model comes to the driver.

    Documents come in the order of their ids' hashes, and those whose features, added to all
    before, number more than ``most`` are left out, so that the task's memory has a bound.
    """

    def run(batches, most=most):
        y, ids, values, held = [], [], [], 0
        for b in batches:
            size = pc.list_value_length(b.column("ids")).to_numpy()
            use = int(np.searchsorted(held + np.cumsum(size), most, "right"))
            y.append(b.column("y").slice(0, use).to_numpy())
            for out, name in ((ids, "ids"), (values, "values")):
                column = b.column(name).slice(0, use)
                at = (column.offsets.to_numpy() - column.offsets[0].as_py()) if use else np.zeros(1, int)
                out += np.split(column.flatten().to_numpy().copy(), at[1:-1]) if use else []
            held += int(size[:use].sum())
            if use < b.num_rows:
                most = held
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(np.concatenate(y), ids, values))])], names=["model"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("y", "ids", "values")
    found = cut(ordered.mapInArrow(run, "model binary")).collect()
    return pickle.loads(bytes(found[0].model)) if found else None
