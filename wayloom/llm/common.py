"""Helpers that the operators share: the shared folder, and words of Arrow text columns.

Texts are handled as one byte buffer per slice of a batch, so that splitting, counting and
coding of words run in numpy and Arrow and the memory of a task has a bound.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are handled at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: The bytes of the contracts' white space, and those that separate words of letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own in local mode, and an error on a cluster."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    before = context._jsc.sc().getCheckpointDir()
    if not found and before.isDefined():
        found = before.get()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not before.isDefined():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: rows are in the shared folder, and survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again; columns are pruned on later reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` returned and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n. A null id is in no held-out fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow of fn over slices of about ``most`` bytes of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=most):
                yield fn(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(size) // (most or SLICE_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), and where each begins, with the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags, one for each byte, over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


@dataclass
class Words:
    """Words of a slice of texts, in order: bytes, bounds in them, text of each word."""

    values: np.ndarray
    bounds: np.ndarray
    text: np.ndarray
    start: np.ndarray
    n_texts: int

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self.text), [None, pa.py_buffer(self.bounds), pa.py_buffer(self.values)])

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A code for each word, and the distinct words by code."""
        if not len(self.text):
            return np.zeros(0, np.int64), pa.array([], pa.large_binary())
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts).astype(np.int64)


def split_words(buf: np.ndarray, off: np.ndarray, separator: np.ndarray, lower: bool = False) -> Words:
    """Runs of bytes that are no separators; none crosses two texts."""
    n = len(off) - 1
    if not len(buf):
        return Words(buf, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n)
    inside = ~separator[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = off[:-1][off[:-1] < len(buf)]
    begins[firsts] = inside[firsts]
    start = np.flatnonzero(begins)
    before = np.cumsum(inside) - inside
    values = buf[inside]
    bounds = np.append(before[start], len(values)).astype(np.int64)
    return Words(np.ascontiguousarray(LOWER[values] if lower else values), bounds, np.searchsorted(off, start, "right") - 1, start, n)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense codes of whole numbers, and how many there are."""
    codes, distinct = pd.factorize(keys)
    return codes.astype(np.int64), len(distinct)
