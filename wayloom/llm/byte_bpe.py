"""Byte-level BPE encoding and decoding by monoid tree reduction.

The encodings of byte strings form a monoid: ``join(encode(a), encode(b)) == encode(a + b)``.
A piece of up to LEAF bytes is encoded by merging directly. A longer one is halved, both halves
are encoded, and the two are joined by encoding anew a window of tokens around the boundary.
The window grows, on the side that needs it, until it meets a token on either side with which
its own outer token is stable: a sequence of tokens is the encoding of its bytes exactly if each
two neighbours are the encoding of their own bytes, so all tokens outside then stay. Decoding
concatenates the bytes of tokens up the same kind of tree.

A text is cut into the matches of the tokenizer's pattern first, each encoded separately, so
the encoding of a text is a concatenation. Encoded pieces are kept in a bounded memo.

Edge cases: a null or empty text has no ids; repeated rows are encoded each; null ids pass.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from itertools import chain

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAF = 8
#: Entries of each memo, and the most bytes of a piece that is kept.
MEMO = 400_000
MEMO_BYTES = 64


class ByteBpe:
    """Ranks of a vocabulary, and encoding and decoding by them."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, list[int]] = {}

    @classmethod
    def read(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """The encoding by direct merging; that of a few bytes is kept."""
        found = self.known.get(data)
        if found is None:
            found = self._merge_few(data) if len(data) <= 128 else self._merge_many(data)
            if len(data) <= 2 * self.leaf:
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[data] = found
        return found

    def _merge_few(self, data: bytes) -> list[int]:
        """The pair of lowest rank merges first, the leftmost among equals."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        far = 1 << 60
        pair = [ranks.get(data[i : i + 2], far) for i in range(len(data) - 1)]
        while pair:
            low = min(pair)
            if low == far:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], far)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
        return [ranks[p] for p in parts]

    def _merge_many(self, data: bytes) -> list[int]:
        """The same by a heap of pairs, for windows that have grown large."""
        ranks, n = self.ranks, len(data)
        end, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            mid = end[i]
            if not i < mid < n or end[mid] != e:
                continue
            end[i], end[mid] = e, 0
            if e < n:
                before[e] = i
                if (r := ranks.get(data[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if i and (r := ranks.get(data[before[i] : e])) is not None:
                heapq.heappush(heap, (r, before[i], e))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def neighbours(self, a: int, b: int) -> bool:
        """Do the bytes of tokens a and b encode as a, b?"""
        key = (a, b)
        if key not in self.stable:
            if len(self.stable) > MEMO:
                self.stable.clear()
            self.stable[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.stable[key]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of a and b, which both are encodings."""
        if not a or not b or self.neighbours(a[-1], b[0]):
            return a + b
        i, j, grow_a, grow_b = 0, 0, 1, 1
        while True:
            i, j = min(len(a), i + grow_a), min(len(b), j + grow_b)
            window = self.merged(self.decode(a[len(a) - i :] + b[:j]))
            ok_a = i == len(a) or self.neighbours(a[len(a) - i - 1], window[0])
            ok_b = j == len(b) or self.neighbours(window[-1], b[j])
            if ok_a and ok_b:
                return a[: len(a) - i] + window + b[j:]
            grow_a, grow_b = (0 if ok_a else max(1, i)), (0 if ok_b else max(1, j))

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Memo(dict):
    """A function of a short string with its results kept; bounded by starting anew."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        ids = self.fn(piece)
        if len(piece) <= MEMO_BYTES:
            self[piece] = ids
        return ids


#: Where the pattern may not start a match at each space: a space before other white space or the end.
UNEVEN = re.compile(r" (?:\s|\Z)|[\x1c-\x1f]")


@functools.lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
    """(bpe, function from a text to its ids), one for each Python worker.

    A space before anything but white space starts a match, so a text whose spaces are all
    like that is cut at its spaces first and each part looked up with its space.
    """
    bpe = ByteBpe.read(path)
    find = regex.compile(pattern).findall
    pieces = Memo(lambda piece: tuple(bpe.encode_piece(piece.encode())))
    encode_all = lambda text: tuple(chain.from_iterable(map(pieces.__getitem__, find(text))))
    spaced = Memo(lambda word: encode_all(" " + word))

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        if pattern != public_tokenizers.PATTERN or UNEVEN.search(text):
            return list(encode_all(text))
        first, *rest = text.split(" ")
        return list(chain(encode_all(first), chain.from_iterable(map(spaced.__getitem__, rest))))

    return bpe, encode


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, encode = encoder(path)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def digested(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that the ids decode to.

    The digests are taken beside the ids, which thus needn't go from Python to Spark and back.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, encode = encoder(path)
        n, by_ids, by_text = [], [], []
        for text in batch.column("text").to_pylist():
            ids = encode(text)
            n.append(len(ids))
            by_ids.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
            by_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: token counts and digests of every document."""
    return digested(table(spark, sf_dir, "documents"))
