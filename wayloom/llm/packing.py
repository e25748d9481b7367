"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. All that a plan needs is how many pieces
there are of each length, which is one row for each of at most ``capacity`` lengths, whatever
the number of documents. The sums of all pairs of lengths still available are kept in an index
by sum, so that one, two or three lengths that fill a gap are found whenever there are any; from
the longest length on, each gap is filled by such a combination, as many times as the counts
allow. What has no exact complement left is packed best-fit, the longest first, again in whole
classes of equal sequences. The plan is a short table: for each length, ranges of pieces, and
the sequence and offset that the first of each range takes.

Pieces get their number among those of equal length without gathering them: numbers count
within salted groups, and the groups' sizes are summed. A plan's ranges join by length and by
blocks of numbers, so the most frequent length is spread over all tasks.

Edge cases: a null or empty text is one piece holding the end id alone; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, map_batches, split_words, stored, table, text_bytes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
END = 0
#: Words whose ids a Python worker keeps, and text bytes that it handles at once.
MEMO = 400_000
SLICE = 2 << 20
#: Groups in which pieces of one length are counted, and the numbers of a block of a range.
SALTS, BLOCK = 64, 4096


#: Words of lower-cased Latin letters, and marks that may follow: two pieces of the tokenizer.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for U+0100 and on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(other)}


class WordIds:
    """Ids of words by a vocabulary's tokenizer, kept in one flat array; bounded by starting anew.

    The vocabulary's white space separates words and is dropped, and nothing else in it looks
    beyond a word, so the ids of a text are those of its words in order. A plain word goes to
    the merges at once; any other passes the whole tokenizer. If ``added``, a word that is one of
    the vocabulary's added tokens has that token's id; else it is a word like any other.
    """

    def __init__(self, path: str, added: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work to the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.tokenizer.encode_special_tokens = not added
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bounds, self.flat = array("q", [0]), array("I")

    def ids(self, word: str) -> list[int]:
        low = PLAIN.fullmatch(word.lower())
        if low is None or len(low[0]) != len(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [t.id for piece in low.groups() if piece for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def places(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, by which ``bounds`` tells where its ids are in ``flat``."""
        if len(self.known) > MEMO:
            self.clear()
        known, flat, bounds = self.known, self.flat, self.bounds
        for w in words:
            if w not in known:
                flat.extend(self.ids(w.decode()))
                known[w] = len(known)
                bounds.append(len(flat))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


word_ids = functools.lru_cache(maxsize=4)(WordIds)


def token_ids(texts: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each text's followed by END, and where each text begins, with the end.

    Added tokens are found in a text as it stands, within words too, before letters are lowered;
    the words of texts that hold one keep their case, so that no other spelling turns into one.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    added = word_ids(path, True).added
    holds = pa.array(np.zeros(len(texts), bool))
    for token in added:
        holds = pc.or_(holds, pc.match_substring(texts, token))
    if not pc.any(holds).as_py():
        return _word_ids(texts, path, False)
    marked = texts
    for token in added:
        marked = pc.replace_substring(marked, token, f" {token} ")
    nothing = pa.scalar("", pa.large_string())
    plain, at = _word_ids(pc.if_else(holds, nothing, texts), path, False)
    other, other_at = _word_ids(pc.if_else(holds, marked, nothing), path, True)
    use = holds.to_numpy(zero_copy_only=False)
    n = np.where(use, np.diff(other_at), np.diff(at))
    of, to = np.repeat(use, n), np.concatenate([[0], np.cumsum(n)])
    out = np.empty(to[-1], np.uint32)
    out[~of] = plain[np.repeat(~use, np.diff(at))]
    out[of] = other[np.repeat(use, np.diff(other_at))]
    return out, to


def _word_ids(texts: pa.Array, path: str, added: bool) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(*text_bytes(texts), SPACE, lower=not added)
    code, distinct = words.coded()
    known = word_ids(path, added)
    place = known.places(distinct.to_pylist())[code]
    bounds, flat = np.array(known.bounds), np.array(known.flat, np.uint32)
    n = (bounds[place + 1] - bounds[place]).astype(np.int64)
    per_text = np.bincount(words.text, weights=n, minlength=words.n_texts).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(per_text + 1)])
    out = np.full(at[-1], END, np.uint32)
    before = np.cumsum(n) - n
    step = np.arange(n.sum())
    out[step + np.repeat(words.text, n)] = flat[step + np.repeat(bounds[place] - before, n)]
    return out, at


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = token_ids(batch.column("text"), path)
        n = np.diff(at)
        parts = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * capacity
        length = np.minimum(capacity, n[row] - start)
        data, first = memoryview(ids.astype("<u4").tobytes()), at[:-1][row] + start
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
        columns = [batch.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long", most=SLICE)


class Available:
    """How many pieces of each length are left, and how many pairs of available lengths have each sum."""

    def __init__(self, have: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        for x, n in have.items():
            self.put(x, n)

    def put(self, x: int, n: int) -> None:
        """From now on n pieces of length x are left."""
        old = self.left[x]
        if (old > 0) != (n > 0):
            others = np.flatnonzero(self.left)
            self.pairs[x + others[others != x]] += 1 if n else -1
        if (old > 1) != (n > 1):
            self.pairs[2 * x] += 1 if n > 1 else -1
        self.left[x] = n

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three of the pieces left that add up to gap, the most frequent first; None if none do."""
        left = self.left
        if gap < 1:
            return None
        if left[gap]:
            return (gap,)
        a = self.second(gap)
        if a:
            return (a, gap - a)
        own = np.arange(1, gap)
        own = own[left[own] > 0]
        n = self.pairs[gap - own].copy()
        # the pair of a and gap - 2a takes a twice, or three times
        twice = gap - 2 * own
        n[(twice > 0) & (left[np.maximum(twice, 0)] > 0) & (twice != own) & (left[own] == 1)] -= 1
        n[(twice == own) & (left[own] == 2)] -= 1
        own = own[n > 0]
        if not len(own):
            return None
        a = int(own[np.argmax(left[own])])
        self.put(a, left[a] - 1)
        b = self.second(gap - a)
        self.put(a, left[a] + 1)
        return (a, b, gap - a - b)

    def second(self, gap: int) -> int:
        """The most frequent length that makes up gap together with another piece left; 0 if none does."""
        n = self.left[1:gap]
        other = n[::-1]
        fits = np.where((n > 0) & (other > 0), n, 0)
        if not gap % 2 and n[gap // 2 - 1 : gap // 2].sum() < 2:
            fits[gap // 2 - 1 : gap // 2] = 0
        return int(np.argmax(fits)) + 1 if fits.any() else 0


def plan(have: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for so many pieces of each length."""
    own = Available({k: v for k, v in have.items() if v > 0 and k < capacity}, capacity)
    out = [((capacity,), have[capacity])] if have.get(capacity) else []
    rest: list[tuple[int, int]] = []
    for long in np.flatnonzero(own.left)[::-1].tolist():
        while n := int(own.left[long]):
            own.put(long, n - 1)
            found = own.complement(capacity - long)  # longer pieces are used up
            own.put(long, n)
            if found is None:
                rest.append((long, n))
                own.put(long, 0)
                break
            need = defaultdict(int)
            for x in (long, *found):
                need[x] += 1
            times = min(int(own.left[x]) // k for x, k in need.items())
            for x, k in need.items():
                own.put(x, int(own.left[x]) - k * times)
            out.append(((long, *found), times))
    return out + _best_fit(rest, capacity)


def _best_fit(rest: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Classes of equal sequences, by the gap that is left in them; the longest pieces first."""
    classes: dict[int, list[list]] = defaultdict(list)
    gaps = np.zeros(capacity + 1, np.int64)
    for long, n in sorted(rest, reverse=True):
        while n:
            fits = np.flatnonzero(gaps[long:])
            if not len(fits):
                each = capacity // long
                full, over = divmod(n, each)
                for k, times in ((each, full), (over, 1 if over else 0)):
                    if times:
                        classes[capacity - k * long].append([(long,) * k, times])
                        gaps[capacity - k * long] += 1
                break
            gap = long + int(fits[0])
            lengths, times = classes[gap].pop()
            gaps[gap] -= 1
            used = min(times, n)
            if times > used:
                classes[gap].append([lengths, times - used])
                gaps[gap] += 1
            classes[gap - long].append([(*lengths, long), used])
            gaps[gap - long] += 1
            n -= used
    return [(lengths, times) for group in classes.values() for lengths, times in group]


def ranges(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, number of the first piece, how many, sequence of the first, offset) of a plan."""
    used, out, sequence = defaultdict(int), [], 0
    for lengths, times in found:
        offset = 0
        for x in lengths:
            out.append((x, used[x], times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return out


def numbered(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows with ``number``: 0, 1, ... among the pieces of equal length."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    first = rows.withColumn("within", F.row_number().over(own) - 1)
    return first.join(counts, ["length", "salt"]).withColumn("number", F.col("ahead") + F.col("within")).drop("salt", "within", "ahead")


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    rows = stored(pieces(docs, capacity, path), "pieces")
    have = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    spans = rows.sparkSession.createDataFrame(ranges(plan(have, capacity)), "length long, first long, n long, sequence long, offset long")
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK)))
    spans = spans.select(F.col("length").alias("s_length"), "first", "n", "sequence", "offset", blocks.alias("block"))
    out = numbered(rows).withColumn("at", F.floor(F.col("number") / BLOCK))
    out = out.join(spans, (F.col("length") == F.col("s_length")) & (F.col("at") == F.col("block")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), "offset")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every piece of every document, and its place in a sequence."""
    return packed(table(spark, sf_dir, "documents"))
