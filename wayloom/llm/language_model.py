"""Language-model scores of whole documents, by a gated recurrent model and a unigram base.

1. Texts are cut into words and coded once, in chunks: a chunk holds the codes of its documents'
   tokens, compressed, and its distinct words, the most frequent first, with their counts in
   training documents.
2. The counts of all words of all training documents are summed. Each chunk's distinct words are
   joined to them, a row for each word and chunk, so a frequent word is no hot key.
3. Chunks meet the counts that aren't their own alone and become the base scores and the symbols of their tokens.
   Symbols are the HEAD most frequent tokens; all other words are hashed to further symbols, whose
   number grows with the square root of the distinct words. So every word is a context and has
   one; a symbol's probability is divided among its words in the proportion of their add-one counts.
4. The recurrent model starts as the unigram distribution of the symbols. On every chunk a copy
   of it trains on the chunk's training documents by truncated backpropagation; the weights of all
   copies are averaged by their tokens, ROUNDS times, each round over its own share of the
   documents. A model has a fixed number of weights for each symbol. What it learns depends on
   the chunks, which are the input's splits, and not on how they fall to tasks and cores.
5. Every document is scored with its state carried from its first token to its last.

Edge cases: a null or empty text is its end token alone; with no training token every count is
0 and the base is log10(1 / 1); null ids train; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import SPACE, discarded, fold, map_batches, split_words, stored, table, text_bytes

HEAD = 1024
CLASSES = 32
ROUNDS = 2
CHUNK = 10 << 20
#: Hash values of words, of which symbols take the low bits.
HASHES = 1 << 16
#: The end of a document among the words; no word holds white space.
END = b"\n"


def squeezed(codes: np.ndarray) -> bytes:
    """Codes as one compressed string, their low bytes first."""
    return pa.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(codes) else b""


def released(data: bytes, n: int) -> np.ndarray:
    """The n codes that ``squeezed`` made a string of."""
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def hashed(word: Column) -> Column:
    """A number under HASHES."""
    return F.pmod(F.xxhash64(word), F.lit(HASHES))


def buckets(n_distinct: int) -> int:
    """How many symbols the words outside the head are hashed to: a power of two, at most half of HASHES."""
    return 1 << min(15, round(np.log2(max(1, n_distinct)) / 2))


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, ids, held, lengths and codes of documents, and words with their training counts and hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(*text_bytes(batch.column("text")), SPACE, lower=True)
        code, distinct = words.coded()
        order = np.argsort(-np.bincount(code, minlength=len(distinct)), kind="stable")
        code, distinct = np.argsort(order)[code], distinct.take(pa.array(order))  # small codes compress well
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        trains = ~held[words.text]
        times = np.bincount(code[trains], minlength=len(distinct)).astype(np.int64)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")), one(held, pa.bool_()), one(words.counts().astype(np.int32), pa.int32()), pa.array([squeezed(code)], pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct.cast(pa.binary())), one(times, pa.int64())],
            names=["ids", "held", "lengths", "codes", "words", "times"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"ids array<{kind}>, held array<boolean>, lengths array<int>, codes binary, words array<binary>, times array<long>"
    own = docs.select("doc_id", F.col("held_out").cast("boolean").alias("held_out"), F.col("text").cast("string").alias("text"))
    low = F.transform("words", lambda w: (hashed(w) - HASHES // 2).cast("short"))
    return map_batches(own, run, schema, most=CHUNK).withColumn("chunk", F.monotonically_increasing_id()).withColumn("hashes", low)


class Vocabulary:
    """What all training tokens give: sums, the symbols and their classes.

    ``others`` has the training tokens and the distinct words of each bucket outside the head.
    """

    def __init__(self, n_tokens: int, n_distinct: int, n_ends: int, head: list[tuple[bytes, int]], others: np.ndarray):
        self.n_tokens, self.n_distinct, self.n_ends = n_tokens, n_distinct, n_ends
        known = sorted([(-c, w) for w, c in head] + [(-n_ends, END)])
        self.least = min((c for _, c in head), default=1)
        self.symbol = {w: i for i, (_, w) in enumerate(known)}
        self.first = len(known)  # the first bucket's symbol
        own = np.array([-c for c, _ in known], float)
        self.mass = np.concatenate([own, others[0]])
        #: Add-one counts of each bucket's words, with one more for words never seen.
        self.rare = others.sum(0) + 1
        share = np.cumsum(np.maximum(own, 0.5)) / np.maximum(own, 0.5).sum()
        of = np.minimum((share * (CLASSES - 1)).astype(int), CLASSES - 2)
        size = np.bincount(of)
        n = others.shape[1]
        each = 1 << (n.bit_length() // 2)
        self.symbols = gru.Symbols(np.append(size[size > 0], np.full(n // each, each)), self.symbol[END])


def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame, Vocabulary]:
    """chunk, at and word of all chunks' words; word and c, its training count; and their sums."""
    each = rows.select("chunk", F.posexplode(F.arrays_zip("words", "times")).alias("at", "w")).select("chunk", "at", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    counts = stored(each.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("chunks")), "counts")
    ends = rows.select(F.explode("held").alias("held")).agg(F.coalesce(F.sum((~F.col("held")).cast("long")), F.lit(0))).first()[0]
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    n = buckets(total[1])
    known = counts.filter("c > 0").withColumn("bucket", hashed(F.col("word")) % n)
    head = known.orderBy(F.desc("c"), "word").limit(HEAD).collect()  # a fixed number
    others = np.zeros((2, n), np.int64)
    for r in known.groupBy("bucket").agg(F.sum("c").alias("c"), F.count("*").alias("words")).collect():  # a row for each bucket
        others[:, r.bucket] = r.c, r.words
    for r in head:
        others[:, r.bucket] -= r.c, 1
    return each.select("chunk", "at", "word", "n"), counts, Vocabulary(total[0] + ends, total[1] + (ends > 0), ends, [(bytes(r.word), r.c) for r in head], others)


def symbolic(rows: DataFrame, words: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """A row for each chunk: ids, held, lengths (ends included), known, base and rare sums, symbols."""
    symbol, first, n_buckets, end = v.symbol, v.first, len(v.rare), v.symbol[END]
    base_all, base_end = np.log10(v.n_tokens + v.n_distinct + 1), np.log10(v.n_ends + 1)
    # a word that stands in one chunk alone has the count that the chunk knows
    shared = counts.filter((F.col("chunks") > 1) | (F.col("c") >= v.least)).select("word", "c")
    found = words.join(shared, "word").filter((F.col("c") != F.col("n")) | (F.col("c") >= v.least)).select("chunk", "at", "c", F.when(F.col("c") >= v.least, F.col("word")).alias("word"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("ids").combine_chunks().flatten()
        lengths = left.column("lengths").combine_chunks().flatten().to_numpy().astype(np.int64)
        code = released(left.column("codes")[0].as_py(), int(lengths.sum()))
        c = left.column("times").combine_chunks().flatten().to_numpy().copy()
        hashes = left.column("hashes").combine_chunks().flatten().to_numpy().astype(np.int64) + HASHES // 2
        at, sym = right.column("at").to_numpy(), first + hashes % n_buckets
        c[at] = right.column("c").to_numpy()
        sym[at] = [symbol.get(w, s) for w, s in zip(right.column("word").to_pylist(), sym[at].tolist())]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        add = lambda per_word: np.bincount(doc, weights=per_word[code], minlength=len(lengths))
        base = add(np.log10(c + 1)) + base_end - (lengths + 1) * base_all
        outside = add(np.where(sym >= first, np.log10((c + 1) / v.rare[np.maximum(sym - first, 0)]), 0.0))
        known = add((c > 0).astype(float)).astype(np.int64) + (v.n_ends > 0)
        tokens = np.full(len(code) + len(lengths), end, np.uint16)
        tokens[np.arange(len(code)) + doc] = sym[code]
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table({
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "held": left.column("held"), "lengths": one((lengths + 1).astype(np.int32), pa.int32()),
            "known": one(known, pa.int64()), "base": one(base, pa.float64()), "outside": one(outside, pa.float64()), "tokens": pa.array([tokens.tobytes()], pa.binary()),
        })

    schema = f"ids {rows.schema['ids'].dataType.simpleString()}, held array<boolean>, lengths array<int>, known array<long>, base array<double>, outside array<double>, tokens binary"
    return rows.select(F.col("chunk").alias("part"), "ids", "held", "lengths", "codes", "times", "hashes").groupBy("part").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)


def _documents(batch: pa.RecordBatch):
    """(row, symbols and lengths of its documents) of each chunk."""
    for k in range(batch.num_rows):
        lengths = batch.column("lengths")[k].values.to_numpy().astype(np.int64)
        yield k, np.frombuffer(batch.column("tokens")[k].as_buffer(), np.uint16).astype(np.int64), lengths


def trained(rows: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Weights after ROUNDS of training on all chunks and averaging."""
    w = gru.initial(v.symbols, v.mass)
    shapes = {k: x.shape for k, x in w.items()}
    ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
    size = int(ends[-1])
    seen = {k: np.full(s, gru.START, np.float32) for k, s in shapes.items()}
    flat = lambda m: np.concatenate([m[k].ravel() for k in shapes])
    shaped = lambda x: {k: p.reshape(s).astype(np.float32) for (k, s), p in zip(shapes.items(), np.split(x, ends[:-1]))}
    for r in range(ROUNDS):

        def run(batches, w=w, seen=seen, r=r):
            total, n = np.zeros(2 * size), 0.0
            for batch in batches:
                for k, tokens, lengths in _documents(batch):
                    use = ~batch.column("held")[k].values.to_numpy(zero_copy_only=False) & (np.arange(len(lengths)) % ROUNDS == r)
                    if use.any():
                        own = lengths[use].sum()
                        total += own * np.concatenate([flat(m) for m in gru.fitted(w, seen, v.symbols, tokens[np.repeat(use, lengths)], lengths[use])])
                        n += own
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * size, dtype=np.int32)), pa.array(total), pa.array(np.full(2 * size, n))], names=["i", "x", "n"])

        summed = rows.select("held", "lengths", "tokens").mapInArrow(run, "i int, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"))
        mean = summed.toPandas().sort_values("i")["x"].to_numpy()  # two rows for each of the model's weights
        if len(mean):
            w, squares = shaped(mean[:size]), shaped(mean[size:])
            seen = {k: gru.START + gru.KEPT * np.maximum(x - gru.START, 0) for k, x in squares.items()}
    return w


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``docs`` has a boolean column held_out: the documents that nothing is learnt from.
    """
    rows = stored(chunks(docs), "chunks")
    words, counts, v = counted(rows)
    ready = stored(symbolic(rows, words, counts, v), "symbols")
    discarded(rows)
    discarded(counts)
    w = trained(ready, v)

    def run(batches):
        for batch in batches:
            for k, tokens, lengths in _documents(batch):
                p = (gru.scored(w, v.symbols, tokens, lengths) / np.log(10) if len(lengths) else np.zeros(0)) + batch.column("outside")[k].values.to_numpy()
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids")[k].values, batch.column("held")[k].values, pa.array(lengths), batch.column("known")[k].values, pa.array(np.full(len(lengths), v.n_tokens, np.int64)), batch.column("base")[k].values, pa.array(p),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: base and model scores of every document."""
    return scored(table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 7) == 2))
