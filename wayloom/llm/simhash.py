"""SimHash near-duplicates through vantage-point trees.

Equal fingerprints are one point. A tree parts the space: a node has a vantage point and a
radius, and a point belongs inside if its Hamming distance to the vantage point is at most the
radius. Every point has one home leaf; as a query it also goes to each leaf that its ball of
``radius`` bits may reach by the triangle bound (inside if d <= r + 3, outside if d > r - 3). The
number of levels follows the number of points. The upper ones are fitted on a sample of fixed
size, node by node; below them each level has one vantage point and radius for all its nodes, so
the tree that goes to the tasks has a fixed size. A leaf, cut into tiles of bounded numbers of
homes and queries, is one task's work, which goes on down a tree of its own. A leaf's dense ball
around a vantage point is linked to that point at once, and its members aren't compared with
each other.

Every pair within the radius is met in the home leaf of one of them, so no link between
components is lost; what leaves a task is a star for each component that it found.

Edge cases: a null or empty text, or one of white space, has fingerprint zero, linked like any
other; rows with a null id take part and count as the largest id; repeated rows are equal
points; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, map_batches, split_words, stored, table, text_bytes
from .components import components, stars

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Points that the tree is fitted on at most, its levels that are fitted node by node, and vantage points tried.
SAMPLE, FITTED, TRIED = 1 << 16, 10, 32
#: Homes that a leaf should have, and homes and queries of a tile at most.
LEAF, TILE_HOMES, TILE_QUERIES = 4096, 8192, 32768
#: Comparisons that are made at once.
BLOCK = 1 << 20
SLICE = 1 << 20


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    words = split_words(*text_bytes(texts), SPACE, lower=True)
    n, size = len(words.text), np.diff(words.bounds)
    out = np.zeros(words.n_texts, np.uint64)
    if not n:
        return out
    line = np.full(len(words.values) + n, 0x20, np.uint8)  # every word and a space
    line[np.arange(len(words.values)) + np.repeat(np.arange(n), size)] = words.values
    begin = words.bounds[:-1] + np.arange(n)
    end = begin + size
    per_text = words.counts()
    first = np.cumsum(per_text) - per_text
    place = np.arange(n) - first[words.text]
    from_word = np.flatnonzero((place <= per_text[words.text] - SHINGLE) | (place == 0))
    to_word = from_word + np.minimum(SHINGLE, per_text[words.text[from_word]]) - 1
    data, digest = memoryview(line), xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], SEED) for a, b in zip(begin[from_word].tolist(), end[to_word].tolist())], np.uint64)
    owner = words.text[from_word]
    at = np.flatnonzero(np.append(True, np.diff(owner) > 0))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    total = np.diff(np.append(at, len(owner)))
    out[owner[at]] = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and key, a hash of the text, of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fingerprints(batch.column("text")).view(np.int64), pa.int64())], names=["doc_id", "key", "fp"])

    text = F.col("text").cast("string")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text")), run, f"doc_id {kind}, key long, fp long", most=SLICE)


def distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


def vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The point and radius that part the points best: even parts, and few points within reach of both."""
    best, found, r = np.inf, None, np.arange(64)
    for v in points[:: max(1, len(points) // TRIED)][:TRIED]:
        upto = np.cumsum(np.bincount(distance(points, v), minlength=65)) / len(points)
        share = np.clip(upto[:64], 1e-9, 1 - 1e-9)
        both = upto[np.minimum(r + RADIUS, 64)] - np.append(np.zeros(RADIUS), upto)[:64]
        cost = np.log2(1 + both) / -(share * np.log2(share) + (1 - share) * np.log2(1 - share))
        cost[(share < 0.2) | (share > 0.8)] = np.inf
        k = int(np.argmin(cost))
        if cost[k] < best:
            best, found = cost[k], (v, k)
    return found


def grow(points: np.ndarray, levels: int):
    """A tree over a sample: (vantage point, radius, inside, outside), or None for a leaf."""
    at = vantage(points) if levels and len(points) >= 4 else None
    if at is None:
        return None
    d = distance(points, at[0])
    return *at, grow(points[d <= at[1]], levels - 1), grow(points[d > at[1]], levels - 1)


def leaves(tree, below: list[tuple[np.uint64, int]], points: np.ndarray, reach: int) -> list[tuple[int, np.ndarray]]:
    """(number of a leaf, which points reach it); with reach 0 each point has its home alone.

    ``below`` has the vantage point and radius of each level under the tree's.
    """
    out, stack, number = [], [(tree, np.arange(len(points)))], 0
    while stack:
        node, own = stack.pop()
        if node is None:
            out.append((number, own))
            number += 1
            continue
        v, r, inside, outside = node
        d = distance(points[own], v)
        stack.append((outside, own[d > r - reach]))
        stack.append((inside, own[d <= r + reach]))
    for v, r in below:
        d = distance(points, v)
        out = [(2 * k + side, own[on[own]]) for k, own in out if len(own) for side, on in ((0, d <= r + reach), (1, d > r - reach))]
    return out


def linked(homes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same points as all pairs of a home and a query within the radius do."""
    a, b, stack = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [(homes, queries)]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) <= 256 or len(h) * len(q) <= BLOCK // 4:
            for x, y in _near(h, q, radius):
                a.append(x)
                b.append(y)
            continue
        v = h[len(h) // 2]
        dh, dq = distance(h, v), distance(q, v)
        for points, d in ((h, dh), (q, dq)):
            ball = points[(d <= radius) & (d > 0)]
            a.append(ball)
            b.append(np.full(len(ball), v))
        in_ball = dh <= radius
        stack.append((h[in_ball], q[(dq > radius) & (dq <= 2 * radius)]))
        rest, d = h[~in_ball], dh[~in_ball]
        if not len(rest):
            continue
        r = int(np.median(d))
        if (d <= r).all():
            r -= 1
        if (d > r).all():  # all at one distance
            for x, y in _near(rest, q[np.abs(dq - d[0]) <= radius], radius):
                a.append(x)
                b.append(y)
            continue
        stack.append((rest[d <= r], q[dq <= r + radius]))
        stack.append((rest[d > r], q[dq > r - radius]))
    return stars(np.concatenate(a), np.concatenate(b))


def _near(h: np.ndarray, q: np.ndarray, radius: int):
    """Links among h and q from comparing all, a block at a time."""
    step = max(1, BLOCK // max(1, len(h)))
    for k in range(0, len(q), step):
        part = q[k : k + step]
        i, j = np.nonzero(np.bitwise_count(h[:, None] ^ part[None, :]) <= radius)
        x, y = h[i], part[j]
        other = x != y
        if other.sum() > 4 * (len(h) + len(part)):
            yield stars(x[other], y[other])
        elif other.any():
            yield x[other], y[other]


def links(points: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """a and b: links between fingerprints ``fp`` that join all points within the radius."""
    n = points.count()
    levels = max(3, math.ceil(math.log2(n / leaf))) if n > 64 else 0
    fitted = min(levels, FITTED)
    chosen = points.orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, 64 << fitted))
    sample = np.array([r.fp for r in chosen.collect()], np.int64).view(np.uint64)  # a fixed number at most
    tree = grow(sample, fitted)
    parts = np.array_split(sample, max(1, levels - fitted))
    below = [(v, int(np.median(distance(sample, v)))) for v, _ in filter(None, map(vantage, parts[: levels - fitted]))]

    def members(batches):
        """(leaf, home, fingerprint) of every membership, in pieces of bounded length."""
        held, size = [], 0
        for b in batches:
            p = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for home, reach in ((True, 0), (False, radius)):
                for number, own in leaves(tree, below, p, reach):
                    held.append((np.full(len(own), number), np.full(len(own), home), p[own].view(np.int64)))
                    size += len(own)
                    if size >= BLOCK:
                        yield map(np.concatenate, zip(*held))
                        held, size = [], 0
        if size:
            yield map(np.concatenate, zip(*held))

    def counted(batches):
        for leaf, home, _ in members(batches):
            key, times = np.unique(2 * leaf + home, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // 2), pa.array(key % 2 == 1), pa.array(times)], names=["leaf", "home", "n"])

    def dealt(batches):
        for columns in members(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["leaf", "home", "fp"])

    tile_homes = int(min(TILE_HOMES, max(1024, n / 64)))
    up = lambda is_home, most: F.greatest(F.ceil(F.sum(F.when(F.col("home") == is_home, F.col("n"))) / most), F.lit(1)).cast("int")
    sizes = points.select("fp").mapInArrow(counted, "leaf long, home boolean, n long").groupBy("leaf").agg(up(True, tile_homes).alias("nh"), up(False, min(TILE_QUERIES, 4 * tile_homes)).alias("nq"))
    placed = points.select("fp").mapInArrow(dealt, "leaf long, home boolean, fp long").join(sizes, "leaf")
    mine, other = (F.when(F.col("home"), F.col(a)).otherwise(F.col(b)) for a, b in (("nh", "nq"), ("nq", "nh")))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), mine).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(0), other - 1)))
    placed = placed.select("leaf", F.when(F.col("home"), F.col("own")).otherwise(F.col("copy")).alias("th"), F.when(F.col("home"), F.col("copy")).otherwise(F.col("own")).alias("tq"), "home", "fp")

    def compared(group: pa.Table) -> pa.Table:
        p = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy()
        a, b = linked(p[home], p[~home], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return placed.groupBy("leaf", "th", "tq").applyInArrow(compared, "a long, b long")


def clustered(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, key, fp, component_id (the least doc_id of the documents linked with it) and root, a name of the component."""
    rows = stored(fingerprinted(docs), "fingerprints")
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(points, radius))
    rooted = cut(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "component_id", "root"), "fp")


def filter_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the least id, with its own columns.

    Of rows that share that id (or have none), the one with the least text hash stays, once.
    """
    found = clustered(docs, radius)
    best = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min(F.struct("key", "fp")).alias("best"))
    nameless = found.filter(F.col("component_id").isNull()).groupBy("root").agg(F.min("key").alias("key"))
    keep = best.filter("component_id is not null").select(F.col("component_id").alias("id"), F.col("best.key").alias("key")).unionByName(nameless.select(F.lit(None).cast(best.schema["component_id"].dataType).alias("id"), "key"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("k"))
    keep = keep.withColumnRenamed("id", "keep_id")
    both = row.join(keep, row["id"].eqNullSafe(keep["keep_id"]) & (row["k"] == keep["key"]), "left_semi")
    once = both.withColumn("nth", F.row_number().over(Window.partitionBy("id", "k").orderBy(F.lit(1)))).filter("nth = 1")
    return once.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the fingerprint and component of every document."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return clustered(table(spark, sf_dir, "documents")).select("doc_id", hexed, "component_id")
