"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned onto the principal axes of a bounded sample, the
leading axis first; a rotation leaves every cosine as it is. Cosine c means a distance of
sqrt(2 - 2c), so two vectors that may reach the threshold lie within that distance on every
axis. A grid of twice that width over the CELL_AXES leading axes gives each vector one home cell
of its label. Cells have an order; as a guest a vector also goes to those later neighbours of its
cell that its ball may reach, so each pair of vectors is met once. A cell's homes and guests are
cut into blocks of bounded numbers, and a tile is a block of homes with another of homes, one of
guests, or both. In a tile, rows lie in the order of the leading axis and only those within the
distance on it meet; the products of the leading axes are summed first; a pair is dropped as soon
as its sum and the product of both suffix norms, which bounds the rest, can't reach the threshold.
Survivors are compared exactly, in the original components and double precision.

Equal vectors of a label are one class, compared once. Links are counted for both classes of a
pair where it is met, and only sums and stars of components leave a tile. Vectors are carried as
they came (single precision stays single) and rotated where they are compared; results join back
by a digest of the vector.

Edge cases: a vector that is null or empty, has zero length, a null label, or null or non-finite
components, links with nothing; vectors of other lengths aren't compared; rows with equal vectors
link with each other, repeated ids too; a null id takes part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored, table
from .components import components, stars

THRESHOLD = 0.98
#: Vectors that the axes are fitted on at most.
SAMPLE = 4096
CELL_AXES = 3
#: Homes and guests of a block, and components that a block of homes holds at most.
BLOCK_HOMES, BLOCK_GUESTS, COMPONENTS = 4096, 16384, 1 << 18
#: Leading axes after which pairs are dropped, and comparisons made at once.
STEPS = (8, 24)
BLOCK = 1 << 20
_SLACK = 1e-9


def comparable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector of every row; the vector is null where it links with nothing."""
    kind = _element(vectors)
    v = F.col("embedding").cast(f"array<{kind}>")
    fit = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    same = F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))  # -0.0 and 0.0 are one value
    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.when(fit, same).alias("vector"))


def digest() -> Column:
    """The key by which rows find the class of their vector; null if they have none."""
    return F.when(F.col("vector").isNotNull(), F.unhex(F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)))


def _element(vectors: DataFrame) -> str:
    return "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"


def classes(rows: DataFrame) -> DataFrame:
    """label, vector, key, n (how many rows), least (id) and dim of each distinct comparable vector."""
    return rows.filter("vector is not null").groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("key", digest()).withColumn("dim", F.size("vector"))


def axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes of a sample of the vectors of each length, one in each column."""
    chosen = rows.orderBy(F.xxhash64("vector"), "label").limit(SAMPLE).select("dim", "vector").collect()  # a fixed number at most
    out = {}
    for dim in {r.dim for r in chosen}:
        x = np.array([r.vector for r in chosen if r.dim == dim], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[dim] = np.linalg.eigh(np.cov(x.T, bias=True) if len(x) > 1 else np.eye(dim))[1][:, ::-1] if dim > 1 else np.ones((1, 1))
    return out


def turned(x: np.ndarray, turn: dict[int, np.ndarray]) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit @ turn[x.shape[1]] if x.shape[1] in turn else unit


def compared(homes: np.ndarray, guests: np.ndarray, h_raw: np.ndarray, g_raw: np.ndarray, threshold: float):
    """Indices (home, guest) of all pairs whose cosine reaches the threshold; a block at a time.

    ``homes`` and ``guests`` are unit vectors on the axes, ``*_raw`` the vectors themselves.
    """
    bounds = [s for s in STEPS if s < homes.shape[1]]
    suffix = lambda x: [np.sqrt(np.maximum((x[:, s:] ** 2).sum(1), 0)) for s in bounds]
    by_h, by_g = np.argsort(homes[:, 0], kind="stable"), np.argsort(guests[:, 0], kind="stable")
    homes, guests = homes[by_h], guests[by_g]
    h_rest, g_rest = suffix(homes), suffix(guests)
    h_norm, g_norm = np.linalg.norm(h_raw, axis=1), np.linalg.norm(g_raw, axis=1)
    least, reach = threshold - _SLACK, np.sqrt(2 - 2 * threshold) + 1e-6
    step = max(1, min(1024, BLOCK // max(1, len(homes))))
    for k in range(0, len(guests), step):
        g = guests[k : k + step]
        first, last = np.searchsorted(homes[:, 0], [g[0, 0] - reach, g[-1, 0] + reach])
        h = homes[first:last]
        if bounds:
            s = bounds[0]
            part = h[:, :s] @ g[:, :s].T
            i, j = np.nonzero(part + np.outer(h_rest[0][first:last], g_rest[0][k : k + step]) >= least)
            total = part[i, j]
            for n, (s, e) in enumerate(zip(bounds, bounds[1:]), 1):
                total = total + np.einsum("ij,ij->i", h[i, s:e], g[j, s:e])
                on = total + h_rest[n][first + i] * g_rest[n][k + j] >= least
                i, j, total = i[on], j[on], total[on]
        else:
            i, j = np.nonzero(h @ g.T >= least)
        for a in range(0, len(i), BLOCK // 16):
            x, y = by_h[first + i[a : a + BLOCK // 16]], by_g[k + j[a : a + BLOCK // 16]]
            cosine = np.einsum("ij,ij->i", h_raw[x], g_raw[y]) / (h_norm[x] * g_norm[y])
            yield x[cosine >= threshold], y[cosine >= threshold]


def links(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b and n: for a class a the rows n that it links to (b null; to be summed), and stars of links (n null)."""
    turn, width = axes(rows), 2 * (float(np.sqrt(2 - 2 * threshold)) + 1e-6)

    def cells(y: np.ndarray) -> list[tuple[bool, np.ndarray, np.ndarray]]:
        """(home, indices, cell coordinates) of homes, and of guests in every later cell that they reach."""
        lead = y[:, :CELL_AXES]
        own = np.floor(lead / width).astype(np.int64)
        out = [(True, np.arange(len(y)), own)]
        for shift in np.ndindex(*(3,) * lead.shape[1]):
            shift = np.array(shift) - 1
            if tuple(shift) <= (0,) * len(shift):
                continue
            to = own + shift
            gap = np.maximum(np.maximum(to * width - lead, lead - (to + 1) * width), 0)
            near = np.flatnonzero((gap**2).sum(1) <= (width / 2) ** 2)
            out.append((False, near, to[near]))
        return out

    def named(label: np.ndarray, dim: int, at: np.ndarray) -> list[str]:
        return [f"{a}/{dim}/{'/'.join(map(str, b))}" for a, b in zip(label.tolist(), at.tolist())]

    def parts(batch: pa.RecordBatch):
        """(home, indices into the batch, cell names), by length of the vectors."""
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        label = np.array(batch.column("label").to_pylist(), object)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = batch.column("vector").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
            for home, own, cell in cells(turned(x, turn)):
                yield home, at[own], named(label[at[own]], dim, cell)

    def counted(batches):
        for b in batches:
            for home, _, names in parts(b):
                name, n = np.unique(names, return_counts=True) if names else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(name), pa.string()), pa.array([home] * len(name), pa.bool_()), pa.array(list(n), pa.int64())], names=["cell", "home", "n"])

    sizes = rows.select("label", "dim", "vector").mapInArrow(counted, "cell string, home boolean, n long").groupBy("cell").agg(F.sum(F.when(F.col("home"), F.col("n"))).alias("h"), F.sum(F.when(~F.col("home"), F.col("n"))).alias("g")).filter("h is not null")
    blocks = sizes.select("cell", "h", F.coalesce("g", F.lit(0)).alias("g"))

    def placed(batches):
        for b in batches:
            for home, own, names in parts(b):
                some = b.select(["class", "n", "dim", "vector"]).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([home] * len(own), pa.bool_()), *some.columns], names=["cell", "home", "class", "n", "dim", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    schema = f"cell string, home boolean, class long, n long, dim int, vector {kind}"
    dealt = rows.select("label", "dim", "class", "n", "vector").mapInArrow(placed, schema).join(blocks, "cell")
    most = F.greatest(F.lit(64), F.least(F.lit(BLOCK_HOMES), F.expr(f"{COMPONENTS} div dim")))
    n_home, n_guest = F.ceil(F.col("h") / most).cast("int"), F.ceil(F.col("g") / (most * (BLOCK_GUESTS // BLOCK_HOMES))).cast("int")
    dealt = dealt.withColumn("nh", n_home).withColumn("ng", n_guest).withColumn("own", F.pmod(F.xxhash64("class"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("ng"))).cast("int"))
    # tile (a, j) holds block a of the homes, block a + j of them and block j of the guests, as far as there are such
    tile = lambda a, j, role: F.struct(a.cast("int").alias("ta"), j.cast("int").alias("tj"), F.lit(role).alias("role"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    as_home = F.transform(upto(F.greatest(F.col("nh") - F.col("own"), F.col("ng"))), lambda j: tile(F.col("own"), j, 0))
    as_other = F.transform(upto(F.col("own")), lambda a: tile(a, F.col("own") - a, 1))
    as_guest = F.transform(upto(F.col("nh")), lambda a: tile(a, F.col("own"), 2))
    dealt = dealt.withColumn("t", F.explode(F.when(F.col("home"), F.concat(as_home, as_other)).otherwise(as_guest))).select("cell", "t.ta", "t.tj", "t.role", "class", "n", "vector")

    def work(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        x = group.column("vector").combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(role), -1)
        who, n = group.column("class").to_numpy(), group.column("n").to_numpy()
        y = turned(x, turn)
        h, g = np.flatnonzero(role == 0), np.flatnonzero(role != 0)
        count = np.zeros(len(role), np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        within = len(h) > 0 and group.column("tj")[0].as_py() == 0
        for other, once in ((h, True), (g, False)) if within else ((g, False),):
            for i, j in compared(y[h], y[other], x[h], x[other], threshold):
                i, j = h[i], other[j]
                if once:
                    i, j = i[i < j], j[i < j]
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                if len(i):
                    s, t = stars(who[i], who[j])
                    a.append(s)
                    b.append(t)
        a, b = stars(np.concatenate(a), np.concatenate(b))
        has = np.flatnonzero(count)
        none = pa.nulls(len(has), pa.int64()), pa.nulls(len(a), pa.int64())
        return pa.table({"a": pa.array(np.concatenate([who[has], a])), "b": pa.concat_arrays([none[0], pa.array(b)]), "n": pa.concat_arrays([pa.array(count[has]), none[1]])})

    return dealt.groupBy("cell", "ta", "tj").applyInArrow(work, "a long, b long, n long")


def clustered(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    every = comparable(vectors)
    rows = stored(classes(every).withColumn("class", F.monotonically_increasing_id()), "vectors")
    found = cut(links(rows, threshold))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(found.filter("b is not null").select("a", "b"))
    rooted = cut(rows.select("class", "label", "key", "n", "least").join(roots.withColumnRenamed("node", "class"), "class", "left").join(counts.withColumnRenamed("a", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_class = rooted.join(least, "root").select(F.col("label").alias("c_label"), F.col("key").alias("c_key"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component")
    both = every.select("vec_id", "label", digest().alias("key")).join(by_class, (F.col("label") == F.col("c_label")) & (F.col("key") == F.col("c_key")), "left")
    component = F.coalesce("component", "vec_id")
    return both.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the links and component of every vector."""
    return clustered(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
