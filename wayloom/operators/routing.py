"""Shortest paths: Dijkstra within each small map, rounds of relaxation over large ones.

A map whose edges number at most ``fits`` is one group of a grouped Arrow function, cut by its
sources so that no group's result grows without bound; many maps and sources run side by side.
Larger maps are cut into blocks of BLOCK ids. Rounds follow the edges between blocks by a join of
the frontier with edges that lie in buckets by the room that they leave, so these are shuffled once
and not each round; what a round improves is settled within each block by a grouped Arrow function.
Costs are kept as a table; what grows with the map is never in one task.

Both ways give the same predecessors. Of paths of equal cost the one whose end has fewer edges
that add nothing counts as shorter, so that such edges make no circle, and of those the one with
the least predecessor.
"""

from __future__ import annotations

import heapq
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges of a map that one task may hold, and edges times sources.
FITS, WORK = 1_000_000, 20_000_000
#: Ids of a block of a large map, the edges within it that one task may hold, and the sources that it has at a time.
BLOCK, WITHIN, SOURCES = 1 << 14, 1_000_000, 16
#: Edges between blocks in a bucket.
BUCKET = 1_000_000
LABELS = "map_id long, source long, id long, cost double, idle int, previous long, fresh boolean"
COSTS = "map_id long, source long, id long, cost double, previous long"
ROUTES = "map_id long, source long, target long, cost double, path array<long>"
KEY = ["map_id", "source", "id"]


def shared_path(spark: SparkSession) -> str:
    """A new path in the checkpoint folder; where that is unset, in one of our own in local mode."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/") + f"/rows-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, *by: str) -> DataFrame:
    """df written to the checkpoint folder as Parquet, a folder for each value of ``by``, and read again, so that its lineage is cut and later plans know its size."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Graph:
    """The edges of one map, by the room that they leave; rooms are numbered in the order of their ids."""

    def __init__(self, edges: pa.Table, sources: np.ndarray):
        src, dst, w = (edges.column(c).to_numpy() for c in ("src", "dst", "w"))
        self.ids = np.unique(np.concatenate([src, dst, sources]))
        order = np.argsort(src, kind="stable")
        self.begin = np.searchsorted(src[order], np.append(self.ids, np.iinfo(np.int64).max)).tolist()
        self.to, self.w = np.searchsorted(self.ids, dst[order]).tolist(), w[order].tolist()

    def spread(self, source: int) -> tuple[list, list]:
        """(cost, idle edges) of each room or None, and the room before it."""
        best, before, done = [None] * len(self.ids), [-1] * len(self.ids), bytearray(len(self.ids))
        s = int(np.searchsorted(self.ids, source))
        best[s], heap = (0.0, 0), [((0.0, 0), s)]
        while heap:
            c, a = heapq.heappop(heap)
            if done[a]:
                continue
            done[a] = 1
            for k in range(self.begin[a], self.begin[a + 1]):
                b = self.to[k]
                if done[b]:
                    continue
                total = c[0] + self.w[k]
                new, old = (total, 0 if total > c[0] else c[1] + 1), best[b]
                if total < float("inf") and (old is None or new < old or (new == old and a < before[b])):
                    best[b], before[b] = new, a
                    heapq.heappush(heap, (new, b))
        return best, before


def _costs(edges: pa.Table, sources: pa.Table) -> pa.Table:
    """Costs and predecessors from each source."""
    wanted = sources.column("source").to_numpy()
    graph, parts = Graph(edges, wanted), []
    for m, s in zip(sources.column("map_id").to_pylist(), wanted.tolist()):
        best, before = graph.spread(s)
        at = np.flatnonzero([c is not None for c in best])
        prev = np.array(before)[at]
        parts.append(pa.table({
            "map_id": pa.array(np.full(len(at), m)), "source": pa.array(np.full(len(at), s)), "id": pa.array(graph.ids[at]),
            "cost": pa.array([best[i][0] for i in at.tolist()], pa.float64()), "previous": pa.array(graph.ids[prev], mask=prev < 0),
        }))
    empty = pa.schema([("map_id", pa.int64()), ("source", pa.int64()), ("id", pa.int64()), ("cost", pa.float64()), ("previous", pa.int64())])
    return pa.concat_tables(parts) if parts else empty.empty_table()


def _routes(edges: pa.Table, wanted: pa.Table) -> pa.Table:
    """The path to each wanted target; every source spreads once."""
    rows = sorted(zip(*(wanted.column(c).to_pylist() for c in ("map_id", "source", "target"))))
    graph, out, last = Graph(edges, np.array([r[1] for r in rows], np.int64)), [], None
    for m, s, t in rows:
        if s != last:
            (best, before), last = graph.spread(s), s
        at = int(np.searchsorted(graph.ids, t))
        if at == len(graph.ids) or graph.ids[at] != t or best[at] is None:
            continue
        path, k = [], at
        while k >= 0:
            path.append(int(graph.ids[k]))
            k = before[k]
        out.append((m, s, t, best[at][0], path[::-1]))
    names, kinds = ["map_id", "source", "target", "cost", "path"], [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names=names)


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).cast("double" if c == "w" else "long").alias(c) for c in columns))


def _by_size(edges: DataFrame, wanted: DataFrame, fits: int, small, schema: str, large) -> DataFrame:
    """The results of the small maps' groups, and those that ``large`` gives for the other maps."""
    edges = checkpointed(edges)
    sizes = edges.groupBy("map_id").agg(F.count("*").alias("n_edges")).join(wanted.groupBy("map_id").agg(F.count("*").alias("n_wanted")), "map_id", "full_outer").na.fill(0)
    sizes = checkpointed(sizes.select("map_id", "n_edges", F.ceil(F.col("n_edges") * F.col("n_wanted") / WORK).alias("blocks")))
    many = sizes.filter(F.col("n_edges") > fits).select("map_id")
    blocks = sizes.filter(F.col("n_edges") <= fits).select("map_id", F.greatest("blocks", F.lit(1)).cast("int").alias("blocks"))
    own = wanted.join(blocks, "map_id").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))).select(*wanted.columns, "block")
    each = edges.join(blocks, "map_id").select(*edges.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    out = each.groupBy("map_id", "block").cogroup(own.groupBy("map_id", "block")).applyInArrow(small, schema)
    if many.isEmpty():
        return out
    return out.unionByName(large(edges.join(many, "map_id", "left_semi"), wanted.join(many, "map_id", "left_semi")))


def shortest(edges: DataFrame, sources: DataFrame, fits: int = FITS) -> DataFrame:
    """map_id, source, id, cost and previous room of every room that a source reaches.

    ``edges`` has map_id, src, dst and w; ``sources`` has map_id and source.
    """
    return _by_size(_whole(edges, "map_id", "src", "dst", "w"), _whole(sources, "map_id", "source").distinct(), fits, _costs, COSTS, relaxed)


def routes(edges: DataFrame, wanted: DataFrame, fits: int = FITS) -> DataFrame:
    """map_id, source, target, the cost and the rooms of the path in order; wanted pairs without a path have no row."""
    large = lambda e, w: paths(relaxed(e, w.select("map_id", "source").distinct()), w)
    return _by_size(_whole(edges, "map_id", "src", "dst", "w"), _whole(wanted, "map_id", "source", "target").distinct(), fits, _routes, ROUTES, large)


def with_rides(edges: DataFrame, rides: DataFrame, rooms: DataFrame, avoid_locked: bool = True, is_locked: Column | None = None) -> DataFrame:
    """Walkable edges and virtual ones (map_id, src, dst, cost and, if there is one, hop), such as rides or a caller's own.

    No direction rules a virtual edge out, but it needs a cost of 0 or more and rooms of the map at
    both ends, and none leads to a locked room unless these may be entered.
    """
    known = rooms.select("map_id", F.col("id").alias("dst"), F.coalesce(is_locked if is_locked is not None else F.col("locked"), F.lit(False)).alias("_shut")).groupBy("map_id", "dst").agg(F.bool_or("_shut").alias("_shut"))
    hop = F.col("hop") if "hop" in rides.columns else F.lit("")
    virtual = rides.filter(F.col("cost") >= 0).select("map_id", "src", "dst", F.col("cost").cast("double").alias("w"), hop.alias("hop"))
    virtual = virtual.join(known, ["map_id", "dst"]).join(known.select("map_id", F.col("dst").alias("src")), ["map_id", "src"], "left_semi")
    virtual = virtual.filter(~F.col("_shut")) if avoid_locked else virtual
    walk = edges.select("map_id", "src", "dst", F.col("w").cast("double").alias("w"), F.lit(None).cast(virtual.schema["hop"].dataType).alias("hop"))
    return walk.unionByName(virtual.select("map_id", "src", "dst", "w", "hop"))


def _settled(edges: pa.Table, labels: pa.Table) -> pa.Table:
    """The labels of a block after what is new in them has spread along the edges within it.

    What ``moved`` spreads, and becomes ``fresh`` as all that it improves does.
    """
    out = labels.select(["map_id", "source", "id", "cost", "idle", "previous", "fresh"])
    moved = labels.column("moved").to_numpy(zero_copy_only=False)
    if not moved.any() or not edges.num_rows:
        return out
    src, dst, w = (edges.column(c).to_numpy() for c in ("src", "dst", "w"))
    order = np.argsort(src, kind="stable")
    ids, begin = np.unique(src[order], return_index=True)
    span = dict(zip(ids.tolist(), zip(begin.tolist(), [*begin.tolist()[1:], len(src)])))
    to, far = dst[order].tolist(), w[order].tolist()
    key = list(zip(labels.column("source").to_pylist(), labels.column("id").to_pylist()))
    best = dict(zip(key, zip(labels.column("cost").to_pylist(), labels.column("idle").to_pylist())))
    before, fresh = dict(zip(key, labels.column("previous").to_pylist())), dict(zip(key, labels.column("fresh").to_pylist()))
    heap = [(best[key[i]], *key[i]) for i in np.flatnonzero(moved).tolist()]
    heapq.heapify(heap)
    while heap:
        c, s, a = heapq.heappop(heap)
        if c != best[s, a]:
            continue
        for k in range(*span.get(a, (0, 0))):
            b = (s, to[k])
            total = c[0] + far[k]
            new, old = (total, 0 if total > c[0] else c[1] + 1), best.get(b)
            if not total < float("inf"):
                continue
            if old is None or new < old:
                best[b], before[b], fresh[b] = new, a, True
                heapq.heappush(heap, (new, *b))
            elif new == old and before[b] is not None and a < before[b]:
                before[b] = a
    m, kinds = labels.column("map_id")[0].as_py(), [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.bool_()]
    columns = [[m] * len(best), [k[0] for k in best], [k[1] for k in best], [c[0] for c in best.values()], [c[1] for c in best.values()], list(before.values()), list(fresh.values())]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=out.column_names)


def _bucketed(rows: DataFrame, n: int, *by: str) -> tuple[str, DataFrame]:
    """rows in n buckets by columns, and the name of their table."""
    name = f"rows_{uuid.uuid4().hex}"
    rows.repartition(n, *by).write.bucketBy(n, *by).option("path", shared_path(rows.sparkSession)).format("parquet").saveAsTable(name)
    return name, rows.sparkSession.table(name)


def relaxed(edges: DataFrame, sources: DataFrame, block: int = BLOCK, within: int = WITHIN) -> DataFrame:
    """The same costs by rounds: rooms whose cost fell reach their neighbours, and the least cost stays.

    An equal path found in a later round replaces the predecessor alone if it has a lesser one.
    Of the rooms that a round could follow only those go whose cost is near the least one, so that
    few are followed before their cost is final; how near doubles by round, so rounds stay few.
    A block with more than ``within`` edges has them followed by the join as well.
    """
    kind, spark = "struct<cost:double,idle:int,previous:long>", edges.sparkSession
    chunks = checkpointed(sources.groupBy("map_id").agg(F.ceil(F.count("*") / SOURCES).alias("chunks")))
    at = lambda c: F.floor(F.col(c) / block).alias("block") if block & (block - 1) else F.shiftright(c, block.bit_length() - 1).alias("block")
    own = edges.withColumn("inner", at("src") == at("dst")).withColumn("block", at("src"))
    crowded = checkpointed(own.filter("inner").groupBy("map_id", "block").agg(F.count("*").alias("n")).filter(F.col("n") > within).select("map_id", "block", F.lit(True).alias("crowded")))
    own = own.join(crowded, ["map_id", "block"], "left").withColumn("inner", F.col("inner") & F.col("crowded").isNull())
    inner = checkpointed(own.filter("inner").join(chunks, "map_id").select("map_id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "src", "dst", "w"))
    outer = own.filter("not inner").select("map_id", "src", "dst", "w")
    name, outer = _bucketed(outer, max(1, -(-outer.count() // BUCKET)), "map_id", "src")
    try:
        wide = checkpointed(outer.groupBy("map_id").agg(F.greatest(F.min("w"), F.avg("w") / 4).alias("wide")))
        settle = lambda df: df.join(chunks, "map_id").withColumn("block", at("id")).withColumn("chunk", F.pmod(F.xxhash64("source"), F.col("chunks"))).drop("chunks")
        first = sources.select("map_id", "source", F.col("source").alias("id"), F.lit(0.0).alias("cost"), F.lit(0).alias("idle"), F.lit(None).cast("long").alias("previous"), F.lit(True).alias("fresh"), F.lit(True).alias("moved"))
        group, reach = ["map_id", "block", "chunk"], 1
        while True:
            best = checkpointed(inner.groupBy(*group).cogroup(settle(first).groupBy(*group)).applyInArrow(_settled, LABELS))
            front = best.filter("fresh")
            if front.isEmpty():
                return best.select(*KEY, "cost", "previous")
            near = front.groupBy("map_id", "source").agg(F.min("cost").alias("least")).join(wide, "map_id", "left").select("map_id", "source", (F.col("least") + F.coalesce(F.col("wide") * reach, F.lit(float("inf")))).alias("upto"))
            reach *= 2
            old = best.join(near, ["map_id", "source"], "left").withColumn("now", F.col("fresh") & (F.col("cost") <= F.col("upto")))
            step = outer.join(old.filter("now").select("map_id", "source", F.col("id").alias("src"), "cost", "idle").hint("shuffle_hash"), ["map_id", "src"])
            cost = F.col("cost") + F.col("w")
            new = step.select("map_id", "source", F.col("dst").alias("id"), F.struct(cost.alias("cost"), F.when(cost > F.col("cost"), 0).otherwise(F.col("idle") + 1).alias("idle"), F.col("src").alias("previous")).cast(kind).alias("b"))
            new = new.filter(F.col("b.cost") < float("inf")).groupBy(*KEY).agg(F.min("b").alias("b")).select(*KEY, "b", F.lit(None).cast(kind).alias("old"), F.lit(False).alias("fresh"))
            label = F.struct("cost", "idle", "previous").cast(kind)
            both = old.select(*KEY, label.alias("b"), label.alias("old"), (F.col("fresh") & ~F.col("now")).alias("fresh")).unionByName(new)
            both = both.groupBy(*KEY).agg(F.min("b").alias("b"), F.min("old").alias("old"), F.max("fresh").alias("fresh"))
            moved = F.col("old").isNull() | (F.struct("b.cost", "b.idle") < F.struct("old.cost", "old.idle"))
            first = both.withColumn("moved", moved).select(*KEY, "b.cost", "b.idle", "b.previous", (F.col("fresh") | F.col("moved")).alias("fresh"), "moved")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def paths(costs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The paths that predecessors give, as ``routes`` has them.

    Jumps of 1, 2, 4, ... rooms back are made by doubling, and the rooms of all wanted paths by
    them, the longest first; so there are as many joins as the length of the longest path has bits.
    """
    own = ["map_id", "source"]
    jumps = [costs.filter("previous is not null").select(*own, F.col("id").alias("at"), F.col("previous").alias("to"))]
    while True:
        one = jumps[-1]
        two = checkpointed(one.withColumnRenamed("to", "mid").join(one.select(*own, F.col("at").alias("mid"), "to"), [*own, "mid"]).select(*own, "at", "to"))
        if two.isEmpty():
            break
        jumps.append(two)
    start = wanted.join(costs.select(*own, F.col("id").alias("target"), "cost"), [*own, "target"])
    on = start.select(*own, "target", "cost", F.col("target").alias("at"), F.lit(0).cast("long").alias("back"))
    for k, jump in reversed(list(enumerate(jumps))):
        on = checkpointed(on)
        far = on.join(jump, [*own, "at"]).select(*own, "target", "cost", F.col("to").alias("at"), (F.col("back") + (1 << k)).alias("back"))
        on = on.unionByName(far)
    path = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("k"), "at"))), lambda x: x["at"])
    return on.groupBy(*own, "target").agg(F.max("cost").alias("cost"), path.alias("path"))


def legs(waypoints: DataFrame) -> DataFrame:
    """Consecutive pairs of waypoints (map_id, plan, pos, room): plan, leg, source and target."""
    after = Window.partitionBy("map_id", "plan").orderBy("pos")
    pairs = waypoints.select("map_id", "plan", "pos", F.col("room").alias("source"), F.lead("room").over(after).alias("target"), F.lead("pos").over(after).alias("next"))
    return pairs.filter("next is not null").select("map_id", "plan", F.col("pos").alias("leg"), "source", "target")


def planned(waypoints: DataFrame, edges: DataFrame, fits: int = FITS) -> DataFrame:
    """Each leg's path and cost; a leg with a null end has neither, and makes no plan incomplete."""
    wanted = legs(waypoints)
    full = wanted.filter("source is not null and target is not null")
    return wanted.join(routes(edges, full, fits), ["map_id", "source", "target"], "left")


def hops(found: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, step, src, dst, w and hop of every step of the paths; a step on foot has no hop.

    Of parallel edges a step takes the cheapest, and of those one on foot.
    """
    step = found.select("map_id", *key, F.posexplode("path").alias("step", "src"), "path").withColumn("dst", F.try_element_at("path", F.col("step") + 2)).filter("dst is not null").drop("path")
    own = edges.select("map_id", "src", "dst", "w", "hop").join(step.select("map_id", "src", "dst").distinct(), ["map_id", "src", "dst"], "left_semi")
    best = own.groupBy("map_id", "src", "dst").agg(F.min(F.struct("w", "hop")).alias("e"))
    return step.join(best, ["map_id", "src", "dst"]).select("map_id", *key, "step", "src", "dst", "e.w", "e.hop")


def plan_totals(found: DataFrame) -> DataFrame:
    """total_steps, and complete: every leg with both ends has a path."""
    computed = F.col("source").isNotNull() & F.col("target").isNotNull()
    return found.groupBy("map_id", "plan").agg(F.sum(F.coalesce(F.size("path") - 1, F.lit(0)) * F.col("path").isNotNull().cast("int")).cast("long").alias("total_steps"), F.bool_and(~computed | F.col("path").isNotNull()).alias("complete"))


def special_steps(found: DataFrame, exits: DataFrame) -> DataFrame:
    """How many steps of each path only a special exit makes."""
    steps = found.select("map_id", "plan", "leg", F.posexplode("path").alias("i", "src"), "path").withColumn("dst", F.try_element_at("path", F.col("i") + 2)).filter("dst is not null")
    kinds = exits.groupBy("map_id", "src", "dst").agg(F.bool_and("special").alias("only_special"))
    return steps.drop("path").join(kinds, ["map_id", "src", "dst"], "left").groupBy("map_id", "plan", "leg").agg(F.count_if(F.coalesce("only_special", F.lit(False))).alias("special_steps"))


def reach(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """Rooms within so many steps of each source, with the least number of steps."""
    seen = sources.select("map_id", "source", F.col("source").alias("id"), F.lit(0).alias("steps"))
    front = seen
    for k in range(1, hops + 1):
        new = front.join(edges.select("map_id", F.col("src").alias("id"), "dst"), ["map_id", "id"]).select("map_id", "source", F.col("dst").alias("id")).distinct()
        front = new.join(seen.select("map_id", "source", "id"), ["map_id", "source", "id"], "left_anti").withColumn("steps", F.lit(k))
        seen = seen.unionByName(front)
    return seen
