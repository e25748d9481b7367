"""Map tables made from the driver's tables, by whole-number arithmetic that SQL can repeat.

Customers are rooms, in maps of MAP rooms laid out in rows of ROW; suppliers are special exits;
events are transport legs and edit logs; orders are two snapshots; documents are a search corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAP, ROW = 400, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.expr(f"c_custkey div {MAP}").alias("map_id"), (k + 1).alias("id"), F.col("c_nationkey").cast("long").alias("area_id"), F.col("c_nationkey").cast("long").alias("area_ord"), k.alias("room_ord"),
        (k % ROW).alias("x"), F.expr(f"(c_custkey div {ROW}) % 10").alias("y"), F.when(k % 97 == 0, 1).otherwise(0).cast("long").alias("z"), F.when(k % 3 == 0, k % 256).otherwise(257 + k % 5).alias("env"),
        (1 + k % 7).alias("weight"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"), (F.col("c_acctbal") < 0).alias("locked"), F.substring("c_mktsegment", 1, 1).alias("symbol"),
    )


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms with their areas' names."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"), F.col("n_name").alias("area_title"))
    return rooms(spark, sf_dir).join(nation, "area_id")


def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    steps = [("e", k + 1, k % ROW < ROW - 1), ("w", k - 1, k % ROW > 0), ("s", k + ROW, F.expr(f"(c_custkey div {ROW}) % 10 < 9")), ("n", k - ROW, F.expr(f"(c_custkey div {ROW}) % 10 > 0")), ("up", k + ROW + 1, k % 11 == 0), ("secret", k + 3, k % 29 == 0)]
    each = F.explode(F.filter(F.array(*(F.struct(F.lit(name).alias("key"), (to + 1).alias("dst"), when.alias("is"), F.lit(i).cast("long").alias("pos")) for i, (name, to, when) in enumerate(steps))), lambda s: s["is"])).alias("s")
    normal = table(spark, sf_dir, "customer").select("c_custkey", each).select(
        F.expr(f"c_custkey div {MAP}").alias("map_id"), (k + 1).alias("src"), "s.key", "s.dst", F.lit(False).alias("special"), "s.pos",
        F.when(k % 13 == 0, 5.0).alias("weight"), ((k % 17 == 0) & (F.col("s.key") == "e")).alias("locked"),
    )
    n = table(spark, sf_dir, "customer").count()
    at = table(spark, sf_dir, "supplier").withColumn("k", (F.col("s_suppkey") * 7) % n)
    key = F.when(F.col("s_suppkey") % 10 == 0, "e").otherwise(F.concat(F.lit("enter "), F.col("s_suppkey").cast("string")))
    special = at.select(F.expr(f"k div {MAP}").alias("map_id"), (F.col("k") + 1).alias("src"), key.alias("key"), (F.expr(f"(k div {MAP}) * {MAP}") + (F.col("s_suppkey") * 37) % MAP + 1).alias("dst"), F.lit(True).alias("special"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("double").alias("weight"), F.lit(False).alias("locked"))
    return normal.unionByName(special)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom lines from parts: each on an exit of a room; every fourth one suppresses."""
    p = F.col("p_partkey")
    n = table(spark, sf_dir, "customer").count()
    points = F.when(p % 4 == 0, F.array().cast("array<array<double>>")).otherwise(F.array(F.array(F.lit(1.0), F.lit(2.0))))
    return table(spark, sf_dir, "part").filter(p < n).select(F.expr(f"p_partkey div {MAP}").alias("map_id"), (p + 1).alias("room_id"), F.element_at(F.array(*map(F.lit, ("e", "w", "s", "n"))), (p % 4 + 1).cast("int")).alias("key"), points.alias("points")).filter(p % 3 == 0)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit log: an event a row, by user; a sign-up adds, an error deletes, others edit."""
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("edit")
    v = F.floor("value").cast("long")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("log_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"), kind.alias("type"), (v % 5).alias("before"), (v % 7).alias("after"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport lines: a customer's orders by number, each a leg to the next one's room; the last leads back."""
    from pyspark.sql import Window

    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = table(spark, sf_dir, "customer").count()
    stop = (F.col("o_orderkey") * 31) % n
    o = table(spark, sf_dir, "orders").withColumn("pos", (F.row_number().over(own) - 1).cast("long")).withColumn("stop", stop)
    o = o.withColumn("next", F.coalesce(F.lead("stop").over(own), F.min_by("stop", "o_orderkey").over(Window.partitionBy("o_custkey"))))
    src = F.when(F.col("o_orderkey") % 23 == 0, F.col("stop") + 1).otherwise(F.col("stop"))
    return o.select(F.lit(0).cast("long").alias("map_id"), F.col("o_custkey").alias("line"), F.lit("ride").alias("board"), F.lit("leave").alias("exit_command"), "pos", (src + 1).alias("src"), (F.col("next") + 1).alias("dst"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 5 * 20).cast("double")).alias("time"), F.col("o_orderpriority").alias("label"))


def snapshot(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Orders as rooms of two versions: some only in one, some changed, some that differ by defaults alone."""
    k = F.col("o_orderkey")
    pick = lambda changed, was, then: F.when(changed, then).otherwise(was) if new else was
    either = lambda was, then: then if new else was
    entries = lambda *pairs: F.map_from_entries(F.filter(F.array(*(F.when(on, F.struct(F.lit(key).alias("key"), value.alias("value"))) for key, on, value in pairs)), lambda e: e.isNotNull()))
    line = lambda y: F.struct(F.when(y == 0, F.array().cast("array<array<double>>")).otherwise(F.array(F.array(F.lit(1.0), y.cast("double")))).alias("points"), F.lit(None).cast("array<int>").alias("color"), F.lit(either("solid", None)).cast("string").alias("style"), F.lit(either(False, None)).cast("boolean").alias("arrow"))
    west = (k % 3 == 0) & ((k + 3) % 10 != 1) if new else k % 3 == 0
    base = table(spark, sf_dir, "orders").filter(k % 10 != 1 if new else k % 10 != 0)
    return base.select(
        F.lit(0).cast("long").alias("map_id"), k.alias("id"), pick(k % 19 == 0, F.col("o_custkey") % 25, F.col("o_custkey") % 25 + 1).alias("area_id"), pick(k % 5 <= 1, k % ROW, k % ROW + 1).alias("x"), F.expr(f"o_orderkey div {ROW}").alias("y"),
        either(F.when(k % 4 > 0, F.lit(0)), F.lit(0)).cast("long").alias("z"), pick(k % 6 == 0, k % 4, k % 4 + 1).alias("env"), F.when(k % 8 == 3, F.lit(either(None, ""))).otherwise(F.col("o_orderstatus")).alias("symbol"),
        pick(k % 7 == 0, F.col("o_orderpriority"), F.lit("renamed")).alias("name"), pick(k % 11 == 0, F.lit(""), F.lit("seen")).alias("notes"), F.lit(either(1, None)).cast("long").alias("weight"), F.lit(either(False, None)).cast("boolean").alias("locked"),
        entries(("n", F.lit(True), pick(k % 13 == 0, k + 1, k + 2)), ("e", (k % 2 == 0) & (k % 17 != 0) if new else k % 2 == 0, k + 10), ("w", west, k + 3), ("s", k % 23 == 0 if new else F.lit(False), k + 5)).alias("exits"),
        entries(("n", k % 3 == 0, pick(k % 29 == 0, F.lit("open"), F.lit("closed"))), ("w", west, F.lit("locked"))).alias("doors"),
        entries(("n", (k % 2 == 0) & (k % 37 != 0) if new else k % 2 == 0, line(pick(k % 31 == 0, F.lit(2), F.lit(3)))), ("e", k % 41 == 0 if new else F.lit(False), line(F.lit(0)))).alias("custom_lines"),
    )


def areas(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Nations as the areas of two versions."""
    k = F.col("n_nationkey")
    base = table(spark, sf_dir, "nation").filter(k % 10 != 1 if new else k % 10 != 0)
    data = F.when(k % 11 == 0, F.create_map(F.lit("a"), F.lit("1"))) if new else F.lit(None)
    return base.select(F.lit(0).cast("long").alias("map_id"), k.cast("long").alias("id"), (F.when(k % 7 == 0, F.lit("renamed")).otherwise(F.col("n_name")) if new else F.col("n_name")).alias("name"), data.cast("map<string,string>").alias("user_data"))


def labels(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Parts as the labels of two versions."""
    k = F.col("p_partkey")
    more = lambda n: F.when(k % n == 0, 1).otherwise(0) if new else F.lit(0)
    base = table(spark, sf_dir, "part").filter(k % 10 != 1 if new else k % 10 != 0)
    return base.select(F.lit(0).cast("long").alias("map_id"), (k % 25).alias("area_id"), k.alias("id"), (k % 50 + more(5)).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("z"), (k % 7 + more(6)).cast("double").alias("width"), F.lit(1.0).alias("height"), (F.when(k % 13 == 0, F.lit("renamed")).otherwise(F.col("p_name")) if new else F.col("p_name")).alias("text"))


def colors(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Suppliers as the colours of two versions."""
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").filter(k % 10 != 1 if new else k % 10 != 0)
    red = F.when(k % 5 == 0, 255 - k % 256).otherwise(k % 256) if new else k % 256
    return base.select(F.lit(0).cast("long").alias("map_id"), k.alias("env"), F.array(red, F.lit(10).cast("long"), F.lit(20).cast("long")).alias("rgb"))


def delta_state(spark: SparkSession, sf_dir: str):
    """One map to which a delta is applied: customers as rooms, nations as areas, parts as labels."""
    from wayloom.operators.apply import State

    k, zero = F.col("c_custkey"), F.lit(0).cast("long")
    cust = table(spark, sf_dir, "customer")
    rooms = cust.select(zero.alias("map_id"), (k + 1).alias("id"), F.col("c_nationkey").cast("long").alias("area_id"), (k % ROW).alias("x"), F.expr(f"c_custkey div {ROW}").alias("y"), zero.alias("z"), (k % 9).alias("env"), F.substring("c_mktsegment", 1, 1).alias("symbol"), F.col("c_name").alias("name"))
    exits = cust.select(zero.alias("map_id"), (k + 1).alias("src"), F.explode(F.array(F.struct(F.lit("n").alias("key"), (k + 2).alias("dst"), F.lit(False).alias("special")), F.struct(F.lit("e").alias("key"), (k + 11).alias("dst"), F.lit(False).alias("special")), F.struct(F.lit("climb").alias("key"), (k + 3).alias("dst"), F.lit(True).alias("special")))).alias("e")).select("map_id", "src", "e.*")
    lines = cust.filter(k % 2 == 0).select(zero.alias("map_id"), (k + 1).alias("room_id"), F.lit("n").alias("key"), F.lit("old").alias("line"))
    areas = table(spark, sf_dir, "nation").select(zero.alias("map_id"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    p = F.col("p_partkey")
    labels = table(spark, sf_dir, "part").select(zero.alias("map_id"), (p % 25).alias("area_id"), p.alias("id"), (p % 50).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("width"), F.lit(1.0).alias("height"), F.col("p_name").alias("text"))
    colors = table(spark, sf_dir, "supplier").select(zero.alias("map_id"), F.col("s_suppkey").alias("env"), F.array(F.col("s_suppkey") % 256, F.lit(1).cast("long"), F.lit(2).cast("long")).alias("rgb"))
    return State(areas, rooms, exits, lines, labels, colors)


DELTA_TYPES = ["ADD_ROOM", "DELETE_ROOM", "MOVE_ROOM_TO_AREA", "MOVE_ROOM", "EDIT_ROOM", "ADD_EXIT", "DELETE_EXIT", "DELETE_SPECIAL_EXIT", "PAINT_BATCH", "ADD_CL", "EDIT_CL", "DELETE_CL", "MOVE_LABEL", "DELETE_LABEL", "EDIT_ENV_COLOR", "ADD_AREA", "EDIT_AREA"]


def delta_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on that map; rooms that move are every third, and targets keep clear of these."""
    from wayloom.operators.apply import OPERATIONS
    from wayloom.schema import lookup

    e, n = F.col("event_id"), table(spark, sf_dir, "customer").count()
    kind = F.element_at(F.array(*map(F.lit, DELTA_TYPES)), (e % len(DELTA_TYPES) + 1).cast("int"))
    y = e % (n // ROW + 1)
    x = F.when((e % 45 < ROW) & ((e % 45 + y + 1) % 3 == 0), 44).otherwise(e % 45)
    room = F.when(e % 10 == 0, 1_000_000_000).when(F.col("type") == "MOVE_ROOM", F.floor((e * 7 % n) / 3) * 3 + 3).otherwise(e * 7 % n + 1)
    new = F.col("type") == "ADD_ROOM"
    of = {
        "map_id": F.lit(0), "seq": e + 1, "type": F.col("type"), "room": F.when(new, F.concat(F.lit("d:"), (e + 1).cast("string"))).otherwise(room.cast("string")), "area": F.when(F.col("type") == "ADD_AREA", F.concat(F.lit("d:"), (e + 1).cast("string"))).otherwise((e % 30).cast("string")),
        "to_area": (e * 3 % 30).cast("string"), "dst": F.when(e % 37 == 0, "d:999999999").otherwise((e * 13 % n + 1).cast("string")), "label": (e * 5 % 500).cast("string"), "key": F.when(F.col("type") == "DELETE_SPECIAL_EXIT", "climb").otherwise(lookup(e % 4, {0: "n", 1: "e", 2: "s", 3: "up"})),
        "x": x, "y": y, "z": F.lit(0), "env": F.when(F.col("type") == "EDIT_ENV_COLOR", e % 50).otherwise(e % 9), "symbol": F.when(F.col("type") == "PAINT_BATCH", F.when(e % 2 == 0, "s").otherwise("")), "name": F.concat(F.lit("new "), e.cast("string")),
        "line": F.lit("new"), "rgb": F.when(e % 4 > 0, F.array(*[F.lit(9).cast("long")] * 3)),
    }
    kinds = dict(c.strip().rsplit(" ", 1) for c in OPERATIONS.split(","))
    base = table(spark, sf_dir, "events").select(e, kind.alias("type"))
    return base.select(*(of.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


#: The state after those operations and the skipped ones, as SQL to stand before a query.
DELTA_SQL = f""" , cn AS (SELECT count(*) AS n FROM customer),
ev AS (SELECT event_id AS e, ['{"', '".join(DELTA_TYPES)}'][event_id % {len(DELTA_TYPES)} + 1] AS type, event_id % (n // {ROW} + 1) AS y, CASE WHEN e % 45 < {ROW} AND (e % 45 + y + 1) % 3 = 0 THEN 44 ELSE e % 45 END AS x,
  CASE WHEN e % 10 = 0 THEN 1000000000 WHEN type = 'MOVE_ROOM' THEN (e * 7 % n) // 3 * 3 + 3 ELSE e * 7 % n + 1 END AS room, e % 30 AS area, e * 3 % 30 AS to_area, e * 13 % n + 1 AS dst, e % 37 = 0 AS lost, e * 5 % 500 AS label, ['n', 'e', 's', 'up'][e % 4 + 1] AS key FROM events, cn),
skip0 AS (SELECT e, 'SID_LEFTOVER' AS code FROM ev WHERE lost), todo AS (SELECT * FROM ev WHERE NOT lost),
areas0 AS (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation), areas1 AS (SELECT * FROM areas0 UNION ALL SELECT (SELECT max(id) FROM areas0) + row_number() OVER (ORDER BY e), 'new ' || e FROM todo WHERE type = 'ADD_AREA'),
ea AS (SELECT * FROM todo WHERE type = 'EDIT_AREA' QUALIFY row_number() OVER (PARTITION BY area ORDER BY e DESC) = 1), areas2 AS (SELECT a.id, CASE WHEN ea.e IS NOT NULL THEN 'new ' || ea.e ELSE a.name END AS name FROM areas1 a LEFT JOIN ea ON ea.area = a.id),
colors1 AS (SELECT s_suppkey AS env, [s_suppkey % 256, 1, 2] AS rgb FROM supplier), ec AS (SELECT *, e % 50 AS env FROM todo WHERE type = 'EDIT_ENV_COLOR' QUALIFY row_number() OVER (PARTITION BY e % 50 ORDER BY e DESC) = 1),
colors2 AS (SELECT * FROM colors1 WHERE env NOT IN (SELECT env FROM ec) UNION ALL SELECT env, [9, 9, 9] FROM ec WHERE e % 4 > 0),
r0 AS (SELECT c_custkey + 1 AS id, c_nationkey::BIGINT AS area_id, c_custkey % {ROW} AS x, c_custkey // {ROW} AS y, c_custkey % 9 AS env, left(c_mktsegment, 1) AS symbol, c_name AS name FROM customer),
ar AS (SELECT e, area, x, y, CASE WHEN area NOT IN (SELECT id FROM areas2) THEN 'AREA_MISSING' WHEN EXISTS (SELECT 1 FROM r0 WHERE r0.area_id = t.area AND r0.x = t.x AND r0.y = t.y) OR row_number() OVER (PARTITION BY area, x, y ORDER BY e) > 1 THEN 'CELL_OCCUPIED' END AS code FROM todo t WHERE type = 'ADD_ROOM'),
r1 AS (SELECT * FROM r0 UNION ALL SELECT (SELECT n FROM cn) + row_number() OVER (ORDER BY e), area, x, y, e % 9, NULL, 'new ' || e FROM ar WHERE code IS NULL),
ma AS (SELECT e, room, to_area, CASE WHEN r.id IS NULL THEN 'ROOM_MISSING' WHEN to_area NOT IN (SELECT id FROM areas2) THEN 'TARGET_AREA_MISSING' WHEN r.area_id = to_area THEN 'ALREADY_IN_AREA' END AS code FROM (SELECT * FROM todo WHERE type = 'MOVE_ROOM_TO_AREA' QUALIFY row_number() OVER (PARTITION BY room ORDER BY e DESC) = 1) t LEFT JOIN r1 r ON r.id = t.room),
r2 AS (SELECT r.* REPLACE (coalesce(m.to_area, r.area_id) AS area_id) FROM r1 r LEFT JOIN ma m ON m.room = r.id AND m.code IS NULL),
dr AS (SELECT e, room, CASE WHEN room NOT IN (SELECT id FROM r2) THEN 'ROOM_MISSING' END AS code FROM todo WHERE type = 'DELETE_ROOM' QUALIFY row_number() OVER (PARTITION BY room ORDER BY e DESC) = 1), gone AS (SELECT room AS id FROM dr WHERE code IS NULL),
r3 AS (SELECT * FROM r2 WHERE id NOT IN (SELECT id FROM gone)),
x0 AS (SELECT c_custkey + 1 AS src, unnest(['n', 'e', 'climb']) AS key, unnest([c_custkey + 2, c_custkey + 11, c_custkey + 3]) AS dst, unnest([false, false, true]) AS special FROM customer),
x3 AS (SELECT * FROM x0 WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)),
l3 AS (SELECT c_custkey + 1 AS room_id, 'n' AS key, 'old' AS line FROM customer WHERE c_custkey % 2 = 0 AND c_custkey + 1 NOT IN (SELECT id FROM gone) AND c_custkey + 2 NOT IN (SELECT id FROM gone)),
mr0 AS (SELECT t.*, r.id, r.area_id AS a, r.x AS rx, r.y AS ry FROM (SELECT * FROM todo WHERE type = 'MOVE_ROOM' QUALIFY row_number() OVER (PARTITION BY room ORDER BY e DESC) = 1) t LEFT JOIN r3 r ON r.id = t.room),
mr1 AS (SELECT *, CASE WHEN id IS NULL THEN 'ROOM_MISSING' WHEN x = rx AND y = ry THEN 'ALREADY_THERE' WHEN EXISTS (SELECT 1 FROM r3 o WHERE o.area_id = m.a AND o.x = m.x AND o.y = m.y AND o.id <> m.id) THEN 'CELL_OCCUPIED' END AS c0 FROM mr0 m),
mr AS (SELECT *, coalesce(c0, CASE WHEN row_number() OVER (PARTITION BY a, x, y, c0 ORDER BY e) > 1 THEN 'CELL_OCCUPIED' END) AS code FROM mr1),
r4 AS (SELECT r.* REPLACE (coalesce(m.x, r.x) AS x, coalesce(m.y, r.y) AS y) FROM r3 r LEFT JOIN mr m ON m.room = r.id AND m.code IS NULL),
er AS (SELECT e, room, CASE WHEN room NOT IN (SELECT id FROM r4) THEN 'ROOM_MISSING' END AS code FROM todo WHERE type = 'EDIT_ROOM' QUALIFY row_number() OVER (PARTITION BY room ORDER BY e DESC) = 1),
r5 AS (SELECT r.* REPLACE (CASE WHEN t.e IS NOT NULL THEN 'new ' || t.e ELSE r.name END AS name, coalesce(t.e % 9, r.env) AS env) FROM r4 r LEFT JOIN er t ON t.room = r.id),
dx AS (SELECT e, room, key, CASE WHEN NOT EXISTS (SELECT 1 FROM x3 WHERE src = room AND x3.key = t.key AND NOT special) THEN 'EXIT_MISSING' END AS code FROM todo t WHERE type = 'DELETE_EXIT' QUALIFY row_number() OVER (PARTITION BY room, key ORDER BY e DESC) = 1),
ds AS (SELECT e, room, CASE WHEN NOT EXISTS (SELECT 1 FROM x3 WHERE src = room AND special) THEN 'SPECIAL_EXIT_MISSING' END AS code FROM todo t WHERE type = 'DELETE_SPECIAL_EXIT' QUALIFY row_number() OVER (PARTITION BY room ORDER BY e DESC) = 1),
x4 AS (SELECT * FROM x3 WHERE NOT EXISTS (SELECT 1 FROM dx WHERE room = src AND dx.key = x3.key AND NOT special) AND NOT EXISTS (SELECT 1 FROM ds WHERE room = src AND special)),
l4 AS (SELECT * FROM l3 WHERE NOT EXISTS (SELECT 1 FROM dx WHERE code IS NULL AND room = room_id AND dx.key = l3.key)),
ax0 AS (SELECT t.*, h.dst AS has, room IN (SELECT id FROM r5) AND t.dst IN (SELECT id FROM r5) AS fine FROM todo t LEFT JOIN x4 h ON h.src = t.room AND h.key = t.key AND NOT h.special WHERE type = 'ADD_EXIT'),
ax AS (SELECT *, CASE WHEN NOT fine THEN 'SRC_OR_TGT_MISSING' WHEN coalesce(has, first_value(dst) OVER (PARTITION BY room, key, fine ORDER BY e)) <> dst THEN 'DIR_OCCUPIED' END AS code FROM ax0),
x5 AS (SELECT * FROM x4 UNION ALL SELECT DISTINCT room, key, dst, false FROM ax WHERE code IS NULL AND has IS NULL),
ac AS (SELECT e, room, key, CASE WHEN room NOT IN (SELECT id FROM r5) THEN 'ROOM_MISSING' END AS code FROM todo WHERE type = 'ADD_CL' QUALIFY row_number() OVER (PARTITION BY room, key ORDER BY e DESC) = 1),
l5 AS (SELECT * FROM l4 WHERE NOT EXISTS (SELECT 1 FROM ac WHERE code IS NULL AND room = room_id AND ac.key = l4.key) UNION ALL SELECT room, key, 'new' FROM ac WHERE code IS NULL),
ed AS (SELECT e, room, key, CASE WHEN room NOT IN (SELECT id FROM r5) THEN 'ROOM_MISSING' WHEN NOT EXISTS (SELECT 1 FROM l5 WHERE room_id = room AND l5.key = t.key) THEN 'CL_MISSING' END AS code FROM todo t WHERE type = 'EDIT_CL' QUALIFY row_number() OVER (PARTITION BY room, key ORDER BY e DESC) = 1),
l6 AS (SELECT * REPLACE (CASE WHEN EXISTS (SELECT 1 FROM ed WHERE code IS NULL AND room = room_id AND ed.key = l5.key) THEN 'new' ELSE line END AS line) FROM l5),
dc AS (SELECT e, room, key, CASE WHEN NOT EXISTS (SELECT 1 FROM l6 WHERE room_id = room AND l6.key = t.key) THEN 'CL_MISSING' END AS code FROM todo t WHERE type = 'DELETE_CL' QUALIFY row_number() OVER (PARTITION BY room, key ORDER BY e DESC) = 1),
l7 AS (SELECT * FROM l6 WHERE NOT EXISTS (SELECT 1 FROM dc WHERE code IS NULL AND room = room_id AND dc.key = l6.key)),
pb AS (SELECT e, room, CASE WHEN room NOT IN (SELECT id FROM r5) THEN 'NO_ROOM_EXISTS' END AS code FROM todo WHERE type = 'PAINT_BATCH'), pl AS (SELECT * FROM pb WHERE code IS NULL QUALIFY row_number() OVER (PARTITION BY room ORDER BY e DESC) = 1),
r6 AS (SELECT r.* REPLACE (coalesce(p.e % 9, r.env) AS env, CASE WHEN p.e IS NULL THEN r.symbol WHEN p.e % 2 = 0 THEN 's' END AS symbol) FROM r5 r LEFT JOIN pl p ON p.room = r.id),
b0 AS (SELECT p_partkey % 25 AS area_id, p_partkey AS id, (p_partkey % 50)::DOUBLE AS x, 0::DOUBLE AS y FROM part),
ml AS (SELECT e, area, label, x, y, CASE WHEN NOT EXISTS (SELECT 1 FROM b0 WHERE area_id = area AND id = label) THEN 'LABEL_MISSING' END AS code FROM todo WHERE type = 'MOVE_LABEL' QUALIFY row_number() OVER (PARTITION BY area, label ORDER BY e DESC) = 1),
b1 AS (SELECT b.* REPLACE (coalesce(m.x, b.x) AS x, coalesce(m.y, b.y) AS y) FROM b0 b LEFT JOIN ml m ON m.area = b.area_id AND m.label = b.id),
dl AS (SELECT e, area, label, CASE WHEN NOT EXISTS (SELECT 1 FROM b1 WHERE area_id = area AND id = label) THEN 'LABEL_MISSING' END AS code FROM todo WHERE type = 'DELETE_LABEL' QUALIFY row_number() OVER (PARTITION BY area, label ORDER BY e DESC) = 1),
b2 AS (SELECT b.* FROM b1 b LEFT JOIN dl d ON d.area = b.area_id AND d.label = b.id WHERE d.e IS NULL),
skips AS (SELECT * FROM skip0 UNION ALL SELECT e, 'AREA_MISSING' FROM ea WHERE area NOT IN (SELECT id FROM areas1) {"".join(f" UNION ALL SELECT e, code FROM {t} WHERE code IS NOT NULL" for t in ("ar", "ma", "dr", "mr", "er", "dx", "ds", "ax", "ac", "ed", "dc", "pb", "ml", "dl"))})
"""


def _arrays(*pairs) -> Column:
    """The values whose condition holds, in order."""
    return F.filter(F.array(*(F.when(on, F.lit(v)) for v, on in pairs)), lambda v: v.isNotNull())


def faulty_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rooms with faults of every kind."""
    k = F.col("c_custkey")
    given = lambda n, value: F.when(k % n > 0, value)
    some = lambda kind, *pairs: F.map_from_entries(F.filter(F.array(*(F.when(on, F.struct(F.lit(key).alias("key"), value.cast(kind).alias("value"))) for key, on, value in pairs)), lambda e: e.isNotNull()))
    every = F.lit(True)
    line = F.struct(F.when(k % 3 > 0, F.array(F.when(k % 5 > 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0))))).alias("points"), F.array(k % 300, F.lit(0).cast("long"), F.lit(0).cast("long")).cast("array<int>").alias("color"), F.when(k % 11 > 0, "dash").otherwise("wavy").alias("style"), F.lit(None).cast("boolean").alias("arrow"))
    return table(spark, sf_dir, "customer").select(
        F.lit(0).cast("long").alias("map_id"), given(50, k).alias("id"), k.alias("x"), given(41, k).alias("y"), F.lit(0).alias("z"), given(31, k % 9).alias("env"), (k % 9).alias("weight"),
        _arrays(("n", every), ("n", k % 7 == 0), ("zz", k % 8 == 0)).alias("stubs"), _arrays(("e", k % 6 == 0), ("e", k % 12 == 0)).alias("exit_locks"), _arrays(("climb", k % 4 == 0)).alias("special_exit_locks"),
        F.when(k % 17 == 0, F.array(F.lit(None).cast("string"))).alias("tags"), some("string", ("a", k % 19 == 0, F.lit(None))).alias("user_data"),
        some("long", ("n", every, given(13, k + 1)), ("sideways", k % 14 == 0, k)).alias("exits"), some("long", ("climb", k % 5 == 0, k), (" ", k % 23 == 0, k), ("n", k % 29 == 0, k)).alias("special_exits"),
        some("double", ("n", every, F.when(k % 3 == 0, 1.5).otherwise(2.0)), ("w", k % 10 == 0, F.lit(0.0))).alias("exit_weights"), some("string", ("n", every, F.when(k % 15 == 0, "ajar").otherwise("open"))).alias("doors"),
        F.when(k % 2 == 0, F.map_from_entries(F.array(F.struct(F.when(k % 4 == 0, "n").otherwise("s").alias("key"), line.alias("value"))))).alias("custom_lines"),
    )


def faulty_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as labels with faults of every kind."""
    k = F.col("p_partkey")
    given = lambda n, value: F.when(k % n > 0, value)
    rgb = lambda top: F.array(k % top, F.lit(1).cast("long"), F.lit(2).cast("long")).cast("array<int>")
    return table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("map_id"), given(50, k).alias("id"), given(7, F.lit(1.0)).alias("x"), F.when(k % 9 == 0, float("nan")).otherwise(1.0).alias("y"), given(11, F.lit(0)).alias("z"), F.lit(1.0).alias("width"), F.when(k % 12 == 0, float("inf")).otherwise(1.0).alias("height"), given(13, F.col("p_name")).alias("text"), rgb(300).alias("fg_color"), given(5, rgb(200)).alias("bg_color"), F.when(k % 8 == 0, "AAA*").when(k % 8 == 1, "AAAA").alias("pixmap"))


def faulty_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as areas with faults of every kind."""
    k = F.col("n_nationkey")
    pos = F.when(k % 4 == 0, F.array(k, k)).when(k % 4 == 1, F.array(k, k, F.lit(None).cast("int"))).when(k % 4 == 2, F.array(k, k, k))
    return table(spark, sf_dir, "nation").select(F.lit(0).cast("long").alias("map_id"), F.when(k % 6 > 0, k).alias("id"), F.when(k % 5 > 0, F.col("n_name")).alias("name"), pos.alias("pos"), F.when(k % 3 == 0, F.create_map(F.lit("a"), F.when(k % 9 > 0, "1"))).alias("user_data"))


def faulty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents with faults of every kind."""
    k = F.col("s_suppkey")
    given = lambda n, value: F.when(k % n > 0, value)
    flag = lambda n: given(n, F.lit(False))
    font = F.struct(given(5, F.lit("serif")).alias("family"), F.lit(10.0).alias("point_size"), given(6, F.lit(-1.0)).alias("pixel_size"), F.lit(5).alias("style_hint"), given(7, F.lit(50)).alias("weight"), *(flag(n).alias(f) for f, n in (("style_setting", 8), ("underline", 9), ("strike_out", 10), ("fixed_pitch", 11))))
    hashes, data = F.create_map(F.lit("h"), given(16, F.lit(1))), F.create_map(F.lit("a"), given(17, F.lit("1")))
    meta = F.struct(given(3, F.col("s_name")).alias("map_name"), given(4, font).alias("symbol_font"), given(12, F.lit(1.0)).alias("symbol_font_fudge_factor"), given(13, F.lit(False)).alias("use_only_map_font"), hashes.alias("room_id_hash"), data.alias("user_data"))
    colors = F.struct(F.create_map(F.lit("1"), k.cast("int") * 10).alias("env_colors"), F.create_map(F.lit("2"), F.when(k % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)))).alias("custom_env_colors"))
    return table(spark, sf_dir, "supplier").select(k.alias("map_id"), F.when(k % 19 == 0, "other").otherwise("lanes").alias("format"), given(18, F.lit(2)).alias("format_version"), given(14, meta).alias("meta"), given(15, colors).alias("colors"), given(20, F.array(F.lit(1))).alias("areas"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rooms whose names are texts and whose areas are sources."""
    return table(spark, sf_dir, "documents").select(F.lit(0).cast("long").alias("map_id"), F.col("doc_id").alias("id"), F.col("text").alias("name"), F.col("source").alias("area_title"), F.lit(0).cast("long").alias("area_ord"), F.col("doc_id").alias("room_ord"))


#: The same tables as SQL, to stand before a query.
SQL = f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
rooms AS (SELECT c_custkey // {MAP} AS map_id, c_custkey + 1 AS id, c_nationkey::BIGINT AS area_id, c_custkey AS room_ord, c_custkey % {ROW} AS x, (c_custkey // {ROW}) % 10 AS y, CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE 0 END::BIGINT AS z,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 256 ELSE 257 + c_custkey % 5 END AS env, 1 + c_custkey % 7 AS weight, c_name || ' ' || c_mktsegment AS name, c_acctbal < 0 AS locked, left(c_mktsegment, 1) AS symbol FROM customer),
normal AS (SELECT c_custkey AS k, 'e' AS key, c_custkey + 2 AS dst, 0 AS pos FROM customer WHERE c_custkey % {ROW} < {ROW - 1} UNION ALL SELECT c_custkey, 'w', c_custkey, 1 FROM customer WHERE c_custkey % {ROW} > 0
  UNION ALL SELECT c_custkey, 's', c_custkey + {ROW + 1}, 2 FROM customer WHERE (c_custkey // {ROW}) % 10 < 9 UNION ALL SELECT c_custkey, 'n', c_custkey - {ROW - 1}, 3 FROM customer WHERE (c_custkey // {ROW}) % 10 > 0
  UNION ALL SELECT c_custkey, 'up', c_custkey + {ROW + 2}, 4 FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT c_custkey, 'secret', c_custkey + 4, 5 FROM customer WHERE c_custkey % 29 = 0),
exits AS (SELECT k // {MAP} AS map_id, k + 1 AS src, key, dst, false AS special, pos, CASE WHEN k % 13 = 0 THEN 5.0 END::DOUBLE AS weight, k % 17 = 0 AND key = 'e' AS locked FROM normal
  UNION ALL SELECT (s_suppkey * 7 % n) // {MAP}, s_suppkey * 7 % n + 1, CASE WHEN s_suppkey % 10 = 0 THEN 'e' ELSE 'enter ' || s_suppkey END, (s_suppkey * 7 % n) // {MAP} * {MAP} + s_suppkey * 37 % {MAP} + 1, true, 0, NULL, false FROM supplier, n),
lines AS (SELECT p_partkey // {MAP} AS map_id, p_partkey + 1 AS room_id, ['e', 'w', 's', 'n'][p_partkey % 4 + 1] AS key, p_partkey % 4 <> 0 AS drawn FROM part, n WHERE p_partkey < n AND p_partkey % 3 = 0),
log AS (SELECT user_id % 10 AS log_id, event_id AS seq, user_id AS key, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'edit' END AS type, floor(value)::BIGINT % 5 AS before, floor(value)::BIGINT % 7 AS after FROM events),
idx(key, idx, opp) AS (VALUES ('n', 1, 's'), ('ne', 2, 'sw'), ('nw', 3, 'se'), ('e', 4, 'w'), ('w', 5, 'e'), ('s', 6, 'n'), ('se', 7, 'nw'), ('sw', 8, 'ne'), ('up', 9, 'down'), ('down', 10, 'up'), ('in', 11, 'out'), ('out', 12, 'in')),
merged AS (SELECT *, row_number() OVER (PARTITION BY map_id, src, key ORDER BY special DESC) AS nth, bool_or(locked) OVER (PARTITION BY map_id, src, key) AS lk FROM exits),
adj AS (SELECT m.map_id, m.src, m.dst, m.key, CASE WHEN m.weight > 0 THEN m.weight ELSE greatest(r.weight, 1)::DOUBLE END AS w, CASE WHEN m.special OR idx IS NULL THEN 2 WHEN idx <= 8 THEN 0 ELSE 1 END AS cls, lk, r.locked AS dst_locked,
  s.area_id AS src_area, r.area_id AS dst_area, s.x AS sx, s.y AS sy, s.z AS sz, r.x AS dx, r.y AS dy, r.z AS dz
  FROM merged m JOIN rooms r ON r.map_id = m.map_id AND r.id = m.dst JOIN rooms s ON s.map_id = m.map_id AND s.id = m.src LEFT JOIN idx ON idx.key = m.key WHERE nth = 1 AND m.dst <> 0),
ok AS (SELECT *, o_orderkey AS k, (SELECT max(o_orderkey) FROM orders) AS mx FROM orders),
o0 AS (SELECT k AS id, o_custkey % 25 AS area_id, k % {ROW} AS x, k // {ROW} AS y, CASE WHEN k % 4 > 0 THEN 0 END AS z, k % 4 AS env, CASE WHEN k % 8 = 3 THEN '' ELSE o_orderstatus END AS symbol, o_orderpriority AS name, '' AS notes,
  k + 1 AS n, CASE WHEN k % 2 = 0 THEN k + 10 END AS e, CASE WHEN k % 3 = 0 AND NOT ((k + 3) % 10 = 1 AND k + 3 <= mx) THEN k + 3 END AS w, NULL::BIGINT AS s, k % 3 = 0 AS raw_w, CASE WHEN k % 3 = 0 THEN 'open' END AS door_n, w IS NOT NULL AS door_w, CASE WHEN k % 2 = 0 THEN 2 END AS line_n, NULL::INT AS line_e
  FROM ok WHERE k % 10 <> 0),
o1 AS (SELECT k AS id, o_custkey % 25 + (k % 19 = 0)::INT AS area_id, k % {ROW} + (k % 5 <= 1)::INT AS x, k // {ROW} AS y, 0 AS z, k % 4 + (k % 6 = 0)::INT AS env, CASE WHEN k % 8 = 3 THEN '' ELSE o_orderstatus END AS symbol, CASE WHEN k % 7 = 0 THEN 'renamed' ELSE o_orderpriority END AS name, CASE WHEN k % 11 = 0 THEN 'seen' ELSE '' END AS notes,
  k + 1 + (k % 13 = 0)::INT AS n, CASE WHEN k % 2 = 0 AND k % 17 <> 0 THEN k + 10 END AS e, CASE WHEN k % 3 = 0 AND (k + 3) % 10 <> 1 THEN k + 3 END AS w, CASE WHEN k % 23 = 0 THEN k + 5 END AS s, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 29 = 0 THEN 'closed' ELSE 'open' END END AS door_n, w IS NOT NULL AS door_w,
  CASE WHEN k % 2 = 0 AND k % 37 <> 0 THEN CASE WHEN k % 31 = 0 THEN 3 ELSE 2 END END AS line_n, CASE WHEN k % 41 = 0 THEN 0 END AS line_e FROM ok WHERE k % 10 <> 1),
flags AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NULL AS fresh, b.id IS NULL AS gone, a.area_id <> b.area_id AS area, a.name <> b.name OR a.notes <> b.notes AS edited, (a.x <> b.x) AS place, a.n <> b.n OR a.e IS DISTINCT FROM b.e OR a.w IS DISTINCT FROM b.w OR a.s IS DISTINCT FROM b.s AS exits,
  a.door_n IS DISTINCT FROM b.door_n OR a.door_w <> b.door_w AS doors, a.env <> b.env AS paint, a.env AS env_before, b.env AS env_after, a.symbol AS symbol_before, b.symbol AS symbol_after, b.area_id AS to_area, a.x AS x0, b.x AS x1, b.y AS y1,
  [a.n, a.e, a.s, a.w] AS to0, [b.n, b.e, b.s, b.w] AS to1, [a.line_n, a.line_e] AS line0, [b.line_n, b.line_e] AS line1 FROM o0 a FULL JOIN o1 b USING (id)),
ops AS (SELECT *, unnest(list_filter([CASE WHEN fresh THEN 'ADD_ROOM' END, CASE WHEN gone THEN 'DELETE_ROOM' END, CASE WHEN area THEN 'MOVE_ROOM_TO_AREA' END, CASE WHEN edited THEN 'EDIT_ROOM' END,
  CASE WHEN NOT edited AND place THEN 'MOVE_ROOM' END, CASE WHEN NOT edited AND doors THEN 'EDIT_EXIT' END, CASE WHEN NOT edited AND NOT exits AND NOT doors AND paint THEN 'PAINT_BATCH' END], lambda t: t IS NOT NULL)) AS type FROM flags),
stops AS (SELECT *, o_orderkey * 31 % n AS stop, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders, n),
legs AS (SELECT o_custkey AS line, pos, CASE WHEN o_orderkey % 23 = 0 THEN stop + 2 ELSE stop + 1 END AS src, coalesce(lead(stop) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), first_value(stop) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) + 1 AS dst,
  CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5 * 20)::DOUBLE END AS time, o_orderpriority AS label FROM stops)
"""
