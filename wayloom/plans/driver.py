"""Registered queries of the map-graph engine, and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.functions import codes
from wayloom.operators import apply, canonical, diff, display, geometry, graph, integrity, oplog, routing, rules, search, transports
from wayloom.plans import grid
from wayloom.schema import DIRECTIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **kinds: str):
    """Registers a query by its function's name; kinds are its columns with their types."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))

        QUERIES[fn.__name__] = run
        if sql:
            names = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            SQL[fn.__name__] = grid.SQL + ", result AS (" + sql + ") SELECT " + ", ".join(f"{c}::{names[k]} AS {c}" for c, k in kinds.items()) + " FROM result"
        return fn

    return add


def _adjacency(spark, sf):
    return graph.adjacency(grid.exits(spark, sf), grid.rooms(spark, sf))


def _walk(spark, sf):
    return graph.walkable(_adjacency(spark, sf))


def _firsts(spark, sf):
    return grid.rooms(spark, sf).groupBy("map_id").agg(F.min("id").alias("source"))


_WALK = "SELECT * FROM adj WHERE NOT lk AND NOT dst_locked"


# ---- graph ----


@query("SELECT map_id, n_nationkey AS id, c_custkey AS room_ord FROM (SELECT 0 AS map_id, c_nationkey AS n_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS k FROM customer) WHERE k = 1", map_id="long", id="long", room_ord="long")
def build_index_last_wins(spark, sf):
    repeated = grid.rooms(spark, sf).select(F.lit(0).alias("map_id"), F.col("area_id").alias("id"), F.lit(0).alias("area_ord"), "room_ord")
    return graph.indexed(repeated)


@query("SELECT e.map_id, src, dst, CASE WHEN e.weight > 0 THEN e.weight ELSE greatest(coalesce(r.weight, 1), 1) END AS w, key FROM exits e LEFT JOIN rooms r ON r.map_id = e.map_id AND r.id = e.dst", map_id="long", src="long", dst="long", key="string", w="double")
def neighbors_simple(spark, sf):
    return graph.neighbors(grid.exits(spark, sf), grid.rooms(spark, sf))


@query("SELECT map_id, src, dst, key, w, cls, lk FROM adj", map_id="long", src="long", dst="long", key="string", w="double", cls="long", lk="boolean")
def adjacency_router(spark, sf):
    return _adjacency(spark, sf)


@query("SELECT cls, count(*) AS n, sum(w) AS total_w FROM adj GROUP BY cls", cls="long", n="long", total_w="double")
def edge_weight(spark, sf):
    return _adjacency(spark, sf).groupBy("cls").agg(F.count("*").alias("n"), F.sum("w").alias("total_w"))


@query("SELECT map_id, src, dst, key FROM adj WHERE cls <= 0 AND NOT lk AND NOT dst_locked", map_id="long", src="long", dst="long", key="string")
def dir_mode_cardinal(spark, sf):
    return graph.walkable(_adjacency(spark, sf), "cardinal")


@query("SELECT map_id, src, dst, key FROM adj WHERE cls <= 1 AND NOT lk", map_id="long", src="long", dst="long", key="string")
def dir_mode_vertical_through_locked_rooms(spark, sf):
    return graph.walkable(_adjacency(spark, sf), "vertical", avoid_locked=False)


@query("SELECT map_id, src, dst, key FROM adj JOIN rooms r USING (map_id) WHERE r.id = adj.dst AND NOT lk AND r.weight <= 3", map_id="long", src="long", dst="long", key="string")
def locked_by_predicate(spark, sf):
    heavy = grid.rooms(spark, sf).select("map_id", F.col("id").alias("dst"), (F.col("weight") > 3).alias("heavy"))
    return graph.walkable(_adjacency(spark, sf).join(heavy, ["map_id", "dst"]), is_locked=F.col("heavy"))


@query("SELECT map_id, src_area, dst_area, min(w) AS min_w FROM adj WHERE src_area <> dst_area GROUP BY ALL", map_id="long", src_area="long", dst_area="long", min_w="double")
def area_min_weight(spark, sf):
    return graph.area_distances(_adjacency(spark, sf))


@query("SELECT map_id, greatest(max(sqrt(((dx-sx)*(dx-sx)+(dy-sy)*(dy-sy)+(dz-sz)*(dz-sz))::DOUBLE)), 1) AS max_edge, min(w) AS min_w FROM adj GROUP BY map_id", map_id="long", max_edge="double", min_w="double")
def astar_params(spark, sf):
    return graph.astar_scale(_adjacency(spark, sf))


@query("SELECT e.map_id, e.src, e.key, e.dst, EXISTS (SELECT 1 FROM exits b WHERE NOT b.special AND b.map_id = e.map_id AND b.src = e.dst AND b.dst = e.src AND b.key = i.opp) AS two_way FROM exits e LEFT JOIN idx i ON i.key = e.key WHERE NOT e.special", map_id="long", src="long", key="string", dst="long", two_way="boolean")
def one_way_exits(spark, sf):
    return graph.reciprocal(grid.exits(spark, sf))


@query("""SELECT l.map_id, l.room_id AS room_a, l.key, e.dst AS room_b FROM lines l JOIN exits e ON e.map_id = l.map_id AND e.src = l.room_id AND e.key = l.key AND NOT e.special JOIN idx i ON i.key = l.key AND i.idx <= 8
    JOIN exits b ON b.map_id = l.map_id AND b.src = e.dst AND b.dst = e.src AND b.key = i.opp AND NOT b.special JOIN rooms x ON x.map_id = l.map_id AND x.id = e.src JOIN rooms y ON y.map_id = l.map_id AND y.id = e.dst AND y.area_id = x.area_id AND y.z = x.z
    WHERE l.drawn AND NOT EXISTS (SELECT 1 FROM lines m WHERE m.map_id = l.map_id AND m.room_id = e.dst AND m.key = i.opp)""", map_id="long", room_a="long", key="string", room_b="long")  # fmt: skip
def suppressor_lint(spark, sf):
    return graph.missing_suppressors(grid.lines(spark, sf), grid.exits(spark, sf), grid.rooms(spark, sf))


# ---- routes ----

_COSTS = f"""SELECT map_id, source, id, cost FROM spread"""
_SPREAD = f"""walk AS ({_WALK}), spread(map_id, source, id, cost) USING KEY (map_id, source, id) AS (SELECT map_id, min(id), min(id), 0::DOUBLE FROM rooms GROUP BY map_id
  UNION SELECT s.map_id, s.source, w.dst, min(s.cost + w.w) FROM spread s JOIN walk w ON w.map_id = s.map_id AND w.src = s.id LEFT JOIN recurring.spread r ON r.map_id = s.map_id AND r.source = s.source AND r.id = w.dst WHERE r.cost IS NULL OR s.cost + w.w < r.cost GROUP BY s.map_id, s.source, w.dst)"""


@query(None, map_id="long", source="long", id="long", cost="double")
def shortest_path_cost(spark, sf):
    return routing.shortest(_walk(spark, sf), _firsts(spark, sf))


@query(None, map_id="long", source="long", id="long", cost="double")
def shortest_path_cost_by_rounds(spark, sf):
    """The way of large maps, over all of them."""
    return routing.shortest(_walk(spark, sf), _firsts(spark, sf), fits=0)


for _name in ("shortest_path_cost", "shortest_path_cost_by_rounds"):
    SQL[_name] = grid.SQL.rstrip() + ",\n" + _SPREAD + " SELECT map_id::BIGINT AS map_id, source::BIGINT AS source, id::BIGINT AS id, cost::DOUBLE AS cost FROM spread"


def _waypoints(spark, sf):
    """Each map's plan: rooms 1, 102, none, 203 and 304 of it."""
    base = _firsts(spark, sf)
    return base.select("map_id", F.lit(0).alias("plan"), F.posexplode(F.array(F.col("source"), F.col("source") + 101, F.lit(None).cast("long"), F.col("source") + 202, F.col("source") + 303)).alias("pos", "room"))


@query(None, map_id="long", plan="long", leg="long", source="long", target="long", cost="double", rooms="string")
def plan_route_legs(spark, sf):
    return routing.planned(_waypoints(spark, sf), _walk(spark, sf)).withColumn("rooms", F.array_join(F.col("path").cast("array<string>"), ","))


@query(None, map_id="long", plan="long", total_steps="long", complete="boolean")
def plan_route_totals(spark, sf):
    return routing.plan_totals(routing.planned(_waypoints(spark, sf), _walk(spark, sf)))


@query(None, map_id="long", plan="long", leg="long", special_steps="long")
def special_steps(spark, sf):
    return routing.special_steps(routing.planned(_waypoints(spark, sf), _walk(spark, sf)), grid.exits(spark, sf))


#: From legs (map_id, leg, source, target) and edges walk: costs, the least predecessor of each room, and the steps of each leg's path from its end.
_PATHS = """spread(map_id, source, id, cost) USING KEY (map_id, source, id) AS (SELECT DISTINCT map_id, source, source, 0::DOUBLE FROM leg WHERE target IS NOT NULL AND source IS NOT NULL
  UNION SELECT s.map_id, s.source, w.dst, min(s.cost + w.w) FROM spread s JOIN walk w ON w.map_id = s.map_id AND w.src = s.id LEFT JOIN recurring.spread r ON r.map_id = s.map_id AND r.source = s.source AND r.id = w.dst WHERE r.cost IS NULL OR s.cost + w.w < r.cost GROUP BY s.map_id, s.source, w.dst),
prev AS (SELECT b.map_id, b.source, b.id, min(w.src) AS previous FROM spread a JOIN walk w ON w.map_id = a.map_id AND w.src = a.id JOIN spread b ON b.map_id = a.map_id AND b.source = a.source AND b.id = w.dst AND a.cost + w.w = b.cost AND b.id <> b.source GROUP BY ALL),
back(map_id, leg, source, target, src, dst, k) AS (SELECT l.map_id, leg, l.source, target, previous, id, 1 FROM leg l JOIN prev p ON p.map_id = l.map_id AND p.source = l.source AND p.id = l.target
  UNION ALL SELECT b.map_id, leg, b.source, target, previous, b.src, k + 1 FROM back b JOIN prev p ON p.map_id = b.map_id AND p.source = b.source AND p.id = b.src)"""
_LEGS = f"""first AS (SELECT map_id, min(id) AS id FROM rooms GROUP BY map_id), point AS (SELECT map_id, pos, id + [0, 101, NULL, 202, 303][pos + 1] AS room FROM first, (SELECT unnest(range(5)) AS pos)),
leg AS (SELECT map_id, pos AS leg, room AS source, next AS target FROM (SELECT *, lead(room) OVER p AS next, lead(pos) OVER p AS more FROM point WINDOW p AS (PARTITION BY map_id ORDER BY pos)) WHERE more IS NOT NULL),
walk AS ({_WALK}), {_PATHS},
legs_found AS (SELECT l.*, s.cost, coalesce((SELECT max(k) FROM back b WHERE b.map_id = l.map_id AND b.leg = l.leg), CASE WHEN s.cost IS NOT NULL THEN 0 END) AS steps FROM leg l LEFT JOIN spread s ON s.map_id = l.map_id AND s.source = l.source AND s.id = l.target)"""
for _name, _select in {
    "plan_route_legs": """SELECT map_id::BIGINT AS map_id, 0::BIGINT AS plan, leg, source::BIGINT AS source, target::BIGINT AS target, cost,
  CASE WHEN cost IS NOT NULL THEN concat_ws(',', source, (SELECT string_agg(dst, ',' ORDER BY k DESC) FROM back b WHERE b.map_id = l.map_id AND b.leg = l.leg)) END AS rooms FROM legs_found l""",
    "plan_route_totals": "SELECT map_id::BIGINT AS map_id, 0::BIGINT AS plan, coalesce(sum(steps), 0)::BIGINT AS total_steps, bool_and(source IS NULL OR target IS NULL OR cost IS NOT NULL) AS complete FROM legs_found GROUP BY map_id",
    "special_steps": """SELECT b.map_id::BIGINT AS map_id, 0::BIGINT AS plan, leg, count(*) FILTER (only_special)::BIGINT AS special_steps FROM back b
  LEFT JOIN (SELECT map_id, src, dst, bool_and(special) AS only_special FROM exits GROUP BY ALL) e ON e.map_id = b.map_id AND e.src = b.src AND e.dst = b.dst GROUP BY b.map_id, leg""",
}.items():
    SQL[_name] = grid.SQL.rstrip() + ",\n" + _LEGS + "\n" + _select


@query(None, map_id="long", source="long", id="long", steps="long")
def k_hop_reach(spark, sf):
    return routing.reach(_walk(spark, sf), _firsts(spark, sf), 4)


SQL["k_hop_reach"] = grid.SQL.rstrip() + f""",
walk AS ({_WALK}), hop(map_id, source, id, steps) AS (SELECT map_id, min(id), min(id), 0 FROM rooms GROUP BY map_id UNION SELECT h.map_id, source, dst, steps + 1 FROM hop h JOIN walk w ON w.map_id = h.map_id AND w.src = h.id WHERE steps < 4)
SELECT map_id::BIGINT AS map_id, source::BIGINT AS source, id::BIGINT AS id, min(steps)::BIGINT AS steps FROM hop GROUP BY map_id, source, id"""

_RIDES = """SELECT line, src, dst, cost, time FROM (SELECT *, min(ok) OVER ride AS all_ok, sum(leg_time) OVER ride AS time, sum(leg_time) OVER ride * {ratio} + {penalty} AS cost FROM (
  SELECT f.line, f.pos AS begin, f.src, off, g.dst, CASE WHEN g.time > 0 THEN g.time ELSE 60 END AS leg_time, (g.src = coalesce(lag(g.dst) OVER (PARTITION BY f.line, f.pos ORDER BY off), f.src) AND g.dst <> f.src AND EXISTS (SELECT 1 FROM rooms r WHERE r.id = g.dst))::INT AS ok
  FROM (SELECT *, count(*) OVER (PARTITION BY line) AS n FROM legs) f, LATERAL (SELECT unnest(range(f.n)) AS off) o JOIN legs g ON g.line = f.line AND g.pos = (f.pos + off) % f.n WHERE EXISTS (SELECT 1 FROM rooms r WHERE r.id = f.src)) WINDOW ride AS (PARTITION BY line, begin ORDER BY off)) WHERE all_ok = 1"""


def _rides(spark, sf, mode):
    known = grid.rooms(spark, sf).select(F.lit(0).cast("long").alias("map_id"), "id")
    return transports.edges(grid.legs(spark, sf), known, mode)


@query(_RIDES.format(ratio=0.5, penalty=30), line="long", src="long", dst="long", cost="double", time="double")
def transport_edges(spark, sf):
    return _rides(spark, sf, "normal")


@query(_RIDES.format(ratio=0.1, penalty=10), line="long", src="long", dst="long", cost="double", time="double")
def transport_edges_aggressive(spark, sf):
    return _rides(spark, sf, "aggressive")


def _ridden(spark, sf):
    """Edges over all maps as one, on foot and by rides, whose hop is the line."""
    one = F.lit(0).cast("long").alias("map_id")
    rooms = grid.rooms(spark, sf).withColumn("map_id", one)
    return routing.with_rides(_walk(spark, sf).withColumn("map_id", one), _rides(spark, sf, "normal").withColumn("hop", F.col("line")), rooms)


_RIDDEN = f"SELECT 0 AS map_id, src, dst, w, NULL::BIGINT AS hop FROM adj WHERE NOT lk AND NOT dst_locked UNION ALL SELECT 0, src, dst, cost, line FROM ({_RIDES.format(ratio=0.5, penalty=30)}) t JOIN rooms r ON r.id = t.dst AND NOT r.locked"


@query(None, source="long", id="long", cost="double")
def route_transports(spark, sf):
    """Costs from the first room over all maps as one, on foot and by rides."""
    return routing.shortest(_ridden(spark, sf), spark.range(1).select(F.lit(0).alias("map_id"), F.lit(1).alias("source")))


SQL["route_transports"] = grid.SQL.rstrip() + f""",
leg AS (SELECT 0 AS map_id, 0 AS leg, 1::BIGINT AS source, 1::BIGINT AS target), walk AS ({_RIDDEN}), {_PATHS}
SELECT source, id::BIGINT AS id, cost FROM spread"""


@query(None, leg="long", step="long", src="long", dst="long", w="double", hop="long")
def route_hops(spark, sf):
    """The steps of three legs, each on foot or by a line."""
    points = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 78), (0, 0, 2, 140), (0, 0, 3, 15)], "map_id long, plan long, pos long, room long")
    edges = routing.checkpointed(_ridden(spark, sf))
    return routing.hops(routing.planned(points, edges), edges, ["leg"])


SQL["route_hops"] = grid.SQL.rstrip() + f""",
leg AS (SELECT 0 AS map_id, * FROM (VALUES (0, 1::BIGINT, 78::BIGINT), (1, 78, 140), (2, 140, 15)) AS x(leg, source, target)), walk AS ({_RIDDEN}), {_PATHS},
best AS (SELECT src, dst, min(w) AS w, min(hop) AS hop, bool_or(hop IS NULL) AS foot FROM walk JOIN (SELECT src, dst, min(w) AS w FROM walk GROUP BY ALL) USING (src, dst, w) GROUP BY src, dst)
SELECT leg::BIGINT AS leg, (max(k) OVER (PARTITION BY leg) - k)::BIGINT AS step, src, dst, w, CASE WHEN NOT foot THEN hop END::BIGINT AS hop FROM back JOIN best USING (src, dst)"""


# ---- search ----


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 25", id="long")
def search_substring(spark, sf):
    return search.rooms_like(grid.corpus(spark, sf), "The")


@query("SELECT doc_id AS id, source AS area, CASE WHEN contains(lower(text), 'that') THEN 2 ELSE 1 END + CASE WHEN contains(lower(text), 'src1') THEN 2 ELSE 1 END AS score FROM documents WHERE (contains(lower(text), 'that') OR contains(lower(source), 'that')) AND (contains(lower(text), 'src1') OR contains(lower(source), 'src1'))", id="long", area="string", score="long")
def search_scored(spark, sf):
    return search.scored(grid.corpus(spark, sf), "that  SRC1", limit=None)


@query("SELECT token, kind, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS token, 'n' AS kind FROM documents UNION ALL SELECT DISTINCT doc_id, unnest(string_split_regex(lower(source), '\\s+')), 'a' FROM documents) WHERE token <> '' GROUP BY ALL", token="string", kind="string", n="long")
def token_index(spark, sf):
    return search.tokens(grid.corpus(spark, sf)).groupBy("token", "kind").agg(F.count("*").alias("n"))


# ---- rules ----


@query("SELECT id FROM (SELECT c_nationkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k > 1", id="long")
def validate_duplicates(spark, sf):
    return rules.repeats(grid.rooms(spark, sf).withColumn("id", F.col("area_id")), ["id"], ["room_ord"])


@query("SELECT e.map_id, e.src, e.key, e.dst FROM exits e WHERE NOT EXISTS (SELECT 1 FROM rooms r WHERE r.map_id = e.map_id AND r.id = e.dst)", map_id="long", src="long", key="string", dst="long")
def validate_dangling(spark, sf):
    return rules.dangling(grid.exits(spark, sf), grid.rooms(spark, sf))


def _broken(source: str, *rules: tuple[str, str, str]) -> str:
    """SQL of the rules (condition, path, code) over a source."""
    return "SELECT map_id, r.path, r.code FROM (SELECT map_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {on} THEN {{'path': {path}, 'code': '{code}'}} END" for on, path, code in rules) + f"], lambda r: r IS NOT NULL)) AS r FROM {source})"


_RULED = dict(map_id="long", path="string", code="string")
_ROOM = "(SELECT 0 AS map_id, c_custkey AS k, CASE WHEN k % 50 > 0 THEN k END AS id, 'rooms[' || coalesce(id::VARCHAR, '?') || '].' AS here FROM customer)"


@query(_broken(_ROOM, ("id IS NULL", "here || 'id'", "MUST_BE_INTEGER"), ("k % 41 = 0", "here || 'y'", "MUST_BE_INTEGER"), ("k % 31 = 0", "here || 'env'", "MUST_BE_INTEGER"), ("k % 9 = 0", "here || 'weight'", "MUST_BE_POSITIVE_INTEGER"), ("k % 7 = 0", "here || 'stubs'", "DUPLICATE_DIRECTION"), ("k % 8 = 0", "here || 'stubs'", "INVALID_DIRECTION"),
    ("k % 12 = 0", "here || 'exit_locks'", "DUPLICATE_DIRECTION"), ("k % 17 = 0", "here || 'tags'", "ELEMENTS_MUST_BE_STRINGS"), ("k % 19 = 0", "here || 'user_data'", "USER_DATA_STRING_DICT"), ("k % 4 = 0 AND k % 5 <> 0", "here || 'special_exit_locks'", "NOT_IN_SPECIAL_EXITS")), **_RULED)
def validate_rooms(spark, sf):
    return rules.room_rules(grid.faulty_rooms(spark, sf))


@query(_broken(f"(SELECT * FROM {_ROOM} WHERE id IS NOT NULL)", ("k % 13 = 0", "here || 'exits.n'", "TARGET_MUST_BE_INTEGER"), ("k % 14 = 0", "here || 'exits.sideways'", "INVALID_DIRECTION"), ("k % 23 = 0", "here || 'special_exits. '", "SPECIAL_EXIT_CMD_NONEMPTY"), ("k % 29 = 0", "here || 'special_exits.n'", "SPECIAL_EXIT_OVERLAPS_EXIT"),
    ("k % 3 = 0", "here || 'exit_weights.n'", "MUST_BE_POSITIVE_INTEGER"), ("k % 10 = 0", "here || 'exit_weights.w'", "NOT_IN_EXITS"), ("k % 10 = 0", "here || 'exit_weights.w'", "MUST_BE_POSITIVE_INTEGER"), ("k % 15 = 0", "here || 'doors.n'", "INVALID_DOOR_VALUE"),
    *((f"k % 2 = 0 AND {on}", "here || 'custom_lines.' || CASE WHEN k % 4 = 0 THEN 'n' ELSE 's' END", code) for on, code in (("k % 3 = 0", "MUST_BE_ARRAY"), ("k % 3 > 0 AND k % 5 = 0", "MUST_BE_COORD_PAIR"), ("k % 300 > 255", "MUST_BE_RGB"), ("k % 11 = 0", "INVALID_CL_STYLE"), ("k % 4 > 0", "KEY_NOT_IN_EXITS")))), **_RULED)
def validate_entries(spark, sf):
    return rules.entry_rules(grid.faulty_rooms(spark, sf).filter("id is not null"))


@query(_broken("(SELECT 0 AS map_id, p_partkey AS k, 'labels[' || coalesce(CASE WHEN k % 50 > 0 THEN k END::VARCHAR, '?') || '].' AS here FROM part)", ("k % 50 = 0", "here || 'id'", "MUST_BE_INTEGER"), ("k % 11 = 0", "here || 'z'", "MUST_BE_INTEGER"), ("k % 7 = 0", "here || 'x'", "MUST_BE_NUMBER"), ("k % 9 = 0", "here || 'y'", "MUST_BE_NUMBER"), ("k % 12 = 0", "here || 'height'", "MUST_BE_NUMBER"),
    ("k % 13 = 0", "here || 'text'", "MUST_BE_STRING"), ("k % 300 > 255", "here || 'fg_color'", "MUST_BE_RGB"), ("k % 5 = 0", "here || 'bg_color'", "MUST_BE_RGB"), ("k % 8 = 0", "here || 'pixmap'", "MUST_BE_BASE64")), **_RULED)
def validate_labels(spark, sf):
    return rules.label_rules(grid.faulty_labels(spark, sf))


@query(_broken("(SELECT 0 AS map_id, n_nationkey AS k, 'areas[' || coalesce(CASE WHEN k % 6 > 0 THEN k END::VARCHAR, '?') || '].' AS here FROM nation)", ("k % 6 = 0", "here || 'id'", "MUST_BE_INTEGER"), ("k % 5 = 0", "here || 'name'", "MUST_BE_STRING"), ("k % 4 <= 1", "here || 'pos'", "MUST_BE_POS3"), ("k % 9 = 0", "here || 'user_data'", "USER_DATA_STRING_DICT")), **_RULED)
def validate_areas(spark, sf):
    return rules.area_rules(grid.faulty_areas(spark, sf))


@query(_broken("(SELECT s_suppkey AS map_id, s_suppkey AS k FROM supplier)", ("k % 19 = 0", "'format'", "INVALID_FORMAT"), ("k % 18 = 0", "'format_version'", "INVALID_FORMAT_VERSION"), ("k % 14 = 0", "'meta'", "REQUIRED"), ("k % 15 = 0", "'colors'", "REQUIRED"), ("k % 20 = 0", "'areas'", "MUST_BE_ARRAY"),
    *((f"k % 14 > 0 AND {on}", f"'meta.{f}'", code) for on, f, code in [("k % 3 = 0", "map_name", "MUST_BE_STRING"), ("k % 4 = 0", "symbol_font", "REQUIRED"), ("k % 12 = 0", "symbol_font_fudge_factor", "MUST_BE_NUMBER"), ("k % 13 = 0", "use_only_map_font", "MUST_BE_BOOLEAN"), ("k % 16 = 0", "room_id_hash", "MUST_BE_INTEGER"), ("k % 17 = 0", "user_data", "USER_DATA_STRING_DICT"),
      *((f"k % 4 > 0 AND k % {n} = 0", f"symbol_font.{f}", code) for n, f, code in ((5, "family", "MUST_BE_STRING"), (6, "pixel_size", "MUST_BE_NUMBER"), (7, "weight", "MUST_BE_INTEGER"), (8, "style_setting", "MUST_BE_BOOLEAN"), (9, "underline", "MUST_BE_BOOLEAN"), (10, "strike_out", "MUST_BE_BOOLEAN"), (11, "fixed_pitch", "MUST_BE_BOOLEAN")))]),
    ("k % 15 > 0 AND k * 10 > 255", "'colors.env_colors.1'", "MUST_BE_BYTE"), ("k % 15 > 0 AND k % 2 = 0", "'colors.custom_env_colors.2'", "MUST_BE_RGBA")), **_RULED)
def validate_documents(spark, sf):
    docs = grid.faulty_documents(spark, sf)
    return rules.document_rules(docs, "lanes").unionByName(rules.meta_rules(docs)).unionByName(rules.color_rules(docs))


# ---- diff ----


@query("SELECT (SELECT count(*) FROM o0) AS n_before, (SELECT count(*) FROM o1) AS n_after, (SELECT count(*) FROM o0 JOIN o1 USING (id)) AS n_both, (SELECT count(*) FROM o0 JOIN o1 USING (id)) / greatest((SELECT count(*) FROM o0), (SELECT count(*) FROM o1)) AS overlap", n_before="long", n_after="long", n_both="long", overlap="double")
def diff_overlap(spark, sf):
    return diff.overlap(grid.snapshot(spark, sf, False), grid.snapshot(spark, sf, True), ["map_id", "id"])


def _both(spark, sf, table=grid.snapshot):
    return table(spark, sf, False), table(spark, sf, True)


def _ops(spark, sf):
    return diff.room_ops(*_both(spark, sf))


@query("SELECT id, type FROM ops", id="long", type="string")
def diff_rooms(spark, sf):
    return _ops(spark, sf)


@query("SELECT type, count(*) AS n FROM ops GROUP BY type", type="string", n="long")
def diff_stats(spark, sf):
    return diff.stats(_ops(spark, sf))


@query("SELECT env_before, env_after, symbol_before, symbol_after, count(*) AS n_rooms, min(id) AS first_room, max(id) AS last_room FROM ops WHERE type = 'PAINT_BATCH' GROUP BY ALL", env_before="long", env_after="long", symbol_before="string", symbol_after="string", n_rooms="long", first_room="long", last_room="long")
def diff_paint_groups(spark, sf):
    return diff.paint_groups(_ops(spark, sf))


@query("SELECT id, type, row_number() OVER (ORDER BY CASE type WHEN 'ADD_ROOM' THEN 1 WHEN 'MOVE_ROOM_TO_AREA' THEN 2 WHEN 'DELETE_ROOM' THEN 3 WHEN 'MOVE_ROOM' THEN 4 WHEN 'EDIT_ROOM' THEN 5 WHEN 'EDIT_EXIT' THEN 6 ELSE 7 END, id) AS seq FROM ops", id="long", type="string", seq="long")
def diff_ordered(spark, sf):
    return diff.ordered(_ops(spark, sf), ["id"])


@query("SELECT env_before, env_after, symbol_before, symbol_after, id FROM ops WHERE type = 'PAINT_BATCH'", env_before="long", env_after="long", symbol_before="string", symbol_after="string", id="long")
def diff_paint_changes(spark, sf):
    return diff.paint_changes(_ops(spark, sf))


@query("SELECT id, key, unnest(list_filter([CASE WHEN d0 IS NOT NULL THEN 'DELETE_EXIT' END, CASE WHEN d1 IS NOT NULL THEN 'ADD_EXIT' END], lambda t: t IS NOT NULL)) AS type, d0, d1 FROM (SELECT id, ['n', 'e', 's', 'w'][i] AS key, to0[i] AS d0, to1[i] AS d1 FROM flags, (SELECT unnest(range(1, 5)) AS i) WHERE NOT fresh AND NOT gone AND NOT edited AND exits AND NOT doors) WHERE d0 IS DISTINCT FROM d1", id="long", key="string", type="string", d0="long", d1="long")
def diff_exits(spark, sf):
    return diff.exit_ops(*_both(spark, sf)).withColumnsRenamed({"dst_before": "d0", "dst_after": "d1"})


@query("SELECT id, key, CASE WHEN a IS NULL THEN 'ADD_CL' WHEN b IS NULL THEN 'DELETE_CL' ELSE 'EDIT_CL' END AS type, coalesce(b, a) = 0 AS suppressor FROM (SELECT id, ['n', 'e'][i] AS key, line0[i] AS a, line1[i] AS b FROM flags, (SELECT unnest(range(1, 3)) AS i) WHERE NOT fresh AND NOT gone AND NOT edited AND NOT exits AND NOT doors) WHERE a IS DISTINCT FROM b", id="long", key="string", type="string", suppressor="boolean")
def diff_lines(spark, sf):
    return diff.line_ops(*_both(spark, sf))


@query("""WITH go AS (SELECT id, to_area, x0, x1, y1 FROM flags WHERE NOT fresh AND NOT gone AND NOT edited AND place), stay AS (SELECT area_id, x, y FROM o1 WHERE id NOT IN (SELECT id FROM go))
    SELECT id, CASE WHEN forced THEN 'EDIT_ROOM' ELSE 'MOVE_ROOM' END AS type, (NOT forced AND waits)::INT AS wave FROM (SELECT g.id, EXISTS (SELECT 1 FROM stay s WHERE s.area_id = g.to_area AND s.x = g.x1 AND s.y = g.y1) OR EXISTS (SELECT 1 FROM go o WHERE o.id < g.id AND o.to_area = g.to_area AND o.x1 = g.x1 AND o.y1 = g.y1) AS forced,
    EXISTS (SELECT 1 FROM go o WHERE o.to_area = g.to_area AND o.x0 = g.x1 AND o.y1 = g.y1) AS waits FROM go g)""", id="long", type="string", wave="long")  # fmt: skip
def diff_moves(spark, sf):
    return diff.moves(*_both(spark, sf))


@query("SELECT coalesce(a.k, b.k) AS id, CASE WHEN a.k IS NULL THEN 'ADD_AREA' WHEN b.k IS NULL THEN 'DELETE_AREA' ELSE 'EDIT_AREA' END AS type FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 10 <> 0) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 10 <> 1) b USING (k) WHERE a.k IS NULL OR b.k IS NULL OR k % 7 = 0 OR k % 11 = 0", id="long", type="string")
def diff_areas(spark, sf):
    return diff.area_ops(*_both(spark, sf, grid.areas))


@query("SELECT s_suppkey AS env, 'EDIT_ENV_COLOR' AS type FROM supplier WHERE s_suppkey % 10 <= 1 OR (s_suppkey % 5 = 0 AND s_suppkey % 256 <> 255 - s_suppkey % 256)", env="long", type="string")
def diff_colors(spark, sf):
    return diff.color_ops(*_both(spark, sf, grid.colors))


@query("SELECT p_partkey AS id, p_partkey % 25 AS area_id, CASE WHEN p_partkey % 10 = 0 THEN 'ADD_LABEL' WHEN p_partkey % 10 = 1 THEN 'DELETE_LABEL' WHEN p_partkey % 13 = 0 THEN 'EDIT_LABEL' WHEN p_partkey % 6 = 0 THEN 'RESIZE_LABEL' WHEN p_partkey % 5 = 0 THEN 'MOVE_LABEL' END AS type FROM part WHERE type IS NOT NULL", id="long", area_id="long", type="string")
def diff_labels(spark, sf):
    return diff.label_ops(*_both(spark, sf, grid.labels))


@query("""SELECT id, list_filter([CASE WHEN a.area_id <> b.area_id THEN 'area_id' END, CASE WHEN a.x <> b.x THEN 'x' END, CASE WHEN a.z IS DISTINCT FROM b.z THEN 'z' END, CASE WHEN a.env <> b.env THEN 'env' END, CASE WHEN a.name <> b.name THEN 'name' END, CASE WHEN a.notes <> b.notes THEN 'notes' END,
    CASE WHEN a.n <> b.n OR a.e IS DISTINCT FROM b.e OR raw_w <> b.door_w OR b.s IS NOT NULL THEN 'exits' END, CASE WHEN a.door_n IS DISTINCT FROM b.door_n OR raw_w <> b.door_w THEN 'doors' END, CASE WHEN a.line_n IS DISTINCT FROM b.line_n OR b.line_e IS NOT NULL THEN 'custom_lines' END], lambda f: f IS NOT NULL) AS f, array_to_string(list_sort(f), ',') AS fields FROM o0 a JOIN o1 b USING (id) WHERE len(f) > 0""", id="long", fields="string")  # fmt: skip
def canonical_changed_fields(spark, sf):
    found = canonical.changed_rooms(grid.snapshot(spark, sf, False), grid.snapshot(spark, sf, True))
    return found.select("id", F.array_join(F.array_sort("fields"), ",").alias("fields"))


# ---- operation logs ----

_CHAINS = """chained AS (SELECT *, sum(opens) OVER (PARTITION BY log_id, key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, (type = 'add' OR coalesce(lag(type) OVER (PARTITION BY log_id, key ORDER BY seq) = 'delete', false))::INT AS opens FROM log)),
folded AS (SELECT *, CASE WHEN first_type = 'add' THEN 'add' ELSE last_type END AS type FROM (SELECT log_id, key, session, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, arg_min(type, seq) AS first_type, arg_max(type, seq) AS last_type, arg_min(before, seq) AS before, arg_max(after, seq) AS after FROM chained GROUP BY ALL)
  WHERE NOT (first_type = 'add' AND last_type = 'delete') AND NOT (first_type = 'edit' AND last_type = 'edit' AND before = after))"""


def _chain_sql(name: str, sql: str) -> None:
    SQL[name] = grid.SQL.rstrip() + ",\n" + _CHAINS + "\n" + sql


@query(None, log_id="long", key="long", session="long", first_seq="long", last_seq="long", n="long", type="string", before="long", after="long")
def op_chain_fold(spark, sf):
    return oplog.folded(grid.log(spark, sf))


_chain_sql("op_chain_fold", "SELECT log_id::BIGINT AS log_id, key::BIGINT AS key, session::BIGINT AS session, first_seq, last_seq, n, type, before::BIGINT AS before, after::BIGINT AS after FROM folded")


@query(None, log_id="long", key="long", seq="long")
def op_renumber(spark, sf):
    return oplog.renumbered(oplog.folded(grid.log(spark, sf)))


_chain_sql("op_renumber", "SELECT log_id::BIGINT AS log_id, key::BIGINT AS key, row_number() OVER (PARTITION BY log_id ORDER BY first_seq, key)::BIGINT AS seq FROM folded")


@query("SELECT log_id, key, seq, 'd:' || row_number() OVER (PARTITION BY log_id ORDER BY seq) AS sid FROM log WHERE type = 'add'", log_id="long", key="long", seq="long", sid="string")
def op_symbolic_ids(spark, sf):
    return oplog.symbolic(grid.log(spark, sf))


@query("""SELECT log_id, key, seq, type, (SELECT arg_max(a.sid, a.seq) FROM (SELECT s.*, (SELECT min(d.seq) FROM log d WHERE d.type = 'delete' AND d.log_id = s.log_id AND d.key = s.key AND d.seq > s.seq) AS gone FROM (SELECT log_id, key, seq, 'd:' || row_number() OVER (PARTITION BY log_id ORDER BY seq) AS sid FROM log WHERE type = 'add') s) a
    WHERE a.log_id = l.log_id AND a.key = l.key AND a.seq <= l.seq AND (a.gone IS NULL OR l.seq <= a.gone)) AS sid FROM log l""", log_id="long", key="long", seq="long", type="string", sid="string")  # fmt: skip
def op_references(spark, sf):
    return oplog.references(grid.log(spark, sf))


@query("SELECT log_id, seq, expected FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY seq) AS expected FROM log) WHERE seq <> expected", log_id="long", seq="long", expected="long")
def op_sequence_errors(spark, sf):
    return oplog.sequence_errors(grid.log(spark, sf).withColumn("pos", F.col("seq")))


def _last_ops(spark, sf):
    last = Window.partitionBy("log_id", "key").orderBy(F.desc("last_seq"))
    return oplog.folded(grid.log(spark, sf)).withColumn("k", F.row_number().over(last)).filter("k = 1").withColumnRenamed("last_seq", "seq")


def _base(spark, sf):
    return grid.log(spark, sf).filter("key % 2 = 0").select(F.col("log_id").alias("map_id"), F.col("key").alias("id"), F.lit(99).cast("long").alias("state")).distinct()


_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id, key ORDER BY last_seq DESC) AS k FROM folded) WHERE k = 1), base AS (SELECT DISTINCT log_id, key, 99 AS state FROM log WHERE key % 2 = 0)"


@query(None, map_id="long", id="long", state="long")
def op_apply(spark, sf):
    return oplog.applied(_base(spark, sf), _last_ops(spark, sf))


SQL["op_apply"] = grid.SQL.rstrip() + ",\n" + _CHAINS + ",\n" + _LAST + "\nSELECT log_id::BIGINT AS map_id, key::BIGINT AS id, CASE WHEN type IS NULL OR (type = 'add' AND state IS NOT NULL) THEN state ELSE after END::BIGINT AS state FROM base FULL JOIN last USING (log_id, key) WHERE CASE WHEN state IS NULL THEN type = 'add' ELSE type IS NULL OR type <> 'delete' END"


@query(None, map_id="long", id="long", seq="long", code="string")
def op_apply_skipped(spark, sf):
    return oplog.skipped(_base(spark, sf), _last_ops(spark, sf))


SQL["op_apply_skipped"] = grid.SQL.rstrip() + ",\n" + _CHAINS + ",\n" + _LAST + "\nSELECT log_id::BIGINT AS map_id, key::BIGINT AS id, last_seq AS seq, CASE WHEN type <> 'add' AND state IS NULL THEN 'ROOM_MISSING' WHEN type = 'add' AND state IS NOT NULL THEN 'ROOM_EXISTS' END AS code FROM last LEFT JOIN base USING (log_id, key) WHERE (type <> 'add' AND state IS NULL) OR (type = 'add' AND state IS NOT NULL)"


# ---- deltas on maps ----


@functools.lru_cache(maxsize=4)
def _applied(application: str, spark: SparkSession, sf: str, table: str | None) -> apply.State:
    """The state that the delta leaves; its tables are checkpointed, and queries of tables that need all operations share them."""
    return apply.applied(grid.delta_state(spark, sf), grid.delta_ops(spark, sf), table=table)


def _delta_query(table: str, sql: str, **kinds: str):
    """Registers the query of one table of the state that a delta leaves."""

    @query(None, **kinds)
    def run(spark, sf):
        state = _applied(spark.sparkContext.applicationId, spark, sf, table if table in (*apply.NEEDED, "skipped") else None)
        return apply.skipped(state) if table == "skipped" else getattr(state, table)

    QUERIES[f"delta_{table}"] = QUERIES.pop("run")
    names = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    SQL[f"delta_{table}"] = grid.SQL.rstrip() + grid.DELTA_SQL.rstrip() + ", result AS (" + sql + ") SELECT " + ", ".join(f"{c}::{names[k]} AS {c}" for c, k in kinds.items()) + " FROM result"


_delta_query("rooms", "SELECT * FROM r6", id="long", area_id="long", x="long", y="long", env="long", symbol="string", name="string")
_delta_query("exits", "SELECT * FROM x5", src="long", key="string", dst="long", special="boolean")
_delta_query("lines", "SELECT * FROM l7", room_id="long", key="string", line="string")
_delta_query("labels", "SELECT * FROM b2", area_id="long", id="long", x="double", y="double")
_delta_query("areas", "SELECT * FROM areas2", id="long", name="string")
_delta_query("skipped", "SELECT e + 1 AS seq, code FROM skips", seq="long", code="string")


# ---- integrity ----


@query("SELECT id, CASE WHEN a.name IS NULL THEN 'missing' WHEN b.name IS NULL THEN 'extra' ELSE 'bad' END AS verdict FROM o0 a FULL JOIN o1 b USING (id) WHERE a.name IS DISTINCT FROM b.name", id="long", verdict="string")
def verify_full_outer(spark, sf):
    side = lambda new: grid.snapshot(spark, sf, new).select("id", F.md5("name").alias("hash"))
    return integrity.verified(side(False), side(True), ["id"])


@query("SELECT map_id, area_id, count(*) AS n, md5(array_to_string(list(md5(name) ORDER BY id), '')) AS hash FROM rooms GROUP BY ALL", map_id="long", area_id="long", n="long", hash="string")
def hash_rollup_md5(spark, sf):
    return integrity.rollup_md5(grid.rooms(spark, sf), ["map_id", "area_id"], "id", "name")


@query(None, id="long", hash="string")
def xxh3_names(spark, sf):
    return grid.rooms(spark, sf).select("id", codes.xxh3_hex("name").alias("hash"))


@query(None, map_id="long", code="string", error="string", n_ids="long")
def route_codes(spark, sf):
    code = codes.encode_route(F.array(F.col("source"), F.col("source") + 7, F.col("source") + 90), F.lit("astar"), F.lit("all"), F.lit("normal"), "way")
    return _firsts(spark, sf).select("map_id", code.alias("code")).withColumn("d", codes.decode_route(F.col("code"), "way")).select("map_id", "code", "d.error", F.size("d.ids").alias("n_ids"))


@query("SELECT k AS n, CASE WHEN k = 1 THEN 'one' WHEN k % 10 BETWEEN 2 AND 4 AND NOT k % 100 BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS pl, CASE WHEN k = 1 THEN 'one' ELSE 'many' END AS en FROM (SELECT c_custkey AS k FROM customer)", n="long", pl="string", en="string")
def plural_messages(spark, sf):
    n = F.col("c_custkey")
    return grid.table(spark, sf, "customer").select(n.alias("n"), codes.plural_form(n, "pl").alias("pl"), codes.plural_form(n, "en").alias("en"))


# ---- display ----

_PALETTE = "pal AS (SELECT i, CASE WHEN i < 16 THEN [[0,0,0],[128,0,0],[0,128,0],[128,128,0],[0,0,128],[128,0,128],[0,128,128],[192,192,192],[128,128,128],[255,0,0],[0,255,0],[255,255,0],[0,0,255],[255,0,255],[0,255,255],[255,255,255]][i + 1] WHEN i < 232 THEN list_transform([(i - 16) // 36, (i - 16) // 6 % 6, (i - 16) % 6], lambda v: CASE WHEN v = 0 THEN 0 ELSE 55 + 40 * v END) ELSE [8 + (i - 232) * 10, 8 + (i - 232) * 10, 8 + (i - 232) * 10] END AS rgb FROM (SELECT unnest(range(256)) AS i))"


def _colored(spark, sf):
    ansi = spark.createDataFrame([(e, (e * 3) % 256) for e in range(0, 300, 2)], "env long, ansi int")
    own = spark.createDataFrame([(e, [e % 256, 10, 20]) for e in range(257, 262, 2)], "env long, rgb array<int>")
    return display.colored(grid.rooms(spark, sf), ansi, own)


@query(None, id="long", r="long", g="long", b="long", ink="string")
def env_color_cascade(spark, sf):
    rgb = F.col("rgb")
    return _colored(spark, sf).select("id", rgb[0].alias("r"), rgb[1].alias("g"), rgb[2].alias("b"), display.contrast(rgb).alias("ink"))


SQL["env_color_cascade"] = grid.SQL.rstrip() + ",\n" + _PALETTE + """,
std AS (SELECT e AS env, rgb FROM (SELECT unnest(range(1, 256)) AS e) JOIN pal ON pal.i = CASE e WHEN 8 THEN 0 WHEN 16 THEN 8 ELSE e END),
c AS (SELECT r.id, coalesce(CASE WHEN r.env IN (257, 259, 261) THEN [r.env % 256, 10, 20] END, a.rgb, s.rgb, [114, 1, 0]) AS rgb FROM rooms r LEFT JOIN std a ON r.env % 2 = 0 AND r.env < 300 AND a.env = r.env * 3 % 256 LEFT JOIN std s ON s.env = r.env)
SELECT id::BIGINT AS id, rgb[1]::BIGINT AS r, rgb[2]::BIGINT AS g, rgb[3]::BIGINT AS b, CASE WHEN rgb[1] * 0.299::DOUBLE + rgb[2] * 0.587::DOUBLE + rgb[3] * 0.114::DOUBLE > 140 THEN '#111' ELSE '#fff' END AS ink FROM c"""


def _kinds(spark, sf):
    return display.exit_kinds(grid.exits(spark, sf), grid.rooms(spark, sf), grid.lines(spark, sf))


_KINDS = """SELECT e.map_id, e.src, e.key, e.dst, CASE WHEN l.drawn THEN 'custom' WHEN NOT l.drawn THEN 'suppressed' WHEN i.idx IS NULL THEN 'skip' WHEN i.idx > 8 THEN 'udio' WHEN y.id IS NULL OR y.area_id <> x.area_id THEN 'cross' WHEN y.z <> x.z THEN 'crossZ'
    WHEN NOT EXISTS (SELECT 1 FROM exits b WHERE NOT b.special AND b.map_id = e.map_id AND b.src = e.dst AND b.dst = e.src AND b.key = i.opp) THEN 'oneway' ELSE 'line' END AS kind FROM exits e LEFT JOIN lines l ON l.map_id = e.map_id AND l.room_id = e.src AND l.key = e.key LEFT JOIN idx i ON i.key = e.key
    JOIN rooms x ON x.map_id = e.map_id AND x.id = e.src LEFT JOIN rooms y ON y.map_id = e.map_id AND y.id = e.dst WHERE NOT e.special"""


@query(_KINDS, map_id="long", src="long", key="string", dst="long", kind="string")
def classify_exit(spark, sf):
    return _kinds(spark, sf)


@query("SELECT map_id, area_id, CASE WHEN px >= 9 OR least(n, 500) <= 200 THEN 'full' WHEN px < 3 THEN 'raster' ELSE 'roomsOnly' END AS lod FROM (SELECT map_id, area_id, count(*) * 40 AS n, count(*) % 12 AS px FROM rooms GROUP BY ALL)", map_id="long", area_id="long", lod="string")
def lod_mode(spark, sf):
    n = grid.rooms(spark, sf).groupBy("map_id", "area_id").agg((F.count("*") * 40).alias("n"), (F.count("*") % 12).alias("px"))
    return n.select("map_id", "area_id", display.level_of_detail(F.col("px"), F.col("n"), F.lit(500)).alias("lod"))


_BOX = "SELECT {by}, min(x) AS min_x, max(x) AS max_x, min(-y) AS min_y, max(-y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(DISTINCT z) AS n_levels, count(*) AS n_rooms FROM rooms GROUP BY ALL"
_BOX_KINDS = dict.fromkeys(["min_x", "max_x", "min_y", "max_y", "min_z", "max_z", "n_levels", "n_rooms"], "long")


@query(_BOX.format(by="map_id, area_id"), map_id="long", area_id="long", **_BOX_KINDS)
def area_bbox(spark, sf):
    return display.bounds(grid.rooms(spark, sf), ["map_id", "area_id"])


@query(_BOX.format(by="map_id, area_id, z"), map_id="long", area_id="long", z="long", **_BOX_KINDS)
def area_z_bbox(spark, sf):
    return display.bounds(grid.rooms(spark, sf), ["map_id", "area_id", "z"])


@query("SELECT e.map_id, x.area_id AS src_area, e.src, y.area_id AS dst_area, e.dst, CASE WHEN special THEN 13 ELSE idx END AS code FROM exits e LEFT JOIN idx USING (key) JOIN rooms x ON x.map_id = e.map_id AND x.id = e.src JOIN rooms y ON y.map_id = e.map_id AND y.id = e.dst WHERE x.area_id <> y.area_id", map_id="long", src_area="long", src="long", dst_area="long", dst="long", code="long")
def inter_area_exits(spark, sf):
    return display.cross_area_exits(grid.exits(spark, sf), grid.rooms(spark, sf))


@query(f"""WITH kinds AS ({_KINDS}) SELECT map_id, area_id, z, x, y, max(layer) AS layer, arg_max(red, layer * 1000000000000 + nth) AS red FROM (SELECT map_id, area_id, z, x, y, 2 AS layer, room_ord AS nth, env % 256 AS red FROM rooms UNION ALL
    SELECT map_id, area_id, z, CAST(x0 + floor((2 * i * (x1 - x0) + n) / greatest(2 * n, 1)) AS BIGINT), CAST(y0 + floor((2 * i * (y1 - y0) + n) / greatest(2 * n, 1)) AS BIGINT), 1, 0, 225 FROM (SELECT *, unnest(range(n + 1)) AS i FROM (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM (
    SELECT DISTINCT e.map_id, a.area_id, a.z, CASE WHEN e.src < e.dst THEN a.x ELSE b.x END AS x0, CASE WHEN e.src < e.dst THEN a.y ELSE b.y END AS y0, CASE WHEN e.src < e.dst THEN b.x ELSE a.x END AS x1, CASE WHEN e.src < e.dst THEN b.y ELSE a.y END AS y1
    FROM kinds e JOIN rooms a ON a.map_id = e.map_id AND a.id = e.src JOIN rooms b ON b.map_id = e.map_id AND b.id = e.dst WHERE kind IN ('line', 'oneway'))))) GROUP BY ALL""", map_id="long", area_id="long", z="long", x="long", y="long", layer="long", red="long")  # fmt: skip
def raster_cells(spark, sf):
    return display.raster_cells(_tinted(spark, sf), _kinds(spark, sf)).withColumn("red", F.col("rgb")[0])


@query("SELECT map_id, id FROM rooms WHERE area_id = 7 AND z = 0", map_id="long", id="long")
def plane_rooms(spark, sf):
    return display.plane(grid.rooms(spark, sf), 7, 0)


@query("SELECT c_custkey AS id, '#' || lpad(lower(hex(c_custkey % 256)), 2, '0') || '0aff' AS color, c_custkey % 256 AS r, 255 AS b FROM customer", id="long", color="string", r="long", b="long")
def hex_colors(spark, sf):
    k = F.col("c_custkey")
    hexed = grid.table(spark, sf, "customer").select(k.alias("id"), codes.rgb_to_hex(F.array(k % 256, F.lit(10).cast("long"), F.lit(300).cast("long"))).alias("color"))
    rgb = codes.hex_to_rgb(F.col("color"))
    return hexed.select("id", "color", rgb[0].alias("r"), rgb[2].alias("b"))


# ---- geometry ----

_AT = geometry.Scale(30)
_STEPS = "st(key, dx, dy) AS (VALUES " + ", ".join(f"('{d[0]}', {d[3]}e0, {0 - d[4]}e0)" for d in DIRECTIONS) + ")"
_ENDS = "kinds k JOIN st USING (key) JOIN rooms s ON s.map_id = k.map_id AND s.id = k.src"
_FOUR = dict.fromkeys(["x1", "y1", "x2", "y2"], "double")
_HALF, _TICK, _LONG, _WIDE = (f"{x!r}e0" for x in (_AT.half, _AT.units(_AT.room_px * 0.9, 4), _AT.units(_AT.room_px * 0.83, 6), _AT.units(_AT.room_px * 0.29, 3)))


@query(f"""WITH kinds AS ({_KINDS}), {_STEPS},
    a AS (SELECT k.*, s.x::DOUBLE + dx * {_HALF} AS x1, (0e0 - s.y) + dy * {_HALF} AS y1, CASE WHEN kind = 'oneway' THEN d.x::DOUBLE ELSE d.x::DOUBLE - dx * {_HALF} END AS x2, CASE WHEN kind = 'oneway' THEN 0e0 - d.y ELSE (0e0 - d.y) - dy * {_HALF} END AS y2
      FROM {_ENDS} JOIN rooms d ON d.map_id = k.map_id AND d.id = k.dst WHERE kind IN ('line', 'oneway')),
    b AS (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS far FROM a),
    c AS (SELECT *, CASE WHEN far > 0 THEN (x2 - x1) / far ELSE 1e0 END AS ux, CASE WHEN far > 0 THEN (y2 - y1) / far ELSE 0e0 END AS uy FROM b)
    SELECT map_id, src, key, kind, x1, y1, x2, y2, CASE WHEN kind = 'oneway' THEN mx END AS tip_x, CASE WHEN kind = 'oneway' THEN mx - ux * {_LONG} - uy * {_WIDE} END AS base_x, CASE WHEN kind = 'oneway' THEN my - uy * {_LONG} + ux * {_WIDE} END AS base_y FROM c""",
    map_id="long", src="long", key="string", kind="string", **_FOUR, tip_x="double", base_x="double", base_y="double")
def exit_lines(spark, sf):
    out = geometry.exit_lines(_kinds(spark, sf), grid.rooms(spark, sf), _AT.cell_px)
    return out.select("*", F.col("head_x")[0].alias("tip_x"), F.col("head_x")[1].alias("base_x"), F.col("head_y")[1].alias("base_y"))


def _tinted(spark, sf):
    return grid.rooms(spark, sf).withColumn("rgb", F.array((F.col("env") % 256).cast("int"), F.lit(10), F.lit(20)))


@query(f"""WITH kinds AS ({_KINDS}), {_STEPS},
    v AS (SELECT k.map_id, k.src, k.key, k.dst, false AS special, s.x::DOUBLE AS sx, 0e0 - s.y AS sy, dx AS vx, dy AS vy FROM {_ENDS} WHERE kind = 'cross' UNION ALL
      SELECT map_id, src, key, dst, true, sx, sy, run / far, rise / far FROM (SELECT *, sqrt(run * run + rise * rise) AS far FROM (SELECT e.map_id, src, e.key, dst, s.x::DOUBLE AS sx, 0e0 - s.y AS sy, d.x::DOUBLE - s.x::DOUBLE AS run, (0e0 - s.y) - (0e0 - d.y) AS rise
        FROM exits e JOIN rooms s ON s.map_id = e.map_id AND s.id = src JOIN rooms d ON d.map_id = e.map_id AND d.id = dst WHERE special AND s.area_id <> d.area_id AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.map_id = e.map_id AND l.room_id = src AND l.key = e.key))) WHERE far > 0),
    w AS (SELECT *, sx + vx * 0.325e0 AS x1, sy + vy * 0.325e0 AS y1 FROM v)
    SELECT w.map_id, src, key, special, x1, y1, x1 + vx * {_TICK} AS x2, y1 + vy * {_TICK} AS y2, coalesce('rgb(' || d.env % 256 || ',10,20)', '#ff9f4a') AS color FROM w LEFT JOIN rooms d ON d.map_id = w.map_id AND d.id = dst""",
    map_id="long", src="long", key="string", special="boolean", **_FOUR, color="string")
def cross_arrows(spark, sf):
    return geometry.cross_arrows(grid.exits(spark, sf), _kinds(spark, sf), _tinted(spark, sf), grid.lines(spark, sf), _AT.cell_px)


@query(f"""WITH {_STEPS}, a AS (SELECT map_id, id, key, x::DOUBLE + dx * {_HALF} AS x1, (0e0 - y) + dy * {_HALF} AS y1, dx, dy FROM (SELECT *, unnest(['n', 'se', 'up']) AS key FROM rooms WHERE id % 3 = 0) JOIN st USING (key) WHERE dx <> 0 OR dy <> 0)
    SELECT map_id, id, key, x1, y1, x1 + dx * 0.5e0 AS x2, y1 + dy * 0.5e0 AS y2 FROM a""", map_id="long", id="long", key="string", **_FOUR)  # fmt: skip
def stub_lines(spark, sf):
    rooms = grid.rooms(spark, sf).filter("id % 3 = 0").withColumn("stubs", F.array(*map(F.lit, ("n", "se", "up"))))
    return geometry.stubs(rooms, _AT.cell_px)


@query(f"""SELECT e.map_id, src AS id, key, r.x::DOUBLE - {_AT.room_px / 30 / 2!r}e0 + {_AT.units(_AT.room_px * 0.22, 2)!r}e0 AS x, (0e0 - r.y) - {_AT.room_px / 30 / 2!r}e0 - {_AT.units(_AT.room_px * 0.22, 2)!r}e0 AS y
    FROM exits e JOIN rooms r ON r.map_id = e.map_id AND r.id = src WHERE NOT special AND key = 'up' AND dst <> 0""", map_id="long", id="long", key="string", x="double", y="double")  # fmt: skip
def stack_shadows(spark, sf):
    return geometry.stack_shadows(grid.exits(spark, sf), grid.rooms(spark, sf), _AT.cell_px)


@query("""SELECT map_id, id, symbol, CASE length(symbol) WHEN 1 THEN 14e0 WHEN 2 THEN 10e0 WHEN 3 THEN 10e0 ELSE 8e0 END / 30e0 AS size,
    CASE WHEN (greatest(env % 256, 20) / 255e0 + least(env % 256, 10) / 255e0) / 2 > 0.41e0 THEN 'rgb(25,25,25)' ELSE 'rgb(225,255,255)' END AS color FROM (SELECT * REPLACE (left(name, 1 + id % 4) AS symbol) FROM rooms)""", map_id="long", id="long", symbol="string", size="double", color="string")  # fmt: skip
def room_symbols(spark, sf):
    rooms = _tinted(spark, sf).withColumn("symbol", F.substring("name", F.lit(1), (1 + F.col("id") % 4).cast("int")))
    return geometry.symbols(rooms, _AT.cell_px)


@query(f"""SELECT map_id, id, 'rgb(' || env % 256 || ',10,20)' AS fill, CASE id % 7 WHEN 0 THEN '#aabbcc80' WHEN 1 THEN '#aabbcc' WHEN 2 THEN 'red' ELSE 'rgb(225,225,225)' END AS border, CASE WHEN id % 10 = 0 THEN 0.35e0 ELSE 1e0 END AS alpha,
    CASE WHEN id % 7 <= 2 THEN greatest(0.4e0, least(greatest(id % 15, 1), 10)::DOUBLE * {_AT.zoom * 0.4875!r}e0) ELSE {_AT.zoom * 0.4875!r}e0 END / 30e0 AS border_width FROM rooms""", map_id="long", id="long", fill="string", border="string", alpha="double", border_width="double")  # fmt: skip
def room_squares(spark, sf):
    k = F.col("id") % 7
    border = F.when(k == 0, "#80aabbcc").when(k == 1, "#FFaabbcc").when(k == 2, "red").otherwise("")
    data = F.create_map(F.lit("system.fallback_hidden"), F.when(F.col("id") % 10 == 0, "True").otherwise("no"), F.lit("room.ui_borderColor"), border, F.lit("room.ui_borderThickness"), (F.col("id") % 15).cast("string"))
    return geometry.room_squares(_tinted(spark, sf).withColumn("user_data", data), _AT.cell_px)


def _drawn(spark, sf):
    """Custom lines with colours, styles, arrows and doors, by room."""
    k = F.col("room_id")
    lines = grid.lines(spark, sf).filter(F.size("points") > 0)
    return lines.select("map_id", "room_id", "key", F.array(F.array(k % 40 + 1.5, F.lit(2.5)), F.array(k % 40 + 4.5, F.lit(6.5))).alias("points"), F.when(k % 2 == 0, F.array((k % 256).cast("int"), F.lit(10), F.lit(20))).alias("color"), F.when(k % 3 == 0, "dash_dot").when(k % 3 == 1, "dash").alias("style"), (k % 4 == 0).alias("arrow"), F.when(k % 5 == 0, "open").when(k % 5 == 1, "jammed").alias("door"))


@query(f"""SELECT l.map_id, room_id, l.key, 1 + 2 AS n_points, x::DOUBLE AS x0, 0e0 - y AS y0, CASE WHEN room_id % 2 = 0 THEN 'rgb(' || room_id % 256 || ',10,20)' ELSE '#aaaaff' END AS color, CASE room_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END AS n_dash, CASE room_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 END * ({_AT.zoom * 2 / 30!r}e0) AS dash,
    CASE WHEN room_id % 5 <= 1 THEN (x::DOUBLE + room_id % 40 + 1.5e0) / 2 END AS door_x, CASE room_id % 5 WHEN 0 THEN 'rgb(10,155,10)' WHEN 1 THEN 'rgb(155,10,10)' END AS door_color, CASE WHEN room_id % 4 = 0 THEN room_id % 40 + 4.5e0 - (0.6e0 * {3**0.5 / 2!r}e0 + -0.8e0 * 0.5e0) * {_AT.units(_AT.zoom * 10, 8)!r}e0 END AS left_x,
    CASE WHEN room_id % 4 = 0 THEN -6.5e0 - (-0.8e0 * {3**0.5 / 2!r}e0 + 0.6e0 * 0.5e0) * {_AT.units(_AT.zoom * 10, 8)!r}e0 END AS right_y FROM lines l JOIN rooms r ON r.map_id = l.map_id AND r.id = room_id WHERE drawn""",
    map_id="long", room_id="long", key="string", n_points="long", x0="double", y0="double", color="string", n_dash="long", dash="double", door_x="double", door_color="string", left_x="double", right_y="double")
def custom_lines(spark, sf):
    out = geometry.custom_lines(_drawn(spark, sf), grid.rooms(spark, sf), _AT.cell_px)
    return out.select("*", F.size("xs").alias("n_points"), F.col("xs")[0].alias("x0"), F.col("ys")[0].alias("y0"), F.size("dash").alias("n_dash"), F.get("dash", F.lit(0)).alias("dash1"), F.get("head_x", F.lit(1)).alias("left_x"), F.get("head_y", F.lit(2)).alias("right_y")).drop("dash").withColumnRenamed("dash1", "dash")


@query(f"""SELECT map_id, src AS id, key, x::DOUBLE AS x, (0e0 - y) + {_AT.room_px / 30 / 4!r}e0 - {_AT.room_px / 30 / 5 * 0.8!r}e0 AS top_y, CASE WHEN (greatest(env % 256, 20) / 255e0 + least(env % 256, 10) / 255e0) / 2 > 0.41e0 THEN 'rgba(25,25,25,0.6)' ELSE 'rgba(225,255,255,0.6)' END AS fill
    FROM (SELECT e.map_id, src, key, x, y, env FROM exits e JOIN rooms r ON r.map_id = e.map_id AND r.id = src WHERE NOT special AND key = 'up')""", map_id="long", id="long", key="string", x="double", top_y="double", fill="string")  # fmt: skip
def inner_marks(spark, sf):
    out = geometry.inner_marks(grid.exits(spark, sf), _tinted(spark, sf), _AT.cell_px)
    return out.select("*", F.col("xs")[0].alias("x"), F.col("ys")[0].alias("top_y"))


@query(f"""SELECT map_id, id, x::DOUBLE + {_AT.half!r}e0 AS x, (0e0 - y) - {_AT.half!r}e0 AS y, CASE WHEN env % 256 * 0.299e0 + 10 * 0.587e0 + 20 * 0.114e0 > 140 THEN '#111' ELSE '#fff' END AS color FROM rooms r WHERE EXISTS (SELECT 1 FROM exits e WHERE e.map_id = r.map_id AND e.src = r.id AND special)""", map_id="long", id="long", x="double", y="double", color="string")
def special_markers(spark, sf):
    return geometry.special_markers(grid.exits(spark, sf), _tinted(spark, sf), _AT.cell_px)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 40 < 4 THEN NULL WHEN c_custkey % 40 < 15 THEN 0.025 WHEN c_custkey % 40 < 30 THEN 0.035 ELSE 0.045 END AS alpha FROM customer", id="long", alpha="double")
def grid_alpha(spark, sf):
    k = F.col("c_custkey")
    return grid.table(spark, sf, "customer").select(k.alias("id"), geometry.grid_alpha(k % 40).alias("alpha"))
