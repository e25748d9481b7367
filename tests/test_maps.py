"""Map documents: reading, checksums, rules, routing, transports, search, diff and codes on small maps."""

import json
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from wayloom.functions import codes, text
from wayloom.operators import delta, diff, display, graph, integrity, oplog, ordering, routing, rules, search, transports
from wayloom.sources import json_map

ROOMS = [
    {"id": 1, "x": 0, "y": 0, "z": 0, "env": 1, "name": "Großer Market", "exits": {"e": 2, "n": 9}},
    {"id": 2, "x": 1, "y": 0, "z": 0, "env": 2, "name": "Ferry Stairs", "exits": {"w": 1, "e": 3}, "exit_weights": {"e": 4}, "special_exits": {"squeeze": 4}},
    {"id": 3, "x": 2, "y": 0, "z": 0, "env": 2, "exits": {"w": 2}, "weight": 3},
    {"id": 4, "x": 5, "y": 5, "z": 1, "env": 300, "name": "Kiln", "locked": True, "exits": {"down": 3}},
]


def document(rooms=ROOMS, **more):
    return {"format": "lanes", "format_version": 2, "meta": {"map_name": "t"}, "colors": {"env_colors": {"2": 9}, "custom_env_colors": {"300": [1, 2, 3]}}, "areas": [{"id": 7, "name": "Harbour", "rooms": rooms, "labels": []}]} | more


@pytest.fixture
def maps(spark, tmp_path):
    def read(doc=None, name="a.json"):
        (tmp_path / name).write_text(json.dumps(doc or document()))
        return json_map.read_maps(spark, str(tmp_path / name))

    return read


def test_tables(maps):
    t = json_map.exploded(maps())
    assert t.rooms.count() == 4 and t.areas.count() == 1 and t.exits.count() == 7
    assert t.exits.filter("special").select("src", "key", "dst").collect() == [(2, "squeeze", 4)]


def test_bad_json_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception):
        json_map.read_maps(spark, str(tmp_path / "bad.json")).collect()


def test_violations(maps):
    t = json_map.exploded(maps(document(ROOMS + [{"id": 1, "x": 0, "y": 0, "z": 0, "env": 1, "exits": {"bogus": 2}, "doors": {"n": "ajar"}, "stubs": ["n", "n"], "weight": 0}], format="other")))
    found = {(r.path, r.code) for r in rules.violations(t, "lanes").collect()}
    assert {("format", "INVALID_FORMAT"), ("rooms[1].id", "DUPLICATE_ROOM_ID"), ("rooms[1].exits.bogus", "INVALID_DIRECTION"), ("rooms[1].doors.n", "INVALID_DOOR_VALUE"), ("rooms[1].stubs", "DUPLICATE_DIRECTION"), ("rooms[1].weight", "MUST_BE_POSITIVE_INTEGER"), ("rooms[1].exits.n", "TARGET_NOT_FOUND")} <= found


def test_empty_map_is_valid(spark):
    e = json_map.empty_map(spark, "lanes")
    assert rules.document_rules(e, "lanes").count() == 0


def walk(t, **options):
    rooms = graph.indexed(t.rooms)
    return graph.walkable(graph.adjacency(t.exits, rooms), **options).withColumn("map_id", F.lit(0))


@pytest.mark.parametrize("fits", [1000, 0])
def test_routes(spark, maps, fits):
    t = json_map.exploded(maps())
    sources = spark.createDataFrame([(0, 1)], "map_id long, source long")
    costs = {r.id: r.cost for r in routing.shortest(walk(t), sources, fits).collect()}
    assert costs == {1: 0.0, 2: 1.0, 3: 5.0}  # the tower is locked
    free = routing.shortest(walk(t, avoid_locked=False), sources, fits)
    assert {r.id: r.cost for r in free.collect()} == {1: 0.0, 2: 1.0, 3: 5.0, 4: 2.0}
    wanted = spark.createDataFrame([(0, 1, 4), (0, 1, 77), (0, 1, 1)], "map_id long, source long, target long")
    assert {r.target: r.path for r in routing.routes(walk(t, avoid_locked=False), wanted, fits).collect()} == {4: [1, 2, 4], 1: [1]}
    rides = spark.createDataFrame([(0, 1, 4, 0.5, "ship"), (0, 1, 3, 0.5, "cart"), (0, 1, 9, 0.1, "cart"), (0, 3, 2, -1.0, "cart")], "map_id long, src long, dst long, cost double, hop string")
    rooms = t.rooms.withColumn("map_id", F.lit(0))
    both = routing.with_rides(walk(t), rides, rooms)
    assert {r.id: r.cost for r in routing.shortest(both, sources, fits).collect()} == {1: 0.0, 2: 1.0, 3: 0.5}  # no ride into the locked tower
    points = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 3), (0, 0, 2, None), (0, 0, 3, 2)], "map_id long, plan long, pos long, room long")
    found = routing.planned(points, both, fits)
    assert [(r.leg, r.src, r.dst, r.hop) for r in routing.hops(found, both, ["leg"]).collect()] == [(0, 1, 3, "cart")]
    assert [tuple(r)[2:] for r in routing.plan_totals(found).collect()] == [(1, True)]
    open_ = routing.with_rides(walk(t), rides, rooms, avoid_locked=False)
    assert {r.id: r.cost for r in routing.shortest(open_, sources, fits).collect()} == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5}
    assert routing.shortest(walk(t, directions="cardinal", avoid_locked=False), sources, fits).count() == 3


def test_edge_weight_of_nan_and_negative(spark):
    df = spark.createDataFrame([(float("nan"), 3), (-1.0, 3), (0.0, None), (2.5, 9), (float("inf"), 1)], "own double, room int")
    assert [r[0] for r in df.select(graph.edge_weight(F.col("own"), F.col("room"))).collect()] == [3.0, 3.0, 1.0, 2.5, float("inf")]


def test_transport_rides_wrap_and_stop(spark):
    legs = spark.createDataFrame([(0, "ship", ["board"], "leave", i, a, b, t, None) for i, (a, b, t) in enumerate([(1, 2, 20.0), (2, 3, None), (3, 1, 10.0)])], "map_id long, line string, board array<string>, exit_command string, pos int, src int, dst int, time double, label string")
    rooms = spark.createDataFrame([(0, i) for i in (1, 2, 3)], "map_id long, id int")
    got = {(r.src, r.dst): r.cost for r in transports.edges(legs, rooms).collect()}
    assert got == {(1, 2): 40.0, (1, 3): 70.0, (2, 3): 60.0, (2, 1): 65.0, (3, 1): 35.0, (3, 2): 45.0}
    assert transports.edges(legs, rooms, "warp").count() == 0
    assert transports.edges(legs, rooms.filter("id <> 3")).count() == 1


def test_rides_end_where_the_line_breaks(spark):
    rows = [("a", 0, 1, 2, 0.1), ("a", 1, 2, 3, 0.2), ("a", 2, 9, 4, 0.3), ("a", 3, 4, 2, 0.4), ("b", 0, 5, 5, 1.0), ("b", 1, 5, 6, 2.0)]
    legs = spark.createDataFrame([(0, line, ["on"], "off", k, a, b, t, f"{line}{k}") for line, k, a, b, t in rows], "map_id long, line string, board array<string>, exit_command string, pos int, src int, dst int, time double, label string")
    rooms = spark.createDataFrame([(0, i) for i in range(1, 7)], "map_id long, id int")
    got = {(r.line, r.src, r.dst): (r.time, r.label, r.via) for r in transports.edges(legs, rooms).collect()}
    assert got == {("a", 1, 2): (0.1, "a0", []), ("a", 1, 3): (0.1 + 0.2, "a1", ["a0"]), ("a", 2, 3): (0.2, "a1", []), ("a", 4, 2): (0.4, "a3", []), ("b", 5, 6): (2.0, "b1", [])}


def test_transport_documents_and_their_sums(spark, maps):
    tuples = spark.createDataFrame([(0, "ship", ["board"], "leave", [(1, 2, 5, "pier"), (2, 1, None, None)])], "map_id long, name string, board array<string>, exit_command string, stops array<struct<from:int,to:int,time:int,label:string>>")
    assert [(r.line, r.pos, r.src, r.dst, r.time, r.label) for r in transports.normalized(tuples).collect()] == [("ship", 0, 1, 2, 5.0, "pier"), ("ship", 1, 2, 1, None, None)]
    lines = [{"name": "b", "board": ["x"], "exit": "y", "legs": [{"from": 1, "to": 2, "time": 1.5}]}, {"name": "a", "board": ["x"], "exit": "y", "legs": [{"from": 2, "to": 1, "label": "l"}]}]
    sums = {(r.level, r.id): r.hash for r in transports.checksums(maps(document(transports={"format": "rides", "version": 1, "lines": lines})), "rides").collect()}
    own = lambda v: xxhash.xxh3_64_hexdigest(text.canonical(v).encode())
    assert sums == {("line", "a"): own(lines[1]), ("line", "b"): own(lines[0]), ("document", ""): own({"format": "rides", "version": 1, "lines": lines[::-1]})}
    signed = maps(document(transports={"format": "rides", "version": 1, "lines": lines}, checksums={"transports": {"hash": "0", "lines": {"a": own(lines[1]), "gone": "1"}}}), "s.json")
    found = integrity.verified(transports.stored_checksums(signed), transports.checksums(signed, "rides"), ["map_id", "level", "id"])
    assert {(r.level, r.id, r.verdict) for r in found.collect()} == {("document", "", "bad"), ("line", "b", "missing"), ("line", "gone", "extra")}
    docs = spark.createDataFrame([(0, "rides", 1, [1]), (1, "x", 2, None)], "map_id long, format string, version int, lines array<int>")
    assert {(r.map_id, r.code) for r in transports.document_problems(docs, "rides").collect()} == {(1, "INVALID_FORMAT"), (1, "INVALID_FORMAT_VERSION"), (1, "MUST_BE_ARRAY")}


def test_canonical_documents(spark, maps, tmp_path):
    doc = document([dict(ROOMS[1], weight=1, locked=False, tags=[]), ROOMS[0]])
    found = json_map.canonical_documents(maps(doc)).first().text
    rooms = [ROOMS[0], ROOMS[1] | {"exit_weights": {"e": 4.0}}]
    assert found == text.canonical(document(rooms))
    json_map.write_maps(maps(doc), str(tmp_path / "out"))
    assert json_map.exploded(json_map.read_maps(spark, str(tmp_path / "out"))).rooms.count() == 2


def test_base_identity_and_meta_sums(maps):
    docs = maps(document() | {"meta": {"map_name": "t", "user_data": {"version": "7", "revision": ""}}})
    sums = integrity.checksums(docs)
    by = {(r.level, r.id): r.hash for r in sums.collect()}
    row = delta.base_identity(sums, docs).first()
    assert (row.crc, row.areas, row.version, row.revision) == (by["file", ""], {"7": by["area", "7"]}, "7", None)
    # fixed values: the sums of an empty meta object and of one whole number
    assert xxhash.xxh3_64_hexdigest(integrity.meta_bytes({"meta": "{}"})) == "684c9486d36b49e6"
    assert xxhash.xxh3_64_hexdigest(integrity.meta_bytes({"meta": '{"a": 1}'})) == "b23e7391a781579c"
    assert integrity.meta_checksums(docs.selectExpr("map_id", "'{}' as meta")).first().hash == "684c9486d36b49e6"


def test_transport_problems(spark):
    lines = spark.createDataFrame([(0, 0, "a", ["b"], "x", [(1, 2, 1.0, None)]), (0, 1, "a", [], " ", [(0, 2, -1.0, None)])], "map_id long, pos int, name string, board array<string>, exit string, legs array<struct<from:int,to:int,time:double,label:string>>")
    assert sorted(r.path for r in transports.problems(lines).collect()) == ["transports.lines[1].board", "transports.lines[1].exit", "transports.lines[1].legs[0].from", "transports.lines[1].legs[0].time", "transports.lines[1].name"]


def test_search(maps):
    rooms = json_map.exploded(maps()).rooms
    assert [r.id for r in search.rooms_like(rooms, "#4").collect()] == [4]
    assert [r.id for r in search.rooms_like(rooms, "GROßER").collect()] == [1]
    found = [(r.id, r.name, r.score) for r in search.scored(rooms, "harbour stairs").collect()]
    assert found == [(2, "Ferry Stairs", 3)]
    assert [(r.id, r.score) for r in search.scored(rooms, "3").collect()][0] == (3, 999)
    assert search.scored(rooms, "  ").count() == 0


def test_moves_wait_for_free_cells(spark):
    kind = "map_id long, id long, area_id long, x long, y long, z long, name string"
    room = lambda i, x, z=0: (0, i, 1, x, 0, z, "r")
    before = [room(1, 1), room(2, 2), room(3, 3), room(4, 10), room(5, 11), room(6, 12), room(7, 20), room(8, 21), room(9, 30, None), room(11, 41), room(10, 40)]
    after = [room(1, 2), room(2, 3), room(3, 4), room(4, 11), room(5, 12), room(6, 10), room(7, 21), room(8, 21, 5), room(9, 30), room(10, 50), room(11, 50)]
    got = {r.id: (r.type, r.wave) for r in diff.moves(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind)).collect()}
    chain = {1: ("MOVE_ROOM", 2), 2: ("MOVE_ROOM", 1), 3: ("MOVE_ROOM", 0)}
    circle = {4: ("EDIT_ROOM", 0), 6: ("MOVE_ROOM", 1), 5: ("MOVE_ROOM", 2)}  # 4 waits for 5, 5 for 6, 6 for 4
    assert got == chain | circle | {7: ("MOVE_ROOM", 1), 8: ("MOVE_ROOM", 0), 10: ("MOVE_ROOM", 0), 11: ("EDIT_ROOM", 0)}


def test_diff_by_kind_of_change(spark):
    kind = "map_id long, id long, area_id long, x long, y long, z long, env long, symbol string, name string, tags array<string>, exits map<string,long>, exit_locks array<string>, special_exits map<string,long>, doors map<string,string>"
    base = {i: dict(map_id=0, id=i, area_id=1, x=i, y=0, z=None, env=1, symbol=None, name="r", tags=None, exits={"e": i + 1}, exit_locks=None, special_exits=None, doors=None) for i in range(1, 8)}
    base[6]["exits"] |= {"n": 7}  # room 7 goes, and its door and lock with it
    base[6] |= {"doors": {"n": "open"}, "exit_locks": ["n"]}
    new = {i: dict(r) for i, r in base.items() if i != 7}
    new[6] |= {"exits": None, "doors": {}, "exit_locks": [], "z": 0, "symbol": "", "tags": []}
    new[1] |= {"tags": ["a"], "x": 9, "env": 2, "exits": {}}
    new[2] |= {"exits": {"e": 4, "w": 1}, "env": 5}
    new[3] |= {"exits": {"w": 1}, "doors": {"w": "open"}, "symbol": "x"}
    new[4] |= {"special_exits": {"climb": 2}}
    new[5] |= {"env": 3, "y": 4}
    make = lambda rows: spark.createDataFrame([[r[c.split()[0]] for c in kind.split(", ")] for r in rows.values()], kind)
    a, b = make(base), make(new)
    assert {(r.id, r.type) for r in diff.room_ops(a, b).collect()} == {(7, "DELETE_ROOM"), (1, "EDIT_ROOM"), (3, "EDIT_EXIT"), (4, "EDIT_EXIT"), (5, "MOVE_ROOM"), (5, "PAINT_BATCH")}
    assert {(r.id, r.key, r.type) for r in diff.exit_ops(a, b).collect()} == {(2, "e", "DELETE_EXIT"), (2, "e", "ADD_EXIT"), (2, "w", "ADD_EXIT")}


def test_diff_and_colors(maps):
    one = lambda doc, name: json_map.exploded(maps(doc, name).withColumn("map_id", F.lit("m")))
    before = one(None, "before.json")
    changed = [dict(r) for r in ROOMS[:3]]
    changed[0]["name"], changed[1]["env"], changed[2]["x"] = "Old Market", 5, 8
    del changed[1]["special_exits"]  # it led to room 4
    after = one(document([*changed, {"id": 5, "x": 0, "y": 9, "z": 0, "env": 1}]), "after.json")
    ops = diff.ordered(diff.room_ops(before.rooms, after.rooms), ["id"])
    assert [(r.type, r.id) for r in ops.orderBy("seq").collect()] == [("ADD_ROOM", 5), ("DELETE_ROOM", 4), ("MOVE_ROOM", 3), ("EDIT_ROOM", 1), ("PAINT_BATCH", 2)]
    assert {(r.id, r.key, r.type) for r in diff.exit_ops(before.rooms, after.rooms).collect()} == set()
    rgb = {r.id: r.rgb for r in display.colored(before.rooms, before.env_colors.withColumn("env", F.col("env").cast("int")), before.custom_colors.withColumn("env", F.col("env").cast("int"))).collect()}
    assert rgb == {1: [128, 0, 0], 2: [255, 0, 0], 3: [255, 0, 0], 4: [1, 2, 3]}


def test_log_folds(spark):
    log = spark.createDataFrame([(0, 1, 1, "add", 0, 1), (0, 2, 1, "edit", 1, 2), (0, 3, 2, "edit", 5, 6), (0, 4, 2, "edit", 6, 5), (0, 5, 3, "add", 0, 1), (0, 6, 3, "delete", 1, 0), (0, 7, 4, "edit", 1, 3)], "log_id long, seq long, key long, type string, before long, after long")
    out = oplog.renumbered(oplog.folded(log)).orderBy("seq").collect()
    assert [(r.seq, r.key, r.type, r.after) for r in out] == [(1, 1, "add", 2), (2, 4, "edit", 3)]


def test_route_codes(spark):
    df = spark.createDataFrame([([100, 200, 300], "astar", "cardinal", "normal"), ([5, 6], "dijkstra", "all", "off"), ([5], "dijkstra", "all", "off"), ([5, 0], "x", "all", "off")], "p array<long>, a string, d string, t string")
    got = [r[0] for r in df.select(codes.encode_route(F.col("p"), F.col("a"), F.col("d"), F.col("t"), "lanes")).collect()]
    code = lambda core: f"{core}:{xxhash.xxh3_64_hexdigest(core.encode())[:8]}"
    own = code("lanes:dwp:5,6")
    assert got == [code("lanes:akn:100,200,300"), own, "", ""]
    bad = spark.createDataFrame([(f" {own.upper()} ",), (own.replace("5,6", "5,7"),), (own.replace("5,6", "05,6"),), (own.replace("lanes", "roads"),)], "c string")
    assert [(r.d and r.d.error, r.d and r.d.ids) for r in bad.select(codes.decode_route(F.col("c"), "lanes").alias("d")).collect()] == [(None, [5, 6]), ("crc", [5, 7]), (None, None), (None, None)]


def test_checksums_roll_up_and_verify(maps):
    docs = maps()
    sums = integrity.checksums(docs)
    by = {(r.level, r.id): r.hash for r in sums.collect()}
    assert len(by) == 6 and all(len(h) == 16 for h in by.values())
    other = integrity.checksums(maps(document([dict(ROOMS[0], name="X"), *ROOMS[1:]]), "b.json")).withColumn("map_id", F.lit("a.json"))
    found = {(r.level, r.id): r.verdict for r in integrity.verified(sums.withColumn("map_id", F.lit("a.json")).filter("id <> '4'"), other, ["level", "id"]).collect()}
    assert found == {("room", "1"): "bad", ("area", "7"): "bad", ("file", ""): "bad", ("room", "4"): "missing"}


def test_signed_documents_verify(spark, maps):
    docs = integrity.signed(maps())
    assert integrity.verified(integrity.stored_checksums(docs), integrity.checksums(docs), ["map_id", "level", "id"]).count() == 0
    assert docs.select("checksums.alg").first()[0] == "v4"


def test_canonical_bytes_and_text_hashes(spark):
    fields = "id x y z env name symbol notes hash weight locked hidden exits stubs exit_locks doors exit_weights special_exits special_exit_locks tags user_data custom_lines".split()
    bare = dict.fromkeys(fields) | {"id": 1, "x": 0, "y": 0, "z": 0, "env": 1}
    # fixed values: the bytes of a room with the required fields alone, and the hash of no bytes
    assert integrity.room_bytes(bare).hex() == "72340100000000000000000000000000000001000000"
    assert integrity.room_bytes(bare | {"weight": 1, "name": "", "exits": [], "locked": False}) == integrity.room_bytes(bare)
    both = integrity.room_bytes(bare | {"exits": [("zz", 3), ("w", 2), ("n", 9)]})
    assert [both.index(k) for k in (b"n\x09", b"w\x02", b"zz\x03")] == sorted(both.index(k) for k in (b"n\x09", b"w\x02", b"zz\x03"))
    assert spark.range(1).select(codes.xxh3_hex(F.lit(""))).first()[0] == "2d06800538d394c2"


def test_routes_of_equal_cost_are_the_same_by_rounds(spark):
    r = random.Random(5)
    ties = [(0, 5, 9, 2.0), (0, 5, 3, 1.0), (0, 3, 9, 1.0)]
    many = [(1, r.randint(1, 25), r.randint(1, 25), float(r.randint(1, 3))) for _ in range(110)]
    idle = [(2, r.randint(1, 15), r.randint(1, 15), float(r.randint(0, 1))) for _ in range(60)]
    edges = spark.createDataFrame(ties + many + idle, "map_id long, src long, dst long, w double")
    sources = spark.createDataFrame([(0, 5), (1, 1), (1, 20), (2, 1), (2, 15)], "map_id long, source long")
    small, large = ({tuple(x) for x in routing.shortest(edges, sources, fits).collect()} for fits in (routing.FITS, 0))
    assert small == large and (0, 5, 9, 2.0, 3) in large
    wanted = spark.createDataFrame([(0, 5, 9)], "map_id long, source long, target long")
    assert routing.routes(edges, wanted, 0).first().path == [5, 3, 9]
    pairs = spark.createDataFrame([(m, s, t) for m, s in ((0, 5), (1, 1), (1, 20), (2, 1), (2, 15)) for t in range(1, 26)], "map_id long, source long, target long")
    small, large = ({(x.map_id, x.source, x.target, x.cost, *x.path) for x in routing.routes(edges, pairs, fits).collect()} for fits in (routing.FITS, 0))
    assert small == large


def test_large_maps_settle_within_blocks_and_follow_bucketed_edges_between_them(spark, monkeypatch):
    """A corridor of 24 rooms needs no round a step, and blocks of any size give what Dijkstra gives."""
    rows = [(1, a, a + 1, 1.0) for a in range(1, 24)] + [(1, a, (a * 7) % 24 + 1, 9.0) for a in range(1, 24, 4)]
    edges = spark.createDataFrame(rows, "map_id long, src long, dst long, w double")
    sources = spark.createDataFrame([(1, 1), (1, 12)], "map_id long, source long")
    want = {tuple(r) for r in routing.shortest(edges, sources).collect()}
    plain, written = routing.checkpointed, []
    monkeypatch.setattr(routing, "checkpointed", lambda df: written.append(1) or plain(df))
    assert {tuple(r) for r in routing.relaxed(edges, sources).collect()} == want
    assert len(written) < 10
    assert {tuple(r) for r in routing.relaxed(edges, sources, block=10).collect()} == want
    assert {tuple(r) for r in routing.relaxed(edges, sources, block=16, within=15).collect()} == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rows_")]


def test_rides_are_shuffled_by_line_alone(spark):
    """What a ride is laid out from is joined once by line, so no shuffle carries a row a ride."""
    legs = spark.createDataFrame([(0, 1, "b", "x", p, p + 1, p + 2, 5.0, "l") for p in range(4)], "map_id long, line long, board string, exit_command string, pos long, src long, dst long, time double, label string")
    out = transports.edges(legs, spark.createDataFrame([(0, i) for i in range(1, 6)], "map_id long, id long"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode(filter(")]
    assert "Join" not in above and sorted((r.src, r.dst, r.time) for r in out.collect() if r.src == 2) == [(2, 3, 5.0), (2, 4, 10.0), (2, 5, 15.0)]


def test_tasks_of_exit_joins_grow_with_the_rooms(spark):
    """Joins of exits keep a number of tasks in proportion to the rooms, whatever the size of their shuffles."""
    rooms = spark.createDataFrame([(1, i, 1, i, 0, 0) for i in range(1, 41)], "map_id long, id long, area_id long, x long, y long, z long")
    exits = spark.createDataFrame([(1, i, "e", i + 1, False) for i in range(1, 40)], "map_id long, src long, key string, dst long, special boolean")
    lines = spark.createDataFrame([], "map_id long, room_id long, key string, points array<array<double>>")
    own = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert (ordering.tasks_for(rooms), ordering.tasks_for(rooms, 2)) == (own, 20)
    out = display.exit_kinds(exits, rooms, lines)
    assert {r.kind for r in out.collect()} == {"oneway"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 4
