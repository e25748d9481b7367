"""Delta files, canonical rooms, and edit logs as streams."""

import datetime as dt
import json
import os

import pytest
import xxhash
from pyspark.sql import functions as F

from wayloom.functions import text
from wayloom.operators import apply, canonical, delta, oplog
from wayloom.plans import grid
from wayloom.streaming import logs


def write(tmp_path, name, doc):
    (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))


def op(seq, kind, target=None, payload=None):
    return {"seq": seq, "type": kind, "target": target, "payload": payload, "label": ""}


def summed(doc):
    """doc with the sums that its operations and all but the sums themselves have."""
    own = lambda v: xxhash.xxh3_64_hexdigest(text.canonical(v).encode())
    return doc | {"checksums": {"file": own({k: v for k, v in doc.items() if k != "checksums"}), "ops": [own(o) for o in doc["ops"]]}}


def test_gates(spark, tmp_path):
    good = {"format": "lanes-delta", "format_version": 3, "meta": {"ops_count": 2, "note": "größer \U0001f600 [{"}, "ops": [op(1, "DELETE_AREA", {"areaId": 4}, {}), op(2, "MOVE_LABEL", {"areaId": 4, "labelId": 1}, {"toX": 1.5, "toY": -0.25})]}
    nested = 1
    for _ in range(70):
        nested = [nested]
    changed = summed(good)
    changed["ops"][1]["payload"]["toX"] = 2
    files = {
        "good": summed(good), "empty": " ", "bad": "{", "other": summed(good | {"format": "x"}), "old": summed(good | {"format_version": 2}), "extra": summed(good) | {"more": 1}, "deep": summed(good | {"meta": {"ops_count": 2, "a": nested}}),
        "changed": changed, "no-ops": {k: v for k, v in summed(good | {"ops": []}).items() if k != "ops"}, "count": summed(good | {"meta": {"ops_count": 5}}),
    }
    for name, doc in files.items():
        write(tmp_path, name, doc)
    got = {r.delta_id: (r.code, r.bad) for r in delta.gates(delta.read(spark, str(tmp_path)), "lanes-delta").collect()}
    assert got == {
        "empty": ("EMPTY_FILE", None), "bad": ("PARSE_ERROR", None), "other": ("NOT_A_DELTA", None), "old": ("UNSUPPORTED_VERSION", None), "extra": ("UNKNOWN_TOP_KEYS", None), "deep": ("TOO_DEEP", None),
        "changed": ("CHECKSUM_MISMATCH", [1]), "no-ops": ("OPS_MISSING", None), "count": ("OPS_COUNT_MISMATCH", None),
    }


def test_lengths_are_in_utf16_units(spark):
    df = spark.createDataFrame([("aé\U0001f600\U0001f600",)], "t string")
    assert df.select(delta.utf16_length(df.t)).first()[0] == 6


def test_problems(spark, tmp_path):
    room = {"roomId": 1}
    ops = [
        op(1, "ADD_ROOM", {"roomId": "d:1", "areaId": 7}, {"room": {}}), op(3, "ADD_EXIT", {"sourceId": "d:1", "dir": "n"}, {"targetId": 2}), op(3, "BOGUS", {}, {}), op(4, "EDIT_ROOM", {"roomId": "d:9"}, {"before": {}}),
        op(5, "ADD_EXIT", {"sourceId": 1, "dir": "nowhere"}, {"targetId": 2, "bidirectional": True}), op(6, "MOVE_ROOM", {"roomId": 1.5}, {"toX": 1, "toY": 2, "toZ": 0}), op(7, "MOVE_ROOM", room, {"toX": "1", "toY": 2, "toZ": 0, "why": 1}),
        op(8, "PAINT_BATCH", {}, {"changes": [{"roomId": 1}, {"env": 2}]}), op(9, "EDIT_ENV_COLOR", {"envId": 3}, {"newColor": None}), op(10, "EDIT_ENV_COLOR", {"envId": -3}, {"newColor": [1, 2, 3]}), op(11, "EDIT_ENV_COLOR", {"envId": 3}, {"newColor": [1, 2, 300]}),
        op(12, "DELETE_AREA", {"areaId": 4}, {"name": None}), op(13, "ADD_CL", room | {"dir": "n"}, {"cl": {"__proto__": 1}}) | {"hue": 1}, op(14, "DELETE_AREA", {"areaId": 4}, {}) | {"hue": 1}, op(15, "EDIT_AREA", {"areaId": 4}, {"name": 5}), op(16, "DELETE_ROOM", None, {"room": {}}), op(17, "DELETE_ROOM", room | {"areaId": 1}, None),
    ]
    write(tmp_path, "d", {"ops": ops})
    ops = delta.operations(delta.read(spark, str(tmp_path)))
    assert {(r.seq, r.code) for r in delta.problems(ops).collect()} == {
        (3, "OP_SEQ_ORDER"), (3, "OP_UNKNOWN_TYPE"), (4, "OP_MISSING_FIELD"), (5, "OP_BAD_DIR"), (6, "OP_INVALID_FIELD"), (7, "OP_INVALID_FIELD"), (7, "OP_UNKNOWN_KEY"), (8, "OP_INVALID_FIELD"), (10, "OP_INVALID_FIELD"), (11, "OP_INVALID_FIELD"),
        (13, "OP_FORBIDDEN_KEY"), (14, "OP_UNKNOWN_KEY"), (15, "OP_INVALID_FIELD"), (16, "OP_NO_TARGET"), (16, "OP_MISSING_FIELD"), (17, "OP_NO_PAYLOAD"), (17, "OP_MISSING_FIELD"),
    }
    assert [(r.seq, r.code) for r in delta.reference_problems(ops).collect()] == [(4, "OP_UNKNOWN_SID")]


def test_canonical_text():
    value = {"b": [1, 2.0, None, True], "a": {"z": [], "y": {}}, "c": [0.1, 1e21, 1.5e-7, -0.0], "\U0001f600": "\n\"é", "\uffee": [[1]]}
    assert text.canonical(value) == '''{
  "a": {
    "y": {},
    "z": []
  },
  "b": [1, 2, null, true],
  "c": [0.1, 1e+21, 1.5e-7, 0],
  "\U0001f600": "\\n\\"é",
  "\uffee": [
    [1]
  ]
}'''
    assert text.canonical(list(range(9))).count("\n") == 10


def test_rooms_equal_but_for_defaults(spark):
    kind = "map_id string, id int, name string, weight int, locked boolean, exits map<string,int>, tags array<string>"
    a = spark.createDataFrame([("m", 1, "", 1, False, {}, ["b", "a"]), ("m", 2, "x", 2, True, {"n": 1}, None)], kind)
    b = spark.createDataFrame([("m", 1, None, None, None, None, ["a", "b"]), ("m", 2, "y", 2, None, {"n": 3}, [])], kind)
    assert [(r.id, r.fields) for r in canonical.changed_rooms(a, b).collect()] == [(2, ["name", "locked", "exits"])]


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(0, 1, 5, "add", 0, 1, t), (0, 2, 5, "edit", 1, 4, t + dt.timedelta(minutes=1)), (1, 3, 6, "delete", 9, 0, t + dt.timedelta(hours=2))]
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, logs.LOG).coalesce(1).write.parquet(path)
    for name, fn, mode in (("chains", logs.latest, "complete"), ("windows", logs.windowed_counts, "append")):
        q = fn(logs.read(spark, path)).writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.key, r.n, r.before, r.after, r.type) for r in spark.table("chains").collect()} == {(5, 2, 0, 4, "edit"), (6, 1, 9, 0, "delete")}
    assert {(r.type, r.n) for r in spark.table("windows").collect()} == {("add", 1), ("edit", 1)}


def test_apply_by_type(spark):
    frame = spark.createDataFrame
    areas = frame([(0, 1, "one"), (0, 2, "two"), (0, -1, "void")], "map_id long, id long, name string")
    rooms = frame([(0, i, 1, i, 0, 0, 1, "s", f"r{i}") for i in range(1, 7)], "map_id long, id long, area_id long, x long, y long, z long, env long, symbol string, name string")
    exits = frame([(0, 1, "e", 2, False), (0, 2, "e", 3, False), (0, 4, "climb", 3, True)], "map_id long, src long, key string, dst long, special boolean")
    lines = frame([(0, 2, "e", "old"), (0, 1, "e", "old")], "map_id long, room_id long, key string, line string")
    labels = frame([(0, 1, 5, 0.0, 0.0, 1.0, 1.0, "t"), (0, 2, 1, 0.0, 0.0, 1.0, 1.0, "t")], "map_id long, area_id long, id long, x double, y double, width double, height double, text string")
    colors = frame([(0, 3, [1, 2, 3])], "map_id long, env long, rgb array<long>")
    names = [c.strip().split(" ")[0] for c in apply.OPERATIONS.split(", ")]
    todo = [
        dict(type="ADD_AREA", area="d:1", name="new"), dict(type="ADD_ROOM", room="d:2", area="d:1", x=9.0, y=9.0, name="fresh"), dict(type="ADD_ROOM", room="d:3", area="1", x=6.0), dict(type="ADD_ROOM", room="d:4", area="77"),
        dict(type="ADD_EXIT", room="d:2", dst="1", key="n"), dict(type="ADD_EXIT", room="1", dst="4", key="e"), dict(type="ADD_EXIT", room="1", dst="d:9", key="s"), dict(type="DELETE_ROOM", room="3"), dict(type="DELETE_ROOM", room="99"),
        dict(type="MOVE_ROOM", room="2", x=20.0, y=0.0), dict(type="MOVE_ROOM", room="1", x=2.0, y=0.0), dict(type="MOVE_ROOM", room="4", x=1.0, y=0.0), dict(type="MOVE_ROOM", room="5", x=5.0, y=0.0), dict(type="MOVE_ROOM", room="6", x=2.0, y=0.0),
        dict(type="MOVE_ROOM_TO_AREA", room="5", to_area="1"), dict(type="EDIT_ROOM", room="d:2", name="named"), dict(type="ADD_LABEL", area="1", label="d:7", x=1.0, y=1.0, width=1.0, height=1.0, text="l"), dict(type="MOVE_LABEL", area="1", label="d:7", x=5.0, y=6.0), dict(type="DELETE_LABEL", area="1", label="9"),
        dict(type="EDIT_ENV_COLOR", env=3), dict(type="EDIT_ENV_COLOR", env=4, rgb=[7, 7, 7]), dict(type="DELETE_AREA", area="2"), dict(type="DELETE_AREA", area="-1"), dict(type="EDIT_CL", room="1", key="n", line="x"), dict(type="PAINT_BATCH", room="98", env=1), dict(type="WHAT"),
    ]
    ops = frame([[o.get(c) if c not in ("map_id", "seq") else (0 if c == "map_id" else k) for c in names] for k, o in enumerate(todo, 1)], apply.OPERATIONS)
    out = apply.applied(apply.State(areas, rooms, exits, lines, labels, colors), ops)
    assert {(r.seq, r.code) for r in apply.skipped(out).collect()} == {
        (3, "CELL_OCCUPIED"), (4, "AREA_MISSING"), (6, "DIR_OCCUPIED"), (7, "SID_LEFTOVER"), (9, "ROOM_MISSING"), (13, "ALREADY_THERE"), (14, "CELL_OCCUPIED"), (15, "ALREADY_IN_AREA"), (19, "LABEL_MISSING"), (23, "DEFAULT_AREA"), (24, "CL_MISSING"), (25, "NO_ROOM_EXISTS"), (26, "UNKNOWN_TYPE"),
    }
    assert {(r.id, r.area_id, r.x, r.name) for r in out.rooms.collect()} == {(1, 1, 2, "r1"), (2, 1, 20, "r2"), (4, 1, 1, "r4"), (5, 1, 5, "r5"), (6, 1, 6, "r6"), (7, 3, 9, "named")}
    assert {(r.src, r.key, r.dst) for r in out.exits.collect()} == {(1, "e", 2), (7, "n", 1)}
    assert {(r.room_id, r.key) for r in out.lines.collect()} == {(1, "e")}
    assert {(r.id, r.name) for r in out.areas.collect()} == {(1, "one"), (-1, "void"), (3, "new")}
    assert {(r.area_id, r.id, r.x) for r in out.labels.collect()} == {(1, 5, 0.0), (1, 6, 5.0)} and out.colors.collect() == [(0, 4, [7, 7, 7])]
    some = apply.applied(apply.State(areas, rooms, exits, lines, labels, colors), ops, only_seq=[20])
    assert apply.skipped(some).count() == 0 and some.colors.count() == 0 and some.rooms.count() == 6


def test_written_deltas_pass_the_gates(spark, tmp_path):
    rows = [("a", 4, "MOVE_ROOM", "two", '{"roomId": 2}', '{"toX":1,"toY":2,"toZ":0}'), ("a", 2, "ADD_AREA", 'na"me', '{"areaId":"d:1"}', '{"area":{"name":"x"}}'), ("a", 3, "NOTE", "", "{}", "{}"), ("b", 1, "DELETE_AREA", None, '{"areaId":5}', None)]
    ops = spark.createDataFrame(rows, "delta_id string, seq long, type string, label string, target string, payload string")
    metas = spark.createDataFrame([("a", '{"author": "me"}'), ("b", "{}"), ("none", "{}")], "delta_id string, meta string")
    for r in delta.texts(ops, metas, "lanes-delta").collect():
        write(tmp_path, r.delta_id, r.text)
        assert r.text == text.canonical(json.loads(r.text))
    files = delta.read(spark, str(tmp_path))
    assert delta.gates(files, "lanes-delta").count() == 0
    read = delta.operations(files)
    assert {(r.delta_id, r.seq, r.type, r.label) for r in read.collect()} == {("a", 1, "ADD_AREA", 'na"me'), ("a", 2, "MOVE_ROOM", "two"), ("b", 1, "DELETE_AREA", "")}
    assert delta.problems(read).count() == 0 and delta.reference_problems(read).count() == 0


def test_chains_stop_where_something_else_refers_to_them(spark):
    log = spark.createDataFrame([(0, 1, 1, "edit", 0, 1), (0, 3, 1, "edit", 1, 2), (0, 4, 1, "edit", 2, 3), (0, 5, 2, "move", 7, 8), (0, 6, 2, "move", 8, 7), (0, 7, 3, "edit", 4, 5), (0, 8, 3, "edit", 5, 4)], "log_id long, seq long, key long, type string, before long, after long")
    blocks = spark.createDataFrame([(0, 1, 2)], "log_id long, key long, seq long")
    got = {(r.key, r.first_seq, r.last_seq, r.before, r.after) for r in oplog.folded(log, blocks).collect()}
    assert got == {(1, 1, 1, 0, 1), (1, 3, 4, 1, 3), (2, 5, 6, 7, 7)}
    assert {(r.key, r.n) for r in oplog.folded(log).collect()} == {(1, 3), (2, 2)}


def test_a_table_is_made_from_the_operations_that_it_hangs_on_alone(spark):
    kinds = {"areas": "id long, name string", "rooms": "id long, area_id long, x long, y long, z long, env long, symbol string, name string", "exits": "src long, key string, dst long, special boolean", "lines": "room_id long, key string, line string", "labels": "area_id long, id long, x double, y double, width double, height double, text string", "colors": "env long, rgb array<long>"}
    rows = {"areas": [(1, 1, "one")], "labels": [(1, 1, 7, 0.0, 0.0, 1.0, 1.0, "t")]}
    state = apply.State(**{t: spark.createDataFrame(rows.get(t, []), f"map_id long, {k}") for t, k in kinds.items()})
    names = [c.split()[0] for c in apply.OPERATIONS.split(", ")]
    given = [dict(seq=1, type="ADD_AREA", area="d:1", name="two"), dict(seq=2, type="EDIT_AREA", area="1", name="uno"), dict(seq=3, type="ADD_ROOM", room="d:2", area="d:1", x=0.0, y=0.0), dict(seq=4, type="ADD_LABEL", label="d:3", area="d:1", x=1.0, y=2.0, text="new"), dict(seq=5, type="MOVE_LABEL", label="7", area="1", x=3.0, y=4.0)]
    ops = spark.createDataFrame([tuple((g | {"map_id": 1}).get(n) for n in names) for g in given], apply.OPERATIONS)
    areas = apply.applied(state, ops, table="areas")
    assert sorted((r.id, r.name) for r in areas.areas.collect()) == [(1, "uno"), (2, "two")]
    assert areas.rooms is state.rooms and areas.labels is state.labels  # no step of theirs was taken
    labels = apply.applied(state, ops, table="labels")
    assert sorted((r.area_id, r.id, r.x) for r in labels.labels.collect()) == [(1, 7, 3.0), (2, 1, 1.0)] and labels.rooms is state.rooms


def test_what_is_skipped_takes_few_jobs_and_only_what_guards_look_at(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    ops = grid.delta_ops(spark, sf)
    ops = ops.unionByName(ops.limit(1).withColumn("type", F.lit("WHAT")).withColumn("seq", F.lit(-1).cast("long")))
    got, jobs = {}, {}
    for table in ("skipped", None):
        spark.sparkContext.setJobGroup(f"skipped-{table}", "")
        state = apply.applied(grid.delta_state(spark, sf), ops, table=table)
        got[table] = sorted((r.seq, r.code) for r in apply.skipped(state).collect())
        jobs[table] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"skipped-{table}"))
        assert ("name" in state.rooms.columns) == (table is None)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got["skipped"] == got[None] and (-1, "UNKNOWN_TYPE") in got["skipped"]
    assert jobs["skipped"] < 180 and jobs[None] < 220, jobs
