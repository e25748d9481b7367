"""A delta's operations applied to map tables, type by type in the order of emission.

Each type is one set of joins: operations meet a guard on the state that the types before left,
those that fail it are skipped with a code and change nothing, and the rest make the new state. A
delta is taken to be compacted: of several operations of a type on one room, direction or label the
last counts. References may be ids or symbolic ids (d:1); additions get the ids after the largest
of the map, in the order of their numbers, and later types find them by their symbolic ids.

Operations are rows of OPERATIONS with the columns that their type needs; a PAINT_BATCH has a row
for each room.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.ordering import numbered
from wayloom.operators.routing import checkpointed

OPERATIONS = """map_id long, seq long, type string, room string, area string, to_area string, dst string, label string, key string,
x double, y double, z double, width double, height double, env long, symbol string, name string, text string, line string, rgb array<long>""".replace("\n", " ")
ORDER = ["ADD_AREA", "EDIT_AREA", "EDIT_ENV_COLOR", "ADD_ROOM", "MOVE_ROOM_TO_AREA", "DELETE_ROOM", "MOVE_ROOM", "EDIT_ROOM", "DELETE_EXIT", "DELETE_SPECIAL_EXIT", "ADD_EXIT", "ADD_CL", "EDIT_CL", "DELETE_CL", "PAINT_BATCH", "ADD_LABEL", "EDIT_LABEL", "RESIZE_LABEL", "MOVE_LABEL", "DELETE_LABEL", "DELETE_AREA"]
SYMBOLIC = r"^d:[1-9][0-9]*$"
#: What each reference of an operation is to, and the one that an addition defines.
REFERENCES = {"room": "room", "dst": "room", "area": "area", "to_area": "area", "label": "label"}
DEFINES = {"ADD_ROOM": "room", "ADD_AREA": "area", "ADD_LABEL": "label"}
#: The columns, beside map_id, that guards look at: all that a state needs where only what is skipped is asked for.
GUARDED = {"areas": ["id"], "rooms": ["id", "area_id", "x", "y", "z"], "exits": ["src", "key", "dst", "special"], "lines": ["room_id", "key"], "labels": ["area_id", "id"], "colors": ["env"]}
UNGUARDED = ["width", "height", "env", "symbol", "name", "text", "line", "rgb"]


@dataclass
class State:
    """Tables of maps: areas (id, name), rooms (id, area_id, x, y, z, env, symbol, name), exits (src, key, dst, special),
    lines (room_id, key, line), labels (area_id, id, x, y, width, height, text), colors (env, rgb); all with map_id."""

    areas: DataFrame
    rooms: DataFrame
    exits: DataFrame
    lines: DataFrame
    labels: DataFrame
    colors: DataFrame
    skipped: list[DataFrame] = field(default_factory=list)
    sids: list[DataFrame] = field(default_factory=list)


def _last(ops: DataFrame, *of: str) -> DataFrame:
    return ops.withColumn("_nth", F.row_number().over(Window.partitionBy("map_id", *of).orderBy(F.desc("seq")))).filter("_nth = 1").drop("_nth")


def _first(*of: str) -> Column:
    return F.row_number().over(Window.partitionBy("map_id", *of).orderBy("seq")) == 1


def _known(state_rows: DataFrame, *pairs: tuple[str, str], flag: str = "_there") -> DataFrame:
    """The distinct keys of a state table under the names that operations have for them, with a flag."""
    return state_rows.select("map_id", *(F.col(a).alias(b) for a, b in pairs)).distinct().withColumn(flag, F.lit(True))


def _guarded(s: State, ops: DataFrame, code: Column, *drop: str) -> tuple[State, DataFrame]:
    """The state with the skipped operations noted, and the operations that pass."""
    judged = checkpointed(ops.withColumn("_code", code))
    bad = judged.filter("_code is not null").select("map_id", "seq", F.col("_code").alias("code"))
    return replace(s, skipped=[*s.skipped, bad]), judged.filter("_code is null").drop("_code", *drop)


def _read(ops: DataFrame) -> DataFrame:
    """Operations with their type if it is known, the ids of references that are ids, and flags of those to symbolic ids; of texts of references only symbolic ids are kept."""
    out = ops.withColumn("_type", F.when(F.col("type").isin(ORDER), F.col("type")))
    for c in REFERENCES:
        symbolic = F.coalesce(F.col(c).startswith("d:") & F.col(c).rlike(SYMBOLIC), F.lit(False))
        own = F.coalesce(F.col("type").isin([t for t, defined in DEFINES.items() if defined == c]), F.lit(False))
        out = out.withColumn(f"{c}_id", F.when(~symbolic, F.col(c).try_cast("long"))).withColumn(f"_by_{c}", symbolic & ~own).withColumn(c, F.when(symbolic, F.col(c)))
    return out


def _resolved(s: State, ops: DataFrame, by: list[str]) -> tuple[State, DataFrame]:
    """Operations with the ids of the references ``by``; those with a symbolic id that nothing defined are skipped."""
    lost = F.lit(False)
    for c in by:
        if s.sids:
            sids = reduce(DataFrame.unionByName, s.sids).filter(F.col("kind") == REFERENCES[c])
            ops = ops.join(sids.select("map_id", F.col("sid").alias(c), F.col("id").alias("_id")), ["map_id", c], "left")
            ops = ops.withColumn(f"{c}_id", F.coalesce(f"{c}_id", "_id")).drop("_id")
        lost = lost | (F.col(f"_by_{c}") & F.col(f"{c}_id").isNull())
    return _guarded(s, ops, F.when(lost, "SID_LEFTOVER"))


def _fresh(rows: DataFrame, ops: DataFrame, by: list[str]) -> DataFrame:
    """Operations with ``fresh``: the ids after the largest of each group, in their order."""
    most = rows.groupBy(*by).agg(F.max("id").alias("_most"))
    return numbered(ops, by, ["seq"], "_n").join(most, by, "left").withColumn("fresh", F.coalesce("_most", F.lit(0)) + F.col("_n")).drop("_most", "_n")


def _defined(s: State, ops: DataFrame, kind: str) -> State:
    return replace(s, sids=[*s.sids, ops.filter(F.col(kind).rlike(SYMBOLIC)).select("map_id", F.lit(kind).alias("kind"), F.col(kind).alias("sid"), F.col("fresh").alias("id"))])


def _set(rows: DataFrame, ops: DataFrame, key: list[str], values: dict[str, Column], given: bool = False) -> DataFrame:
    """rows with new values, or those ``given`` that aren't null, in the columns they have, where an operation has their key."""
    values = {c: v for c, v in values.items() if c in rows.columns}
    if not values:
        return rows
    new = ops.select(*key, F.struct(*(v.alias(k) for k, v in values.items())).alias("_new"))
    out = rows.join(new, key, "left")
    return checkpointed(out.select(*(F.when(F.col(f"_new.{c}").isNotNull() if given else F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns)))


def _without_rooms(s: State, gone: DataFrame) -> State:
    """The state without rooms (map_id, id), exits from and to them, and lines of any of these."""
    of = lambda name: gone.select("map_id", F.col("id").alias(name))
    into = s.exits.join(of("dst"), ["map_id", "dst"], "left_semi").select("map_id", F.col("src").alias("room_id"), "key")
    exits = s.exits.join(of("dst"), ["map_id", "dst"], "left_anti").join(of("src"), ["map_id", "src"], "left_anti").select(*s.exits.columns)
    lines = s.lines.join(into, ["map_id", "room_id", "key"], "left_anti").join(of("room_id"), ["map_id", "room_id"], "left_anti").select(*s.lines.columns)
    return replace(s, rooms=checkpointed(s.rooms.join(gone, ["map_id", "id"], "left_anti").select(*s.rooms.columns)), exits=checkpointed(exits), lines=checkpointed(lines))


def add_area(s: State, ops: DataFrame) -> State:
    ops = checkpointed(_fresh(s.areas, ops, ["map_id"]))
    return _defined(replace(s, areas=s.areas.unionByName(ops.withColumn("id", F.col("fresh")).select(*s.areas.columns))), ops, "area")


def edit_area(s: State, ops: DataFrame) -> State:
    ops = _last(ops, "area_id").join(_known(s.areas, ("id", "area_id")), ["map_id", "area_id"], "left")
    s, ops = _guarded(s, ops, F.when(F.col("_there").isNull(), "AREA_MISSING"))
    return replace(s, areas=_set(s.areas, ops.withColumn("id", F.col("area_id")), ["map_id", "id"], {"name": F.col("name")}))


def delete_area(s: State, ops: DataFrame) -> State:
    ops = _last(ops, "area_id").join(_known(s.areas, ("id", "area_id")), ["map_id", "area_id"], "left")
    s, ops = _guarded(s, ops, F.when(F.col("_there").isNull(), "AREA_MISSING").when(F.col("area_id") <= 0, "DEFAULT_AREA"))
    gone = ops.select("map_id", "area_id")
    s = _without_rooms(s, s.rooms.join(gone, ["map_id", "area_id"], "left_semi").select("map_id", "id"))
    return replace(s, areas=s.areas.join(gone.withColumnRenamed("area_id", "id"), ["map_id", "id"], "left_anti").select(*s.areas.columns), labels=s.labels.join(gone, ["map_id", "area_id"], "left_anti").select(*s.labels.columns))


def edit_env_color(s: State, ops: DataFrame) -> State:
    """A null colour goes back to the default; no operation is skipped."""
    if "rgb" not in s.colors.columns:
        return s
    ops = checkpointed(_last(ops, "env"))
    kept = s.colors.join(ops.select("map_id", "env"), ["map_id", "env"], "left_anti").select(*s.colors.columns)
    return replace(s, colors=kept.unionByName(ops.filter("rgb is not null").select(*s.colors.columns)))


_CELL = ["map_id", "area_id", "x", "y", "z"]


def _cells(rooms: DataFrame) -> DataFrame:
    return rooms.select("map_id", "area_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in "xyz"), F.col("id").alias("_on"))


def add_room(s: State, ops: DataFrame) -> State:
    ops = ops.na.fill(0.0, ["x", "y", "z"]).join(_known(s.areas, ("id", "area_id")), ["map_id", "area_id"], "left").join(_cells(s.rooms).drop("_on").distinct().withColumn("_taken", F.lit(True)), _CELL, "left")
    code = F.when(F.col("_there").isNull(), "AREA_MISSING").when(F.col("_taken").isNotNull() | ~_first(*_CELL[1:]), "CELL_OCCUPIED")
    s, ops = _guarded(s, ops, code)
    ops = checkpointed(_fresh(s.rooms, ops, ["map_id"]))
    kinds = {f.name: f.dataType for f in s.rooms.schema.fields}
    values = {"id": F.col("fresh"), "symbol": F.nullif(F.col("symbol"), F.lit(""))}
    new = ops.select(*(values.get(c, F.col(c)).cast(kinds[c]).alias(c) if c in (*values, *ops.columns) else F.lit(None).cast(kinds[c]).alias(c) for c in s.rooms.columns))
    return _defined(replace(s, rooms=checkpointed(s.rooms.unionByName(new))), ops, "room")


def delete_room(s: State, ops: DataFrame) -> State:
    s, ops = _guarded(s, _last(ops, "room_id").join(_known(s.rooms, ("id", "room_id")), ["map_id", "room_id"], "left"), F.when(F.col("_there").isNull(), "ROOM_MISSING"))
    return _without_rooms(s, ops.select("map_id", F.col("room_id").alias("id")))


def move_room_to_area(s: State, ops: DataFrame) -> State:
    at = s.rooms.select("map_id", F.col("id").alias("room_id"), F.col("area_id").alias("_at"), F.lit(True).alias("_room"))
    ops = _last(ops, "room_id").join(at, ["map_id", "room_id"], "left").join(_known(s.areas, ("id", "to_area_id")), ["map_id", "to_area_id"], "left")
    s, ops = _guarded(s, ops, F.when(F.col("_room").isNull(), "ROOM_MISSING").when(F.col("_there").isNull(), "TARGET_AREA_MISSING").when(F.col("_at") == F.col("to_area_id"), "ALREADY_IN_AREA"))
    return replace(s, rooms=_set(s.rooms, ops.withColumn("id", F.col("room_id")), ["map_id", "id"], {"area_id": F.col("to_area_id")}))


def move_room(s: State, ops: DataFrame) -> State:
    """A target counts as free if all rooms on it moved away before; who waits for whom is followed round by round."""
    at = s.rooms.select("map_id", F.col("id").alias("room_id"), "area_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{c}") for c in "xyz"), F.lit(True).alias("_room"))
    ops = _last(ops, "room_id").drop("area_id").join(at, ["map_id", "room_id"], "left").withColumn("z", F.coalesce("z", "_z"))
    same = (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("z") == F.col("_z"))
    s, ops = _guarded(s, ops, F.when(F.col("_room").isNull(), "ROOM_MISSING").when(same, "ALREADY_THERE"))
    own = ops.select("map_id", F.col("room_id").alias("_on"), F.col("seq").alias("_left"))
    waits = ops.join(_cells(s.rooms), _CELL).filter("_on <> room_id").join(own, ["map_id", "_on"], "left")
    waits = checkpointed(waits.select("map_id", "seq", F.when(F.col("_left") < F.col("seq"), F.col("_left")).alias("after")))
    stuck, free = waits.filter("after is null").select("map_id", "seq").distinct(), None
    todo = checkpointed(ops.select(*_CELL, "seq").join(stuck, ["map_id", "seq"], "left_anti"))
    while not todo.isEmpty():
        ahead = waits.join(todo.select("map_id", F.col("seq").alias("after")), ["map_id", "after"], "left_semi").select("map_id", "seq").distinct()
        blocked = waits.join(stuck.select("map_id", F.col("seq").alias("after")), ["map_id", "after"], "left_semi").select("map_id", "seq").distinct()
        now = todo.join(ahead, ["map_id", "seq"], "left_anti").withColumn("ok", F.lit(True)).join(blocked.withColumn("_bad", F.lit(True)), ["map_id", "seq"], "left")
        now = now.withColumn("ok", F.col("_bad").isNull())
        now = checkpointed(now.withColumn("ok", F.col("ok") & (F.row_number().over(Window.partitionBy(*_CELL).orderBy(F.desc("ok"), "seq")) == 1)))
        if free is not None:
            late = now.filter("ok").join(free.select(*_CELL), _CELL, "left_semi").select("map_id", "seq")
            now = checkpointed(now.join(late.withColumn("_late", F.lit(True)), ["map_id", "seq"], "left").withColumn("ok", F.col("ok") & F.col("_late").isNull()).drop("_late"))
        won = now.filter("ok").select(*_CELL, "seq")
        free = checkpointed(won if free is None else free.unionByName(won))
        stuck = checkpointed(stuck.unionByName(now.filter("not ok").select("map_id", "seq")))
        todo = checkpointed(todo.join(now.select("map_id", "seq"), ["map_id", "seq"], "left_anti").select(*todo.columns))
    s, ops = _guarded(s, ops.join(stuck.withColumn("_stuck", F.lit(True)), ["map_id", "seq"], "left"), F.when(F.col("_stuck").isNotNull(), "CELL_OCCUPIED"))
    kinds = {f.name: f.dataType for f in s.rooms.schema.fields}
    return replace(s, rooms=_set(s.rooms, ops.withColumn("id", F.col("room_id")), ["map_id", "id"], {c: F.col(c).cast(kinds[c]) for c in "xyz"}))


def edit_room(s: State, ops: DataFrame) -> State:
    """The fields that the operation has; others stay."""
    s, ops = _guarded(s, _last(ops, "room_id").join(_known(s.rooms, ("id", "room_id")), ["map_id", "room_id"], "left"), F.when(F.col("_there").isNull(), "ROOM_MISSING"))
    return replace(s, rooms=_set(s.rooms, ops.withColumn("id", F.col("room_id")), ["map_id", "id"], {c: F.col(c) for c in ("name", "env", "symbol")}, given=True))


def paint_batch(s: State, ops: DataFrame) -> State:
    ops = ops.join(_known(s.rooms, ("id", "room_id")), ["map_id", "room_id"], "left")
    some = F.max(F.coalesce("_there", F.lit(False))).over(Window.partitionBy("map_id", "seq"))
    s, ops = _guarded(s, ops, F.when(~some, "NO_ROOM_EXISTS"))
    ops = _last(ops.filter("_there"), "room_id").withColumn("id", F.col("room_id"))
    return replace(s, rooms=_set(s.rooms, ops, ["map_id", "id"], {"env": F.col("env"), "symbol": F.nullif(F.col("symbol"), F.lit(""))}))


def add_exit(s: State, ops: DataFrame) -> State:
    have = s.exits.filter("not special").select("map_id", F.col("src").alias("room_id"), "key", F.col("dst").alias("_has"))
    ops = ops.join(_known(s.rooms, ("id", "room_id"), flag="_src"), ["map_id", "room_id"], "left").join(_known(s.rooms, ("id", "dst_id"), flag="_dst"), ["map_id", "dst_id"], "left").join(have, ["map_id", "room_id", "key"], "left")
    ops = ops.withColumn("_ok", F.col("_src").isNotNull() & F.col("_dst").isNotNull())
    own = F.first("dst_id").over(Window.partitionBy("map_id", "room_id", "key", "_ok").orderBy("seq"))
    s, ops = _guarded(s, ops, F.when(~F.col("_ok"), "SRC_OR_TGT_MISSING").when(F.coalesce("_has", own) != F.col("dst_id"), "DIR_OCCUPIED"))
    new = ops.filter("_has is null").select("map_id", F.col("room_id").alias("src"), "key", F.col("dst_id").alias("dst"), F.lit(False).alias("special")).distinct()
    return replace(s, exits=checkpointed(s.exits.unionByName(new)))


def _drop_exits(s: State, ops: DataFrame, special: bool, code: str) -> State:
    have = _known(s.exits.filter(F.col("special") == special), ("src", "room_id"), ("key", "key"))
    s, ops = _guarded(s, _last(ops, "room_id", "key").join(have, ["map_id", "room_id", "key"], "left"), F.when(F.col("_there").isNull(), code))
    gone = ops.select("map_id", "room_id", "key")
    exits = s.exits.join(gone.select("map_id", F.col("room_id").alias("src"), "key", F.lit(special).alias("special")), ["map_id", "src", "key", "special"], "left_anti").select(*s.exits.columns)
    return replace(s, exits=checkpointed(exits), lines=checkpointed(s.lines.join(gone, ["map_id", "room_id", "key"], "left_anti").select(*s.lines.columns)))


def delete_exit(s: State, ops: DataFrame) -> State:
    return _drop_exits(s, ops, False, "EXIT_MISSING")


def delete_special_exit(s: State, ops: DataFrame) -> State:
    return _drop_exits(s, ops, True, "SPECIAL_EXIT_MISSING")


def _line_ops(s: State, ops: DataFrame) -> DataFrame:
    return _last(ops, "room_id", "key").join(_known(s.rooms, ("id", "room_id"), flag="_room"), ["map_id", "room_id"], "left").join(_known(s.lines, ("room_id", "room_id"), ("key", "key")), ["map_id", "room_id", "key"], "left")


def _lines_set(s: State, ops: DataFrame) -> State:
    kept = s.lines.join(ops.select("map_id", "room_id", "key"), ["map_id", "room_id", "key"], "left_anti").select(*s.lines.columns)
    return replace(s, lines=checkpointed(kept.unionByName(ops.select(*s.lines.columns))))


def add_cl(s: State, ops: DataFrame) -> State:
    s, ops = _guarded(s, _line_ops(s, ops), F.when(F.col("_room").isNull(), "ROOM_MISSING"))
    return _lines_set(s, ops)


def edit_cl(s: State, ops: DataFrame) -> State:
    s, ops = _guarded(s, _line_ops(s, ops), F.when(F.col("_room").isNull(), "ROOM_MISSING").when(F.col("_there").isNull(), "CL_MISSING"))
    return _lines_set(s, ops) if "line" in s.lines.columns else s


def delete_cl(s: State, ops: DataFrame) -> State:
    s, ops = _guarded(s, _line_ops(s, ops), F.when(F.col("_there").isNull(), "CL_MISSING"))
    return replace(s, lines=checkpointed(s.lines.join(ops.select("map_id", "room_id", "key"), ["map_id", "room_id", "key"], "left_anti").select(*s.lines.columns)))


_LABEL = {"x": "x", "y": "y", "width": "width", "height": "height", "text": "text"}


def add_label(s: State, ops: DataFrame) -> State:
    s, ops = _guarded(s, ops.join(_known(s.areas, ("id", "area_id")), ["map_id", "area_id"], "left"), F.when(F.col("_there").isNull(), "AREA_MISSING"))
    ops = checkpointed(_fresh(s.labels, ops, ["map_id", "area_id"]))
    return _defined(replace(s, labels=checkpointed(s.labels.unionByName(ops.withColumn("id", F.col("fresh")).select(*s.labels.columns)))), ops, "label")


def _on_labels(columns: list[str] | None):
    """Sets the columns of labels, or deletes them where there are none."""

    def run(s: State, ops: DataFrame) -> State:
        s, ops = _guarded(s, _last(ops, "area_id", "label_id").join(_known(s.labels, ("area_id", "area_id"), ("id", "label_id")), ["map_id", "area_id", "label_id"], "left"), F.when(F.col("_there").isNull(), "LABEL_MISSING"))
        key, ops = ["map_id", "area_id", "id"], ops.withColumn("id", F.col("label_id"))
        if columns is None:
            return replace(s, labels=checkpointed(s.labels.join(ops.select(*key), key, "left_anti").select(*s.labels.columns)))
        return replace(s, labels=_set(s.labels, ops, key, {c: F.col(c) for c in columns}))

    return run


STEPS = {
    "ADD_AREA": add_area, "EDIT_AREA": edit_area, "EDIT_ENV_COLOR": edit_env_color, "ADD_ROOM": add_room, "MOVE_ROOM_TO_AREA": move_room_to_area, "DELETE_ROOM": delete_room, "MOVE_ROOM": move_room, "EDIT_ROOM": edit_room,
    "DELETE_EXIT": delete_exit, "DELETE_SPECIAL_EXIT": delete_special_exit, "ADD_EXIT": add_exit, "ADD_CL": add_cl, "EDIT_CL": edit_cl, "DELETE_CL": delete_cl, "PAINT_BATCH": paint_batch, "ADD_LABEL": add_label,
    "EDIT_LABEL": _on_labels(list(_LABEL)), "RESIZE_LABEL": _on_labels(["x", "y", "width", "height"]), "MOVE_LABEL": _on_labels(["x", "y"]), "DELETE_LABEL": _on_labels(None), "DELETE_AREA": delete_area,
}


#: What each table of a state hangs on beside its own types: areas guard labels and rooms, and only these two define ids.
NEEDED = {"areas": ["AREA"], "colors": ["ENV_COLOR"], "labels": ["AREA", "LABEL"]}


def types_for(table: str | None) -> list[str]:
    """The types of operations that a table of the state depends on; all of them for rooms, exits, lines and what is skipped."""
    if table not in NEEDED:
        return ORDER
    return [t for t in ORDER if t.endswith(tuple("_" + n for n in NEEDED[table])) and t != "MOVE_ROOM_TO_AREA"]


def applied(state: State, ops: DataFrame, only_seq: list[int] | None = None, table: str | None = None) -> State:
    """The state after the operations, or after those whose numbers are given; ``skipped`` has map_id, seq and code of the rest.

    Where a table, or ``skipped``, is named, only what it depends on is applied, and it alone is to be read. Operations are
    read once, with the ids that they have; symbolic ids are looked up for those alone that have some, and for all types
    between two that define ids at once.
    """
    if table == "skipped":
        state = replace(state, **{t: getattr(state, t).select("map_id", *kept) for t, kept in GUARDED.items()})
        ops = ops.drop(*UNGUARDED)
    elif table is not None:
        ops = ops.filter(F.col("type").isin(types_for(table)))
    if only_seq is not None:
        ops = ops.filter(F.col("seq").isin(only_seq))
    ops = checkpointed(_read(ops), "_type")
    flags = {c: f"_by_{c}" for c in REFERENCES}
    there = {r["_type"]: [c for c in flags if r[c]] for r in ops.groupBy("_type").agg(*(F.bool_or(f).alias(c) for c, f in flags.items())).collect()}  # a row for each type
    refers = reduce(lambda a, b: a | b, map(F.col, flags.values()))
    state = replace(state, skipped=[ops.filter("_type is null").select("map_id", "seq", F.lit("UNKNOWN_TYPE").alias("code"))])
    turns = [[]]
    for t in filter(there.__contains__, ORDER):
        turns[-1].append(t)
        if t in DEFINES:
            turns.append([])
    for types in turns:
        by = [c for c in flags if any(c in there[t] for t in types)]
        if by:
            state, found = _resolved(state, ops.filter(F.col("_type").isin(types) & refers), by)
        for t in types:
            own = ops.filter(F.col("_type") == t)
            if there[t]:
                own = own.filter(~refers).unionByName(found.filter(F.col("_type") == t))
            state = STEPS[t](state, own.drop("_type", *flags.values()))
    return state


def skipped(state: State) -> DataFrame:
    """map_id, seq and code of every operation that changed nothing."""
    return reduce(DataFrame.unionByName, state.skipped).distinct()
