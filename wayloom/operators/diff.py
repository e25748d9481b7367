"""Differences between two snapshots of map tables, as rows of typed operations.

Rooms are compared in canonical form, so a field that equals its default and an absent one are the
same. The room before is first rid of its exits into rooms that go, with what hangs on these exits,
since deleting a room does as much. Of what then differs in a room,

- a new area is an operation of its own;
- any field but place, paint, exits and lines makes one EDIT_ROOM, which takes in all the rest;
- else a new place is a move, and besides it exits alone make operations by direction, exits with
  their doors, weights, locks or stubs one EDIT_EXIT, and only a room whose exits stay has paint
  and line operations of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.canonical import comparable
from wayloom.operators.ordering import numbered
from wayloom.operators.routing import checkpointed

#: The order in which operations of each type are emitted; fixed values.
PHASES = ["ADD_AREA", "EDIT_AREA", "EDIT_ENV_COLOR", "ADD_ROOM", "MOVE_ROOM_TO_AREA", "DELETE_ROOM", "MOVE_ROOM", "EDIT_ROOM", "DELETE_EXIT", "ADD_EXIT", "EDIT_EXIT", "ADD_CL", "EDIT_CL", "DELETE_CL", "PAINT_BATCH", "ADD_LABEL", "EDIT_LABEL", "RESIZE_LABEL", "MOVE_LABEL", "DELETE_LABEL", "DELETE_AREA"]
PLACE, PAINT = ["x", "y", "z"], ["env", "symbol"]
EXIT_FAMILY = ["special_exits", "doors", "exit_weights", "exit_locks", "special_exit_locks", "stubs"]
#: Columns of room tables that aren't fields of the room.
OUTSIDE = ["map_id", "id", "area_id", "area_ord", "room_ord", "area_name", "area_title"]


def differs(columns: list[str], a: str = "before", b: str = "after") -> Column:
    return reduce(lambda x, y: x | y, (~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns), F.lit(False))


def matched(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """A row for each key of either side, with structs before and after (null: not there)."""
    pack = lambda df, name: df.select(*key, F.struct(*columns).alias(name))
    return pack(before, "before").join(pack(after, "after"), key, "full_outer")


def overlap(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """How many keys both sides share, by the larger side; 1 if both are empty."""
    both = matched(before, after, key, key)
    n = both.agg(F.count("before").alias("n_before"), F.count("after").alias("n_after"), F.count_if(F.col("before").isNotNull() & F.col("after").isNotNull()).alias("n_both"))
    ratio = F.when(F.greatest("n_before", "n_after") == 0, 1.0).otherwise(F.col("n_both") / F.greatest("n_before", "n_after"))
    return n.select("n_before", "n_after", "n_both", ratio.alias("overlap"))


def trimmed(rooms: DataFrame, gone: DataFrame) -> DataFrame:
    """Rooms without their exits into rooms of ``gone`` (map_id, id), and without what hangs on these exits."""
    lost = gone.select("map_id", F.col("id").alias("to")).distinct()
    out = rooms
    for field, locks in (("exits", "exit_locks"), ("special_exits", "special_exit_locks")):
        if field not in rooms.columns:
            continue
        keys = rooms.select("map_id", "id", F.explode(field).alias("key", "to")).join(lost, ["map_id", "to"]).groupBy("map_id", "id").agg(F.collect_set("key").alias("_keys"))
        out = out.join(keys, ["map_id", "id"], "left")
        cut = {c: F.when(F.col("_keys").isNull(), F.col(c)).otherwise(F.map_filter(c, lambda k, _: ~F.array_contains("_keys", k))) for c in (field, "doors", "exit_weights", "custom_lines") if c in rooms.columns}
        cut |= {c: F.when(F.col("_keys").isNull(), F.col(c)).otherwise(F.array_except(c, "_keys")) for c in (locks,) if c in rooms.columns}
        out = out.withColumns(cut).drop("_keys")
    return out


def room_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """map_id, id, before and after (canonical rooms with area_id, null: not there) and what differs.

    ``edited`` marks rooms that one EDIT_ROOM takes in; exits, exit_rest, paint, lines and place
    are what differs otherwise, area in any case.
    """
    gone = before.select("map_id", "id").join(after.select("map_id", "id"), ["map_id", "id"], "left_anti")
    fields = [c for c in before.columns if c in after.columns and c not in OUTSIDE]
    zero = lambda df: comparable(df).withColumn("z", F.nullif(F.col("z"), F.lit(0))) if "z" in df.columns else comparable(df)
    both = matched(zero(trimmed(before, gone)), zero(after), ["map_id", "id"], ["area_id", *fields])
    here = F.col("before").isNotNull() & F.col("after").isNotNull()
    own = lambda names: here & differs([c for c in names if c in fields])
    rest = [c for c in fields if c not in [*PLACE, *PAINT, "exits", *EXIT_FAMILY, "custom_lines"]]
    both = both.withColumns({"area": here & differs(["area_id"]), "edited": own(rest), "place": own(PLACE), "exits": own(["exits"]), "exit_rest": own(EXIT_FAMILY), "paint": own(PAINT), "lines": own(["custom_lines"])})
    small = ~F.col("edited")
    quiet = small & ~F.col("exits") & ~F.col("exit_rest")
    return both.withColumns({"place": small & F.col("place"), "exit_edit": small & F.col("exit_rest"), "exits": small & F.col("exits") & ~F.col("exit_rest"), "paint": quiet & F.col("paint"), "lines": quiet & F.col("lines")})


def room_ops(before: DataFrame, after: DataFrame) -> DataFrame:
    """map_id, id, type, before, after: operations on whole rooms."""
    both = room_changes(before, after)
    kinds = {"ADD_ROOM": F.col("before").isNull(), "DELETE_ROOM": F.col("after").isNull(), "MOVE_ROOM_TO_AREA": F.col("area"), "EDIT_ROOM": F.col("edited"), "MOVE_ROOM": F.col("place"), "EDIT_EXIT": F.col("exit_edit"), "PAINT_BATCH": F.col("paint")}
    each = F.explode(F.filter(F.array(*(F.when(on, F.lit(t)) for t, on in kinds.items())), lambda k: k.isNotNull()))
    return both.select("map_id", "id", each.alias("type"), "before", "after")


def _entries(changes: DataFrame, flag: str, field: str) -> DataFrame:
    """map_id, id, key, before and after of the entries of a map field that differ, in rooms with the flag."""
    side = lambda s: changes.filter(flag).select("map_id", "id", F.explode(f"{s}.{field}").alias("e")).select("map_id", "id", F.col("e.key").alias("key"), F.col("e.value").alias(s))
    both = side("before").join(side("after"), ["map_id", "id", "key"], "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def exit_ops(before: DataFrame, after: DataFrame) -> DataFrame:
    """map_id, id, key, type, dst_before, dst_after: exits by direction; a new target is a deletion and an addition."""
    both = _entries(room_changes(before, after), "exits", "exits")
    kinds = F.array(F.when(F.col("before").isNotNull(), F.lit("DELETE_EXIT")), F.when(F.col("after").isNotNull(), F.lit("ADD_EXIT")))
    return both.select("map_id", "id", "key", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("type"), F.col("before").alias("dst_before"), F.col("after").alias("dst_after"))


def line_ops(before: DataFrame, after: DataFrame) -> DataFrame:
    """map_id, id, key, type: custom lines added, edited and deleted; ``suppressor`` marks lines without points."""
    both = _entries(room_changes(before, after), "lines", "custom_lines")
    kind = F.when(F.col("before").isNull(), "ADD_CL").when(F.col("after").isNull(), "DELETE_CL").otherwise("EDIT_CL")
    line = F.coalesce("after", "before")
    return both.select("map_id", "id", "key", kind.alias("type"), (F.coalesce(F.size(line["points"]), F.lit(0)) <= 0).alias("suppressor"))


def paint_changes(ops: DataFrame) -> DataFrame:
    """A row for each painted room: env and symbol before and after, which name its batch."""
    cols = [(F.coalesce(F.col(f"{s}.{c}"), F.lit("")) if c == "symbol" else F.col(f"{s}.{c}")).alias(f"{c}_{s}") for s in ("before", "after") for c in PAINT]
    return ops.filter("type = 'PAINT_BATCH'").select("map_id", "id", *cols)


def paint_groups(ops: DataFrame) -> DataFrame:
    """The batches: rooms with the same change of paint, how many, and the least and largest id."""
    return paint_changes(ops).groupBy("map_id", "env_before", "symbol_before", "env_after", "symbol_after").agg(F.count("*").alias("n_rooms"), F.min("id").alias("first_room"), F.max("id").alias("last_room"))


def keyed_ops(before: DataFrame, after: DataFrame, key: list[str], columns: list[str], add: str, edit: str, delete: str) -> DataFrame:
    """Added, edited and deleted keys."""
    both = matched(before, after, key, columns)
    kind = F.when(F.col("before").isNull(), add).when(F.col("after").isNull(), delete).when(differs(columns), edit)
    return both.select(*key, kind.alias("type"), "before", "after").filter("type is not null")


def area_ops(before: DataFrame, after: DataFrame) -> DataFrame:
    """Areas added, deleted, and edited in name or user_data; an absent name is the empty one."""
    plain = lambda df: df.select("map_id", "id", F.coalesce("name", F.lit("")).alias("name"), F.when(F.size("user_data") > 0, F.array_sort(F.map_entries("user_data"))).alias("user_data"))
    return keyed_ops(plain(before), plain(after), ["map_id", "id"], ["name", "user_data"], "ADD_AREA", "EDIT_AREA", "DELETE_AREA")


def color_ops(before: DataFrame, after: DataFrame) -> DataFrame:
    """EDIT_ENV_COLOR for every env whose own colour (rgb) is new, other or gone."""
    return keyed_ops(before, after, ["map_id", "env"], ["rgb"], *["EDIT_ENV_COLOR"] * 3)


def label_ops(before: DataFrame, after: DataFrame) -> DataFrame:
    """Operations on labels; of an edit, a new size and a new place, the first that applies. Labels of deleted areas go with these."""
    size, place, rest = ["width", "height"], ["x", "y"], ["z", "text", "fg_color", "bg_color", "no_scaling", "show_on_top", "pixmap"]
    both = matched(before, after, ["map_id", "area_id", "id"], [*size, *place, *[c for c in rest if c in before.columns]])
    rest = [c for c in rest if c in before.columns]
    kind = F.when(F.col("before").isNull(), "ADD_LABEL").when(F.col("after").isNull(), "DELETE_LABEL").when(differs(rest), "EDIT_LABEL").when(differs(size), "RESIZE_LABEL").when(differs(place), "MOVE_LABEL")
    return both.select("map_id", "area_id", "id", kind.alias("type"), "before", "after").filter("type is not null")


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """map_id, id, type and wave of the rooms whose place alone changes: each moves once its target is free.

    A room whose target is taken by another that moves waits for it, so waves count the rooms that
    one waits for. Of rooms that wait for each other in a circle, the one with the least id is an
    EDIT_ROOM, which needs no free target; so is a room whose target never becomes free. Waits are
    followed by doubling, so there are as many joins as the longest wait has bits.
    """
    changes = room_changes(before, after)
    cell = lambda s: [F.col(f"{s}.x").alias("x"), F.col(f"{s}.y").alias("y"), F.coalesce(f"{s}.z", F.lit(0)).alias("z")]
    wanted = checkpointed(changes.filter("place").select("map_id", "id", F.col("after.area_id").alias("area_id"), *cell("after")))
    at = ["map_id", "area_id", "x", "y", "z"]
    first = Window.partitionBy(*at).orderBy("id")
    stay = changes.filter("after is not null and not place").select("map_id", "id", F.col("after.area_id").alias("area_id"), *cell("after"))
    taken = stay.select(*at, F.lit(True).alias("kept")).distinct()
    leave = changes.filter("place").select("map_id", F.col("id").alias("on"), F.col("after.area_id").alias("area_id"), *cell("before")).groupBy(*at).agg(F.min("on").alias("on"))
    rows = wanted.withColumn("nth", F.row_number().over(first)).join(taken, at, "left").join(leave, at, "left")
    never = F.col("kept").isNotNull() | (F.col("nth") > 1)
    rows = checkpointed(rows.select("map_id", "id", never.alias("never"), F.when(~never & (F.col("on") != F.col("id")), F.col("on")).alias("on")))
    least = _least_of_circles(rows)
    rows = rows.join(least, ["map_id", "id"], "left").select("map_id", "id", (F.col("never") | F.col("circle").isNotNull()).alias("forced"), F.when(F.col("circle").isNull(), F.col("on")).alias("on"))
    wave = _followed(rows.select("map_id", "id", "on", F.lit(0).alias("low")))
    kind = F.when(F.col("forced"), "EDIT_ROOM").otherwise("MOVE_ROOM")
    return rows.join(wave.select("map_id", "id", "steps"), ["map_id", "id"]).select("map_id", "id", kind.alias("type"), F.col("steps").alias("wave"))


def _followed(rows: DataFrame, most: int | None = None) -> DataFrame:
    """map_id, id, on (where following ``on`` ends: null at a root), steps made, and the least low met; ``most`` doublings at most."""
    now, k = checkpointed(rows.withColumn("steps", F.col("on").isNotNull().cast("long"))), 0
    while (most is None or k < most) and not now.filter("on is not null").isEmpty():
        to = now.select("map_id", F.col("id").alias("on"), F.col("on").alias("far"), F.col("steps").alias("more"), F.col("low").alias("low_far"))
        both = now.join(to, ["map_id", "on"], "left")
        now, k = checkpointed(both.select("map_id", "id", F.col("far").alias("on"), F.least("low", "low_far").alias("low"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))), k + 1
    return now


def _least_of_circles(rows: DataFrame) -> DataFrame:
    """map_id and id of the least member of each circle of waits, with ``circle`` true."""
    n = rows.filter("on is not null").count()
    if not n:
        return rows.filter("false").select("map_id", "id", F.lit(True).alias("circle"))
    far = _followed(rows.select("map_id", "id", "on", F.col("id").alias("low")), n.bit_length())
    on_circle = far.filter("on is not null").select("map_id", F.col("on").alias("id")).distinct()
    return far.join(on_circle, ["map_id", "id"], "left_semi").filter("low = id").select("map_id", "id", F.lit(True).alias("circle"))


def ordered(ops: DataFrame, by: list[str]) -> DataFrame:
    """seq 1, 2, ... by phase within each map."""
    phase = F.coalesce(*(F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(PHASES)))
    return numbered(ops.withColumn("phase", phase), ["map_id"], ["phase", *by])


def stats(ops: DataFrame) -> DataFrame:
    return ops.groupBy("map_id", "type").agg(F.count("*").alias("n"))
