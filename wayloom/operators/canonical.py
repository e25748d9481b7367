"""Canonical form of rooms: fields that equal their defaults are left out, lists and keys sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAPS = ["exits", "doors", "exit_weights", "custom_lines", "special_exits", "user_data"]
LISTS = ["stubs", "exit_locks", "special_exit_locks", "tags"]
TEXTS = ["symbol", "name", "notes"]
FLAGS = ["locked", "hidden"]


def sorted_entries(m: Column) -> Column:
    """A map's entries by key, which unlike a map can be compared, grouped and hashed; null if there are none."""
    return F.when(F.size(m) > 0, F.array_sort(F.map_entries(m)))


def stripped(rooms: DataFrame) -> DataFrame:
    """Rooms without what equals absence: empty containers and texts, weight 1, false flags, a solid line's style, a missing arrow."""
    line = lambda _, v: v.withField("style", F.nullif(v["style"], F.lit("solid"))).withField("arrow", F.when(v["arrow"], F.lit(True)))
    out = {c: F.when(F.size(c) > 0, F.col(c)) for c in [*MAPS, *LISTS] if c in rooms.columns}
    out |= {c: F.nullif(F.col(c), F.lit("")) for c in TEXTS if c in rooms.columns}
    out |= {c: F.when(F.col(c), F.lit(True)) for c in FLAGS if c in rooms.columns}
    if "weight" in rooms.columns:
        out["weight"] = F.nullif(F.col("weight"), F.lit(1))
    if "custom_lines" in rooms.columns:
        out["custom_lines"] = F.when(F.size("custom_lines") > 0, F.transform_values("custom_lines", line))
    return rooms.withColumns(out)


def stripped_struct(room: Column, fields: list[str]) -> Column:
    """The same for one room of a nested document, which has these fields."""
    line = lambda _, v: F.struct(v["points"].alias("points"), v["color"].alias("color"), F.nullif(v["style"], F.lit("solid")).alias("style"), F.when(v["arrow"], F.lit(True)).alias("arrow"))

    def bare(c: str) -> Column:
        if c in [*MAPS, *LISTS]:
            return F.when(F.size(room[c]) > 0, F.transform_values(room[c], line) if c == "custom_lines" else room[c])
        if c in TEXTS:
            return F.nullif(room[c], F.lit(""))
        return F.when(room[c], F.lit(True)) if c in FLAGS else F.nullif(room[c], F.lit(1)) if c == "weight" else room[c]

    return F.struct(*(bare(c).alias(c) for c in fields))


def comparable(rooms: DataFrame) -> DataFrame:
    """Stripped rooms whose maps are sorted entries and whose lists are sorted, for equality of whole rooms."""
    bare = stripped(rooms)
    out = {c: sorted_entries(F.col(c)) for c in MAPS if c in rooms.columns} | {c: F.sort_array(c) for c in LISTS if c in rooms.columns}
    return bare.withColumns(out)


def changed_rooms(before: DataFrame, after: DataFrame) -> DataFrame:
    """map_id, id and the names of the fields in which rooms of both sides differ."""
    a, b = comparable(before), comparable(after)
    fields = [c for c in a.columns if c not in ("map_id", "id", "area_ord", "room_ord", "area_name", "area_title") and c in b.columns]
    both = a.select("map_id", "id", F.struct(*fields).alias("a")).join(b.select("map_id", "id", F.struct(*fields).alias("b")), ["map_id", "id"])
    names = F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    return both.select("map_id", "id", names.alias("fields")).filter(F.size("fields") > 0)
