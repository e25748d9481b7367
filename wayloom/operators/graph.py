"""The room graph: index, weights, adjacency, area graph and reciprocal exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.schema import direction_number, opposite


def indexed(rooms: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One room for each map_id and id: of repeated ids the last in the map's order."""
    order = order or ["area_ord", "room_ord"]
    last = Window.partitionBy("map_id", "id").orderBy(*(F.desc(c) for c in order))
    return rooms.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")


def edge_weight(own: Column, room: Column) -> Column:
    """A positive exit weight, else the target room's weight, one at least. NaN counts as unset."""
    return F.when(~F.isnan(own) & (own > 0), own).otherwise(F.greatest(F.when(room > 0, room.cast("double")), F.lit(1.0)))


def neighbors(exits: DataFrame, rooms: DataFrame) -> DataFrame:
    """map_id, src, dst and w of every exit and special exit; dangling and repeated ones stay."""
    target = rooms.select("map_id", F.col("id").alias("dst"), F.col("weight").alias("room_weight"))
    return exits.join(target, ["map_id", "dst"], "left").select("map_id", "src", "key", "special", "pos", "dst", edge_weight(F.col("weight"), F.col("room_weight")).alias("w"))


def exit_class(key: Column, special: Column) -> Column:
    """0 compass, 1 vertical (in and out too), 2 special or unknown."""
    idx = direction_number(key)
    return F.when(special | idx.isNull(), 2).when(idx <= 8, 0).otherwise(1)


def adjacency(exits: DataFrame, rooms: DataFrame) -> DataFrame:
    """The router's edges: a special exit replaces an exit of the same key, and dangling ones go.

    map_id, src, dst, key, w, cls, lk (the exit is locked), and both rooms' areas and places.
    """
    newest = Window.partitionBy("map_id", "src", "key").orderBy(F.desc("special"))
    locks = Window.partitionBy("map_id", "src", "key")
    own = exits.withColumn("_nth", F.row_number().over(newest)).withColumn("lk", F.max(F.col("locked").cast("int")).over(locks) == 1).filter("_nth = 1 and dst <> 0")
    source = rooms.select("map_id", F.col("id").alias("src"), F.col("area_id").alias("src_area"), F.col("x").alias("src_x"), F.col("y").alias("src_y"), F.coalesce("z", F.lit(0)).alias("src_z"))
    target = rooms.select("map_id", F.col("id").alias("dst"), F.col("area_id").alias("dst_area"), F.col("x").alias("dst_x"), F.col("y").alias("dst_y"), F.coalesce("z", F.lit(0)).alias("dst_z"), F.col("weight").alias("room_weight"), F.coalesce("locked", F.lit(False)).alias("dst_locked"))
    both = own.join(target, ["map_id", "dst"]).join(source, ["map_id", "src"])
    w = edge_weight(F.col("weight"), F.col("room_weight")).alias("w")
    return both.select("map_id", "src", "dst", "key", "special", w, exit_class(F.col("key"), F.col("special")).alias("cls"), "lk", "dst_locked", "src_area", "dst_area", "src_x", "src_y", "src_z", "dst_x", "dst_y", "dst_z")


def walkable(edges: DataFrame, directions: str = "all", avoid_locked: bool = True, is_locked: Column | None = None) -> DataFrame:
    """Edges that a route may take: no locked exit, no locked target, no class that directions rule out."""
    allowed = {"cardinal": 0, "vertical": 1}.get(directions, 2)
    out = edges.filter((F.col("cls") <= allowed) & ~F.col("lk"))
    return out.filter(~(is_locked if is_locked is not None else F.col("dst_locked"))) if avoid_locked else out


def area_distances(edges: DataFrame) -> DataFrame:
    """The least edge weight between each two neighbouring areas."""
    return edges.filter("src_area <> dst_area").groupBy("map_id", "src_area", "dst_area").agg(F.min("w").alias("min_w"))


def astar_scale(edges: DataFrame) -> DataFrame:
    """For each map the longest edge, one at least, and the least weight, which scale a distance to a cost bound."""
    square = lambda a: (F.col(f"dst_{a}") - F.col(f"src_{a}")) * (F.col(f"dst_{a}") - F.col(f"src_{a}"))
    length = F.sqrt((square("x") + square("y") + square("z")).cast("double"))
    return edges.groupBy("map_id").agg(F.greatest(F.max(length), F.lit(1.0)).alias("max_edge"), F.min(F.when(F.abs("w") < float("inf"), F.col("w"))).alias("w")).select("map_id", "max_edge", F.coalesce("w", F.lit(1.0)).alias("min_w"))


def reciprocal(exits: DataFrame) -> DataFrame:
    """Regular exits with ``two_way``: the target has the opposite exit back."""
    own = exits.filter(~F.col("special")).withColumn("back", opposite(F.col("key")))
    back = own.select("map_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("key").alias("back"), F.lit(True).alias("_two")).distinct()
    return own.join(back, ["map_id", "src", "dst", "back"], "left").withColumn("two_way", F.coalesce("_two", F.lit(False))).drop("_two", "back")


def missing_suppressors(lines: DataFrame, exits: DataFrame, rooms: DataFrame) -> DataFrame:
    """room_a, key, room_b, opposite: lines whose way back draws a second, unsuppressed line.

    ``lines`` has map_id, room_id, key and points; a line without points suppresses.
    """
    drawn = lines.filter((F.size("points") > 0) & (direction_number(F.col("key")) <= 8)).select("map_id", F.col("room_id").alias("src"), "key")
    two = reciprocal(exits).filter("two_way").select("map_id", "src", "key", "dst")
    place = lambda p: rooms.select("map_id", F.col("id").alias(p), F.col("area_id").alias(f"{p}_area"), F.col("z").alias(f"{p}_z"))
    found = drawn.join(two, ["map_id", "src", "key"]).join(place("src"), ["map_id", "src"]).join(place("dst"), ["map_id", "dst"]).filter("src_area = dst_area and src_z <=> dst_z")
    found = found.select("map_id", F.col("src").alias("room_a"), "key", F.col("dst").alias("room_b"), opposite(F.col("key")).alias("opposite"))
    has = lines.select("map_id", F.col("room_id").alias("room_b"), F.col("key").alias("opposite")).distinct()
    return found.join(has, ["map_id", "room_b", "opposite"], "left_anti")
