"""Display model: colours, exit classes, level of detail, geometry and raster cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.operators.ordering import tasks_for
from wayloom.schema import direction_number, opposite

# Fixed values of the palette and of the tiers.
SYSTEM_COLORS = [(0, 0, 0), (128, 0, 0), (0, 128, 0), (128, 128, 0), (0, 0, 128), (128, 0, 128), (0, 128, 128), (192, 192, 192), (128, 128, 128), (255, 0, 0), (0, 255, 0), (255, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 255, 255)]
CUBE_LEVELS = (0, 95, 135, 175, 215, 255)
DEFAULT_COLOR = (114, 1, 0)
LINE_ALPHA, ROOM_ALPHA, LINE_RGB = 140, 255, (225, 225, 225)


def palette() -> list[tuple[int, int, int]]:
    """The 256 colours: system, a 6x6x6 cube, greys."""
    cube = [(CUBE_LEVELS[i // 36], CUBE_LEVELS[i // 6 % 6], CUBE_LEVELS[i % 6]) for i in range(216)]
    return SYSTEM_COLORS + cube + [(8 + 10 * i,) * 3 for i in range(24)]


def palette_of(env: Column) -> Column:
    """The colour that an env number stands for itself; 8 and 16 stand for 0 and 8, others outside 1 to 255 for none."""
    table = F.array(*(F.array(*map(F.lit, c)) for c in palette()))
    at = F.when(env == 8, 0).when(env == 16, 8).otherwise(env)
    return F.when(env.between(1, 255), F.try_element_at(table, (at + 1).cast("int")))


def colored(rooms: DataFrame, env_colors: DataFrame, custom_colors: DataFrame) -> DataFrame:
    """Rooms with ``rgb``: the map's own colour of the env, its ANSI colour, the palette's, or the default.

    Colour tables without map_id hold for all maps.
    """
    key = lambda df: [c for c in ("map_id", "env") if c in df.columns]
    ansi = env_colors.select(*key(env_colors), F.col("ansi").alias("_ansi"))
    own = custom_colors.select(*key(custom_colors), F.col("rgb").alias("_rgb"))
    out = rooms.join(ansi, key(env_colors), "left").join(own, key(custom_colors), "left")
    rgb = F.coalesce(F.col("_rgb"), palette_of(F.col("_ansi")), palette_of(F.col("env")), F.array(*map(F.lit, DEFAULT_COLOR)))
    return out.withColumn("rgb", rgb).drop("_ansi", "_rgb")


def contrast(rgb: Column) -> Column:
    """Dark on light colours, white on dark ones."""
    light = rgb[0] * F.lit(0.299) + rgb[1] * F.lit(0.587) + rgb[2] * F.lit(0.114)
    return F.when(light > 140, "#111").otherwise("#fff")


def exit_kinds(exits: DataFrame, rooms: DataFrame, lines: DataFrame) -> DataFrame:
    """Regular exits with ``kind``: custom, suppressed, skip, udio, cross (unknown targets too), crossZ, oneway or line; the first that applies."""
    line = lines.select("map_id", F.col("room_id").alias("src"), "key", (F.size("points") > 0).alias("drawn"))
    place = lambda p: rooms.select("map_id", F.col("id").alias(p), F.col("area_id").alias(f"{p}_area"), F.coalesce("z", F.lit(0)).alias(f"{p}_z"))
    normal, n = exits.filter(~F.col("special")), tasks_for(rooms)
    back = normal.select("map_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("key").alias("back"), F.lit(True).alias("two")).distinct()
    out = normal.withColumn("back", opposite(F.col("key"))).repartition(n, "map_id", "src", "key").join(line, ["map_id", "src", "key"], "left").repartition(n, "map_id", "src").join(place("src"), ["map_id", "src"])
    out = out.repartition(n, "map_id", "dst").join(place("dst"), ["map_id", "dst"], "left").repartition(n, "map_id", "src", "dst", "back").join(back, ["map_id", "src", "dst", "back"], "left")
    idx = direction_number(F.col("key"))
    kind = F.when(F.col("drawn"), "custom").when(~F.col("drawn"), "suppressed").when(idx.isNull(), "skip").when(idx > 8, "udio").when(F.col("dst_area").isNull() | (F.col("dst_area") != F.col("src_area")), "cross").when(F.col("dst_z") != F.col("src_z"), "crossZ").when(F.col("two").isNull(), "oneway").otherwise("line")
    return out.select("map_id", "src", "key", "dst", kind.alias("kind"))


def level_of_detail(cell_px: Column, n_rooms: Column, visible: Column) -> Column:
    """full, roomsOnly or raster."""
    return F.when((cell_px >= 9) | (F.least(n_rooms, visible) <= 200), "full").when(cell_px < 3, "raster").otherwise("roomsOnly")


def bounds(rooms: DataFrame, by: list[str]) -> DataFrame:
    """The box of rooms' places, y downwards, and how many levels it has."""
    y = -F.col("y")
    return rooms.groupBy(*by).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count_distinct("z").alias("n_levels"), F.count("*").alias("n_rooms"))


def raster_cells(rooms: DataFrame, kinds: DataFrame) -> DataFrame:
    """map_id, area_id, z, x, y, layer (1 line, 2 room), rgb and alpha: the cells of each plane; ``rooms`` have ``rgb``.

    ``kinds`` are the exits of ``exit_kinds``; those of kind line and oneway are drawn. A line's
    cells come from stepping its longer axis, rounded half up; a two-way exit is drawn
    once, from the lower id. Rooms cover lines, and of rooms in one cell the last one is seen.
    """
    p = lambda n: rooms.select("map_id", F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("area_id", "x", "y", "z")))
    on_plane = kinds.filter(F.col("kind").isin("line", "oneway")).join(p("src"), ["map_id", "src"]).join(p("dst"), ["map_id", "dst"])
    pairs = on_plane.select("map_id", F.col("src_area_id").alias("area_id"), F.col("src_z").alias("z"), *(F.when(F.col("src") < F.col("dst"), F.col(f"src_{c}")).otherwise(F.col(f"dst_{c}")).alias(f"{c}0") for c in ("x", "y")), *(F.when(F.col("src") < F.col("dst"), F.col(f"dst_{c}")).otherwise(F.col(f"src_{c}")).alias(f"{c}1") for c in ("x", "y"))).distinct()
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    step = pairs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda c: (F.col(f"{c}0") + F.floor((2 * F.col("i") * (F.col(f"{c}1") - F.col(f"{c}0")) + F.col("n")) / F.greatest(2 * F.col("n"), F.lit(1)))).cast("int").alias(c)
    cells = step.select("map_id", "area_id", "z", at("x"), at("y"), F.struct(F.lit(1).alias("layer"), F.lit(0).cast("long").alias("nth"), F.array(*map(F.lit, LINE_RGB)).alias("rgb")).alias("c"))
    cells = cells.unionByName(rooms.select("map_id", "area_id", "z", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.struct(F.lit(2).alias("layer"), F.col("room_ord").cast("long").alias("nth"), "rgb").alias("c")))
    top = cells.groupBy("map_id", "area_id", "z", "x", "y").agg(F.max("c").alias("c")).select("map_id", "area_id", "z", "x", "y", "c.layer", "c.rgb")
    return top.withColumn("alpha", F.when(F.col("layer") == 1, LINE_ALPHA).otherwise(ROOM_ALPHA))


def cross_area_exits(exits: DataFrame, rooms: DataFrame) -> DataFrame:
    """Exits between areas with their code: the direction's number, 13 for special ones."""
    area = lambda n: rooms.select("map_id", F.col("id").alias(n), F.col("area_id").alias(f"{n}_area"))
    both = exits.join(area("src"), ["map_id", "src"]).join(area("dst"), ["map_id", "dst"]).filter("src_area <> dst_area")
    return both.select("map_id", "src_area", "src", "dst_area", "dst", F.when(F.col("special"), 13).otherwise(direction_number(F.col("key"))).cast("int").alias("code"))


def plane(rooms: DataFrame, area_id: int, z: int | None = None) -> DataFrame:
    """The rooms of an area, or of one level of it; an absent z is 0."""
    out = rooms.filter(F.col("area_id") == area_id)
    return out if z is None else out.filter(F.coalesce("z", F.lit(0)) == z)
