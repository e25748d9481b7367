"""Shapes that a map is drawn with: tables of places in map units, y downwards.

A plane is drawn at ``cell_px`` pixels a map unit. What depends on it alone is a number; what
depends on rooms and exits is a column of their joins by (map_id, room id). Directions of lines
are unit vectors from square roots, so results don't depend on a library's angle functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.operators.display import contrast
from wayloom.operators.ordering import tasks_for
from wayloom.schema import DIRECTIONS, lookup

# Fixed values of the drawing.
CELL_PX, ROOM_SIZE = 18, 0.65
LINE_COLOR, UNKNOWN_COLOR = "rgb(225,225,225)", "#ff9f4a"
DOOR_COLORS = {"open": "rgb(10,155,10)", "closed": "rgb(226,205,59)", "locked": "rgb(155,10,10)"}
DARK_SYMBOL, LIGHT_SYMBOL, LIGHTNESS = "rgb(25,25,25)", "rgb(225,255,255)", 0.41
FADED = 0.35
OWN_LINE_COLOR, FILL_ALPHA = "#aaaaff", 0.6
#: Pixels of dashes and gaps, times the zoom's step.
DASHES = {"dash": (4, 2), "dot": (1, 1), "dash_dot": (8, 3, 1, 3), "dash_dot_dot": (8, 3, 1, 3, 1, 3)}
#: Inner marks of an exit: offsets from the centre, in quarters of a room, and quarter turns.
INNER = {"up": [(0, 1, 0)], "down": [(0, -1, 2)], "in": [(-1, 0, 1), (1, 0, 3)], "out": [(-1, 0, 3), (1, 0, 1)]}
#: Shares of a room's size, with the least pixels: lengths and half widths of arrow heads, the tick of a cross-area arrow and its head, the offset of a shadow.
HEAD_LONG, HEAD_WIDE, TICK, TICK_HEAD, SHADOW = (0.83, 6), (0.29, 3), (0.9, 4), (0.35, 1.5), (0.22, 2)
#: The border of a room and the width of a line, times the zoom, with the least pixels.
BORDER = (0.4875, 0.4)


@dataclass
class Scale:
    """Measures at one size of the cell; a room is two pixels wide at least."""

    cell_px: float

    @property
    def zoom(self) -> float:
        return self.cell_px / CELL_PX

    @property
    def room_px(self) -> float:
        return max(2.0, ROOM_SIZE * self.cell_px)

    def units(self, px: float, least: float = 0.0) -> float:
        return max(least, px) / self.cell_px

    @property
    def half(self) -> float:
        return self.room_px / 2 / self.cell_px

    @property
    def line_width(self) -> float:
        return self.units(self.zoom * BORDER[0], BORDER[1])

    def share(self, of: tuple[float, float]) -> float:
        """A share of the room's size, with the least pixels that it has."""
        return self.units(self.room_px * of[0], of[1])


def css(rgb: Column) -> Column:
    return F.concat(F.lit("rgb("), F.array_join(F.slice(rgb, 1, 3).cast("array<string>"), ","), F.lit(")"))


def step_x(key: Column) -> Column:
    return lookup(key, {d[0]: float(d[3]) for d in DIRECTIONS})


def step_y(key: Column) -> Column:
    """Downwards."""
    return lookup(key, {d[0]: -float(d[4]) if d[4] else 0.0 for d in DIRECTIONS})


def _place(rooms: DataFrame, end: str, *more: str) -> DataFrame:
    return rooms.select("map_id", F.col("id").alias(end), F.col("x").cast("double").alias(f"{end}_x"), (F.lit(0.0) - F.col("y")).alias(f"{end}_y"), *(F.col(c).alias(f"{end}_{c}") for c in more))


def exit_lines(kinds: DataFrame, rooms: DataFrame, cell_px: float = CELL_PX) -> DataFrame:
    """Lines of the exits whose kind is line or oneway, and the arrow heads of the latter.

    A line runs from edge to edge; a one-way exit's is dashed, aims at the target's centre and has
    its head in the middle, down to a zoom of 0.3. head_x and head_y are its tip and two corners.
    """
    s, n = Scale(cell_px), tasks_for(rooms)
    own = kinds.filter(F.col("kind").isin("line", "oneway")).repartition(n, "map_id", "src").join(_place(rooms, "src"), ["map_id", "src"]).repartition(n, "map_id", "dst").join(_place(rooms, "dst"), ["map_id", "dst"])
    one_way, dx, dy = F.col("kind") == "oneway", step_x(F.col("key")), step_y(F.col("key"))
    own = own.withColumns({"one_way": one_way, "x1": F.col("src_x") + dx * s.half, "y1": F.col("src_y") + dy * s.half})
    own = own.withColumns({"x2": F.when(one_way, F.col("dst_x")).otherwise(F.col("dst_x") - dx * s.half), "y2": F.when(one_way, F.col("dst_y")).otherwise(F.col("dst_y") - dy * s.half)})
    run, rise = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    far = F.sqrt(run * run + rise * rise)
    own = own.withColumns({"ux": F.when(far > 0, run / far).otherwise(1.0), "uy": F.when(far > 0, rise / far).otherwise(0.0), "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    long, wide = s.share(HEAD_LONG), s.share(HEAD_WIDE)
    back_x, back_y = F.col("mx") - F.col("ux") * long, F.col("my") - F.col("uy") * long
    headed = F.col("one_way") & F.lit(s.zoom > 0.3)
    head_x = F.when(headed, F.array("mx", back_x - F.col("uy") * wide, back_x + F.col("uy") * wide))
    head_y = F.when(headed, F.array("my", back_y + F.col("ux") * wide, back_y - F.col("ux") * wide))
    dash = F.when(F.col("one_way"), F.array(F.lit(s.units(s.zoom * 1.8, 2)), F.lit(s.units(s.zoom * 0.9, 1)))).otherwise(F.array().cast("array<double>"))
    return own.select("map_id", "src", "key", "dst", "kind", "x1", "y1", "x2", "y2", F.lit(s.line_width).alias("width"), dash.alias("dash"), head_x.alias("head_x"), head_y.alias("head_y"))


def cross_arrows(exits: DataFrame, kinds: DataFrame, rooms: DataFrame, lines: DataFrame, cell_px: float = CELL_PX) -> DataFrame:
    """Arrows at the room's edge for exits to other areas or unknown rooms, in the target's colour.

    ``rooms`` have ``rgb``. A special exit to a known room points along the difference of the
    places, unless a custom line has its key. No arrows below a zoom of 0.25.
    """
    s, n = Scale(cell_px), tasks_for(rooms)
    dst = _place(rooms, "dst", "rgb", "area_id")
    normal = kinds.filter("kind = 'cross'").repartition(n, "map_id", "src").join(_place(rooms, "src"), ["map_id", "src"]).repartition(n, "map_id", "dst").join(dst, ["map_id", "dst"], "left")
    normal = normal.select("map_id", "src", "key", "dst", F.lit(False).alias("special"), "src_x", "src_y", "dst_rgb", step_x(F.col("key")).alias("vx"), step_y(F.col("key")).alias("vy"))
    drawn = lines.select("map_id", F.col("room_id").alias("src"), "key")
    special = exits.filter("special").join(drawn, ["map_id", "src", "key"], "left_anti").repartition(n, "map_id", "src").join(_place(rooms, "src", "area_id"), ["map_id", "src"]).repartition(n, "map_id", "dst").join(dst, ["map_id", "dst"]).filter("src_area_id <> dst_area_id")
    # the difference is taken upwards and used downwards: a fixed trait of the format's drawing
    run, rise = F.col("dst_x") - F.col("src_x"), F.col("src_y") - F.col("dst_y")
    special = special.withColumns({"run": run, "rise": rise}).withColumn("far", F.sqrt(F.col("run") * F.col("run") + F.col("rise") * F.col("rise"))).filter("far > 0")
    special = special.select("map_id", "src", "key", "dst", F.lit(True).alias("special"), "src_x", "src_y", "dst_rgb", (F.col("run") / F.col("far")).alias("vx"), (F.col("rise") / F.col("far")).alias("vy"))
    half, tick, head = ROOM_SIZE / 2, s.share(TICK), s.share(TICK_HEAD)
    both = normal.unionByName(special).filter(F.lit(s.zoom >= 0.25))
    both = both.withColumns({"x1": F.col("src_x") + F.col("vx") * half, "y1": F.col("src_y") + F.col("vy") * half})
    both = both.withColumns({"x2": F.col("x1") + F.col("vx") * tick, "y2": F.col("y1") + F.col("vy") * tick})
    color = F.coalesce(css(F.col("dst_rgb")), F.lit(UNKNOWN_COLOR))
    vx, vy = F.col("vx") * head, F.col("vy") * head
    head_x = F.array(F.col("x2") + vx * 1.2, F.col("x2") - vx - vy * 0.8, F.col("x2") - vx + vy * 0.8)
    head_y = F.array(F.col("y2") + vy * 1.2, F.col("y2") - vy + vx * 0.8, F.col("y2") - vy - vx * 0.8)
    return both.select("map_id", "src", "key", "dst", "special", "x1", "y1", "x2", "y2", F.lit(s.units(s.zoom, 1)).alias("width"), head_x.alias("head_x"), head_y.alias("head_y"), color.alias("color"))


def stubs(rooms: DataFrame, cell_px: float = CELL_PX) -> DataFrame:
    """Half a unit of line for each stub in a compass direction; ``rooms`` have ``stubs``."""
    s = Scale(cell_px)
    each = rooms.select("map_id", "id", F.col("x").cast("double").alias("x"), (F.lit(0.0) - F.col("y")).alias("y"), F.explode("stubs").alias("key"))
    each = each.withColumns({"dx": step_x(F.col("key")), "dy": step_y(F.col("key"))}).filter("dx <> 0 or dy <> 0")
    each = each.withColumns({"x1": F.col("x") + F.col("dx") * s.half, "y1": F.col("y") + F.col("dy") * s.half})
    return each.select("map_id", "id", "key", "x1", "y1", (F.col("x1") + F.col("dx") * 0.5).alias("x2"), (F.col("y1") + F.col("dy") * 0.5).alias("y2"), F.lit(s.line_width).alias("width"))


def stack_shadows(exits: DataFrame, rooms: DataFrame, cell_px: float = CELL_PX) -> DataFrame:
    """Squares behind rooms that have a way up (to the upper right) or down (to the lower left)."""
    s = Scale(cell_px)
    off, size = s.share(SHADOW), s.room_px / s.cell_px
    own = exits.filter(~F.col("special") & F.col("key").isin("up", "down") & (F.col("dst") != 0) & F.lit(s.zoom > 0.3)).join(_place(rooms, "src"), ["map_id", "src"])
    way = F.when(F.col("key") == "up", 1.0).otherwise(-1.0)
    corner = lambda c, sign: F.col(c) - size / 2 + sign * way * off
    return own.select("map_id", F.col("src").alias("id"), "key", corner("src_x", 1.0).alias("x"), corner("src_y", -1.0).alias("y"), F.lit(size).alias("size"), F.lit(round(min(0.7, s.zoom * 0.5), 2)).alias("alpha"), F.lit(s.units(s.zoom * 0.7, 0.5)).alias("width"))


def dash_pattern(style: Column, cell_px: float) -> Column:
    """Dashes and gaps in map units; none for a solid line."""
    s = Scale(cell_px)
    step = s.units(max(1.0, s.zoom * 2))
    out = F.array().cast("array<double>")
    for name, parts in DASHES.items():
        out = F.when(style == name, F.array(*(F.lit(p * step) for p in parts))).otherwise(out)
    return out


def custom_lines(lines: DataFrame, rooms: DataFrame, cell_px: float = CELL_PX) -> DataFrame:
    """Custom lines from the room's centre through all their points; those without points aren't drawn.

    ``lines`` have map_id, room_id, key, points, color, style and arrow, and may have ``door``. A door
    is a square in the middle of the first stretch; an arrow's head spreads 30 degrees to either side.
    """
    s = Scale(cell_px)
    doors = lines if "door" in lines.columns else lines.withColumn("door", F.lit(None).cast("string"))
    own = doors.filter(F.size("points") > 0).join(_place(rooms, "room_id"), ["map_id", "room_id"])
    along = lambda c, i, sign: F.concat(F.array(f"room_id_{c}"), F.transform("points", lambda p: p[i] if sign > 0 else F.lit(0.0) - p[i]))
    own = own.withColumns({"xs": along("x", 0, 1), "ys": along("y", 1, -1)})
    last = lambda c, k: F.element_at(c, F.lit(-k))
    run, rise = last("xs", 1) - last("xs", 2), last("ys", 1) - last("ys", 2)
    far = F.sqrt(run * run + rise * rise)
    own = own.withColumns({"ux": F.when(far > 0, run / far).otherwise(1.0), "uy": F.when(far > 0, rise / far).otherwise(0.0)})
    long, turn = s.units(s.zoom * 10, 8), 3**0.5 / 2
    side = lambda k: (last("xs", 1) - (F.col("ux") * turn + F.col("uy") * (0.5 * k)) * long, last("ys", 1) - (F.col("uy") * turn - F.col("ux") * (0.5 * k)) * long)
    (ax, ay), (bx, by) = side(1), side(-1)
    headed, door = F.coalesce("arrow", F.lit(False)), F.col("door").isNotNull()
    mid = lambda c: F.when(door, (F.element_at(c, 1) + F.element_at(c, 2)) / 2)
    return own.select(
        "map_id", "room_id", "key", "xs", "ys", F.coalesce(css(F.col("color")), F.lit(OWN_LINE_COLOR)).alias("color"), F.lit(s.units(s.zoom * 1.2, 1)).alias("width"), dash_pattern(F.col("style"), cell_px).alias("dash"),
        mid("xs").alias("door_x"), mid("ys").alias("door_y"), F.when(door, F.lit(s.units(s.room_px / 2))).alias("door_side"), F.when(door, F.lit(s.units(s.zoom * 0.8, 1))).alias("door_width"), door_color(F.col("door")).alias("door_color"),
        F.when(headed, F.array(last("xs", 1), ax, bx)).alias("head_x"), F.when(headed, F.array(last("ys", 1), ay, by)).alias("head_y"),
    )


def inner_marks(exits: DataFrame, rooms: DataFrame, cell_px: float = CELL_PX) -> DataFrame:
    """Triangles within rooms for ways up, down, in and out, above a zoom of 0.25; ``rooms`` have ``rgb``, ``exits`` may have ``door``.

    A triangle has radius a fifth of the room, stretched 1.4 by 0.8, and a turn of its own; its
    outline has the door's colour or that of symbols.
    """
    s = Scale(cell_px)
    size = s.room_px / s.cell_px
    corners = [(0.0, -1.0), (3**0.5 / 2, 0.5), (-(3**0.5) / 2, 0.5)]
    turned = {0: lambda x, y: (x, y), 1: lambda x, y: (-y, x), 2: lambda x, y: (-x, -y), 3: lambda x, y: (y, -x)}
    rows = []
    for key, marks in INNER.items():
        for dx, dy, quarter in marks:
            at = [turned[quarter](x * size / 5 * 1.4, y * size / 5 * 0.8) for x, y in corners]
            rows.append((key, [dx * size / 4 + x for x, _ in at], [dy * size / 4 + y for _, y in at]))
    shapes = exits.sparkSession.createDataFrame(rows, "key string, off_x array<double>, off_y array<double>")
    doors = exits if "door" in exits.columns else exits.withColumn("door", F.lit(None).cast("string"))
    own = doors.filter(~F.col("special") & F.lit(s.zoom > 0.25)).join(F.broadcast(shapes), "key").join(_place(rooms, "src", "rgb"), ["map_id", "src"])  # six rows
    ink = symbol_color(F.col("src_rgb"))
    fill = F.concat(F.regexp_replace(F.regexp_replace(ink, r"^rgb", "rgba"), r"\)$", f",{FILL_ALPHA})"))
    moved = lambda off, c: F.transform(off, lambda v: v + F.col(c))
    return own.select("map_id", F.col("src").alias("id"), "key", moved("off_x", "src_x").alias("xs"), moved("off_y", "src_y").alias("ys"), fill.alias("fill"), F.coalesce(door_color(F.col("door")), ink).alias("stroke"), F.lit(s.units(s.zoom * 0.6, 0.5)).alias("width"))


def special_markers(exits: DataFrame, rooms: DataFrame, cell_px: float = CELL_PX) -> DataFrame:
    """A mark at the upper right corner of rooms that have special exits, above a zoom of 0.5; ``rooms`` have ``rgb``."""
    s = Scale(cell_px)
    px = max(6.0, s.room_px * 0.44)
    has = exits.filter(F.col("special") & F.lit(s.zoom > 0.5)).select("map_id", F.col("src").alias("id")).distinct()
    own = rooms.join(has, ["map_id", "id"], "left_semi")
    ink = contrast(F.col("rgb"))
    halo = F.when(ink == "#fff", "rgba(0,0,0,0.7)").otherwise("rgba(255,255,255,0.5)")
    return own.select("map_id", "id", (F.col("x").cast("double") + s.half).alias("x"), (F.lit(0.0) - F.col("y") - s.half).alias("y"), F.lit(s.units(float(int(px + 0.5)))).alias("size"), ink.alias("color"), halo.alias("halo"), F.lit(s.units(px * 0.15, 1)).alias("halo_width"))


def grid_alpha(cell_px: Column) -> Column:
    """The opacity of the grid's lines; none below four pixels a unit."""
    return F.when(cell_px < 4, None).when(cell_px < 15, 0.025).when(cell_px < 30, 0.035).otherwise(0.045)


def door_color(state: Column) -> Column:
    """Any state but open and closed counts as locked; null stays null."""
    return F.when(state.isNotNull(), F.coalesce(lookup(state, DOOR_COLORS), F.lit(DOOR_COLORS["locked"])))


def symbol_color(rgb: Column) -> Column:
    """Dark on rooms whose lightness, halfway between the largest and least part, is over 0.41."""
    parts = F.slice(rgb, 1, 3)
    light = (F.array_max(parts) / F.lit(255.0) + F.array_min(parts) / F.lit(255.0)) / 2
    return F.when(light > LIGHTNESS, DARK_SYMBOL).otherwise(LIGHT_SYMBOL)


def symbols(rooms: DataFrame, cell_px: float = CELL_PX) -> DataFrame:
    """Symbols that are legible: their size in map units and colour; ``rooms`` have ``rgb``.

    One or two characters have seven pixels at least; more must fit into the room. Characters
    beyond the basic plane are one em wide, others 0.6. None at a zoom of 0.8 or less.
    """
    s = Scale(cell_px)
    rounded = lambda share: float(int(s.room_px * share + 0.5))
    n = F.length("symbol")
    wide = n - F.length(F.regexp_replace("symbol", r"[\x{10000}-\x{10FFFF}]", ""))
    ems = wide * F.lit(1.0) + (n - wide) * F.lit(0.6)
    px = F.when(n > 2, F.least(F.lit(rounded(0.52)), F.floor(F.lit(s.room_px) / ems).cast("double"))).when(n > 1, max(7.0, rounded(0.52))).otherwise(max(7.0, rounded(0.7)))
    own = rooms.filter((n > 0) & F.lit(s.zoom > 0.8)).withColumn("px", px).filter("px >= 7")
    return own.select("map_id", "id", "symbol", (F.col("px") / s.cell_px).alias("size"), symbol_color(F.col("rgb")).alias("color"))


def room_squares(rooms: DataFrame, cell_px: float = CELL_PX, hidden_mode: str = "faded") -> DataFrame:
    """Squares of rooms with fill, border and opacity; ``rooms`` have ``rgb`` and ``user_data``.

    Hidden rooms are faded, dashed or, in the mode hide, left out. A room's own border colour
    (#AARRGGBB) and thickness (1 to 10) come before the line colour.
    """
    s = Scale(cell_px)
    at = lambda k: F.col("user_data")[k]
    hidden = F.coalesce(F.lower(at("system.fallback_hidden")) == "true", F.lit(False))
    dashed = hidden & F.lit(hidden_mode == "dashed")
    given, parts = F.nullif(at("room.ui_borderColor"), F.lit("")), r"^\s*#([0-9a-fA-F]{2})([0-9a-fA-F]{6})\s*$"
    alpha, color = F.regexp_extract(given, parts, 1), F.regexp_extract(given, parts, 2)
    border = F.when(~given.rlike(parts), given).when(F.lower(alpha) == "ff", F.concat(F.lit("#"), color)).otherwise(F.concat(F.lit("#"), color, alpha))
    thick = F.regexp_extract(at("room.ui_borderThickness"), r"^\s*([+-]?[0-9]+)", 1).try_cast("double")
    thick = F.coalesce(F.least(F.greatest(thick, F.lit(1.0)), F.lit(10.0)), F.lit(1.0))
    own_px = F.greatest(F.when(dashed, 1.3).otherwise(BORDER[1]), thick * (s.zoom * BORDER[0]))
    px = F.when(given.isNotNull(), own_px).when(dashed, max(1.4, s.zoom * 1.4)).otherwise(max(BORDER[1], s.zoom * BORDER[0]))
    shown = rooms.filter(~hidden) if hidden_mode == "hide" else rooms
    opacity = F.when(hidden & F.lit(hidden_mode == "faded"), FADED).otherwise(1.0)
    return shown.select("map_id", "id", F.col("x").cast("double").alias("x"), (F.lit(0.0) - F.col("y")).alias("y"), F.lit(s.half).alias("half"), css(F.col("rgb")).alias("fill"), F.coalesce(border, F.lit(LINE_COLOR)).alias("border"), (px / s.cell_px).alias("border_width"), opacity.alias("alpha"), dashed.alias("dashed"))
