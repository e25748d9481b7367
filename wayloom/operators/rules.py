"""Checks of map tables: each rule gives rows (map_id, path, code), and all are united."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.schema import DIRECTIONS, DOORS, FORMAT_VERSION, LINE_STYLES
from wayloom.sources.json_map import MapTables

_KEYS = [d[0] for d in DIRECTIONS]


def is_color(c: Column) -> Column:
    """Three or four bytes."""
    return F.size(c).isin(3, 4) & F.forall(c, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def repeats(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Every row whose key an earlier row has."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth > 1").drop("_nth")


def dangling(exits: DataFrame, rooms: DataFrame) -> DataFrame:
    """Exits whose target isn't a room of the map."""
    return exits.join(rooms.select("map_id", F.col("id").alias("dst")), ["map_id", "dst"], "left_anti")


def each(df: DataFrame, rules: list[tuple[Column, Column, str]]) -> DataFrame:
    """One row for each rule (it fails, path, code) that a row of df breaks; one pass for all rules."""
    found = F.filter(F.array(*(F.when(fails, F.struct(path.alias("path"), F.lit(code).alias("code"))) for fails, path, code in rules)), lambda x: x.isNotNull())
    return df.select("map_id", F.explode(found).alias("e")).select("map_id", "e.path", "e.code")


def room_rules(rooms: DataFrame) -> DataFrame:
    at = lambda f: F.concat(F.lit("rooms["), F.coalesce(F.col("id").cast("string"), F.lit("?")), F.lit(f"].{f}"))
    return each(rooms, [
        *((F.col(c).isNull(), at(c), "MUST_BE_INTEGER") for c in ("id", "x", "y", "z", "env")),
        (F.col("weight") < 1, at("weight"), "MUST_BE_POSITIVE_INTEGER"),
        (F.size("stubs") > F.size(F.array_distinct("stubs")), at("stubs"), "DUPLICATE_DIRECTION"),
        (F.exists("stubs", lambda d: ~d.isin(_KEYS)), at("stubs"), "INVALID_DIRECTION"),
        (F.size("exit_locks") > F.size(F.array_distinct("exit_locks")), at("exit_locks"), "DUPLICATE_DIRECTION"),
        (F.exists("exit_locks", lambda d: ~d.isin(_KEYS)), at("exit_locks"), "INVALID_DIRECTION"),
        (F.exists("tags", lambda t: t.isNull()), at("tags"), "ELEMENTS_MUST_BE_STRINGS"), *data_rules(rooms, at("user_data")),
        (F.exists("special_exit_locks", lambda c: ~F.array_contains(F.coalesce(F.map_keys("special_exits"), F.array().cast("array<string>")), c)), at("special_exit_locks"), "NOT_IN_SPECIAL_EXITS"),
    ])


def entry_rules(rooms: DataFrame) -> DataFrame:
    """Rules on the entries of a room's maps."""
    at = lambda field: F.concat(F.lit("rooms["), F.col("id").cast("string"), F.lit(f"].{field}."), F.col("key"))
    of = lambda c: rooms.select("map_id", "id", "exits", "special_exits", F.explode(c).alias("key", "value"))
    known = F.coalesce(F.map_contains_key("exits", F.col("key")), F.lit(False)) | F.coalesce(F.map_contains_key("special_exits", F.col("key")), F.lit(False))
    in_exits = F.coalesce(F.map_contains_key("exits", F.col("key")), F.lit(False))
    parts = [
        each(of("exits"), [(~F.col("key").isin(_KEYS), at("exits"), "INVALID_DIRECTION"), (F.col("value").isNull(), at("exits"), "TARGET_MUST_BE_INTEGER")]),
        each(of("special_exits"), [(F.trim("key") == "", at("special_exits"), "SPECIAL_EXIT_CMD_NONEMPTY"), (F.col("value").isNull(), at("special_exits"), "TARGET_MUST_BE_INTEGER"), (F.col("key").isin(_KEYS) & in_exits, at("special_exits"), "SPECIAL_EXIT_OVERLAPS_EXIT")]),
        each(of("exit_weights"), [(~known, at("exit_weights"), "NOT_IN_EXITS"), (F.col("value").isNull() | (F.col("value") < 1) | (F.col("value") != F.floor("value")), at("exit_weights"), "MUST_BE_POSITIVE_INTEGER")]),
        each(of("doors"), [(~F.col("value").isin(DOORS) | F.col("value").isNull(), at("doors"), "INVALID_DOOR_VALUE")]),
        each(of("custom_lines"), [
            (F.col("value.points").isNull(), at("custom_lines"), "MUST_BE_ARRAY"), (F.exists("value.points", lambda p: (F.size(p) != 2) | ~finite(p[0]) | ~finite(p[1])), at("custom_lines"), "MUST_BE_COORD_PAIR"),
            (~is_color(F.col("value.color")), at("custom_lines"), "MUST_BE_RGB"), (~F.col("value.style").isin(LINE_STYLES), at("custom_lines"), "INVALID_CL_STYLE"), (~known, at("custom_lines"), "KEY_NOT_IN_EXITS"),
        ]),
    ]
    return reduce(DataFrame.unionByName, parts)


def label_rules(labels: DataFrame) -> DataFrame:
    at = lambda f: F.concat(F.lit("labels["), F.coalesce(F.col("id").cast("string"), F.lit("?")), F.lit(f"].{f}"))
    return each(labels, [
        (F.col("id").isNull(), at("id"), "MUST_BE_INTEGER"), (F.col("z").isNull(), at("z"), "MUST_BE_INTEGER"), *((~finite(F.col(c)), at(c), "MUST_BE_NUMBER") for c in ("x", "y", "width", "height")),
        (F.col("text").isNull(), at("text"), "MUST_BE_STRING"), *((~F.coalesce(is_color(F.col(c)), F.lit(False)), at(c), "MUST_BE_RGB") for c in ("fg_color", "bg_color")),
        (F.length("pixmap") > 4_194_304, at("pixmap"), "PIXMAP_TOO_LARGE"), (~F.col("pixmap").rlike("^[A-Za-z0-9+/]*={0,2}$"), at("pixmap"), "MUST_BE_BASE64"),
    ])


def data_rules(df: DataFrame, at: Column, field: str = "user_data") -> list[tuple[Column, Column, str]]:
    """A dictionary of texts: no value may be absent."""
    return [(F.exists(F.map_values(field), lambda v: v.isNull()), at, "USER_DATA_STRING_DICT")]


def area_rules(areas: DataFrame) -> DataFrame:
    at = lambda f: F.concat(F.lit("areas["), F.coalesce(F.col("id").cast("string"), F.lit("?")), F.lit(f"].{f}"))
    return each(areas, [
        (F.col("id").isNull(), at("id"), "MUST_BE_INTEGER"), (F.col("name").isNull(), at("name"), "MUST_BE_STRING"),
        (F.col("pos").isNotNull() & ((F.size("pos") != 3) | F.exists("pos", lambda p: p.isNull())), at("pos"), "MUST_BE_POS3"), *data_rules(areas, at("user_data")),
    ])


def meta_rules(documents: DataFrame) -> DataFrame:
    """Rules on a document's meta object, its font and its table of room hashes; none where there is no meta."""
    at = lambda f: F.lit(f"meta.{f}")
    absent = lambda f: F.col("meta.symbol_font").isNotNull() & F.col(f"meta.symbol_font.{f}").isNull()
    font = [(absent("family"), "family", "MUST_BE_STRING"), *((absent(f), f, "MUST_BE_NUMBER") for f in ("point_size", "pixel_size")), *((absent(f), f, "MUST_BE_INTEGER") for f in ("style_hint", "weight")), *((absent(f), f, "MUST_BE_BOOLEAN") for f in ("style_setting", "underline", "strike_out", "fixed_pitch"))]
    return each(documents.filter("meta is not null"), [
        (F.col("meta.map_name").isNull(), at("map_name"), "MUST_BE_STRING"), (F.col("meta.symbol_font").isNull(), at("symbol_font"), "REQUIRED"), *((fails, at(f"symbol_font.{f}"), code) for fails, f, code in font),
        (F.col("meta.symbol_font_fudge_factor").isNull(), at("symbol_font_fudge_factor"), "MUST_BE_NUMBER"), (F.col("meta.use_only_map_font").isNull(), at("use_only_map_font"), "MUST_BE_BOOLEAN"),
        (F.exists(F.map_values("meta.room_id_hash"), lambda v: v.isNull()), at("room_id_hash"), "MUST_BE_INTEGER"), *data_rules(documents, at("user_data"), "meta.user_data"),
    ])


def document_rules(documents: DataFrame, format_name: str) -> DataFrame:
    at = F.lit
    return each(documents, [
        (~F.coalesce(F.col("format") == format_name, F.lit(False)), at("format"), "INVALID_FORMAT"), (~F.coalesce(F.col("format_version") == FORMAT_VERSION, F.lit(False)), at("format_version"), "INVALID_FORMAT_VERSION"),
        (F.col("meta").isNull(), at("meta"), "REQUIRED"), (F.col("colors").isNull(), at("colors"), "REQUIRED"), (F.col("areas").isNull(), at("areas"), "MUST_BE_ARRAY"),
    ])


def color_rules(documents: DataFrame) -> DataFrame:
    """One row for each colour that is none."""
    of = lambda field: documents.select("map_id", F.explode(f"colors.{field}").alias("key", "value"))
    at = lambda field: F.concat(F.lit(f"colors.{field}."), F.col("key"))
    env = each(of("env_colors"), [(~F.coalesce(F.col("value").between(0, 255), F.lit(False)), at("env_colors"), "MUST_BE_BYTE")])
    return env.unionByName(each(of("custom_env_colors"), [(~F.coalesce(is_color(F.col("value")), F.lit(False)), at("custom_env_colors"), "MUST_BE_RGBA")]))


def reference_rules(exits: DataFrame, rooms: DataFrame) -> DataFrame:
    """Exits to rooms that aren't in the map."""
    path = F.concat(F.lit("rooms["), F.col("src").cast("string"), F.when(F.col("special"), F.lit("].special_exits.")).otherwise(F.lit("].exits.")), F.col("key"))
    return dangling(exits.filter("dst is not null"), rooms).select("map_id", path.alias("path"), F.lit("TARGET_NOT_FOUND").alias("code"))


def unique_rules(areas: DataFrame, rooms: DataFrame, labels: DataFrame) -> DataFrame:
    """Every area, room and label whose id an earlier one has."""
    at = lambda kind: F.concat(F.lit(f"{kind}["), F.col("id").cast("string"), F.lit("].id")).alias("path")
    row = lambda df, kind, code: df.select("map_id", at(kind), F.lit(code).alias("code"))
    return row(repeats(areas, ["map_id", "id"], ["area_ord"]), "areas", "DUPLICATE_AREA_ID").unionByName(row(repeats(rooms, ["map_id", "id"], ["area_ord", "room_ord"]), "rooms", "DUPLICATE_ROOM_ID")).unionByName(row(repeats(labels, ["map_id", "area_id", "id"], ["label_ord"]), "labels", "DUPLICATE_LABEL_ID"))


def violations(t: MapTables, format_name: str) -> DataFrame:
    """map_id, path and code of every broken rule of documents, areas, rooms, labels and references."""
    parts = [
        document_rules(t.documents, format_name), meta_rules(t.documents), color_rules(t.documents), area_rules(t.areas), room_rules(t.rooms), entry_rules(t.rooms), label_rules(t.labels),
        unique_rules(t.areas, t.rooms, t.labels), reference_rules(t.exits, t.rooms),
    ]
    return reduce(DataFrame.unionByName, parts)


def verdicts(found: DataFrame) -> DataFrame:
    """map_id, errors and warnings of maps that have any."""
    warning = F.col("code") == "SPECIAL_EXIT_OVERLAPS_EXIT"
    return found.groupBy("map_id").agg(F.count_if(~warning).alias("errors"), F.count_if(warning).alias("warnings"))
