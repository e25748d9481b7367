"""JSON map documents as tables, and tables as documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.text import canonical_json
from wayloom.operators.canonical import stripped_struct
from wayloom.schema import FORMAT_VERSION, MAP


@dataclass
class MapTables:
    """The tables of one or more map documents, all keyed by map_id."""

    documents: DataFrame
    areas: DataFrame
    rooms: DataFrame
    exits: DataFrame
    labels: DataFrame
    lines: DataFrame
    env_colors: DataFrame
    custom_colors: DataFrame
    legs: DataFrame


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of path, with map_id (its file) and the format's columns.

    A file that isn't a JSON object fails when it is read.
    """
    docs = spark.read.schema(MAP).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.select(F.col("_metadata.file_name").alias("map_id"), "*")


def canonical_documents(documents: DataFrame) -> DataFrame:
    """map_id and text: each document in its canonical text.

    Areas, rooms and labels stand in the order of their ids, and fields of rooms that equal their
    defaults are left out, as are absent fields.
    """
    by_id = lambda xs: F.array_sort(xs, lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    area = documents.schema["areas"].dataType.elementType
    fields = area["rooms"].dataType.elementType.fieldNames()
    part = {"rooms": lambda a: F.transform(by_id(a["rooms"]), lambda r: stripped_struct(r, fields)), "labels": lambda a: by_id(a["labels"])}
    areas = F.transform(by_id(F.col("areas")), lambda a: F.struct(*((part[c](a) if c in part else a[c]).alias(c) for c in area.fieldNames())))
    out = documents.withColumn("areas", areas)
    return out.select("map_id", canonical_json(F.to_json(F.struct(*(c for c in documents.columns if c != "map_id")))).alias("text"))


def write_maps(documents: DataFrame, path: str) -> None:
    """Documents in canonical text, a file for each partition; one document a file needs as many partitions."""
    canonical_documents(documents).select("text").write.mode("overwrite").option("lineSep", "\n").text(path)


def empty_map(spark: SparkSession, format_name: str, name: str = "New map") -> DataFrame:
    """A document of the named format without areas that validates."""
    flags = ("style_setting", "underline", "strike_out", "fixed_pitch")
    font = F.struct(F.lit("monospace").alias("family"), F.lit(10.0).alias("point_size"), F.lit(-1.0).alias("pixel_size"), F.lit(5).alias("style_hint"), F.lit(50).alias("weight"), *(F.lit(False).alias(f) for f in flags))
    empty = lambda kind: F.expr("map_from_arrays(array(), array())").cast(kind)
    return spark.range(1).select(
        F.lit("new").alias("map_id"), F.lit(format_name).alias("format"), F.lit(FORMAT_VERSION).alias("format_version"),
        F.struct(F.lit(name).alias("map_name"), font.alias("symbol_font"), F.lit(1.0).alias("symbol_font_fudge_factor"), F.lit(False).alias("use_only_map_font"), empty("map<string,int>").alias("room_id_hash"), empty("map<string,string>").alias("user_data")).alias("meta"),
        F.struct(empty("map<string,int>").alias("env_colors"), empty("map<string,array<int>>").alias("custom_env_colors")).alias("colors"),
        F.expr("array()").cast("array<struct<id:int,name:string>>").alias("areas"),
    )


def exploded(documents: DataFrame) -> MapTables:
    """The tables of documents, with the places of areas and rooms in them."""
    area = documents.select("map_id", F.posexplode("areas").alias("area_ord", "a"))
    named = F.coalesce(F.when(F.col("a.name") != "", F.col("a.name")), F.col("a.id").cast("string"))
    room = area.select("map_id", F.col("a.id").alias("area_id"), named.alias("area_name"), F.coalesce("a.name", F.lit("")).alias("area_title"), "area_ord", F.posexplode("a.rooms").alias("room_ord", "r"))
    rooms = room.select("map_id", "area_id", "area_name", "area_title", "area_ord", "room_ord", "r.*")
    return MapTables(
        documents=documents,
        areas=area.select("map_id", "area_ord", "a.*").drop("rooms", "labels"),
        rooms=rooms,
        exits=exits_of(rooms),
        labels=area.select("map_id", F.col("a.id").alias("area_id"), F.posexplode("a.labels").alias("label_ord", "l")).select("map_id", "area_id", "label_ord", "l.*"),
        lines=rooms.select("map_id", "area_id", F.col("id").alias("room_id"), F.explode("custom_lines").alias("key", "line")).select("map_id", "area_id", "room_id", "key", "line.*"),
        env_colors=documents.select("map_id", F.explode("colors.env_colors").alias("env", "ansi")),
        custom_colors=documents.select("map_id", F.explode("colors.custom_env_colors").alias("env", "rgb")),
        legs=documents.select("map_id", F.explode("transports.lines").alias("l")).select("map_id", F.col("l.name").alias("line"), F.col("l.board").alias("board"), F.col("l.exit").alias("exit_command"), F.posexplode("l.legs").alias("pos", "g")).select("map_id", "line", "board", "exit_command", "pos", F.col("g.from").alias("src"), F.col("g.to").alias("dst"), F.col("g.time").alias("time"), F.col("g.label").alias("label")),
    )


def exits_of(rooms: DataFrame) -> DataFrame:
    """A row for each exit and special exit of each room, regular ones first."""
    normal = rooms.select("map_id", F.col("id").alias("src"), "exit_weights", F.col("exit_locks").alias("locks"), F.posexplode("exits").alias("pos", "key", "dst"), F.lit(False).alias("special"))
    special = rooms.select("map_id", F.col("id").alias("src"), "exit_weights", F.col("special_exit_locks").alias("locks"), F.posexplode("special_exits").alias("pos", "key", "dst"), F.lit(True).alias("special"))
    locked = F.coalesce(F.array_contains("locks", F.col("key")), F.lit(False)).alias("locked")
    return normal.unionByName(special).select("map_id", "src", "key", "dst", "special", "pos", F.try_element_at("exit_weights", F.col("key")).alias("weight"), locked)
