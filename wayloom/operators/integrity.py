"""Checksums of rooms, areas and files, and their comparison with stored ones.

A room's hash is that of its canonical bytes; an area's covers its own fields and its rooms'
hashes in the order of their ids; a file's covers the colours and its areas' hashes. Each level
is one grouping. The byte formats are fixed values of the map format.
"""

from __future__ import annotations

import json
import math
import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: the order of directions in canonical bytes, and absent-equal values.
CANONICAL_DIRECTIONS = ["n", "ne", "e", "se", "s", "sw", "w", "nw", "up", "down", "in", "out"]
_RANK = {d: i for i, d in enumerate(CANONICAL_DIRECTIONS)}


def _i32(*values) -> bytes:
    return b"".join((int(v or 0) & 0xFFFFFFFF).to_bytes(4, "little") for v in values)


def _f64(v) -> bytes:
    return bytes.fromhex("000000000000f87f") if v is None or math.isnan(v) else struct.pack("<d", v + 0.0)


def _str(s: str) -> bytes:
    raw = s.encode()
    return _i32(len(raw)) + raw


def _listed(items, each) -> bytes:
    """Nothing for an empty container, else how many and each one."""
    return _i32(len(items)) + b"".join(map(each, items)) if items else b""


def _by_direction(keys):
    return sorted(keys, key=lambda k: (_RANK.get(k, len(_RANK)), k.encode()))


def _pairs(m, value, by=lambda keys: sorted(keys, key=str.encode)) -> bytes:
    m = dict(m or ())
    return _listed(by(m), lambda k: _str(k) + value(m[k]))


def _line(cl: dict) -> bytes:
    out = _i32(len(cl["points"] or ())) + b"".join(_f64(c) for p in cl["points"] or () for c in p[:2])
    if cl["color"] is not None:
        out += b"\x01" + _i32(*cl["color"][:3])
    if cl["style"] not in (None, "solid"):
        out += b"\x01" + _str(cl["style"])
    return out + (b"\x01" if cl["arrow"] else b"")


def room_bytes(r: dict) -> bytes:
    """The canonical bytes of a room; what equals its default is left out."""
    text = sorted
    parts = [
        b"r4", _i32(r["id"], r["x"], r["y"], r["z"], r["env"]),
        b"" if r["weight"] in (None, 1) else _i32(r["weight"]), *(b"\x01" for flag in ("locked", "hidden") if r[flag]), *(_str(r[c]) for c in ("symbol", "name", "notes") if r[c]),
        _pairs(r["exits"], _i32, _by_direction), _listed(_by_direction(set(r["exit_locks"] or ())), _str), _pairs(r["doors"], _str, _by_direction), _listed(_by_direction(set(r["stubs"] or ())), _str),
        _pairs(r["special_exits"], _i32), _listed(text(r["special_exit_locks"] or (), key=str.encode), _str), _pairs(r["exit_weights"], _i32, _by_direction),
        _pairs(r["custom_lines"], _line), _listed(text(r["tags"] or (), key=str.encode), _str), _pairs(r["user_data"], _str), _str(r["hash"]) if r["hash"] else b"",
    ]
    return b"".join(parts)


def _label(b: dict) -> bytes:
    colors = b"".join(_i32(len(c)) + _i32(*c) for c in (b["fg_color"] or [0, 0, 0], b["bg_color"] or [0, 0, 0]))
    flags = bytes([bool(b["show_on_top"]), bool(b["no_scaling"])])
    return _i32(b["id"]) + _f64(b["x"]) + _f64(b["y"]) + _i32(b["z"]) + _f64(b["width"]) + _f64(b["height"]) + _str(b["text"] or "") + colors + flags + (b"\x01" + _str(b["pixmap"]) if b["pixmap"] else b"\x00")


def area_bytes(a: dict) -> bytes:
    flags = b"".join(bytes([a[c]]) for c in ("grid_mode", "is_zone") if a[c] is not None)
    ref = _i32(a["zone_area_ref"]) if a["zone_area_ref"] is not None else b""
    pos = _i32(*a["pos"][:3]) if a["pos"] is not None else b""
    labels = sorted(a["labels"] or (), key=lambda b: b["id"])
    hashes = [h["hash"] for h in a["hashes"] or ()]
    return b"a4" + _i32(a["id"]) + _str(a["name"] or "") + flags + ref + pos + _listed(labels, _label) + _pairs(a["user_data"], _str) + _i32(len(hashes)) + b"".join(bytes.fromhex(h)[::-1] for h in hashes)


def file_bytes(d: dict) -> bytes:
    env = sorted((int(k), v) for k, v in d["env_colors"] or ())
    own = sorted((int(k), v) for k, v in d["custom_env_colors"] or ())
    hashes = [h["hash"] for h in d["hashes"] or ()]
    return b"f4" + _i32(len(env)) + b"".join(_i32(*p) for p in env) + _i32(len(own)) + b"".join(_i32(k) + bytes([len(v)]) + _i32(*v) for k, v in own) + _i32(len(hashes)) + b"".join(bytes.fromhex(h)[::-1] for h in hashes)


def _value(v) -> bytes:
    """A JSON value: a byte for its kind, then what it holds; keys in the order of their bytes."""
    if v is None or isinstance(v, bool):
        return bytes([0 if v is None else 1 + v])
    if isinstance(v, (int, float)):
        small = float(v).is_integer() and -(2**31) <= v < 2**31
        return b"\x03" + _i32_signed(int(v)) if small else b"\x04" + _f64(float(v))
    if isinstance(v, str):
        return b"\x05" + _str(v)
    if isinstance(v, list):
        return b"\x06" + _i32(len(v)) + b"".join(map(_value, v))
    return b"\x07" + _members(v)


def _i32_signed(v: int) -> bytes:
    return struct.pack("<i", v)


def _members(v: dict) -> bytes:
    return _i32(len(v)) + b"".join(_str(k) + _value(v[k]) for k in sorted(v, key=str.encode))


def meta_bytes(r: dict) -> bytes:
    """The canonical bytes of a document's meta object, given as JSON text; any that isn't an object counts as an empty one."""
    v = json.loads(r["meta"]) if r["meta"] else {}
    return b"m4" + _members(v if isinstance(v, dict) else {})


def meta_checksums(metas: DataFrame) -> DataFrame:
    """map_id, level (meta), id and hash of meta objects (map_id and ``meta``, JSON text)."""
    return hashed(metas.select("map_id", "meta"), ["map_id"], meta_bytes).select("map_id", F.lit("meta").alias("level"), F.lit("").alias("id"), "hash")


def hashed(df: DataFrame, keys: list[str], encode) -> DataFrame:
    """keys and ``hash``, the XXH3-64 of each row's canonical bytes as 16 hex digits."""

    def run(batches):
        for b in batches:
            h = [xxhash.xxh3_64_hexdigest(encode(r)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(h, pa.string())], names=[*keys, "hash"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.mapInArrow(run, f"{kinds}, hash string")


def checksums(documents: DataFrame) -> DataFrame:
    """map_id, level (room, area, file), id and hash of every part of every document."""
    area = documents.select("map_id", F.explode("areas").alias("a"))
    rooms = hashed(area.select("map_id", F.col("a.id").alias("area_id"), F.explode("a.rooms").alias("r")).select("map_id", "area_id", "r.*"), ["map_id", "area_id", "id"], room_bytes)
    in_order = F.sort_array(F.collect_list(F.struct("id", "hash"))).alias("hashes")
    of_area = rooms.groupBy("map_id", F.col("area_id").alias("id")).agg(in_order)
    areas = hashed(area.select("map_id", "a.*").drop("rooms").join(of_area, ["map_id", "id"], "left"), ["map_id", "id"], area_bytes)
    of_file = areas.groupBy("map_id").agg(in_order)
    files = hashed(documents.select("map_id", "colors.env_colors", "colors.custom_env_colors").join(of_file, "map_id", "left"), ["map_id"], file_bytes)
    as_id = lambda c: F.col(c).cast("string").alias("id")
    return rooms.select("map_id", F.lit("room").alias("level"), as_id("id"), "hash").unionByName(areas.select("map_id", F.lit("area").alias("level"), as_id("id"), "hash")).unionByName(files.select("map_id", F.lit("file").alias("level"), F.lit("").alias("id"), "hash"))


def signed(documents: DataFrame) -> DataFrame:
    """Documents whose ``checksums`` hold the sums of what they have now, of known meta fields too."""
    sums = checksums(documents).unionByName(meta_checksums(documents.select("map_id", F.to_json("meta").alias("meta"))))
    entries = lambda level: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("level") == level, F.struct("id", "hash"))))).alias(f"{level}s")
    by_map = sums.groupBy("map_id").agg(F.max(F.when(F.col("level") == "file", F.col("hash"))).alias("file"), F.max(F.when(F.col("level") == "meta", F.col("hash"))).alias("meta_sum"), entries("area"), entries("room"))
    both = documents.join(by_map.withColumnsRenamed({"areas": "areas_sums", "rooms": "rooms_sums"}), "map_id")
    return both.withColumn("checksums", F.struct(F.lit("v4").alias("alg"), F.col("file").alias("file"), F.col("meta_sum").alias("meta"), F.col("areas_sums").alias("areas"), F.col("rooms_sums").alias("rooms"))).drop("file", "meta_sum", "areas_sums", "rooms_sums")


def stored_checksums(documents: DataFrame) -> DataFrame:
    """The checksums that documents bring with them, in the same shape."""
    level = lambda n: documents.select("map_id", F.lit(n).alias("level"), F.explode(f"checksums.{n}s").alias("id", "hash"))
    return level("room").unionByName(level("area")).unionByName(documents.filter("checksums.file is not null").select("map_id", F.lit("file").alias("level"), F.lit("").alias("id"), F.col("checksums.file").alias("hash")))


def verified(stored: DataFrame, computed: DataFrame, key: list[str]) -> DataFrame:
    """key and verdict: bad (hashes differ), missing (no stored hash) or extra (nothing to hash); equal ones are left out."""
    both = stored.select(*key, F.col("hash").alias("stored")).join(computed.select(*key, F.col("hash").alias("computed")), key, "full_outer")
    verdict = F.when(F.col("stored").isNull(), "missing").when(F.col("computed").isNull(), "extra").when(F.col("stored") != F.col("computed"), "bad")
    return both.select(*key, verdict.alias("verdict")).filter("verdict is not null")


def rollup_md5(rows: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """An ordered rollup with Spark's own hash: by, n and the md5 of the rows' md5s in order."""
    each = rows.select(*by, order, F.md5(F.col(text)).alias("h"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), "")
    return each.groupBy(*by).agg(F.count("*").alias("n"), F.md5(joined).alias("hash"))
