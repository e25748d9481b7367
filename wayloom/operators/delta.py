"""Delta files: reading, gates on the file, and checks of each operation as relational rules."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.functions.text import canonical_json, json_hash
from wayloom.operators.ordering import numbered
from wayloom.operators.rules import each
from wayloom.schema import DIRECTIONS

# Fixed values of the delta format. Its name, which files bring in ``format``, is an argument of what checks it.
DELTA_VERSION = 3
MAX_OPS, MAX_CHARS = 5_000, 8 * 1024 * 1024
#: type: (required target fields, required payload fields)
OPERATIONS = {
    "ADD_ROOM": ("roomId areaId", "room"),
    "DELETE_ROOM": ("roomId areaId", "room"),
    "EDIT_ROOM": ("roomId", "before after"),
    "EDIT_EXIT": ("roomId", "before after"),
    "PAINT_BATCH": ("", "changes"),
    "MOVE_ROOM": ("roomId", "toX toY toZ"),
    "MOVE_ROOM_TO_AREA": ("roomId", "toAreaId"),
    "ADD_EXIT": ("sourceId dir", "targetId"),
    "DELETE_EXIT": ("roomId dir", ""),
    "DELETE_SPECIAL_EXIT": ("roomId", "cmd"),
    "ADD_AREA": ("areaId", "area"),
    "DELETE_AREA": ("areaId", ""),
    "EDIT_AREA": ("areaId", "name"),
    "ADD_CL": ("roomId dir", "cl"),
    "EDIT_CL": ("roomId dir", "before after"),
    "DELETE_CL": ("roomId dir", ""),
    "DELETE_SUPPRESSOR": ("roomId dir", ""),
    "ADD_SUPPRESSOR": ("roomId dir", ""),
    "AUTO_FIX_SUPPRESSORS": ("", "added removed"),
    "ADD_LABEL": ("areaId", "label"),
    "EDIT_LABEL": ("areaId labelId", "before after"),
    "DELETE_LABEL": ("areaId labelId", "label"),
    "MOVE_LABEL": ("areaId labelId", "toX toY"),
    "RESIZE_LABEL": ("areaId labelId", "toX toY toW toH"),
    "EDIT_ENV_COLOR": ("envId", "newColor"),
}
#: Payload fields that a type may have besides.
OPTIONAL = {
    "MOVE_ROOM": "fromX fromY fromZ",
    "MOVE_ROOM_TO_AREA": "fromAreaId",
    "ADD_EXIT": "bidirectional",
    "DELETE_EXIT": "exitId",
    "DELETE_SPECIAL_EXIT": "targetId",
    "DELETE_AREA": "name",
    "EDIT_AREA": "user_data beforeName beforeUserData",
    "DELETE_CL": "cl",
    "DELETE_SUPPRESSOR": "cl",
    "MOVE_LABEL": "fromX fromY",
    "RESIZE_LABEL": "fromX fromY fromW fromH",
    "EDIT_ENV_COLOR": "oldColor",
}
TOP_KEYS, OP_KEYS = ["format", "format_version", "meta", "ops", "checksums"], ["seq", "type", "target", "payload", "label"]
FORBIDDEN, MAX_DEPTH = ["__proto__", "constructor", "prototype"], 60
#: What the value of a field that a type needs must be.
FIELD_KINDS = {
    "reference": "roomId areaId sourceId labelId toAreaId targetId",
    "coordinate": "toX toY toZ toW toH",
    "object": "room before after area cl label",
    "list": "changes added removed",
    "text": "cmd name",
    "env": "envId",
    "color": "newColor",
}
SYMBOLIC = r"^d:[1-9][0-9]*$"
#: Places that may hold a symbolic id: fields of the target, of the payload, and ids of things in it.
REFERENCES = [("target", f, "$") for f in ("roomId", "areaId", "sourceId", "labelId")] + [("payload", f, "$") for f in ("toAreaId", "targetId")]
REFERENCES += [("payload", f, "$.id") for f in ("room", "label", "area", "before", "after")]
#: Things in a payload whose exits, and lists whose entries, may hold some.
EXITS_OF, LISTS_OF = ["room", "before", "after"], ["changes", "added", "removed"]
#: Where an addition defines its own.
DEFINES = {"ADD_ROOM": "target.roomId", "ADD_AREA": "target.areaId", "ADD_LABEL": "payload.label"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """delta_id, text and doc (null where the text is no JSON), a row for each file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_name").alias("delta_id"), F.col("value").alias("text"), F.try_parse_json("value").alias("doc"))


def depth(text: Column) -> Column:
    """How deep JSON text is nested; brackets in strings don't count."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
    now = lambda acc, c: F.struct((acc["at"] + step(c)).alias("at"), F.greatest(acc["most"], acc["at"] + step(c)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), now)["most"]


def summed(files: DataFrame, format_name: str) -> DataFrame:
    """delta_id and file: the sum that each file should have, of all but its sums."""
    part = lambda p, empty: F.coalesce(F.to_json(F.try_variant_get("doc", p, "variant")), F.lit(empty))
    whole = F.concat(F.lit(f'{{"format":{json.dumps(format_name)},"format_version":{DELTA_VERSION},"meta":'), part("$.meta", "{}"), F.lit(',"ops":'), part("$.ops", "[]"), F.lit("}"))
    return files.filter("doc is not null").select("delta_id", json_hash(whole).alias("file"))


def operation_sums(files: DataFrame) -> DataFrame:
    """delta_id, pos, stored and computed sums of each operation."""
    ops = files.select("delta_id", F.posexplode(F.try_variant_get("doc", "$.ops", "array<variant>")).alias("pos", "op"), F.try_variant_get("doc", "$.checksums.ops", "array<string>").alias("stored"))
    return ops.select("delta_id", "pos", F.get("stored", F.col("pos")).alias("stored"), json_hash(F.to_json("op")).alias("computed"))


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a text: code points, and one more for each beyond the basic plane."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def gates(files: DataFrame, format_name: str) -> DataFrame:
    """delta_id and the code of the first gate that stops a file; files that pass have no row.

    With a wrong sum of the file, ``bad`` has the places of operations whose own sums differ.
    """
    get = lambda p, kind: F.try_variant_get("doc", p, kind)
    n = F.size(get("$.ops", "array<variant>"))
    top = F.map_keys(get("$", "map<string,variant>"))
    wrong = operation_sums(files).filter("stored is not null and stored <> computed").groupBy("delta_id").agg(F.sort_array(F.collect_list("pos")).alias("bad"))
    both = files.join(summed(files, format_name), "delta_id", "left").join(wrong, "delta_id", "left")
    deep = F.greatest(F.coalesce(depth(F.to_json(get("$.meta", "variant"))), F.lit(0)), F.coalesce(depth(F.to_json(get("$.ops", "variant"))), F.lit(0)) - 1) > MAX_DEPTH
    code = (
        F.when(F.trim("text") == "", "EMPTY_FILE").when(utf16_length(F.col("text")) > MAX_CHARS, "FILE_TOO_LARGE").when(F.col("doc").isNull(), "PARSE_ERROR")
        .when(~F.coalesce(get("$.format", "string") == format_name, F.lit(False)), "NOT_A_DELTA").when(~F.coalesce(get("$.format_version", "int") == DELTA_VERSION, F.lit(False)), "UNSUPPORTED_VERSION")
        .when(F.size(F.array_except(top, F.array(*map(F.lit, TOP_KEYS)))) > 0, "UNKNOWN_TOP_KEYS").when(deep, "TOO_DEEP").when(~F.coalesce(get("$.checksums.file", "string") == F.col("file"), F.lit(False)), "CHECKSUM_MISMATCH")
        .when(n.isNull() | (n < 0), "OPS_MISSING").when(n > MAX_OPS, "TOO_MANY_OPS").when(~F.coalesce(get("$.meta.ops_count", "int") == n, F.lit(False)), "OPS_COUNT_MISMATCH")
    )
    return both.select("delta_id", code.alias("code"), F.when(code == "CHECKSUM_MISMATCH", F.col("bad")).alias("bad")).filter("code is not null")


def operations(files: DataFrame) -> DataFrame:
    """delta_id, pos, seq, type, label, keys, raw (its JSON text), target and payload of every operation."""
    op = files.select("delta_id", F.posexplode(F.try_variant_get("doc", "$.ops", "array<variant>")).alias("pos", "op"))
    return op.select("delta_id", "pos", F.try_variant_get("op", "$.seq", "long").alias("seq"), F.try_variant_get("op", "$.type", "string").alias("type"), F.try_variant_get("op", "$.label", "string").alias("label"), F.map_keys(F.try_variant_get("op", "$", "map<string,variant>")).alias("keys"), F.to_json("op").alias("raw"), F.try_variant_get("op", "$.target", "map<string,variant>").alias("target"), F.try_variant_get("op", "$.payload", "map<string,variant>").alias("payload"))


def _wrong_kind(field: str, kind: str) -> Column:
    """A field that the type needs, with a value that isn't what the field holds."""
    out = F.lit(False)
    for part in ("target", "payload"):
        v = F.try_element_at(part, F.lit(field))
        name, number = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
        is_number = name.rlike("^(BIGINT|DECIMAL|DOUBLE)")
        whole = is_number & (number == F.floor(number))
        rooms = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.schema_of_variant(F.try_variant_get(e, "$.roomId", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|STRING)"))
        bytes_ = F.try_variant_get(v, "$", "array<double>")
        good = {
            "reference": (whole & (F.abs(number) < 2**31)) | ((name == "STRING") & F.try_variant_get(v, "$", "string").rlike(SYMBOLIC)),
            "coordinate": is_number & (F.abs(number) < 2**31),
            "object": name.startswith("OBJECT"),
            "list": name.startswith("ARRAY") & F.forall(rooms, lambda r: F.coalesce(r, F.lit(False))),
            "text": name == "STRING",
            "env": (whole & (number >= 0)) | ((name == "STRING") & (F.try_variant_get(v, "$", "string") != "")),
            "color": (name == "VOID") | (name.startswith("ARRAY") & (F.size(bytes_) >= 3) & F.forall(bytes_, lambda c: F.coalesce((c == F.floor(c)) & c.between(0, 255), F.lit(False)))),
        }[kind]
        out = out | (F.array_contains(f"of_{part}", field) & F.map_contains_key(part, F.lit(field)) & ~F.coalesce(good, F.lit(kind == "color") & v.isNull()))
    return out


def problems(ops: DataFrame) -> DataFrame:
    """delta_id, seq, code: wrong numbers, unknown types, missing, wrong, forbidden and unknown fields, bad directions."""
    more = [(t, a.split(), p.split(), [*p.split(), *OPTIONAL.get(t, "").split()]) for t, (a, p) in OPERATIONS.items()]
    rules = ops.sparkSession.createDataFrame(more, "type string, of_target array<string>, of_payload array<string>, may_payload array<string>")
    known = ops.join(F.broadcast(rules), "type", "left").withColumn("map_id", F.col("delta_id"))  # a row for each type
    path = F.coalesce(F.col("seq"), F.col("pos").cast("long") + 1).cast("string")
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    missing = (F.size(F.array_except("of_target", keys("target"))) > 0) | (F.size(F.array_except("of_payload", keys("payload"))) > 0)
    strange = (F.size(F.array_except("keys", F.array(*map(F.lit, OP_KEYS)))) > 0) | (F.size(F.array_except(keys("target"), "of_target")) > 0) | (F.size(F.array_except(keys("payload"), "may_payload")) > 0)
    direction = F.try_variant_get(F.try_element_at("target", F.lit("dir")), "$", "string")
    kinds = reduce(lambda a, b: a | b, (_wrong_kind(f, kind) for kind, fields in FIELD_KINDS.items() for f in fields.split()))
    barred = F.col("raw").rlike('"(' + "|".join(FORBIDDEN) + r')"\s*:')
    # an operation without a number, type, target or payload of its own is looked at no further
    shaped = F.col("seq").eqNullSafe(F.col("pos").cast("long") + 1) & F.col("of_target").isNotNull() & F.col("target").isNotNull() & F.col("payload").isNotNull()
    found = each(known, [
        (~F.col("seq").eqNullSafe(F.col("pos").cast("long") + 1), path, "OP_SEQ_ORDER"), (F.col("of_target").isNull(), path, "OP_UNKNOWN_TYPE"), ((F.size("of_target") > 0) & F.col("target").isNull(), path, "OP_NO_TARGET"),
        ((F.size("of_payload") > 0) & F.col("payload").isNull(), path, "OP_NO_PAYLOAD"), (F.col("of_target").isNotNull() & missing, path, "OP_MISSING_FIELD"), (shaped & kinds, path, "OP_INVALID_FIELD"),
        (F.map_contains_key("target", F.lit("dir")) & ~F.coalesce(direction.isin([d[0] for d in DIRECTIONS]), F.lit(False)), path, "OP_BAD_DIR"), (shaped & barred, path, "OP_FORBIDDEN_KEY"), (shaped & ~barred & strange, path, "OP_UNKNOWN_KEY"),
    ])
    return found.select(F.col("map_id").alias("delta_id"), F.col("path").cast("long").alias("seq"), "code")


def references(ops: DataFrame) -> DataFrame:
    """delta_id, seq, type, sid and ``defines``: every symbolic id at a place that refers; texts never do."""
    at = lambda part, field, path, kind="string": F.try_variant_get(F.try_element_at(part, F.lit(field)), path, kind)
    one = [F.struct(F.lit(f"{p}.{f}").alias("place"), at(p, f, path).alias("sid")) for p, f, path in REFERENCES]
    many = [at("payload", f, f"$.{m}", "map<string,string>") for f in EXITS_OF for m in ("exits", "special_exits")]
    inner = [F.transform(F.coalesce(F.map_values(m), F.array().cast("array<string>")), lambda s: F.struct(F.lit("exits").alias("place"), s.alias("sid"))) for m in many]
    listed = [F.transform(F.coalesce(at("payload", f, "$", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.struct(F.lit("list").alias("place"), F.try_variant_get(v, "$.roomId", "string").alias("sid"))) for f in LISTS_OF]
    own = F.coalesce(*(F.when(F.col("type") == t, F.lit(place)) for t, place in DEFINES.items()))
    found = ops.select("delta_id", "seq", "type", own.alias("own"), F.explode(F.concat(F.array(*one), *inner, *listed)).alias("r")).filter(F.col("r.sid").rlike(SYMBOLIC))
    return found.select("delta_id", "seq", "type", "r.sid", F.coalesce(F.col("own") == F.col("r.place"), F.lit(False)).alias("defines"))


def reference_problems(ops: DataFrame) -> DataFrame:
    """OP_DUP_SID for a second definition, OP_ADD_NEEDS_SID for none, OP_UNKNOWN_SID for a use before or without one."""
    refs = references(ops)
    nth = F.row_number().over(Window.partitionBy("delta_id", "sid").orderBy("seq"))
    again = refs.filter("defines").withColumn("nth", nth).filter("nth > 1").select("delta_id", "seq", F.lit("OP_DUP_SID").alias("code"))
    first = refs.filter("defines").groupBy("delta_id", "sid").agg(F.min("seq").alias("from_seq"))
    lost = refs.filter("not defines").join(first, ["delta_id", "sid"], "left").filter("from_seq is null or from_seq > seq").select("delta_id", "seq", F.lit("OP_UNKNOWN_SID").alias("code"))
    bare = ops.filter(F.col("type").isin(*DEFINES)).join(refs.filter("defines").select("delta_id", "seq"), ["delta_id", "seq"], "left_anti").select("delta_id", "seq", F.lit("OP_ADD_NEEDS_SID").alias("code"))
    return again.unionByName(lost.distinct()).unionByName(bare)


def exportable(log: DataFrame) -> DataFrame:
    """The rows of a log whose type a delta can hold."""
    return log.filter(F.col("type").isin(*OPERATIONS))


def texts(ops: DataFrame, metas: DataFrame, format_name: str) -> DataFrame:
    """delta_id and the canonical text of each delta file, with its sums.

    ``ops`` have delta_id, seq, type, label, and target and payload as JSON text; they are numbered
    anew. ``metas`` have delta_id and meta, a JSON object that gets the number of operations. A file
    holds at most MAX_OPS of them.
    """
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    op = F.concat(F.lit('{"seq":'), F.col("nth").cast("string"), F.lit(',"type":'), text(F.col("type")), F.lit(',"label":'), text(F.coalesce("label", F.lit(""))), F.lit(',"target":'), F.coalesce("target", F.lit("{}")), F.lit(',"payload":'), F.coalesce("payload", F.lit("{}")), F.lit("}"))
    each = numbered(exportable(ops), ["delta_id"], ["seq"], "nth").select("delta_id", "nth", op.alias("op")).withColumn("sum", json_hash("op"))
    by_file = each.groupBy("delta_id").agg(F.sort_array(F.collect_list(F.struct("nth", "op", "sum"))).alias("ops"))
    both = metas.join(by_file, "delta_id", "left").withColumn("ops", F.coalesce("ops", F.array().cast("array<struct<nth:long,op:string,sum:string>>")))
    rest = F.regexp_replace(F.trim("meta"), r"^\{\s*", "")
    meta = F.concat(F.lit('{"ops_count":'), F.size("ops").cast("string"), F.when(rest == "}", "").otherwise(","), rest)
    body = F.concat(F.lit(f'"format":{json.dumps(format_name)},"format_version":{DELTA_VERSION},"meta":'), meta, F.lit(',"ops":['), F.array_join(F.transform("ops", lambda o: o["op"]), ","), F.lit("]"))
    sums = F.concat(F.lit(',"checksums":{"file":"'), json_hash(F.concat(F.lit("{"), F.col("body"), F.lit("}"))), F.lit('","ops":'), F.to_json(F.transform("ops", lambda o: o["sum"])), F.lit("}}"))
    return both.withColumn("body", body).select("delta_id", canonical_json(F.concat(F.lit("{"), F.col("body"), sums)).alias("text"))


def base_identity(sums: DataFrame, documents: DataFrame) -> DataFrame:
    """map_id, crc, version, revision and areas: what a delta notes of the map that it was cut against.

    ``sums`` are those of ``integrity.checksums``.
    """
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("level") == "area", F.struct("id", "hash")))))
    by_map = sums.groupBy("map_id").agg(F.max(F.when(F.col("level") == "file", F.col("hash"))).alias("crc"), entries.alias("areas"))
    data = lambda k: F.nullif(F.try_element_at("meta.user_data", F.lit(k)), F.lit("")).alias(k)
    return by_map.join(documents.select("map_id", data("version"), data("revision")), "map_id", "left")
