"""Operation logs: chains that fold, pairs that vanish, numbers and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.ordering import numbered


def sessions(log: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """log (log_id, seq, key, type, before, after) with ``session``: a deletion ends a key's chain, an addition begins one.

    So does ``blocks`` (log_id, key, seq): at seq an operation on something else refers to the key,
    and what comes later must not be drawn before it.
    """
    rows = log.withColumn("_block", F.lit(False))
    if blocks is not None:
        only = {"log_id", "key", "seq"}
        stops = blocks.select("log_id", "key", "seq").distinct().select(*(F.col(c) if c in only else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns), F.lit(True).alias("_block"))
        rows = rows.unionByName(stops)
    own = Window.partitionBy("log_id", "key").orderBy("seq", "_block")
    opens = F.col("_block") | (F.col("type") == "add") | F.coalesce(F.lag("type").over(own) == "delete", F.lit(False))
    rows = rows.withColumn("_new", opens.cast("int")).withColumn("session", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return rows.filter(~F.col("_block")).drop("_new", "_block")


def folded(log: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One operation for each chain: an addition with the last state, or first before and last after.

    A chain from an addition to a deletion vanishes, as does an edit that ends where it began;
    moves, colours and paint (type move, color or paint) keep their first before and last after
    even if these are equal.
    """
    chain = sessions(log, blocks).groupBy("log_id", "key", "session").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), F.min_by("type", "seq").alias("first_type"), F.max_by("type", "seq").alias("last_type"),
        F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"),
    )
    gone = (F.col("first_type") == "add") & (F.col("last_type") == "delete")
    same = (F.col("first_type") == "edit") & (F.col("last_type") == "edit") & F.col("before").eqNullSafe(F.col("after"))
    kind = F.when(F.col("first_type") == "add", "add").otherwise(F.col("last_type"))
    return chain.filter(~gone & ~same).withColumn("type", kind)


def renumbered(ops: DataFrame) -> DataFrame:
    """ops with seq 1, 2, ... in the order of first_seq within each log."""
    return numbered(ops, ["log_id"], ["first_seq", "key"])


def symbolic(log: DataFrame) -> DataFrame:
    """Additions with ``sid``, d:1, d:2, ... in the log's order."""
    adds = numbered(log.filter("type = 'add'"), ["log_id"], ["seq"], "nth")
    return adds.withColumn("sid", F.concat(F.lit("d:"), F.col("nth").cast("string"))).drop("nth")


def references(log: DataFrame) -> DataFrame:
    """Each operation with the symbolic id that its key has then: from its addition to its deletion."""
    live = symbolic(log).select("log_id", "key", "sid", F.col("seq").alias("from_seq"))
    end = log.filter("type = 'delete'").select("log_id", "key", F.col("seq").alias("end_seq"))
    until = live.join(end, ["log_id", "key"], "left").groupBy("log_id", "key", "sid", "from_seq").agg(F.min(F.when(F.col("end_seq") > F.col("from_seq"), F.col("end_seq"))).alias("to_seq"))
    ops, u = log.alias("o"), until.alias("u")
    at = (F.col("o.log_id") == F.col("u.log_id")) & (F.col("o.key") == F.col("u.key")) & (F.col("o.seq") >= F.col("u.from_seq")) & (F.col("u.to_seq").isNull() | (F.col("o.seq") <= F.col("u.to_seq")))
    found = ops.join(u, at, "left").select("o.*", "u.sid", F.col("u.from_seq").alias("_from"))
    latest = found.groupBy("log_id", "seq", "key", "type").agg(F.max_by("sid", "_from").alias("sid"))
    return latest


def sequence_errors(log: DataFrame) -> DataFrame:
    """Operations whose number isn't their place in the log, from 1."""
    return numbered(log, ["log_id"], ["pos"], "expected").filter(~F.col("seq").eqNullSafe(F.col("expected")))


def _met(rooms: DataFrame, ops: DataFrame) -> DataFrame:
    """Rooms and folded operations by id, with ``code`` where the operation doesn't fit: it changes nothing then."""
    last = ops.select(F.col("log_id").alias("map_id"), F.col("key").alias("id"), "seq", "type", "after")
    both = rooms.withColumn("there", F.lit(True)).join(last, ["map_id", "id"], "full_outer")
    code = F.when((F.col("type") != "add") & F.col("there").isNull(), "ROOM_MISSING").when((F.col("type") == "add") & F.col("there"), "ROOM_EXISTS")
    return both.withColumn("code", code)


def applied(rooms: DataFrame, ops: DataFrame) -> DataFrame:
    """Rooms (map_id, id, and ``state``) after folded operations on them: added, replaced or gone. Typed deltas are ``apply``'s."""
    both = _met(rooms, ops)
    gone = (F.col("code").isNull() & (F.col("type") == "delete")) | F.col("there").isNull() & F.col("code").isNotNull()
    return both.filter(~F.coalesce(gone, F.lit(False))).select("map_id", "id", F.when(F.col("type").isNull() | F.col("code").isNotNull(), F.col("state")).otherwise(F.col("after")).alias("state"))


def skipped(rooms: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations that meet no room to edit or delete, or one that is there to add, with a code."""
    return _met(rooms, ops).filter("code is not null").select("map_id", "id", "seq", "type", "code")
