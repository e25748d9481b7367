"""Transport lines: checks of their documents, sums, and virtual edges from timed legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.text import json_hash
from wayloom.operators.rules import each

# Fixed values of the cost model: a ride costs its time by the ratio, and the penalty once.
PENALTY = {"normal": 30.0, "aggressive": 10.0}
RATIO = {"normal": 0.5, "aggressive": 0.1}
DEFAULT_TIME = 60.0
TRANSPORTS_VERSION = 1


def normalized(tuples: DataFrame) -> DataFrame:
    """Legs of lines given as (map_id, name, board, exit_command, stops), a stop being from, to, time, label."""
    leg = tuples.select("map_id", F.col("name").alias("line"), "board", "exit_command", F.posexplode("stops").alias("pos", "s"))
    return leg.select("map_id", "line", "board", "exit_command", "pos", F.col("s.from").alias("src"), F.col("s.to").alias("dst"), F.col("s.time").cast("double").alias("time"), F.col("s.label").alias("label"))


def edges(legs: DataFrame, rooms: DataFrame, mode: str = "normal") -> DataFrame:
    """map_id, line, src, dst, cost, time, label, via: every ride from every leg's start.

    A ride goes on along the legs, around the end to the first, while each starts where the one
    before ended; it ends before the room that it began in and before a room outside the map.
    An unknown mode has no edges. How far each ride goes is found before its legs are laid out:
    each leg knows the next leg that breaks the line, and the next that comes back to where it began.
    """
    known = rooms.select("map_id", F.col("id").alias("room")).distinct()
    n = legs.groupBy("map_id", "line").agg(F.count("*").alias("n"))
    time = F.when(F.col("time") > 0, F.col("time")).otherwise(DEFAULT_TIME)
    line = Window.partitionBy("map_id", "line").orderBy("pos")
    own = legs.join(n, ["map_id", "line"]).join(known.select("map_id", F.col("room").alias("dst"), F.lit(True).alias("known")), ["map_id", "dst"], "left")
    own = own.withColumn("before", F.coalesce(F.lag("dst").over(line), F.last("dst").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    # two rounds of the line, so that a ride around its end is a run of rows
    twice = own.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("pos") + F.col("round") * F.col("n"))
    along = Window.partitionBy("map_id", "line").orderBy("at")
    later, now_on = along.rowsBetween(1, Window.unboundedFollowing), along.rowsBetween(0, Window.unboundedFollowing)
    dead = F.when(F.col("known").isNull(), F.col("at"))
    torn = F.when(F.col("src") != F.col("before"), F.col("at"))
    twice = twice.withColumns({"dead": F.min(dead).over(now_on), "torn": F.min(torn).over(later), "leg_time": time})
    begin = twice.filter("round = 0").join(known.withColumnRenamed("room", "src"), ["map_id", "src"])
    home = twice.select("map_id", "line", F.col("dst").alias("src"), F.col("at").alias("home"))
    end = F.least(F.col("at") + F.col("n"), F.coalesce("dead", F.col("at") + F.col("n")), F.coalesce("torn", F.col("at") + F.col("n")))
    begin = begin.select("map_id", "line", "board", "exit_command", "src", F.col("at").alias("begin"), end.alias("end"))
    back = begin.join(home, ["map_id", "line", "src"]).filter("home >= begin").groupBy("map_id", "line", "begin").agg(F.min("home").alias("home"))
    begin = begin.join(back, ["map_id", "line", "begin"], "left").withColumn("end", F.least("end", F.coalesce("home", "end"))).filter("end > begin")
    laid = twice.groupBy("map_id", "line").agg(F.sort_array(F.collect_list(F.struct("at", "dst", "leg_time", "label"))).alias("legs"))  # as long as the line
    ride = begin.join(laid, ["map_id", "line"]).withColumns({"labels": F.transform("legs", lambda x: x["label"]), "leg": F.explode(F.filter("legs", lambda x: (x["at"] >= F.col("begin")) & (x["at"] < F.col("end"))))})
    ride = ride.select(*begin.columns, "labels", "leg.*")
    upto = Window.partitionBy("map_id", "line", "begin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ride = ride.withColumn("time", F.sum("leg_time").over(upto))
    cost = F.col("time") * RATIO.get(mode, 0.0) + PENALTY.get(mode, 0.0)
    via = F.slice("labels", (F.col("begin") + 1).cast("int"), (F.col("at") - F.col("begin")).cast("int"))
    return ride.filter(F.lit(mode in PENALTY)).select("map_id", "line", "board", "exit_command", "src", "dst", cost.alias("cost"), "time", "label", via.alias("via"))


def document_problems(documents: DataFrame, format_name: str) -> DataFrame:
    """map_id, path and code of faults of transport documents (map_id, format, version, lines) as a whole."""
    wrong = lambda c, want: ~F.coalesce(F.col(c) == want, F.lit(False))
    return each(documents, [(wrong("format", format_name), F.lit("transports.format"), "INVALID_FORMAT"), (wrong("version", TRANSPORTS_VERSION), F.lit("transports.version"), "INVALID_FORMAT_VERSION"), (F.col("lines").isNull(), F.lit("transports.lines"), "MUST_BE_ARRAY")])


def problems(lines: DataFrame) -> DataFrame:
    """map_id, path and code of each fault in lines (map_id, pos, name, board, exit, legs)."""
    at = lambda f: F.concat(F.lit("transports.lines["), F.col("pos").cast("string"), F.lit(f"].{f}"))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    again = F.row_number().over(Window.partitionBy("map_id", "name").orderBy("pos")) > 1
    none = lambda c: F.coalesce(F.size(c), F.lit(-1)) < 1
    lines = lines.withColumn("again", again)
    of_line = each(lines, [
        (blank("name"), at("name"), "MUST_BE_NONEMPTY_STRING"), (~blank("name") & F.col("again"), at("name"), "DUPLICATE_LINE_NAME"), (none("board") | F.exists("board", lambda c: c.isNull()), at("board"), "MUST_BE_NONEMPTY_STRINGS"),
        (blank("exit"), at("exit"), "MUST_BE_NONEMPTY_STRING"), (none("legs"), at("legs"), "MUST_BE_NONEMPTY_ARRAY"),
    ])
    leg = lines.select("map_id", "pos", F.posexplode("legs").alias("j", "g"))
    on = lambda f: F.concat(at("legs["), F.col("j").cast("string"), F.lit(f"].{f}"))
    bad = lambda c: F.col(f"g.{c}").isNull() | (F.col(f"g.{c}") <= 0)
    of_leg = each(leg, [(bad("from"), on("from"), "MUST_BE_POSITIVE_INTEGER"), (bad("to"), on("to"), "MUST_BE_POSITIVE_INTEGER"), (F.col("g.time") <= 0, on("time"), "MUST_BE_POSITIVE_NUMBER")])
    return of_line.unionByName(of_leg)


def line_json(line: Column) -> Column:
    """The JSON text of a line that its sum covers: absent fields are left out, legs keep their order."""
    leg = lambda g: F.struct(g["from"].alias("from"), g["to"].alias("to"), g["time"].alias("time"), g["label"].alias("label"))
    return F.to_json(F.struct(line["name"].alias("name"), line["board"].alias("board"), line["exit"].alias("exit"), F.transform(line["legs"], leg).alias("legs")))


def checksums(documents: DataFrame, format_name: str) -> DataFrame:
    """map_id, level (line, document), id and hash of the transports of map documents; lines count by name."""
    own = documents.filter("transports is not null").select("map_id", F.explode("transports.lines").alias("l")).select("map_id", F.col("l.name").alias("id"), line_json(F.col("l")).alias("text"))
    whole = own.groupBy("map_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), ",").alias("texts"))  # as many as a document has lines
    text = F.concat(F.lit('{"format":"' + format_name + f'","version":{TRANSPORTS_VERSION},"lines":['), F.coalesce("texts", F.lit("")), F.lit("]}"))
    every = documents.filter("transports is not null").select("map_id").join(whole, "map_id", "left").select("map_id", F.lit("document").alias("level"), F.lit("").alias("id"), json_hash(text).alias("hash"))
    return own.select("map_id", F.lit("line").alias("level"), "id", json_hash("text").alias("hash")).unionByName(every)


def stored_checksums(documents: DataFrame) -> DataFrame:
    """The sums of transports that documents bring with them, in the same shape."""
    lines = documents.select("map_id", F.lit("line").alias("level"), F.explode("checksums.transports.lines").alias("id", "hash"))
    return lines.unionByName(documents.filter("checksums.transports.hash is not null").select("map_id", F.lit("document").alias("level"), F.lit("").alias("id"), F.col("checksums.transports.hash").alias("hash")))
