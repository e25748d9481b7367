"""Room search: by a piece of a name or an id, and by scored words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 25


def rooms_like(rooms: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Rooms whose name holds query, or whose id it is ('#12' or '12'), in the map's order."""
    q = query.strip().lower()
    as_id = re.fullmatch(r"#?(\d+)", q)
    hit = F.col("id") == int(as_id[1]) if as_id else F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(q))
    return rooms.filter(hit & F.lit(bool(q))).orderBy("map_id", "area_ord", "room_ord").limit(limit)


def tokens(rooms: DataFrame) -> DataFrame:
    """map_id, token, id, kind (n name, a area): distinct lower-case words of names."""
    words = lambda c, kind: F.transform(F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), "")), lambda w: F.struct(w.alias("token"), F.lit(kind).alias("kind")))
    return rooms.select("map_id", "id", F.inline(F.concat(words("name", "n"), words("area_title", "a"))))


def scored(rooms: DataFrame, query: str, limit: int | None = LIMIT) -> DataFrame:
    """map_id, id, name, area, score: every word of query must be in the room's or the area's name.

    A word in the room's name scores 2, one in the area's 1; the room whose id the query begins
    with scores 999. A token holds a word exactly if the name does, so names are matched directly.
    """
    q = query.strip().lower()
    words = q.split()
    number = re.match(r"[+-]?\d+", q)
    name, area = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("area_title", F.lit("")))
    score, every = F.lit(0), F.lit(bool(words))
    for w in words:
        in_name, in_area = F.contains(name, F.lit(w)), F.contains(area, F.lit(w))
        score = score + F.when(in_name, 2).when(in_area, 1).otherwise(0)
        every = every & (in_name | in_area)
    is_id = (F.col("id") == int(number[0])) if number else F.lit(False)
    shown = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    out = rooms.filter(every | is_id).select("map_id", "id", shown.alias("name"), F.coalesce("area_title", F.lit("")).alias("area"), F.when(is_id, 999).otherwise(score).cast("int").alias("score"), "area_ord", "room_ord")
    return out.orderBy(F.desc("score"), "area_ord", "room_ord", "id").limit(limit) if limit is not None else out
