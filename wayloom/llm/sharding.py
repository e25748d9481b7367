"""Contiguous shards of near equal bytes, by global prefix sums.

Documents are laid in one order (digest of the text, then doc_id, so that equal texts stand
together) and range-partitioned by it. Sizes are summed within each partition; the totals of the
partitions, one row each, are summed again; both sums give each document its place in the bytes
of all. The places are cut at equal targets. A cut inside a group of equal texts moves to the
nearer end of the group if that is at most ``snap`` of a shard away, so small groups stay whole
and a large one, which may hold a third of all rows, is split.

Texts aren't shuffled: only the id, size, checksum and digest move. DataFrame functions only.

The number of ranges follows the number of rows. To find their bounds Spark samples up to 100 rows
a range, and a million in all.

Edge cases: a null text has size 1 and the checksum of no bytes; null ids stand first among
equal texts; repeated rows each take a slot, in the order that they are read in; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 16
SNAP = 0.005
#: Rows of a range, and ranges at least; a range's totals, one row, are all that is put in one place.
ROWS, LEAST = 1 << 20, 32


def placed(docs: DataFrame, rows_per_range: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32, digest, and ``before``: bytes and rows that stand before, in all."""
    ranges = max(LEAST, -(-docs.count() // rows_per_range))
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("nth"))
    order = ["digest", F.col("doc_id").asc_nulls_first(), "nth"]
    part = rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut(part.select("*", F.sum("size").over(within).alias("bytes_to"), F.row_number().over(within).cast("long").alias("rows_to")))
    totals = summed.groupBy("part").agg(F.max("bytes_to").alias("b"), F.max("rows_to").alias("r"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b"), F.coalesce(F.sum("r").over(ahead), F.lit(0)).alias("r"))
    both = summed.join(totals, "part")  # a row for each range
    return both.select("doc_id", "size", "text_crc32", "digest", (F.col("b") + F.col("bytes_to") - F.col("size")).alias("before"), (F.col("r") + F.col("rows_to") - 1).alias("row"))


def cuts(rows: DataFrame, shards: int = SHARDS, snap: float = SNAP) -> list[int]:
    """The shards - 1 places where the bytes are cut. What comes to the driver is a row for each cut."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    marks = [total * k // shards for k in range(1, shards)]
    if not total:
        return marks
    at = F.array(*map(F.lit, marks))
    inside = F.explode(F.filter(at, lambda m: (m >= F.col("before")) & (m < F.col("before") + F.col("size"))))
    hit = rows.select("digest", inside.alias("mark"))
    groups = rows.join(F.broadcast(hit.select("digest").distinct()), "digest", "left_semi")  # at most shards - 1 digests
    spans = groups.groupBy("digest").agg(F.min("before").alias("first"), F.max(F.col("before") + F.col("size")).alias("last"))
    found = {r.mark: r for r in hit.join(F.broadcast(spans), "digest").collect()}
    out = []
    for mark in marks:
        ends = [e for e in (found[mark].first, found[mark].last) if abs(e - mark) <= snap * total / shards] if mark in found else []
        out.append(min(ends, key=lambda e: abs(e - mark)) if ends else mark)
    return out


def shard_of(middle: Column, at: list[int]) -> Column:
    """The shard of a document whose middle is there."""
    out = F.lit(0)
    for place in at:
        out = out + (middle >= F.lit(place)).cast("int")
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, snap: float = SNAP) -> DataFrame:
    """doc_id, size, text_crc32, shard and the slot in it, counted from 0."""
    rows = cut(placed(docs))
    out = rows.withColumn("shard", shard_of(F.col("before") + F.floor(F.col("size") / 2), cuts(rows, shards, snap)))
    first = out.groupBy("shard").agg(F.min("row").alias("first_row"))
    return out.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the shard and slot of every document, under the law of bytes."""
    return sharded(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
