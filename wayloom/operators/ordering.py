"""Running numbers over rows in an order, without one task that sees all rows of a group.

Rows are range-partitioned by group and order, numbered within their partition, and each
partition's count, one row, is summed ahead of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.routing import checkpointed

#: Rooms, with their exits, whose rows one task of a join has.
ROOMS = 25_000


def tasks_for(rooms: DataFrame, most: int = ROOMS) -> int:
    """How many tasks share the rows of these rooms: in proportion to the rooms, and no fewer than a shuffle has.

    A number of tasks that is given is kept, where Spark would pack well-compressed partitions into few tasks.
    """
    return max(int(rooms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rooms.count() // most))


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "seq") -> DataFrame:
    """rows with ``name``: 1, 2, ... in the order within each group."""
    part = rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    part = checkpointed(part.withColumn("_nth", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))))
    counts = part.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return part.join(ahead, same).withColumn(name, (F.col("_ahead") + F.col("_nth")).cast("long")).select(*(c for c in rows.columns if c != name), name)
