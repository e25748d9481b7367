"""Connected components of a table of links, by contraction.

In each round every node moves to the least of its neighbours and itself, moves are followed to
their ends by doubling, and the links move with their nodes; rounds end when no link joins two
nodes, so a long chain needs as many joins as its length has bits. Nodes, links and moves stay tables;
what is grouped is reduced by min before the shuffle, so a node with very many links is no
hot spot. Links that come as stars around their least member need a round or two.

Edge cases: a link from a node to itself, repeated links and either direction count once; links with
a null end are left out; without links there are no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node and root for every node that has a link; ``links`` has long columns a and b."""
    pair = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    left = cut(pair(links, "a", "b"))
    roots = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        move = cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")))
        while True:
            onward = move.select(F.col("node").alias("to"), F.col("to").alias("far"))
            jumped = cut(move.join(onward, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("on")))
            if jumped.filter("on").isEmpty():
                break
            move = jumped.drop("on")
        if roots is None:
            roots = move.withColumnRenamed("to", "root")
        else:
            step = move.withColumnRenamed("node", "root")
            roots = cut(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        to_a, to_b = move.toDF("a", "to_a"), move.toDF("b", "to_b")
        left = cut(pair(left.join(to_a, "a").join(to_b, "b"), "to_a", "to_b"))
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as links between each member and the least one; within a task."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]
