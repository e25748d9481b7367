"""Embedding near-duplicates against all pairs, with odd vectors, equal ones and a dense cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.llm import embedding_dedup
from wayloom.llm.components import components


@pytest.mark.parametrize("block", [4096, 64])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_HOMES", block)
    monkeypatch.setattr(embedding_dedup, "BLOCK_GUESTS", block)
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    dense = base[0] + 0.02 * r.normal(size=(150, 16))
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, dense, base[:5], base[:5] * 3])]
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] * 8, 0), (904, vectors[0], None), (905, [], 1), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, vectors[1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in embedding_dedup.clustered(df).collect()}
    fine = [(i, np.array(v, float), l) for i, v, l in rows + odd if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: [j for j, w, m in fine if j != i and m == l and len(w) == len(v) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98] for i, v, l in fine}
    for i, *_ in rows + odd:
        seen, todo = {i}, [i]
        while todo:
            new = set(near.get(todo.pop(), ())) - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near.get(i, ())), min(seen), min(seen) == i)


def test_odd_columns_and_ids(spark):
    rows = [(None, [1.0, 0.0], 1, "x"), (7, [2.0, 0.0], 1, "x"), (7, [-0.0, 3.0], 1, "y"), (8, [0.0, 3.0], 1, "y"), (9, [0.0, 3.0], 2, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, class string").withColumn("key", F.lit(1)).withColumn("vector", F.lit("v")).withColumn("n", F.lit(0))
    got = sorted(map(tuple, embedding_dedup.clustered(df).collect()), key=repr)
    assert got == sorted([(None, 1, 7, False), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True)], key=repr)


def test_components_of_chains_rings_and_odd_links(spark):
    chain = [(i, i + 1) for i in range(60)]
    ring = [(100 + i, 100 + (i + 7) % 30) for i in range(30)]
    odd = [(200, 200), (300, 301), (301, 300), (300, 301), (400, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + ring + odd, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 130), 100) | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert embedding_dedup.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
