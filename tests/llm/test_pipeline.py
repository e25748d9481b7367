"""The pipeline's stages: columns, decisions and the rows of the last one."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    assert docs.count() < n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == ids


KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, key string, salt int, limits string"


def prose(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(120)) + "."


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows, labels=()):
        spark.createDataFrame(list(rows), KIND).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return make


def test_odd_rows(spark, folder):
    more = ("r", 5, "k", 1, "l")
    good = [(i, prose(i), "en", "s", 1, *more) for i in range(12)]
    odd = [(50, None, "en", "s", 0, *more), (51, "", None, None, 0, *more), (52, " \n ", "en", "s", None, *more), (53, "x " * 40_000, "en", "s", 1, *more)]
    odd += [(None, prose(90), None, "s", 1, *more), (None, prose(90), None, "s", 1, *more), good[3], (60, prose(4), "en", "s", 1, *more)]
    path = folder(good + odd)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [c.split()[0] for c in KIND.split(", ")]
        left = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=repr)
        once = sorted([*range(12), None], key=repr)
        assert left == (once if name == "simhash" else sorted([*range(12), None, None, 3, 60], key=repr))
    got = corpus_pipeline.run(spark, path)
    assert sorted({r.doc_id for r in got.select("doc_id").collect()}, key=repr) == once
    assert got.filter("piece = 0").count() == 13 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_empty_tables(spark, folder):
    path = folder([])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
    assert corpus_pipeline.run(spark, path).count() == 0
