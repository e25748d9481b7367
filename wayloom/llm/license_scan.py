"""License scans by diagonal voting.

All rolling word k-grams of every document are hashed and joined to the k-grams of the
templates. A hit at document word p and template word t votes for the diagonal p - t. Votes are
counted by document, template and diagonal; diagonals of a template within ``band`` of each
other merge with all their votes, single ones too, so that a few words more or fewer in a copy
don't break it. Spans of bounded length within a merged run are verified by the share of the
template's words that their hits cover, each compared as words; the best one counts. A phrase that must stand whole takes a diagonal with every vote of its own.

DataFrame functions only. The templates are fixed parameters of under a hundred words, so their
grams are broadcast and documents move no text: hits alone are shuffled. Each text is read and cut
into words once; every document has a hit of its own besides, before its first word, which holds
how many words it has.

Edge cases: a null text has no words; a repeated row (same id and text) gets the same result as
the first, its votes being counted by template word; rows of one id with other texts are kept
apart; a null id is an id of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Phrases that must stand whole, and their labels; fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that may differ by some words, and the labels that the voting adds.
NOTICES = {
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under the gnu general public license version 3": "gpl-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
}
K = 2
BAND = 3
COVER = 0.9
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased; nothing else changes."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, SEPARATORS), "")


def templates(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    """(template, label, whole, number of words, word number, word, next word) for every k-gram."""
    out = []
    for i, (text, label, whole) in enumerate([*((t, x, True) for t, x in phrases.items()), *((t, x, False) for t, x in notices.items())]):
        w = text.split()
        out += [(i, label, whole, len(w), t, w[t], w[t + 1]) for t in range(len(w) - K + 1)]
    return out


def hits(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, key, template, label, whole, n, diagonal and t of every hit; of a document itself, with n words, template and t are -1."""
    spark = docs.sparkSession
    grams = spark.createDataFrame([*templates(phrases, notices), (-1, "", False, 0, -1, "", "")], "template int, label string, whole boolean, n int, t int, a string, b string")
    grams = grams.select("*", F.xxhash64("a", "b").alias("gram"))
    text = F.col("text").cast("string")
    each = docs.select("doc_id", F.xxhash64(text).alias("key"), words(text).alias("w"))
    each = each.select("doc_id", "key", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - K, F.lit(-1)))).alias("p"))
    word = lambda at: F.when(F.col("p") < 0, "").otherwise(F.get("w", at))
    each = each.select("doc_id", "key", "p", word(F.col("p")).alias("p_a"), word(F.col("p") + 1).alias("p_b"), F.size("w").alias("n_words"))
    each = each.withColumn("p_gram", F.xxhash64("p_a", "p_b"))
    found = each.join(F.broadcast(grams), (F.col("p_gram") == F.col("gram")) & (F.col("p_a") == F.col("a")) & (F.col("p_b") == F.col("b")))
    return found.select("doc_id", "key", "template", "label", "whole", F.when(F.col("template") < 0, F.col("n_words")).otherwise(F.col("n")).alias("n"), (F.col("p") - F.col("t")).alias("diagonal"), "t")


def votes(found: DataFrame) -> DataFrame:
    """doc_id, key, template, label, whole, n, diagonal, and the template words hit on it."""
    return found.filter("template >= 0").groupBy("doc_id", "key", "template", "label", "whole", "n", "diagonal").agg(F.array_sort(F.collect_set("t")).alias("ts"))


def spans(found: DataFrame, band: int = BAND, cover: float = COVER, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Verified spans: doc_id, key, label, whole, first and last word, and the share covered."""
    whole = found.filter(F.col("whole") & (F.size("ts") == F.col("n") - K + 1))
    whole = whole.select("doc_id", "key", "label", "whole", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n") - 1).alias("last"), F.lit(1.0).alias("score"))
    near = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    part = found.filter(~F.col("whole")).withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > band, F.lit(True)).cast("int"))
    part = part.withColumn("run", F.sum("new").over(near))
    part = part.withColumn("hits", F.transform("ts", lambda t: F.struct((F.col("diagonal") + t).alias("at"), t.alias("t"))))
    part = part.groupBy("doc_id", "key", "template", "label", "n", "run").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    covered = lambda hits: F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.array(h["t"], h["t"] + 1))))) / F.col("n")
    part = part.filter(covered("hits") >= cover).select("doc_id", "key", "template", "label", "n", "run", F.inline("hits"))
    # a run may go on beyond a copy, so each of its hits begins a span of the longest length allowed
    longest = max((len(x.split()) for x in notices), default=0) + 4 * band - 2
    ahead = Window.partitionBy("doc_id", "key", "template", "run").orderBy("at").rangeBetween(0, longest)
    part = part.withColumn("hits", F.collect_list(F.struct("at", "t")).over(ahead))
    part = part.withColumn("hits", F.filter("hits", lambda h: h["at"] - F.col("at") + K - 1 < F.col("n") + 4 * band))
    part = part.select("doc_id", "key", "template", "label", "run", F.struct(covered("hits").alias("score"), (-F.col("at")).alias("back"), (F.array_max(F.col("hits")["at"]) + K - 1).alias("last")).alias("span"))
    part = part.filter(F.col("span.score") >= cover).groupBy("doc_id", "key", "template", "label", "run").agg(F.max("span").alias("span"))
    part = part.select("doc_id", "key", "label", (-F.col("span.back")).alias("first"), F.col("span.last").alias("last"), F.col("span.score").alias("score"))
    return whole.unionByName(part.select("doc_id", "key", "label", F.lit(False).alias("whole"), "first", "last", "score"))


def scanned(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, band: int = BAND, cover: float = COVER) -> DataFrame:
    """For every document: n_words, n_base, first_word, last_word, base_labels, labels and score."""
    every = cut(hits(docs, phrases, notices))
    found = spans(cut(votes(every)), band, cover, notices).withColumn("starts", F.when(F.col("whole"), F.col("first")))
    by_doc = found.groupBy("doc_id", "key").agg(
        F.count("starts").alias("n_base"), F.min("starts").alias("first_word"), F.max("starts").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    ).withColumnsRenamed({"doc_id": "f_doc_id", "key": "f_key"})
    every = every.filter("template < 0").select("doc_id", "key", F.col("n").cast("long").alias("n_words"))
    both = every.join(by_doc, F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("key") == F.col("f_key")), "left")
    return both.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op4: counts, places and labels of licence phrases and notices in every document."""
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"({i}, '{x}', {str(h).lower()}, {n}, {t}, '{a}', '{b}')" for i, x, h, n, t, a, b in templates(PHRASES, NOTICES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT * FROM (VALUES {rows}) AS x(template, label, whole, n, t, a, b)),
p AS (SELECT r, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT r, w, unnest(range(0, len(w) - 1)) AS p FROM d)),
h AS (SELECT r, template, label, whole, n, p - t AS diagonal, t FROM p JOIN g USING (a, b)),
v AS (SELECT r, template, label, whole, n, diagonal, count(DISTINCT t) AS c, list_distinct(list(t)) AS ts FROM h GROUP BY ALL),
e AS (SELECT r, label, true AS whole, diagonal AS start, 1.0::DOUBLE AS score FROM v WHERE whole AND c = n - 1),
m1 AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER near <= {BAND} THEN 0 ELSE 1 END AS new FROM v WHERE NOT whole WINDOW near AS (PARTITION BY r, template ORDER BY diagonal)),
m2 AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM m1),
m3 AS (SELECT r, template, label, n, run, t, diagonal + t AS at FROM (SELECT *, unnest(ts) AS t FROM m2)),
m4 AS (SELECT r, template, run FROM m3 GROUP BY r, template, n, run HAVING len(list_distinct(list_concat(list(t), list(t + 1)))) / n::DOUBLE >= {COVER}),
m5 AS (SELECT a.r, a.label, a.template, a.run, a.at, len(list_distinct(list_concat(list(b.t), list(b.t + 1)))) / a.n::DOUBLE AS score FROM (SELECT DISTINCT * EXCLUDE t FROM m3 SEMI JOIN m4 USING (r, template, run)) a
  JOIN m3 b ON a.r = b.r AND a.template = b.template AND a.run = b.run AND b.at >= a.at AND b.at - a.at + {K - 1} < a.n + {4 * BAND} GROUP BY a.r, a.label, a.template, a.run, a.at, a.n),
s AS (SELECT * FROM e UNION ALL SELECT r, label, false, NULL, score FROM m5 WHERE score >= {COVER}),
f AS (SELECT r, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (whole)), ','), '') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r)
"""


SQL = _sql()
