"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch is a table of counts by bin. Bins are whole numbers: exact below 64, above that with
a relative width of 1/32, so two sketches merge by adding counts and any merge order gives the
same result. A sketch for each language and source gives the fences; a group of fewer than
``min_group`` documents takes the merged sketch of its language, a small language that of all.

Fences, for each metric: ``median + max(spread * (q75 - median), floor)`` above, and for the mean
word length also ``median - max(spread * (median - q25), floor)`` below. Over even prose the spreads
are small, so a fence stands on its floor above the group's median; a group of mixed texts, such as
code or lists, widens its own. Repeated words have no fence: the base rule, a fixed share, is stricter
than any that would go with the others.

Edge cases: a null text has no words and fails the base rule; null lang or source form a group
of their own; repeated rows are measured each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NEWLINE, SPACE, cut, map_batches, per_text, ranked, slices, split_words, table, text_bytes

#: metric -> (spread, floor, two-sided). Ratios are per 1000 words, lines or characters; mean length in hundredths.
FENCES = {
    "punct": (8, 600, False),
    "symbols": (8, 100, False),
    "caps": (8, 350, False),
    "dup": (8, 600, False),
    "length": (8, 300, True),
}
MIN_GROUP = 200
MIN_WORDS = 10
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_punct", "n_caps"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHAR = np.ones(256, bool)  # first bytes of characters that aren't white space
_CHAR[0x80:0xC0] = False
_CHAR &= ~SPACE
_CAPS = np.zeros(256, bool)
_CAPS[0x41:0x5B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text."""
    buf, off = text_bytes(texts)
    words = split_words(buf, off, SPACE)
    lines = split_words(buf, off, NEWLINE)
    out = {"n_words": words.counts()}
    for name, flags in (("word_chars", _CHAR), ("n_symbols", _SYMBOL), ("n_punct", _PUNCT), ("n_caps", _CAPS)):
        out[name] = per_text(flags[buf], off)
    ink = np.zeros(len(lines.values) + 1, np.int64)
    np.cumsum(~SPACE[lines.values], out=ink[1:])
    worded = ink[lines.bounds[1:]] > ink[lines.bounds[:-1]] if len(lines.text) else np.zeros(0, bool)
    code, distinct = lines.coded()
    text, code = lines.text[worded], code[worded]
    out["n_lines"] = np.bincount(text, minlength=words.n_texts).astype(np.int64)
    different = np.unique(text * max(len(distinct), 1) + code) // max(len(distinct), 1)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(different, minlength=words.n_texts)
    out["n_repeat_words"] = _repeated(words)
    return out


def _repeated(words, width: int = 5) -> np.ndarray:
    """Words of each text that stand in a window of width words found twice or more in it."""
    n = len(words.text) - width + 1
    if n <= 0:
        return np.zeros(words.n_texts, np.int64)
    code, distinct = words.coded()
    two, n_two = ranked(code[:-1] * len(distinct) + code[1:])
    four, n_four = ranked(two[:-2] * n_two + two[2:])
    five, n_five = ranked(four[:-1] * len(distinct) + code[4:])
    at = np.flatnonzero(words.text[:n] == words.text[width - 1 :])
    if not len(at):
        return np.zeros(words.n_texts, np.int64)
    key, n_key = ranked(five[at] * words.n_texts + words.text[at])
    again = at[np.bincount(key, minlength=n_key)[key] > 1]
    cover = np.zeros(len(words.text) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return np.bincount(words.text[np.cumsum(cover[:-1]) > 0], minlength=words.n_texts).astype(np.int64)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = counts(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=["doc_id", "lang", "source", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Whole-number metrics of documents that have words."""
    of = lambda a, b, k: F.floor(F.lit(k) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "punct": of("n_punct", "n_words", 1000), "symbols": of("n_symbols", "n_words", 1000), "caps": of("n_caps", "word_chars", 1000),
        "dup": of("n_dup_lines", "n_lines", 1000), "length": of("word_chars", "n_words", 100),
    }


def bin_low(value: Column) -> Column:
    """The lowest whole number of value's bin."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.floor(value / step).cast("long") * step


def sketched(rows: DataFrame) -> DataFrame:
    """The sketches of every (lang, source): counts n by metric and bin."""
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics())), F.array(*(bin_low(c) for c in metrics().values()))))
    return rows.filter("n_words > 0").select("lang", "source", pairs.alias("metric", "bin")).groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """q25, q50, q75 and the count of each metric, of the sketches merged over by."""
    merged = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    below = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    return below.groupBy(*by, "metric").agg(F.max("total").alias("total"), *(F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))).alias(f"q{25 * k}") for k in (1, 2, 3)))


def thresholds(rows: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source, and low_<metric> and high_<metric>, one row for each group."""
    sketch = cut(sketched(rows))
    own = quartiles(sketch, ["lang", "source"])
    wide = lambda q, p: q.select(*[c for c in ("lang", "metric") if c in q.columns], *(F.col(c).alias(f"{p}_{c}") for c in ("total", "q25", "q50", "q75")))
    of_lang, of_all = wide(quartiles(sketch, ["lang"]), "l").withColumnRenamed("lang", "l_lang").withColumnRenamed("metric", "l_metric"), wide(quartiles(sketch, []), "a")
    both = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(of_all, "metric")
    pick = lambda c: F.when(F.col("total") >= min_group, F.col(c)).when(F.col("l_total") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    q = both.select("lang", "source", "metric", *(pick(c).alias(c) for c in ("q25", "q50", "q75")))
    cols = []
    for m, (spread, floor, both_sides) in FENCES.items():
        at = F.col("metric") == m
        cols.append(F.max(F.when(at, F.col("q50") + F.greatest(spread * (F.col("q75") - F.col("q50")), F.lit(floor)))).alias(f"high_{m}"))
        if both_sides:
            cols.append(F.max(F.when(at, F.col("q50") - F.greatest(spread * (F.col("q50") - F.col("q25")), F.lit(floor)))).alias(f"low_{m}"))
    return q.groupBy("lang", "source").agg(*cols)


def within_fences() -> Column:
    ok = F.lit(True)
    for m, value in metrics().items():
        ok = ok & (value <= F.col(f"high_{m}"))
        if FENCES[m][2]:
            ok = ok & (value >= F.col(f"low_{m}"))
    return F.coalesce(ok, F.lit(False))


def judged(docs: DataFrame) -> DataFrame:
    """The counts of every document with base_failed and kept."""
    rows = cut(measured(docs))
    limits = thresholds(rows).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return out.select("doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & within_fences()).alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The thresholds join to the documents; the counts are taken anew beside the text, which saves
    a shuffle of all texts.
    """
    limits = cut(thresholds(measured(docs)))
    names = [c for c in limits.columns if c not in ("lang", "source")]
    limits = limits.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.struct(*names).alias("limits"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    row = row.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left").select("row", F.col("row.text").cast("string").alias("text"), "limits")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = counts(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("limits"), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=["row", "limits", *COUNTS])

    schema = f"row {row.schema['row'].dataType.simpleString()}, limits {row.schema['limits'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    kept = map_batches(row, run, schema).select("row", *COUNTS, *(F.col(f"limits.{n}").alias(n) for n in names)).filter(~base_failed() & within_fences())
    return kept.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the base counts, base_failed and kept of every document."""
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")


def _sql() -> str:
    chars = r"'[\x20\x09-\x0D]+'"
    quart = lambda k, by: f"min(CASE WHEN 4 * upto >= {k} * total THEN bin END) AS q{25 * k}"
    level = lambda by: f"""SELECT {by}{', ' if by else ''}metric, max(total) AS total, {', '.join(quart(k, by) for k in (1, 2, 3))} FROM (
        SELECT *, sum(n) OVER (PARTITION BY {by}{', ' if by else ''}metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}{', ' if by else ''}metric) AS total
        FROM (SELECT {by}{', ' if by else ''}metric, bin, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""  # noqa: E731
    value = {"punct": "1000 * n_punct // n_words", "symbols": "1000 * n_symbols // n_words", "caps": "1000 * n_caps // greatest(word_chars, 1)", "dup": "1000 * n_dup_lines // greatest(n_lines, 1)", "length": "100 * word_chars // n_words"}
    pick = lambda c: f"CASE WHEN o.total >= {MIN_GROUP} THEN o.{c} WHEN l.total >= {MIN_GROUP} THEN l.{c} ELSE a.{c} END AS {c}"
    fence = lambda m, s, f: f"max(CASE WHEN metric = '{m}' THEN q50 + greatest({s} * (q75 - q50), {f}) END) AS high_{m}, max(CASE WHEN metric = '{m}' THEN q50 - greatest({s} * (q50 - q25), {f}) END) AS low_{m}"
    ok = " AND ".join(f"v_{m} <= high_{m}" + (f" AND v_{m} >= low_{m}" if FENCES[m][2] else "") for m in FENCES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, {chars}), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
  (length(text) - length(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g')))::BIGINT AS n_punct, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_caps
  FROM d JOIN w USING (r) LEFT JOIN again USING (r) LEFT JOIN ln USING (r)),
v AS (SELECT *, {', '.join(f'CASE WHEN n_words > 0 THEN {x} END AS v_{m}' for m, x in value.items())} FROM c),
long AS ({' UNION ALL '.join(f"SELECT lang, source, '{m}' AS metric, v_{m} AS x FROM v WHERE n_words > 0" for m in value)}),
sketch AS (SELECT lang, source, metric, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS bin, count(*) AS n FROM long GROUP BY ALL),
o AS ({level('lang, source')}), l AS ({level('lang')}), a AS ({level('')}),
q AS (SELECT o.lang, o.source, o.metric, {', '.join(pick(x) for x in ('q25', 'q50', 'q75'))} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN a ON o.metric = a.metric),
t AS (SELECT lang, source, {', '.join(fence(m, s, f) for m, (s, f, _) in FENCES.items())} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words) AND coalesce({ok}, false) AS kept
FROM v LEFT JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source
"""


SQL = _sql()
