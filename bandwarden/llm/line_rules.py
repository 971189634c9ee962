"""Quality rules with cross-document line frequency, in DataFrame functions only.

Method: every line is normalised (A-Z folded, white space runs to one space, ends trimmed) and hashed; for each host,
which in ``documents`` is the source, the documents that have the line are counted.  A line is boilerplate when more
than ``LINE_DOCS`` documents of the host have it, however large the host is.  Such lines are removed, and a document that loses more than ``DEPLETED_PERCENT`` per cent of its words is rejected.

The base rules are counted inside each row by array functions, without a shuffle: five-word windows are hashed, sorted
with their places, and equal neighbours mark the words they cover.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, written

WINDOW = 5
LINE_DOCS = 20
DEPLETED_PERCENT = 70
LEAST_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_SPACE = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def normal_line(line: Column) -> Column:
    folded = F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(folded, _SPACE, " "), F.lit(" "))


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))


def _row() -> Column:
    """Names a row by its id, source and text; rows that repeat all three share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), _host(), F.coalesce(F.col("text").cast("string"), F.lit("")))


def row_counts(docs: DataFrame) -> DataFrame:
    """Base counts of every row and its distinct normalised lines as (hash, words of all such lines)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), _host().alias("host"), text.alias("text"))
    # Each step is a projection of its own: what a lambda refers to has to be a column, or it would run per element.
    rows = docs.select("*", F.transform(word_list(F.col("text")), lambda w: F.xxhash64(w)).alias("words"),
                       F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0).alias("lines"))
    places = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", F.transform(places, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])).alias("windows"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select("*", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
                       .alias("sorted"))
    twin = lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"])
    rows = rows.select("*", F.when(F.col("sorted").isNotNull(), F.sort_array(F.transform(
        F.filter("sorted", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))).alias("marked"))
    covered = F.aggregate(F.transform("marked", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("marked", i + 1) - p, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, b: a + b)
    line_rows = F.transform("lines", lambda x: F.struct(
        F.xxhash64(normal_line(x)).alias("hash"), F.size(word_list(x)).cast("long").alias("words")))
    return rows.select(
        "doc_id", "row", "host", F.size("words").cast("long").alias("n_words"), F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), line_rows.alias("lines"))


def common_lines(counts: DataFrame) -> DataFrame:
    """``host``, ``hash`` of the lines that too many documents of the host have."""
    each = counts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    return each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > LINE_DOCS).select("host", "hash")


def line_frequency_rules(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts of every row, and (row, hash) of the lines to remove.

    A null text has no words and fails the base rule; a null source is a host of its own; rows that repeat a document
    count as documents of their own and get the same verdict; columns other than doc_id, source and text are ignored."""
    counts = written(row_counts(docs))
    common = written(common_lines(counts))
    lines = counts.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.hash", "line.words")
    # Rows that repeat a document share ``row``; taking the words as a maximum per line keeps them from adding up.
    own = counts.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    hits = lines.join(common, ["host", "hash"])
    lost = hits.groupBy("row").agg(F.sum("words").alias("words")).join(own, "row").select(
        "row", (F.col("words") / F.col("copies")).alias("lost"))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * F.coalesce("lost", F.lit(0)) > DEPLETED_PERCENT * F.col("n_words")
    verdicts = counts.join(lost, "row", "left").select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & ~depleted).alias("kept"))
    return verdicts, hits.select("row", "hash").distinct()


def clean_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, each once, without their host's common lines; blank lines stay as they are.

    The columns come back as they were, also one that is named like a column used here."""
    verdicts, hits = line_frequency_rules(docs)
    gone = hits.groupBy("row").agg(F.collect_set("hash").alias("gone"))
    kept = verdicts.where("kept").select("row").distinct().join(gone, "row", "left").select("row", F.struct("gone").alias("found"))
    packed = docs.select(_row().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = packed.join(kept, "row")
    left = F.when(F.col("found.gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.filter(
        F.split("doc.text", "\n"), lambda x: (F.length(F.trim(x, F.lit(SPACES))) == 0) | ~F.array_contains("found.gone", F.xxhash64(normal_line(x)))), "\n"))
    return joined.select(*[left.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op3_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency_rules(table(spark, folder, "documents"))[0].drop("row")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (
  SELECT doc_id, host, line,
         trim(regexp_replace(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
common AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS docs FROM ln GROUP BY host, norm) WHERE docs > {LINE_DOCS}),
lost AS (SELECT doc_id, sum(n) AS n FROM ln SEMI JOIN common USING (host, norm) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS gone
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND NOT (100 * gone > {DEPLETED_PERCENT} * n_words) AS kept
FROM c"""
