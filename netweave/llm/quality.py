"""Quality rules: repetition and length rules of single documents, then line frequency across documents."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import SPACE, WORD, col, join_back, keyed, text_of, words_of

WINDOW = 8


def base_counts(rows: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and __lines of the column ``__text``, and its ``copy``.

    ``copy`` is the hash of the text without white space, equal for exact copies.

    Words in repeated windows: windows are hashed to 64 bits; only in texts with an equal pair are
    they sorted, each with its place, and the places of windows with an equal neighbour summed up
    as the union of their spans.
    """
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = rows.select("*", words_of(text).alias("__words"), lines.alias("__lines"))
    rows = rows.select("*", F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"))
    h = F.col("__h")
    n = F.size(h)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    rows = rows.select("*", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("__win"))
    win = F.col("__win")
    repeats = F.size(F.array_distinct(win)) < F.size(win)
    by_hash = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.select("*", F.when(repeats, by_hash).alias("__s"))
    s = F.col("__s")

    def twin_place(x: Column, i: Column) -> Column:
        return F.when(F.get(s, i - 1)["x"].eqNullSafe(x["x"]) | F.get(s, i + 1)["x"].eqNullSafe(x["x"]), x["i"])

    places = F.sort_array(F.filter(F.transform(s, twin_place), lambda x: x.isNotNull()))
    rows = rows.select("*", places.alias("__p"))
    p = F.col("__p")
    spans = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    covered = F.aggregate(spans, F.lit(0), lambda a, x: a + x)
    bare = F.regexp_replace(text, f"{SPACE}+", "")
    return rows.select(
        "*",
        n.cast("long").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        F.xxhash64(bare).alias("copy"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).drop("__words", "__h", "__win", "__s", "__p")


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), f"{SPACE}+", " "))


def judge(
    docs: DataFrame,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_docs: int = 5,
    min_share: float = 0.02,
    many_docs: int = 1000,
    min_left: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Judge each row: base counts, base_failed, kept, and the code points of its lines before and after.

    A line (normalised, hashed) is above the limits of its host if at least ``min_docs`` distinct
    documents of the host have it, and these are at least ``min_share`` of the host's documents or ``many_docs``.
    Such lines are removed, and a document with less than ``min_left`` of its line text left is rejected.

    Documents count as distinct by their whole text without white space: exact copies are one
    document, so copying does not turn a clean text's lines into boilerplate. Counts go through
    (host, line, document) with map-side combine, so a line that a third of all rows has is
    spread over many tasks before it meets in one number.

    Null text counts as empty and fails the base rules; null hosts form one host. Repeated rows
    are judged alike. Ties, a share or a count exactly at a limit, are above it. Very long texts are
    judged whole: a row holds its lines. An empty table gives no rows.
    """
    return _judged(docs, min_words, max_repeat_percent, min_docs, min_share, many_docs, min_left, id_col, text_col, host_col).drop("frequent")


def _judged(
    docs: DataFrame, min_words: int, max_repeat_percent: int, min_docs: int, min_share: float, many_docs: int, min_left: float, id_col: str, text_col: str, host_col: str
) -> DataFrame:
    """``judge`` with the hashes of each row's lines above the limits, ``frequent``; null if it has none."""
    rows = keyed(docs, col(id_col).alias("doc_id"), col(host_col).cast("string").alias("host"), text_of(text_col).alias("__text"))
    rows = base_counts(rows)
    normal = F.transform("__lines", lambda x: normal_line(x))
    rows = rows.withColumn("lines", F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), F.char_length(x).alias("chars"))))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    rows = scratch.materialize(rows.withColumn("base_failed", failed).drop("__text", "__lines"), "judged")
    lines = rows.select("__row", "host", "copy", F.explode("lines").alias("l")).select("__row", "host", "copy", "l.line", "l.chars")
    counts = lines.groupBy("host", "line").agg(F.countDistinct("copy").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    hosts = rows.filter(F.size("lines") > 0).groupBy(F.col("host").alias("h")).agg(F.countDistinct("copy").alias("host_docs"))
    above = (F.col("n_docs") >= F.col("host_docs") * F.lit(min_share)) | (F.col("n_docs") >= many_docs)
    limits = counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).filter(above)
    limits = scratch.materialize(limits.select(F.col("host").alias("h"), F.col("line").alias("frequent")), "frequent_lines")
    removed = lines.join(limits, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("frequent")))
    removed = removed.groupBy("__row").agg(F.sum("chars").alias("removed_chars"), F.collect_set("line").alias("frequent")).withColumnRenamed("__row", "__r")
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    out = rows.withColumn("line_chars", total).join(removed, F.col("__row") == F.col("__r"), "left")
    out = out.withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0).cast("long")))
    depleted = F.col("line_chars") - F.col("removed_chars") < F.col("line_chars") * F.lit(min_left)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select(
        "__row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "removed_chars", "frequent"
    )


def without_lines(text: Column, frequent: Column) -> Column:
    """The text without the lines of these hashes; blank lines stay, and a text without such lines is unchanged."""
    left = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(frequent, F.xxhash64(normal_line(x)))))
    return F.when(frequent.isNull(), text).otherwise(F.array_join(left, "\n"))


def keep_good(docs: DataFrame, chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their text without the lines above the limits.

    ``chars_col``, if ``docs`` has it, is set to the code points of a text that lost lines. Null and
    empty texts fail the base rules and go, null hosts are one host, repeated rows stay as often as
    they come, and an empty table gives none. Columns keep their names and order, whatever they are.
    """
    docs = scratch.as_files(docs)
    given = inspect.signature(judge).bind(docs, **options)
    given.apply_defaults()
    text_col = given.arguments["text_col"]
    rows, got = join_back(docs, _judged(*given.args).filter("kept").select("__row", "frequent"))
    cut, clean = got["frequent"].isNotNull(), without_lines(text_of(text_col), got["frequent"])
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {text_col: clean, chars_col: F.char_length(clean)}
    return rows.select(*[(F.when(cut, new[c].cast(kinds[c])).otherwise(col(c)).alias(c) if c in new else col(c)) for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("__row")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT k, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
win2 AS (SELECT k, i, list_slice(words, i, i + 7) AS g FROM win),
twin AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win2),
span AS (SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS s FROM twin WHERE c > 1),
rep AS (SELECT k, sum(s)::BIGINT AS n_repeat_words FROM span GROUP BY k),
b AS (
  SELECT w.k, doc_id, source, lines, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS copy
  FROM w LEFT JOIN rep USING (k)),
l AS (
  SELECT k, source, copy, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT k, source, copy, unnest(lines) AS x FROM b)),
c AS (SELECT source, line, count(DISTINCT copy) AS n_docs FROM l GROUP BY source, line HAVING count(DISTINCT copy) >= 5),
h AS (SELECT source, count(DISTINCT copy) AS host_docs FROM b WHERE len(lines) > 0 GROUP BY source),
f AS (SELECT c.source, line FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n_docs >= host_docs * 0.02::DOUBLE OR n_docs >= 1000),
r AS (
  SELECT l.k, sum(length(l.line))::BIGINT AS line_chars,
         coalesce(sum(length(l.line)) FILTER (WHERE f.line IS NOT NULL), 0)::BIGINT AS removed_chars
  FROM l LEFT JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY l.k),
z AS (
  SELECT b.*, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(removed_chars, 0)::BIGINT AS removed_chars,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM b LEFT JOIN r USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (line_chars - removed_chars < line_chars * 0.5::DOUBLE) AS kept, line_chars, removed_chars
FROM z
"""
