"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lowered, digits to 0, white space to single spaces) and hashed. Per host a line's frequency is
the number of distinct texts that hold it: exact copies of a document count once, and a line that a text repeats counts
once. Lines in more than LIMIT_DOCS texts of their host, or in more than LIMIT_SHARE of its texts (and LEAST_DOCS of
them), are removed. A document is rejected if it fails the base rules, or if too few of its words are left: fewer than
KEEP_WORDS, or less than KEEP_SHARE of what it had.

A text is read once, for its counts and its lines' hashes; it is never shuffled. Counts of (host, line, text) are summed
where they arise, then per (host, line). Only lines over a limit are joined back, those that many rows hold by broadcast
(at most common.HEAVY of them), so one line in a third of all documents loads no single task.

Repeated windows of three words are found by sorting their hashes within the text (64 bits; two windows of one text that
differ are taken for equal with a chance below 1e-8 even in a text of a million words).

Defined cases: a null text has no words and fails the base rules, as does an empty one; a null host is a host of its
own; lines without a word count nowhere; very long texts are read whole; repeated rows and ids get the same result each;
extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_counted, stored, table

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Base rules: the fewest words, and the largest part (in hundredths) of words in repeated windows.
BASE_WORDS, BASE_REPEATED = 50, 50
#: A line is removed in more than so many distinct texts of a host, or in more than this share of them, if in more than
#: the least number.
LIMIT_DOCS, LIMIT_SHARE, LEAST_DOCS = 20, 0.1, 5
KEEP_WORDS, KEEP_SHARE = 50, 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.translate(ascii_lower(F.trim(line, F.lit(SPACES))), "123456789", "000000000"), SPACE, " ")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three that the array holds twice or more."""
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    def starts(ordered: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, k: same(k - 1, x) | same(k + 1, x))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    # Each array is bound by a transform of one element, as what is named twice would be computed twice, a time per element.
    bound = lambda value, use: F.transform(F.array(value), use)[0]
    ordered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # Most texts have no window twice and are done with the first comparison.
    found = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), bound(ordered(h), lambda o: bound(starts(o), covered))).otherwise(0))
    return F.when(F.size(words) >= WINDOW, found).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, text, host) to row, doc_id, host, copy (hash of the text), the counts, and lines: hash and words of each
    line that has a word."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("host").cast("string").alias("host"))
    rows = rows.select("doc_id", "host", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    line = lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words_of(x)).alias("words"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host"),
        F.xxhash64("text").alias("copy"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.transform("lines", line).alias("lines"),
    )


def lines_over(rows: DataFrame) -> DataFrame:
    """host, line, n (rows of ``lines`` that have it) of the lines that more distinct texts of a host hold than a limit
    allows."""
    held = rows.select("host", "copy", F.explode("lines.line").alias("line")).groupBy("host", "line", "copy").agg(F.count("*").alias("n"))
    often = held.groupBy("host", "line").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") > LEAST_DOCS)
    hosts = rows.groupBy("host", "copy").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("of"))
    return often.join(hosts, "host").where((F.col("docs") > LIMIT_DOCS) | (F.col("docs") > LIMIT_SHARE * F.col("of"))).select("host", "line", "n")


def line_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, text, host) to one row per document: doc_id, counts, base_failed, removed_lines, removed_words, kept."""
    rows = stored(measured(docs), "line-rows")
    over = stored(lines_over(rows), "lines-over")
    lines = rows.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*")
    lost = join_counted(lines, over, ["host", "line"]).groupBy("row").agg(F.count("*").alias("removed_lines"), F.sum("words").alias("removed_words"))
    out = rows.drop("lines", "host", "copy").join(lost, "row", "left")
    removed = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("removed_lines", "removed_words")]
    out = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *removed)
    out = out.withColumn("base_failed", (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words")))
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= KEEP_WORDS) & (left >= KEEP_SHARE * F.col("n_words")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_words")


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT r, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), o AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS docs FROM l GROUP BY host, norm) JOIN (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host) USING (host)
  WHERE docs > 20 OR (docs > 5 AND docs > 0.1 * n)
), g AS (
  SELECT r, count(*) AS lines, sum(words) AS words FROM l JOIN o USING (host, norm) GROUP BY r
), u AS (
  SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM l GROUP BY r
), t AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM (SELECT r, i, list_slice(w, i, i + 2) AS win FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d))
), p AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS k FROM t WHERE n > 1) GROUP BY r
), q AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(g.lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(g.words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN u USING (r) LEFT JOIN p USING (r) LEFT JOIN g USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 50 AND n_words - removed_words >= 0.5 * n_words AS kept
FROM q
"""
