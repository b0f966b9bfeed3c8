"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ten consecutive words (an item of fewer words is one window). A window is
contained in a document only if all its words are, so its rarest word is a sufficient prefix: only document words
that are some window's rarest word are joined. A joined word fixes where the window would have to start; windows
that would begin before the document's first word or end after its last are out (position and length bounds), and
the rest is verified word by word. Occurrences carry the id of their window; the items that have it are joined last.

Rarity: the occurrences of every window word are counted over all documents, and the word with the fewest is the
window's prefix; a window with a word that no document holds occurs nowhere.

A row per document word would be most of the cost, so a bit table of the wanted words' hashes first thins the word
array in place; what passes is exploded with its neighbourhood (enough for any window over it), joined exactly and
verified. Texts are never shuffled. Windows are broadcast in blocks of at most ``BLOCK_WINDOWS``, however large the
benchmark.

Defined cases: very long texts are read whole; a null or empty text has no words, is not hit and has the digest of the empty string; null item ids
count as the id ``null``; repeated rows get the same result each; repeated items count once; extra columns are
ignored; an empty benchmark hits nothing; empty documents table in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, doc_key, stored, table

WINDOW_WORDS = 10
#: A block holds so many windows of ten words at most: some 50 MB when broadcast.
BLOCK_WINDOWS = 100_000
#: Bits of the table that thins the words; a fuller table only passes more words on to the join.
BITS = 2**17
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def bit_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITS)).cast("int")


def bit_table(words: DataFrame) -> Column:
    """The bits of ``words.word`` as an array of longs that the plan holds as one constant."""
    longs = [0] * (BITS // 64)
    for (i,) in words.select(bit_of(F.col("word"))).distinct().collect():  # at most BITS rows
        longs[i >> 6] |= 1 << (i & 63)
    return F.expr("array(" + ",".join(f"{x - 2**64 if x >> 63 else x}L" if x != 2**63 else "bigint(-9223372036854775808)" for x in longs) + ")")


def wanted(words: Column, hashes: Column, bits: Column) -> Column:
    """Places (from 0) of the words whose bit is set. By lower(), which any two words equal under A-Z lowering share."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.getbit(F.get(bits, F.shiftright(F.get(hashes, i), 6)), F.get(hashes, i).bitwiseAND(63)) == 1)


def thinned(docs: DataFrame, words: DataFrame) -> DataFrame:
    """key, doc_id, w (words) and at (places of words that may be among ``words.word``)."""
    d = docs.select("doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("key"), words_of(F.col("text")).alias("w"))
    d = d.withColumn("hashes", F.transform("w", lambda x: bit_of(F.lower(x))))
    at = F.when(F.size("w") > 0, wanted(F.col("w"), F.col("hashes"), bit_table(words))).otherwise(F.array().cast("array<int>"))
    return d.select("key", "doc_id", "w", at.alias("at"))


def item_windows(benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, text) to distinct windows: id, window (array of words), items (ids of the items that have it)."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window_words - 1), F.lit(1)))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(window_words)))).alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item_id").alias("items")).withColumn("id", F.xxhash64("window"))


def rarest(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Of each window that may occur the word that all documents hold least often: id, times, word, at."""
    spread = windows.select("id", F.posexplode("window").alias("at", "raw")).select("id", "at", F.lower("raw").alias("word"))
    vocabulary = stored(spread.select("word").distinct(), "decon-vocabulary")
    # Outer: see below.
    words = docs.select(F.explode_outer(words_of(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))
    counts = words.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").count()  # at most ten words a window
    best = spread.join(counts, "word", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("times"), "word", "at")).alias("m"))
    return best.where("m.times > 0").select("id", "m.*")


def occurrences(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (key, doc_id, n_words), and every place where a window occurs: key, start (from 0), n, id."""
    base = docs.select(doc_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    prefix = stored(windows.join(rarest(docs, windows), "id").select("word", F.col("at").alias("before"), F.size("window").alias("n"), "window", "id"), "decon-prefix")

    d = thinned(docs, prefix.select("word"))
    reach = WINDOW_WORDS - 1 if windows.isEmpty() else windows.agg(F.max(F.size("window"))).first()[0] - 1
    near = F.transform("at", lambda i: F.struct(i.alias("pos"), F.lower(F.get("w", i)).alias("word"), F.least(i, F.lit(reach)).alias("left"), F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near")))
    # Outer: the filter that Spark infers from an inner explode would compute every array a second time.
    places = d.select("key", F.explode_outer(near).alias("p")).select("key", "p.*")
    joined = places.join(F.broadcast(prefix), "word")  # at most BLOCK_WINDOWS rows
    first = F.col("left") - F.col("before")
    inside = (first >= 0) & (first + F.col("n") <= F.size("near"))
    same = F.transform(F.slice("near", F.when(inside, first + 1).otherwise(1), F.col("n")), ascii_lower) == F.col("window")
    return base, joined.where(inside & same).select("key", (F.col("pos") - F.col("before")).alias("start"), "n", "id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: key, doc_id, n_words, n_hit, items (sorted), contaminated."""
    docs = docs.select("doc_id", "text")
    windows = stored(item_windows(benchmark, window_words), "decon-windows")
    n_blocks = max(1, -(-windows.count() // block_windows))
    found = None
    for block in range(n_blocks):
        base, hits = occurrences(docs, windows.where(F.pmod("id", F.lit(n_blocks)) == block))
        found = hits if found is None else found.unionByName(hits)
    found = stored(found.distinct(), "decon-hits")
    hits = found.groupBy("key", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("key").orderBy("start")
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.withColumn("covered", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), reach)))
    counted = spans.groupBy("key").agg(F.sum("covered").alias("n_hit"))
    # A window that many items share is carried as its id up to here, and its items come in once a document.
    owners = windows.select("id", F.explode("items").alias("item"))
    items = found.select("key", "id").distinct().join(owners, "id").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = base.join(counted, "key", "left").join(items, "key", "left")
    return out.select(
        "key",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), v AS (
  SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS win FROM (
    SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM v)
), h AS (
  SELECT DISTINCT p.r, p.i, p.n, v.item FROM p JOIN v ON v.win = list_slice(p.w, p.i, p.i + p.n - 1)
), c AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
