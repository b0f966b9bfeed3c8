"""File names in questions, found among the files by their trigrams: an equi-join, then a look at the whole name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import basename, filename_mentions
from lodestone.sources.shared import stored

#: Questions and files of one ask go together in arrays of about so many. Spark holds the product of two arrays at once.
QUESTIONS, FILES = 256, 512
#: Tasks a core that write out the pairs.
WAVES = 8


def mentions(questions: DataFrame) -> DataFrame:
    """(query_id, question) to distinct (query_id, name)."""
    return questions.select("query_id", F.explode(filename_mentions(F.col("question"))).alias("name")).distinct()


def trigrams(name: Column) -> Column:
    """The distinct runs of three characters; a mention has at least three."""
    n = F.length(name)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(name, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class NameIndex:
    """Trigrams of base names: (gram, base), and how many names have each."""

    def __init__(self, bases: DataFrame):
        """``bases``: distinct ``base``, lower-case."""
        self.grams = bases.select("base", F.explode(trigrams(F.col("base"))).alias("gram"))
        self.counts = self.grams.groupBy("gram").agg(F.count("*").alias("n"))

    def search(self, names: DataFrame) -> DataFrame:
        """(name) to (name, base) of the base names that contain it. Each name is looked up by its rarest trigram; one
        whose rarest has no base name at all is contained in none."""
        asked = names.select("name").distinct().select("name", F.explode(trigrams(F.col("name"))).alias("gram"))
        weighed = asked.join(self.counts, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
        rarest = weighed.where("m.n > 0").select("name", F.col("m.gram").alias("gram"))
        return rarest.join(self.grams, "gram").where(F.contains("base", F.col("name"))).select("name", "base")


def matched_files(named: DataFrame, files: DataFrame) -> DataFrame:
    """Mentions (query_id, name) and files (file_path, ...) to query_id, name and the files whose base name contains it."""
    keyed = files.withColumn("base", basename(F.col("file_path")))
    found = NameIndex(keyed.select("base").distinct()).search(named)
    return named.join(found, "name").join(keyed, "base").drop("base")


def matched_pairs(named: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Mentions (query_id, name) and files (file_path, ``key``) to the distinct pairs of query_id and ``key``, for many questions.

    Pairs are made last and in one place, as products of arrays: no shuffle, sort or hash table sees a row of a pair. An
    ask is a name and the names before it in the same question that share a file with it; its files are those of the name
    and of none of these. So a question's asks have no file in common, and products need no distinct after them.
    """
    named = stored(named, "mentions")
    keyed = files.select(F.struct(key).alias("file"), basename(F.col("file_path")).alias("base"))  # a struct is never null
    found = NameIndex(keyed.select("base").distinct()).search(named)
    has = stored(found.join(keyed, "base").select("name", "file").distinct(), "named-files")
    shared = has.join(has.select("file", F.col("name").alias("before")), "file").where("before < name").select("name", "before").distinct()

    known = named.join(has.select("name").distinct(), "name", "left_semi").groupBy("query_id").agg(F.collect_set("name").alias("names"))
    each = known.select("query_id", "names", F.explode("names").alias("name"))
    each = each.select("query_id", "name", F.explode_outer(F.filter("names", lambda n: n < F.col("name"))).alias("before"))
    each = each.join(shared.withColumn("both", F.lit(True)), ["name", "before"], "left")
    asks = each.groupBy("query_id", "name").agg(F.sort_array(F.collect_set(F.when(F.col("both"), F.col("before")))).alias("but"))
    asks = stored(asks.select(F.struct("name", "but").alias("ask"), "query_id"), "asks")

    distinct = asks.select("ask", F.col("ask.name").alias("name")).distinct()
    gone = distinct.select("ask", F.explode("ask.but").alias("name")).join(has, "name").select("ask", "file")
    rest = distinct.join(has, "name").select("ask", "file").join(gone, ["ask", "file"], "left_anti")
    cells = _blocks(asks, "query_id", QUESTIONS).join(_blocks(stored(rest, "ask-files"), "file", FILES), "ask")
    dealt = cells.select("query_ids", F.transform("files", lambda f: f[key]).alias("files")).repartition(WAVES * named.sparkSession.sparkContext.defaultParallelism)
    return dealt.select(F.explode("query_ids").alias("query_id"), "files").select("query_id", F.explode("files").alias(key))


def _blocks(rows: DataFrame, column: str, size: int) -> DataFrame:
    """(ask, ``column``) to (ask, array of ``column``), some ``size`` values in each; ``rows`` are stored."""
    n = rows.groupBy("ask").agg(F.ceil(F.count("*") / size).alias("n"))
    block = F.pmod(F.xxhash64(column), F.col("n")).alias("block")
    return rows.join(n, "ask").groupBy("ask", block).agg(F.collect_list(column).alias(f"{column}s")).drop("block")


def unmatched(named: DataFrame, files: DataFrame) -> DataFrame:
    """Mentions (query_id, name) that no file's base name contains."""
    found = NameIndex(files.select(basename(F.col("file_path")).alias("base")).distinct()).search(named)
    return named.join(found.select("name").distinct(), "name", "left_anti").select("query_id", "name")
