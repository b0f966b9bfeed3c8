"""What is known of a repository: languages, folders, tree, starter questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import extension
from lodestone.params import DEFAULTS, STARTERS


def language_stats(files: DataFrame, by: list[str], most: int = DEFAULTS.top_languages) -> DataFrame:
    """(*by, language, files, pct): the most frequent languages with their rounded (half-even) share."""
    counts = files.groupBy(*by, "language").agg(F.count("*").alias("files"))
    total = F.sum("files").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("files").desc(), "language"))
    out = counts.withColumn("pct", F.bround(F.lit(100.0) * F.col("files") / total).cast("int")).withColumn("r", rank)
    return out.where(F.col("r") <= most).drop("r")


def sizes(files: DataFrame, by: list[str]) -> DataFrame:
    """(*by, files, bytes) of files with their length."""
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum(F.col("length").cast("long")).alias("bytes"))


def chunk_counts(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(*by, chunks, lines) of chunks with their first and last line."""
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.sum((F.col("end_line") - F.col("start_line") + 1).cast("long")).alias("lines"))


def top_extensions(paths: DataFrame, most: int = 15) -> DataFrame:
    """(extension, files): the most frequent extensions of all walked paths, ties by extension."""
    counts = paths.select(extension(F.col("path")).alias("extension")).where("extension != ''").groupBy("extension").agg(F.count("*").alias("files"))
    return counts.orderBy(F.desc("files"), "extension").limit(most)


def listed(chunks: DataFrame, by: list[str], most: dict[str, int] | None = None) -> DataFrame:
    """(*by, files, functions, classes): the first distinct paths by name, and the first names of functions (methods
    too) and classes by path and line. Ranks are cut before rows come together, so a row gathers ``most`` at most."""
    most = most or {"files": 20, "functions": 15, "classes": 10}
    place = F.struct("file_path", "start_line", "name")
    none = F.struct(F.col("file_path"), F.lit(0).alias("start_line"), F.lit("").alias("name"))
    of = lambda kind, rows, at, value: rows.select(*by, F.lit(kind).alias("kind"), at.alias("at"), F.col(value).alias("value"))
    named = chunks.withColumn("start_line", F.col("start_line").cast("int")).where(F.coalesce("name", F.lit("")) != "")
    rows = of("files", chunks.select(*by, "file_path").distinct(), none, "file_path")
    rows = rows.unionByName(of("functions", named.where(F.col("chunk_type").isin("function", "method")), place, "name"))
    rows = rows.unionByName(of("classes", named.where("chunk_type = 'class'"), place, "name"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("at"))).where(F.col("r") <= max(most.values()))
    gathered = lambda kind: F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & (F.col("r") <= most[kind]), F.struct("r", "value"))))["value"].alias(kind)
    return ranked.groupBy(*by).agg(*[gathered(k) for k in ("files", "functions", "classes")])


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)


def folder_names(paths: DataFrame) -> DataFrame:
    return paths.select(F.explode(folders(F.col("path"))).alias("name")).distinct()


def tree(paths: DataFrame) -> DataFrame:
    """(parent, name, kind, depth, ordinal): each folder and file once, folders first, then by lower-case name."""
    parts = F.split("path", "/")
    n = F.size(parts)
    level = lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "/").alias("parent"),
        F.get(parts, i).alias("name"),
        F.when(i == n - 1, "file").otherwise("directory").alias("kind"),
        i.alias("depth"),
    )
    nodes = paths.select(F.explode(F.transform(F.sequence(F.lit(0), n - 1), level)).alias("x")).select("x.*").distinct()
    order = Window.partitionBy("parent").orderBy("kind", F.lower("name"), "name")
    return nodes.withColumn("ordinal", F.row_number().over(order))


def starters(paths: DataFrame, most: int = 4) -> DataFrame:
    """(position, question): questions of the patterns that some folder or file name contains, each once."""
    spark = paths.sparkSession
    names = folder_names(paths).union(paths.select(F.lower(F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1)).alias("name"))).distinct()
    rows = [(2 * i + j, s[0], s[1 + j]) for i, s in enumerate(STARTERS) for j in (0, 1)]
    patterns = F.broadcast(spark.createDataFrame(rows, "at int, pattern string, question string"))  # fixed, 30 rows
    found = patterns.join(names, F.contains(names["name"], patterns["pattern"])).groupBy("question").agg(F.min("at").alias("at"))
    first = found.orderBy("at").limit(most).select("at", "question")
    few = first.agg(F.count("*").alias("n")).where("n < 3").select(F.lit(1000).alias("at"), F.lit("What does the main entry point do?").alias("question"))
    return first.unionByName(few).select(F.row_number().over(Window.orderBy("at")).alias("position"), "question")
