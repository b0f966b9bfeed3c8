"""File names of many questions: beside every question with every file, and without a row of a pair on the way."""

import random
import re

from pyspark.sql import functions as F

from lodestone.catalog import QUERIES
from lodestone.operators import filenames

MENTIONS = "query_id struct<a: int, b: int>, name string"


def test_pairs_are_those_of_all_questions_and_files(spark, monkeypatch):
    """Names within names, several in a question, ids that are null or have several paths, blocks of a few values."""
    monkeypatch.setattr(filenames, "QUESTIONS", 3)
    monkeypatch.setattr(filenames, "FILES", 2)
    rng = random.Random(5)
    names = ["1.py", "11.py", "a1.py", "é_1.md", "b-1.md", "1.md", "none.ts", "x.py", "a.py2.md"]
    asked = {((None if q == 7 else q, q % 2), n) for q in range(40) for n in rng.sample(names, rng.randrange(1, 5))}
    paths = ["x/1.PY", "11.py", "d/a11.py", "b-1.md", "é_1.MD", "x.py", "1.py/other.md", "a.py2.md", "11.py1.md", "", None]
    files = [(None if i % 11 == 0 else i % 60, rng.choice(paths)) for i in range(90)]
    expected = {(q, i) for q, n in asked for i, path in files if path and n in path.split("/")[-1].lower()}
    named = spark.createDataFrame(sorted(asked, key=repr), MENTIONS)
    found = filenames.matched_pairs(named, spark.createDataFrame(files, "id int, file_path string"), "id")
    rows = [((r["query_id"]["a"], r["query_id"]["b"]), r["id"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert {i for _, i in expected} >= {None} and {q for q, _ in expected} >= {(None, 1)}
    assert filenames.matched_pairs(named.limit(0), spark.createDataFrame(files, "id int, file_path string"), "id").count() == 0


def test_no_row_of_a_pair_is_dealt_or_compared(spark, sf_dir):
    """What follows the last shuffle only writes products out, and the rows before it are far fewer than the pairs."""
    plan = QUERIES["filename_match"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    after, repartition, _ = plan.partition("Repartition")
    assert repartition and not re.search("Aggregate|Join|Sort|Window", after)
    named = spark.range(600).select(F.struct(F.col("id").alias("a"), F.lit(0).alias("b")).alias("query_id"), F.lit("1.py").alias("name"))
    files = spark.range(1200).select("id", F.concat(F.col("id") * 10 + 1, F.lit(".py")).alias("file_path"))
    found = filenames.matched_pairs(named, files, "id")
    assert found.count() == found.distinct().count() == 600 * 1200
    assert found.rdd.getNumPartitions() == filenames.WAVES * spark.sparkContext.defaultParallelism
