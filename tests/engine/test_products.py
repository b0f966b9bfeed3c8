"""The searches by matrix products: beside the column functions, on copies, odd rows and many queries."""

import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.text import cosine
from lodestone.operators import ivf, products, vector


def test_the_best_are_those_of_all_pairs(spark):
    """Groups of copies, near ties within and beyond nine digits, small parts: as every pair scored and ranked by Spark."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 7 if i < 200 else i % 40] * (1 + i % 3) + (1e-9 * i if i % 5 == 0 else 0)]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(5)
    asked = vectors.where("vec_id % 20 = 0").select(F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"), F.col("embedding").alias("query_vector"))
    pairs = vectors.crossJoin(asked).select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("query_vector")), 9).alias("c"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id"))).where("rank <= 9")
    expected = {(r["query_id"], r["vec_id"], r["rank"], max(0.0, r["c"])) for r in ranked.collect()}
    found = vector.nearest(vectors, asked, 9)
    assert {(r["query_id"], r["vec_id"], r["rank"], r["similarity"]) for r in found.collect()} == expected
    assert {(r["query_id"], r["vec_id"]) for r in ivf.exact(vectors, asked, 9).collect()} == {x[:2] for x in expected}
    assert {(r["query_id"], r["vec_id"]) for r in ivf.Index(vectors).search(asked, 9, probes=1000).collect()} == {x[:2] for x in expected}


def test_no_row_is_made_of_a_pair(spark, monkeypatch):
    """Neither search joins queries with rows, and a task hands on some k rows a query, also of copies alone."""
    monkeypatch.setattr(products, "HELD", 64)
    vectors = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).repartition(2)
    asked = vectors.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = ivf.Index(vectors)
    for found in (vector.nearest(vectors, asked, 3), ivf.exact(vectors, asked, 3), index.search(asked, 3)):
        assert not re.search("Join|CartesianProduct", found._jdf.queryExecution().executedPlan().toString())
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == [(q, i + 1, i) for q in range(20) for i in range(3)]
    assert products.contenders(vectors, asked, 3, cosine=True).count() == 2 * 20 * 3


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, []), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [3.0]), (None, [0.0, 1.0])], "query_id string, query_vector array<double>")
    found = {(r["query_id"], r["vec_id"], r["similarity"]) for r in vector.nearest(vectors, asked, 5).collect()}
    half = 0.707106781
    assert found == {("a", 1, 1.0), ("a", None, half), ("a", 2, 0.0), ("c", 4, 1.0), (None, None, half), (None, 1, 0.0), (None, 2, 0.0)}
    assert vector.nearest(vectors, asked.limit(0), 5).count() == vector.nearest(vectors.limit(0), asked, 5).count() == 0


def test_terms_are_counted_without_postings(spark, sf_dir):
    """Document counts are those of the postings, also of compound words, and no postings are written for them."""
    from lodestone.functions.text import COMPOUND
    from lodestone.operators import lexical
    from lodestone.plans import queries

    rows = [(1, "parseHTML parse_html USA Usa"), (2, "_x A1b HTTPServer9 éA __"), (3, None), (4, ""), (5, "x " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {tuple(r) for r in lexical.document_counts(docs).collect()}
    assert counts == {tuple(r) for r in lexical.term_counts(lexical.postings(docs)).collect()}
    assert {("parse", 1), ("html", 1), ("usa", 1), ("a1b", 1), ("x", 2), ("server9", 1)} <= counts
    assert [re.findall(COMPOUND, t) for _, t in rows[:2]] == [["parseHTML", "parse_html", "USA"], ["_x", "HTTPServer9", "__"]]
    made = []
    original, lexical.postings = lexical.postings, lambda *a, **k: made.append(a)
    try:
        assert queries.term_stats(spark, sf_dir).count() > 0
    finally:
        lexical.postings = original
    assert not made


def test_python_has_few_rows_at_once(spark, monkeypatch):
    """Vectors and chunks leave in small batches; texts without tokens, and a null, have vectors of zeros."""
    import pandas as pd

    from lodestone.operators import chunk
    from lodestone.sources import embed

    def never(*a, **k):
        raise AssertionError("whole batches as pandas")

    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", never)
    assert pd  # the frames that are not made
    texts = spark.createDataFrame([("a", "one two two"), ("b", "..."), (None, None), ("c", "two one two")] + [(str(i), f"w{i}") for i in range(600)], "hash string, text string")
    found = {r["hash"]: r["embedding"] for r in embed.hashed_vectors(texts).collect()}
    assert len(found) == 604 and all(len(v) == 64 for v in found.values())
    assert found["a"] == found["c"] and set(found["b"]) == set(found[None]) == {0.0}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for h, v in found.items() if h not in ("b", None))
    assert sorted({abs(round(x, 4)) for x in found["a"]}) == [0.0, 0.4472, 0.8944]
    files = spark.createDataFrame([(f"{i}.py", f"def f{i}():\n    return {i}\n") for i in range(200)] + [("x.py", "def ("), ("y.py", None)], "path string, content string").coalesce(1)
    chunks = chunk.syntax_chunks(files)
    assert chunks.count() == 202 and chunks.where("chunk_type = 'function'").count() == 200
