"""Every query beside its SQL, as the rows of both."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = Counter(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert found == expected


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fusion", "hybrid_search"])
def test_several_questions_at_once(spark, duck, sf_dir, monkeypatch, name):
    """Every tenth benchmark item in place of every hundredth, which at this size is one question."""
    from lodestone.operators import lexical
    from lodestone.plans import queries as q

    tenth = lambda s: s.replace("% 100 = 0", "% 10 = 0")
    monkeypatch.setattr(q, "asked", lambda spark, d: lexical.question_terms(q.table(spark, d, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "text")))
    monkeypatch.setattr(q, "search_set", lambda spark, d: q.table(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")))
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(tenth(ORACLES[name]))
    names = [c[0] for c in result.description]
    assert found == Counter(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert len({r["query_id"] for r in df.select("query_id").collect()}) == 4


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
