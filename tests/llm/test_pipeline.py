"""The pipeline's stages: their decisions take effect and clean documents stay."""

import numpy as np

import corpus_pipeline as p
from lodestone.llm import quality
from lodestone.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sharding":
            assert out.columns == docs.columns
            docs = out.cache()
            kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert set(kept["near_dedup"]) < set(kept["quality"])
    assert len(set(kept["near_dedup"])) == len(kept["near_dedup"])
    assert set(kept["decontamination"]) < set(kept["near_dedup"])
    assert len(kept["quality"]) > 0.7 * table(spark, sf_dir, "documents").count()
    assert out.count() == len(kept["mixing"])
    assert sorted({r["shard"] for r in out.collect()}) == list(range(8))


def test_stages_on_odd_rows(spark, sf_dir):
    """Each stage's rows, in full: nulls, empty and repeated rows, ties in all but an extra column, clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, copies int"
    rows = [(1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, "same text here", "en", "a", 3, "x", 1), (3, "same text here", "en", "a", 3, "x", 1), (3, "same text here", "en", "a", 3, "w", 1), (None, "no id", "en", None, 4, "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    found = {name: sorted(map(tuple, stage(spark, docs, sf_dir).collect()), key=str) for name, stage in p.STAGES}
    assert found["quality"] == sorted(rows, key=str)
    assert found["near_dedup"] == sorted([rows[0], rows[4], rows[5]], key=str)  # null and empty are one text
    assert found["decontamination"] == sorted(rows, key=str)
    sizes = [len((r[1] or "").split()) for r in rows]
    assert sum(len((r[1] or "").split()) for r in found["mixing"]) <= 3 * sum(sizes)
    assert {r for r in found["mixing"]} <= {*rows}
    assert sorted((r[0] or 0, r[1]) for r in found["sharding"]) == sorted((r[0] or 0, len((r[1] or "").encode()) + 1) for r in rows)
    again = {name: sorted(map(tuple, stage(spark, docs.repartition(5), sf_dir).collect()), key=str) for name, stage in p.STAGES[:4]}
    assert again == {k: v for k, v in found.items() if k != "sharding"}


def test_repeated_and_null_ids(spark, monkeypatch):
    """A junk row takes only itself along, and a group keeps one row however its ids repeat."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = [f"word{i}" for i in range(300)]
    near = [" ".join([*words[:290], f"end{i}"]) for i in range(4)]
    rows = [(None, "clean one", "en", "a", 9), (None, "junk", "en", "a", 4), (None, "clean two", "en", "a", 9), (5, "clean three", "en", "a", 11), (5, "junk", "en", "a", 4), (6, "clean four", "en", "a", 10)]
    docs = spark.createDataFrame(rows, schema)

    class Long:  # defined here, so that it reaches the workers
        def score(self, x):
            return (x[:, 0] > np.log1p(4.5)).astype(float)

    monkeypatch.setattr(quality, "fit", lambda *a: Long())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(p, "table", lambda *a: labels)
    assert sorted(r["text"] for r in p.quality(spark, docs, "").collect()) == ["clean four", "clean one", "clean three", "clean two"]
    for ids in ((None, None, None, None), (7, 7, 7, 7), (None, 7, 7, 9)):
        group = [(i, t, "en", "a", len(t)) for i, t in zip(ids, near, strict=True)]
        docs = spark.createDataFrame([*group, group[0], *rows[:1]], schema)
        kept = p.near_dedup(spark, docs, "").collect()
        assert len(kept) == 2
        assert [r["doc_id"] for r in kept if r["text"] != "clean one"] == [min((i for i in ids if i is not None), default=None)]
