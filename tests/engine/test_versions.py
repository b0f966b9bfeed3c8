"""Versions of a repository: interrupted and repeated runs, racing writers, incremental against full, disk."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone.api import Engine
from lodestone.sources import embed
from lodestone.sources.cache import SearchCache
from lodestone.sources.manifest import Conflict, Versions
from lodestone.sources.store import ChunkStore


def source(spark, files):
    rows = [(p, len(c), bytearray(c.encode())) for p, c in files.items()]
    return spark.createDataFrame(rows, "path string, length long, content binary")


def program(i, body="return 1"):
    return f"import os\nimport sys\n\ndef parse_{i}(path):\n    {body}\n\nclass Store{i}:\n    def save(self, row):\n        return row\n"


def parquet_files(folder):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(folder) for f in names)


def contents(engine, repo):
    """All that a version holds, without what differs between runs of the same work."""
    v, last = engine._current(repo)
    rows = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()), key=str)
    return {
        "files": rows(engine._live(v, last, "files"), "file_path", "content", "language", "total_lines"),
        "chunks": rows(engine._live(v, last, "chunks"), "chunk_id", "file_path", "start_line", "end_line", "name", "chunk_type", "content", "embedding"),
        "postings": rows(engine._live(v, last, "postings"), "doc_id", "term", "tf", "doc_len"),
        "terms": rows(engine._terms(v, last), "term", "df"),
        "tree": rows(engine.tree(repo), "parent", "name", "kind", "ordinal"),
        "languages": rows(engine.summary(repo), "language", "files", "pct"),
        "sums": {k: round(last[k], 9) for k in ("files", "chunks", "functions", "tokens", "mean_idf")},
    }


@pytest.mark.parametrize("stage", ["walking", "parsing", "embedding", "storing"])
def test_a_run_that_stops_is_made_good_by_the_next(spark, tmp_path, stage):
    e = Engine(spark, f"file://{tmp_path}/e")
    files = {"a.py": program(1), "b.md": "# about\nwords of b\nmore words"}
    list(e.index("r", source(spark, files)))
    before = contents(e, "r")
    files["a.py"] = program(1, "return open(path)")
    for event in e.index("r", source(spark, files)):
        if event["stage"] == stage:
            break
    assert contents(e, "r") == before
    assert list(e.index("r", source(spark, files)))[-1]["stage"] == "complete"
    clean = Engine(spark, f"file://{tmp_path}/clean")
    list(clean.index("r", source(spark, files)))
    assert contents(e, "r") == contents(clean, "r")
    data = f"{tmp_path}/e/repositories"
    was = parquet_files(data)
    e.vacuum("r", older_than=0)
    assert parquet_files(data) < was or stage == "walking"  # which has written nothing yet
    assert contents(e, "r") == contents(clean, "r")


def test_incremental_equals_full_after_many_edits(spark, tmp_path, monkeypatch):
    """Edits, additions and deletions in turn; segments are merged on the way."""
    monkeypatch.setattr(api, "SEGMENTS", 3)
    r = random.Random(3)
    e = Engine(spark, f"file://{tmp_path}/e")
    files = {f"src/f{i}.py": program(i) for i in range(6)}
    list(e.index("r", source(spark, files)))
    for step in range(5):
        for _ in range(4):
            kind, name = r.random(), f"src/f{r.randint(0, 9)}.py"
            if kind < 0.3 and len(files) > 3:
                files.pop(name, None)
            else:
                files[name] = program(r.randint(0, 3), f"return {r.randint(0, 99)} + camelCase{r.randint(0, 3)}")
        list(e.index("r", source(spark, files), commit=f"c{step}"))
    full = Engine(spark, f"file://{tmp_path}/full")
    list(full.index("r", source(spark, files)))
    assert contents(e, "r") == contents(full, "r")
    assert len(e._current("r")[1]["segments"]) <= 3
    hits = lambda x: [tuple(h) for h in x.search("r", "camelCase1 parse").select("position", "chunk_id", "score").orderBy("position").collect()]
    assert hits(e) == hits(full)


def test_an_incremental_run_writes_what_changed(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    files = {f"f{i}.py": program(i) for i in range(20)}
    list(e.index("r", source(spark, files)))
    files["f3.py"] = program(3, "return 2")
    del files["f4.py"]
    assert list(e.index("r", source(spark, files), commit="c"))[1] == {"stage": "parsing", "files": 19, "changed": 2}
    v, last = e._current("r")
    one = last["segments"][1]["tables"]
    assert v.table(one["files"]).count() == 1
    assert v.table(one["gone_files"]).count() == 2
    assert v.table(one["postings"]).count() < v.table(last["segments"][0]["tables"]["postings"]).count() / 10
    again = list(e.index("r", source(spark, {}), commit="c"))
    assert again == [{"stage": "complete", "chunks": last["chunks"], "changed": 0, "current": True}]
    assert e.status().first()["files"] == 19


def test_of_two_writers_one_succeeds(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    one, other = e.index("r", source(spark, {"a.py": program(1)})), e.index("r", source(spark, {"b.py": program(2)}))
    for run in (one, other):
        while next(run)["stage"] != "storing":
            pass
    list(one)
    with pytest.raises(Conflict):
        list(other)
    assert [f[0] for f in contents(e, "r")["files"]] == ["a.py"]
    v = Versions(spark, f"file://{tmp_path}/v")
    v.commit({"x": 1}, 0)
    with pytest.raises(Conflict):
        v.commit({"x": 2}, 0)
    assert v.read() == {"x": 1, "version": 1}


def test_no_change_of_a_chunk_table_is_lost(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}/s")
    schema = "repo_id string, chunk_id string, file_path string, content string"
    s.upsert(spark.createDataFrame([("r", "1", "a", "x")], schema))
    raced = []

    def change(old):
        if not raced:  # another writer comes in between
            raced.append(1)
            s.upsert(spark.createDataFrame([("r", "2", "b", "y")], schema))
        return old.unionByName(spark.createDataFrame([("r", "3", "c", "z")], schema))

    s.change(change)
    assert sorted(r["chunk_id"] for r in s.read().collect()) == ["1", "2", "3"]


def test_delete_frees_the_disk(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    list(e.index("r", source(spark, {"a.py": program(1)})))
    list(e.index("other", source(spark, {"b.py": program(2)})))
    assert e.status().count() == 2
    before = parquet_files(tmp_path)
    e.delete("r")
    e.delete("r")
    assert parquet_files(tmp_path) <= before / 2
    assert [r["repo_id"] for r in e.status().collect()] == ["other"]
    with pytest.raises(KeyError):
        e.peek("r")
    list(e.index("r", source(spark, {"a.py": program(3)})))
    assert e.status().count() == 2


def test_answers_are_kept_by_version(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    list(e.index("r", source(spark, {"a.py": program(1)})))
    first = [tuple(x) for x in e.search("r", "parse_1 path").collect()]
    assert [tuple(x) for x in e.search("r", "parse_1 path").collect()] == first
    assert len(e.answers.kept) == 1
    list(e.index("r", source(spark, {"a.py": program(1, "return path + path")})))
    assert "return path + path" in e.search("r", "parse_1 path").orderBy("position").first()["content"]
    debug = e.debug_search("r", "parse_1 path").orderBy("position").first()
    assert debug["name"] == "parse_1"
    assert debug["above_threshold"] == (debug["score"] >= 0.25)
    e.delete("r")
    with pytest.raises(KeyError):
        e.search("r", "parse_1 path")


def test_the_oldest_half_of_the_answers_goes():
    c = SearchCache()
    for i in range(101):
        c.put(i, ([], None))
    assert list(c.kept) == list(range(50, 101))
    assert c.get(3) is None
    assert c.get(60) is not None


class Picky:
    """Vectors of two numbers, but not for texts with a forbidden word."""

    def __init__(self, word):
        self.word = word

    def __call__(self, texts):
        if any(self.word in t for t in texts):
            raise ValueError("cannot")
        return [[float(len(t)), 1.0] for t in texts]


def test_a_bad_text_spoils_only_itself(spark, tmp_path):
    picky = embed.Embedder("picky", Picky("save"), batch=8)
    done = embed.bisected(picky, [f"text {i}" + " save" * (i in (3, 11)) for i in range(16)])
    assert [i for i, (v, e) in enumerate(done) if v is None and e] == [3, 11]
    e = Engine(spark, f"file://{tmp_path}/e", embedder=picky)
    files = {f"f{i}.py": program(i) for i in range(4)}
    events = list(e.index("r", source(spark, files)))
    assert events[-2] == {"stage": "storing", "failed": 4}
    assert {r["error"] for r in e.failures("r").collect()} == {"ValueError: cannot"}
    v, last = e._current("r")
    assert {r["name"] for r in e._live(v, last, "chunks").where("embedding is null").collect()} == {"save"}
    e.embedder = embed.Embedder("picky", Picky("nothing"))
    assert list(e.index("r", source(spark, files)))[-2] == {"stage": "storing", "failed": 0}  # tried again, though no file changed
    v, last = e._current("r")
    assert e._live(v, last, "chunks").where("embedding is null").count() == 0


class Wide(Picky):
    def __call__(self, texts):
        return [[1.0, 2.0, 3.0] for _ in texts]


def test_vectors_of_another_length_are_refused(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", embedder=embed.Embedder("m", Picky("-")))
    list(e.index("r", source(spark, {"a.py": program(1)})))
    e.embedder = embed.Embedder("m", Wide("-"))
    with pytest.raises(ValueError, match="lengths"):
        list(e.index("r", source(spark, {"a.py": program(2)})))
    list(e.index("r", source(spark, {"a.py": program(2)}), incremental=False))
    assert e._current("r")[1]["dimensions"] == 3


def test_a_stream_of_files_equals_one_index(spark, tmp_path):
    from lodestone.streaming.ingest import files_stream, index_stream

    files = {f"src/f{i}.py": program(i) for i in range(5)}
    for p, c in files.items():
        (tmp_path / "in" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / p).write_text(c)
    e, events = Engine(spark, f"file://{tmp_path}/e"), []
    q = index_stream(e, "r", files_stream(e, f"file://{tmp_path}/in", 2), f"{tmp_path}/c", events.append)
    assert q.awaitTermination(300)
    assert {x["batch"] for x in events} == {0, 1, 2}
    once = Engine(spark, f"file://{tmp_path}/once")
    list(once.index("r", source(spark, files)))
    assert contents(e, "r") == contents(once, "r")
    again = list(e.index("r", source(spark, {"x.py": program(9)}), whole=False, batch=2))
    assert again[0]["current"]


def test_the_scorer_sees_twice_as_many_and_named_files_first(spark, tmp_path):
    from lodestone.params import Params

    seen = f"{tmp_path}/seen"

    def scorer(questions, texts):
        with open(seen, "a") as f:
            f.write(f"{len(texts)}\n")
        return [float("z = 1" in x) for x in texts]

    e = Engine(spark, f"file://{tmp_path}/e", Params(top_k=2, candidates=4))
    files = {f"f{i}.py": program(i) for i in range(9)} | {"named.py": "z = 1\ny = 2\n"}
    list(e.index("r", source(spark, files)))
    hits = e.search("r", "parse in named.py", scorer=scorer).orderBy("position").collect()
    assert hits[0]["file_path"] == "named.py"
    assert len(hits) == 2
    assert sum(map(int, open(seen).read().split())) >= 5


def test_the_walk_is_reported(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    files = {"a.py": program(1), "b.py": program(2), "c.png": "x", "Makefile": "x", "node_modules/d.js": "x", "e.py": "", "f.md": "text\0"}
    list(e.index("r", source(spark, files)))
    report = lambda: ({tuple(r) for r in e.walk_report("r").collect()}, [tuple(r) for r in e.extensions("r").orderBy(F.desc("files"), "extension").collect()])
    assert report() == ({("kept", 2), ("extension", 1), ("no_ext", 1), ("folder", 1), ("size", 1), ("binary", 1)}, [(".py", 3), (".js", 1), (".md", 1), (".png", 1)])
    files = {"a.py": program(1), "b.py": "x" * 500_001, "c.py": program(3)}  # b.py has grown too long
    assert list(e.index("r", source(spark, files)))[1] == {"stage": "parsing", "files": 2, "changed": 2}
    assert report() == ({("kept", 2), ("size", 1)}, [(".py", 3)])
    assert {r["file_path"] for r in e.peek("r", 99).collect()} == {"a.py", "c.py"}


def test_prompts_and_answers(spark, tmp_path):
    """A follow-up is searched with the question before it; the model sees the question, the history and what is missing."""
    from lodestone.params import Params

    e = Engine(spark, f"file://{tmp_path}/e", Params(top_k=2, candidates=4, history_answer_chars=5))
    files = {f"f{i}.py": program(i) for i in range(6)} | {"named.py": "z = 1\ny = 2\n"}
    list(e.index("r", source(spark, files)))
    history = [("left out", "by now")] * 3 + [("no answer", None), ("x", "y"), ("what is in named.py", "long answer")]
    found = e.prompt("r", "and in other.py?", history).collect()
    assert len(found) == 1
    text = found[0]["prompt"]
    assert found[0]["n_hits"] == 2
    assert "] module-level code (named.py:1-" in text
    assert text.index("FILES IN RETRIEVED CHUNKS:\n\n  ") < text.index("[1] ") < text.index("```python\n") < text.index("Previous Q: left out") < text.index("Question: and in other.py?")
    assert "Previous Q: x\nPrevious A: y\nPrevious Q: what is in named.py\nPrevious A: long ...\n\nQuestion: " in text
    assert "no answer" not in text
    assert text.endswith("The repository has no file named other.py. Say that it was not found and do not guess what it holds.")

    def model(prompts):
        return [f"**named.py:1** of {len(p)}\n```python\nz = 1\n```" for p in prompts]

    row = e.ask("r", "and in other.py?", model, history).first()
    assert row["answer"].startswith(f"**named.py:1** of {len(text)}")
    assert row["citations"] == ["named.py:1"]
    assert [p["kind"] for p in row["parts"]] == ["text", "code"]

    def broken(prompts):
        raise OSError("no model")

    assert e.ask("r", "what is in named.py", broken).select("answer", "error").first() == (None, "OSError: no model")
    list(e.index("r", source(spark, {})))
    assert e.prompt("r", "what is in named.py").count() == 0
    assert e.ask("r", "what is in named.py", broken).first()["answer"] == "No file of the repository is named named.py; it may lie elsewhere or have been left out of the index."


def test_one_bad_prompt_spoils_no_other(spark):
    from lodestone.operators.generate import generated

    def model(prompts):
        if "bad" in prompts:
            raise ValueError("bad")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "query_id int, prompt string")
    assert {tuple(r) for r in generated(rows, model).collect()} == {(1, "A", None), (2, None, "ValueError: bad"), (3, "C", None)}
