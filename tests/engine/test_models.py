"""Operators against plain Python models and hand-made rows."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import chunk, lexical
from lodestone.sources import embed, store, walk
from lodestone.streaming import limiter


def tokens(text):
    out = []
    for w in re.findall(r"[A-Za-z0-9_]+", text):
        out.append(w.lower())
        if "_" in w:
            out += [p for p in w.lower().split("_") if p]
        camel = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", w).split(" ")
        if len(camel) > 1:
            out += [p.lower() for p in camel]
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aBcD_9 é.", max_size=20), min_size=20, max_size=60))
def test_tokenizer(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    found = {r["i"]: r["ts"] for r in df.select("i", t.identifier_tokens(F.col("x")).alias("ts")).collect()}
    assert found == {i: tokens(x) for i, x in enumerate(texts)}


@pytest.mark.parametrize("n", [1, 49, 50, 51, 90, 91])
def test_windows_cover_every_line(spark, n):
    files = spark.createDataFrame([("f", "\n".join(f"x{i}" for i in range(n)))], "path string, content string")
    rows = sorted((r["start_line"], r["end_line"]) for r in chunk.sliding_windows(files).collect())
    assert {i for a, b in rows for i in range(a, b + 1)} == set(range(1, n + 1))
    assert all(b[0] - a[0] == 40 for a, b in zip(rows, rows[1:], strict=False))


def test_split_keeps_the_text(spark):
    content = "\n".join("y" * (i * 37 % 700) for i in range(60))
    rows = chunk.split_long(spark.createDataFrame([("f", 1, 60, content)], "path string, start_line int, end_line int, content string")).orderBy("piece").collect()
    assert len(rows) > 5
    assert "\n".join(r["content"] for r in rows) == content
    assert all(len(r["content"]) <= 2000 for r in rows)


def test_python_definitions():
    source = "import a\nimport b\n\n@d\ndef f():\n    pass\n\nclass C:\n    x = 1\n    def g(self):\n        return 1\n    y = 2\n\nclass Lone: pass\n"
    assert chunk.python_definitions(source, "a") == [
        (1, 3, "a", "module", None), (4, 6, "f", "function", None), (8, 9, "C", "class", None), (10, 11, "g", "method", "C"), (12, 12, "C", "class", None), (14, 14, "Lone", "class", None),
    ]
    assert chunk.python_definitions("def f(:") is None


@pytest.mark.parametrize("source", ["a" + ".b" * 20_000, "+".join("1" * 50_000), "-" * 100_000 + "1", "(" * 5000 + ")" * 5000, "x = 1\x00"])
def test_what_the_parser_cannot_read_goes_to_windows(source):
    assert chunk.python_definitions(source) is None


def test_script_definitions():
    source = """import a from 'a'; // { not counted
import b from "b";

export default async function load(x = { y: 1 }) {
  return `}${x}`;
}

export const add = (
  a: number,
  b: number,
): number => {
  return a + b;
};

const twice = x => x * 2
type Id = string | number;
export interface Shape { area(): number }
enum Kind { A, B }

@Injectable()
export class Store extends Base {
  private rows: string[] = [];

  constructor(private db: Db) {
    super();
  }
  save = async (row) => {
    if (row) { this.rows.push(row) }
  };
  last = 1;
}
"""
    assert chunk.script_definitions(source, "a") == [
        (1, 3, "a", "module", None), (4, 6, "load", "function", None), (8, 13, "add", "function", None), (15, 15, "twice", "function", None), (16, 16, "Id", "type", None),
        (17, 17, "Shape", "interface", None), (18, 18, "Kind", "enum", None), (20, 23, "Store", "class", None), (24, 26, "constructor", "method", "Store"), (27, 29, "save", "method", "Store"), (30, 31, "Store", "class", None),
    ]
    assert chunk.script_definitions("function f( {") == [(1, 1, "f", "function", None)]
    assert chunk.script_definitions("") == chunk.script_definitions("f)") == []


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ('const re = /[({]/;\nfunction a() {\n  return re.test("x") / 2 / 1;\n}\n', [(2, 4, "a", "function", None)]),
        ("function f() {\n  return `a ${b(`}`)} c`;\n}\nconst z = 1;\n", [(1, 3, "f", "function", None)]),
        ("module.exports = function run(a) {\n  return a;\n};\nexports.x = () => {\n  y();\n};\n", [(1, 3, "default", "function", None), (4, 6, "x", "function", None)]),
        ("const A = React.memo(function A(p) {\n  return <p>Don't {p.x} http://a.b</p>;\n});\nexport const s = create<T>()((set) => ({\n  n: 0,\n}));\n", [(1, 3, "A", "function", None), (4, 6, "s", "function", None)]),
        ("const x = require('x');\nconst y = f(1);\n", [(1, 3, "a", "module", None)]),
        ("namespace N {\n  export function f() {\n    return 1;\n  }\n  export class C {\n    @D()\n    m() {\n      return 2;\n    }\n  }\n}\n", [(2, 4, "f", "function", None), (5, 5, "C", "class", None), (6, 9, "m", "method", "C"), (10, 10, "C", "class", None)]),
        ("function broken() {\n  if (x) {\n    y(;\n\nfunction good() {\n  return 1;\n}\nexport class K {\n  a() { return 1; }\n}\n", [(1, 4, "broken", "function", None), (5, 7, "good", "function", None), (8, 8, "K", "class", None), (9, 9, "a", "method", "K"), (10, 10, "K", "class", None)]),
        ("f)\nfunction g() {\n  return 1\n}\n", [(2, 4, "g", "function", None)]),
        ("export default () => {\n  a();\n};\nFoo.prototype.bar = function () {\n  return 1;\n};\n", [(1, 3, "default", "function", None), (4, 6, "bar", "function", None)]),
        ("/* never closed {\nfunction f() {}", [(1, 2, "a", "module", None)]),
        ("const a = 'it\\'s {';\nconst b = \"{\";\nfunction f() {}\n", [(1, 2, "a", "module", None), (3, 3, "f", "function", None)]),
    ],
)
def test_script_shapes(source, found):
    assert chunk.script_definitions(source, "a") == found


def test_a_scanned_script_keeps_its_places():
    source = "a(`x${ {b: `${1}`} }y`, /[/{]/g, '}', \"{\"); // }\n/* { */ let r = a / b / c;"
    found = chunk.quiet(source)
    assert len(found) == len(source)
    assert [c for c in found if c in "(){}[]"] == list("({{{}}})")
    assert "a / b / c" in found


def test_bm25_of_a_common_term_is_still_positive(spark):
    docs = spark.createDataFrame([(i, "the cat" if i else "the dog dog") for i in range(5)], "doc_id long, text string")
    rows = lexical.bm25(docs, lexical.question_terms(spark.createDataFrame([("dog",)], "text string")), 3).collect()
    assert [r["doc_id"] for r in rows] == [0]


def test_an_index_is_built_once_for_the_same_files(spark, tmp_path):
    from lodestone.sources import shared

    at = f"{tmp_path}/docs"
    rows = lambda n: spark.createDataFrame([(i, f"word{i} common") for i in range(n)], "doc_id long, text string")
    rows(3).write.parquet(at)
    first = lexical.Index.of_table(spark.read.parquet(at))
    assert lexical.Index.of_table(spark.read.parquet(at)) is first
    rows(5).write.mode("overwrite").parquet(at)
    other = lexical.Index.of_table(spark.read.parquet(at))
    assert other.terms.where("term = 'common'").first()["df"] == 5
    shared.release(spark)  # the tables go, and the index is made again
    assert not shared.readable(other.postings)
    again = lexical.Index.of_table(spark.read.parquet(at))
    assert again is not other
    assert again.terms.count() == 6


def test_binary_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x\x00y")
    (tmp_path / "b.py").write_bytes(b"x = 1\r\n")
    f = walk.read_files(spark, str(tmp_path))
    rows = {r["name"]: r for r in f.select(F.substring_index("path", "/", -1).alias("name"), walk.skip_reason(F.substring_index("path", "/", -1), F.col("length"), F.col("content")).alias("reason"), walk.as_text(F.col("content")).alias("text")).collect()}
    assert rows["a.py"]["reason"] == "binary"
    assert rows["b.py"]["reason"] is None
    assert rows["b.py"]["text"] == "x = 1\n"


def test_store_versions(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    assert s.read() is None
    schema = "repo_id string, chunk_id string, file_path string, content string"
    s.upsert(spark.createDataFrame([("r", "1", "a", "x"), ("r", "2", "b", "y")], schema))
    before = s.read()
    s.upsert(spark.createDataFrame([("r", "2", "b", "z"), ("r", "3", "c", "w"), ("r", "3", "c", "w")], schema))
    assert {(r["chunk_id"], r["content"]) for r in s.read().collect()} == {("1", "x"), ("2", "z"), ("3", "w")}
    assert before.count() == 2
    s.delete_files(spark.createDataFrame([("a",)], "file_path string"))
    assert s.stats().first()["chunks"] == 2


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("one two",), ("one two",), ("three",)], "text string")
    none = spark.createDataFrame([], "hash string, model string, embedding array<float>")
    first = embed.embedded(texts, none)
    assert first.count() == 2
    assert embed.cache_misses(texts, first, "hash64").count() == 0
    assert embed.cache_misses(texts, first, "other").count() == 2


def test_limiter_stream_equals_batch(spark, tmp_path):
    """Requests that arrive late, within the delay, in several micro-batches; then time goes on and no state is left."""
    r = random.Random(4)
    rows = [(c, i, float(i * 3 + r.randint(0, 40))) for i, c in enumerate(r.choice([1, 1, 1, 2, 3]) for _ in range(120))]
    schema = "client long, event_id long, at double"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    later = [[(9, 1000 + i, t)] for i, t in enumerate((2000.0, 4000.0))]
    for n, part in enumerate([rows[i : i + 30] for i in range(0, 120, 30)] + later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05 * (n >= 0))  # files are read in the order of their times
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = limiter.limited_stream(source, 3, 60, "100 seconds").writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    found = {tuple(x) for x in spark.table("limited").where("client < 9").collect()}
    assert found == {tuple(x) for x in limiter.limited(spark.createDataFrame(rows, schema), 3, 60).collect()}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # of client 9 alone


def test_limiter_edge():
    assert limiter.decided([(0, 0.0), (1, 1.0), (2, 2.0), (3, 60.0), (4, 60.5)], [], 3, 60) == [True, True, True, False, True]


def neighbours(df):
    return {(r["query_id"], r["vec_id"]) for r in df.select("query_id", "vec_id").collect()}


def test_recall_of_the_cell_index(spark):
    from lodestone.catalog import QUERIES

    exact, found = (neighbours(QUERIES[q](spark, "/root/testdata/sf0.1")) for q in ("knn_exact", "knn_cells"))
    assert len(exact & found) / len(exact) >= 0.9


def test_cells_of_vectors_that_lie_in_groups(spark):
    """Forty groups around given vectors: few cells are looked into, and the scan asks for their folders."""
    from lodestone.operators import ivf
    from lodestone.plans.queries import search_set, table

    sf = "/root/testdata/sf0.1"
    v = table(spark, sf, "embeddings")
    middle = v.where("vec_id < 40").select(F.col("vec_id").alias("g"), F.col("embedding").alias("m"))
    v = v.withColumn("g", F.col("vec_id") % 40).join(middle, "g").select("vec_id", F.zip_with("embedding", "m", lambda a, b: 0.3 * a + b).alias("embedding"))
    index = ivf.Index(v)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact, found = neighbours(ivf.exact(v, asked, 10)), neighbours(index.search(asked, 10))
    assert len(exact & found) / len(exact) >= 0.95
    assert index.candidates(asked).count() < 0.1 * asked.count() * v.count()
    plan = index.candidates(asked.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (=|IN)", plan)
    assert neighbours(index.search(asked, 10, probes=1000)) == exact  # all cells
    assert index.search(search_set(spark, sf).withColumn("query_vector", F.lit(None).cast("array<double>")), 3).count() == 0


def test_cells_of_few_vectors(spark):
    from lodestone.operators import ivf

    two = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None)], "query_id string, query_vector array<double>")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])]
    made = lambda rows: spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in ivf.Index(made(rows)).search(two, 3, probes=9).orderBy("rank").collect()] == [1, 4, 2]
    assert [r["vec_id"] for r in ivf.Index(made(rows[:1])).search(two, 3).collect()] == [1]
    assert ivf.Index(made([])).search(two.limit(0), 3).count() == 0
    assert ivf.Index(made([])).search(two, 3).count() == 0


def test_codes_rule_out_most_vectors_and_lose_none(spark, tmp_path):
    from lodestone.catalog import QUERIES
    from lodestone.operators import codes, ivf
    from lodestone.plans.queries import search_set, table

    sf = "/root/testdata/sf0.1"
    exact, found = ({tuple(r) for r in QUERIES[q](spark, sf).select("query_id", "vec_id", "rank", "similarity").collect()} for q in ("knn_exact", "knn_codes"))
    assert found == exact
    index = codes.CodeIndex(table(spark, sf, "embeddings"))
    asked = search_set(spark, sf)
    left = index.candidates(asked.select("query_id", ivf.unit(F.col("query_vector")).alias("q")), 10).count()
    assert left < 0.05 * asked.count() * index.rows.count()
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8]), (4, [1.0]), (5, [1.0, 0.0])], "vec_id int, embedding array<double>")
    two = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [3.0])], "query_id string, query_vector array<double>")
    assert [(r["query_id"], r["vec_id"], r["similarity"]) for r in codes.CodeIndex(odd).search(two, 3).orderBy("query_id", "rank").collect()] == [("a", 1, 1.0), ("a", 5, 1.0), ("a", 3, 0.6), ("b", 4, 1.0)]
    assert codes.CodeIndex(odd.limit(0)).search(two, 3).count() == 0


def test_engine_from_files_to_answers(spark, tmp_path):
    from lodestone.api import Engine

    code = "import os\nimport sys\n\ndef parseConfig(path):\n    return open(path).read()\n\nclass Store:\n    def save(self, row):\n        return row\n"
    rows = [("src/config.py", code), ("docs/guide.md", "\n".join(f"line {i} about storage" for i in range(120))), ("node_modules/x.js", "let a"), ("a.png", "x")]
    source = spark.createDataFrame([(p, len(c), bytearray(c.encode())) for p, c in rows], "path string, length long, content binary")
    e = Engine(spark, f"file://{tmp_path}/engine")
    events = list(e.index("r", source))
    assert [x["stage"] for x in events] == ["walking", "parsing", "embedding", "storing", "complete"]
    assert events[1]["files"] == 2
    hits = e.search("r", "how does parseConfig work").orderBy("position").collect()
    assert hits[0]["name"] == "parseConfig"
    assert hits[0]["header"] == "[1] parseConfig() (src/config.py:4-5)"
    assert "import sys" in hits[0]["enriched"]
    assert e.file("r", "docs/guide.md", 2, 3).first()["content"] == "line 1 about storage\nline 2 about storage"
    assert e.summary("r").count() == 2
    assert e.tree("r").where("parent = ''").count() == 2
    assert e.unmatched("r", "what do guide.md and lost.py say").first()["name"] == "lost.py"
    named = e.search("r", "parseConfig as told in guide.md").orderBy("position").collect()
    assert {r["file_path"] for r in named} >= {"docs/guide.md"}
    assert all(r["score"] >= 0.25 for r in e.search("r", "how does parseConfig work", hybrid=False).collect())
    longest = e.search("r", "how does parseConfig work", scorer=lambda qs, ts: [len(x) for x in ts]).where("position = 1").first()
    assert longest["file_path"] == "docs/guide.md"
    again = list(e.index("r", source, commit="c1"))
    assert again[1]["changed"] == 0
    assert again[-1]["chunks"] == events[-1]["chunks"]
    assert e.is_current("r", "c1")
    assert not e.is_current("r", "c2")
    was = {r["chunk_id"]: r["content"] for r in e.peek("r", 100).collect()}
    rows[0] = (rows[0][0], code.replace("return row", "return [row]"))
    rows[1] = ("docs/other.md", "an other file")
    source = spark.createDataFrame([(p, len(c), bytearray(c.encode())) for p, c in rows], "path string, length long, content binary")
    part = list(e.index("r", source))
    assert part[1]["changed"] == 3
    now = {r["chunk_id"]: r["content"] for r in e.peek("r", 100).collect()}
    list(e.index("r", source, incremental=False))
    assert now == {r["chunk_id"]: r["content"] for r in e.peek("r", 100).collect()} != was
    assert e.status().first()["functions"] == 2
    for question in ("ab", "x" * 2001):
        with pytest.raises(ValueError, match="characters"):
            e.search("r", question)
    for path in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError, match="path"):
            e.file("r", path)
    assert e.exists("r")
    e.delete("r")
    assert not e.exists("r")
    assert e.status().count() == 0


def test_rerank(spark):
    from lodestone.operators.rerank import reranked

    rows = [("q", i, "x" * i, i + 1) for i in range(4)]
    df = spark.createDataFrame(rows, "question string, id int, text string, rank int")
    assert {(r["id"], r["rank"], r["score"]) for r in reranked(df).collect()} == {(i, i + 1, 0.5) for i in range(4)}
    longest = reranked(df, lambda qs, ts: [len(x) for x in ts]).where("rank = 1").first()
    assert longest["id"] == 3
