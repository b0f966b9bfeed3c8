"""The other operators: against brute force, SQL or a round trip, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format, decontaminate, mixing, piecewise_hash, quality, secret_scan, sharding, token_shards, toxicity
from lodestone.llm.common import shared_dir, table
from lodestone.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, shard int"
ODD = [
    (1, None, None, None, None, 1, "x", 2),
    (2, "", "en", "a", 0, 1, "x", 2),
    (3, " \n\t ", "en", "a", 3, 1, "x", 2),
    (4, "word", "en", None, 4, 1, "x", 2),
    (4, "word", "en", None, 4, 1, "x", 2),
    (4, "other word", "en", "b", 4, 1, "x", 2),
    (None, "no id password = abcdef1", "en", "b", 5, 1, "x", 2),
    (-7, "é" * 50 + " AKIA" + "A1" * 10 + " x", "fr", "c", 80, 1, "x", 2),
    (9, "long text. " * 20000, "en", "c", 220000, 1, "x", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    r = con.execute(ORACLES[name])
    at = [[c[0] for c in r.description].index(c) for c in columns]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert Counter(tuple(show(x[c]) for c in columns) for x in df.collect()) == Counter(tuple(show(x[i]) for i in at) for x in r.fetchall())


# ---- 1 and 8


@pytest.mark.parametrize("name", ["op1_toxicity", "op8_quality"])
def test_scores_are_of_every_document(spark, sf_dir, docs, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy(spark):
    """At a hundred times the smallest tables, where there is enough to learn from."""
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in table(spark, d, "labels").collect()}
    rows = [(labels[r["doc_id"]]["quality"], r["predicted"]) for r in QUERIES["op8_quality"](spark, d).where("held_out").collect() if r["doc_id"] in labels]
    assert np.mean([a == b for a, b in rows]) > 0.98
    rows = [(labels[r["doc_id"]]["toxic"], r["predicted"]) for r in QUERIES["op1_toxicity"](spark, d).where("held_out").collect() if r["doc_id"] in labels]
    assert np.mean([b for a, b in rows if a == 1]) > 0.9
    assert np.mean([a for a, b in rows if b == 1]) > 0.9


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (4, 1, 1), (9, 0, 0), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        out = score(odd, labels)
        assert out.count() == len(ODD)
        assert out.where("score is null or not score between 0 and 1").count() == 0
        assert {r["score"] for r in score(odd, labels.limit(0)).collect()} == {0.5}
        assert score(odd.limit(0), labels).count() == 0


def test_quality_against_one_pass_in_memory(spark, sf_dir):
    """The scores of ridge and calibration over all rows in one array, by least squares and pairwise pooling."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["quality"] is not None}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    folds = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in rows])
    x = np.array([quality.statistics(t) for _, t in rows], float)
    y = np.array([marks.get(i, np.nan) for i, _ in rows])
    seen = (folds != 0) & ~np.isnan(y)
    mean, sd = x[seen].mean(0), x[seen].std(0)
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0, 1 / quality.BANDWIDTH, (x.shape[1], quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.clip((x - mean) / np.where(sd > 1e-9, sd, 1.0), -8, 8) @ w + b
    z = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(z), np.ones((len(z), 1))])
    own, held = seen & (folds != 1), seen & (folds == 1)
    # ridge as least squares over rows added for the penalty
    weight = np.sqrt(quality.RIDGE * seen.sum() / quality.FEATURES)
    beta = np.linalg.lstsq(np.vstack([z[own], weight * np.eye(z.shape[1])]), np.concatenate([y[own], np.zeros(z.shape[1])]), rcond=None)[0]
    raw = z @ beta
    bins = np.clip(np.floor((raw[held] + 1) / 3 * quality.CALIBRATION_BINS), 0, quality.CALIBRATION_BINS - 1)
    at = np.unique(bins)
    n = np.array([(bins == k).sum() for k in at], float)
    centre, height = (np.array([v[held][bins == k].mean() for k in at]) for v in (raw, y))
    # isotonic values by the min-max formula
    part = lambda i, j: (n[i : j + 1] * height[i : j + 1]).sum() / n[i : j + 1].sum()
    level = [max(min(part(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    expected = dict(zip([i for i, _ in rows], np.interp(raw, centre, level), strict=True))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    assert got.keys() == expected.keys()
    assert max(abs(got[i] - expected[i]) for i in got) < 1e-6


def test_isotonic_fit_is_monotone():
    knots, values = quality.pooled([(0.1, 1, 0.2), (0.2, 3, 0.1), (0.3, 1, 0.5), (0.4, 1, 0.4), (0.5, 2, 0.9)])
    assert values == sorted(values)
    assert knots == [0.1, 0.2, 0.3, 0.4, 0.5, 0.5]
    assert values[0] == pytest.approx(0.125)


def kneser_ney(rows):
    """The two models of (text, y) written out: p(c, w, v) for class c, word w and the word v before it or None."""
    cut = toxicity.STEM
    held = {k: {0: Counter(), 1: Counter()} for k in ("stem", "word", "pair")}
    for text, y in rows:
        ws = re.findall(r"[a-z0-9]+", text.lower())
        held["stem"][y].update({w[:cut] for w in ws})
        held["word"][y].update(set(ws))
        held["pair"][y].update(set(zip(ws, ws[1:], strict=False)))

    def keeps(kind, c, x):
        size = {k: sum(held[kind][k].values()) for k in (0, 1)}
        expected = (held[kind][0][x] + held[kind][1][x]) * size[c] / sum(size.values())
        return max(held[kind][c][x] - expected - toxicity.Z[kind] * (expected + 1) ** 0.5, 0.0)

    words = {*held["word"][0], *held["word"][1]}
    joint = {w: held["word"][0][w] + held["word"][1][w] + toxicity.SHARED_PRIOR for w in words}
    shared = {w: n / sum(joint.values()) for w, n in joint.items()}
    of_stem = Counter()
    for w in words:
        of_stem[w[:cut]] += shared[w]
    total = {k: {c: sum(held[k][c].values()) for c in (0, 1)} for k in held}
    rest = {k: {c: 1 - sum(keeps(k, c, x) for x in held[k][c]) / total[k][c] for c in (0, 1)} for k in ("stem", "word")}

    def stem(c, s):
        return keeps("stem", c, s) / total["stem"][c] + rest["stem"][c] * of_stem[s]

    def word(c, w):
        return keeps("word", c, w) / total["word"][c] + rest["word"][c] * stem(c, w[:cut]) * shared[w] / of_stem[w[:cut]]

    def pair(c, w, v):
        if v is None:
            return word(c, w)
        after = [x for x in held["pair"][c] if x[0] == v]
        n = sum(held["pair"][c][x] for x in after)
        left = 1 - sum(keeps("pair", c, x) for x in after) / n if n else 1.0
        return (keeps("pair", c, (v, w)) / n if n else 0.0) + left * word(c, w)

    plain = np.log(rest["stem"][1] / rest["stem"][0]) + np.log(rest["word"][1] / rest["word"][0])
    return pair, words, plain


def test_toxicity_models_written_out(spark, monkeypatch):
    """Differences equal those of the models written out, whose probabilities sum to 1; also with most values joined."""
    monkeypatch.setattr(toxicity, "Z", {"stem": 1.0, "word": 0.5, "pair": 0.2})
    rng = random.Random(4)
    usual = [f"{a}{b}" for a in ("alpha", "bravo", "gamma", "delta") for b in range(12)]
    rows = []
    for i in range(120):
        y = int(i % 4 == 0)
        ws = [rng.choice(usual) for _ in range(rng.randrange(2, 30))]
        for _ in range(3 * y):
            ws[rng.randrange(len(ws))] = rng.choice(["slur", "insult1", "insult2", "insult3"])
        rows.append((" ".join(ws), y))
    p, words, plain = kneser_ney(rows)
    for c in (0, 1):
        for v in (None, "slur", "alpha1", "gamma7"):
            assert sum(p(c, w, v) for w in words) == pytest.approx(1, abs=1e-9)
    values = toxicity.fit(spark.createDataFrame([(t, float(y)) for t, y in rows], "text string, y double"))
    texts = [(i, t) for i, (t, _) in enumerate(rows)] + [(-1, None), (-2, ""), (-3, rows[0][0]), (-3, rows[0][0])]
    expected = {}
    for i, t in texts:
        ws = (t or "").split()
        parts = [np.log(p(1, w, v) / p(0, w, v)) - plain for v, w in zip([None, *ws], ws, strict=False)]
        expected[i] = sum(parts) / max(len(parts), 1)
    assert max(expected.values()) > 0.05
    for hot in (200_000, 5):
        monkeypatch.setattr(toxicity, "HOT_KEYS", hot)
        found = toxicity.differences(spark.createDataFrame(texts, "i long, text string"), toxicity.Model(values), "i").collect()
        assert len(found) == len(texts)
        for r in found:
            assert r["difference"] == pytest.approx(expected[r["i"]], abs=1e-9)


# ---- 3


def test_token_shards_against_the_tokenizer(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer, start, expected = Tokenizer.from_file(token_shards.default_tokenizer()), 0, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expected[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op3_token_shards"](spark, sf_dir).collect()}
    assert found == expected


def test_pieces_encode_like_whole_texts():
    e = token_shards.Encoder(token_shards.default_tokenizer())
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "Bc", " ", " ", "\n", ".", ",", "é", "1", "'s", "\t", "\x1c", "<|endoftext|>", "日", "!?"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_are_looked_up_once_a_call():
    """Not at each place where they stand, and single words go to the tokenizer together."""

    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

        def __getitem__(self, k):
            Counted.n += 1
            return super().__getitem__(k)

    e = token_shards.Encoder(token_shards.default_tokenizer())
    e.ids = Counted()
    texts = ["The cat sat on a mat. " * 300 + "x" * i for i in range(20)]
    assert [len(ids) for ids in e.encode(texts)] == [4 * len(x.ids) for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert Counted.n < 200


def test_odd_texts_encode_like_whole_texts():
    e = token_shards.Encoder(token_shards.default_tokenizer())
    odd = ["", " ", "  a", "a ", "a  b", "a \n b", "\x85 a", "a\u3000 b", "a\u180e b", "é" * 60 + " b", "<|endoftext|> a", "a\nb c", "x\r\n y", "\n", " .", "a.\n\nb!", "\u200b c"]
    for texts in (odd, [""], ["", ""], [" ", " "], [], ["a b"], odd[::-1] * 3):
        found = [np.frombuffer(ids, "<u4").tolist() if ids else [] for ids in e.encode(texts)]
        assert found == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_calls_keep_rows_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_shards, "ROWS", 2)
    monkeypatch.setattr(token_shards, "CALL_CHARS", 6)
    texts = ["abc", None, "de", "", "f" * 9, "gh", "ijkl", "m"]
    batches = [pa.RecordBatch.from_pydict({"k": range(a, b), "t": pa.array(texts[a:b], pa.string())}) for a, b in ((0, 3), (3, 3), (3, 8))]
    found = list(token_shards.calls(iter(batches)))
    assert [(k, t) for ks, ts in found for k, t in zip(ks, ts, strict=True)] == [(i, t or "") for i, t in enumerate(texts)]
    assert [sum(map(len, ts)) for _, ts in found] == [5, 9, 6, 1]
    assert list(token_shards.calls(iter([]))) == []


def test_shard_file_lookup(tmp_path):
    w = token_shards.Writer(f"file://{tmp_path}/x.sst")
    rng, rows = random.Random(1), []
    for i in [None, -(2**63), -5, 0, 0, *range(10, 9000, 7), 2**63 - 1]:
        rows.append((i, [rng.randrange(70000 if i == 10 else 50000) for _ in range(rng.randrange(1, 400))]))
        w.add(token_shards.key_of(i), np.array(rows[-1][1], "<u4").tobytes())
    w.close()
    r = token_shards.Reader(f"file://{tmp_path}/x.sst")
    assert len(r.index) > 3
    assert [(i, ids.tolist()) for i, _, ids in r.scan()] == rows
    for i in (None, -(2**63), 0, 10, 17, 4000, 8998, 2**63 - 1, 11, 5):
        assert [x.tolist() for x in r.lookup(i)] == [ids for k, ids in rows if k == i]
    assert sum(r.may_hold(i) for i in range(20000, 30000)) < 300


def test_token_shards_on_odd_rows(spark, odd):
    m = token_shards.write_shards(odd, f"{shared_dir(spark)}/odd", token_shards.default_tokenizer())
    rows = token_shards.read_shards(m).orderBy("start").collect()
    assert len(rows) == len(ODD)
    assert [r["doc_id"] for r in rows] == [None, -7, 1, 2, 3, 4, 4, 4, 9]
    assert next(r for r in rows if r["doc_id"] == 1)["n_tokens"] == 1
    none = token_shards.write_shards(odd.limit(0), f"{shared_dir(spark)}/none", token_shards.default_tokenizer())
    assert token_shards.read_shards(none).count() == 0


# ---- 4


def test_secrets_against_the_patterns(spark, sf_dir, docs):
    patterns = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    for r in QUERIES["op4_secrets"](spark, sf_dir).join(docs.select("doc_id", "text"), "doc_id").collect():
        spans = []
        for k, (kind, p) in enumerate(patterns):
            for m in re.finditer(p, r["text"] or "", re.A):
                if (len(m[2]) >= 6) if k == 0 else len(m[0]) >= (20, 24)[k - 1]:
                    spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        base = [s for *_, s in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert Counter(s.split(":")[0] for s in base) == Counter({"assign": r["n_assign"], "access": r["n_access"], "hex": r["n_hex"]})
        assert set(base) <= set(r["spans"].split(",")) or not base


def test_owned_and_copied_values(spark, odd):
    live, copied = "Zk3pQ9vT7mX2bN5wR8yL", "Ab1Cd2Ef3Gh4Ij5Kl6Mn"
    rows = [(i, f"see {copied} here", f"o{i}") for i in range(5)] + [(7, f"key {live}\npassword: short", "o1"), (8, f"again {live}", "o1")]
    out = {r["doc_id"]: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), F.col("source")).collect()}
    assert all(out[i]["n_shared"] == 1 and not out[i]["spans"] for i in range(5))
    assert [(s["start"], s["kind"], s["end"]) for s in out[8]["spans"]] == [(6, 3, 26)]
    assert out[7]["n_live"] == 1
    assert [s["kind"] for s in out[7]["spans"]] == [3]  # the password's value is too short
    assert secret_scan.secrets(odd, F.col("source"), F.col("source")).count() == len(ODD)
    assert secret_scan.secrets(odd.limit(0), F.col("source"), F.col("source")).count() == 0


def test_ownership_counts(spark):
    """Owners and repositories of each value, counted by hand; a value of one owner in many repositories is shared."""
    rng = random.Random(8)
    rows = [(rng.randrange(6), f"o{rng.randrange(4)}", f"r{rng.randrange(30)}") for _ in range(400)]
    expected = {v: (len({o for w, o, _ in rows if w == v}), len({(o, r) for w, o, r in rows if w == v})) for v, _, _ in rows}
    found = secret_scan.ownership(spark.createDataFrame(rows, "value long, owner string, repo string")).collect()
    assert {r["value"]: (r["owners"], r["repos"]) for r in found} == expected
    token = "Zq9rT2xLw8Kp4Vn6Bs1Yd3"
    many = [(i, f"see {token}", f"repo{i}", "one") for i in range(secret_scan.REPOS_AN_OWNER)]
    for rows, added in ((many, 0), (many[1:], 1)):
        docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
        out = secret_scan.secrets(docs, F.col("repo"), F.col("owner")).collect()
        assert {len(r["spans"]) for r in out} == {added}
        assert {r["n_shared"] for r in out} == {1 - added}


def test_secrets_against_one_pass_in_memory(spark, docs):
    """Live and shared values and added spans of whole documents, found with nothing of the module; some documents carry
    tokens that several owners, several repositories of one owner, or one repository hold."""
    planted = ["Qz8nT4xLw2Kp6Vn1Bs9Yd5", "Hj3kL7mN1pQ5rS9tU2vW6x", "Xc4vB8nM2aS6dF1gH5jK9l"]
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.select("doc_id", "text", "source", "lang").collect()]
    rows += [(10_000 + i, f"in {planted[0]}, x", f"s{i}", "en") for i in range(4)] + [(11_000 + i, planted[1], "s1", f"l{i}") for i in range(3)] + [(12_000 + i, f"token={planted[2]} {planted[2]}", "s1", "en") for i in range(2)]
    patterns = [re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("(AKIA[A-Z0-9]{16,})"), re.compile("([0-9a-f]{24,})")]

    def found(text):
        base = [(m.start(), k, m.end(), m[1]) for k, p in enumerate(patterns) for m in p.finditer(text) if k or len(m[1]) >= 6]
        inside = lambda m: any(a < m.end() and b > m.start() for a, _, b, _ in base)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]) and not inside(m)]
        return sorted(base), more

    holders: dict = {}
    for _, text, source, lang in rows:
        for *_, value in sum(found(text or ""), []):
            holders.setdefault(value, set()).add((source, lang))
    shared = {v: len({s for s, _ in h}) >= 3 or len(h) >= 3 * len({s for s, _ in h}) for v, h in holders.items()}
    random_ = lambda v: -sum(v.count(c) / len(v) * np.log2(v.count(c) / len(v)) for c in set(v)) >= 3 - 1e-12
    out = {r["doc_id"]: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), F.concat_ws("/", "source", "lang"), F.col("source")).collect()}
    added = 0
    for doc_id, text, *_ in rows:
        base, more = found(text or "")
        live = lambda x: random_(x[3]) and not shared[x[3]]
        spans = sorted([x[:3] for x in base] + [x[:3] for x in more if live(x)])
        assert [(s["start"], s["kind"], s["end"]) for s in out[doc_id]["spans"]] == spans
        assert (out[doc_id]["n_live"], out[doc_id]["n_shared"]) == (sum(map(live, base + more)), sum(shared[x[3]] for x in base + more))
        added += len(spans) - len(base)
    assert added == 2


def test_candidates_outside_base_spans():
    """The one pass over tokens and spans finds what a comparison of every token with every span finds."""
    rng = random.Random(9)
    parts = ["Ab1" * 8, "x", "token = Qw3rTy7uIoP9", "0123456789abcdef0123456789abcdef", "AKIA" + "Z9" * 9, "plain words", "secret: 'Mn8Bv5Cx2Lk0Jh4Gf6Ds'"]
    for _ in range(60):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        base = secret_scan.base_spans(text)
        found = {(a, b) for a, kind, b, _, _ in secret_scan.candidates(text, base) if kind == 3}
        mixed = [m for m in secret_scan.TOKEN.finditer(text) if m[0].lower() != m[0] and m[0].upper() != m[0] and any(c.isdigit() for c in m[0])]
        assert found == {m.span() for m in mixed if all(m.end() <= a or m.start() >= b for a, _, b in base)}


# ---- 5


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", r"<\|x", "<<||", "a\nb", "", None, "%0A%25", r"\<|\|", "<|im_start|>user\nhi<|im_end|>\n", "é" * 9]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "we%ird\nrole<|", None]), rng.choice(texts), 1) for c in [*range(30), None] for t in range(rng.randrange(1, 9))]
    rows += [(5, 0, "assistant", "tie", 1), (5, None, "user", "no turn", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head int")
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_examples(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text, _ in rows if k == c))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert found[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (found[c]["loss_sha256"], found[c]["loss_chars"], found[c]["n_turns"]) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss), len(turns))
    assert chat_format.format_examples(df.limit(0)).count() == 0


def test_long_and_missing_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    long = "<|im_end|> é " * 60_000
    r = chat_format.read_back(chat_format.format_examples(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], schema))).first()
    assert r["loss_chars"] == len(long)
    assert r["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_examples(spark.createDataFrame([], schema))).count() == 0


def test_examples_are_prefixes(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "r"), (1, 3, "assistant", "a2"), (1, 4, "user", "end")]
    out = chat_format.format_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [r["text"][r["loss_start"] : r["loss_start"] + r["loss_length"]] for r in out] == ["a1", "a2", ""]
    assert out[1]["text"].startswith(out[0]["text"])
    assert [r["trainable"] for r in out] == [True, True, False]


# ---- 6 and 7


def test_mix_on_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    total = sum(r["size"] for r in rows)
    assert sum(r["size"] * r["copies"] for r in rows) <= total
    assert all(0 <= r["copies"] <= 3 for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0
    assert {r["copies"] for r in mixing.mix(odd.where("doc_id in (1, 2, 3)")).collect()} == {0}


def test_mixed_stream_follows_the_weights(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), "abc"[i % 3]) for i in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = {r[0]: (r[1], r[2]) for r in mixed.join(spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.col("size") * F.col("copies")), F.first("target")).collect()}
    assert all(abs(t - goal) <= 40 for t, goal in taken.values())
    ordered = [r["finish"] for r in mixing.in_mixed_order(mixed).collect()]
    assert ordered == sorted(ordered)
    assert len(ordered) == mixed.agg(F.sum("copies")).first()[0]


def test_shards(spark, docs, odd):
    for df, tolerance in ((docs, 0.03), (odd, None)):
        rows = sharding.assign_shards(df).collect()
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        for s in range(8):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        if tolerance:
            sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
            assert max(sizes) - min(sizes) < tolerance * sum(sizes)
    assert sharding.assign_shards(odd.limit(0)).count() == 0


def placed_by_hand(rows, shards):
    """(doc_id, size, shard, slot) by one sort and one running sum over all rows."""
    key = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    order = sorted((key(t or ""), key("" if d is None else str(d)), d is not None, d or 0, len((t or "").encode()) + 1, d) for d, t in rows)
    share = sum(r[4] for r in order) / shards
    sizes, starts, at, slots = Counter(), {}, 0, Counter()
    for r in order:
        sizes[r[0]] += r[4]
    for h, _, _, _, size, d in order:
        starts.setdefault(h, at)
        middle = starts[h] + sizes[h] / 2 if sizes[h] <= sharding.SPLIT_OVER * share else at + size / 2
        shard = min(shards - 1, int(middle // share))
        yield d, size, shard, slots[shard]
        slots[shard] += 1
        at += size


@pytest.mark.parametrize("shards", [1, 8, 13])
def test_shards_against_one_sort(spark, docs, odd, shards):
    hot = spark.createDataFrame([(i % 900 or None, "hot " * 40 if i % 3 else f"text {i // 4} " * (i % 50)) for i in range(3000)], "doc_id long, text string")
    for df in (docs, odd, hot):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        out = sharding.assign_shards(df, shards).collect()
        assert Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in out) == Counter(placed_by_hand(rows, shards))


def test_a_hot_text_is_split_and_a_small_group_is_not(spark):
    rows = [(i, "hot text " * 30 if i % 3 == 0 else f"text {i // 2} " * 25) for i in range(4000)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = Counter()
    shards_of: dict = {}
    for r in out:
        sizes[r["shard"]] += r["size"]
        shards_of.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert max(sizes.values()) < 1.03 * min(sizes.values())
    assert sorted(map(len, shards_of.values()))[-2:][0] == 1  # all but the hot one stay together
    assert max(map(len, shards_of.values())) > 2


# ---- 9


def brute_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda s: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    windows: dict = {}
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - 9, 1)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    lengths = {len(w) for w in windows}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        yield d, len(w), len(hit), sorted(found)


def test_window_words_are_counted_over_all_documents(spark):
    """A word that one of 5,000 documents holds is known as such, and a window with a word that none holds is out."""
    rows = [(i, "Alpha beta gamma") for i in range(5000)] + [(5000, "Delta beta"), (None, None)]
    windows = spark.createDataFrame([(1, ["alpha", "beta", "gamma"]), (2, ["beta", "delta", "gamma"]), (3, ["alpha", "nowhere"])], "id long, window array<string>")
    found = decontaminate.rarest(spark.createDataFrame(rows, "doc_id long, text string"), windows).collect()
    assert {tuple(r) for r in found} == {(1, 5000, "alpha", 0), (2, 1, "delta", 1)}


def test_quality_is_fitted_on_all_labels(spark, sf_dir, monkeypatch):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    before = {r["key"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    monkeypatch.setattr(quality, "FIT_ROWS", 20, raising=False)  # the cap that there was
    after = {r["key"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    assert max(abs(before[k] - after[k]) for k in before) < 1e-9


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["a", "b", "É", "é", "c1", "D", "d", "e", "x-y"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 12, 30]))) for i in range(12)] + [(None, "E e b"), (3, None), (4, ""), (5, "!!"), (5, text(11))]
    rows = [(i, text(rng.randrange(60)) + " " + rng.choice(items)[1].__str__() + "," + text(5)) for i in range(80)] + [(1, None), (2, ""), (2, "a a a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter((d, n, h, tuple(f)) for d, n, h, f in brute_hits(rows, items))
    for block in (100_000, 7):
        out = decontaminate.decontaminate(docs, bench, block_windows=block).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out) == expected
    assert all(r["n_hit"] == 0 for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())
    long = " ".join(f"w{i}" for i in range(300_000)) + " " + items[0][1] + " end"
    found = decontaminate.decontaminate(spark.createDataFrame([(1, long)], "doc_id long, text string"), bench).first()
    assert [(found["n_words"], found["n_hit"], tuple(found["items"]))] == [(n, h, tuple(f)) for _, n, h, f in brute_hits([(1, long)], items)]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


# ---- 10


def test_fingerprints(spark, docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    out = {r["doc_id"]: r for r in piecewise_hash.fingerprints(docs).collect()}
    assert len(out) == len(rows)
    for r, following in zip(rows, [*rows[1:], rows[0]], strict=True):
        o, changed = out[r["doc_id"]], piecewise_hash.edited(r["text"], following["text"])
        own, other = piecewise_hash.fingerprint(r["text"]), piecewise_hash.fingerprint(changed)
        assert (o["n_chars"], o["fingerprint"], o["edited_fingerprint"]) == (len(r["text"]), own, other)
        assert o["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert o["near_edited"] == piecewise_hash.likeness(own, other)
        assert o["near_next"] == piecewise_hash.likeness(own, piecewise_hash.fingerprint(following["text"]))
    long = [o for o in out.values() if o["n_chars"] > 500]
    assert np.mean([o["near_edited"] > o["near_next"] for o in long]) > 0.9


def test_edit_likeness_is_the_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        expected = 1.0 if a == b else 2 * best[-1][-1] / (len(a) + len(b)) if a and b else 0.0
        assert piecewise_hash.edit_likeness(a, b) == expected


def test_fingerprints_on_odd_rows(spark, odd):
    rows = piecewise_hash.fingerprints(odd).collect()
    assert len(rows) == len(ODD)
    assert next(r for r in rows if r["doc_id"] == 1)["fingerprint"] == "1::"
    assert all(0 <= r["near_edited"] <= 1 for r in rows)
    one = piecewise_hash.fingerprints(odd.where("doc_id = 9")).collect()
    assert len(one) == 1
    assert one[0]["near_next"] == 1.0
    assert piecewise_hash.fingerprints(odd.limit(0)).count() == 0


def slow_fingerprint(text):
    """The rule written out byte by byte, with none of the module's code: hits, cuts, block size, characters."""
    data = text.encode()
    if not data:
        return "1::"
    hashes = []
    for i in range(len(data)):
        h = 0
        for j in range(min(7, i + 1)):
            h = (h + (data[i - j] + 1) * pow(0x01000193, j, 2**32)) % 2**32
        h = h * 0x9E3779B1 % 2**32
        hashes.append(h ^ (h >> 15))

    def pieces(block):
        out, start = [], 0
        for i in range(len(data)):
            if hashes[i] % block == block - 1 or i + 1 - start == 3 * block or i + 1 == len(data):
                out.append(data[start : i + 1])
                start = i + 1
        return out

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hits = lambda block: sum(h % block == block - 1 for h in hashes)
    block = 1
    while block * 64 < len(data):
        block *= 2
    while hits(block) > 64 or len(pieces(block)) > 64:
        block *= 2
    while block > 1 and len(pieces(block)) < 32 and hits(block // 2) <= 64 and len(pieces(block // 2)) <= 64:
        block //= 2
    return ":".join([str(block), *("".join(letters[zlib.crc32(p) % 64] for p in pieces(b)) for b in (block, 2 * block))])


def slow_likeness(one, other):
    if one == other:
        return 1.0
    (m, *a), (n, *b) = one.split(":"), other.split(":")
    best = 0.0
    for i in range(2):
        for j in range(2):
            x, y = a[i], b[j]
            least = min(7, max(1, min(len(x), len(y)) // 3))
            if int(m) << i == int(n) << j and x and y and any(x[k : k + least] in y for k in range(len(x) - least + 1)):
                row = [0] * (len(y) + 1)
                for c in x:
                    old = row
                    row = [0]
                    for k, d in enumerate(y):
                        row.append(old[k] + 1 if c == d else max(old[k + 1], row[k]))
                best = max(best, 1.0 if x == y else 2 * row[-1] / (len(x) + len(y)))
    return best


def odd_texts(rng):
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    line = words(14) + "\n"
    return ["", "a", "aé", "a" * 3000, "ab" * 1500, line * 40, line * 3 + words(300), words(5), words(60), words(400), "z" * 700 + words(120), words(9) + "\n" * 900]


def test_fingerprints_against_the_rule_written_out():
    rng = random.Random(6)
    texts = odd_texts(rng) + odd_texts(rng)
    prints = [piecewise_hash.fingerprint(t) for t in texts]
    assert prints == [slow_fingerprint(t) for t in texts]
    for one in prints:
        for other in prints:
            assert piecewise_hash.likeness(one, other) == slow_likeness(one, other)


def test_half_of_a_repeated_text_is_recognised():
    """Repeated characters and lines have pieces as other texts have, so half of them replaced leaves likeness."""
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("abcdefghij klmnop") for _ in range(99)) + "\n"
    for text in ["a" * 20000, "\n" * 5000, line() * 400, "".join(line() for _ in range(3)) * 100, line() * 30]:
        own = piecewise_hash.fingerprint(text)
        assert max(map(len, own.split(":")[1:])) <= piecewise_hash.PIECES
        other = piecewise_hash.fingerprint(text[: len(text) // 2] + "".join(line() for _ in range(len(text) // 200)))
        assert 0.15 < piecewise_hash.likeness(own, other) < 1, (text[:20], own, other)
        assert piecewise_hash.likeness(own, piecewise_hash.fingerprint("".join(line() for _ in range(len(text) // 100)))) < 0.1
