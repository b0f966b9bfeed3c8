"""Near-duplicates against a comparison of all pairs, on tables small enough for that."""

import itertools
import random

import numpy as np
import pytest

from lodestone.llm import minhash as m
from lodestone.llm.common import table

SCHEMA = "doc_id long, text string"


def brute(rows, idf):
    """Groups of ids by all pairs: {id: least id of its group}, and the alike pairs of texts."""
    shingler = m.Shingler(idf)
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets = shingler(texts)
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    links = set()
    inverted: dict = {}
    for i, (h, _) in enumerate(sets):
        for x in h.tolist():
            inverted.setdefault(x, []).append(i)
    pairs = {p for ids in inverted.values() for p in itertools.combinations(ids, 2)}
    for i, j in pairs:
        if m.weighted_jaccard(sets[i], sets[j]) >= m.THRESHOLD:
            links.add((texts[i], texts[j]))
            a, b = find(texts[i]), find(texts[j])
            if a != b:
                parent[a] = b
    least: dict = {}
    for d, t in rows:
        g = find(t or "")
        least[g] = min(least.get(g, d), d)
    return {d: least[find(t or "")] for d, t in rows}, links


def test_equals_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    expected, links = brute(rows, m.word_frequencies(docs))
    found = {r["doc_id"]: r for r in m.near_duplicates(docs).collect()}
    assert len(found) == len(rows)
    assert {d: r["group_id"] for d, r in found.items()} == expected


def test_chain_and_large_group(spark):
    """A chain whose ends are not alike, and a group of near copies larger than any pair list should be."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    chain, at = [base], base
    for k in range(4):
        at = at.copy()
        at[40 * k] = f"edit{k}"
        chain.append(at)
    big = [rng.choice(words) for _ in range(200)]
    copies = []
    for k in range(60):
        c = big.copy()
        c[rng.randrange(200)] = f"other{k}"
        copies.append(c)
    alone = [[rng.choice(words) for _ in range(100)] for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(chain + copies + alone)]
    docs = spark.createDataFrame(rows, SCHEMA)
    expected, _ = brute(rows, m.word_frequencies(docs))
    found = {r["doc_id"]: r["group_id"] for r in m.near_duplicates(docs).collect()}
    assert found == expected
    assert {found[i] for i in range(5, 65)} == {5}
    assert all(found[i] == i for i in range(65, 85))


def test_unsettled_members_are_compared_with_their_bucket(spark, monkeypatch):
    """With hubs that settle little (bands of one sample), the result is still that of all pairs."""
    monkeypatch.setattr(m, "BANDS", 39)
    monkeypatch.setattr(m, "ROWS", 1)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(30):
        own = [rng.choice(words) for _ in range(70)]
        rows.append((2 * i, " ".join(shared + own)))
        edited = own.copy()
        edited[35] = "changed"
        rows.append((2 * i + 1, " ".join(shared + edited)))
    docs = spark.createDataFrame(rows, SCHEMA)
    expected, _ = brute(rows, m.word_frequencies(docs))
    assert {r["doc_id"]: r["group_id"] for r in m.near_duplicates(docs).collect()} == expected


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "one two"), (5, "!!!"), (None, "one two"), (7, "a b c d e f " * 4000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", label string")
    found = m.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    groups = {(r["doc_id"], r["group_id"]) for r in found}
    assert groups == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (None, 3), (7, 7)}
    assert m.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("similar", [0.5, 0.8, 0.95])
def test_samples_agree_as_often_as_weights_overlap(similar):
    rng = np.random.default_rng(1)
    n = 400
    h = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
    w = rng.uniform(0.5, 3, 2 * n)
    shared = int(n * 2 * similar / (1 + similar))
    a = np.argsort(h[:n])
    rest = np.r_[0:shared, n : 2 * n - shared]
    b = rest[np.argsort(h[rest])]
    one, other = (h[a], w[a]), (h[b], w[b] * np.where(b < shared, 1.05, 1))
    tags = m.samples([one, other], 2000)
    assert abs((tags[0] == tags[1]).mean() - m.weighted_jaccard(one, other)) < 0.04
