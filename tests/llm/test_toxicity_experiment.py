"""Why op1's discounts grow with the joint count: the plain models on the same labels, in memory, beside the operator."""

import math
import zlib
from collections import Counter

import numpy as np

from lodestone.llm.common import table
from lodestone.llm.minhash import words_of
from lodestone.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def discounts(counts):
    """Modified Kneser-Ney: absolute discounts of counts of 1, 2 and more, from how often counts of 1 to 4 occur."""
    n = Counter(min(c, 5) for c in counts)
    y = n[1] / max(1, n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n[k + 1] / max(1, n[k]) for k in (1, 2, 3)]
    return lambda c: min(c, max(0.0, d[min(c, 3) - 1])) if c else 0.0


def plain_model(texts, shared):
    """log p(w | v) of a class: token counts of pairs, continuation counts of words, and below these the counts that both
    classes share."""
    pairs = Counter(p for ws in texts for p in zip(ws, ws[1:], strict=False))
    after, before = Counter(), Counter()
    for (v, w), c in pairs.items():
        after[v] += c
        before[w] += 1
    d2, d1 = discounts(pairs.values()), discounts(before.values())
    left2, left1, n1 = Counter(), sum(map(d1, before.values())), sum(before.values())
    for (v, _), c in pairs.items():
        left2[v] += d2(c)

    def log_p(v, w):
        p = (before[w] - d1(before[w]) + left1 * shared(w)) / n1
        if after[v]:
            p = (pairs[v, w] - d2(pairs[v, w]) + left2[v] * p) / after[v]
        return math.log(p)

    return log_p


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_the_operator_against_plain_kneser_ney(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect() if r["toxic"] is not None}
    docs = [(r["doc_id"], words_of(r["text"] or "")) for r in table(spark, SF, "documents").select("doc_id", "text").collect() if r["doc_id"] in labels]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    learned = [(ws, labels[i]) for i, ws in docs if fold(i)]
    joint = Counter(w for ws, _ in learned for w in ws)
    total = sum(joint.values()) + 0.5 * (len(joint) + 1)
    toxic, ordinary = (plain_model([ws for ws, y in learned if y == c], lambda w: (joint[w] + 0.5) / total) for c in (1, 0))
    held = [(i, ws) for i, ws in docs if fold(i) == 0]
    y = np.array([labels[i] == 1 for i, _ in held])
    plain = np.array([np.mean([toxic(*p) - ordinary(*p) for p in zip(ws, ws[1:], strict=False)]) if len(ws) > 1 else 0.0 for _, ws in held])
    found = {r["doc_id"]: r["score"] for r in QUERIES["op1_toxicity"](spark, SF).where("held_out").collect()}
    ours = np.array([found[i] for i, _ in held])
    best = max(((plain >= t) & y).sum() / y.sum() for t in plain if ((plain >= t) & y).sum() >= 0.9 * (plain >= t).sum())
    recall, precision = (ours[y] >= 0.5).mean(), y[ours >= 0.5].mean()
    print(f"plain: AUC {auc(plain, y):.3f}, recall {best:.2f} at precision 0.9; operator: AUC {auc(ours, y):.3f}, recall {recall:.2f}, precision {precision:.2f}")
    assert auc(ours, y) > 0.95 > 0.9 > auc(plain, y)
    assert recall >= 0.9 > 0.7 > best
    assert precision >= 0.95
