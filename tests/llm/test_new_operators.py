"""Conversation repair, line rules and collocations: against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations, conversation_repair, line_rules
from lodestone.llm.common import join_counted

SPACE = " \t\n\x0b\x0c\r"


# ---- 11

TURNS = "conv_id long, turn long, role string, text string, at long, conv string, block int"


def cheapest(turns):
    """(role, text) rows in order to cost, audit and repaired turns: every state at every row, longest suffixes last."""
    seen, codes = set(), []
    for role, text in turns:
        bare = text.strip(SPACE)
        codes.append((role, text, not bare or (role, text) in seen, bool(bare) and (role, text) not in seen and bare[-1] not in ".!?"))
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    word = {"u": "user", "a": "assistant"}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for s in out:
                n = after[s]
                c, audit, rows = out[n]
                out[s] = min(out[s], (c + 2, "I" + audit, [(word[n], ""), *rows]))
        return out

    best = inserted({s: (0 if s in ("", "a") else 10**6, "", []) for s in after})
    for role, text, bad, cut in reversed(codes):
        now = {}
        for s in after:
            c, audit, rows = best[s]
            options = [(c + 3, "D" + audit, rows)]
            if not bad:
                initial = role[:1]
                if (initial == "s" and s == "") or (initial in word and after[s] == initial):
                    c, audit, rows = best[initial]
                    options.append((c + cut, "K" + audit, [(role, text), *rows]))
                c, audit, rows = best[after[s]]
                options.append((c + 2 + cut, "R" + audit, [(word[after[s]], text), *rows]))
            now[s] = min(options)
        best = inserted(now)
    faults = [sum(not t.strip(SPACE) for _, t, _, _ in codes), sum(bad and bool(t.strip(SPACE)) for _, t, bad, _ in codes), sum(cut for *_, cut in codes)]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return best[""], faults, illegal


def chats(seed, n, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            rows.append((conv, turn * r.choice([1, 1, 1, 2]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"]), r.choice(["yes.", "no", " ", "", "why?", "so\n", "a! ", f"text {turn}.", f"open {turn}"])))
    return rows


@pytest.mark.parametrize("bits", [1, 3, 7])
def test_repair_against_every_suffix(spark, monkeypatch, bits):
    """In blocks of 2, 8 and 128 turns, whose seams fall anywhere."""
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)
    rows = chats(bits, 40, 12)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, repaired = conversation_repair.repair(df)
    found = {r["conv"]: r for r in report.collect()}
    turns = defaultdict(list)
    for r in repaired.orderBy("conv", "at", "nth").collect():
        turns[r["conv"]].append((r["role"], r["text"]))
    digests = {r["conv"]: r["sha256"] for r in conversation_repair.digests(repaired).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[str(conv)].append((turn, role, hashlib.md5(text.encode()).hexdigest(), text))
    for conv, own in by.items():
        own.sort()
        (cost, audit, kept), faults, illegal = cheapest([(role, text) for _, role, _, text in own])
        r = found[conv]
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert turns[conv] == kept
        assert [r["blank"], r["duplicate"], r["truncated"]] == faults
        assert r["illegal"] == illegal
        at = [x[0] for x in own]
        assert r["gaps"] == max(at) - min(at) + 1 - len(set(at))
        if kept:
            assert digests[conv] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        else:
            assert conv not in digests
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _ in kept))
    assert len(found) == len(by)


def test_repair_of_a_long_conversation(spark):
    """Thousands of turns in one conversation: many blocks in several tasks, one audit."""
    rows = [(7, i, "user" if i % 2 == 0 or i % 10 == 3 else "assistant", f"turn {i}" + "." * (i % 7 > 0)) for i in range(3000)]
    report, repaired = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (cost, audit, kept), _, _ = cheapest([(r, t) for _, _, r, t in rows])
    r = report.first()
    assert (r["cost"], r["audit"]) == (cost, audit)
    assert [(x["role"], x["text"]) for x in repaired.orderBy("at", "nth").collect()] == kept


def test_repair_on_odd_rows(spark):
    big = 2**63 - 1
    rows = [
        (None, None, None, None, 1, "x", 2), (None, 1, "user", "hi.", 1, "x", 2), (None, None, "user", "first.", 1, "x", 2),
        (1, 5, "user", "same.", 1, "x", 2), (1, 5, "user", "same.", 1, "x", 2), (1, 5, "user", "same.", 1, "x", 2),
        (2, None, "assistant", "w" * 300_000 + ".", 1, "x", 2), (2, None, "user", "tie!", 1, "x", 2),
        (3, -big, "user", "low.", 1, "x", 2), (3, big, "assistant", "high.", 1, "x", 2),
        (4, 1, "", " \t\x0b\n", 1, "x", 2),
    ]
    df = spark.createDataFrame(rows, TURNS)
    report, repaired = conversation_repair.repair(df)
    found = {r["conv"]: r for r in report.collect()}
    assert {k: (r["audit"], r["cost"], r["gaps"], r["blank"], r["duplicate"]) for k, r in found.items()} == {
        " ": ("DKR", 5, 0, 1, 0), "1": ("KDDI", 8, 0, 0, 2), "2": ("IKKI", 4, 0, 0, 0), "3": ("KK", 0, big, 0, 0), "4": ("D", 3, 0, 1, 0),
    }
    assert {r["conv"] for r in repaired.collect()} == {" ", "1", "2", "3"}
    report, repaired = conversation_repair.repair(df.limit(0))
    assert report.count() == repaired.count() == conversation_repair.digests(repaired).count() == 0


def test_dropped_conversations_have_zeros(spark, monkeypatch, tmp_path):
    """Turns whose crc32 divides by 20 go; a conversation of only such turns is still in the result."""
    import zlib

    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    path = f"{tmp_path}/sf"
    spark.createDataFrame([(gone, 0, "user", "hello.")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    r = conversation_repair.op11_conversation_repair(spark, path).first()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two?") for c in range(30) for t in range(4)] + [(None, 3, None, None), (5, None, "user", "x!")]
    out = Counter(tuple(r) for r in conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    expected = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            expected[c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text] += 1 + (kind == 3)
    assert out == expected


# ---- 12

DOCS = "doc_id long, text string, host string, row long, line string, n long"


def line_verdicts(rows):
    """(doc_id, text, host) to sorted results, in one pass in memory."""
    def norm(line):
        return re.sub(f"[{SPACE}]+", " ", re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))))

    def words(x):
        return [w for w in re.split(f"[{SPACE}]+", x) if w]

    docs, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if words(line):
                docs[host, norm(line)].add(text)
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        w = words(text)
        places = defaultdict(list)
        for i in range(len(w) - 2):
            places[tuple(w[i : i + 3])].append(i)
        repeated = len({i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)})
        lines = [x for x in text.split("\n") if words(x)]
        n = lambda x: len(docs[host, norm(x)])
        over = [x for x in lines if n(x) > 20 or (n(x) > 5 and n(x) > 0.1 * len(hosts[host]))]
        removed = sum(len(words(x)) for x in over)
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        left = len(w) - removed
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, len(over), removed, failed, not failed and left >= 50 and left >= 0.5 * len(w)))
    return Counter(out)


def test_line_rules_against_one_pass(spark):
    r = random.Random(5)
    shared = [" ".join(f"s{r.randint(0, 500)}" for _ in range(n)) for n in (8, 30, 60, 90)]
    rows = []
    for i in range(160):
        own = [" ".join(f"w{r.randint(0, 4000)}" for _ in range(r.randint(5, 60))) for _ in range(r.randint(0, 4))]
        some = [x.upper() + f"  {i}" if r.random() < 0.3 else x for x in shared if r.random() < 0.35]
        text = "\n".join(r.sample(own + some + [""], len(own + some) + 1)) + ("\nabc abc abc abc #1" * r.randint(0, 12) if r.random() < 0.2 else "")
        rows.append((i, text, r.choice(["big", "big", "big", "small", None])))
    rows += [rows[3]] * 40  # one text, however often, is one document
    out = line_rules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, host string"))
    found = Counter(tuple(x) for x in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_lines", "removed_words", "base_failed", "kept").collect())
    assert found == line_verdicts(rows)
    assert any(x[-1] for x in found)
    assert any(not x[-1] and not x[-2] for x in found)


def test_line_rules_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t\x0b ", "a"), (None, "é ü x", "a"), (None, "é ü x", "a"), (5, long, "b"), (6, "a b " * 30_000, "b"), (7, "q\n" * 1000, "b")]
    df = spark.createDataFrame([(*x, 1, "x", 2) for x in rows], DOCS)
    out = line_rules.line_rules(df)
    assert Counter(tuple(x) for x in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_lines", "removed_words", "base_failed", "kept").collect()) == line_verdicts(rows)
    assert line_rules.line_rules(df.limit(0)).count() == 0


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    """Keys over a share of the rows by broadcast, the others by a shuffle: the rows of one plain join."""
    from lodestone.llm import common

    monkeypatch.setattr(common, "HEAVY", 5)
    rows = spark.createDataFrame([(i % 50 if i % 3 else 0, i) for i in range(600)], "k int, v int").cache()
    counted = rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 7 = 0").cache()
    plain = Counter(tuple(x) for x in rows.join(counted, "k").select("k", "v", "n").collect())
    assert Counter(tuple(x) for x in join_counted(rows, counted, ["k"]).select("k", "v", "n").collect()) == plain
    assert join_counted(rows, counted.limit(0), ["k"]).count() == 0


# ---- 13


def phrases_by_hand(rows, least, best):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            score, _, left, right = min((2000000 * a // (counts[phrase[:k]] + counts[phrase[k:]]), k, counts[phrase[:k]], counts[phrase[k:]]) for k in range(1, len(phrase)))
            inside = lambda q: any(q[i : i + len(phrase)] == phrase for i in range(len(q) - len(phrase) + 1))  # noqa: B023, E731
            if not any(len(q) > len(phrase) and b >= least and 100 * b >= 80 * a and inside(q) for q, b in counts.items()):
                found.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def talk(seed, n):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [r.choice(["New York", "New York City hall", "a b a b", "of the", "Ünter der", "x y z", "the", "of", "one  two\tthree", "rare%d" % r.randint(0, 99)]) for _ in range(r.randint(0, 30))]
        rows.append((r.choice(["en", "fr", None, "und"]), "".join(w + r.choice([" ", " ", " ", ", ", "\n", ".", "\r"]) for w in words)))
    return rows


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_collocations_by_hand(spark, monkeypatch, bits):
    """Also with a table of 64 bits, in which every phrase seems frequent."""
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    rows = talk(1, 120)
    out = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 4, 25)
    expected = phrases_by_hand(rows, 4, 25)
    assert sorted(tuple(r) for r in out.collect()) == expected
    assert max(r[1] for r in expected) == 25


def test_levels_emit_only_what_may_be_frequent():
    import numpy as np

    words = collocations.Words({"en": [b"a b c\na b d"]})
    bits = np.zeros(1 << 14, np.uint64)
    for p in ("a b", "b d"):
        h = collocations.phrase_hash("en", p) & ((1 << 20) - 1)
        bits[h >> 6] |= np.uint64(1 << (h & 63))
    _, phrases, times = collocations.counted(words, 3, bits)
    assert (phrases.to_pylist(), times.tolist()) == ([b"a b d"], [1])
    _, phrases, times = collocations.counted(words, 2, None)
    assert dict(zip(phrases.to_pylist(), times.tolist(), strict=True)) == {b"a b": 2, b"b c": 1, b"b d": 1}
    assert collocations.counted(collocations.Words({"en": [b"a"]}), 3, None)[1].to_pylist() == []
    assert collocations.counted(collocations.Words({"en": [b"", b"\n \n"]}), 1, None)[1].to_pylist() == []


def test_slices_keep_pieces_whole(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 10)
    text = (b"Aaaa bbbb cccc, dd ee\tff gg hh ii; jj. " * 3 + b"k" * 30).translate(collocations.PLAIN)
    parts = list(collocations.slices(text))
    assert b"".join(parts) == text
    assert len(parts) > 4
    assert all(p.endswith(b"\n") for p in parts[:-1])


def test_scores_past_64_bits(spark):
    """Occurrences whose product with two million passes 64 bits."""
    big = 4 * 10**18
    rows = [("en", "p", 1, big), ("en", "q", 1, big), ("en", "p q", 2, big)]
    r = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, k int, f long")).first()
    assert (r["score"], r["a"], r["l"]) == (1_000_000, big, big)


def test_collocations_on_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", " \t "), ("en", "..,,"), ("en", "one two " * 50_000), ("en", "one two " * 50_000), ("fr", "x" * 100_000), ("en", "\x00a b")]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "lang string, text string, phrase string, f long, k int, n long")
    out = sorted(tuple(r) for r in collocations.collocations(df, 30, 5).collect())
    assert out == phrases_by_hand([r for r in rows], 30, 5)
    assert collocations.collocations(df.limit(0)).count() == 0
