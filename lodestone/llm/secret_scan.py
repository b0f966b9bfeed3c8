"""Secret scans with corpus-wide ownership frequency.

Three patterns give the base spans of a text. Besides, every long token that mixes cases and digits is a candidate.
Candidate values (by hash) are counted over the whole corpus by distinct repositories and owners: a value that
several owners hold, or that one owner has in several repositories, is a copied example; one that looks random and is
neither is probably live. Candidates outside
the base spans that prove live are added as spans of kind ``token``; base spans stay whatever their verdict.

A text is read once; only candidates (a few per thousand documents) are shuffled, pre-aggregated by (value, owner,
repository).

Defined cases: a null text is empty; very long texts are read whole; null repositories and owners count as one; repeated rows are scanned alike and
count once per repository; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# Runs are maximal, so the least length can stand in the pattern without changing which matches are left.
ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A value held by so many owners, or in so many repositories for each owner that holds it, is a copied example; entropy
#: in bits a character from which a value looks random.
SHARED_OWNERS, REPOS_AN_OWNER, RANDOM_BITS = 3, 3, 3.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, kind, end, hash of the value, looks random) of base spans and of mixed tokens outside them."""
    out = []
    for start, kind, end in base:
        value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
        out.append((start, kind, end, xxhash.xxh64_intdigest(value.encode()) - 2**63, bits(value) >= RANDOM_BITS))
    at, reach = 0, 0  # base spans that start before the token's end, and the furthest end of these
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        v = m[0]
        if reach <= m.start() and v.lower() != v and v.upper() != v and any(c.isdigit() for c in v):
            out.append((m.start(), 3, m.end(), xxhash.xxh64_intdigest(v.encode()) - 2**63, bits(v) >= RANDOM_BITS))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64()), ("random", pa.bool_())]))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            some = batch.slice(i, 1024)
            spans, found = [], []
            for text in some.column(3).to_pylist():
                base = base_spans(text or "")
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                found.append([{"start": s, "kind": k, "end": e, "value": h, "random": r} for s, k, e, h, r in candidates(text or "", base)])
            rows = pa.array(range(row, row + some.num_rows), pa.int64())
            row += some.num_rows
            yield pa.RecordBatch.from_arrays([rows, some.column(0), some.column(1), some.column(2), pa.array(spans, SPANS), pa.array(found, FOUND)], names=["row", "doc_id", "repo", "owner", "base", "found"])


def joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(held: DataFrame) -> DataFrame:
    """(value, owner, repo) rows to value, owners, repos: by how many different owners and repositories it is held.
    Copies within a repository, then within an owner, are merged by the tasks that have them before any shuffle."""
    by_owner = held.groupBy("value", "owner", "repo").count().groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def secrets(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """One row per document: doc_id, base (spans of the patterns), spans (with the added ones), n_live, n_shared."""
    rows = docs.select("doc_id", F.coalesce(repo, F.lit("")).alias("repo"), F.coalesce(owner, F.lit("")).alias("owner"), "text")
    kinds = "start: bigint, kind: int, end: bigint"
    scanned = stored(rows.mapInArrow(scan, f"row long, doc_id long, repo string, owner string, base array<struct<{kinds}>>, found array<struct<{kinds}, value: bigint, random: boolean>>"), "secrets")
    held = scanned.select("row", "repo", "owner", F.explode("found").alias("c")).select("row", "repo", "owner", "c.*")
    known = stored(ownership(held), "secret-values")
    shared = (F.col("owners") >= SHARED_OWNERS) | (F.col("repos") >= REPOS_AN_OWNER * F.col("owners"))
    judged = held.join(known, "value").select("row", "start", "kind", "end", shared.alias("shared"), "random")
    live = F.col("random") & ~F.col("shared")
    per = judged.groupBy("row").agg(
        F.collect_list(F.when(live & (F.col("kind") == 3), F.struct("start", "kind", "end"))).alias("added"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum(F.col("shared").cast("long")).alias("n_shared"),
    )
    out = scanned.select("row", "doc_id", "base").join(per, "row", "left")
    every = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(f"array<struct<{kinds}>>"))))
    return out.select("doc_id", "base", every.alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_shared")
