"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a piece wherever it hits a value that depends on the block size; a piece that no hit
ends within LONGEST block sizes is cut there, so repeated text, whose hits are all or none, has pieces too. Each piece
gives one character, so an edit changes only the characters near it: cuts follow the last hit. The block size is a power
of two near a 64th of the text's length, doubled while the whole text has more than 64 pieces and halved while it has
fewer than 32 (if it then has no more than 64), so that no text falls into a last piece for want of room; signatures are
made at it and at its double, and two fingerprints are compared where they have a block size in common: likeness is 1 -
(insertions and deletions) / (both lengths) of the signatures, and 0 unless they share seven characters in a row (a third
of the shorter one, if that has fewer than 21).

Documents are paired with the next one in descending order of id by one range partitioning; each task streams its
range, and only the seams between ranges (one document each side) are finished afterwards.

Defined cases: null text is empty and has the fingerprint ``1::``; very long texts are read whole; equal fingerprints have likeness 1; null ids come
last, repeated ids follow each other by hash of the text; a single document is its own next; extra columns are
ignored; empty in, empty out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WINDOW_BYTES = 7
PIECES = 64
COMMON = 7
LONGEST = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolling(b: np.ndarray) -> np.ndarray:
    """A mixed hash of the WINDOW_BYTES bytes that end at each place (fewer at the start)."""
    x = b.astype(np.uint32) + np.uint32(1)
    h = x.copy()
    power = 1
    for j in range(1, min(WINDOW_BYTES, len(x))):
        power = power * 0x01000193 & 0xFFFFFFFF
        h[j:] += x[: len(x) - j] * np.uint32(power)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    return h


def cuts(hits: np.ndarray, size: int, most: int) -> list[int]:
    """Where the pieces of ``size`` bytes end (the place behind): behind each hit, and every ``most`` bytes without one."""
    out, at = [], 0
    for e in [*(hits + 1).tolist(), size]:
        out += range(at + most, e, most)
        if e > at:
            out.append(e)
        at = e
    return out


def signature(data: bytes, ends: list[int]) -> str:
    """A character for every piece of the whole text."""
    return "".join(ALPHABET[zlib.crc32(data[a:b]) & 63] for a, b in zip([0, *ends[:-1]], ends, strict=True))


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice the block size`` over the whole text's UTF-8 bytes."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "1::"
    h = rolling(np.frombuffer(data, np.uint8))

    def hits(block: int) -> np.ndarray:
        return np.flatnonzero((h & np.uint32(block - 1)) == block - 1)

    def ends(block: int, found: np.ndarray) -> list[int]:
        return cuts(found, len(data), LONGEST * block)

    block = 1
    while block * PIECES < len(data):
        block *= 2
    found = hits(block)
    while len(found) > PIECES or len(ends(block, found)) > PIECES:
        block *= 2
        found = found[(h[found] & np.uint32(block - 1)) == block - 1]
    pieces = ends(block, found)
    while block > 1 and len(pieces) < PIECES // 2 and len(finer := hits(block // 2)) <= PIECES and len(more := ends(block // 2, finer)) <= PIECES:
        block, found, pieces = block // 2, finer, more
    double = found[(h[found].astype(np.uint64) & np.uint64(2 * block - 1)) == 2 * block - 1]
    return f"{block}:{signature(data, pieces)}:{signature(data, ends(2 * block, double))}"


def edit_likeness(a: str, b: str) -> float:
    """1 - indel distance / (len(a) + len(b)), by the bit-parallel longest common subsequence."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1 for two fingerprints; 0 where no block size is common."""
    if one == other:
        return 1.0
    (m, a1, a2), (n, b1, b2) = one.split(":"), other.split(":")
    m, n = int(m), int(n)
    pairs = [(a1, b1), (a2, b2)] if m == n else [(a2, b1)] if 2 * m == n else [(a1, b2)] if m == 2 * n else []
    best = 0.0
    for a, b in pairs:
        n = min(COMMON, max(1, min(len(a), len(b)) // 3))
        if {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
            continue
        best = max(best, edit_likeness(a, b))
    return best


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def described(doc_id: int | None, text: str, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    print_ = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, print_, likeness(own, print_), likeness(own, next_print)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
WITH_SEAMS = RESULT.append(pa.field("part", pa.int32())).append(pa.field("first_text", pa.string())).append(pa.field("last_text", pa.string()))


def stream_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one range in order; the last is left with its text, the first's text is noted for the range before."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    rows, held, first = [], None, None
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            some = batch.slice(i, 512)
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                text = text or ""
                own = fingerprint(text)
                if held is not None:
                    rows.append((*described(*held, text, own), part, first, None))
                    first = None
                else:
                    first = text
                held = (doc_id, text, own)
                if len(rows) == 512:
                    yield as_batch(rows, WITH_SEAMS)
                    rows = []
    if held is not None:
        rows.append((held[0], None, None, None, None, None, None, part, first, held[1]))
        yield as_batch(rows, WITH_SEAMS)


def close_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, following in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield as_batch([described(doc_id, text, fingerprint(text), following, fingerprint(following))], RESULT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row per document: its fingerprint, that of the edited text, and both likenesses."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(F.col("doc_id").desc_nulls_last(), "h").sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "h", "text")
    done = stored(rows.select("doc_id", "text").mapInArrow(stream_range, OUT + ", part int, first_text string, last_text string"), "ctph")
    seams = done.where("first_text is not null or last_text is not null").groupBy("part").agg(F.max("first_text").alias("first_text"), F.max("last_text").alias("last_text"), F.max(F.when(F.col("last_text").isNotNull(), F.col("doc_id"))).alias("doc_id"))
    order = Window.orderBy("part")  # a number per range; the texts themselves meet in a join
    ring = seams.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    firsts = seams.select(F.col("part").alias("next"), F.col("first_text").alias("following"))
    last = seams.join(ring, "part").join(firsts, "next").select("doc_id", F.col("last_text").alias("text"), "following").mapInArrow(close_seams, OUT)
    return done.where("last_text is null").drop("part", "first_text", "last_text").unionByName(last)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
