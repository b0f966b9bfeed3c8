"""Conversation structure repair by signature deduplication.

A turn's role and fault are one character of its conversation's signature: the role's initial where that is s, u or a,
else x; upper case where the text is truncated; ``-`` where the turn is blank or repeats an earlier one and has to go.
Conversations that look alike share a signature, so each distinct signature is solved once, by memoised recursion, and
its audit (the edits' initials) is joined back and replayed on the turns.

Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2; a truncated
turn that stays costs 1 more. The repaired roles' initials are ``(s?(ua)+)?``. Of the cheapest audits the least in ASCII
order counts; from any state two edits never have the same initial, so that is the least initial at every step.

Signatures are cut into blocks of at most BLOCK turns, as the turns lie in the range partitions that order them: a long
conversation is never one group. A block's costs between the four states of the pattern are a min-plus matrix. From the
last block to the first these give what is still to pay after each block, from the first to the last the state each
starts in; so the blocks' audits together are the audit of the whole. Per conversation 16 numbers a block are gathered,
never its texts. Only the digest of a whole repaired conversation, SHA-256, has to read its texts in a row; it streams.

Defined cases: null ids are one conversation, ordered by turn as others, null turns first; null roles and texts are one
space (a blank turn, an initial that is none of s, u, a); an empty role has no initial; ties of turn go by role and md5
of the text, repeated rows stay and count as duplicates; very long texts are read whole; a conversation whose rows were
all dropped has zeros, an empty audit and the digest of the empty string; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, stored, table

#: Turns of a block: 2 to this power. The recursion is two calls a turn deep.
BLOCK_BITS = 7
#: Solved cases that are broadcast, some kilobytes each.
HEAVY_CASES = 500
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a. Where a kept role leads from a state, and what user or
#: assistant turn the pattern asks for next.
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: What is still to pay after the last turn: inserted turns that complete the pattern.
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 20


def last_character(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) in order: conv (the id as text), at (rises with the order, also across tasks), turn,
    role, text, h, blank, truncated. Stored, as the places hold only for this one partitioning."""
    text = F.coalesce("text", F.lit(" "))
    last = last_character(text)
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.md5(text).alias("h"),
        (last == "").alias("blank"),
        ((last != "") & ~last.isin(".", "!", "?")).alias("truncated"),
        F.monotonically_increasing_id().alias("salt"),  # deals repeated rows over several ranges
    )
    order = ["conv", "turn", "role", "h", "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    return stored(rows.withColumn("at", F.monotonically_increasing_id()), "repair-turns")


def blocks(turns: DataFrame) -> DataFrame:
    """Per block of a conversation: its signature, first place, counts of first faults, role pairs out of order, and the
    initials at its ends."""
    slim = turns.select("conv", "at", "role", "h", "blank", "truncated")
    again = slim.groupBy("conv", "role", "h").agg(F.min("at").alias("first_at"), F.count("*").alias("n")).where("n > 1").drop("n")
    slim = slim.join(again, ["conv", "role", "h"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("at") > F.col("first_at"), F.lit(False))
    truncated = ~duplicate & F.col("truncated")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("blank") | duplicate, "-").when(truncated, F.upper(initial)).otherwise(initial)
    rows = slim.select("conv", F.shiftright("at", BLOCK_BITS).alias("block"), F.struct("at", code.alias("code"), initial.alias("role")).alias("t"), "blank", duplicate.alias("duplicate"), truncated.alias("truncated"))
    count = lambda c: F.count_if(c).alias(c)
    per = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"), count("blank"), count("duplicate"), count("truncated"))
    roles = F.array_join(F.transform("ts", lambda t: t["role"]), "")
    return per.select(
        "conv", "block", "blank", "duplicate", "truncated",
        F.col("ts")[0]["at"].alias("first_at"),
        F.array_join(F.transform("ts", lambda t: t["code"]), "").alias("signature"),
        (F.size("ts") - 1 - F.regexp_count(roles, F.lit("(?=su|ua|au)"))).cast("long").alias("illegal"),
        F.substring(roles, 1, 1).alias("opens"),
        F.right(roles, F.lit(1)).alias("closes"),
    )


class Solver:
    """The cheapest edits of one signature from any state, where ``after`` is still to pay in each state after it."""

    def __init__(self, signature: str, after: tuple[int, ...]):
        self.signature, self.after = signature, after
        self.to_go = functools.cache(self._to_go)
        self.own = functools.cache(self._own)

    def options(self, i: int, state: int) -> list[tuple[str, int, int]]:
        """(initial, cost, state after) of what can be done with turn i, by initial."""
        code = self.signature[i]
        out = [("D", DELETE, state)]
        if code != "-":
            more = TRUNCATED * code.isupper()
            if (to := KEPT.get((code.lower(), state))) is not None:
                out.append(("K", more, to))
            out.append(("R", REROLE + more, NEXT[state]))
        return out

    def _own(self, i: int, state: int) -> int:
        """To pay from turn i on, with nothing inserted before it."""
        return min(cost + self.to_go(i + 1, to) for _, cost, to in self.options(i, state))

    def _to_go(self, i: int, state: int) -> int:
        """To pay from turn i on; more than two insertions before a turn lead back to where they began."""
        if i == len(self.signature):
            return self.after[state]
        once, twice = NEXT[state], NEXT[NEXT[state]]
        return min(self.own(i, state), INSERT + self.own(i, once), 2 * INSERT + self.own(i, twice))

    def path(self, state: int) -> tuple[str, int, list[dict]]:
        """The audit from a state, the state it ends in, and per turn: what is inserted before it, edit, role after it
        (null: its own or none)."""
        audit, replay, before, i = "", [], [], 0
        while i < len(self.signature):
            best = self.to_go(i, state)
            fits = {e: to for e, cost, to in self.options(i, state) if cost + self.to_go(i + 1, to) == best}
            if "D" not in fits and INSERT + self.to_go(i, NEXT[state]) == best:
                edit, state = "I", NEXT[state]
                before.append(ROLE[state])
            else:
                edit = min(fits)
                state = fits[edit]
                replay.append({"before": before, "edit": edit, "role": ROLE[state] if edit == "R" else None})
                before, i = [], i + 1
            audit += edit
        return audit, state, replay


def columns_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


COSTS = pa.schema([("signature", pa.string()), ("n", pa.int64()), ("costs", pa.list_(pa.int32()))])
PATH = pa.struct([("audit", pa.string()), ("state", pa.int32()), ("replay", pa.list_(pa.struct([("before", pa.list_(pa.string())), ("edit", pa.string()), ("role", pa.string())])))])
SOLVED = pa.schema([("signature", pa.string()), ("after", pa.list_(pa.int32())), ("n", pa.int64()), ("paths", pa.list_(PATH))])


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, n) with costs: from state i to state j at 4 * i + j."""
    for batch in batches:
        out = []
        for signature, n in columns_of(batch):
            by_end = [Solver(signature, tuple(0 if j == k else NEVER for k in range(4))) for j in range(4)]
            out.append({"signature": signature, "n": n, "costs": [min(by_end[j].to_go(0, i), NEVER) for i in range(4) for j in range(4)]})
        yield pa.RecordBatch.from_pylist(out, COSTS)


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, after, n) with the paths from the four states."""
    for batch in batches:
        out = []
        for signature, after, n in columns_of(batch):
            solver = Solver(signature, tuple(after))
            paths = [dict(zip(("audit", "state", "replay"), solver.path(s), strict=True)) for s in range(4)]
            out.append({"signature": signature, "after": after, "n": n, "paths": paths})
        yield pa.RecordBatch.from_pylist(out, SOLVED)


def still_to_pay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, blocks with costs in order) to conv, block, after (less its least value), least (total of the conversation
    at its first block)."""
    for batch in batches:
        out = []
        for conv, chain in columns_of(batch):
            after = list(AT_END)
            for b in reversed(chain):
                low = min(after)
                row = {"conv": conv, "block": b["block"], "after": [min(x - low, NEVER) for x in after], "cost": None}
                after = [min(b["costs"][4 * i + j] + after[j] for j in range(4)) for i in range(4)]
                out.append(row)
            out[-1]["cost"] = after[0]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.int32())), ("cost", pa.int64())]))


def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, blocks with the states that they lead to, in order) to conv, block, start, end (the state at the
    conversation's end, at its last block), seam (1 if its first role may not follow the role before it)."""
    for batch in batches:
        out = []
        for conv, chain in columns_of(batch):
            state, closes = 0, ""
            for b in chain:
                out.append({"conv": conv, "block": b["block"], "start": state, "end": None, "seam": int(bool(closes) and closes + b["opens"] not in ("su", "ua", "au"))})
                state, closes = b["states"][state], b["closes"]
            out[-1]["end"] = state
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("seam", pa.int64())]))


def in_chains(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("blocks"))


def solved(parts: DataFrame) -> DataFrame:
    """``blocks`` with audit, replay, tail (roles inserted after the conversation's last turn, at its last block), seam
    and cost (at the first block)."""
    signatures = stored(parts.groupBy("signature").agg(F.count("*").alias("n")).mapInArrow(matrices, "signature string, n long, costs array<int>"), "repair-costs")
    priced = join_counted(parts.select("conv", "block", "signature"), signatures, ["signature"])
    after = in_chains(priced, "costs").mapInArrow(still_to_pay, "conv string, block long, after array<int>, cost long")
    known = stored(parts.join(after, ["conv", "block"]), "repair-after")
    replay = "array<struct<before: array<string>, edit: string, role: string>>"
    cases = stored(known.groupBy("signature", "after").agg(F.count("*").alias("n")).mapInArrow(solve, f"signature string, after array<int>, n long, paths array<struct<audit: string, state: int, replay: {replay}>>"), "repair-solved")
    whole = stored(join_counted(known, cases, ["signature", "after"], heavy=HEAVY_CASES).drop("n"), "repair-paths")
    starts = in_chains(whole.withColumn("states", F.transform("paths", lambda p: p["state"])), "states", "opens", "closes").mapInArrow(entered, "conv string, block long, start int, end int, seam long")
    out = whole.join(starts, ["conv", "block"]).withColumn("path", F.col("paths")[F.col("start")])
    tail = F.when(F.col("end") == 1, F.array(F.lit("user"), F.lit("assistant"))).when(F.col("end") == 2, F.array(F.lit("assistant"))).otherwise(F.array().cast("array<string>"))
    return out.select("conv", "block", "blank", "duplicate", "truncated", "first_at", "illegal", "seam", "cost", "path.audit", "path.replay", tail.alias("tail"))


def repaired_turns(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """The edits of ``solved`` replayed on ``placed`` turns: conv, at, nth, edit, role, text; (at, nth) is the order."""
    edits = parts.select("first_at", F.posexplode("replay")).select((F.col("first_at") + F.col("pos")).alias("at"), "col.*")
    row = lambda edit, role, text: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))
    new = lambda roles: F.transform(roles, lambda r: row(F.lit("I"), r, F.lit("")))
    own = F.when(F.col("edit") != "D", F.array(row(F.col("edit"), F.coalesce("new_role", "role"), F.col("text"))))
    both = turns.select("conv", "at", "role", "text").join(edits.withColumnRenamed("role", "new_role"), "at")
    out = both.select("conv", "at", F.posexplode(F.concat(new(F.col("before")), F.coalesce(own, F.array().cast("array<struct<edit: string, role: string, text: string>>")))).alias("nth", "turn"))
    # Behind every place of its own conversation; places of others do not matter to it.
    last = parts.where(F.size("tail") > 0).select("conv", (F.col("first_at") + F.size("replay")).alias("at"), F.posexplode(new(F.col("tail"))).alias("nth", "turn"))
    return out.unionByName(last).select("conv", "at", "nth", "turn.*")


def digests(turns: DataFrame) -> DataFrame:
    """conv, sha256 of ``role:text`` of its turns, joined by line feeds; a task streams through its conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, []
        for batch in batches:
            for c, role, text in columns_of(batch):
                if c != conv:
                    if digest:
                        out.append({"conv": conv, "sha256": digest.hexdigest()})
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if digest:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "sha256": digest.hexdigest()}])

    return turns.repartition("conv").sortWithinPartitions("conv", "at", "nth").select("conv", "role", "text").mapInArrow(run, "conv string, sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) to the report (conv: the id as text, a space for null; gaps, blank, duplicate,
    truncated, illegal, cost, audit) and the repaired turns (conv, at, nth, edit, role, text)."""
    rows = placed(turns)
    parts = stored(solved(stored(blocks(rows), "repair-blocks")), "repair-parts")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")]
    pieces = F.sort_array(F.collect_list(F.struct("block", F.concat("audit", F.repeat(F.lit("I"), F.size("tail"))).alias("audit"))))
    per = parts.groupBy("conv").agg(*sums, F.sum(F.col("illegal") + F.col("seam")).alias("illegal"), pieces.alias("pieces"))
    spread = rows.groupBy("conv", "turn").count().groupBy("conv").agg(F.max("turn").alias("last"), F.min("turn").alias("first"), F.count("turn").alias("turns"))
    wide = F.col("last").cast("decimal(20,0)") - F.col("first").cast("decimal(20,0)") + 1 - F.col("turns")
    gaps = F.least(F.coalesce(wide, F.lit(0)), F.lit(2**63 - 1)).cast("long")  # turns from end to end of the type
    report = per.join(spread, "conv").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"))
    return report, repaired_turns(rows, parts)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows by crc32 of ``conv_id:turn`` mod 20: 0 is dropped, 1 loses its text, 2 its full stops, exclamation and
    question marks, 3 is there twice, 4 gets the role user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "kind")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = repair(damaged(turns))
    ids = turns.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = ids.join(report, "conv", "left").join(digests(repaired), "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


OP11_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x // 2, 3988292384 * (x % 2)))), 4294967295) % 20 AS kind
  FROM conversations
), d AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS seq,
    right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last FROM d
), f AS (
  SELECT *, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY seq) AS p, last = '' AS blank,
    last <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY seq) > 1 AS dup FROM o
), g AS (
  SELECT *, NOT blank AND NOT dup AND last NOT IN ('.', '!', '?') AS trunc, blank OR dup AS bad FROM f
), r AS (
  SELECT conv, max(seq) AS seq, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS s0, {'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']} AS s1,
    {'c': 2, 'a': 'I', 'r': ['assistant:']} AS s2, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS s3
  FROM g GROUP BY conv
  UNION ALL
  SELECT conv, seq - 1,
    list_sort([w0, {'c': w2.c + 2, 'a': 'I' || w2.a, 'r': list_prepend('user:', w2.r)}, {'c': w3.c + 4, 'a': 'II' || w3.a, 'r': list_concat(['user:', 'assistant:'], w3.r)}])[1],
    list_sort([w1, {'c': w2.c + 2, 'a': 'I' || w2.a, 'r': list_prepend('user:', w2.r)}, {'c': w3.c + 4, 'a': 'II' || w3.a, 'r': list_concat(['user:', 'assistant:'], w3.r)}])[1],
    list_sort([w2, {'c': w3.c + 2, 'a': 'I' || w3.a, 'r': list_prepend('assistant:', w3.r)}])[1],
    list_sort([w3, {'c': w2.c + 2, 'a': 'I' || w2.a, 'r': list_prepend('user:', w2.r)}])[1]
  FROM (
    SELECT r.conv, r.seq,
      list_sort([{'c': 3 + s0.c, 'a': 'D' || s0.a, 'r': s0.r}, {'c': CASE WHEN bad OR i NOT IN ('s', 'u') THEN 9999 ELSE t END + CASE i WHEN 's' THEN s1.c ELSE s2.c END, 'a': 'K' || CASE i WHEN 's' THEN s1.a ELSE s2.a END, 'r': list_prepend(role || ':' || text, CASE i WHEN 's' THEN s1.r ELSE s2.r END)},
        {'c': CASE WHEN bad THEN 9999 ELSE 2 + t END + s2.c, 'a': 'R' || s2.a, 'r': list_prepend('user:' || text, s2.r)}])[1] AS w0,
      list_sort([{'c': 3 + s1.c, 'a': 'D' || s1.a, 'r': s1.r}, {'c': CASE WHEN bad OR i <> 'u' THEN 9999 ELSE t END + s2.c, 'a': 'K' || s2.a, 'r': list_prepend(role || ':' || text, s2.r)},
        {'c': CASE WHEN bad THEN 9999 ELSE 2 + t END + s2.c, 'a': 'R' || s2.a, 'r': list_prepend('user:' || text, s2.r)}])[1] AS w1,
      list_sort([{'c': 3 + s2.c, 'a': 'D' || s2.a, 'r': s2.r}, {'c': CASE WHEN bad OR i <> 'a' THEN 9999 ELSE t END + s3.c, 'a': 'K' || s3.a, 'r': list_prepend(role || ':' || text, s3.r)},
        {'c': CASE WHEN bad THEN 9999 ELSE 2 + t END + s3.c, 'a': 'R' || s3.a, 'r': list_prepend('assistant:' || text, s3.r)}])[1] AS w2,
      list_sort([{'c': 3 + s3.c, 'a': 'D' || s3.a, 'r': s3.r}, {'c': CASE WHEN bad OR i <> 'u' THEN 9999 ELSE t END + s2.c, 'a': 'K' || s2.a, 'r': list_prepend(role || ':' || text, s2.r)},
        {'c': CASE WHEN bad THEN 9999 ELSE 2 + t END + s2.c, 'a': 'R' || s2.a, 'r': list_prepend('user:' || text, s2.r)}])[1] AS w3
    FROM r JOIN (SELECT *, CASE WHEN trunc THEN 1 ELSE 0 END AS t FROM g) g ON g.conv = r.conv AND g.seq = r.seq
  )
), n AS (
  SELECT conv, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (trunc) AS truncated, count(*) FILTER (p IS NOT NULL AND p || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM c) LEFT JOIN n USING (conv) LEFT JOIN (SELECT conv, s0 FROM r WHERE seq = 0) USING (conv)
"""
