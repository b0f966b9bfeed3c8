"""Phrase collocation mining by Apriori level-wise passes.

Pass k counts phrases of k words per language. From pass 2 on a phrase is counted only where both phrases of k - 1 words
that overlap in it are frequent (LEAST occurrences or more): the frequent phrases of the level before are broadcast as
a table of FILTER_BITS bits, so the broadcast has one size whatever the corpus. A bit that another phrase has set lets a
phrase be counted in vain; it then has too few occurrences and goes like any rare one, so levels are exact. In a
task phrases are counted by numbers of its own words; what is shuffled are its distinct phrases as text with their
counts, so no identity rests on a hash.

Cuts are scored from the level tables: a phrase, its first and its last words meet by joins on (language, phrase); sums
and products are decimals of 38 digits. The best of each language are found first within hash buckets, then among these.

Defined cases: a null or empty text has no words; a null language is ``und``, together with documents that say so;
very long texts are read whole, in slices that end between pieces; repeated rows count each time; ties go by occurrences,
then by the phrase's bytes; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

LEAST = 30
MAX_WORDS = 4
#: A phrase is part of a longer one if that has at least so many hundredths of its occurrences.
PART_OF = 80
BEST = 2000
#: Hash buckets of a language's phrases, each cut to BEST before the last ordering.
BUCKETS = 64
FILTER_BITS = 1 << 27
#: A task counts so many words at a time; longer texts are sliced between pieces.
CHUNK_WORDS = 400_000
SLICE_BYTES = 4_000_000
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: One pass over a text's bytes: capitals to small letters, every separator to a line feed, tabs to spaces.
PLAIN = bytes.maketrans(UPPER + SEPARATORS + b"\t", LOWER + b"\n" * len(SEPARATORS) + b" ")


def slices(text: bytes) -> Iterator[bytes]:
    """A plain text in parts of about SLICE_BYTES, cut only at separators."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        end = text.find(b"\n", at + SLICE_BYTES)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:] if at else text


class Words:
    """Texts as numbers of their languages' words: ``numbers`` in order, -1 between pieces; of each number its ``word`` (an
    Arrow array) and the number of its language in ``langs``. Numbers hold within this object only, and are exact."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = pa.array(list(texts), pa.string())
        numbers, words, of_lang, n = [], [], [], 0
        for i, own in enumerate(texts.values()):
            flat = pc.split_pattern(pa.array([t.replace(b"\n", b" \n ") + b" \n" for t in own], pa.binary()), " ").flatten()
            coded = pc.dictionary_encode(flat)
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            at, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            place = {w: pc.index(distinct, pa.scalar(w, pa.binary())).as_py() for w in (b"", b"\n")}
            to = np.arange(n, n + len(distinct))
            to[place[b"\n"]] = -1
            numbers.append(to[at[at != place[b""]]] if place[b""] >= 0 else to[at])
            words.append(distinct)
            of_lang.append(np.full(len(distinct), i))
            n += len(distinct)
        self.numbers, self.words, self.of_lang = np.concatenate(numbers), pa.concat_arrays(words), np.concatenate(of_lang)

    def hashes(self) -> np.ndarray:
        seeds = [lang_seed(x) for x in self.langs.to_pylist()]
        return np.array([*[xxhash.xxh64_intdigest(w, seeds[i]) for w, i in zip(self.words.to_pylist(), self.of_lang.tolist(), strict=True)], 0], np.uint64)  # the last is that of separators


def lang_seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """(lang, text as bytes) to the words of some texts at a time."""
    waiting: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                for piece in slices((text or b"").translate(PLAIN)):
                    waiting.setdefault(lang, []).append(piece)
                    size += piece.count(b" ") + 1
                    if size >= CHUNK_WORDS:
                        yield Words(waiting)
                        waiting, size = {}, 0
    if waiting:
        yield Words(waiting)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def following(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return mixed(mixed(hashes) + more)


def phrase_hash(lang: str, phrase: str) -> int:
    words = np.array([[xxhash.xxh64_intdigest(w.encode(), lang_seed(lang))] for w in phrase.split(" ")], np.uint64)
    h = words[0]
    for w in words[1:]:
        h = following(h, w)
    return int(h[0])


def bits_of(frequent: DataFrame, n_bits: int) -> np.ndarray:
    """So many bits, set at the hashes of the frequent phrases; built from words of 64 bits that tasks have merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([phrase_hash(lang, phrase) & (n_bits - 1) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["at", "bit"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def counted(words: Words, k: int, bits: np.ndarray | None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The numbers of their languages, the phrases of k words and their counts; both overlapping phrases of k - 1 words pass
    the bits."""
    numbers = words.numbers
    n = max(0, len(numbers) - k + 1)
    fits = numbers[:n] >= 0
    for j in range(1, k):
        fits &= numbers[j : n + j] >= 0
    if bits is not None and n:
        h = words.hashes()[numbers]
        shorter = h[: n + 1]
        for j in range(1, k - 1):
            shorter = following(shorter, h[j : n + 1 + j])
        frequent = passing(bits, shorter)
        fits &= frequent[:n] & frequent[1 : n + 1]
    places, base = np.flatnonzero(fits), max(1, len(words.words))
    # One number a phrase, of its first words' number (dense after each step) and the next word's.
    key, steps = numbers[places], []
    for j in range(1, k):
        if j > 1:
            distinct, key = np.unique(key, return_inverse=True)
            steps.append(distinct)
        key = key * base + numbers[places + j]
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times, key = np.diff(first, append=len(key)), key[first]
    parts: list[np.ndarray] = []
    for j in range(k - 1, 0, -1):
        key, last = np.divmod(key, base)
        parts.insert(0, last)
        if j > 1:
            key = steps.pop()[key]
    parts.insert(0, key)
    phrases = [words.words.take(pa.array(x)) for x in parts]
    return words.of_lang[parts[0]], phrases[0] if k == 1 else pc.binary_join_element_wise(*phrases, b" "), times


def level(docs: DataFrame, k: int, before: DataFrame | None) -> DataFrame:
    """(lang, text) to lang, phrase, f: occurrences of phrases of k words of which ``before`` lets hope."""
    shared = None if before is None else docs.sparkSession.sparkContext.broadcast(bits_of(before, FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in chunks(batches):
            langs, phrases, times = counted(words, k, None if shared is None else shared.value)
            for i in range(0, len(times), 100_000):
                some = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(langs[some])), phrases[some].cast(pa.string()), pa.array(times[some])], names=["lang", "phrase", "f"])

    rows = docs.select("lang", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def levels(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, text) to frequent phrases (lang, phrase, k, f) of 1 to max_words words, and (lang, n) of all words."""
    words = stored(level(docs, 1, None), "phrases-1")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    before = words.where(F.col("f") >= least)
    out = before.withColumn("k", F.lit(1))
    for k in range(2, max_words + 1):
        before = stored(level(docs, k, before).where(F.col("f") >= least), f"phrases-{k}")
        out = out.unionByName(before.withColumn("k", F.lit(k)))
    return out, totals


def scored(frequent: DataFrame) -> DataFrame:
    """Frequent phrases to their lowest cut: lang, phrase, k, a, l, r, score."""
    phrases = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda part: F.array_join(part, " ")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", join(F.slice("w", F.lit(1), F.col("cut"))).alias("first"), join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("rest"))
    of = lambda part, name: frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("bigint(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))))")
    return both.withColumn("score", score).groupBy("lang", "phrase", "k").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("c")).select("lang", "phrase", "k", "c.a", "c.l", "c.r", "c.score")


def inside_longer(frequent: DataFrame) -> DataFrame:
    """lang, phrase, longer: the most occurrences of a frequent phrase with one word more before or after. A still longer
    one has no more, so it need not be asked."""
    parts = F.array(F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("k") - 1), " "))
    rows = frequent.where("k > 2").select("lang", "k", "f", F.split("phrase", " ").alias("w")).select("lang", F.explode(parts).alias("phrase"), "f")
    return rows.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """(lang, text) to lang, rank, phrase, a, l, r, n, score: each language's best phrases that no longer one explains."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    frequent, totals = levels(docs, least)
    frequent = stored(frequent, "phrases")
    rows = scored(frequent).join(inside_longer(frequent), ["lang", "phrase"], "left")
    part = F.coalesce(F.expr(f"100 * cast(longer as decimal(20,0)) >= {PART_OF} * cast(a as decimal(20,0))"), F.lit(False))
    rows = rows.where(~part).select("lang", "phrase", "a", "l", "r", "score", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).alias("bucket"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= best)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), o AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), c AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang
), q AS (
  SELECT * FROM c WHERE f >= 30
), x AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM q WHERE k > 1
), s AS (
  SELECT x.lang, x.phrase, x.k, a, cut, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM x JOIN q l ON l.lang = x.lang AND l.phrase = array_to_string(list_slice(w, 1, cut), ' ')
    JOIN q r ON r.lang = x.lang AND r.phrase = array_to_string(list_slice(w, cut + 1, x.k), ' ')
), m AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), g AS (
  SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.lang = m.lang AND q.k > m.k AND contains(' ' || q.phrase || ' ', ' ' || m.phrase || ' ') AND 100 * CAST(q.f AS HUGEINT) >= 80 * CAST(m.a AS HUGEINT))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM g JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
