"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (A-Z lower-cased; a shorter text is one shingle). A shingle weighs its
count in the text times the mean inverse document frequency of its words. Word frequencies are counted over all
documents; by definition of the weight, words in less than FLOOR of them have the same, highest value, which bounds
the table that tasks get. (Weights from the shingles' own frequencies would fall with the size of a group of copies
while a lone edit kept the highest weight, so that near copies in large groups would end below the threshold.)

Consistent weighted samples are cut into bands; texts that agree in a band are candidates. No bucket is paired off in
full:

1. Over the texts that have a candidate, shingles are ordered by rarity. Two texts at the threshold must have a shingle
   in common within the first 1 - THRESHOLD of their weight in that order (prefix filter). A text whose prefix holds
   nothing that another text has is alike to none and leaves its buckets.
2. In each bucket the text with the most widely held shingles becomes the hub, and the others are compared with it: one
   comparison a member, and in a group of copies nearly all are alike to the hub.
3. Texts that share a bucket but are still in different components are joined on the shingles of their prefixes, with
   the sizes and the weights left after the shared shingle as further bounds. All that could be alike passes, so no
   link between components is lost, while texts with edits of their own meet nobody.

Weighted Jaccard similarity of the whole texts decides, from THRESHOLD up; groups are the connected components.

Equal texts are one class from the start and are compared once.

Defined cases: null counts as empty; all texts without words but with the same characters form a class; very long
texts are sampled and compared whole; null ids are never a group's id unless all its ids are null; repeated rows share
class and group; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, shared_dir, stored, table

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold is a candidate with probability 1 - (1 - 0.8 ** 3) ** 10 = 0.9992.
BANDS, ROWS = 10, 3
SEED = 7
#: Words in a smaller share of the documents are not told apart by frequency.
FLOOR = 1e-3
#: Word hashes that a worker keeps.
CACHE_WORDS = 500_000
#: Texts whose total weights lie within this factor of each other (as a logarithm) share a size class.
SIZE_STEP = 0.05
#: Allowance for weights kept as 32-bit numbers, as a share of a text's weight.
ROUNDING = 1e-5

_word = re.compile(WORD)


def words_of(text: str) -> list[str]:
    if text.isascii():
        return _word.findall(text.lower())
    # A-Z only; bytes.lower() is that, as all other letters are beyond ASCII in UTF-8
    return _word.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def word_frequencies(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequencies, over all documents, of the words in at least FLOOR of them; under the key ''
    that of any other word. At most (mean distinct words a document) / FLOOR entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                for text in batch.column(0).slice(i, 1024).to_pylist():
                    seen.update(set(words_of(text or "")))
                if len(seen) > CACHE_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})

    total = docs.count()
    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FLOOR * total)
    out = {r["word"]: 1 + float(np.log((total + 1) / (r["n"] + 1))) for r in counted.collect()}
    out[""] = 1 + float(np.log((total + 1) / (FLOOR * total + 1)))
    return out


class Shingler:
    """Shingle hashes and weights of texts; keeps hash and frequency of the words it has met."""

    _last: Shingler | None = None

    def __init__(self, idf: dict[str, float]):
        self.idf, self.rare = idf, idf[""]
        self.clear()

    @classmethod
    def of_worker(cls, idf: dict[str, float]) -> Shingler:
        """The worker's own, so that words met in one task are known in the next."""
        if cls._last is None or cls._last.idf is not idf:
            cls._last = cls(idf)
        return cls._last

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.hashes, self.values = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its distinct shingle hashes, sorted, and their weights."""
        if len(self.at) > CACHE_WORDS:
            self.clear()
        at, places = self.at, []
        for text in texts:
            ws = words_of(text)
            for w in ws:
                if w not in at:
                    n = at[w] = len(at)
                    if n == len(self.hashes):
                        self.hashes, self.values = np.resize(self.hashes, 2 * n), np.resize(self.values, 2 * n)
                    self.hashes[n], self.values[n] = xxhash.xxh64_intdigest(w, SEED), self.idf.get(w, self.rare)
            places.append(np.fromiter(map(at.__getitem__, ws), np.int64, len(ws)))
        return [self.of(p) for p in places]

    def of(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(p):
            return np.empty(0, np.uint64), np.empty(0)
        h, v = self.hashes[p], self.values[p]
        k = min(SHINGLE_WORDS, len(p))
        n = len(p) - k + 1
        s, w = np.zeros(n, np.uint64), np.zeros(n)
        for j in range(k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
            s ^= s >> np.uint64(29)
            w += v[j : j + n]
        s, first, times = np.unique(s, return_index=True, return_counts=True)
        return s, times * w[first] / k


def _gamma_table(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at (i + 0.5) / n, by bisection of 1 - (1 + x) exp(-x)."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        over = 1 - (1 + mid) * np.exp(-mid) > p
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    return low


GAMMA_R = _gamma_table(1 << 12).astype(np.float32)
INVERSE_R = (1 / GAMMA_R).astype(np.float32)
LOG_GAMMA_C = np.log(_gamma_table(1 << 16)).astype(np.float32)


def samples(shingles: list[tuple[np.ndarray, np.ndarray]], n_samples: int) -> np.ndarray:
    """Consistent weighted samples of several non-empty weighted sets: one row of 32-bit tags per set.

    For each element of weight S and each sample: r, c ~ Gamma(2, 1) and b ~ U(0, 1) depend on the element alone;
    t = floor(ln S / r + b); the element with the least ln c - r (t - b + 1) is drawn, and (element, t) is the tag.
    """
    x = np.concatenate([s for s, _ in shingles])
    log_s = np.log(np.concatenate([w for _, w in shingles])).astype(np.float32)
    starts = np.cumsum([0, *[len(s) for s, _ in shingles[:-1]]])
    out = np.empty((len(shingles), n_samples), np.uint32)
    for k in range(n_samples):
        h = x ^ np.uint64((k + 1) * 0xD1342543DE82EF95 % 2**64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        at = (h & np.uint64(0xFFF)).view(np.int64)
        b = ((h >> np.uint64(12)).astype(np.uint32) >> np.uint32(12)).astype(np.float32)
        b *= np.float32(2.0**-20)
        t = INVERSE_R.take(at)
        t *= log_s
        t += b
        np.floor(t, out=t)
        a = t - b
        a += np.float32(1)
        a *= GAMMA_R.take(at)
        np.subtract(LOG_GAMMA_C.take((h >> np.uint64(48)).view(np.int64)), a, out=a)
        # the least a, as its bits in the order of signed integers, with the tag below them
        bits = a.view(np.int32)
        key = (bits ^ ((bits >> np.int32(31)) & np.int32(0x7FFFFFFF))).astype(np.int64)
        key <<= 32
        key |= (h >> np.uint64(16)).astype(np.uint32) * np.uint32(31) + t.astype(np.int32).view(np.uint32)
        out[:, k] = np.minimum.reduceat(key, starts).astype(np.uint32)
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def class_of(text):  # noqa: ANN001, ANN201
    return F.xxhash64(F.coalesce(text, F.lit("")))


def band_keys(texts: DataFrame, idf) -> DataFrame:  # noqa: ANN001
    """(class, text) to class, bucket (band and key as one hash); a text that a task has just had is not sampled again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, had = Shingler.of_worker(idf.value), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                new = {c: t for c, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) if c not in had and t}
                had |= new.keys()
                if len(had) > CACHE_WORDS:
                    had = set()
                sets = [(c, s) for c, s in zip(new, shingler(list(new.values())), strict=True) if len(s[0])]
                if not sets:
                    continue
                tags = samples([s for _, s in sets], BANDS * ROWS).reshape(len(sets), BANDS, ROWS).astype(np.uint64)
                key = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(sets), 1))
                for r in range(ROWS):
                    key = (key ^ tags[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([c for c, _ in sets], np.int64), BANDS)), pa.array(key.view(np.int64).ravel())], names=["class", "bucket"])

    return texts.mapInArrow(run, "class long, bucket long")


def shingle_rows(texts: DataFrame, idf) -> DataFrame:  # noqa: ANN001
    """(class, text) to class, shingle, weight, total (the weight of the whole text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler.of_worker(idf.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                sets = shingler(some.column(1).to_pylist())
                sizes = [len(s) for s, _ in sets]
                if not sum(sizes):
                    continue
                classes, totals = np.repeat(some.column(0).to_numpy(), sizes), np.repeat(np.array([w.sum() for _, w in sets], np.float32), sizes)
                shingles, weights = np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(shingles.view(np.int64)), pa.array(weights), pa.array(totals)], names=["class", "shingle", "weight", "total"])

    return texts.mapInArrow(run, "class long, shingle long, weight float, total float")


def prefixes(rows: DataFrame) -> DataFrame:
    """Of each text the shingles that others have too and that lie in its prefix: class, shingle, before (the weight of
    all rarer shingles of the text), total, spread (mean number of other texts that have its shingles)."""
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    whole = Window.partitionBy("class")
    held = rows.join(counts, "shingle").withColumn("weight", F.col("weight").cast("double"))
    held = held.withColumn("shared", F.sum("weight").over(whole)).withColumn("spread", F.sum(F.col("weight") * (F.col("n") - 1)).over(whole) / F.col("total"))
    held = held.withColumn("before", F.col("total") - F.col("shared") + F.sum("weight").over(whole.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"))
    return held.where(F.col("before") <= (1 - THRESHOLD + ROUNDING) * F.col("total")).select("class", "shingle", F.col("before").cast("float").alias("before"), "total", "spread")


def size_class(total: Column) -> Column:
    return F.floor(F.log(total) / SIZE_STEP).cast("int")


def across_components(members: DataFrame, prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): the texts that share a bucket with one of another component, where the prefixes let them be alike.

    In each bucket the largest component is the main one, and every pair of components has a text outside it; so only
    texts outside some main component (open ones) look for partners. A text of weight W whose shared shingle has p before it can reach
    the threshold only with a partner of weight from t W to (1 + t) / t (W - p) - W, and W / t at most; these bounds go
    into the join as size classes, so copies of one size do not meet where p is already too much."""
    labelled = members.join(labels, "class", "left").select("bucket", "class", F.coalesce("label", "class").alias("label"))
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("n_labels")).where("n_labels > 1")
    sides = labelled.join(mains.select("bucket", "main"), "bucket").groupBy("class", "label").agg(F.max(F.col("label") != F.col("main")).alias("open"))
    entries = stored(prefix.select("class", "shingle", "before", "total").join(sides, "class"), "near-entries")
    slack = 1 + 4 * ROUNDING
    most = F.least(F.col("total") / THRESHOLD, (F.col("total") - F.col("before")) * ((1 + THRESHOLD) / THRESHOLD) - F.col("total")) * slack
    least = F.col("total") * THRESHOLD / slack
    seeking = entries.where("open").where(most >= least).withColumn("size", F.explode(F.sequence(size_class(least), size_class(most))))
    seeking = seeking.select("shingle", "size", F.col("class").alias("a"), F.col("label").alias("label_a"), F.col("before").alias("before_a"), F.col("total").alias("total_a"))
    sought = entries.select("shingle", size_class(F.col("total")).alias("size"), F.col("class").alias("b"), F.col("label").alias("label_b"), F.col("before").alias("before_b"), F.col("total").alias("total_b"), F.col("open").alias("open_b"))
    left = F.least(F.col("total_a") - F.col("before_a"), F.col("total_b") - F.col("before_b"))
    may = (F.col("label_a") != F.col("label_b")) & (~F.col("open_b") | (F.col("a") < F.col("b"))) & (left * slack >= THRESHOLD / (1 + THRESHOLD) * (F.col("total_a") + F.col("total_b")))
    return seeking.join(sought, ["shingle", "size"]).where(may).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:  # noqa: ANN001
    """(a, b) to the pairs that are alike. Texts of candidates only are shuffled; joins that a hub makes uneven are
    plain joins on its class, which Spark splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler.of_worker(idf.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                a, b, ta, tb = (c.to_pylist() for c in batch.slice(i, 64).columns)
                both = list(dict.fromkeys(ta + tb))
                sets = dict(zip(both, shingler(both), strict=True))
                alike = [weighted_jaccard(sets[x], sets[y]) for x, y in zip(ta, tb, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike, pa.float64())], names=["a", "b", "similarity"])

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= THRESHOLD)


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (class, label): the least class of each connected component.

    First each class hands its lesser neighbours to the least of them and keeps that one link: members of a group share
    their hubs, so about one link a class is left, which no later join multiplies. Then labels spread to neighbours and
    are replaced by their labels' labels, so a chain of length n takes about log n rounds."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    handed = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
    kept = handed.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    kept = stored(kept.distinct(), "near-kept")
    edges = stored(kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v"))), "near-edges")
    labels = stored(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "class"), "near-labels")
    while True:
        low = edges.join(labels.select(F.col("class").alias("v"), "label"), "v").groupBy(F.col("u").alias("class")).agg(F.min("label").alias("low"))
        least = labels.join(low, "class").select("class", F.col("label").alias("old"), F.least("label", "low").alias("next"))
        above = labels.select(F.col("class").alias("next"), F.col("label").alias("above"))
        new = stored(least.join(above, "next", "left").select("class", F.least("next", "above").alias("label"), "old"), "near-labels")
        labels = new.select("class", "label")
        if new.where("label != old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least id with the same text), group_id (least id of the group),
    n_verified (texts it was compared with and found alike; not all of its group), class (hash of the text),
    kept_class (the one class that stands for the group: that of its least id, nulls last, and of classes with the
    same id the least)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    idf = spark.sparkContext.broadcast(word_frequencies(docs))
    texts = docs.select(class_of(F.col("text")).alias("class"), "text")
    keys = stored(band_keys(texts, idf).distinct(), "near-keys")
    full = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stored(keys.join(full, "bucket"), "near-members")
    # one text a class (each task hands on one row of a text, however often it occurs), of those with a candidate
    texts = stored(texts.groupBy("class").agg(F.first("text").alias("text")).join(members.select("class").distinct(), "class", "left_semi"), "near-texts")
    prefix = stored(prefixes(stored(shingle_rows(texts, idf), "near-shingles")), "near-prefixes")

    members = stored(members.join(prefix.groupBy("class").agg(F.max("spread").alias("spread")), "class"), "near-members")
    hubs = members.groupBy("bucket").agg(F.max(F.struct("spread", "class"))["class"].alias("hub"))
    pairs = members.join(hubs, "bucket").where("class != hub").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    links = stored(verified(pairs, texts, idf), "near-links")
    labels = components(links)
    rest = stored(across_components(members, prefix, labels), "near-rest")
    more = stored(verified(rest, texts, idf), "near-links")
    if not more.isEmpty():
        links = stored(links.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")
        labels = components(links)
    degrees = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_verified"))
    classes = stored(docs.select("doc_id", class_of(F.col("text")).alias("class")), "near-classes")
    least = classes.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    least = stored(least.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")).join(degrees, "class", "left"), "near-least")
    groups = stored(least.groupBy("label").agg(F.min("class_id").alias("group_id"), F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "class"))["class"].alias("kept_class")), "near-groups")
    known = stored(least.join(groups, "label").select("class", "class_id", "group_id", F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"), "kept_class"), "near-known")
    return classes.join(known, "class").select("doc_id", "class_id", "group_id", "n_verified", "class", "kept_class")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).drop("class", "kept_class")
