"""Vectors for texts: a cache by model and content hash, embedding in batches of which a bad text spoils nothing but
itself, and an embedder that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import embed_input, identifier_tokens

DIMENSIONS = 64
#: Texts whose tokens a task has as Python strings at once, each distinct one once.
HASHED_ROWS = 256


@dataclass(frozen=True)
class Embedder:
    """A model by name: texts to vectors of one length. A batch that fails is halved down to single texts, and a single
    text is tried ``attempts`` times."""

    model: str
    of: Callable[[list[str]], list[list[float]]]
    batch: int = 64
    attempts: int = 2


def content_hash(text):  # noqa: ANN001, ANN201
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct (hash, text) that the cache has no vector of this model for."""
    wanted = texts.select(content_hash(F.col("text")).alias("hash"), "text").dropDuplicates(["hash"])
    return wanted.join(cache.where(F.col("model") == model).select("hash"), "hash", "left_anti")


def hashed_vectors(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(hash, text) to (hash, embedding): signed feature hashing of the tokens, unit length; deterministic, makes no
    claim to meaning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, HASHED_ROWS):
                some = batch.slice(start, HASHED_ROWS)
                n, tokens = some.num_rows, some.column(1)
                words = tokens.flatten().dictionary_encode()
                h = np.array([zlib.crc32(t.encode()) for t in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
                row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
                out = np.bincount(row * dimensions + h % dimensions, np.where(h >> 16 & 1, 1, -1), n * dimensions).astype(np.float32).reshape(n, dimensions)
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                vectors = pa.array((out / np.where(norm > 0, norm, 1)).ravel())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dimensions, vectors)], names=["hash", "embedding"])

    return texts.select("hash", identifier_tokens(embed_input(F.col("text"))).alias("tokens")).mapInArrow(run, "hash string, embedding array<float>")


def bisected(embedder: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """(vector, None) or (None, error) of each text: a failing batch is halved until the texts that fail stand alone."""
    try:
        vectors = [list(map(float, v)) for v in embedder.of(texts)]
        if len(vectors) != len(texts) or len({len(v) for v in vectors}) > 1:
            raise ValueError(f"{len(vectors)} vectors of lengths {sorted({len(v) for v in vectors})} for {len(texts)} texts")
        return [(v, None) for v in vectors]
    except Exception as e:
        if len(texts) > 1:
            half = len(texts) // 2
            return bisected(embedder, texts[:half]) + bisected(embedder, texts[half:])
        if embedder.attempts > 1:
            return bisected(Embedder(embedder.model, embedder.of, embedder.batch, embedder.attempts - 1), texts)
        return [(None, f"{type(e).__name__}: {e}")]


def embed_new(misses: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(hash, text) to (hash, embedding, error), one of them null; without an embedder by hashed tokens."""
    if embedder is None:
        return hashed_vectors(misses).withColumn("error", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), embedder.batch):
                some = b.iloc[i : i + embedder.batch]
                done = bisected(embedder, list(some["text"]))
                yield pd.DataFrame({"hash": some["hash"].to_numpy(), "embedding": [v for v, _ in done], "error": [e for _, e in done]})

    return misses.select("hash", embed_input(F.col("text")).alias("text")).mapInPandas(run, "hash string, embedding array<float>, error string")


def embedded(texts: DataFrame, cache: DataFrame, model: str = "hash64", embedder: Embedder | None = None) -> DataFrame:
    """(hash, model, embedding) for all texts: cached vectors, and new ones for the rest; texts that fail are left out."""
    new = embed_new(cache_misses(texts, cache, model), embedder).where("embedding is not null").select("hash", F.lit(model).alias("model"), "embedding")
    hashes = texts.select(content_hash(F.col("text")).alias("hash")).distinct()
    return cache.where(F.col("model") == model).join(hashes, "hash", "left_semi").select("hash", "model", "embedding").unionByName(new)
