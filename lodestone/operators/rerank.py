"""Second look at fused candidates by a scorer of (question, text) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[[list[str], list[str]], list[float]]


def no_model(questions: list[str], texts: list[str]) -> list[float]:
    """Without a model all candidates score 0 and keep their order."""
    return [0.0] * len(texts)


def reranked(candidates: DataFrame, scorer: Scorer = no_model) -> DataFrame:
    """(question, id, text, rank) with the new ``rank`` and ``score`` (sigmoid of the scorer's), per question; a few
    dozen rows a question."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(raw=[float(x) for x in scorer(list(b["question"]), list(b["text"]))])

    kind = candidates.schema["id"].dataType.simpleString()
    scored = candidates.select("question", "id", "text", F.col("rank").cast("int").alias("was")).mapInPandas(run, f"question string, id {kind}, was int, raw double")
    order = Window.partitionBy("question").orderBy(F.col("raw").desc(), "was")
    return scored.select("question", "id", F.row_number().over(order).alias("rank"), F.round(1 / (1 + F.exp(-F.col("raw"))), 6).alias("score"))
