"""Answers to prompts by any model that takes a list of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generator = Callable[[list[str]], list[str]]


def generated(prompts: DataFrame, generator: Generator, batch: int = 16) -> DataFrame:
    """(query_id, prompt) to (query_id, answer, error), one of them null. A batch that fails is tried prompt by prompt, so
    that one bad prompt spoils no other's answer."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return generator([prompt])[0], None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def some(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            found = generator(texts)
            if len(found) == len(texts):
                return [(x, None) for x in found]
        except Exception:  # found out prompt by prompt
            pass
        return [one(x) for x in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [x for i in range(0, len(b), batch) for x in some(list(b["prompt"].iloc[i : i + batch]))]
            yield pd.DataFrame({"query_id": b["query_id"], "answer": [a for a, _ in done], "error": [e for _, e in done]})

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string, error string")


def without_hits(missing: list[str]) -> str:
    """What is said where a search finds nothing."""
    if missing:
        return f"No file of the repository is named {', '.join(missing)}; it may lie elsewhere or have been left out of the index."
    return "The repository has no passage that answers this; another wording may find one."
