"""Answers kept by what was asked of which version."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Hashable

from pyspark.sql import Row
from pyspark.sql.types import StructType

Answer = tuple[list[Row], StructType]
#: The entry beyond MOST drops the oldest DROPPED. Whoever asks keeps answers of at most ROWS rows here.
MOST, DROPPED, ROWS = 100, 50, 200


class SearchCache:
    """Bounded, ordered by first use. A key names the version of the index, so an older answer cannot be found."""

    def __init__(self) -> None:
        self.kept: OrderedDict[Hashable, Answer] = OrderedDict()

    def get(self, key: Hashable) -> Answer | None:
        return self.kept.get(key)

    def put(self, key: Hashable, answer: Answer) -> None:
        self.kept[key] = answer
        if len(self.kept) > MOST:
            for _ in range(DROPPED):
                self.kept.popitem(last=False)
