"""Vectors against a block of queries as matrix products: a task hands on the rows that may be among a query's k best.

Products find the rows; those within ``MARGIN`` of the k-th best are scored again term by term, in the order in which
Spark sums, so that the scores are those of the column functions. Of equal scores the k least ids are kept, so a task
holds some k rows a query, however many vectors are copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Scores that round to the same nine digits differ by less, and so do a product and its sum in order.
MARGIN = 2e-9
#: Rows that are multiplied at once, and pairs that are scored at once.
ROWS, PAIRS = 1024, 1 << 16
#: Pairs that a task holds before it drops those that others have overtaken.
HELD = 1 << 19


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, from the first number to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total = total + a[:, j] * b[:, j]
    return total


def units(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def scores(q: np.ndarray, v: np.ndarray, cosine: bool) -> np.ndarray:
    """Cosines, 0 where a vector is all zeros, or plain inner products; not-a-number counts as the highest."""
    out = np.empty(len(q))
    for i in range(0, len(q), PAIRS):
        a, b = q[i : i + PAIRS], v[i : i + PAIRS]
        dot = summed(b, a)
        if cosine:
            norm = np.sqrt(summed(b, b) * summed(a, a))
            dot = np.divide(dot, norm, out=np.zeros(len(dot)), where=norm != 0)
        out[i : i + PAIRS] = np.where(np.isnan(dot), np.inf, dot)
    return out


def numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a column of arrays the places and the matrix of those of each length; nulls and arrays with nulls are left out."""
    sizes = pc.list_value_length(column)
    for length in pc.unique(sizes.drop_null()).to_pylist():
        at = np.flatnonzero(pc.fill_null(pc.equal(sizes, length), False).to_numpy(zero_copy_only=False))
        values = column.take(pa.array(at)).flatten()
        whole = ~values.is_null().to_numpy(zero_copy_only=False).reshape(len(at), length).any(axis=1)
        yield at[whole], values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), length)[whole]


class Held:
    """The pairs (query, id, score) of a task so far."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full((n, k), -np.inf)  # the k best products of each query
        self.pairs: list[pa.Table] = []
        self.n = 0

    def add(self, near: np.ndarray, mine: np.ndarray, q: np.ndarray, v: np.ndarray, ids: pa.Array, cosine: bool) -> None:
        """``near``: the products of the queries ``mine`` (``q``) and the rows ``v``."""
        near = np.where(np.isnan(near), np.inf, near)
        both = np.concatenate([self.least[mine], near], axis=1)
        self.least[mine] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        i, j = np.nonzero(near >= self.least[mine].min(axis=1)[:, None] - MARGIN)
        for at in range(0, len(i), HELD):
            a, b = i[at : at + HELD], j[at : at + HELD]
            scored = np.concatenate([scores(q[a[x : x + PAIRS]], v[b[x : x + PAIRS]], cosine) for x in range(0, len(a), PAIRS)])
            self.pairs.append(pa.table({"q": pa.array(mine[a]), "id": ids.take(pa.array(b)), "score": pa.array(scored)}))
            self.n += len(a)
            if self.n > HELD + 2 * self.least.size:
                self.prune()

    def prune(self) -> pa.Table:
        pairs = pa.concat_tables(self.pairs)
        pairs = pairs.take(pc.sort_indices(pairs, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        q, score = pairs.column("q").to_numpy(), pairs.column("score").to_numpy()
        at = np.arange(len(q))
        new = np.r_[True, q[1:] != q[:-1]]
        first = np.maximum.accumulate(np.where(new, at, 0))
        run = np.maximum.accumulate(np.where(new | np.r_[True, score[1:] != score[:-1]], at, 0))
        last = np.minimum(first + self.k - 1, len(q) - 1)
        kth = np.where(q[last] == q, score[last], -np.inf)
        kept = pairs.filter(pa.array((at - run < self.k) & (score >= kth - MARGIN)))
        self.pairs, self.n = [kept], len(kept)
        return kept


def contenders(rows: DataFrame, asked: DataFrame, k: int, cosine: bool, probed: dict | None = None) -> DataFrame:
    """Rows (vec_id, vector) and a block of queries (query_id, vector) to (query_id, vec_id, score) with all that may be
    among the k best of a query by score rounded to nine digits and id. Only vectors of one length meet; with ``probed``,
    of query_id to cells, rows have a cell too and meet the queries that name it."""
    spark, id_kind, kind = rows.sparkSession, rows.schema[0].dataType.simpleString(), asked.schema[0].dataType.simpleString()
    asked = asked.toArrow()  # a block
    by_length = [(at.astype(np.int64), q, units(q) if cosine else q) for at, q in numbers(asked.column(1).combine_chunks())] if len(asked) else []
    ids = asked.column(0).combine_chunks()
    of_cell: dict[int, list[int]] = {}
    for i, x in enumerate(ids.to_pylist() if probed is not None else []):
        for c in probed.get(x, ()):
            of_cell.setdefault(c, []).append(i)
    shared = spark.sparkContext.broadcast((ids, by_length, {c: np.array(x) for c, x in of_cell.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by_length, of_cell = shared.value
        held = Held(len(ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                cells = some.column(2).to_numpy() if probed is not None else None
                for at, v in numbers(some.column(1)):
                    for mine, q, unit in by_length:
                        if not len(at) or q.shape[1] != v.shape[1]:
                            continue
                        if cells is None:
                            held.add(unit @ (units(v) if cosine else v).T, mine, q, v, some.column(0).take(pa.array(at)), cosine)
                            continue
                        for c in np.unique(cells[at]):
                            own, here = np.flatnonzero(cells[at] == c), np.flatnonzero(np.isin(mine, of_cell.get(c, [])))
                            if len(here):
                                held.add(unit[here] @ v[own].T, mine[here], q[here], v[own], some.column(0).take(pa.array(at[own])), cosine)
        if held.pairs:
            kept = held.prune()
            score = kept.column("score").to_numpy()
            out = pa.table({"query_id": ids.take(kept.column("q").combine_chunks()), "vec_id": kept.column("id"), "score": pa.array(np.where(np.isinf(score), np.nan, score))})
            yield from out.to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, f"query_id {kind}, vec_id {id_kind}, score double")
