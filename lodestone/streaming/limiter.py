"""A sliding-window request limiter, in batch and over a stream. Rejected requests are not recorded, so a request's
fate depends on those accepted before it: a fold, not a window frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "client long, event_id long, at double, accepted boolean"


def decided(requests: list[tuple[int, float]], kept: list[float], limit: int, seconds: float) -> list[bool]:
    """Which of the (id, time) are accepted; ``kept`` holds the accepted times and is updated."""
    out = []
    for _, at in requests:
        while kept and at - kept[0] > seconds:
            kept.pop(0)
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(at)
    return out


def limited(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(client, event_id, at) to accepted or not, by (at, event_id). One shuffle by client; rows stream through a task
    in order and only the accepted times of the window in hand are held, so a busy client needs no room."""
    rows = requests.select("client", "event_id", "at").repartition("client").sortWithinPartitions("client", "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, kept = None, []
        for b in batches:
            out = []
            for c, e, at in zip(b["client"], b["event_id"], b["at"], strict=True):
                if c != client:
                    client, kept = c, []
                out += decided([(e, at)], kept, limit, seconds)
            yield b.assign(accepted=out)

    return rows.mapInPandas(run, OUT)


def limited_stream(requests: DataFrame, limit: int, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """The same over a stream, whose requests may arrive out of order by up to ``delay``.

    A request waits in its client's state until the watermark has passed it and is decided then, in order of time across
    micro-batches; so the result is that of the batch form. State is a client's waiting requests and the accepted times
    of its last window; a timer on event time ends it when both are over."""
    rows = requests.select("client", "event_id", "at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts")).withWatermark("ts", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, ids, ats = map(list, state.get) if state.exists else ([], [], [])
        for b in batches:
            ids += b["event_id"].tolist()
            ats += b["at"].tolist()
        now = state.getCurrentWatermarkMs() / 1000
        waiting = sorted(zip(ats, ids, strict=True))
        due = [(e, at) for at, e in waiting if at <= now]
        accepted = decided(due, kept, limit, seconds)
        waiting = waiting[len(due) :]
        kept = [at for at in kept if now - at <= seconds]
        if waiting or kept:
            state.update((kept, [e for _, e in waiting], [at for at, _ in waiting]))
            state.setTimeoutTimestamp(int(max(now, min([at for at, _ in waiting[:1]] + [at + seconds for at in kept[-1:]])) * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"client": [key[0]] * len(due), "event_id": [e for e, _ in due], "at": [at for _, at in due], "accepted": accepted}).astype({"client": "int64", "event_id": "int64", "at": "float64", "accepted": bool})

    return rows.groupBy("client").applyInPandasWithState(step, OUT, "kept array<double>, ids array<long>, ats array<double>", "append", GroupStateTimeout.EventTimeTimeout)
