"""Streaming twins: counts by window, first of a key, the rate limit that does not count refusals, the record merge, and work at intervals."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import folds


def window_counts(events: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total for each window; rows later than the watermark are left out once their window is closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", span).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_of_key(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row to arrive of each key; a key is forgotten when the watermark is past it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_limit(events: DataFrame, limit: int = 2, span: int = 3_600_000_000) -> DataFrame:
    """event_id, allowed. The state of a user is the times of at most limit allowed calls, so it does not grow.

    Calls of a micro-batch are taken by time, then id; a call older than those of an earlier batch counts as it arrives.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(parts)).sort_values(["us", "event_id"])
        allowed = []
        for us in pdf["us"].tolist():
            kept = [t for t in kept if t > us - span]
            allowed.append(len(kept) < limit)
            if allowed[-1]:
                kept.append(us)
        state.update((kept,))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "allowed": allowed})

    e = events.select("event_id", "user_id", F.unix_micros("ts").alias("us"))
    return e.groupBy("user_id").applyInPandasWithState(fold, "event_id long, allowed boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def merge(changes: DataFrame) -> DataFrame:
    """user_id, kind, key, seq, status, copy, data: the record merge on a stream. A key's state is its one record, kept for good.

    Changes of a micro-batch are taken by seq; one that arrives later than a later seq counts as it arrives.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = None, 0
        if state.exists:
            data, deleted, updated, moved, device, last = state.get
            held = folds.Record(None if data is None else json.loads(data), deleted, updated, moved, device)
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            before = held
            held, status, lost = folds.merge_change(key[1], held, last, folds.change_of(r), None if pd.isna(r.seen) else int(r.seen))
            if held is not before:
                last = int(r.seq)
            out.append((*key, int(r.seq), status, folds._text(lost), folds._text(held.data)))
        state.update((folds._text(held.data), held.deleted, held.updated, held.moved, held.device, last))
        yield pd.DataFrame(out, columns=["user_id", "kind", "key", "seq", "status", "copy", "data"])

    schema = "user_id long, kind string, key string, seq long, status string, copy string, data string"
    return changes.groupBy(*folds.KEYS).applyInPandasWithState(fold, schema, "data string, deleted boolean, updated long, moved long, device string, last long", "append", GroupStateTimeout.NoTimeout)


def at_intervals(rows: DataFrame, work: Callable[[DataFrame, int], None], every: str | None, checkpoint: str) -> StreamingQuery:
    """Runs work(batch, number) on what came in since the last time, every so often, or once if every is None.

    A batch that fails is given again with its number, so work must be repeatable.
    """
    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
