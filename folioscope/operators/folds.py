"""Folds that depend on the order of arrival: record merge, rate limit with unrecorded refusals, longest rising chain."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import deque
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Kinds that have an order field beside their content, and the kind whose lost texts are kept.
ORDER_FIELDS = {"note": "sortIndex", "noteFolder": "sortIndex", "session": "sortIndex", "sessionBook": "position"}
NOTE = "note"
KEYS = ["user_id", "kind", "key"]
OUT = "user_id long, kind string, key string, seq long, status string, copy string, data string, deleted boolean, updated_us long, moved_us long, device string"


class Record(NamedTuple):
    data: dict | None
    deleted: bool
    updated: int | None
    moved: int | None
    device: str


#: Registers of a record and the clock of each: what it says, and where it stands among its like.
CLOCKS = {"content": "updated", "place": "moved"}
READ_BY_USERS = ("title", "bodyText")


def winners(old: Record, new: Record, registers: list[str]) -> dict[str, Record]:
    """The last writer of each register: by its clock, then by device. A write without a time wins nothing."""

    def stamp(r: Record, register: str) -> tuple:
        time = getattr(r, CLOCKS[register])
        return (time is not None, time or 0, r.device if time is not None else "")

    return {x: max((old, new), key=lambda r: stamp(r, x)) for x in registers}


def composed(last: dict[str, Record], old: Record, new: Record, field: str | None) -> Record:
    """One record of the registers' winners: the place's field goes over the content's, or takes it away if a new place has none."""
    content, place = last["content"], last.get("place", last["content"])
    data = None if content.deleted else content.data
    if data is not None:
        givers = [] if not field else [new] if place is new else [old, content]
        order = next(({field: r.data[field]} for r in givers if field in (r.data or {})), {})
        data = {k: v for k, v in data.items() if k != field} | order
    return Record(data, content.deleted, content.updated, place.moved, new.device)


def merge_change(kind: str, old: Record | None, old_seq: int, new: Record, seen: int | None) -> tuple[Record, str, dict | None]:
    """The record after a change, what became of the change, and the text that lost, if it is kept.

    A record is two registers, content and (for some kinds) place, each kept by its last writer; the device is that of
    whatever was written last. The loser of two different notes is kept as a copy if its writer had not seen the other.
    """
    if old is None:
        return new, "applied", None
    field = ORDER_FIELDS.get(kind)
    last = winners(old, new, ["content", "place"] if field else ["content"])
    lost = None
    if kind == NOTE and (seen or 0) < old_seq and not any(r.deleted for r in (old, new)):
        loser = new if last["content"] is old else old
        says = [tuple((r.data or {}).get(k) or "" for k in READ_BY_USERS) for r in (old, new)]
        lost = dict(loser.data or {}) or None if len(set(says)) == 2 else None
    won = [x for x, r in last.items() if r is new]
    # a kept copy of what came in is what became of the change, wherever it moved the note
    applied = "content" in won or (won and not lost)
    status = ("applied" if applied else "older_ignored") + "_with_copy" * bool(lost)
    return (composed(last, old, new, field) if won else old), status, lost


def _whole(v) -> int | None:
    return None if pd.isna(v) else int(v)


def _text(d: dict | None) -> str | None:
    return None if d is None else json.dumps(d, ensure_ascii=False, sort_keys=True)


def change_of(r) -> Record:
    """The record that a row of changes writes."""
    gone = False if pd.isna(r.deleted) else bool(r.deleted)
    data = None if gone or not isinstance(r.data, str) else json.loads(r.data)
    return Record(data, gone, _whole(r.updated_us), _whole(r.moved_us), r.device if isinstance(r.device, str) else "")


def merge_changes(changes: DataFrame) -> DataFrame:
    """One row for each change, by its seq: status, copy (JSON of a lost text) and the record after it.

    changes: user_id, kind, key, seq, updated_us, moved_us, device, deleted, data (JSON), seen (the seq its writer had).
    Merges do not commute, so a record's changes are folded in order of seq, in one task but batch by batch: what is held
    is one record. Null deleted counts as false, null device as empty; null data is a record without data.
    """

    def fold(batches):
        at, state, state_seq = None, None, 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                key = tuple(None if pd.isna(v) else v for v in (r.user_id, r.kind, r.key))
                if key != at:
                    at, state = key, None
                before = state
                state, status, lost = merge_change(r.kind, state, state_seq, change_of(r), _whole(r.seen))
                if state is not before:
                    state_seq = int(r.seq)
                out.append((*key, int(r.seq), status, _text(lost), _text(state.data), state.deleted, state.updated, state.moved, state.device))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"user_id": "Int64", "updated_us": "Int64", "moved_us": "Int64"})

    rows = changes.select(*KEYS, "seq", "updated_us", "moved_us", "device", "deleted", "data", "seen")
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "seq").mapInPandas(fold, OUT)


def sync_merge(events: DataFrame) -> DataFrame:
    """The merge over events as changes: clicks are notes, purchases folders of notes, all others bookmarks."""
    us, n = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", NOTE).when(F.col("event_type") == "purchase", "noteFolder").otherwise("bookmark")
    data = F.to_json(F.struct(F.col("event_type").alias("title"), F.col("props").alias("bodyText"), F.col("value").alias("sortIndex")))
    return merge_changes(events.select("user_id", kind.alias("kind"), F.col("event_type").alias("key"), n.alias("seq"), us.alias("updated_us"), (us - n % 5 * 1_000_000).alias("moved_us"), (n % 3).cast("string").alias("device"), (n % 11 == 0).alias("deleted"), data.alias("data"), (n - n % 400).alias("seen")))


def rate_fold(events: DataFrame, limit: int = 2, span: int = 3_600_000_000) -> DataFrame:
    """Calls let through: a refused call does not count against later ones. What is held is the times of at most limit calls."""

    def fold(batches):
        user, recent = None, deque()
        for pdf in batches:
            ok = []
            for who, us in zip(pdf["user_id"].tolist(), pdf["us"].tolist(), strict=True):
                if who != user:
                    user, recent = who, deque()
                while recent and recent[0] <= us - span:
                    recent.popleft()
                ok.append(len(recent) < limit)
                if ok[-1]:
                    recent.append(us)
            yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "allowed": ok})

    e = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(fold, "event_id long, allowed boolean")


def longest_rising(values: list[float]) -> list[int]:
    """Indexes of a longest strictly rising subsequence."""
    tails: list[float] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def lis_chain(anchors: DataFrame) -> DataFrame:
    """(grp, x, y): of each group's anchors by x, a longest chain with rising y."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        return pdf.iloc[longest_rising(pdf["y"].tolist())]

    return anchors.groupBy("grp").applyInPandas(chain, "grp long, x long, y double")
