"""Latest message and message count of running sessions, as state that ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "start_us BIGINT, last_us BIGINT, event_id BIGINT, event_type STRING, turns BIGINT"
PIECE_COLUMNS = ["start_us", "last_us", "event_id", "event_type", "turns"]
PIECE = f"user_id BIGINT, ts TIMESTAMP, {STATE}"
CHANGE = f"user_id BIGINT, {STATE}, closed BOOLEAN"
GAP, DELAY = "30 minutes", "1 hour"


def _micros(interval: str) -> int:
    return pd.Timedelta(interval) // pd.Timedelta(microseconds=1)


def _pieces(gap_us: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            user, at = batch["user_id"].to_numpy(), batch["ts_us"].to_numpy()
            order = np.lexsort((batch["event_id"].to_numpy(), at, user))
            user, at = user[order], at[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (user[1:] != user[:-1]) | (at[1:] >= at[:-1] + gap_us)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(order)) - 1
            newest = batch.iloc[order[last]]
            yield pd.DataFrame(
                {
                    "user_id": user[last],
                    "ts": newest["ts"].array,
                    "start_us": at[first],
                    "last_us": at[last],
                    "event_id": newest["event_id"].to_numpy(),
                    "event_type": newest["event_type"].to_numpy(),
                    "turns": last - first + 1,
                }
            )

    return run


class SessionState(StatefulProcessor):
    """One open session per user.

    A message at least ``gap_us`` after the newest one opens another session; until then it counts,
    and replaces the newest one if it is not older. The timer of an idle session ends its state.
    """

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _timer(self, last_us: int) -> int:
        return -(-(last_us + self.gap_us) // 1000)

    def _keep(self, before: tuple | None, now: tuple) -> None:
        if before is None or before[1] != now[1]:
            if before is not None:
                self.handle.deleteTimer(self._timer(before[1]))
            self.handle.registerTimer(self._timer(now[1]))
        self.open.update(now)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.sort_values(["last_us", "event_id"]).iloc[-1]
        self._keep(None, (int(row.start_us), int(row.last_us), int(row.event_id), row.event_type, int(row.turns)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.open.get()
        now, changes = before, []
        # Plain lists: a user has few rows, for which frames cost more than the work on them.
        pieces = [p for frame in rows for p in zip(*(frame[name].tolist() for name in PIECE_COLUMNS), strict=True)]
        for piece in sorted(pieces, key=lambda p: p[:3]):
            if now is None:
                now = piece
            elif piece[0] >= now[1] + self.gap_us:
                changes.append((*key, *now, True))
                now = piece
            else:
                newest = max(now, piece, key=lambda p: (p[1], p[2]))
                now = (now[0], *newest[1:4], now[4] + piece[4])
        changes.append((*key, *now, False))
        self._keep(before, tuple(now))
        yield self._rows(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.open.get()
        if now is not None:
            self.open.clear()
            yield self._rows([(*key, *now, True)])

    @staticmethod
    def _rows(changes: list[tuple]) -> pd.DataFrame:
        names = ["user_id", *PIECE_COLUMNS, "closed"]
        return pd.DataFrame(dict(zip(names, map(list, zip(*changes, strict=True)), strict=True)))


def last_state(events: DataFrame, gap: str = GAP, delay: str = DELAY, snapshot: DataFrame | None = None) -> DataFrame:
    """Latest message and number of messages of every session that changed, and whether it has ended.

    A session ends ``gap`` after its newest message: at once where a later message shows it, else when the
    watermark, ``delay`` behind the newest message of all, has passed it; then its state ends. Messages
    without a time are left out, those behind the watermark too; other late ones count but never replace a
    newer one. ``snapshot`` holds open sessions to begin with (columns of the result), such as those of an
    earlier run or a batch. Messages are combined inside each input batch, so a busy session sends one row per
    batch and stretch to its task.
    """
    gap_us = _micros(gap)
    timed = events.where(F.col("ts").isNotNull()).select(
        "user_id", "ts", F.unix_micros("ts").alias("ts_us"), "event_id", "event_type"
    )
    pieces = timed.mapInPandas(_pieces(gap_us), PIECE).withWatermark("ts", delay)
    begin = None
    if snapshot is not None:
        begin = snapshot.where("NOT closed").select(
            "user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("ts").alias("last_us"),
            "event_id", "event_type", "turns",
        ).groupBy("user_id")
    changes = pieces.groupBy("user_id").transformWithStateInPandas(
        SessionState(gap_us), CHANGE, "Update", "EventTime", initialState=begin
    )
    return changes.select(
        "user_id", F.timestamp_micros("start_us").alias("session_start"), F.timestamp_micros("last_us").alias("ts"),
        "event_id", "event_type", "turns", "closed",
    )


def session_states(events: DataFrame, gap: str = GAP) -> DataFrame:
    """The same sessions from a table, all open, to begin a stream with.

    Sessions of a user are cut where a message follows at least ``gap`` after all earlier ones.
    """
    session = F.session_window("ts", gap)
    newest = F.max(F.struct("ts", "event_id", "event_type")).alias("newest")
    return (
        events.where(F.col("ts").isNotNull())
        .groupBy("user_id", session)
        .agg(newest, F.min("ts").alias("session_start"), F.count("*").alias("turns"))
        .select("user_id", "session_start", "newest.ts", "newest.event_id", "newest.event_type", "turns", F.lit(False).alias("closed"))
    )
