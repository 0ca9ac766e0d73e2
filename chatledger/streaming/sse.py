"""Reassembly of responses from a stream of server-sent-event lines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatledger.operators.sse import LATEST, completed, parse_lines
from chatledger.streaming.folds import LATE_MS, with_event_time

PIECE = (
    "seq bigint, done boolean, content string, id string, model string, finish string, "
    "prompt bigint, completion bigint"
)
NAMES = ["seq", "done", "content", *LATEST]


class Reassembly(StatefulProcessor):
    """Keep a stream's pieces until its end marker, emit it once, then keep a mark only.

    With event time, the mark leaves when the watermark has passed it, and a stream
    silent for ``abandon_ms`` is given up: what has come so far is emitted, with the
    finish reason ``abandoned``, and a mark stays in its place.
    """

    def __init__(self, timed: bool, abandon_ms: int | None):
        self.timed, self.abandon_ms = timed, abandon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", PIECE)
        self.finished = handle.getValueState("finished", "at bigint")
        self.newest = handle.getValueState("newest", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        fresh = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        at = self._time(fresh)
        if self.finished.exists():
            if self.timed:
                # Lines that follow the end keep the mark while they come.
                self.finished.update((at,))
                self._wake_at(at + 1)
            return
        # What is missing is None, or a number that is not equal to itself.
        new = list(zip(*[[v if v == v else None for v in fresh[n].tolist()] for n in NAMES]))
        if not any(p[1] for p in new):
            self.pieces.appendList(new)
            if self.timed and self.abandon_ms is not None:
                self._wake_at(at + self.abandon_ms)
            return
        # A call on the state is a message to the JVM: most streams end in the batch they begin in.
        held = [tuple(p) for p in self.pieces.get()] if self.pieces.exists() else []
        pieces = sorted(held + new, key=lambda p: p[0])
        if held:
            self.pieces.clear()
        end = min(p[0] for p in pieces if p[1])
        yield self._merged(key, [p for p in pieces if p[0] < end], at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.finished.exists():
            self.finished.clear()
            self.newest.clear()
            return
        pieces = sorted((tuple(p) for p in self.pieces.get()), key=lambda p: p[0])
        self.pieces.clear()
        out = self._merged(key, pieces, expiredTimerInfo.getExpiryTimeInMs())
        out["finish"] = pd.Series(["abandoned"], dtype="object")
        yield out

    def _time(self, fresh: pd.DataFrame) -> int:
        """The newest event time of the stream so far."""
        if not self.timed:
            return 0
        at = int(fresh["ms_"].max())
        if self.newest.exists():
            at = max(at, self.newest.get()[0])
        self.newest.update((at,))
        return at

    def _merged(self, key: Any, pieces: list[tuple], at: int) -> pd.DataFrame:
        rows = [dict(zip(NAMES, p)) for p in pieces]
        self.finished.update((at,))
        if self.timed:
            self._wake_at(at + 1)
        merged = {"stream_id": key[0], "content": "".join(p["content"] or "" for p in rows)}
        for name in LATEST:
            known = [p[name] for p in rows if p[name] is not None]
            merged[name] = known[-1] if known else None
        return pd.DataFrame({k: pd.Series([v], dtype="object") for k, v in merged.items()})

    def _wake_at(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def sse_reassemble_stream(
    lines: DataFrame, ms: str | None = None, late_ms: int = LATE_MS, abandon_ms: int | None = None
) -> DataFrame:
    """:func:`chatledger.operators.sse.sse_reassemble` over a stream of lines.

    Lines need no time; then pieces stay until the end marker and marks for good.  With
    ``ms``, a column of when a line was sent, lines more than ``late_ms`` behind the newest
    are dropped, marks leave behind them, and ``abandon_ms`` may end silent streams.
    """
    if abandon_ms is not None and ms is None:
        raise ValueError("streams are given up by the time of their lines: name its column")
    schema = (
        "stream_id bigint, content string, id string, model string, finish string, "
        "prompt bigint, completion bigint"
    )
    if ms is None:
        parsed = parse_lines(lines)
    else:
        # What parse_lines drops is not needed to know how far time has come.
        timed = lines.withColumn("ms_", F.col(ms).cast("bigint"))
        parsed = with_event_time(parse_lines(timed, "ms_"), "ms_", late_ms)
    merged = parsed.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=Reassembly(ms is not None, abandon_ms),
        outputStructType=schema,
        outputMode="append",
        timeMode="None" if ms is None else "EventTime",
    )
    return completed(merged.withColumn("est_tokens", F.lit(0).cast("bigint")))
