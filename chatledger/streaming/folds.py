"""Rate limits, cache hits and budgets over a stream.

The decisions are made by the step functions of the batch operators.  A key's state leaves
when event time shows that it can no longer change an answer: the watermark is ``late_ms``
behind the newest request, and rows behind it are dropped, so a bucket that is
full by then, or an entry that has expired by then, is the same as none.  Without ``late_ms``
no row is dropped and state stays for good.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatledger.operators import folds
from chatledger.operators.folds import Step

#: Requests may come this much later than newer ones.
LATE_MS = 86_400_000
EVENT = "event_time_"

#: The event time from which on a state is the same as none; None for never.
Expiry = Callable[[tuple], int | None]


def with_event_time(df: DataFrame, ms: str, late_ms: int | None) -> DataFrame:
    if late_ms is None:
        return df
    timed = df.withColumn(EVENT, F.timestamp_millis(F.col(ms)))
    return timed.withWatermark(EVENT, f"{late_ms} milliseconds")


class StreamingFold(StatefulProcessor):
    """Run a step function along each key's rows, its state kept between batches."""

    def __init__(
        self,
        step: Step,
        order: Sequence[str],
        inputs: Sequence[str],
        passed: Sequence[str],
        outputs: Sequence[str],
        state: T.StructType,
        expiry: Expiry | None,
    ):
        self.step, self.order, self.inputs = step, list(order), list(inputs)
        self.passed, self.outputs = list(passed), list(outputs)
        self.state_schema, self.expiry = state, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", self.state_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A call on the state is a message to the JVM: most of the time of a key with few rows.
        before = tuple(self.state.get()) if self.state.exists() else None
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        if len(batch) > 1:
            batch = batch.sort_values(self.order, kind="stable")
        state, results = before, []
        for args in zip(*[batch[c].tolist() for c in self.inputs]):
            state, result = self.step(state, *args)
            results.append(result)
        if state is None:
            if before is not None:
                self.state.clear()
        elif state != before:
            self.state.update(state)
        if self.expiry is not None:
            # A state's timer is known from the state.
            old, new = (None if s is None else self.expiry(s) for s in (before, state))
            if old != new:
                if old is not None:
                    self.handle.deleteTimer(old)
                if new is not None:
                    self.handle.registerTimer(new)
        columns = {c: batch[c].array for c in self.passed}
        for name, values in zip(self.outputs, zip(*results)):
            columns[name] = np.fromiter(values, "object", len(values))
        yield pd.DataFrame(columns, copy=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # A timer of a run with other settings may come too early for them.
        at = self.expiry(tuple(self.state.get())) if self.expiry is not None and self.state.exists() else None
        if at is not None and at > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(at)
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _fold_stream(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    step: Step,
    inputs: Sequence[str],
    outputs: T.StructType,
    state: str,
    expiry: Expiry | None,
    late_ms: int | None,
) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *outputs.fields])
    if late_ms is None:
        expiry = None
    processor = StreamingFold(
        step, order, inputs, df.columns, outputs.names, T._parse_datatype_string(state), expiry
    )
    return with_event_time(df, order[0], late_ms).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=schema,
        outputMode="append",
        timeMode="None" if late_ms is None else "EventTime",
    )


def rate_limit_stream(
    df: DataFrame,
    key: str,
    ms: str,
    tie: str,
    rpm: float = 60,
    burst: float = 1.5,
    cost: int = 1,
    late_ms: int | None = LATE_MS,
) -> DataFrame:
    """:func:`chatledger.operators.folds.rate_limit_audit` over a stream.

    Buckets fill by the time of the requests, of which a clock on the wall says nothing
    when a stream pauses or lags.  A full bucket leaves the state.
    """
    folds.check_limits(rpm, cost)
    one = df.withColumn("requests", F.lit(1).cast("bigint"))
    out = T.StructType([T.StructField("tokens_", T.DoubleType())])
    capacity, per_ms = folds.bucket_capacity(rpm, burst), rpm / 60000

    def full(state: tuple) -> int:
        tokens, last = state
        return int(last) + math.ceil((capacity - tokens) / per_ms) + 1

    answered = _fold_stream(
        one,
        key,
        [ms, tie],
        folds.bucket_step(rpm, burst, cost),
        [ms, "requests"],
        out,
        "tokens double, last_ms bigint",
        full,
        late_ms,
    )
    return answered.select(
        *df.columns, *folds.bucket_answer(F.col("tokens_"), F.lit(1), rpm, cost)
    )


def cache_attribution_stream(
    df: DataFrame,
    key: str,
    ms: str,
    tie: str,
    ttl_ms: int = 86_400_000,
    stores: Column | None = None,
    late_ms: int | None = LATE_MS,
) -> DataFrame:
    """:func:`chatledger.operators.folds.cache_attribution` over a stream.  An entry leaves
    the state when it has expired; those without a time to live stay."""
    can = F.coalesce(stores, F.lit(False)) if stores is not None else F.lit(True)
    answered = _fold_stream(
        df.withColumn("can_store", can & F.col(key).isNotNull()),
        key,
        [ms, tie],
        StoreTimes(ttl_ms),
        [ms, "can_store"],
        T.StructType([T.StructField("stored_ms", T.LongType())]),
        "stored_ms bigint",
        (lambda state: int(state[0]) + ttl_ms + 1) if ttl_ms > 0 else None,
        late_ms,
    )
    return answered.select(*df.columns, F.col("stored_ms").isNotNull().alias("is_hit"), "stored_ms")


class StoreTimes:
    """The cache step with only the store time as state."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def __call__(self, state, ms, stores):
        entry = None if state is None else (state[0], None)
        entry, live = folds.cache_step(self.ttl_ms)(entry, ms, stores)
        return (None if entry is None else (entry[0],)), (live[0],)


def budget_guard_stream(
    df: DataFrame,
    scope: str,
    ms: str,
    tie: str,
    est: str,
    charge: str,
    session_budget: int = 0,
    daily_budget: int = 0,
    idle_ms: int | None = None,
    late_ms: int | None = LATE_MS,
) -> DataFrame:
    """:func:`chatledger.operators.folds.budget_guard` over a stream.

    Every answer tells what the session used before, so a session's counters stay until it
    is over: with ``idle_ms``, when it was silent for so long in the time of requests and its
    last day has ended.  Later requests of its name then begin a new session.
    """
    rows = df.withColumn("utc_day", folds.day_number(F.col(ms))).withColumn("at_ms", F.col(ms).cast("bigint"))
    outputs = T.StructType(
        [
            T.StructField("passes", T.BooleanType()),
            T.StructField("session_before", T.LongType()),
            T.StructField("daily_before", T.LongType()),
        ]
    )

    def over(state: tuple) -> int | None:
        if idle_ms is None:
            return None
        return max(int(state[3]) + idle_ms, (int(state[1]) + 1) * 86_400_000) + 1

    answered = _fold_stream(
        rows,
        scope,
        [ms, tie],
        Timed(folds.budget_step(session_budget, daily_budget)),
        ["at_ms", "utc_day", est, charge],
        outputs,
        "session_used bigint, day int, daily_used bigint, last_ms bigint",
        over,
        late_ms,
    )
    return answered.select(
        *df.columns,
        *folds.budget_answer(F.col("session_before"), F.col("daily_before"), F.col(est), session_budget, daily_budget),
    )


class Timed:
    """A step whose state also tells when it last changed."""

    def __init__(self, step: Step):
        self.step = step

    def __call__(self, state, ms, *args):
        inner = None if state is None else tuple(state[:-1])
        inner, result = self.step(inner, *args)
        last = ms if state is None else max(ms, state[-1])
        return (*inner, last), result
