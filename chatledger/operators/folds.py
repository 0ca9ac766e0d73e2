"""Operators whose rows depend on earlier *decisions*: rate limits, cache hits, budgets.

A rejected request changes nothing, so these are folds and not windows.  Rows are range-sorted
by key and time into even partitions, whatever share of them a key holds, and every
partition is folded on its own, in constant memory.  A fold is right for every key that
begins in its partition.  Only the first key of a partition may go on from an earlier one,
and of that only the rows before the state is *certain*, whatever it was at the partition's
start: a bucket that must have been full, a cache entry that must have expired.
These open rows get a second, short treatment:

* Rate limits fold the open rows between two certain states, one row per millisecond.
  These stretches are folded side by side.
* Cache hits need no fold to know the state at a partition's start: every storable
  millisecond points to the store that follows its entry's end, pointers are doubled
  over partitions, and the marked stores give every partition its state.
* Budgets decide by bounds: requests that pass even if all earlier ones were charged, and
  requests that are certain to be blocked.  Only what is left is folded.

What stays serial is a key whose state never becomes certain: a client over its limit from
one end of the log to the other is one fold over at most a row a millisecond.

The step functions are shared with the streaming versions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.window import WindowSpec

from chatledger.operators.running import carried_forward, in_key_order, ordered_pass, running_totals
from chatledger.sources.tables import checkpointed

SLICE_MS = 60_000

Step = Callable[..., tuple[Any, tuple]]


def fold_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    inputs: Sequence[str],
    outputs: str,
) -> DataFrame:
    """Run ``step(state, *inputs) -> (state, outputs)`` along each key's rows.

    ``state`` starts as None.  Adds the ``outputs`` columns to ``df``; columns that
    are neither key nor input pass through as Arrow data.  One exchange on the
    keys; memory is one batch and one state.
    """
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow_schema = to_arrow_schema(schema)
    names, keys, inputs = df.columns, list(keys), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            given = {n: batch.column(names.index(n)).to_pylist() for n in {*keys, *inputs}}
            results = []
            for key, args in zip(zip(*(given[k] for k in keys)), zip(*(given[i] for i in inputs))):
                if key != current:
                    current, state = key, None
                state, result = step(state, *args)
                results.append(result)
            # A null struct with a field that is never null cannot be cast, even to its own type.
            types = [arrow_schema.field(i).type for i in range(len(names))]
            columns = [c if c.type == t else c.cast(t) for c, t in zip(batch.columns, types)]
            for field, values in zip(list(arrow_schema)[len(names) :], zip(*results)):
                columns.append(pa.array(values, type=field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(run, schema)


def resumed(step: Step) -> Step:
    """``step`` for a stretch whose rows carry, as their last input, the state before it."""

    def run(held, *args):
        *args, entry = args
        state = held[0] if held is not None else entry and tuple(entry.values())
        state, result = step(state, *args)
        return (state,), result

    return run


def fold_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    certain: Step,
    inputs: Sequence[str],
    outputs: str,
    state: str,
    parts: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Run ``step`` along each key's rows, in even partitions sorted by key and order.

    ``certain(track, *inputs) -> (track, sure)`` follows rows whose state at the start is not
    known, and tells from which row on it is.  Open rows that depend on each other are a
    chain.  A chain within one partition is folded again from the state before it.  Returns the
    rows with ``outputs``, and the rows of longer chains, if there are any, with
    ``part_, at_`` (their place), ``chain_`` and ``resume_`` (the state before the chain).
    """
    keys, inputs = list(keys), list(inputs)
    added = T._parse_datatype_string(outputs)
    arrow = to_arrow_schema(added)
    kept = to_arrow_type(T._parse_datatype_string(state))
    rows = in_key_order(df, keys, order, parts)
    at = [rows.columns.index(c) for c in inputs]

    def make():
        now, track, sure, first = None, None, False, True

        def run(batch: pa.RecordBatch, starts: np.ndarray) -> list[pa.Array]:
            nonlocal now, track, sure, first
            results, settled = [], np.ones(batch.num_rows, bool)
            for i, (begins, *args) in enumerate(zip(starts.tolist(), *(batch.column(a).to_pylist() for a in at))):
                if begins:
                    now, sure, first = None, not first, False
                if not sure:
                    track, sure = certain(track, *args)
                    settled[i] = sure
                now, result = step(now, *args)
                results.append(result)
            last = None if now is None else {
                f.name: list(v.items()) if pa.types.is_map(f.type) else v for f, v in zip(kept, now)
            }
            columns = [pa.array(v, type=f.type) for f, v in zip(arrow, zip(*results))]
            return [*columns, pa.array(settled), pa.array([None] * (batch.num_rows - 1) + [last], kept)]

        return run

    run = ordered_pass(rows, keys, [], f"{outputs}, settled_ boolean, state_ struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in T._parse_datatype_string(state))}>", make)
    chains = checkpointed(_goes_on(run, keys), "chains")
    longest = chains.agg(F.max("links_")).first()[0] or 0
    right = run
    if longest:
        place = (F.col("part_") == F.col("of_")) & F.col("first_") & ~F.col("settled_")
        joined = run.join(F.broadcast(chains), place, "left")
        right = joined.where("of_ IS NULL")
        short = joined.where("links_ = 1").select(*df.columns, "at_", "chain_", "resume_")
        short = fold_by_key(short, ["chain_"], ["at_"], resumed(step), [*inputs, "resume_"], outputs)
        right = right.select(*df.columns, *added.names).union(short.select(*df.columns, *added.names))
    right = right.select(*df.columns, *added.names)
    if longest < 2:
        return right, None
    return right, joined.where("links_ > 1").select(*df.columns, "part_", "at_", "chain_", "resume_")


def _goes_on(run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``of_, chain_, resume_, links_`` for every partition whose first key began in an earlier one: at
    most a row a partition.  A chain is named after the last partition with a known end, and has
    ``links_`` partitions."""
    ends = run.where("last_").select(*keys, "part_", F.lit(1).alias("kind_"), "first_", "settled_", "state_")
    begins = run.where("at_ = 0").select(
        *keys, "part_", F.lit(0).alias("kind_"), "first_", "settled_", F.lit(None).cast(run.schema["state_"].dataType).alias("state_")
    )
    before = Window.partitionBy(*keys).orderBy("part_", "kind_").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.max(F.col("kind_")).over(before) == 1
    bounds = ends.union(begins).withColumn("goes_on_", F.coalesce(goes_on, F.lit(False)))
    known = (F.col("kind_") == 1) & (~F.col("first_") | ~F.col("goes_on_") | F.col("settled_"))
    end = F.when(known, F.struct("part_", "state_"))
    bounds = bounds.withColumn("end_", F.last(end, ignorenulls=True).over(before))
    bounds = bounds.where("kind_ = 0 AND goes_on_").select(
        F.col("part_").alias("of_"), F.col("end_.part_").alias("chain_"), F.col("end_.state_").alias("resume_")
    )
    return bounds.withColumn("links_", F.count("*").over(Window.partitionBy("chain_")))


# --- rate limits -------------------------------------------------------------


def bucket_capacity(rpm: float, burst: float) -> float:
    """Most requests a bucket can hold; halves round upwards."""
    return float(max(1, int(rpm * burst + 0.5)))


def bucket_step(rpm: float, burst: float, cost: int) -> Step:
    """State ``(tokens, last_ms)``.  Input: a millisecond and its number of requests.
    Output: the tokens on hand before the first of them."""
    capacity = bucket_capacity(rpm, burst)
    per_ms = rpm / 60000

    def step(state, ms, n):
        if state is None:
            tokens, last = capacity, ms
        else:
            tokens, last = state
            # A late event of a stream is taken at the time already reached.
            elapsed = ms - last if ms > last else 0
            tokens = min(capacity, tokens + elapsed * per_ms)
            last = max(ms, last)
        passed = min(n, tokens // cost)
        return (tokens - passed * cost, last), (tokens,)

    return step


def bucket_answer(tokens: Column, nth: Column, rpm: float, cost: int) -> list[Column]:
    """Answer to the ``nth`` request of a millisecond that began with ``tokens``."""
    fitting = F.floor(tokens / cost)
    allowed = nth <= fitting
    deficit = F.lit(float(cost)) - (tokens - fitting * cost)
    reset = F.when(allowed, F.lit(0)).otherwise(F.ceil(deficit / F.lit(rpm / 60000))).cast("bigint")
    return [
        allowed.alias("allowed"),
        F.when(allowed, F.floor(tokens - nth * cost)).otherwise(F.lit(0)).cast("bigint").alias("remaining"),
        reset.alias("reset_ms"),
        F.ceil(reset / 1000).cast("bigint").alias("retry_after_s"),
    ]


def check_limits(rpm: float, cost: int) -> None:
    if rpm <= 0:
        raise ValueError("rpm must be positive")
    if cost != int(cost) or cost < 1:
        raise ValueError("cost must be a whole number of at least 1")


def fullness(rpm: float, burst: float, cost: int) -> Step:
    """Follows the least a bucket can hold whatever it held before: nothing at first, and
    every request is paid for.  Where even that fills the bucket, its state is certain."""
    capacity, per_ms = bucket_capacity(rpm, burst), rpm / 60000

    def certain(track, ms, n):
        least, last = track or (0.0, ms)
        least += max(0, ms - last) * per_ms
        # Some room for rounding: the bucket itself adds up other numbers.
        sure = least >= capacity + 1e-6
        return (max(0.0, min(least, capacity) - n * cost), ms), sure

    return certain


def rate_limit_audit(
    df: DataFrame,
    key: str,
    ms: str,
    tie: str,
    rpm: float = 60,
    burst: float = 1.5,
    cost: int = 1,
    parts: int | None = None,
) -> DataFrame:
    """Add ``allowed, remaining, reset_ms, retry_after_s``: what a token bucket per
    ``key`` would have answered to each request, in ``(ms, tie)`` order."""
    check_limits(rpm, cost)
    step = bucket_step(rpm, burst, cost)
    one = df.withColumn("n_", F.lit(1).cast("bigint"))
    state = "tokens double, last_ms bigint"
    right, open_ = fold_in_order(
        one, [key], [ms, tie], step, fullness(rpm, burst, cost), [ms, "n_"], "tokens_ double", state, parts
    )
    result = right.select(*df.columns, *bucket_answer(F.col("tokens_"), F.lit(1), rpm, cost))
    if open_ is None:
        return result
    # Requests of one millisecond cannot be told apart by the state.
    per_ms = open_.groupBy("chain_", ms).agg(F.count("*").alias("n_"), F.first("resume_").alias("resume_"))
    states = fold_by_key(per_ms, ["chain_"], [ms], resumed(step), [ms, "n_", "resume_"], "tokens_ double")
    nth = F.row_number().over(Window.partitionBy("chain_", ms).orderBy("part_", "at_"))
    spread = open_.withColumn("nth_", nth).join(states.select("chain_", ms, "tokens_"), ["chain_", ms])
    return result.unionByName(
        spread.select(*df.columns, *bucket_answer(F.col("tokens_"), F.col("nth_"), rpm, cost))
    )


def idle_buckets(df: DataFrame, key: str, ms: str, now_ms: Column | int, idle_ms: int = 300_000) -> DataFrame:
    """Keys whose last request lies more than ``idle_ms`` before ``now_ms``."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return (
        df.groupBy(key)
        .agg(F.max(ms).alias("last_ms"))
        .withColumn("idle_ms", now - F.col("last_ms"))
        .where(F.col("idle_ms") > idle_ms)
    )


# --- cache hits --------------------------------------------------------------


def cache_step(ttl_ms: int) -> Step:
    """State: the live entry, ``(stored_ms, payload)``.  Input: a millisecond,
    whether a request of it can store an answer, and what the entry would carry.
    Output: the entry if still live."""

    def step(entry, ms, stores, payload=None):
        if entry is not None and (ttl_ms <= 0 or ms - entry[0] <= ttl_ms):
            return entry, entry
        return ((ms, payload) if stores else None), (None, None)

    return step


def delayed_cache_step(ttl_ms: int) -> Step:
    """As :func:`cache_step`, but an answer is stored when it completes.  Input:
    a millisecond and ``(completion, payload)`` of its requests that can store."""

    def step(state, ms, answers):
        entry, pending = state or (None, [])
        due = [a for a in pending if a[0] <= ms]
        if due:
            newest = max(due, key=lambda a: a[1])
            entry = newest[1:]
            pending = [a for a in pending if a[0] > ms]
        live = entry is not None and (ttl_ms <= 0 or ms - entry[0] <= ttl_ms)
        if not live:
            pending = pending + [(max(a["done"], ms + 1), a["done"], a["payload"]) for a in answers]
        return (entry, pending), (entry if live else (None, None))

    return step


def expired(ttl_ms: int) -> Step:
    """An entry stored before a silence of more than ``ttl_ms`` is gone, whichever it was."""

    def certain(last, ms, *_):
        return ms, last is not None and ms - last > ttl_ms

    return certain


def cache_attribution(
    df: DataFrame,
    keys: str | Sequence[str],
    ms: str,
    tie: str,
    ttl_ms: int = 86_400_000,
    stores: Column | None = None,
    completed_ms: Column | None = None,
    payload: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Add ``is_hit, stored_ms``: which requests a response cache would have answered.

    The first request stores, later ones hit until the entry is older than
    ``ttl_ms`` (0: never), then the next one stores anew; age counts from the
    store.  ``stores`` is false for requests whose answer failed.  ``payload``
    columns of the storing request are added to its hits as ``stored_<name>``.
    With ``completed_ms`` an entry counts from its completion and is seen by
    requests of later milliseconds only, so overlapping equal requests all miss.
    A request whose key is null has no entry: it misses and stores nothing.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    can = F.coalesce(stores, F.lit(False)) if stores is not None else F.lit(True)
    load = F.struct(*payload) if payload else F.lit(None).cast("string")
    rows = df.withColumn("can_", can).withColumn("load_", load)
    load_type = rows.schema["load_"].dataType.simpleString()
    entry = f"live_ bigint, entry_ {load_type}"
    unnamed = F.lit(False)
    for k in keys:
        unnamed = unnamed | F.col(k).isNull()
    named = rows.where(~unnamed)
    none = [F.lit(None).cast("bigint").alias("live_"), F.lit(None).cast(load_type).alias("entry_")]
    if completed_ms is not None:
        done = F.when(F.col("can_"), F.greatest(completed_ms.cast("bigint"), F.col(ms)))
        answer = F.struct(done.alias("done"), F.col("load_").alias("payload"))
        named = named.withColumn("answer_", F.when(done.isNotNull(), answer))
        # An answer is seen by later milliseconds only, so those of one may be handed over together.
        per_ms = named.groupBy(*keys, ms).agg(F.collect_set("answer_").alias("answers_"))
        states = fold_by_key(per_ms, keys, [ms], delayed_cache_step(ttl_ms), [ms, "answers_"], entry)
        result = named.join(states.drop("answers_"), [*keys, ms]).select(*df.columns, "live_", "entry_")
    elif ttl_ms <= 0:
        result = _first_stores(named, keys, ms, tie).select(*df.columns, "live_", "entry_")
    else:
        step, inputs = cache_step(ttl_ms), [ms, "can_", "load_"]
        state = f"stored_ms bigint, payload {load_type}"
        right, open_ = fold_in_order(named, keys, [ms, tie], step, expired(ttl_ms), inputs, entry, state, parts)
        result = right.select(*df.columns, "live_", "entry_")
        if open_ is not None:
            known = _states_of_parts(open_, ms, ttl_ms, load_type, parts)
            again = open_.drop("resume_").join(F.broadcast(known), "part_").withColumnRenamed("state_", "start_")
            folded = fold_by_key(again, ["part_"], ["at_"], resumed(step), [*inputs, "start_"], entry)
            result = result.union(folded.select(*df.columns, "live_", "entry_"))
    result = result.union(rows.where(unnamed).select(*df.columns, *none))
    return result.select(
        *df.columns,
        F.col("live_").isNotNull().alias("is_hit"),
        F.col("live_").alias("stored_ms"),
        *[F.col("entry_")[c].alias(f"stored_{c}") for c in payload],
    )


def _first_stores(rows: DataFrame, keys: list[str], ms: str, tie: str) -> DataFrame:
    """Entries that never expire: a key's first request that can store, for all after it."""
    place = F.struct(ms, tie)
    first = rows.where("can_").groupBy(*keys).agg(F.min_by(F.struct(place.alias("at"), "load_"), place).alias("f_"))
    after = place > F.col("f_.at")
    return rows.join(first, keys, "left").withColumns(
        {"live_": F.when(after, F.col("f_.at")[ms]), "entry_": F.when(after, F.col("f_.load_"))}
    )


def _exits(ms: int, can: int, load: int, part: int, chain: int, ttl_ms: int, schema: pa.Schema):
    """For each storable millisecond of a partition at which an entry may begin: the last store
    of the partition that follows from it, with its payload."""

    def nodes(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        able = np.flatnonzero(table.column(can).to_numpy())
        begin = int(table.column(ms)[0].as_py())
        times, first = np.unique(table.column(ms).to_numpy()[able], return_index=True)
        after = np.searchsorted(times, times + ttl_ms, "right")
        last = np.where(after < len(times), after, np.arange(len(times)))
        while len(last) and (last[last] != last).any():
            last = last[last]
        # Entries from before the partition end within ttl_ms of its first request.
        open_ = np.ones(len(times), bool)
        open_[1:] = times[:-1] <= begin + ttl_ms
        some = np.flatnonzero(open_)
        size = len(some)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([table.column(chain)[0].as_py()] * size, pa.int32()),
                pa.array([table.column(part)[0].as_py()] * size, pa.int32()),
                pa.array(times[some]), pa.array(times[last[some]]),
                pc.take(table.column(load).combine_chunks(), pa.array(able[first[last[some]]])).cast(schema.field("load_").type),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column(part).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if waiting and waiting[0].column(part)[0].as_py() != numbers[a]:
                    yield nodes(waiting)
                    waiting = []
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield nodes(waiting)

    return run


def _states_of_parts(open_: DataFrame, ms: str, ttl_ms: int, load_type: str, parts: int | None) -> DataFrame:
    """``part_, state_``: the entry before each partition's open rows, if any.

    Nodes are the storable milliseconds at which an entry may begin; a node's jump leads to the
    first node after the end of the last entry of its partition.  The chain's first entry is
    marked, then those its jump leads to, with jumps of twice the length in each round.
    """
    schema = T.StructType([
        T.StructField("chain_", T.IntegerType()), T.StructField("part_", T.IntegerType()), T.StructField("node_", T.LongType()),
        T.StructField("exit_", T.LongType()), open_.schema["load_"],
    ])
    held = open_.select("chain_", "part_", "at_", ms, "can_", "load_").repartition("part_").sortWithinPartitions("part_", "at_")
    at = {c: i for i, c in enumerate(held.columns)}
    exits = _exits(at[ms], at["can_"], at["load_"], at["part_"], at["chain_"], ttl_ms, to_arrow_schema(schema))
    nodes = checkpointed(held.mapInArrow(exits, schema), "nodes")
    starts = checkpointed(open_.groupBy("chain_").agg(F.first("resume_").alias("resume_")), "starts")
    never = F.lit(-(1 << 62))
    asking = starts.select(
        "chain_", F.lit(None).cast("bigint").alias("node_"), F.coalesce(F.col("resume_.stored_ms") + ttl_ms, never).alias("t_"), F.lit(0).alias("kind_")
    )
    asking = asking.union(nodes.select("chain_", "node_", F.col("exit_") + ttl_ms, F.lit(0)))
    standing = nodes.select("chain_", "node_", F.col("node_").alias("t_"), F.lit(1).alias("kind_"))
    # Backwards in time, the last node passed is the first one later than the question.
    both = asking.union(standing).withColumns(
        {"back_": -F.col("t_"), "is_": F.when(F.col("kind_") == 1, F.col("node_"))}
    )
    found = carried_forward(both, ["chain_"], ["back_", "kind_"], "is_", "to_", parts).where("kind_ = 0")
    found = checkpointed(found.select("chain_", "node_", "to_"), "jumps")
    marked = checkpointed(found.where("node_ IS NULL AND to_ IS NOT NULL").select("chain_", F.col("to_").alias("node_")), "marked")
    jumps = found.where("node_ IS NOT NULL AND to_ IS NOT NULL")
    while True:
        reached = marked.join(jumps, ["chain_", "node_"]).select("chain_", F.col("to_").alias("node_"))
        reached = checkpointed(reached, "reached")
        if reached.isEmpty():
            break
        marked = checkpointed(marked.union(reached), "marked")
        onwards = jumps.select("chain_", F.col("node_").alias("to_"), F.col("to_").alias("far_"))
        jumps = checkpointed(jumps.join(onwards, ["chain_", "to_"]).select("chain_", "node_", F.col("far_").alias("to_")), "jumps")
    # A row a partition from here on.
    stores = nodes.join(marked, ["chain_", "node_"]).select("chain_", "part_", F.struct(F.col("exit_").alias("stored_ms"), F.col("load_").alias("payload")).alias("store_"))
    every = open_.select("chain_", "part_").distinct().join(stores.drop("chain_"), "part_", "left")
    earlier = Window.partitionBy("chain_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("store_", ignorenulls=True).over(earlier)
    before = every.select("chain_", "part_", last.alias("before_")).join(starts, "chain_")
    return before.select("part_", F.coalesce("before_", "resume_").alias("state_"))


# --- budgets -----------------------------------------------------------------


def within(session_used: int, daily_used: int, est: int, session_budget: int, daily_budget: int) -> bool:
    return not (
        (session_budget > 0 and session_used + est > session_budget)
        or (daily_budget > 0 and daily_used + est > daily_budget)
    )


def budget_step(session_budget: int, daily_budget: int) -> Step:
    """State ``(session_used, day, daily_used)``.  Input: day number, estimate,
    charge.  Output: whether the request passes, and the counters before it."""

    def step(state, day, est, charge):
        session_used, today, daily_used = state or (0, day, 0)
        if day > today:
            today, daily_used = day, 0
        before = (session_used, daily_used)
        ok = within(session_used, daily_used, est, session_budget, daily_budget)
        if ok:
            session_used += charge
            daily_used += charge
        return (session_used, today, daily_used), (ok, *before)

    return step


def cached_budget_step(session_budget: int, daily_budget: int, ttl_ms: int) -> Step:
    """As :func:`budget_step` for requests a cache may answer: only a miss is
    charged, and only a miss that passes is stored.  The state also maps the
    hashes stored so far to their times; each cost at least one token of the
    budget, and expired ones leave with the day.  A null key is never stored.
    Output: whether the request passes, the counters before it, and whether it is charged."""

    def step(state, ms, day, est, charge, key, stores):
        session_used, today, daily_used, entries = state or (0, day, 0, {})
        if not isinstance(entries, dict):
            entries = dict(entries)
        if day > today:
            today, daily_used = day, 0
            if ttl_ms > 0:
                entries = {k: t for k, t in entries.items() if ms - t <= ttl_ms}
        charged, before = False, (session_used, daily_used)
        ok = within(session_used, daily_used, est, session_budget, daily_budget)
        if ok and stores:
            stored = entries.get(key)
            charged = stored is None or (0 < ttl_ms < ms - stored)
        if charged:
            if key is not None:
                entries[key] = ms
            session_used += charge
            daily_used += charge
        return (session_used, today, daily_used, entries), (ok, *before, charged)

    return step


def _unknown(track, *_):
    """Counters are never certain by themselves."""
    return track, False


def budget_guard(
    df: DataFrame,
    scope: str,
    ms: str,
    tie: str,
    est: str,
    charge: str,
    session_budget: int = 0,
    daily_budget: int = 0,
    parts: int | None = None,
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Add ``allowed, blocked_by, session_used_before, daily_used_before``.

    ``charge``, 0 or more, is what an allowed request adds to both counters: its actual
    tokens if it was an answered miss, otherwise 0.  0 means no limit.  ``tie``
    must identify a request.  Without any limit the counters are running totals.
    """
    budgets = (session_budget, daily_budget)
    rows = _budget_rows(df, ms, est, charge)
    if session_budget <= 0 and daily_budget <= 0:
        counted = _counters(rows, [scope], ms, tie, F.col("charge_"), parts)
        return counted.select(*df.columns, *_passes(budgets))
    step, inputs = budget_step(*budgets), ["day_", "est_", "charge_"]
    state = "session_used bigint, day int, daily_used bigint"
    right, open_ = fold_in_order(rows, [scope], [ms, tie], step, _unknown, inputs, PASSES, state, parts)
    result = right.select(*df.columns, *_passes(budgets))
    if open_ is None:
        return result
    before = open_.withColumns({"used_": F.col("resume_.session_used"), "until_": F.col("resume_.day"), "today_": F.col("resume_.daily_used")})
    most = _counters(before.drop("part_", "at_", "resume_"), ["chain_"], ms, tie, F.col("charge_"), parts)
    most = checkpointed(_from_start(most), "most")
    # The first request of a chain that might not pass; all before it do.  A row a chain.
    place = F.struct(ms, tie)
    doubt = most.where(~_fits(F.col("session_"), F.col("daily_"), F.col("est_"), *budgets))
    doubt = doubt.groupBy("chain_").agg(
        F.min_by(F.struct(place.alias("at"), F.struct("session_", "day_", "daily_").alias("state")), place).alias("doubt_")
    )
    most = most.join(F.broadcast(checkpointed(doubt, "doubt")), "chain_", "left")
    passes = F.coalesce(place < F.col("doubt_.at"), F.lit(True))
    charging = most.where(~passes & (F.col("charge_") > 0))
    charging = charging.select("chain_", ms, tie, *inputs, F.col("doubt_.state").alias("start_"))
    undecided = _undecided(charging, charging, "chain_", ms, *budgets, slice_ms)
    decided = fold_by_key(undecided, ["chain_"], [ms, tie], resumed(step), [*inputs, "start_"], PASSES)
    decided = decided.where("ok_").select("chain_", ms, tie, F.lit(True).alias("ok_"))
    counted = most.drop("session_", "daily_").join(decided, ["chain_", ms, tie], "left")
    paid = F.when(passes | F.coalesce("ok_", F.lit(False)), F.col("charge_")).otherwise(0)
    counted = _from_start(_counters(counted, ["chain_"], ms, tie, paid, parts))
    return result.unionByName(counted.select(*df.columns, *_passes(budgets)))


def _from_start(rows: DataFrame) -> DataFrame:
    """Counters of a chain with what was used before it."""
    return rows.withColumns(
        {
            "session_": F.col("session_") + F.col("used_"),
            "daily_": F.col("daily_") + F.when(F.col("day_") == F.col("until_"), F.col("today_")).otherwise(0),
        }
    )


def budget_guard_cached(
    df: DataFrame,
    scope: str,
    ms: str,
    tie: str,
    est: str,
    charge: str,
    key: str,
    stores: str,
    ttl_ms: int,
    session_budget: int = 0,
    daily_budget: int = 0,
    parts: int | None = None,
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """:func:`budget_guard` where each scope also has a response cache.

    Whether a request is charged depends on earlier misses, and whether those
    passed depends on earlier charges, so one fold carries both.  A scope that spans
    partitions is folded anew over fewer rows: of equal requests (same key, estimate,
    storing or not) in one millisecond only the first can change anything, and
    those certain to be blocked stay out of it too.
    """
    step = cached_budget_step(session_budget, daily_budget, ttl_ms)
    budgets = (session_budget, daily_budget)
    inputs = [ms, "day_", "est_", "charge_", "key_", "stores_"]
    output = PASSES + ", charged_ boolean"
    rows = _budget_rows(df, ms, est, charge).withColumns(
        {"key_": F.col(key), "stores_": F.col(stores)}
    )
    hashes = rows.schema["key_"].dataType.simpleString()
    state = f"session_used bigint, day int, daily_used bigint, entries map<{hashes},bigint>"
    right, open_ = fold_in_order(rows, [scope], [ms, tie], step, _unknown, inputs, output, state, parts)
    if open_ is None:
        return right.select(*df.columns, *_passes(budgets))
    wide = checkpointed(open_.select(F.col(scope).alias("wide_")).distinct(), "wide")
    # At most a row a partition.
    wide = F.broadcast(wide)
    same = F.col(scope).eqNullSafe(F.col("wide_"))
    result = right.join(wide, same, "left_anti").select(*df.columns, *_passes(budgets))
    busy = checkpointed(rows.join(wide, same, "left_semi"), "busy")
    alike = [scope, ms, "key_", "est_", "stores_", "own_"]
    first = (
        busy.withColumn("own_", F.when(F.col("key_").isNull(), F.col(tie)))
        .groupBy(*alike)
        .agg(F.min_by(F.struct(tie, "day_", "charge_"), tie).alias("f_"))
        .select(*alike, "f_.*")
        .drop("own_")
    )
    # The first storing request of a key is charged if it passes: nothing is cached yet.
    sure = (
        first.where("stores_")
        .groupBy(scope, "key_")
        .agg(F.min_by(F.struct(ms, "day_", "est_", "charge_"), F.struct(ms, tie)).alias("f_"))
        .select(scope, "f_.*")
    )
    undecided = _undecided(first, sure, scope, ms, *budgets, slice_ms)
    decided = fold_by_key(undecided, [scope], [ms, tie], step, inputs, output).where("charged_")
    paid = decided.select(F.col(scope).alias("in_"), F.col(ms).alias("when_"), F.col(tie).alias("which_"), F.lit(True).alias("paid_"))
    match = F.col(scope).eqNullSafe(F.col("in_")) & (F.col(ms) == F.col("when_")) & (F.col(tie) == F.col("which_"))
    counted = busy.join(paid, match, "left").drop("in_", "when_", "which_")
    amount = F.when(F.col("paid_"), F.col("charge_")).otherwise(0)
    counted = _counters(counted, [scope], ms, tie, amount, parts)
    return result.unionByName(counted.select(*df.columns, *_passes(budgets)))


# Shares of a scope's requests at which `_undecided` looks for an exhausted budget.
EDGE_QUANTILES = [0.0, 0.001, 0.01, 0.1, 0.5, 1.0]
PASSES = "ok_ boolean, session_ bigint, daily_ bigint"


def _passes(budgets: tuple[int, int]) -> list[Column]:
    return budget_answer(F.col("session_"), F.col("daily_"), F.col("est_"), *budgets)


def _budget_rows(df: DataFrame, ms: str, est: str, charge: str) -> DataFrame:
    return df.withColumns(
        {
            "day_": day_number(F.col(ms)),
            "est_": F.col(est).cast("bigint"),
            "charge_": F.coalesce(F.col(charge).cast("bigint"), F.lit(0).cast("bigint")),
        }
    )


def day_number(ms: Column) -> Column:
    """UTC days since the epoch."""
    return F.floor(ms / 86_400_000).cast("int")


def _counters(rows: DataFrame, keys: list[str], ms: str, tie: str, amount: Column, parts: int | None) -> DataFrame:
    """Add ``session_, daily_``: what the key's rows before each one add up to, in all and
    on its day."""
    paid = rows.withColumn("paid_", amount.cast("bigint"))
    used = running_totals(paid, [*keys, "day_"], ms, tie, {"in_day_": F.col("paid_")}, parts)
    # A row for each key and day.
    days = used.groupBy(*keys, "day_").agg(F.max("in_day_").alias("sum_"))
    earlier = Window.partitionBy(*keys).orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(
        *[F.col(k).alias(f"of_{k}") for k in keys], F.col("day_").alias("of_day_"),
        F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("earlier_"),
    )
    same = F.col("day_") == F.col("of_day_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    before = F.col("in_day_") - F.col("paid_")
    used = used.join(days, same, "left").withColumns(
        {"session_": F.coalesce("earlier_", F.lit(0)) + before, "daily_": before}
    )
    return used.drop("paid_", "in_day_", "earlier_", "of_day_", *[f"of_{k}" for k in keys])


def _fits(session_used: Column, daily_used: Column, est: Column, session_budget: int, daily_budget: int) -> Column:
    over_session = session_used + est > session_budget if session_budget > 0 else F.lit(False)
    over_daily = daily_used + est > daily_budget if daily_budget > 0 else F.lit(False)
    return ~(over_session | over_daily)


def budget_answer(
    session_used: Column, daily_used: Column, est: Column, session_budget: int, daily_budget: int
) -> list[Column]:
    over_session = session_used + est > session_budget if session_budget > 0 else F.lit(False)
    over_daily = daily_used + est > daily_budget if daily_budget > 0 else F.lit(False)
    return [
        (~(over_session | over_daily)).alias("allowed"),
        F.when(over_session, F.lit("session")).when(over_daily, F.lit("daily")).alias("blocked_by"),
        session_used.alias("session_used_before"),
        daily_used.alias("daily_used_before"),
    ]


def _undecided(
    rows: DataFrame,
    sure: DataFrame,
    scope: str,
    ms: str,
    session_budget: int,
    daily_budget: int,
    slice_ms: int,
) -> DataFrame:
    """Those of ``rows`` that are not certain to be blocked.

    ``sure`` are requests that are charged if they pass.  Take those of a scope
    with an estimate of at most ``e``.  At any time either all so far passed, and
    their charges are spent, or one was blocked because less than ``e`` was left.
    So once their charges exceed ``budget - e``, every later request with an
    estimate of ``e`` or more is blocked, whatever else happened: for the rest of
    the day by the daily budget, for good by the session budget.  (A day's charges
    count towards the session only up to what the daily budget is sure to have
    let through.)

    This holds for any ``e``; a few quantiles of the scope's estimates serve as
    such.  Charges are summed per (scope, slice, ``e``) with partial aggregation,
    so the mass of hopeless requests of a scope drops out without a fold.
    """
    at = F.floor(F.col(ms) / slice_ms).alias("slice_")
    edges = sure.groupBy(scope).agg(
        F.explode(F.array_distinct(F.percentile_approx("est_", EDGE_QUANTILES, 10_000))).alias("e_")
    )
    by_slice = (
        sure.select(scope, "day_", "est_", "charge_", at)
        .join(F.broadcast(edges), scope)
        .where(F.col("est_") <= F.col("e_"))
        .groupBy(scope, "day_", "slice_", "e_")
        .agg(F.sum("charge_").alias("gain_"))
    )

    def so_far(*keys: str) -> WindowSpec:
        ordered = Window.partitionBy(*keys).orderBy("slice_")
        return ordered.rowsBetween(Window.unboundedPreceding, 0)

    def spent(sums: DataFrame, keys: list[str], budget: int) -> DataFrame:
        """Per key: each ``e`` with the slice after which it is hopeless."""
        used = sums.withColumn("used_", F.sum("gain_").over(so_far(*keys, "e_")))
        full = used.where(F.col("used_") > budget - F.col("e_"))
        ends = full.groupBy(*keys, "e_").agg(F.min("slice_").alias("end_"))
        return ends.groupBy(*keys).agg(F.collect_list(F.struct("e_", "end_")).alias("ends_"))

    def open_rows(left: DataFrame, sums: DataFrame, keys: list[str], budget: int) -> DataFrame:
        hopeless = F.exists(
            "ends_", lambda x: (x["e_"] <= F.col("est_")) & (x["end_"] < F.col("slice_"))
        )
        marked = left.join(spent(sums, keys, budget), keys, "left")
        return marked.where(~F.coalesce(hopeless, F.lit(False))).drop("ends_")

    left = rows.select("*", at)
    if daily_budget > 0:
        left = open_rows(left, by_slice, [scope, "day_"], daily_budget)
        in_day = F.sum("gain_").over(so_far(scope, "day_", "e_"))
        most = F.greatest(F.lit(0).cast("bigint"), daily_budget - F.col("e_") + 1)
        certain = by_slice.withColumn("certain_", F.least(in_day, most))
        before = F.lag("certain_").over(Window.partitionBy(scope, "day_", "e_").orderBy("slice_"))
        by_slice = certain.withColumn("gain_", F.col("certain_") - F.coalesce(before, F.lit(0)))
    if session_budget > 0:
        left = open_rows(left, by_slice, [scope], session_budget)
    return left.select(*rows.columns)
