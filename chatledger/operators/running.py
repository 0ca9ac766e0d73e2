"""Running totals and trailing means as segmented prefix sums.

Rows are written once in narrow form, range-sorted by key and time, and cut into even
partitions, whatever share of them a key holds.  One pass over each partition takes
the totals of its own rows.  Only the first key of a partition can have begun in an
earlier one, so what earlier partitions add is at most one row for each partition: the
sums of the key's earlier partitions, or, for a trailing mean, the few values before the
partition's first row (its halo).  These rows are broadcast and added.

An operator's input is computed once, unless it is only read from files; no task holds more than a partition and no key has
a plan of its own.  Null keys are keys; null values count as 0 in sums and not at all
in means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chatledger.sources.tables import checkpointed, forget, is_scan

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Where a row stands: its partition, its place in it, whether its key is the first of the
#: partition, and whether it is the partition's last row.
PLACE = "part_ int, at_ long, first_ boolean, last_ boolean"


class Runs:
    """Finds where runs of equal keys start in the batches of a sorted partition."""

    def __init__(self, names: Sequence[str], keys: Sequence[str]):
        self.at = [list(names).index(k) for k in keys]
        self.last: tuple | None = None

    def starts(self, batch: pa.RecordBatch) -> np.ndarray:
        """Whether each row is the first of its run; runs go on from batch to batch."""
        columns = [batch.column(i) for i in self.at]
        out = np.zeros(batch.num_rows, bool)
        for c in columns:
            missing = np.asarray(pc.is_null(c).to_numpy(zero_copy_only=False), bool)
            differs = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            out[1:] |= np.asarray(differs, bool) | (missing[1:] != missing[:-1])
        out[0] = self.last != tuple(c[0].as_py() for c in columns)
        self.last = tuple(c[-1].as_py() for c in columns)
        return out


def key_order(keys: Sequence[str], order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*keys, *order)]


def in_key_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df``, written unless it is just read from files, in even partitions sorted by key and
    order.  (A range exchange computes its input twice, to find the bounds first.)"""
    by = key_order(keys, order)
    written = df if is_scan(df) else checkpointed(df, "in-key-order")
    ranged = written.repartitionByRange(parts, *by) if parts else written.repartitionByRange(*by)
    ordered = ranged.sortWithinPartitions(*by)
    ordered.written_path = None if written is df else written.written_path
    return ordered


def ordered_pass(
    rows: DataFrame,
    keys: Sequence[str],
    dropped: Sequence[str],
    added: str,
    make: Callable[[], Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]]],
) -> DataFrame:
    """One pass over sorted partitions, its result written; what ``in_key_order`` wrote for
    it is deleted.

    ``make()`` gives a function of a batch and its run starts that returns the ``added``
    columns; it is called once for each partition and may keep state.  The columns
    of ``PLACE`` are added too, and ``dropped`` columns left out.
    """
    names, keys = rows.columns, list(keys)
    kept = [n for n in names if n not in dropped]
    fields = [rows.schema[n] for n in kept]
    schema = T.StructType([*fields, *T._parse_datatype_string(f"{added}, {PLACE}").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, first = TaskContext.get().partitionId(), 0, True
        runs, step, waiting = Runs(names, keys), make(), None

        def placed(batch: list, size: int, start: int, leading: np.ndarray, ends: bool) -> pa.RecordBatch:
            last = np.zeros(size, bool)
            last[-1] = ends
            place = [np.full(size, part, np.int32), np.arange(start, start + size), leading, last]
            columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip([*batch, *map(pa.array, place)], arrow)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = runs.starts(batch)
            later = starts.copy()
            later[0] &= at > 0
            leading = (np.cumsum(later) == 0) & first
            first = bool(leading[-1])
            columns = [batch.column(names.index(n)) for n in kept] + step(batch, starts)
            if waiting is not None:
                yield placed(*waiting, False)
            waiting, at = (columns, batch.num_rows, at, leading), at + batch.num_rows
        if waiting is not None:
            yield placed(*waiting, True)

    result = checkpointed(rows.mapInArrow(run, schema), "ordered-pass")
    forget(rows)
    return result


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _summing(at: Sequence[int]):
    def make():
        carried = [0] * len(at)

        def step(batch: pa.RecordBatch, starts: np.ndarray) -> list[pa.Array]:
            begin = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
            going_on = np.cumsum(starts) == 0
            out = []
            for n, i in enumerate(at):
                v = _numbers(batch.column(i))
                sums = np.cumsum(v)
                totals = sums - (sums - v)[begin] + np.where(going_on, carried[n], v.dtype.type(0))
                carried[n] = totals[-1]
                out.append(pa.array(totals))
            return out

        return step

    return make


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order_ms: str,
    tie: str,
    totals: Mapping[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Add a column per entry of ``totals``: the sum over the key's rows up to and
    including this one, in ``(order_ms, tie)`` order.

    Whole numbers are summed as bigint, others as double.  ``parts`` sets the number of
    partitions, otherwise the session does.
    """
    keys, names = list(keys), list(totals)
    valued = df.select("*", *[e.alias(f"value_{n}") for n, e in totals.items()])
    whole = {n: isinstance(valued.schema[f"value_{n}"].dataType, INTEGRAL) for n in names}
    types = {n: "bigint" if whole[n] else "double" for n in names}
    value = {n: F.coalesce(F.col(f"value_{n}").cast(types[n]), F.lit(0).cast(types[n])) for n in names}
    valued = valued.select(*df.columns, *[value[n].alias(f"value_{n}") for n in names])
    rows = in_key_order(valued, keys, [order_ms, tie], parts)
    values = [f"value_{n}" for n in names]
    summing = _summing([rows.columns.index(v) for v in values])
    added = ", ".join(f"`sum_{n}` {types[n]}" for n in names)
    run = ordered_pass(rows, keys, values, added, summing)

    ends = run.where("last_").select(*keys, "part_", F.lit(False).alias("begins_"), *[f"sum_{n}" for n in names])
    begins = run.where("at_ = 0").select(
        *keys, "part_", F.lit(True).alias("begins_"), *[F.lit(None).cast(types[n]).alias(f"sum_{n}") for n in names]
    )
    earlier = Window.partitionBy(*keys).orderBy("part_").rangeBetween(Window.unboundedPreceding, -1)
    before = ends.union(begins).select(
        F.col("part_").alias("of_"), "begins_", *[F.sum(f"sum_{n}").over(earlier).alias(f"before_{n}") for n in names]
    )
    # At most one row a partition.
    before = F.broadcast(before.where("begins_").drop("begins_"))
    joined = run.join(before, (F.col("part_") == F.col("of_")) & F.col("first_"), "left")
    zero = F.lit(0)
    return joined.select(
        *df.columns, *[(F.col(f"sum_{n}") + F.coalesce(f"before_{n}", zero)).cast(types[n]).alias(n) for n in names]
    )


def _trailing(at: int, rows: int, integral: bool):
    def make():
        kind = np.int64 if integral else np.float64
        behind, known, length = np.zeros(0, kind), np.zeros(0, bool), 0

        def step(batch: pa.RecordBatch, starts: np.ndarray) -> list[pa.Array]:
            nonlocal behind, known, length
            column = batch.column(at)
            have = ~np.asarray(pc.is_null(column).to_numpy(zero_copy_only=False), bool)
            v = _numbers(pc.fill_null(column, 0)).astype(kind)
            index = np.arange(len(v))
            begin = np.maximum.accumulate(np.where(starts, index, -length))
            nth = index - begin + 1
            # Values behind the batch that its first run can still reach, then the batch's own.
            held = len(behind)
            row, flags = np.concatenate([behind, v]), np.concatenate([known, have])
            count = np.concatenate([[0], np.cumsum(flags)])
            reach = np.minimum(nth, rows)
            low, high = index + held + 1 - reach, index + held + 1
            counts = count[high] - count[low]
            if integral:
                total = np.concatenate([[0], np.cumsum(row)])
                sums = total[high] - total[low]
            else:
                # Frames are added up one by one: differences of long sums would lose digits.
                padded = np.concatenate([np.zeros(rows), row])
                sums = np.zeros(len(v))
                for back in range(rows):
                    sums += np.where(back < reach, padded[rows + high - 1 - back], 0.0)
            length = int(nth[-1])
            keep = min(length, rows - 1)
            behind, known = row[len(row) - keep :], flags[len(flags) - keep :]
            tail = [int(x) if integral else float(x) for x in behind]
            tail = [x if k else None for x, k in zip(tail, known.tolist())]
            # The batch's last row carries what later partitions may need.
            tails = pa.array([None] * (len(v) - 1) + [tail], pa.list_(pa.int64() if integral else pa.float64()))
            return [pa.array(nth), pa.array(sums), pa.array(counts.astype(np.int64)), tails]

        return step

    return make


def trailing_mean(
    df: DataFrame,
    keys: Sequence[str],
    order_ms: str,
    tie: str,
    value: str,
    rows: int,
    name: str,
    parts: int | None = None,
) -> DataFrame:
    """Add ``name``: mean of ``value`` over the last ``rows`` rows of the key."""
    if rows < 1:
        raise ValueError("a frame has at least one row")
    keys = list(keys)
    integral = isinstance(df.schema[value].dataType, INTEGRAL)
    kind = "bigint" if integral else "double"
    valued = df.withColumn("value_", F.col(value).cast(kind))
    sorted_rows = in_key_order(valued, keys, [order_ms, tie], parts)
    step = _trailing(sorted_rows.columns.index("value_"), rows, integral)
    added = f"nth_ long, sum_ {kind}, count_ long, tail_ array<{kind}>"
    run = ordered_pass(sorted_rows, keys, ["value_"], added, step)

    ends = run.where("last_").select(*keys, "part_", F.lit(1).alias("kind_"), "tail_")
    begins = run.where("at_ = 0").select(*keys, "part_", F.lit(0).alias("kind_"), F.lit(None).cast(f"array<{kind}>").alias("tail_"))
    # Every earlier partition of the key has at least one of the values that are needed.
    near = Window.partitionBy(*keys).orderBy("part_", "kind_").rowsBetween(-2 * rows, -1)
    halo = F.flatten(F.collect_list("tail_").over(near))
    halos = ends.union(begins).select(F.col("part_").alias("of_"), "kind_", halo.alias("halo_"))
    halos = F.broadcast(halos.where("kind_ = 0").drop("kind_"))
    joined = run.join(halos, (F.col("part_") == F.col("of_")) & F.col("first_"), "left")
    needed = F.least(F.greatest(rows - F.col("nth_"), F.lit(0)), F.size("halo_")).cast("int")
    taken = F.when((F.col("nth_") < rows) & (needed > 0), F.slice("halo_", -needed, needed))
    taken = F.coalesce(taken, F.array().cast(f"array<{kind}>"))
    more = F.aggregate("taken_", F.lit(0).cast(kind), lambda s, x: s + F.coalesce(x, F.lit(0).cast(kind)))
    known = F.size(F.filter("taken_", lambda x: x.isNotNull()))
    total, count = F.col("sum_") + more, F.col("count_") + known
    return joined.withColumn("taken_", taken).select(
        *df.columns, F.when(count > 0, total.cast("double") / count).alias(name)
    )


def carried_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, parts: int | None = None
) -> DataFrame:
    """Add ``name``: the last known whole number of ``value`` in the key's rows up to this one."""
    keys = list(keys)
    rows = in_key_order(df, keys, order, parts)
    at = rows.columns.index(value)

    def make():
        carried: int | None = None

        def step(batch: pa.RecordBatch, starts: np.ndarray) -> list[pa.Array]:
            nonlocal carried
            column = batch.column(at)
            known = ~np.asarray(pc.is_null(column).to_numpy(zero_copy_only=False), bool)
            v, index = _numbers(pc.fill_null(column, 0)).astype(np.int64), np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(starts, index, -1))
            latest = np.maximum.accumulate(np.where(known, index, -1))
            here = latest >= np.maximum(begin, 0)
            out = np.where(here, v[latest], 0 if carried is None else carried)
            missing = ~here & ((begin >= 0) | (carried is None))
            carried = None if missing[-1] else int(out[-1])
            return [pa.array(out, mask=missing)]

        return step

    run = ordered_pass(rows, keys, [], "carried_ bigint", make)
    ends = run.where("last_").select(*keys, "part_", F.lit(1).alias("kind_"), "carried_")
    begins = run.where("at_ = 0").select(*keys, "part_", F.lit(0).alias("kind_"), F.lit(None).cast("bigint").alias("carried_"))
    earlier = Window.partitionBy(*keys).orderBy("part_", "kind_").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.union(begins).select(
        F.col("part_").alias("of_"), "kind_", F.last("carried_", ignorenulls=True).over(earlier).alias("before_")
    )
    before = F.broadcast(before.where("kind_ = 0").drop("kind_"))
    joined = run.join(before, (F.col("part_") == F.col("of_")) & F.col("first_"), "left")
    return joined.select(*df.columns, F.coalesce("carried_", "before_").alias(name))
