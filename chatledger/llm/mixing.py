"""Mixing sources to target weights.

Documents get a hash-random key and are range-sorted by source and key, which spreads a
large source over many partitions.  Within each sorted partition a running sum of
sizes is taken, and the sums of a source's earlier partitions are added: distributed
prefix sums.  The words of a source form a circle in that order; the mix takes the
first ``target`` of them, going round again (another epoch) where the target is
larger than the source, and cuts exactly there, if need be within a document.

Targets share out the total of all sizes by weight.  No source is taken more than
``most_epochs`` times; what is above that goes to the other sources by weight until
none is above (the level at which that ends is the largest of the levels that stopping
after each source, in order of capacity for its weight, would give).

Null texts have size 0; null is a source of its own, after the others.  Equal rows
are mixed each on its own.  Sources are one row each in one task while targets are set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatledger.llm.common import Scratch

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` for one row ``source, source_size`` a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), number + 1)
    room = F.col("source_size") * most_epochs
    rows = sizes.select("source", "source_size", weight.cast("long").alias("weight"), room.alias("room"))
    by_level = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0))
    rows = rows.withColumn("stop", left / F.sum("weight").over(after))
    level = F.max("stop").over(everything) * F.col("weight")
    return rows.select("source", "source_size", F.least(F.col("room").cast("double"), level).alias("target"))


def _running(source_at: int, size_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the partition's number and the sum of earlier sizes of the row's source in it."""
        part = TaskContext.get().partitionId()
        source, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(source_at).cast(pa.string())
            sizes = batch.column(size_at).to_numpy(zero_copy_only=False)
            # A row starts a source if its name differs from the one before, nulls alike.
            same = pc.equal(names[1:], names[:-1]).fill_null(False)
            both_null = pc.and_(pc.is_null(names[1:]), pc.is_null(names[:-1]))
            starts = np.flatnonzero(~pc.or_(same, both_null).to_numpy(zero_copy_only=False).astype(bool)) + 1
            if names[0].as_py() != source:
                total = 0
            sums = np.cumsum(sizes) - sizes
            base = np.zeros(batch.num_rows, np.int64)
            base[starts] = np.diff(np.concatenate([[0], sums[starts]]))
            inside = sums - np.cumsum(base)
            first = starts[0] if len(starts) else batch.num_rows
            inside[:first] += total
            source, total = names[-1].as_py(), int(inside[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(inside, pa.int64())],
                names=[*batch.schema.names, "part_", "before_"],
            )

    return run


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = SEED
) -> DataFrame:
    """``docs`` (``doc_id, source, size`` and others) with ``source_size``, ``target`` of its
    source and ``taken``, the words the mix takes of it, repeats counted."""
    docs = docs.drop("source_size", "target", "taken", "part_", "before_", "key_", "offset_")
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    order = [F.col("source").asc_nulls_last(), F.col("key_"), F.col("doc_id"), F.col("size")]
    rows = docs.withColumn("size", F.col("size").cast("long")).withColumn("key_", key)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("key_")
    schema = T.StructType([*rows.schema.fields, T.StructField("part_", T.IntegerType()), T.StructField("before_", T.LongType())])
    run = _running(rows.columns.index("source"), rows.columns.index("size"))
    rows = scratch.write(rows.mapInArrow(run, schema), "sorted")

    parts = scratch.write(rows.groupBy("source", "part_").agg(F.sum("size").alias("sum_")), "parts")
    earlier = Window.partitionBy("source").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("source").alias("source_"), F.col("part_").alias("of_"),
        F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("offset_"),
    )
    sizes = parts.groupBy("source").agg(F.sum("sum_").alias("source_size"))
    targets = scratch.write(source_targets(sizes, weights, most_epochs), "targets")
    offsets = scratch.write(
        offsets.join(targets, F.col("source_").eqNullSafe(F.col("source"))).drop("source"), "offsets"
    )
    found = rows.join(offsets, (F.col("part_") == F.col("of_")) & F.col("source").eqNullSafe(F.col("source_")))
    budget = F.floor(F.col("target") + 0.5)
    size, total = F.col("size"), F.greatest(F.col("source_size"), F.lit(1))
    rest = F.pmod(budget, total) - (F.col("before_") + F.col("offset_"))
    taken = F.floor(budget / total) * size + F.greatest(F.lit(0), F.least(rest, size))
    return found.select(*docs.columns, "source_size", "target", taken.cast("long").alias("taken"))


def oracle(seed: str = SEED) -> str:
    """DuckDB SQL for the mix of ``documents``."""
    return rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source
), stops AS (
  SELECT *, 3 * source_size AS room,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
      ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (
      ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS stop
  FROM sizes
), targets AS (
  SELECT source, source_size, least(room::DOUBLE, max(stop) OVER () * weight) AS target FROM stops
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
    greatest(t.source_size, 1) AS total,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{seed}:' || d.doc_id::VARCHAR), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((budget // total) * size + greatest(0, least(budget % total - before, size)))::BIGINT AS taken
FROM placed
"""
