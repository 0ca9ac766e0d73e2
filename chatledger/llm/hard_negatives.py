"""Hard negatives by an inverted multi-index.

Vectors are made of whole numbers (``floor(256 x)``) and scored by inner products, exactly.
Each half of the vector space has a codebook; the pair of nearest codewords is a vector's
cell.  The directory of cells (at most ``codes`` squared rows) holds their sizes and the
radii of both halves.  For an anchor, a codeword's half-score bound is its own half-score
plus the anchor's half-length times the codeword's radius; the multi-sequence heap takes
cells in order of the sum of both bounds, so the bound of the next cell holds for
every cell that follows.

Positives: cells are visited until some hundred rows were seen; the fifth score among
those is certified by visiting all further cells whose bound reaches it, and there the
heap stops.  Negatives: every positive opens a window of scores.  The heap runs again;
cells certainly above all windows are skipped, and it stops when the next bound is
below the last place of every window.  Both results are therefore exact.

Rows are kept by shelves: the cells of one codeword of the first half, cut into chunks of
at most about ``CHUNK`` rows.  An anchor goes to the chunks of the shelves that hold cells it
visits, with the set of those cells; large numbers of anchors are dealt into blocks.  A
chunk gives back a few rows for each anchor.

Rows with a null vec_id, label or vector, and those with a component that is null or not
finite (also after the scaling), take no part.  Vectors of different lengths are compared as
if the shorter ended in zeros.  Scores outside 64 bits count as the nearest 64-bit number.
Every row counts on its own, also one that repeats another or its vec_id; ties go to the
smaller vec_id.  Other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatledger.llm.common import Scratch

#: Codewords of a half.
CODES = 32
#: The codebooks are fitted on at most so many rows, drawn by hash; every row is indexed.
SAMPLE_ROWS = 8192
FIT_ROUNDS = 8
#: Rows an anchor sees before it sets its first limits.
PROBE = 1024
CHUNK = 2048
ANCHOR_BLOCK = 16384
LONG = np.iinfo(np.int64).max


def quantised(x: Column) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("double"))


def _vectors(vectors: DataFrame, anchors: Column) -> DataFrame:
    """Rows that take part, with whole-number vectors and a row number."""
    whole = F.transform("embedding", lambda v: v.cast("double") * 256)
    bad = F.exists("v_", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), whole.alias("v_"), anchors.alias("anchor")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v_").isNotNull() & ~bad)
    # rint of a floor: whole numbers as doubles, also beyond 64 bits.
    down = F.transform("v_", lambda v: F.when(F.rint(v) > v, F.rint(v) - 1).otherwise(F.rint(v)))
    return rows.select(F.monotonically_increasing_id().alias("at"), "vec_id", "label", down.alias("v"), "anchor")


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Rows of equal length, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) * size == len(flat):
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _fit(rows: np.ndarray, codes: int) -> np.ndarray:
    """Codewords by a few rounds of k-means from spread-out rows of the sample."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    words = rows[np.linspace(0, len(rows) - 1, min(codes, len(rows))).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        near = _nearest(rows, words)[0]
        sums = np.zeros_like(words)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(words))
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def _nearest(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the distance to it."""
    with np.errstate(all="ignore"):
        apart = (words * words).sum(axis=1) - 2 * rows @ words.T
        near = np.nan_to_num(apart, nan=np.inf).argmin(axis=1)
        rest = rows - words[near]
        return near, np.sqrt((rest * rest).sum(axis=1))


@dataclass(frozen=True)
class Index:
    """Codebooks and the directory of cells; ``size`` is the length of the vectors."""

    size: int
    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    radii: tuple[np.ndarray, np.ndarray]

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """Half-score bounds of the codewords, then of every cell: highest, lowest, middle."""
        cut = self.size // 2
        sides = []
        with np.errstate(all="ignore"):
            for words, radii, q, axis in zip(self.halves, self.radii, (v[:cut], v[cut:]), (1, 0)):
                score, length = words @ q, np.sqrt(q @ q)
                slack = 1 + 1e-9 * (np.abs(words) @ np.abs(q) + length * radii.max(axis=axis))
                sides.append((score, length, slack))
            (s1, n1, e1), (s2, n2, e2) = sides
            first = s1 + n1 * self.radii[0].max(axis=1) + e1
            second = s2 + n2 * self.radii[1].max(axis=0) + e2
            middle = s1[:, None] + s2[None, :]
            reach = n1 * self.radii[0] + n2 * self.radii[1] + e1[:, None] + e2[None, :]
            high, low = middle + reach, middle - reach
        top = np.nan_to_num
        return top(first, nan=np.inf), top(second, nan=np.inf), top(high, nan=np.inf), top(low, nan=-np.inf), top(middle)


def best_cells(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All cells by falling sum of half-score bounds: the multi-sequence heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i], b[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def _probe_positives(index: Index, v: np.ndarray, state: dict) -> Iterator[tuple[int, int]]:
    first, second, *_ = index.bounds(v)
    seen = 0
    for _, i, j in best_cells(first, second):
        if seen >= PROBE:
            return
        if index.counts[i, j]:
            seen += index.counts[i, j]
            yield i, j


def _rest_of_positives(index: Index, v: np.ndarray, state: dict) -> Iterator[tuple[int, int]]:
    first, second, high, *_ = index.bounds(v)
    done = set(_probe_positives(index, v, state))
    limit = -np.inf if state["limit"] is None else state["limit"]
    for bound, i, j in best_cells(first, second):
        if bound < limit:
            return
        if index.counts[i, j] and high[i, j] >= limit and (i, j) not in done:
            yield i, j


def _probe_negatives(index: Index, v: np.ndarray, state: dict) -> Iterator[tuple[int, int]]:
    first, second, _, low, middle = index.bounds(v)
    tops = state["tops"]
    seen = 0
    for _, i, j in best_cells(first, second):
        if seen >= PROBE:
            return
        if index.counts[i, j] and low[i, j] <= max(tops):
            seen += index.counts[i, j] if middle[i, j] <= min(tops) else 0
            yield i, j


def _rest_of_negatives(index: Index, v: np.ndarray, state: dict) -> Iterator[tuple[int, int]]:
    first, second, high, low, _ = index.bounds(v)
    done = set(_probe_negatives(index, v, state))
    tops, limits = np.array(state["tops"], float), np.array(state["limits"], float)
    least = limits.min()
    for bound, i, j in best_cells(first, second):
        if bound < least:
            return
        if index.counts[i, j] and (i, j) not in done and ((high[i, j] >= limits) & (low[i, j] <= tops)).any():
            yield i, j


def _plan(index: Index, choose: Callable, states: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each anchor and shelf it visits, with the cells as a mask."""
        width = index.counts.shape[1]
        for batch in batches:
            v = _matrix(batch.column(batch.schema.get_field_index("v")), index.size)
            known = [batch.column(batch.schema.get_field_index(s)).to_pylist() for s in states]
            rows, shelves, masks = [], [], []
            for k in range(batch.num_rows):
                shelf: dict[int, np.ndarray] = {}
                for i, j in choose(index, v[k], dict(zip(states, (s[k] for s in known)))):
                    if i not in shelf:
                        shelf[i] = np.zeros(width, np.uint8)
                    shelf[i][j] = 1
                rows += [k] * len(shelf)
                shelves += list(shelf)
                masks += [m.tobytes() for m in shelf.values()]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(shelves, pa.int32()), pa.array(masks, pa.binary())],
                names=[*batch.schema.names, "shelf", "cells"],
            )

    return run


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as the nearest 64-bit numbers."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([int(x) for x in m.ravel()], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -int(LONG), int(LONG)).astype(np.int64)


def _visit(size: int, same: bool, most: int, low: int, high: int):
    """For the anchors that visit a chunk: its best rows of the same label, or of other
    labels in each window."""

    def run(rows: pa.Table, visits: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and visits.num_rows:
            rows = rows.sort_by([("vec_id", "ascending"), ("at", "ascending")])
            b, cell = _matrix(rows.column("v"), size), rows.column("cell").to_numpy()
            at, ids = rows.column("at").to_numpy(), rows.column("vec_id").to_numpy()
            labels = rows.column("label").to_pylist()
            numbers = {x: n for n, x in enumerate(dict.fromkeys(labels))}
            label = np.array([numbers[x] for x in labels])
            for start in range(0, visits.num_rows, 256):
                part = visits.slice(start, 256)
                found = scores(_matrix(part.column("v"), size), b)
                windows = [None] * part.num_rows if same else part.column("scores").to_pylist()
                columns = (part.column(c).to_pylist() for c in ("at", "label", "cells"))
                for k, (anchor, name, cells) in enumerate(zip(*columns)):
                    ok = np.frombuffer(cells, np.uint8)[cell] != 0
                    ok &= (label == numbers.get(name, -1)) == same
                    ok &= at != anchor
                    if not same:
                        tops = [high * w // 100 for w in windows[k]]
                        floors = [-(-low * w // 100) for w in windows[k]]
                        ok &= (found[k] <= max(tops)) & (found[k] >= min(floors))
                    some = np.flatnonzero(ok)
                    some = some[np.argsort(-found[k, some], kind="stable")]
                    s = found[k, some]
                    if same:
                        out += [(anchor, 0, s[n], ids[r], at[r]) for n, r in enumerate(some[:most])]
                        continue
                    for w, top, floor in zip(windows[k], tops, floors):
                        begin = int(np.searchsorted(-s, -top, "left"))
                        for n in range(begin, min(begin + most, len(s))):
                            if s[n] >= floor:
                                out.append((anchor, w, s[n], ids[some[n]], at[some[n]]))
        columns = zip(*out) if out else [[]] * 5
        names = ["anchor_at", "window", "score", "other_id", "other_at"]
        return pa.table([pa.array([int(x) for x in c], pa.int64()) for c in columns], names=names)

    return run


def build(rows: DataFrame, scratch: Scratch, codes: int = CODES) -> tuple[Index, DataFrame]:
    """The index of ``rows(at, vec_id, label, v, anchor)``, and the rows with ``shelf`` and ``cell``."""
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    sample = rows.select("v", F.xxhash64("vec_id", "at").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("v").toArrow()
    drawn, cut = _matrix(sample.column("v"), size), size // 2
    halves = _fit(drawn[:, :cut], codes), _fit(drawn[:, cut:], codes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(batch.schema.get_field_index("v")), size)
            (i, d1), (j, d2) = _nearest(v[:, :cut], halves[0]), _nearest(v[:, cut:], halves[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(d1), pa.array(d2)],
                names=[*batch.schema.names, "shelf", "cell", "d1", "d2"],
            )

    label = rows.schema["label"].dataType.simpleString()
    placed = rows.mapInArrow(
        place, f"at long, vec_id long, label {label}, v array<double>, anchor boolean, shelf int, cell int, d1 double, d2 double"
    )
    placed = scratch.write(placed, "placed")
    shape = len(halves[0]), len(halves[1])
    counts, radii = np.zeros(shape, np.int64), (np.zeros(shape), np.zeros(shape))
    cells = placed.groupBy("shelf", "cell").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2"))
    for r in cells.collect():  # At most codes squared rows.
        counts[r["shelf"], r["cell"]] = r["n"]
        for part, d in zip(radii, (r["d1"], r["d2"])):
            part[r["shelf"], r["cell"]] = np.nan_to_num(d, nan=np.inf)
    return Index(size, halves, counts, radii), placed.drop("d1", "d2")


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, codes: int = CODES
) -> DataFrame:
    """For each anchor of ``vectors(vec_id, label, embedding)`` and each of its first ``positives``
    other rows of its label, the first ``negatives`` rows of other labels that score ``low``
    to ``high`` percent of the positive: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``."""
    scratch = Scratch(vectors.sparkSession, "hard-negatives")
    rows = scratch.write(_vectors(vectors, anchors), "vectors")
    index, placed = build(rows, scratch, codes)
    asked = placed.where("anchor").select("at", "vec_id", "label", "v")
    blocks = max(1, -(-asked.count() // ANCHOR_BLOCK))
    chunks = F.array(*[F.lit(max(1, -(-int(n) // CHUNK))) for n in index.counts.sum(axis=1)])
    of_shelf = F.element_at(chunks, F.col("shelf") + 1)
    keys = ["shelf", "chunk", "block"]
    shelved = placed.withColumn("chunk", F.pmod(F.xxhash64("at"), of_shelf).cast("int"))
    shelved = shelved.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("anchor")

    def visit(asked: DataFrame, choose: Callable, states: tuple[str, ...], same: bool, most: int) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields) + ", shelf int, cells binary"
        visits = asked.mapInArrow(_plan(index, choose, states), schema)
        visits = visits.withColumn("chunk", F.explode(F.sequence(F.lit(0), of_shelf - 1)))
        visits = visits.withColumn("block", F.pmod(F.xxhash64("at", F.lit("block")), F.lit(blocks)).cast("int"))
        found = shelved.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(
            _visit(index.size, same, most, low, high),
            "anchor_at long, window long, score long, other_id long, other_at long",
        )
        return scratch.write(first(found, most), "found")

    def first(found: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("anchor_at", "window").orderBy(F.desc("score"), "other_id", "other_at")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    probed = visit(asked, _probe_positives, (), True, positives)
    limit = probed.groupBy("anchor_at").agg(F.when(F.count("*") >= positives, F.min("score")).alias("limit"))
    limited = asked.join(limit, F.col("at") == F.col("anchor_at"), "left").drop("anchor_at")
    rest = visit(limited, _rest_of_positives, ("limit",), True, positives)
    chosen = scratch.write(first(probed.drop("rank").union(rest.drop("rank")), positives), "positives")

    windows = chosen.groupBy("anchor_at").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    tops = F.transform("scores", lambda w: F.floor(w.cast("decimal(38,0)") * high / 100).cast("double"))
    opened = asked.join(windows, F.col("at") == F.col("anchor_at")).drop("anchor_at").withColumn("tops", tops)
    opened = scratch.write(opened, "windows")
    probed = visit(opened, _probe_negatives, ("tops",), False, negatives)
    full = probed.groupBy(F.col("anchor_at").alias("full_at"), F.col("window").alias("full_window")).agg(
        F.when(F.count("*") >= negatives, F.min("score")).alias("last")
    )
    named = opened.select(F.col("at").alias("of_"), F.explode("scores").alias("window"))
    floors = F.ceil(F.col("window").cast("decimal(38,0)") * low / 100).cast("double")
    same = (F.col("of_") == F.col("full_at")) & (F.col("window") == F.col("full_window"))
    limits = named.join(full, same, "left").select("of_", "window", F.coalesce(F.col("last").cast("double"), floors).alias("least"))
    limits = limits.groupBy("of_").agg(F.sort_array(F.collect_list(F.struct("window", "least"))).alias("l_"))
    limited = opened.join(limits, F.col("at") == F.col("of_")).withColumn("limits", F.col("l_.least")).drop("of_", "l_")
    rest = visit(limited, _rest_of_negatives, ("tops", "limits"), False, negatives)
    mined = first(probed.drop("rank").union(rest.drop("rank")), negatives)

    left = chosen.select("anchor_at", F.col("score").alias("positive_score"), F.col("other_id").alias("positive_id"))
    right = mined.select(
        F.col("anchor_at").alias("of_"), F.col("window").alias("window_"), F.col("rank").cast("int").alias("rank"),
        F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    pairs = left.join(right, (F.col("anchor_at") == F.col("of_")) & (F.col("positive_score") == F.col("window_")))
    names = asked.select(F.col("at").alias("anchor_at"), F.col("vec_id").alias("anchor_id"))
    return pairs.join(names, "anchor_at").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


#: DuckDB SQL for the registered query.
ORACLE = r"""
WITH rows_ AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), scored AS (
  SELECT a.row_no, a.vec_id AS anchor_id, b.row_no AS other_no, b.vec_id AS other_id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.row_no <> b.row_no
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
  row_number() OVER (PARTITION BY p.row_no, p.other_no ORDER BY n.score DESC, n.other_id)::INT AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.row_no = n.row_no AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
