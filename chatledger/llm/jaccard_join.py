"""Similarity join of documents on the Jaccard similarity of their word n-grams.

A document's set of five-word shingles is summed up as a *point*: shingles are
hashed into groups, and the point holds how many fall into each group.  Two sets
share at most the sum of the smaller coordinates of their points; a pair whose
bound is too small for the similarity is dropped, all others are verified on their
full texts.

1. One pass over the texts makes points and *anchors* (hashes of pairs of minimal
   shingles under random orders).  Texts with equal sets form one class, which a
   representative stands for from then on.
2. Classes that share an anchor meet in a block.  Two sets of similarity 0.75 share
   none of the 32 anchors with probability (1 - 0.75**2)**32 = 3e-12.
3. Every class is verified against the block leader it shares most anchors with.
   That is one pair per class, so groups of thousands of near copies become a few
   components at linear cost.
4. In blocks that still hold several components, an R-tree over the points finds
   every pair of different components whose bound allows a link.  First only the pairs
   of largest bound that would connect a block's components are verified (no more than
   the block has members), then all pairs of components that are still apart.  Pairs
   within a component cannot change the result.  Large blocks are cut into chunks of
   both sides.
5. Components of all verified links.

The tree is built on the points' ``TREE_GROUPS`` coarse coordinates, each the sum of
neighbouring fine ones; pairs that pass it are checked on all ``GROUPS``.

Nulls and texts without words have no shingles and link with nothing.  Rows that
share a doc_id count as one document that has the links of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import (
    Scratch,
    components,
    min_hashes,
    mixed,
    odd_numbers,
    shingle_hashes,
    space_words,
    word_hashes,
)

GROUPS, TREE_GROUPS = 1024, 64
BANDS, ROWS = 32, 2
#: Members of one side of an R-tree join within a task.
CHUNK = 1024
FANOUT = 16

POINT = "doc_id long, n_shingles long, set_id binary, point binary, anchors array<long>"


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(space_words(text))))


def packed(counts: np.ndarray) -> bytes:
    """A point in as few bytes a coordinate as its largest one needs."""
    top = int(counts.max(initial=0))
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def unpacked(point: bytes) -> np.ndarray:
    return np.frombuffer(point, f"<u{len(point) // GROUPS}").astype(np.int64)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("n", "set", "point", "anchors")}
        for text in batch.column(1).cast(pa.binary()):
            shingles = shingle_set(text.as_py())
            rows["n"].append(len(shingles))
            if not len(shingles):
                for k in ("set", "point", "anchors"):
                    rows[k].append(None)
                continue
            counts = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=GROUPS)
            lows = min_hashes(shingles, BANDS * ROWS, seed=11).reshape(BANDS, ROWS)
            anchors = mixed((lows * odd_numbers(ROWS, 5)).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
            rows["set"].append(md5(shingles.tobytes()).digest())
            rows["point"].append(packed(counts))
            rows["anchors"].append(anchors.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(rows["n"], pa.int64()),
                pa.array(rows["set"], pa.binary()),
                pa.array(rows["point"], pa.binary()),
                pa.array(rows["anchors"], pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "set_id", "point", "anchors"],
        )


def linked(shared: int, left: int, right: int, percent: int) -> bool:
    return 100 * shared >= percent * (left + right - shared)


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links among (src, dst, src_point, dst_point, src_text, dst_text): the bound
        first, then the exact sets."""
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            src, dst = [], []
            columns = [batch.column(i) for i in range(6)]
            for s, d, p, q, x, y in zip(*(c.cast(pa.binary()) if i > 1 else c for i, c in enumerate(columns))):
                p, q = unpacked(p.as_py()), unpacked(q.as_py())
                if not linked(int(np.minimum(p, q).sum()), int(p.sum()), int(q.sum()), percent):
                    continue
                x = x.as_py()
                if x != last[0]:
                    last = (x, shingle_set(x))
                right = shingle_set(y.as_py())
                shared = len(np.intersect1d(last[1], right, assume_unique=True))
                if linked(shared, len(last[1]), len(right), percent):
                    src.append(s.as_py())
                    dst.append(d.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


class RTree:
    """Points packed into boxes, level by level, by repeated sorting and cutting
    along the coordinates that vary most."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self._pack(points, 0, len(points))
        low, high = points[self.order], points[self.order]
        small = low.sum(axis=1)
        self.levels = [(low, high, small)]
        while len(low) > 1:
            starts = np.arange(0, len(low), FANOUT)
            low = np.minimum.reduceat(low, starts)
            high = np.maximum.reduceat(high, starts)
            small = np.minimum.reduceat(small, starts)
            self.levels.append((low, high, small))

    def _pack(self, points: np.ndarray, start: int, end: int) -> None:
        part = self.order[start:end]
        if len(part) <= FANOUT:
            return
        axis = int(np.argmax(np.ptp(points[part], axis=0)))
        self.order[start:end] = part[np.argsort(points[part, axis], kind="stable")]
        middle = start + -(-(end - start) // (2 * FANOUT)) * FANOUT
        self._pack(points, start, middle)
        self._pack(points, middle, end)


def tree_pairs(left: RTree, right: RTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Point pairs of two trees whose bound allows a link: both trees are descended
    together, and boxes whose largest possible overlap is too small for even their
    smallest sets are left out."""
    i, j = len(left.levels) - 1, len(right.levels) - 1
    a = np.zeros(1 if len(left.order) else 0, np.int64)
    b = np.zeros(len(a) if len(right.order) else 0, np.int64)
    a = a[: len(b)]
    while True:
        keep = np.zeros(len(a), bool)
        (_, high_a, small_a), (_, high_b, small_b) = left.levels[i], right.levels[j]
        for at in range(0, len(a), 65_536):
            x, y = a[at : at + 65_536], b[at : at + 65_536]
            most = np.minimum(high_a[x], high_b[y]).sum(axis=1)
            keep[at : at + 65_536] = (100 + percent) * most >= percent * (small_a[x] + small_b[y])
        a, b = a[keep], b[keep]
        if i == 0 and j == 0:
            return left.order[a], right.order[b]
        if i:
            i -= 1
            a, b = _children(a, b, len(left.levels[i][0]))
        if j:
            j -= 1
            b, a = _children(b, a, len(right.levels[j][0]))


def _children(nodes: np.ndarray, partners: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    first = nodes * FANOUT
    width = np.minimum(FANOUT, below - first)
    offsets = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    return np.repeat(first, width) + offsets, np.repeat(partners, width)


def _forest(left: np.ndarray, right: np.ndarray, order: np.ndarray) -> list[int]:
    """Numbers of the pairs that would connect components, taken in ``order``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i in order.tolist():
        x, y = root(int(left[i])), root(int(right[i]))
        if x != y:
            parent[x] = y
            kept.append(i)
    return kept


def _block_search(percent: int, forest: bool):
    def run(block: pa.Table) -> pa.Table:
        side = block["side"].to_numpy()
        nodes, parts = block["node"].to_numpy(), block["component"].to_numpy()
        fine = np.array([np.frombuffer(p.as_py(), f"<u{len(p.as_py()) // GROUPS}") for p in block["point"]])
        sizes = fine.sum(axis=1, dtype=np.int64)
        coarse = fine.reshape(len(fine), TREE_GROUPS, -1).sum(axis=2, dtype=np.int64)
        at = [np.flatnonzero(side == s) for s in (0, 1)]
        a, b = tree_pairs(*(RTree(coarse[i]) for i in at), percent)
        a, b = at[0][a], at[1][b]
        other = parts[a] != parts[b]
        a, b = a[other], b[other]
        most = np.zeros(len(a), np.int64)
        for i in range(0, len(a), 8192):
            most[i : i + 8192] = np.minimum(fine[a[i : i + 8192]], fine[b[i : i + 8192]]).sum(axis=1, dtype=np.int64)
        both = sizes[a] + sizes[b]
        ok = (100 + percent) * most >= percent * both
        a, b, likeness = a[ok], b[ok], most[ok] / both[ok]
        x, y = np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])
        if forest:
            kept = _forest(parts[a], parts[b], np.lexsort((y, x, -likeness)))
            x, y = x[kept], y[kept]
        anchor = np.full(len(x), block["anchor"][0].as_py(), np.int64)
        return pa.table({"anchor": anchor, "src": x.astype(np.int64), "dst": y.astype(np.int64)})

    return run


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    points = classes.select("node", "point").join(texts, "node")

    def side(name: str) -> DataFrame:
        return points.select(*[F.col(c).alias(f"{name}_{c}") for c in points.columns])

    both = pairs.join(side("src"), F.col("src") == F.col("src_node")).join(side("dst"), F.col("dst") == F.col("dst_node"))
    both = both.select("src", "dst", "src_point", "dst_point", "src_text", "dst_text")
    return both.mapInArrow(_verifier(percent), "src long, dst long")


def _apart(
    members: DataFrame, found: DataFrame, classes: DataFrame, scratch: Scratch, percent: int, forest: bool
) -> DataFrame:
    """``anchor, src, dst``: pairs of different components in a block that the bound allows."""
    members = members.select("anchor", "node").join(found, "node", "left")
    members = members.select("anchor", "node", F.coalesce("component", "node").alias("component"))
    members = scratch.write(members, "labelled")
    sizes = members.groupBy("anchor", "component").count()
    blocks = sizes.groupBy("anchor").agg(
        F.max_by("component", F.struct("count", "component")).alias("major"),
        F.sum("count").alias("all_"),
        (F.sum("count") - F.max("count")).alias("odd_"),
    )
    blocks = scratch.write(blocks.where("odd_ > 0"), "mixed")
    # Blocks with the same members would name the same pairs: one of them is enough.
    member_hash = F.xxhash64("node", "component")
    blocks = (
        members.join(blocks, "anchor")
        .groupBy("anchor", "major", "all_", "odd_")
        .agg(F.sum(member_hash.cast("decimal(38,0)")).alias("sum_"), F.bit_xor(member_hash).alias("xor_"))
        .groupBy("major", "all_", "odd_", "sum_", "xor_")
        .agg(F.min("anchor").alias("anchor"))
        .select("anchor", "major", *[F.ceil(F.col(c) / CHUNK).alias(n) for c, n in (("odd_", "probes"), ("all_", "builds"))])
    )
    blocks = scratch.write(blocks, "kept-blocks")
    rows = members.join(blocks, "anchor").join(classes.select("node", "point"), "node")
    draw = F.xxhash64("node")

    def dealt(side: DataFrame, own: str, other: str, number: int) -> DataFrame:
        return side.select(
            "anchor", "node", "component", "point", F.lit(number).alias("side"),
            F.pmod(draw, F.col(own)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other),
        ).select("anchor", "probes", "builds", "side", "node", "component", "point")

    probes = dealt(rows.where("component <> major"), "probes", "builds", 0)
    builds = dealt(rows, "builds", "probes", 1)
    blocks = probes.union(builds).groupBy("anchor", "probes", "builds")
    return blocks.applyInArrow(_block_search(percent, forest), "anchor long, src long, dst long")


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links of at least
    ``percent`` / 100 similarity, ``class_id`` that of the documents with an equal
    set.  A null doc_id has neither.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "jaccard-join")
    points = scratch.write(docs.mapInArrow(_points, POINT), "points")
    named = points.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    classes = scratch.write(
        named.groupBy("set_id").agg(
            F.min("doc_id").alias("node"), F.first("point").alias("point"), F.first("anchors").alias("anchors")
        ),
        "classes",
    )
    members = classes.select("node", F.explode("anchors").alias("anchor"))
    blocks = members.groupBy("anchor").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    blocks = scratch.write(blocks.where("leader < last").select("anchor", "leader"), "blocks")
    members = scratch.write(members.join(blocks, "anchor"), "members")

    # One candidate per class: the leader it shares most anchors with.
    votes = members.where("leader <> node").groupBy("node", "leader").count()
    best = votes.groupBy("node").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("src"))
    first = scratch.write(best.select("src", F.col("node").alias("dst")), "first")
    needed = members.select("node").distinct()
    texts = docs.select(F.col("doc_id").alias("node"), "text").where("text IS NOT NULL")
    texts = scratch.write(texts.join(needed, "node", "left_semi"), "texts")
    links = scratch.write(_verified(first, classes, texts, percent), "links")
    found = components(links, scratch)

    for forest in (True, False):
        more = scratch.write(_apart(members, found, classes, scratch, percent, forest), "more")
        if more.isEmpty():
            break
        pairs = more.select("src", "dst").distinct()
        links = scratch.write(links.union(_verified(pairs, classes, texts, percent)), "links")
        found = components(links, scratch)
        # A block without a pair that the bound allows is done.
        members = members.join(more.select("anchor").distinct(), "anchor", "left_semi")
    scratch.drop(texts, first)

    known = classes.select("set_id", F.col("node").alias("class_id"))
    result = points.select("doc_id", "n_shingles", "set_id").join(known, "set_id", "left")
    result = result.join(found, result["doc_id"] == found["node"], "left")
    own = result.select("doc_id", "n_shingles", "class_id", F.col("component").alias("own_"))
    by_class = found.select(F.col("node").alias("class_id"), F.col("component").alias("of_class_"))
    own = own.join(by_class, "class_id", "left")
    return own.select(
        "doc_id",
        "n_shingles",
        F.coalesce(F.least("own_", "of_class_"), "of_class_", "own_", "class_id", "doc_id").alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


#: DuckDB SQL for the registered query.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k : k + least(5, len(ws)) - 1], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS k FROM words WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared h JOIN sizes p ON h.x = p.doc_id JOIN sizes q ON h.y = q.doc_id
  WHERE 100 * h.n >= 75 * (p.n + q.n - h.n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
), parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT p.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM parts p LEFT JOIN sizes s ON p.doc_id = s.doc_id
"""
