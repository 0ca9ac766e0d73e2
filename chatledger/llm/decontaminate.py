"""Benchmark decontamination by multi-pattern search in the manner of Wu and Manber.

Patterns are the windows of 13 consecutive words of the benchmark items (an item of
fewer words is one pattern).  For each pattern length a *shift table*, indexed by a
hash of two consecutive words, tells how far the search may move on: the least
distance of that block from the end of any pattern.  Where the shift is zero, the
*suffix bucket* of the block lists the patterns that end with it; those whose first
block fits too are compared word by word.

Items are cut into pieces and dealt into blocks of about ``BLOCK_WINDOWS`` windows by
a hash; the tables of a block are broadcast, and every block is searched in all
documents.  With one block no row is shuffled or written; with more, rows are written
to the shared folder between blocks.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A null text has
none.  Items with a null id or without words are left out; equal items each count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatledger.llm.common import Scratch, mixed, odd_numbers, word_hashes

WINDOW = 13
PIECE_WINDOWS = 10_000
BLOCK_WINDOWS = 200_000
#: Entries of a shift table, a power of two.
TABLE = 1 << 20

_NOT_WORD = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_SPACED = bytes.maketrans(_NOT_WORD, b" " * len(_NOT_WORD))


def benchmark_words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_SPACED).split() if text else []


@dataclass
class Patterns:
    """The tables of all patterns of one length."""

    length: int
    keys: list[bytes]
    items: list[list[int]]

    def __post_init__(self) -> None:
        self.block = min(2, self.length)
        words = word_hashes([w for k in self.keys for w in k.split(b" ")]).reshape(-1, self.length)
        reach = self.length - self.block
        hashes = np.stack([self.hashes(words[:, j : j + self.block].ravel())[:: self.block] for j in range(reach + 1)])
        slots = self.slots(hashes)
        self.shift = np.full(TABLE, reach + 1, np.uint8)
        for j in range(reach + 1):
            np.minimum.at(self.shift, slots[j], np.uint8(reach - j))
        self.first = hashes[0]
        self.order = np.argsort(slots[reach], kind="stable")
        self.suffixes = slots[reach][self.order]

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """Hash of the block that starts at each word."""
        factors = odd_numbers(2, 31)
        size = len(words) - self.block + 1
        return mixed(sum(words[i : i + size] * factors[i] for i in range(self.block)))

    @staticmethod
    def slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(TABLE - 1)).astype(np.int64)

    def search(self, words: list[bytes], hashed: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(start, pattern)`` of every occurrence."""
        if len(words) < self.length:
            return
        hashes = self.hashes(hashed)
        slots = self.slots(hashes)
        shift = self.shift[slots].tobytes()
        reach, end = self.length - self.block, len(shift)
        at = reach
        while at < end:
            step = shift[at]
            if step:
                at += step
                continue
            start = at - reach
            low, high = np.searchsorted(self.suffixes, (slots[at], slots[at] + 1))
            for p in self.order[low:high]:
                if self.first[p] == hashes[start] and self.keys[p] == b" ".join(words[start : start + self.length]):
                    yield start, int(p)
            at += 1


def tables(pieces: list[tuple[int, bytes]], window: int) -> list[Patterns]:
    """Tables of every pattern length among ``(item_id, words joined by blanks)``."""
    by_length: dict[int, dict[bytes, list[int]]] = {}
    for item, text in pieces:
        words = text.split(b" ")
        size = min(window, len(words))
        found = by_length.setdefault(size, {})
        for at in range(len(words) - size + 1):
            owners = found.setdefault(b" ".join(words[at : at + size]), [])
            if item not in owners[-1:]:
                owners.append(item)
    return [Patterns(size, list(p), list(p.values())) for size, p in sorted(by_length.items())]


def _pieces(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"item_id": [], "piece": [], "windows": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = benchmark_words(text)
                count = max(1, len(words) - window + 1) if words else 0
                for at in range(0, count, PIECE_WINDOWS):
                    size = min(PIECE_WINDOWS, count - at)
                    rows["item_id"].append(item)
                    rows["piece"].append(b" ".join(words[at : at + size + window - 1]))
                    rows["windows"].append(size)
            yield pa.RecordBatch.from_pydict(
                rows, pa.schema([("item_id", pa.int64()), ("piece", pa.binary()), ("windows", pa.int64())])
            )

    return run


FOUND = "n_words long, hit_ranges array<struct<start: int, end: int>>, items array<long>"
_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(shared, at: int, first: bool):
    """Adds the occurrences of one block of patterns to what earlier blocks have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: list[Patterns] = shared.value
        for batch in batches:
            counts, ranges, owners = [], [], []
            texts = batch.column(at).cast(pa.binary())
            for row, text in enumerate(texts):
                words = benchmark_words(text.as_py())
                items = set() if first else set(batch.column(batch.num_columns - 1)[row].as_py())
                spans = [] if first else [(r["start"], r["end"]) for r in batch.column(batch.num_columns - 2)[row].as_py()]
                if words:
                    hashed = word_hashes(words)
                    for table in patterns:
                        for start, p in table.search(words, hashed):
                            spans.append((start, start + table.length))
                            items.update(table.items[p])
                counts.append(len(words))
                ranges.append([{"start": s, "end": e} for s, e in _united(spans)])
                owners.append(sorted(items))
            kept = batch.num_columns - (0 if first else 3)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(counts, pa.int64()), pa.array(ranges, _RANGES), pa.array(owners, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:kept], "n_words", "hit_ranges", "items"],
            )

    return run


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_ranges`` (word ranges inside occurrences of a
    window, end exclusive), ``items`` (ids, ascending), ``n_hit``, ``n_items`` and
    ``contaminated`` (at least a twentieth of the words are hit).  Columns of these
    names are replaced; other columns stay, a row for a row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    docs = docs.drop("n_words", "hit_ranges", "items", "n_hit", "n_items", "contaminated")
    known = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL")
    known = known.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    pieces = scratch.write(known.mapInArrow(_pieces(window), "item_id long, piece binary, windows long"), "pieces")
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    blocks = max(1, -(-total // block_windows))
    at, columns = docs.columns.index("text"), len(docs.columns)
    found = docs
    for block in range(blocks):
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)) == block)
        rows = sorted((r["item_id"], bytes(r["piece"])) for r in mine.select("item_id", "piece").collect())
        shared = spark.sparkContext.broadcast(tables(rows, window))
        schema = T.StructType(list(found.schema.fields[:columns]) + T._parse_datatype_string(FOUND).fields)
        found = found.mapInArrow(_search(shared, at, first=block == 0), schema)
        if block < blocks - 1:
            found = scratch.write(found, "block")
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    found = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return found.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def items_digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    names = F.array_sort(F.transform(items, lambda x: x.cast("string")))
    return F.sha2(F.array_join(names, ",").cast("binary"), 256)


#: DuckDB SQL for the registered query.
ORACLE = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS size, array_to_string(ws[k : k + least(13, len(ws)) - 1], ' ') AS words
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS k FROM items WHERE len(ws) > 0)
), starts AS (
  SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k
  FROM low, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size
), hits AS (
  SELECT s.doc_id, s.k, s.size, w.item_id FROM starts s JOIN windows w
    ON s.size = w.size AND array_to_string(s.ws[s.k : s.k + s.size - 1], ' ') = w.words
), found AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(k, k + size))))) AS n_hit,
    list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM hits GROUP BY doc_id
)
SELECT l.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM low l LEFT JOIN found f ON l.doc_id = f.doc_id
"""
