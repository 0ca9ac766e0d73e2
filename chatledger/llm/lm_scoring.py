"""Language-model scores by deleted interpolation.

A text's tokens are its words and one end.  The model mixes maximum-likelihood estimates of
orders 3, 2, 1 and the uniform one: an order is trusted with a weight that depends on how
often its context was seen (a bucket for each power of two), the rest goes to the next
lower order; a context never seen leaves all to it.  The weights are learned by
expectation-maximisation: a tenth of the training documents is deleted from the counts, and
the weights are fitted to the events in it.  Scores then use all counts.

Documents are packed into blocks of some megabytes.  A block sends each distinct n-gram
once, with its count, to the bucket of its hash: buckets hold even shares whatever the
n-gram's frequency, as a block sends it once.  A bucket adds up and answers
every block with counts in the order in which it was asked, so answers need no keys, and the
block looks up all of its tokens at once.  No table of the vocabulary or of n-grams is
in one place; the driver sees sums and the weights of at most 64 buckets an order.

Words are compared as 64-bit hashes, n-grams of two and three as hashes of 56 bits: among
10^12 different ones, one in some 70,000 shares its count with another.  Null texts are empty ones: a single end.  A null
doc_id belongs to the training documents and is not held out.  Every row is a document of
its own, repeated ones too.  Without training tokens all probabilities are 1.  Columns
other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chatledger.llm.common import Scratch, mixed, odd_numbers, space_words, word_hashes

ORDERS = (1, 2, 3)
#: Bits of the hashes of each order that are zero, and not sent.
SPARE = (0, 8, 8)
#: A block is closed when its texts reach so many bytes; larger ones repeat more n-grams.
BLOCK_BYTES = 10 << 20
#: n-grams that a bucket gets, about.
BUCKET_KEYS = 1 << 20
#: One of so many training documents is deleted to learn the weights.
DELETED = 10
MOST_ROUNDS, SETTLED = 12, 1e-3
#: Context counts below 2**63 fall into this many buckets, 0 for unseen.
BUCKETS = 64
SMOOTHING = 0.5
#: No word holds white space, so these stand for the end of a text and for what is before it.
END, START = word_hashes([b"\n", b" "])


def held_out(doc_id: Column) -> Column:
    """The documents that are never learned from."""
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))
    return F.coalesce(fold == 1, F.lit(False))


def _deleted(doc_id: Column) -> Column:
    name = F.concat(F.lit("deleted:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.pmod(F.crc32(name.cast("binary")), F.lit(DELETED)) == 0


# Blocks


def _pack(ids: pa.DataType):
    def row(block: int, deleted: bool, docs: list[tuple]) -> pa.RecordBatch:
        names, texts, held = zip(*docs)
        sizes = np.array([len(t) for t in texts], np.int64)
        payload = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        columns = [
            pa.array([block], pa.int64()), pa.array([deleted]), pa.array([payload], pa.binary()),
            pa.array([sizes.tobytes()], pa.binary()), pa.array([list(names)], pa.list_(ids)),
            pa.array([list(held)], pa.list_(pa.bool_())), pa.array([int(sizes.sum()) + len(docs)], pa.int64()),
            pa.array([len(docs) - sum(held)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "deleted", "payload", "sizes", "ids", "held", "bytes", "learned"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        waiting: dict[bool, list[tuple]] = {True: [], False: []}
        size = {True: 0, False: 0}
        for batch in batches:
            for doc, text, held, deleted in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or b""
                waiting[deleted].append((doc, text, held))
                size[deleted] += len(text) + 8
                if size[deleted] >= BLOCK_BYTES:
                    yield row(base + made, deleted, waiting[deleted])
                    waiting[deleted], size[deleted], made = [], 0, made + 1
        for deleted, docs in waiting.items():
            if docs:
                yield row(base + made, deleted, docs)
                made += 1

    return run


def pack(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` packed into blocks; deleted training documents have blocks of their own."""
    doc = F.col("doc_id")
    held = held_out(doc)
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), held.alias("held"), (~held & _deleted(doc)).alias("deleted"))
    ids = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("payload", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()), T.StructField("ids", T.ArrayType(ids)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("bytes", T.LongType()), T.StructField("learned", T.LongType()),
    ])
    return rows.mapInArrow(_pack(to_arrow_type(ids)), schema)


@dataclass
class Tokens:
    """Hashes of a block's n-grams, one of each order a token; ``starts`` are the documents' first tokens."""

    grams: list[np.ndarray]
    starts: np.ndarray
    known: np.ndarray  # Whether the token's document is learned from.


def _tokens(payload: bytes, sizes: bytes, held: list[bool]) -> Tokens:
    data, at, hashes, counts = zstandard.ZstdDecompressor().decompress(payload), 0, [], []
    for size in np.frombuffer(sizes, np.int64).tolist():
        words = word_hashes(space_words(data[at : at + size]))
        at += size
        hashes += [words, [END]]
        counts.append(len(words) + 1)
    w = np.concatenate(hashes).astype(np.uint64)
    counts = np.array(counts)
    starts = np.cumsum(counts) - counts
    longer = [mixed(w * odd_numbers(1, 301)[0])]
    grams = longer[:]
    before = w
    for order in ORDERS[1:]:
        # The words before each token, one place further back for each order.
        before = np.concatenate([[START], before[:-1]]).astype(np.uint64)
        before[starts] = START
        a, b = odd_numbers(2, 300 + order)
        spare = np.uint64(SPARE[order - 1])
        longer.append(mixed(longer[-1] * a + before * b))
        grams.append(longer[-1] >> spare << spare)
    return Tokens(grams, starts, ~np.repeat(np.array(held, bool), counts))


# Counts


@lru_cache(1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack_numbers(x: np.ndarray) -> bytes:
    """Numbers of 0 or more in as many bytes each as the largest needs, byte by byte of
    equal weight, so that bytes that hardly differ stand together, compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + (_codec()[0].compress(planes.T.tobytes()) if len(x) else b"")


def _unpack_numbers(data: bytes) -> np.ndarray:
    if len(data) == 1:
        return np.zeros(0, np.uint64)
    width = data[0]
    planes = np.frombuffer(_codec()[1].decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block and bucket: its distinct n-grams, as differences of sorted
        hashes, and their counts in documents that are learned from."""
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _tokens(row["payload"], row["sizes"], row["held"])
                columns: list[list[bytes]] = []
                for grams, spare in zip(tokens.grams, SPARE):
                    keys, which = np.unique(grams, return_inverse=True)
                    learned = np.bincount(which, tokens.known, len(keys)).astype(np.uint64)
                    ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                    steps = np.diff(keys, prepend=np.uint64(0))
                    packed, times = [], []
                    for bucket in range(1 << bits):
                        a, b = ends[bucket], ends[bucket + 1]
                        part = steps[a:b].copy()
                        if b > a:
                            part[0] = keys[a] - (np.uint64(bucket) << np.uint64(64 - bits))
                        packed.append(_pack_numbers(part >> np.uint64(spare)))
                        times.append(_pack_numbers(learned[a:b]))
                    columns += [packed, times]
                some = [i for i in range(1 << bits) if any(len(c[i]) > 1 for c in columns)]
                for at in range(0, len(some), 64):
                    chosen = some[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(chosen, pa.int32()), pa.array([row["block"]] * len(chosen), pa.int64()), pa.array([row["deleted"]] * len(chosen))]
                        + [pa.array([c[i] for i in chosen], pa.binary()) for c in columns],
                        names=["bucket", "block", "deleted", *(f"{x}{o}" for o in ORDERS for x in "kn")],
                    )

    return run


_ASKED = "bucket int, block long, deleted boolean, " + ", ".join(f"k{o} binary, n{o} binary" for o in ORDERS)
_COUNTS = "bucket int, block long, deleted boolean, " + ", ".join(f"c{o} binary, h{o} binary" for o in ORDERS)
_COUNTS += ", tokens long, words long, deleted_tokens long, left_words long"


def _answer(asked: pa.Table) -> pa.Table:
    """Adds up a bucket.  Blocks get all counts, those of deleted documents also the deleted
    counts; one row without a block has the bucket's share of the totals."""
    rows = asked.num_rows
    deleted = np.array(asked.column("deleted").to_pylist(), bool)
    answers: dict[str, list] = {}
    totals = (0, 0, 0, 0)
    for order, spare in zip(ORDERS, SPARE):
        keys = [np.cumsum(_unpack_numbers(k), dtype=np.uint64) << np.uint64(spare) for k in asked.column(f"k{order}").to_pylist()]
        times = [_unpack_numbers(n) for n in asked.column(f"n{order}").to_pylist()]
        sizes = np.array([len(k) for k in keys])
        which = np.unique(np.concatenate(keys), return_inverse=True)[1]
        times_flat = np.concatenate(times).astype(float)
        gone = np.where(np.repeat(deleted, sizes), times_flat, 0.0)
        most = int(which.max(initial=-1)) + 1
        every = np.bincount(which, times_flat, most).astype(np.uint64)
        held = np.bincount(which, gone, most).astype(np.uint64)
        ends = np.cumsum(sizes)
        parts = [which[b - n : b] for b, n in zip(ends, sizes)]
        answers[f"c{order}"] = [_pack_numbers(every[p]) for p in parts] + [None]
        answers[f"h{order}"] = [_pack_numbers(held[p]) if d else None for p, d in zip(parts, deleted)] + [None]
        if order == 1:
            totals = int(every.sum()), int((every > 0).sum()), int(held.sum()), int((every > held).sum())
    columns = [
        pa.array([asked.column("bucket")[0].as_py()] * (rows + 1), pa.int32()),
        pa.array(asked.column("block").to_pylist() + [None], pa.int64()),
        pa.array([*deleted.tolist(), None], pa.bool_()),
        *(pa.array(answers[f"{x}{o}"], pa.binary()) for o in ORDERS for x in "ch"),
        *(pa.array([None] * rows + [t], pa.int64()) for t in totals),
    ]
    names = ["bucket", "block", "deleted", *(f"{x}{o}" for o in ORDERS for x in "ch"), "tokens", "words", "deleted_tokens", "left_words"]
    return pa.table(columns, names=names)


@dataclass(frozen=True)
class Totals:
    """Sums over the documents learned from: tokens, distinct words, documents."""

    tokens: int
    words: int
    docs: int


def _looked_up(tokens: Tokens, counts: pa.Table, name: str) -> list[np.ndarray]:
    """The count of every token's n-grams, a column of each order."""
    out = []
    for order, grams in zip(ORDERS, tokens.grams):
        which = np.unique(grams, return_inverse=True)[1]
        answers = [_unpack_numbers(c) for c in counts.column(f"{name}{order}").to_pylist()]
        out.append(np.concatenate(answers).astype(np.int64)[which])
    return out


def _contexts(counts: list[np.ndarray], starts: np.ndarray, docs: int) -> list[np.ndarray]:
    """How often the context of each token was seen, for orders 2 and 3: the count of the
    n-gram that ends a token earlier, or that of documents at a text's start."""
    out = []
    for lower in counts[:-1]:
        seen = np.concatenate([[0], lower[:-1]])
        seen[starts] = docs
        out.append(seen)
    return out


def _bucket(seen: np.ndarray) -> np.ndarray:
    return np.frexp(seen.astype(float))[1]


# Weights


def _events(left: Totals):
    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        """Events of a block of deleted documents, by the counts without these."""
        names = ["n", "b3", "b2", "r3", "x3", "r2", "x2", "r1"]
        if not block.num_rows:
            return pa.table([pa.array([], pa.int64())] * len(names), names=names)
        row = block.to_pylist()[0]
        tokens = _tokens(row["payload"], row["sizes"], row["held"])
        counts = counts.sort_by("bucket")
        r1, r2, r3 = (a - b for a, b in zip(_looked_up(tokens, counts, "c"), _looked_up(tokens, counts, "h")))
        x2, x3 = _contexts([r1, r2, r3], tokens.starts, left.docs)
        columns = [_bucket(x3), _bucket(x2), r3, x3, r2, x2, r1]
        # Equal events are one, with their number.
        mix = np.zeros(len(r1), np.uint64)
        for c, a in zip(columns, odd_numbers(len(columns), 310)):
            mix = mixed(mix + c.astype(np.uint64) * a)
        _, first, n = np.unique(mix, return_index=True, return_counts=True)
        return pa.table([pa.array(n.astype(np.int64)), *(pa.array(c[first].astype(np.int64)) for c in columns)], names=names)

    return run


@dataclass(frozen=True)
class Weights:
    """How far order 1 is trusted, and orders 2 and 3 for each bucket of context counts."""

    one: float
    two: list[float]
    three: list[float]


def _filled(sums: dict[int, tuple[float, float]]) -> list[float]:
    """Weights by bucket; a bucket without events takes that of the next one below that has
    some, or else above.  Half an event for and half against keep them inside (0, 1)."""
    known = {b: round((used + 0.5) / (total + 1), 6) for b, (used, total) in sums.items() if b and total > 0}
    out, last = [0.0], known[min(known)] if known else 0.5
    for b in range(1, BUCKETS):
        last = known.get(b, last)
        out.append(last)
    return out


def learn(events: DataFrame, left: Totals) -> Weights:
    """Expectation-maximisation of the weights over ``events``; the driver gets
    one row of sums for each pair of buckets a round."""
    weights = Weights(0.5, _filled({}), _filled({}))
    uniform, tokens = 1 / (left.words + 1), max(1, left.tokens)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    f3, f2, f1 = share(F.col("r3"), F.col("x3")), share(F.col("r2"), F.col("x2")), F.col("r1") / F.lit(tokens)
    for _ in range(MOST_ROUNDS):
        l3 = F.element_at(F.array(*map(F.lit, weights.three)), F.col("b3").cast("int") + 1)
        l2 = F.element_at(F.array(*map(F.lit, weights.two)), F.col("b2").cast("int") + 1)
        rows = events.select("n", "b3", "b2", (l3 * f3).alias("q3"), (l2 * f2).alias("q2"), (weights.one * f1).alias("q1"), l3.alias("l3"), l2.alias("l2"))
        rows = rows.withColumn("p1", F.col("q1") + (1 - weights.one) * uniform)
        rows = rows.withColumn("p2", F.col("q2") + (1 - F.col("l2")) * F.col("p1"))
        rows = rows.withColumn("a3", F.col("n") * F.col("q3") / (F.col("q3") + (1 - F.col("l3")) * F.col("p2")))
        rows = rows.withColumn("m2", F.col("n") - F.col("a3"))
        rows = rows.withColumn("a2", F.col("m2") * F.col("q2") / F.col("p2")).withColumn("m1", F.col("m2") - F.col("a2"))
        sums = rows.groupBy("b3", "b2").agg(
            F.sum("n").alias("n"), F.sum("a3").alias("a3"), F.sum("m2").alias("m2"), F.sum("a2").alias("a2"),
            F.sum("m1").alias("m1"), F.sum(F.col("m1") * F.col("q1") / F.col("p1")).alias("a1"),
        ).collect()
        three: dict[int, tuple[float, float]] = {}
        two: dict[int, tuple[float, float]] = {}
        for r in sums:
            for table, bucket, used, total in ((three, r["b3"], r["a3"], r["n"]), (two, r["b2"], r["a2"], r["m2"])):
                before = table.get(bucket, (0.0, 0.0))
                table[bucket] = before[0] + used, before[1] + total
        total = sum(r["m1"] for r in sums)
        one = round((sum(r["a1"] for r in sums) + 0.5) / (total + 1), 6) if sums else 0.5
        new = Weights(one, _filled(two), _filled(three))
        moved = max(abs(a - b) for a, b in zip([new.one, *new.two, *new.three], [weights.one, *weights.two, *weights.three]))
        weights = new
        if moved < SETTLED:
            break
    return weights


# Scores


def _score(totals: Totals, weights: Weights):
    base = totals.tokens + SMOOTHING * (totals.words + 1)
    two, three = np.array(weights.two), np.array(weights.three)

    def mix(l: np.ndarray, part: np.ndarray, whole: np.ndarray, lower: np.ndarray) -> np.ndarray:
        l = l[_bucket(whole)]
        return l * part / np.maximum(whole, 1) + (1 - l) * lower

    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        tokens = _tokens(row["payload"], row["sizes"], row["held"])
        c1, c2, c3 = _looked_up(tokens, counts.sort_by("bucket"), "c")
        x2, x3 = _contexts([c1, c2, c3], tokens.starts, totals.docs)
        one = weights.one if totals.tokens else 0.0
        p = one * c1 / max(1, totals.tokens) + (1 - one) / (totals.words + 1)
        p = mix(three, c3, x3, mix(two, c2, x2, p))
        columns = [
            np.diff(np.append(tokens.starts, len(p))), np.add.reduceat((c1 > 0).astype(np.int64), tokens.starts),
            np.add.reduceat(np.log10((c1 + SMOOTHING) / base), tokens.starts), np.add.reduceat(np.log10(p), tokens.starts),
        ]
        ids, held = (block.column(c).combine_chunks().flatten() for c in ("ids", "held"))
        return pa.table([ids, held, *map(pa.array, columns)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of
    ``docs(doc_id, text)``: tokens, those of them seen in training, the training's tokens,
    the log10 probability by smoothed single tokens, and by the model."""
    scratch = Scratch(docs.sparkSession, "lm-scoring")
    blocks = scratch.write(pack(docs), "blocks")
    sums = blocks.agg(F.sum("bytes").alias("bytes"), F.sum("learned").alias("docs"), F.sum(F.when(~F.col("deleted"), F.col("learned"))).alias("left")).first()
    schema = T.StructType([
        T.StructField("doc_id", blocks.schema["ids"].dataType.elementType),
        T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    # Of some 6 bytes a token, each block asks for about two n-grams.
    bits = max(2, ((sums["bytes"] or 0) // 3 // BUCKET_KEYS).bit_length())
    asked = blocks.select("block", "deleted", "payload", "sizes", "held").mapInArrow(_ask(bits), _ASKED)
    counts = scratch.write(asked.groupBy("bucket").applyInArrow(_answer, _COUNTS), "counts")
    total = counts.where("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "deleted_tokens", "left_words")]).first()
    every = Totals(total["tokens"], total["words"], sums["docs"] or 0)
    left = Totals(total["tokens"] - total["deleted_tokens"], total["left_words"], sums["left"] or 0)

    texts = blocks.select("block", "deleted", "payload", "sizes", "held", "ids")
    answers = counts.where("block IS NOT NULL")
    gone = answers.where("deleted").select("block", "bucket", *(f"{x}{o}" for o in ORDERS for x in "ch"))
    names = ", ".join(f"{c} long" for c in ("n", "b3", "b2", "r3", "x3", "r2", "x2", "r1"))
    events = texts.where("deleted").groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_events(left), names)
    weights = learn(scratch.write(events, "events"), left)

    answers = answers.select("block", "bucket", *(f"c{o}" for o in ORDERS))
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(every, weights), schema)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(every.tokens).cast("long").alias("train_tokens"), "base_score", "score")
