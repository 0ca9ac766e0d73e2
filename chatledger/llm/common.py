"""Helpers the operators share: written tables, word and shingle hashes, components.

Words are compared as 64-bit hashes of their UTF-8 bytes and shingles as 64-bit
mixes of five word hashes.
"""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger.sources.tables import shared_path

ROOT = str(Path(__file__).resolve().parents[2])
SHINGLE_WORDS = 5
#: Distinct words whose hashes a worker remembers before it starts anew.
WORD_CACHE = 200_000
MASK = (1 << 64) - 1


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package (a cluster gets it with ``--py-files``).
    A local session without a shared folder, as in a test, gets one of its own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="chatledger-"))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, ROOT)))
    return spark


class Scratch:
    """Tables written to the shared folder between the jobs of one operator.

    A written table cuts the lineage, outlives executors and is computed once;
    ``drop`` deletes one that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ready(spark)
        self.base = shared_path(spark, name)
        self.number = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        path = f"{self.base}/{self.number}-{name}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(conf).delete(path, True)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes split at just these."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(64)
def odd_numbers(count: int, seed: int) -> np.ndarray:
    made = [xxhash.xxh3_64_intdigest(f"{seed}:{i}".encode()) | 1 for i in range(count)]
    return np.array(made, np.uint64)


def shingle_hashes(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every run of ``width`` words, in text order; of fewer words, one
    hash of the whole sequence; of none, nothing."""
    count = len(words)
    if not count:
        return np.zeros(0, np.uint64)
    size = min(width, count)
    factors = odd_numbers(width, size)
    total = np.zeros(count - size + 1, np.uint64)
    for i in range(size):
        total += words[i : count - size + 1 + i] * factors[i]
    return mixed(total)


def min_hashes(values: np.ndarray, count: int, seed: int, chunk: int = 8192) -> np.ndarray:
    """``count`` minima of well-mixed ``values`` under random orders: those of their
    products with random odd numbers, modulo 2**64."""
    factors, out = odd_numbers(count, seed)[:, None], np.full(count, MASK, np.uint64)
    step = max(1, chunk)
    for at in range(0, len(values), step):
        part = values[at : at + step][None, :] * factors
        np.minimum(out, part.min(axis=1), out=out)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(src, dst)``: ``(node, component)``, where the
    component is its smallest node.  Null ends and loops are ignored.

    Every node keeps a parent that is never larger than itself.  In each round a
    node and its parent take the smallest grandparent seen over an edge, and
    parents are replaced by grandparents, so that the depth halves; a round is a
    fixed number of joins on written tables (whose hot keys adaptive execution
    splits) and of minima with partial aggregation.
    """
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    both = scratch.write(
        edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(),
        "edges",
    )
    parents = scratch.write(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least_"))
        .select("node", F.least("node", "least_").alias("parent")),
        "parents",
    )
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        grand = scratch.write(parents.join(up, "parent"), "grand")
        seen = both.join(grand.select(F.col("node").alias("dst"), F.col("grand").alias("offer")), "dst")
        to_node = seen.groupBy(F.col("src").alias("node")).agg(F.min("offer").alias("offer"))
        to_parent = grand.join(to_node, "node").select(F.col("parent").alias("node"), "offer")
        offers = to_node.union(to_parent).withColumn("before", F.lit(None).cast("long"))
        own = grand.select("node", F.col("grand").alias("offer"), F.col("parent").alias("before"))
        new = offers.union(own).groupBy("node").agg(F.min("offer").alias("parent"), F.max("before").alias("before"))
        new = scratch.write(new, "parents")
        settled = new.where("parent <> before").isEmpty()
        scratch.drop(grand, parents)
        parents = new.drop("before")
        parents.scratch_path = new.scratch_path
        if settled:
            break
    scratch.drop(both)
    return parents.withColumnRenamed("parent", "component")
