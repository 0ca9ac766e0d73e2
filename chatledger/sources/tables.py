"""The response-cache and audit tables, and the shared folder for written data."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from chatledger.operators import cache
from chatledger.schemas import AUDIT_LOG, RESPONSE_CACHE


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/chatledger/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a stage boundary that
    outlives executors and is computed once however often it is read.  ``forget`` deletes
    it when nothing reads it any more."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def forget(df: DataFrame) -> None:
    """Delete what :func:`checkpointed` wrote for a frame; other frames are left alone."""
    path = getattr(df, "written_path", None)
    if path:
        spark = df.sparkSession
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)


def is_scan(df: DataFrame) -> bool:
    """Whether a frame is files read, filtered and projected, and no more: such a frame may be
    computed again where another one had better be written."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().split(" ")[0] not in ("Project", "Filter", "LogicalRelation", "Relation"):
            return False
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_response_cache(
    df: DataFrame, table: str, path: str | None = None, buckets: int = 64
) -> None:
    """Write a new version of the cache as a table bucketed by ``hash``.

    Bucketing stands in for the primary key: lookups and upserts on ``hash``
    read matching buckets together and need no exchange of the cache side.
    """
    out = _conform(df, RESPONSE_CACHE).repartition(buckets, "hash")
    writer = out.write.format("parquet").bucketBy(buckets, "hash").sortBy("hash")
    if path:
        writer = writer.option("path", path)
    writer.mode("overwrite").saveAsTable(table)


def read_response_cache(spark: SparkSession, table: str) -> DataFrame:
    return _conform(spark.read.table(table), RESPONSE_CACHE)


# Audit rows lie in one folder per UTC day, so that day filters prune, and in it one folder
# per batch, so that a batch written twice replaces itself.


def append_audit(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append audit rows.  Rows of a ``batch`` already there are replaced day by day: a batch
    that is written again after a failure counts once."""
    day = F.date_format(F.timestamp_millis(F.col("timestamp")), "yyyy-MM-dd")
    rows = _conform(df, AUDIT_LOG).withColumns({"day": day, "batch": F.lit(batch or uuid.uuid4().hex)})
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day", "batch").parquet(path)


def append_audit_stream(rows: DataFrame, path: str, name: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream of audit rows, each exactly once.

    A micro-batch is the batch ``name-number`` of :func:`append_audit`: one that is
    replayed from ``checkpoint`` after a failure replaces what it had written.  Streams into
    one folder need names of their own.  Set a trigger and ``start()`` it.
    """
    if not re.fullmatch(r"\w+", name):
        raise ValueError("a stream's name is made of letters, digits and underscores")

    def write(batch: DataFrame, number: int) -> None:
        append_audit(batch, path, f"{name}-{number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_audit(
    spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """Audit rows, of the given UTC days (``yyyy-MM-dd``) only if any are given."""
    parts = [T.StructField("day", T.DateType()), T.StructField("batch", T.StringType())]
    rows = spark.read.schema(T.StructType([*AUDIT_LOG.fields, *parts])).parquet(path)
    if first_day:
        rows = rows.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day:
        rows = rows.where(F.col("day") <= F.lit(last_day).cast("date"))
    return rows.drop("day", "batch")


class VersionedCache:
    """The response cache as a folder of versions, changed in place.

    Entries lie in buckets of their hash.  A version is a small file that names, for each
    bucket, the folder that holds it; publishing writes folders for the buckets that
    changed and then creates the next version's file.  Buckets that did not change are
    neither read nor written, a frame read before keeps its version's folders, and of
    two writers that began with the same version the second fails with nothing lost.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """The cache at ``path``; ``buckets`` holds for a new one, an old one keeps its own."""
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
        version = self.version()
        self.buckets = buckets if version is None else self._manifest(version)["buckets"]

    # Versions

    def versions(self) -> list[int]:
        folder = self._paths(f"{self.path}/versions")
        if not self._system.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._system.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def _manifest(self, version: int) -> dict:
        stream = self._system.open(self._paths(f"{self.path}/versions/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, folders: dict[str, str]) -> None:
        """Creates a version's file; that fails if another writer has created it."""
        text = json.dumps({"buckets": self.buckets, "folders": folders})
        draft = self._paths(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = self._system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._system.mkdirs(self._paths(f"{self.path}/versions"))
        target = self._paths(f"{self.path}/versions/{version}")
        # A rename that finds its target taken does nothing.
        if self._system.exists(target) or not self._system.rename(draft, target):
            raise RuntimeError(f"version {version} of {self.path} was published by another writer")

    # Reading

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("hash"), F.lit(self.buckets)).cast("int")

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], RESPONSE_CACHE)
        return self.spark.read.schema(RESPONSE_CACHE).parquet(*sorted(folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The entries of a version, by default the newest; none before the first."""
        version = self.version() if version is None else version
        return self._read([] if version is None else list(self._manifest(version)["folders"].values()))

    # Changes

    def _publish(self, touched: Sequence[int], change: Callable[[DataFrame], DataFrame]) -> int:
        """Replaces the touched buckets by ``change`` of their entries."""
        base = self.version()
        folders = {} if base is None else dict(self._manifest(base)["folders"])
        old = [folders[str(b)] for b in touched if str(b) in folders]
        number, here = (0 if base is None else base + 1), f"{self.path}/data/{uuid.uuid4().hex}"
        rows = _conform(change(self._read(old)), RESPONSE_CACHE).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").parquet(here)
        for b in touched:
            made = f"{here}/bucket={b}"
            if self._system.exists(self._paths(made)):
                folders[str(b)] = made
            else:
                folders.pop(str(b), None)
        self._commit(number, folders)
        return number

    def _touched(self, hashes: DataFrame) -> list[int]:
        """Buckets that hold any of ``hashes``: at most ``buckets`` numbers."""
        return [r["b"] for r in hashes.where("hash IS NOT NULL").select(self._bucket().alias("b")).distinct().collect()]

    def publish(self, entries: DataFrame) -> int:
        """A version of just these entries."""
        return self._publish(range(self.buckets), lambda old: entries)

    def upsert(self, entries: DataFrame) -> int:
        entries = checkpointed(_conform(entries, RESPONSE_CACHE), "upsert")
        return self._publish(self._touched(entries), lambda old: cache.cache_upsert(old, entries))

    def touch(self, hits: DataFrame) -> int:
        """``hits``: ``hash, now_ms`` of answered requests."""
        hits = checkpointed(hits.select("hash", "now_ms"), "hits")
        return self._publish(self._touched(hits), lambda old: cache.cache_touch(old, hits))

    def evict(self, listed: DataFrame | None = None) -> int:
        """Drops the listed hashes, or everything."""
        if listed is None:
            return self._publish(range(self.buckets), lambda old: cache.cache_evict(old))
        listed = checkpointed(listed.select("hash"), "evict")
        return self._publish(self._touched(listed), lambda old: cache.cache_evict(old, listed))

    def prune(self, now_ms: Column | int) -> int:
        """Drops expired entries; only buckets that hold some are rewritten."""
        now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
        dead = self.read().where((F.col("ttl_ms") > 0) & (now - F.col("created_at") > F.col("ttl_ms")))
        return self._publish(self._touched(dead), lambda old: cache.cache_prune_expired(old, now_ms))

    def vacuum(self, keep: int = 2) -> None:
        """Forgets all but the newest ``keep`` versions and deletes folders that none of these
        names.  Frames of forgotten versions can no longer be read, and no writer may be
        at work."""
        versions = self.versions()
        kept = versions[-keep:] if keep > 0 else []
        for version in versions:
            if version not in kept:
                self._system.delete(self._paths(f"{self.path}/versions/{version}"), False)
        named = {f for v in kept for f in self._manifest(v)["folders"].values()}
        data = self._paths(f"{self.path}/data")
        if not self._system.exists(data):
            return
        for write in self._system.listStatus(data):
            for bucket in self._system.listStatus(write.getPath()):
                name = bucket.getPath().getName()
                if f"{self.path}/data/{write.getPath().getName()}/{name}" not in named:
                    self._system.delete(bucket.getPath(), True)
