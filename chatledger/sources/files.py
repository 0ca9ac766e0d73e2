"""Directory scan: one row per file, then one row per secret.

Spark's own file listing leaves out names that begin with a dot or an underscore,
which a scan for secrets must see.  Folders are therefore listed by tasks, a level of the
tree at a time, and files are read by tasks, through the client of the store that their URI
names.  Symbolic links are not followed: neither a loop nor a link out of the tree is
entered.  What cannot be listed or read, and a file of more than ``MOST_BYTES``, is a row
with an ``error``.  Stores that only Hadoop knows are read by Spark, without hidden names.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger.operators.scanning import scan_findings
from chatledger.rules import RULES, Rule
from chatledger.sources.tables import checkpointed, shared_path

# Directories and files of these names are passed over.
SKIPPED = ("node_modules", ".git", "dist")
#: A text is one value of a row; a larger file is not read.
MOST_BYTES = 1 << 30
#: Schemes that Hadoop spells otherwise than the stores' clients.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
CLIENTS = ("s3", "gs", "hdfs")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, relative ones made absolute.  Stores
    with a client of their own need none in Hadoop."""
    if _scheme(path) in (*CLIENTS, *SCHEMES):
        return path
    jvm = spark._jvm
    made = jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(made).toString()


def _scheme(uri: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    return found[1].lower() if found else ""


def _local(uri: str) -> str | None:
    found = re.match(r"file:(?://)?(/.*)", uri)
    return found[1] if found else None


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if local := _local(uri):
        return fs.LocalFileSystem(), local
    scheme = _scheme(uri)
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + uri[len(scheme) :])


def _entries(folder: str) -> list[tuple[str, bool]]:
    """Names of the files and folders in a folder, links and special files left out."""
    if local := _local(folder):
        with os.scandir(local) as found:
            return [(e.name, e.is_dir(follow_symlinks=False)) for e in found if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)]
    system, root = _opened(folder)
    found = system.get_file_info(fs.FileSelector(root))
    known = (fs.FileType.Directory, fs.FileType.File)
    return [(i.base_name, i.type == fs.FileType.Directory) for i in found if i.type in known]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, folder, error`` of what the folders hold."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            try:
                found = [(posixpath.join(folder, n), d, None) for n, d in _entries(folder) if n not in SKIPPED]
            except (OSError, pa.ArrowException) as e:
                found = [(folder, False, f"{type(e).__name__}: {e}")]
            columns = zip(*found) if found else ([], [], [])
            types = (pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "folder", "error"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, error in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = None
            if error is None:
                try:
                    system, name = _opened(path)
                    with system.open_input_stream(name) as file:
                        data = file.read(MOST_BYTES + 1)
                    if len(data) > MOST_BYTES:
                        error = f"more than {MOST_BYTES} bytes"
                    else:
                        text = data.decode("utf-8", "replace")
                except (OSError, pa.ArrowException) as e:
                    error = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["path", "text", "error"]
            )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, error`` of every file under a folder, or of the one file it names.  Names in
    ``SKIPPED`` are passed over below the root only."""
    root = qualified(spark, path)
    system, name = _opened(root)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return spark.createDataFrame([(root, None)], "path string, error string")
    files, folders = None, spark.createDataFrame([(root,)], "path string")
    while True:
        level = checkpointed(folders.mapInArrow(_list, "path string, folder boolean, error string"), "listing")
        here = level.where("NOT folder").select("path", "error")
        files = here if files is None else files.union(here)
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            return files
        folders = folders.repartition("path")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text, error)`` for every file under ``path``, skipped folders left out; bytes
    that are not UTF-8 become replacement characters."""
    root = qualified(spark, path)
    if _local(root) is None and SCHEMES.get(_scheme(root), _scheme(root)) not in CLIENTS:
        return _read_by_spark(spark, root)
    # Paths say nothing of how much is to be read: a few bytes of them would be merged into one task.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    files = list_files(spark, path).repartition(tasks, "path")
    return files.mapInArrow(_read, "path string, text string, error string")


def _read_by_spark(spark: SparkSession, root: str) -> DataFrame:
    below = F.substring_index("path", root.rstrip("/"), -1)
    skipped = F.exists(F.split(below, "/"), lambda n: n.isin(*SKIPPED))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    fits = F.col("length") <= MOST_BYTES
    text = F.when(fits, F.decode("content", "UTF-8"))
    error = F.when(~fits, F.lit(f"more than {MOST_BYTES} bytes"))
    return found.where(~skipped).select("path", text.alias("text"), error.alias("error"))


def write_text_files(texts: DataFrame, name: str) -> str:
    """Write every row's ``text`` to its ``path`` in a new shared folder, and return that."""
    folder = qualified(texts.sparkSession, shared_path(texts.sparkSession, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, target = _opened(posixpath.join(folder, path))
                system.create_dir(posixpath.dirname(target), recursive=True)
                with system.open_output_stream(target) as file:
                    file.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    texts.select("path", "text").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
    return folder


def scan_files(
    spark: SparkSession, path: str, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Findings of every file under ``path`` (or of the one file it names), and a row with an
    ``error`` and no finding for what could not be read."""
    return scan_findings(read_text_files(spark, path), "path", "text", rules=rules, error="error")
