"""Starting stream operators on the data that is there."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatledger.sources.tables import shared_path

NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@contextmanager
def _only_data_batches(spark: SparkSession) -> Iterator[None]:
    """Timers and time-to-live ask for one more empty batch after every batch, so a
    run over the available data would never end; here they wait for real data."""
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input, append to files, and return them as a frame."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    out = shared_path(spark, name)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", shared_path(spark, name + "-state"))
        .option("path", out)
        .trigger(availableNow=True)
    )
    with _only_data_batches(spark):
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_totals(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run a grouped stream in update mode and return each group's last state.

    Every micro-batch appends its changed groups under its number; the newest row
    per group is the current one.  A replayed batch overwrites its own folder.
    """
    spark = stream.sparkSession
    use_rocksdb(spark)
    out = shared_path(spark, name)
    # A source without rows starts no batch.
    made = spark._jvm.org.apache.hadoop.fs.Path(out)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", shared_path(spark, name + "-state"))
        .foreachBatch(write)
        .trigger(availableNow=True)
    )
    with _only_data_batches(spark):
        writer.start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    changes = spark.read.schema(schema).parquet(out)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return changes.withColumn("_n", newest).where("_n = 1").select(*stream.columns)
