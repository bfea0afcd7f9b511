"""Running a stream to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import checkpoint_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB provider."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def work_folder(spark: SparkSession, name: str) -> str:
    """New folder below the shared checkpoint folder of the session."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Processes all available input once and returns what was written.

    Results go to files, one folder per micro-batch that a retry overwrites,
    never to the driver.  A stream in update mode gives a key anew in each
    batch that changes it: ``keys`` keeps its latest row.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")

    # a stream without input has no micro-batch; its result is an empty table
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    if not keys:
        return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")
    written = spark.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), F.col("batch").cast("bigint")).alias("_row"))
    return latest.select("_row.*")
