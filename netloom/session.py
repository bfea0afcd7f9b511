"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "netloom", memory: str = "8g",
                  partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine.

    On a cluster, use the session the cluster gives; the library sets nothing
    on it.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; sets one of its own only where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            configured = tempfile.mkdtemp(prefix="netloom-ckpt-" + str(os.getpid()))
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    Survives the loss of executors, unlike a local checkpoint.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the checkpoint folder; for tables that are read more than once."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
