"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans partition counts, skewed joins and broadcast choices at run time;
# the byte limits keep one task's input well inside executor memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Wide expression trees compile to long JVM methods; without this flag HotSpot
# leaves any method over 8000 bytes of bytecode uncompiled.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def build_session(app: str = "fwlog", master: str | None = None, **extra) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    b = b.config("spark.driver.extraJavaOptions", JVM_OPTIONS)
    b = b.config("spark.executor.extraJavaOptions", JVM_OPTIONS)
    return b.getOrCreate()


def local_session(app: str = "fwlog", cpus: int | None = None, **extra) -> SparkSession:
    """Session for tests and the bench: one JVM, one shuffle partition per core."""
    cpus = cpus or os.cpu_count() or 8
    return build_session(
        app,
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            **extra,
        },
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder of ``spark.checkpoint.dir``; later steps read that copy.

    Only a session whose tasks run in this process may use a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
