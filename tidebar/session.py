"""Session defaults and lineage cuts."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[tuple[str, str, str], str] = {}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidebar")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.streaming.noDataMicroBatches.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(scratch)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write a derived table once per application and read it back.

    The bar, feature and label tables feed many jobs, so each is computed once and
    kept as Parquet in the shared checkpoint folder, where a lost executor cannot
    take it along.
    """
    app = spark.sparkContext.applicationId
    slot = (app, source, name)
    path = _TABLES.get(slot)
    if path is None:
        digest = hashlib.md5(source.encode()).hexdigest()[:12]
        path = f"{checkpoint_root(spark)}/tidebar-{app}/{digest}/{name}"
        build().write.mode("overwrite").parquet(path)
        _TABLES[slot] = path
    return spark.read.parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's address below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/tidebar-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back; unlike a checkpoint, the plan then knows its size."""
    df.write.parquet(path := fresh(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared checkpoint folder and read it from there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint()
