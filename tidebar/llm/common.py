"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidebar.session import checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/tidebar-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a result to the shared folder and read it from there.

    Unlike a checkpoint, the table read again has the size of its files, so that joins of
    many such cuts are planned by what they hold.
    """
    df.write.parquet(path := fresh_folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: many freed small blocks otherwise stay with the process."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once; without this, Catalyst may put its expression into a lambda that runs per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lens: Column, block: int = 256) -> Column:
    """Exclusive running sums of an int array; in two levels, so that long arrays aren't copied per element."""

    def scan(xs: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")), lambda acc: acc["a"])

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocked(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(block)), lambda b: F.slice(xs, b + 1, F.lit(block)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, total), F.lit(0)), scan)))

    return let(lens, lambda xs: F.when(F.size(xs) <= block, scan(xs, F.lit(0))).otherwise(blocked(xs)))
