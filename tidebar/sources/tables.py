"""Reading and writing bar, sample and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import finite

# Column order of the raw twelve-column feed.
RAW_SCHEMA = (
    "open_time_ms long, open string, high string, low string, close string, volume string, close_time_ms long, quote_volume string, "
    "trades long, taker_base string, taker_quote string, unused string"
)


def read_raw(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw feed rows with a declared schema; nothing is inferred."""
    reader = spark.read.schema(RAW_SCHEMA)
    return reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_bars(df: DataFrame, path: str, mode: str = "append") -> None:
    """Bars partitioned by series and UTC date, so a filter on either prunes files."""
    dated = df.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("open_time_ms") / 86_400_000).cast("int")))
    dated.write.mode(mode).partitionBy("symbol", "interval", "date").parquet(path)


def where_all(df: DataFrame, **wanted) -> DataFrame:
    """Optional equality filters; None leaves a column open, a list means any of its values."""
    conds: list[Column] = [
        F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v for c, v in wanted.items() if v is not None
    ]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def scan(spark: SparkSession, name: str, allowed: Sequence[str], condition: str | None = None) -> DataFrame:
    if name not in allowed:
        raise ValueError(f"unknown table {name}")
    df = spark.table(name)
    return df.where(condition) if condition else df


def to_layout(df: DataFrame, layout: Mapping[str, str]) -> DataFrame:
    """Declared column order and types; a missing column is filled with NULL."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in layout.items()])


def export(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], root: str, formats: Sequence[str] = ("parquet", "csv")) -> DataFrame:
    """Write every table sorted by its keys in each format and return the manifest of row counts."""
    spark = next(iter(tables.values()))[0].sparkSession
    rows = []
    for name, (df, keys) in tables.items():
        clean = df.select(*[finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
        for fmt in formats:
            writer = clean.sortWithinPartitions(*keys).write.mode("overwrite")
            writer.option("header", "true").csv(f"{root}/csv/{name}") if fmt == "csv" else writer.format(fmt).save(f"{root}/{fmt}/{name}")
        rows.append((name, spark.read.format("parquet").load(f"{root}/parquet/{name}").count() if "parquet" in formats else clean.count()))
    out = spark.createDataFrame(rows, "table string, row_count long")
    out.write.mode("overwrite").json(f"{root}/manifest")
    return out


def dictionary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column names and types of every table."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(n, c, t) for n, df in tables.items() for c, t in df.dtypes], "table string, column string, type string")


def dataset_manifest(df: DataFrame, digest: DataFrame) -> DataFrame:
    """Symbols, intervals, time range and count of a sample table beside its content digest; one row."""
    base = df.agg(
        F.count(F.lit(1)).alias("sample_count"), F.min("open_time_ms").alias("start_ms"), F.max("open_time_ms").alias("end_ms"),
        F.count_distinct("symbol").alias("symbol_count"), F.array_join(F.array_sort(F.collect_set("interval")), ",").alias("intervals"),
    )
    return base.crossJoin(F.broadcast(digest.select("data_version")))
