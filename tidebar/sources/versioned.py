"""Tables with upserts: partitions rewritten as new versions, made current by one committed manifest.

A batch is folded to one row a key, joined with the current rows of the partitions it touches, and
these are written anew below the next version's folder; other partitions stay where they are. A version
exists once its manifest, the list of partitions with the version that holds each, is renamed into
the log. A batch that fails before leaves nothing a reader sees and its folder is written over;
a batch that was committed is known by its number and does nothing when it is sent again. So files
follow partitions and not batches, and ``vacuum`` removes what no kept version points to.
One writer a table, as a stream has; two writers of one version can't both rename.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.feed import latest_by_key

PART = "_p"
MANIFEST = "partition string, version long, rows long, batch long, rows_in long, rows_new long, rows_changed long, rows_stale long"


@dataclass(frozen=True)
class VersionedTable:
    """``keys`` name a row; of rows with one key the greatest ``order`` counts; ``partition`` cuts the table and depends on keys only."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    order: str
    partition: Column

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.path)
        return hadoop.Path, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        path, fs = self._fs()
        at = path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return [int(n[1:]) for n in self._listed("log") if n.startswith("v") and n[1:].isdigit()]

    def manifest(self, version: int | None = None) -> DataFrame:
        """Partitions with the version that holds their rows, and the counts of the batch that made ``version``."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], MANIFEST)
        at = have[-1] if version is None else version
        if at not in have:
            raise ValueError(f"no version {at} of {self.path}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/log/v{at:012d}")

    def _rows(self, held: DataFrame, only: list[str] | None = None) -> DataFrame | None:
        held = held.where(F.col("partition").isNotNull())
        if only is not None:
            held = held.where(F.col("partition").isin(only))
        # names of folders, one a partition
        folders = [f"{self.path}/data/v{r.version:012d}/{PART}={r.partition}" for r in held.select("partition", "version").collect()]
        return self.spark.read.parquet(*folders) if folders else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table's rows as of a version (the last one); None before the first."""
        return self._rows(self.manifest(version))

    def upsert(self, batch: DataFrame, number: int) -> int:
        """Apply a batch once, whatever its number of tries; returns the version that holds it."""
        have = self.versions()
        last = self.manifest()
        done = last.agg(F.max("batch")).collect()[0][0]  # one value
        if done is not None and number <= done:
            return have[-1]
        # partition names stand in folder names, so they are kept to plain characters
        named = batch.withColumn(PART, F.regexp_replace(self.partition.cast("string"), "[^A-Za-z0-9_.-]", "_"))
        if named.where(F.col(PART).isNull()).limit(1).count():
            raise ValueError("a row has no partition")
        touched = sorted(r[0] for r in named.select(PART).distinct().collect())  # names of partitions
        version = (have[-1] if have else 0) + 1
        folder = f"{self.path}/data/v{version:012d}"
        before = self._rows(last, touched)
        mine = named.withColumn("_new", F.lit(1))
        both = mine if before is None else mine.unionByName(before.withColumn(PART, F.regexp_replace(self.partition.cast("string"), "[^A-Za-z0-9_.-]", "_")).withColumn("_new", F.lit(0)))
        # equal orders: a new row goes before a stored one
        latest = latest_by_key(both, [PART, *self.keys], F.struct(self.order, "_new"))
        latest.drop("_new").repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(folder)
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in latest.drop("_new").schema.fields)
        written = self.spark.read.schema(shape).parquet(folder).groupBy(F.col(PART).alias("partition")).agg(F.count("*").alias("rows"))
        counts = self._counts(mine, before)
        kept = last.where(F.col("partition").isNotNull() & ~F.col("partition").isin(touched)).select("partition", "version", "rows")
        both = kept.unionByName(written.select("partition", F.lit(version).cast("long").alias("version"), "rows"))
        # a row without a partition carries the batch itself, so that empty batches are remembered too
        note = self.spark.createDataFrame([(None, version, 0)], "partition string, version long, rows long")
        rows = both.unionByName(note).select("*", F.lit(number).cast("long").alias("batch"), *[F.lit(v).cast("long").alias(c) for c, v in counts.items()])
        self._commit(rows, version)
        return version

    def _counts(self, mine: DataFrame, before: DataFrame | None) -> dict[str, int]:
        """Rows that came, and of their keys the new ones, the changed ones and those with a later row stored already."""
        best = mine.groupBy(*self.keys).agg(F.count("*").alias("_n"), F.max(self.order).alias("_o"))
        if before is None:
            got = best.agg(F.sum("_n"), F.count("*"), F.lit(0), F.lit(0))
        else:
            stored = before.select(*self.keys, F.col(self.order).alias("_b"))
            both = best.join(stored, list(self.keys), "left")
            got = both.agg(F.sum("_n"), F.count_if(F.col("_b").isNull()), F.count_if(F.col("_o") >= F.col("_b")), F.count_if(F.col("_o") < F.col("_b")))
        return dict(zip(("rows_in", "rows_new", "rows_changed", "rows_stale"), (v or 0 for v in got.collect()[0]), strict=True))  # one row

    def _commit(self, rows: DataFrame, version: int) -> None:
        made, current = f"{self.path}/log/making-{version:012d}", f"{self.path}/log/v{version:012d}"
        rows.coalesce(1).write.mode("overwrite").parquet(made)
        path, fs = self._fs()
        if fs.exists(path(current)) or not fs.rename(path(made), path(current)):
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")

    def vacuum(self, keep: int = 1) -> int:
        """Drop versions but the last ``keep`` and the data no kept one points to; returns how many folders went."""
        path, fs = self._fs()
        have = self.versions()
        kept = have[-keep:] if keep > 0 else have
        used = set()
        for v in kept:
            used |= {(r.version, r.partition) for r in self.manifest(v).where("partition is not null").select("version", "partition").distinct().collect()}
        gone = 0
        for name in self._listed("data"):
            version = int(name[1:])
            if version > have[-1]:  # an unfinished batch writes over it
                continue
            parts = [p for p in self._listed(f"data/{name}") if p.startswith(f"{PART}=")]
            for p in parts:
                if (version, p[len(PART) + 1 :]) not in used:
                    fs.delete(path(f"{self.path}/data/{name}/{p}"), True)
                    gone += 1
            if not any((version, p[len(PART) + 1 :]) in used for p in parts):
                fs.delete(path(f"{self.path}/data/{name}"), True)
        for v in have:
            if v not in kept:
                fs.delete(path(f"{self.path}/log/v{v:012d}"), True)
        return gone

    def upsert_stream(self, rows: DataFrame, checkpoint: str, keep: int = 2) -> DataStreamWriter:
        """A writer that upserts every micro-batch under its number and clears versions before the last ``keep``."""

        def store(batch: DataFrame, number: int) -> None:
            self.upsert(batch, number)
            self.vacuum(keep)

        return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
