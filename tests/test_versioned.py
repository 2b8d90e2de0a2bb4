"""Upserts: repeated and failed batches leave one version, and files follow partitions."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidebar.sources.versioned import VersionedTable

SCHEMA = "symbol string, open_time_ms long, ingest_seq long, close double"
DAY = 86_400_000


def table(spark, path):
    return VersionedTable(spark, str(path), ("symbol", "open_time_ms"), "ingest_seq", F.floor(F.col("open_time_ms") / DAY))


def batches(rng, n, days=4):
    seq = 0
    for _ in range(n):
        rows = []
        for _ in range(rng.randrange(1, 40)):
            seq += 1
            # now and then a version older than what is stored
            rows.append((rng.choice("AB"), rng.randrange(days * 6) * DAY // 6, seq - rng.choice((0, 0, 0, 500)), rng.random()))
        yield rows


def latest(rows):
    out = {}
    for i, r in enumerate(rows):
        if r[:2] not in out or (r[2], i) > out[r[:2]][0]:
            out[r[:2]] = ((r[2], i), r)
    return sorted(v for _, v in out.values())


def files(path):
    return [p for p in Path(path).rglob("*.parquet") if "data" in p.parts and p.is_file()]


def test_batches_repeats_failures_and_vacuum(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    t, seen, states = table(spark, tmp_path / "t"), [], {}
    for n, rows in enumerate(batches(rng, 8)):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        stored = {r[:2]: r[2] for r in latest(seen)}
        if n in (3, 5):  # fails after its data, before its manifest
            with monkeypatch.context() as m:
                m.setattr(VersionedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    t.upsert(df, n)
            assert sorted(map(tuple, t.read().select("symbol", "open_time_ms", "ingest_seq").collect())) == sorted(r[:3] for r in latest(seen))
        version = t.upsert(df, n)
        assert t.upsert(df, n) == version and t.versions()[-1] == version == n + 1
        seen += rows
        states[version] = [r[:3] for r in latest(seen)]
        got = t.read().select("symbol", "open_time_ms", "ingest_seq")
        assert sorted(map(tuple, got.collect())) == states[version]
        note = t.manifest().where("partition is null").collect()[0]
        best = {}
        for r in rows:
            best[r[:2]] = max(r[2], best.get(r[:2], -(10**9)))
        stale = sum(k in stored and v < stored[k] for k, v in best.items())
        assert (note.rows_in, note.rows_new, note.rows_stale) == (len(rows), sum(k not in stored for k in best), stale)
        assert note.rows_changed == len(best) - note.rows_new - stale
    assert sorted(map(tuple, t.read(4).select("symbol", "open_time_ms", "ingest_seq").collect())) == states[4]
    t.vacuum(2)
    assert t.versions() == [7, 8] and sorted(map(tuple, t.read(7).select("symbol", "open_time_ms", "ingest_seq").collect())) == states[7]
    t.vacuum(1)
    assert len(files(tmp_path / "t")) == t.manifest().where("partition is not null").count() == 4
    with pytest.raises(ValueError):
        t.read(3)


def test_streamed_upserts(spark, tmp_path):
    rng = random.Random(6)
    sent = list(batches(rng, 6))
    for i, rows in enumerate(sent):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"src/b{i}"))
    t = table(spark, tmp_path / "t")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    for _ in range(2):  # the second run finds nothing new
        q = t.upsert_stream(stream, str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    got = {tuple(r) for r in t.read().select("symbol", "open_time_ms", "ingest_seq").collect()}
    best = {}
    for rows in sent:
        for r in rows:
            best[r[:2]] = max(r[2], best.get(r[:2], -(10**9)))
    assert got == {(*k, v) for k, v in best.items()}
    assert len(t.versions()) == 2 and len(files(tmp_path / "t")) <= 8


def test_empty_batches_are_remembered(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read() is None
    t.upsert(spark.createDataFrame([], SCHEMA), 0)
    assert t.versions() == [1] and t.read() is None
    t.upsert(spark.createDataFrame([("A", 0, 1, 1.0)], SCHEMA), 0)  # a number that is done already
    assert t.read() is None
    t.upsert(spark.createDataFrame([("A", 0, 1, 1.0)], SCHEMA), 1)
    assert t.read().count() == 1
