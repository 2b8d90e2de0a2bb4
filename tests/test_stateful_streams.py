"""Stateful streams equal their batch operators, whatever the order, batches and restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import feed, universe
from tidebar.streaming import stateful

BARS = "symbol string, interval string, open_time_ms long, ingest_seq long, open double, high double, low double, close double, volume double"
HOUR = 3_600_000
START = 1_700_000_000_000


def feed_rows(spark, folder, batches, schema):
    """One file a batch, read one at a time in the order of their names."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i:03d}")


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, tmp_path):
    q = stateful.appended(stream, str(tmp_path / "out"), str(tmp_path / "ck")).start()
    assert q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def series(rng, symbol, n):
    price, out = 100.0, []
    for i in range(n):
        o = price
        c = max(1.0, o * (1 + rng.uniform(-0.05, 0.045)))
        low = min(o, c) * (1 - rng.choice((0.001, 0.06)))
        out.append((symbol, "1h", START + i * HOUR, i, o, max(o, c) * 1.01, low, c, float(rng.choice((5, 10, 60)))))
        price = c
    return out


@pytest.mark.parametrize("restart", [False, True])
def test_candidates_equal_batch_on_shuffled_repeated_and_late_bars(spark, tmp_path, restart):
    rng = random.Random(11)
    rows = [b for s in ("AAA", "BBB", "CCC") for b in series(rng, s, 130)]
    # shuffled by up to thirty hours, some bars in two versions of which the later one counts
    first = [(*b[:3], -1, *[x * 1.5 for x in b[4:]]) for b in rng.sample(rows, 40)]
    sent = sorted(rows + first, key=lambda b: (b[2] + rng.uniform(0, 30) * HOUR, b[3]))
    batches = [sent[i : i + 60] for i in range(0, len(sent), 60)]
    # versions that come after the watermark, and a bar of another series that closes the stream
    late = [(*b[:3], 9_999, *[x * 3 for x in b[4:]]) for b in rows[:25]]
    batches += [late, [("ZZZ", "1h", START + 10_000 * HOUR, 0, 1.0, 1.0, 1.0, 1.0, 1.0)]]
    src = tmp_path / "src"
    if restart:
        feed_rows(spark, src, batches[:4], BARS)
        run(stateful.candidate_stream(read(spark, src, BARS), "35 hours"), tmp_path)
        for i, part in enumerate(batches[4:], 4):
            spark.createDataFrame(part, BARS).coalesce(1).write.parquet(f"{src}/b{i:03d}")
    else:
        feed_rows(spark, src, batches, BARS)
    out = run(stateful.candidate_stream(read(spark, src, BARS), "35 hours"), tmp_path)
    bars = spark.createDataFrame([(*b, i) for s in ("AAA", "BBB", "CCC") for i, b in enumerate(r for r in rows if r[0] == s)], BARS + ", bar_index long")
    actions = bars.where("bar_index % 31 = 25").select("symbol", "interval", "bar_index", F.lit("s1").alias("session_id"), F.lit("OPEN_LONG").alias("user_action"))
    got = stateful.stream_universe(out, actions)
    want = universe.deep_v_universe(bars, actions)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert want.where("is_candidate = 1").count() > 5
    assert sorted((r.symbol, r.open_time_ms, r.ingest_seq) for r in out.where("kind = 'late'").collect()) == sorted((b[0], b[2], b[3]) for b in late)


LOG = "observation_id string, session_id string, symbol string, interval string, bar_index long, changed_at long, change_no long, operation string, human_decision string, confidence int, note string"


def changes(rng, keys, n):
    out = []
    for no in range(n):
        k = rng.randrange(keys)
        named = k % 3 != 0
        op = rng.choice(("CREATE", "UPDATE", "UPDATE", "DELETE"))
        out.append((f"o{k}" if named else None, "s", "AAA", "1h", k, START + (no // 3) * 60_000, no, op, rng.choice(("ENTRY", "REJECT", None)), rng.choice((1, 5, None)), rng.choice(("é n", 'q"', None))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_annotations_equal_batch_for_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = changes(rng, 12, 200)
    sent = sorted(rows, key=lambda r: r[5] + rng.uniform(0, 20) * 60_000)
    cuts = sorted(rng.sample(range(1, len(sent)), 5))
    batches = [sent[a:b] for a, b in zip([0, *cuts], [*cuts, len(sent)], strict=True)]
    batches.append([("end", "s", "Z", "1h", 0, START + 10**9, 0, "DELETE", None, None, None)])
    src = tmp_path / "src"
    feed_rows(spark, src, batches[:3], LOG)
    run(stateful.annotation_stream(read(spark, src, LOG), "25 minutes"), tmp_path)
    for i, part in enumerate(batches[3:], 3):
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{src}/b{i:03d}")
    out = run(stateful.annotation_stream(read(spark, src, LOG), "25 minutes"), tmp_path).where("annotation_key <> 'end'")
    log = spark.createDataFrame(rows, LOG)
    assert out.where("kind = 'late'").count() == 0

    def plain(df):
        return sorted(str(tuple(json.dumps(json.loads(v), sort_keys=True) if isinstance(v, str) and v.startswith("{") else v for v in r)) for r in df.collect())

    want = feed.revision_history(log)
    assert plain(stateful.stream_revisions(out).select(*want.columns)) == plain(want)
    want = feed.current_annotations(log)
    assert plain(stateful.stream_current(out).select(*want.columns)) == plain(want)


def test_deleted_annotations_are_forgotten_and_late_changes_leave_aside(spark, tmp_path):
    def change(key, minute, no, op):
        return (key, "s", "A", "1h", 0, START + minute * 60_000, no, op, "ENTRY", 1, None)

    batches = [
        [change("a", 0, 0, "CREATE"), change("a", 1, 1, "DELETE"), change("b", 0, 2, "CREATE"), change("b", 1, 3, "DELETE")],
        [change("z", 30, 4, "CREATE")],
        [change("b", 40, 5, "CREATE"), change("a", 2, 6, "UPDATE")],
        [change("z", 300, 7, "UPDATE")],
        [change("a", 310, 8, "CREATE")],
        [change("z", 900, 9, "UPDATE")],
    ]
    src = tmp_path / "src"
    feed_rows(spark, src, batches, LOG)
    out = run(stateful.annotation_stream(read(spark, src, LOG), "1 minute", forget=60 * 60_000), tmp_path).collect()
    got = {(r.annotation_key, r.change_no): (r.kind, r.revision_no, r.annotation_version) for r in out}
    assert got["b", 5] == ("change", 3, 2)  # within the hour the chain goes on
    assert got["a", 6] == ("late", None, None)
    assert got["a", 8] == ("change", 1, 1)  # after it, it starts anew
