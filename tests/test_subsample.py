"""Draws without replacement: parts, several parts a group, and the path for large draws give the same."""

import hashlib
from statistics import mean, median, stdev

import pytest

from tidebar.operators import resample


def plain(rows, size, draws):
    out = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g and r[2] is not None]
        means, medians, wins = [], [], []
        for rep in range(draws):
            drawn = [v for _, _, v in sorted(mine, key=lambda r: (hashlib.md5(f"{r[1]}:sub:{rep}".encode()).hexdigest(), r[1]))[:size]]
            means.append(mean(drawn))
            medians.append(median(drawn))
            wins.append(100.0 * sum(v > 0 for v in drawn) / len(drawn))
        out[g] = (min(size, len(mine)), len(mine), mean(means), stdev(means), mean(medians), mean(wins))
    return out


@pytest.mark.parametrize(("part", "size"), [(8_192, 20), (64, 20), (8, 20), (64, 1_000)])
def test_draws_of_every_path(spark, monkeypatch, part, size):
    monkeypatch.setattr(resample, "PART", part)
    rows = [(g, f"{g}-{i}", None if i % 11 == 3 else float((i * 37) % 101 - 40)) for g, n in (("a", 300), ("b", 15), ("c", 70)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id string, v double")
    got = {r["g"]: tuple(r)[1:7] for r in resample.subsample_baseline(df, ["g"], "v", "id", size, 12).collect()}
    assert got == {g: pytest.approx(v) for g, v in plain(rows, size, 12).items()}


def test_replicates_are_not_shuffled(spark):
    """Rows go to their part once; exploded replicates of them never go through an exchange."""
    df = spark.range(500).selectExpr("'a' AS g", "cast(id AS string) AS id", "cast(id AS double) AS v")
    out = resample.subsample_baseline(df, ["g"], "v", "id", 10, 50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" not in plan and "RepartitionByExpression" in plan
