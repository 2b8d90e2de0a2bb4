import numpy as np
from pyspark.sql import functions as F

from tidebar.operators import matching, quantiles


def test_whole_groups_give_the_neighbours_of_cells(spark):
    rng = np.random.default_rng(5)
    cell = lambda: None if rng.random() < 0.15 else float(rng.integers(0, 6))
    rows = [(g, f"{g}{i:03d}", bool(i % 4 == 0), cell(), cell()) for g, n in (("a", 90), ("b", 40), ("c", 2)) for i in range(n)]
    df = spark.createDataFrame(rows + [("d", "d1", True, 1.0, 1.0)], "g string, id string, u boolean, x double, y double")
    # one id is user and control at once; it is no neighbour of itself
    users, controls = df.where("u"), df.where("not u or id = 'a000'")
    found = [sorted(matching.nearest(users, controls, ["g"], "id", "id", ["x", "y"], 3, cell=8, whole=w).collect()) for w in (0, 50, 16_384)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 90


def test_small_groups_are_sorted_without_edges(spark, monkeypatch):
    rows = [(None if g == 3 else f"g{g}", float((i * 7919) % 101)) for g in range(4) for i in range(10 + 30 * g)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs, names = [0.0, 0.25, 0.5, 0.9], ["a", "b", "c", "d"]
    want = {r["g"]: [float(np.quantile([x for g, x in rows if g == r["g"]], p)) for p in probs] for r in df.select("g").distinct().collect()}
    whole = quantiles.exact_quantiles(df, ["g"], "x", probs, names)
    monkeypatch.setattr(quantiles, "CHUNK", 50)
    mixed = quantiles.exact_quantiles(df.where(F.col("g").isNotNull()), ["g"], "x", probs, names)
    got = {r["g"]: [r[n] for n in names] for r in whole.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], atol=1e-12) for g in want)
    assert {r["g"]: [r[n] for n in names] for r in mixed.collect()} == {g: v for g, v in got.items() if g}
    monkeypatch.setattr(quantiles, "_edges", None)
    monkeypatch.setattr(quantiles, "CHUNK", 16_384)
    quantiles.exact_quantiles(df, ["g"], "x", probs, names).collect()
