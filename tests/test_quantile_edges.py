"""Quantiles, positions and ranks hold whatever the order in which parts of the sketch are merged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import quantiles


@pytest.fixture
def dealt(spark):
    """Rows that lie in other partitions each time they are read, as after a lost task or with parts fetched in another order."""
    df = spark.range(0, 1_200_000, 1, 12).select(F.lit("a").alias("g"), F.col("id"), (F.xxhash64("id") % 1_000_003 / 1000.0).alias("v"))

    def anew(batches):
        rng = np.random.default_rng()
        for b in batches:
            yield b.assign(part=rng.integers(0, 1 << 40, len(b)))

    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield df, df.mapInPandas(anew, "g string, id long, v double, part long").repartition(12, "part").drop("part")
    spark.conf.set("spark.sql.exchange.reuse", reuse)


def test_counts_and_sorted_bins_mean_the_same_edges(dealt):
    df, moved = dealt
    v = np.sort(df.toPandas()["v"].to_numpy())
    probs = [k / 40 for k in range(1, 40)]
    got = quantiles.exact_quantiles(moved, ["g"], "v", probs, [f"q{k}" for k in range(1, 40)]).collect()
    assert np.allclose(np.array(got[0][1:], float), np.quantile(v, probs), atol=1e-9)
    at = quantiles.value_positions(moved, ["g"], "v").toPandas()
    assert (np.searchsorted(v, at["v"].to_numpy()) == at["n_below"].to_numpy()).all()
