import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidebar.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, "6g")


@pytest.fixture(scope="session")
def bars(spark):
    """Two series, one of them far longer than the other."""
    import random

    rng = random.Random(7)
    rows = []
    for symbol, n in (("HOT", 260), ("COLD", 40)):
        price = 100.0
        for i in range(n):
            o = price
            c = max(1.0, o * (1 + rng.uniform(-0.03, 0.03)))
            rows.append((symbol, "1h", i, i * 3_600_000, o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(rng.randint(1, 50))))
            price = c
    cols = "symbol string, interval string, bar_index long, open_time_ms long, open double, high double, low double, close double, volume double"
    return spark.createDataFrame(rows, cols).cache()
