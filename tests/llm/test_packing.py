from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidebar.llm import packing


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_bounds_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(0, 40, 60)
        values, count = np.unique(lengths, return_counts=True)
        for k in (1, 2, 3):
            got = packing.optimal_bounds(count, values * count, values, k)
            best = min(padding(lengths, [*c, values[-1]]) for c in combinations(values[:-1], min(k, len(values)) - 1))
            assert len(got) <= k and padding(lengths, got) == best


def test_batches(documents, prose, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 16)
    rows = [(i, prose(i, (i * 37) % 90)) for i in range(200)] + [(500, prose(1, 3000)), (501, None), (502, ""), (503, "x\x0by\x1cz")]
    out = packing.pack(documents(rows), packing.word_count(F.col("text")), budget=400).collect()
    assert {r.doc_id: r.length for r in out} == {i: len((t or "").replace("\x1c", "_").split()) for i, t in rows}
    batches = {}
    for r in out:
        batches.setdefault((r.bucket, r.batch), []).append(r)
        assert r.length <= r.padded_length
    top = {r.bucket: max(x.length for x in out if x.bucket == r.bucket) for r in out}
    for (bucket, batch), rs in batches.items():
        room = max(1, 400 // max(1, rs[0].padded_length))
        assert {r.padded_length for r in rs} == {top[bucket]}
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len(rs) <= room
        last = max(b for k, b in batches if k == bucket)
        assert len(rs) == room or batch == last  # only a bucket's last batch has room left
    assert len(top) == packing.BUCKETS


def test_edges(documents):
    assert packing.pack(documents([]), packing.word_count(F.col("text"))).collect() == []
    out = packing.pack(documents([(None, None), (None, None)]), packing.word_count(F.col("text"))).collect()
    assert sorted((r.doc_id, r.length, r.bucket, r.batch, r.slot) for r in out) == [(None, 0, 0, 0, 0), (None, 0, 0, 0, 1)]


def quadratic(lengths, buckets):
    """Least padding by trying every cut."""
    values, count = np.unique(lengths, return_counts=True)
    n, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(values * count)])
    best = n[1:] * values - s[1:]
    for _ in range(buckets - 1):
        before = np.concatenate([[0], best])
        best = np.array([(before[:j] + (n[j] - n[:j]) * values[j - 1] - (s[j] - s[:j])).min() for j in range(1, len(values) + 1)])
    return best[-1]


def test_halving_finds_the_least_padding():
    rng = np.random.default_rng(5)
    for size, spread, buckets in ((1, 5, 4), (2, 5, 4), (900, 3.0, 16), (3000, 1.5, 7), (500, 9.0, 2)):
        lengths = np.exp(rng.normal(5, spread, size).clip(0, 13)).astype(np.int64)
        values, count = np.unique(lengths, return_counts=True)
        got = packing.optimal_bounds(count, values * count, values, buckets)
        at = np.array(got)[np.searchsorted(got, lengths)]
        assert (at - lengths).sum() == quadratic(lengths, buckets)


def test_many_distinct_lengths():
    values = np.arange(1, 300_001)
    got = packing.optimal_bounds(np.ones_like(values), values, values, 16)
    # equal counts: even buckets are best, up to one length
    assert len(got) == 16 and np.ptp(np.diff([0, *got])) <= 1


def test_long_lengths_are_not_rounded(documents):
    rows = [(i, "w " * n) for i, n in enumerate((1000, 1001, 1002, 1003, 1004, 9000))]
    out = packing.pack(documents(rows), packing.word_count(F.col("text")), buckets=3).collect()
    assert sorted((r.length, r.padded_length) for r in out) == [(1000, 1001), (1001, 1001), (1002, 1004), (1003, 1004), (1004, 1004), (9000, 9000)]
