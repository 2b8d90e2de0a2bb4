"""Exact filters of the n-gram join: they lose no link, and sets that link with nothing cost little."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tests_support import brute_groups

from tidebar.llm import ngram_join as J

LIKES = [J.DEFAULT, J.Likeness(5, 80, 100), J.Likeness(5, 1, 2), J.Likeness(1, 97, 100)]


def linked_sets(like, rng, sizes=800):
    """Two sets that link, as unlike as they may be."""
    n = int(rng.integers(1, sizes))
    both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    extra = rng.integers(0, 1 << 63, n * like.den // like.num - n, dtype=np.uint64) * np.uint64(2)
    cut = int(rng.integers(0, len(extra) + 1))
    return [np.unique(np.concatenate([both, x])) for x in (extra[:cut], extra[cut:])]


@pytest.mark.parametrize("like", LIKES)
def test_linked_sets_share_enough_first_elements_and_parities(like):
    rng = np.random.default_rng(5)
    for _ in range(400):
        a, b = linked_sets(like, rng)
        i = len(np.intersect1d(a, b))
        assert like.den * i >= like.num * (len(a) + len(b) - i)
        (la, need_a), (lb, need_b) = J.prefix(len(a), like), J.prefix(len(b), like)
        shared = len(np.intersect1d(a[:la], b[:lb]))
        assert shared >= max(need_a, need_b) >= 1
        x, y = (np.frombuffer(J.parity(s), np.uint8)[None] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        different = int(np.bitwise_count(J._folded(x, width) ^ J._folded(y, width)).sum())
        assert different <= len(a) + len(b) - 2 * i
        assert J._may_link(np.array([different]), np.array([len(a) + len(b)]), like)[0]


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 100])
def test_runs_over_borders_of_batches(cut):
    rng = random.Random(cut)
    rows = sorted((rng.randrange(12), rng.randrange(6)) for _ in range(60))
    full = pa.table({"sig": [s for s, _ in rows], "sid": [i for _, i in rows], "often": [0] * len(rows)})
    got = [r for b in J._several(iter(full.to_batches(max_chunksize=cut))) for r in b.column(0).to_pylist()]
    groups = {}
    for s, i in rows:
        groups.setdefault(s, set()).add(i)
    assert sorted(got) == sorted(i for g in groups.values() if len(g) > 1 for i in g)


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_stars_and_blocks_find_what_may_link(cut):
    like, rng = J.Likeness(5, 80, 100), np.random.default_rng(1)
    sets = [s for _ in range(12) for s in linked_sets(like, rng, 200)]
    n, bits = [len(s) for s in sets], [J.parity(s) for s in sets]
    k = len(sets)
    rows = {"sig": [i // 6 for i in range(k)], "salt": [0] * k, "sid": list(range(k)), "comp": list(range(k)), "n": n}
    star = pa.table(rows).append_column("bits", pa.array(bits, pa.binary())).to_batches(max_chunksize=cut)
    pairs = lambda out: {p for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    wanted = {(i, i + 1) for i in range(0, k, 2)}
    assert pairs(J._stars(iter(star), like)) >= {p for p in wanted if p[0] % 6 == 0}
    cells = {"sig": rows["sig"], "lo": [0] * k, "hi": [0] * k, "block": [0] * k, "sid": rows["sid"], "comp": rows["comp"], "n": n}
    cells = pa.table(cells).append_column("bits", pa.array(bits, pa.binary())).to_batches(max_chunksize=cut)
    assert pairs(J._across(iter(cells), like)) >= wanted


def test_large_groups_go_by_blocks(documents, prose, monkeypatch):
    monkeypatch.setattr(J, "RUN", 8)
    like, rng = J.Likeness(5, 80, 100), random.Random(8)
    hub = prose(1, 120).split()
    rows = [(0, " ".join(hub))]
    for i in range(1, 60):
        w = list(hub)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {}
    for r in J.join_components(documents(rows), like=like).collect():
        got.setdefault(r.component_id, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, brute_groups(dict(rows), like)))


def test_texts_of_their_own_shuffle_no_signatures(spark, documents):
    rng, size, count = random.Random(2), 300, 120
    df = documents([(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(size))) for i in range(count)])
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._jvm.java.util.ArrayList()

    def shuffled():
        stages = store.stageList(none, False, False, getattr(store, "stageList$default$4")(), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    J.join_components(df, like=J.Likeness(5, 80, 100)).collect()
    assert shuffled() - before < 0.4 * size * count
