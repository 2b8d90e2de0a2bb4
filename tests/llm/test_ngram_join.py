import random
import re

import numpy as np

from tidebar.llm import ngram_join as J
from tidebar.llm.graph import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= 90 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return {(rows[k][0], len(sets[k]), min((i for i in groups[find(k)] if i is not None), default=None)) for k in range(len(rows))}


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def test_components_against_brute_force(documents, prose):
    rng, texts = random.Random(4), []
    for size in (3, 9, 10, 11, 12, 19, 20, 35, 60, 120, 260):
        for s in range(3):
            base = prose(size * 10 + s, size)
            texts += [base, base.upper(), edited(rng, base, 1), edited(rng, base, 1 + size // 60), edited(rng, base, size // 20), base + " tail"]
    # a chain of drift, whose ends don't link, and a large group of near copies of one text
    chain = prose(5, 200)
    for _ in range(12):
        texts.append(chain)
        chain = edited(rng, chain, 2)
    hub = prose(6, 150)
    texts += [edited(rng, hub, rng.randint(1, 4)) for _ in range(90)]
    texts += ["", None, "one", "ONE", "one two", "a\x0bb\x1cc\xa0d e"]
    rng.shuffle(texts)
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.join_components(documents(rows)).collect()}
    assert got == brute(rows)


def test_salted_runs_and_shuffled_texts_change_nothing(documents, prose, monkeypatch):
    for name, value in (("SAMPLE", 1), ("HEAVY_ROWS", 3), ("SALTS", 4), ("BROADCAST_ROWS", 0), ("STAR_ROUNDS", 1)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(8)
    hub = prose(6, 120)
    rows = [(i, edited(rng, hub, rng.randint(0, 4))) for i in range(60)] + [(100 + i, prose(i, 40)) for i in range(20)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.join_components(documents(rows)).collect()}
    assert got == brute(rows)


def test_signatures_share_one_whenever_sets_link():
    rng = np.random.default_rng(1)
    edges = J.band_edges(5000)
    for _ in range(400):
        n = int(rng.integers(2, 800))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        k = int(n / 0.9) - n
        extra = rng.integers(0, 1 << 63, int(rng.integers(0, k + 1)), dtype=np.uint64)
        cut = int(rng.integers(0, len(extra) + 1))
        a, b = (np.unique(np.concatenate([both, x])) for x in (extra[:cut], extra[cut:]))
        i = len(np.intersect1d(a, b))
        if 100 * i >= 90 * (len(a) + len(b) - i) and not np.array_equal(a, b):
            assert set(J.signatures(a, edges).tolist()) & set(J.signatures(b, edges).tolist())


def test_edges(documents):
    assert J.join_components(documents([])).collect() == []
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "x"), (None, "z"), (1, None)]
    got = sorted(J.join_components(documents(rows)).collect(), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (2, 1, 2), (None, 1, None), (1, 0, 1)], key=str)


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 150)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
