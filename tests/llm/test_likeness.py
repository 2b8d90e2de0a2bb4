import random
import re

import corpus_pipeline
import numpy as np
import pytest

from tidebar.llm import ngram_join as J


def links(rows, like):
    """Places of the rows that link, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[k : k + like.words]) for k in range(len(w) - like.words + 1)} if len(w) >= like.words else ({tuple(w)} if w else set()))
    return [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and like.den * len(sets[a] & sets[b]) >= like.num * len(sets[a] | sets[b])]


def least(rows, like):
    """id -> least id of its component."""
    label = {i: i for i, _ in rows}
    for a, b in links(rows, like):
        x, y = sorted((label[rows[a][0]], label[rows[b][0]]))
        label = {i: x if v == y else v for i, v in label.items()}
    return label


def family(prose, seed=3):
    rng, rows = random.Random(seed), []
    for size in (3, 5, 8, 14, 30, 70, 160, 400):
        base = prose(size * 7, size).split()
        for cut in (0, 0.05, 0.1, 0.15, 0.19, 0.21, 0.3):
            rows.append(" ".join(base + prose(size + int(cut * 100), max(1, int(cut * size))).split() if cut else base))
            w = list(base)
            w[rng.randrange(size)] = "edited"
            rows.append(" ".join(w[: max(1, round(size * (1 - cut)))]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("like", [J.Likeness(5, 80, 100), J.Likeness(2, 1, 2)])
def test_components_by_other_words_and_similarity(documents, prose, like):
    rows = family(prose)
    assert {r.doc_id: r.component_id for r in J.join_components(documents(rows), like=like).collect()} == least(rows, like)


@pytest.mark.parametrize("like", [J.Likeness(5, 80, 100), J.Likeness(5, 1, 2), J.Likeness(1, 97, 100)])
def test_signatures_share_one_whenever_sets_link(like):
    rng = np.random.default_rng(2)
    edges = J.band_edges(5000, like)
    for _ in range(300):
        n = int(rng.integers(2, 800))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        extra = rng.integers(0, 1 << 63, int(rng.integers(0, n * like.den // like.num - n + 1)), dtype=np.uint64)
        cut = int(rng.integers(0, len(extra) + 1))
        a, b = (np.unique(np.concatenate([both, x])) for x in (extra[:cut], extra[cut:]))
        i = len(np.intersect1d(a, b))
        if like.den * i >= like.num * (len(a) + len(b) - i) and not np.array_equal(a, b):
            assert set(J.signatures(a, edges, like).tolist()) & set(J.signatures(b, edges, like).tolist())


def test_pipeline_drops_copies_with_a_seventh_appended(spark, documents, prose):
    rows = [(1, prose(1, 140)), (2, prose(1, 140) + " " + prose(2, 20)), (3, prose(3, 140)), (4, prose(3, 140) + " " + prose(4, 60))]
    kept = corpus_pipeline.keep_one_of_alike(spark, documents(rows), "")
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4}
    assert {r.doc_id: r.component_id for r in J.join_components(documents(rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
