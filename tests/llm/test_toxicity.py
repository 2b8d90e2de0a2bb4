import random

from tidebar.llm import toxicity
from tidebar.llm.toxicity import BUCKETS, Model, fit  # noqa: F401

BAD = ["vilegrub", "snarkwad", "dungface"]


def corpus(prose, n, seed, bad=BAD):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = prose(seed * 10_000 + i, rng.randint(30, 200)).split()
        toxic = int(i % 4 == 0)
        for _ in range(toxic * (1 + len(w) // 25)):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_unseen_misspellings(spark, documents, prose):
    rows, labels = corpus(prose, 600, 1)
    docs, lab = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    truth = {i: t for i, _, t in labels}
    out = toxicity.flagged(docs, model).collect()
    held = [r for r in out if r.held_out]
    assert 60 < len(held) < 180
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    rows, labels = corpus(prose, 80, 2, ["vilegrubb", "snarkwads", "dungfacee"])
    got = {r.doc_id: r.predicted for r in toxicity.flagged(documents(rows), model).collect()}
    assert sum(got[i] for i, _, t in labels if t) / 20 > 0.8 and sum(got[i] for i, _, t in labels if not t) <= 3


def test_score_does_not_depend_on_blocks(documents, prose, monkeypatch):
    rows = [(i, prose(i, 40 * i)) for i in range(8)] + [(8, ""), (9, None), (10, "𝄞 ä b")]
    model = Model(toxicity.np.linspace(-1, 1, BUCKETS), 0.1)
    texts = [t for _, t in rows]
    whole = toxicity.np.concatenate([model.of_block(at, c) for _, at, c in toxicity._blocks(texts)])
    monkeypatch.setattr(toxicity, "STEP", 97)
    small = toxicity.np.concatenate([model.of_block(at, c) for _, at, c in toxicity._blocks(texts)])
    assert toxicity.np.allclose(whole, small)


def test_edges(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, None), (2, ""), (None, "x"), (None, "x")]
    out = toxicity.flagged(documents(rows), toxicity.train(documents(rows), none)).collect()
    assert len(out) == 4 and all(r.predicted == 0 and r.score < 1e-9 for r in out)
    mixed = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(documents(rows), mixed).bias == -60.0
    assert toxicity.flagged(documents([]), Model(toxicity.np.zeros(BUCKETS), 0.0)).collect() == []
    kept = toxicity.drop_flagged(documents(rows), Model(toxicity.np.zeros(BUCKETS), -3.0))
    assert kept.columns == documents(rows).columns and kept.count() == 4
    assert toxicity.drop_flagged(documents(rows), Model(toxicity.np.zeros(BUCKETS), 3.0)).count() == 0
