from tidebar.llm import toxicity

from test_toxicity import corpus


def test_bounded_sample_keeps_the_shares_of_the_labels(spark, documents, prose, monkeypatch):
    rows = [(i, prose(i, 30)) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample: seen.append([r[0] for r in sample]))
    for bound in (toxicity.SAMPLE_ROWS, 200, 3):
        toxicity.train(documents(rows), labels, sample_rows=bound)
    whole, part, few = seen
    assert 700 < len(whole) < 900 and abs(len(part) - 200) <= 1
    assert abs(sum(part) / len(part) - sum(whole) / len(whole)) < 0.01
    assert set(few) == {0, 1} and len(few) <= 5
    toxicity.train(documents(rows), labels, sample_chars=sum(len(t) for _, t in rows) // 5)
    short = seen[-1]
    assert 150 < len(short) < 250 and abs(sum(short) / len(short) - sum(whole) / len(whole)) < 0.03
    toxicity.train(documents(rows), labels, sample_chars=1)
    assert sorted(seen[-1]) == [0, 1]


def test_half_of_the_labels_train_as_well(spark, documents, prose):
    """The steps don't follow the number of rows."""
    rows, labels = corpus(prose, 600, 7)
    docs, truth = documents(rows), {i: t for i, _, t in labels}
    for n in (600, 300):
        model = toxicity.train(docs, spark.createDataFrame(labels[:n], "doc_id long, quality int, toxic int"))
        out = toxicity.flagged(docs, model).where("held_out").collect()
        found = sum(r.predicted * truth[r.doc_id] for r in out)
        wrong = sum(r.predicted * (1 - truth[r.doc_id]) for r in out)
        assert found >= 0.9 * sum(truth[r.doc_id] for r in out) and wrong <= 0.05 * len(out), (n, found, wrong)


def test_scores_equal_a_plain_recomputation():
    """The mean weight of the 3- to 5-grams inside words, one gram at a time."""
    np = toxicity.np
    weights = np.random.default_rng(3).normal(size=toxicity.BUCKETS)
    model = toxicity.Model(weights, 0.3, -0.2)
    texts = ["Du  bist\tein x", "", "é" * 30, "a b c"]
    whole = np.concatenate([model.of_block(at, c) for _, at, c in toxicity._blocks(texts)])
    for text, got in zip(texts, whole, strict=True):
        line = " " + "".join(" " if ch.isspace() else ch for ch in text.lower()) + " "
        found = []
        for n in toxicity.GRAMS:
            for i in range(len(line) - n + 1):
                if " " not in line[i + 1 : i + n - 1]:
                    ((at, bucket),) = list(toxicity._grams(np.array([ord(ch) for ch in line[i : i + n]], np.uint32)))[n - 3 :]
                    found.append(weights[bucket[0]])
        mean = (sum(found) + toxicity.USUAL_GRAMS * -0.2) / (len(found) + toxicity.USUAL_GRAMS)
        assert abs(got - 1 / (1 + np.exp(-(mean + 0.3)))) < 1e-9
