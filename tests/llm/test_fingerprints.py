import hashlib

from tidebar.llm import fingerprints


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_and_edits_against_brute_force(documents, prose):
    texts = [prose(i, 20 + 13 * i) for i in range(30)] + ["ä𝄞 " * 40, "one", "two words", prose(99, 9_000)]
    texts[7] = texts[6]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(documents([(3 * i, t) for i, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts)
    errors = []
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[3 * i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard(shingles(t), shingles(edited)), r.near_next - jaccard(shingles(t), shingles(after))]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[18].fingerprint == got[21].fingerprint and got[18].near_next == 1.0
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.06 and max(map(abs, errors)) < 0.25


def test_estimate_has_no_bias_with_few_shingles(documents, prose):
    """Densified bins of short texts estimate as well as full ones on average."""
    rows, want = [], []
    for s in range(60):
        w = prose(s, 40).split()
        rows += [(2 * s, " ".join(w)), (2 * s + 1, " ".join([*w[:30], *prose(1000 + s, 10).split()]))]
        want.append(jaccard(shingles(rows[-2][1]), shingles(rows[-1][1])))
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprint_edits(documents(rows)).collect()}
    assert abs(sum(got[2 * s] - w for s, w in enumerate(want)) / 60) < 0.04


def test_edge_cases(spark, documents):
    rows = [(None, "a b c d e f g"), (1, None), (1, None), (2, ""), (5, "x y z"), (5, "x y z"), (5, "other text")]
    out = fingerprints.fingerprint_edits(documents(rows)).collect()
    assert len(out) == len(rows)
    empty = [r for r in out if r.n_chars == 0]
    assert len(empty) == 3 and {r.fingerprint for r in empty} == {"0" * 256}
    assert len({r for r in out if r.doc_id == 5 and r.n_chars == 5}) == 1  # repeated rows give equal rows
    assert fingerprints.fingerprint_edits(documents([])).collect() == []
    alone = fingerprints.fingerprint_edits(documents([(9, "a b c d e f g h")])).collect()[0]
    assert alone.near_next == 1.0


def test_no_python_in_the_plan(documents):
    plan = fingerprints.fingerprint_edits(documents([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
