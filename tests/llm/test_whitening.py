import numpy as np
import pytest

from tidebar.llm import whitening as W


def plain(vectors, components=16):
    """All figures again by numpy's own eigenvectors, from the list of kept vectors."""
    x = np.array([[int(np.floor(64.0 * float(c))) + 1_000_000 for c in v] for v in vectors])
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(0)
    y = listed - sums / n
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    return n, dev, (x - sums / n) @ vecs[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def frame(spark, rows):
    """vec_id, embedding and columns of names that the operator uses inside."""
    return spark.createDataFrame([(i, v, 1, 2.0, [3]) for i, v in rows], "vec_id long, embedding array<float>, id int, n double, x array<int>")


def test_against_plain_eigenvectors(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(400, 24)) @ rng.normal(size=(24, 24)) / 8).astype(np.float32)
    vectors = np.concatenate([base, np.repeat(base[:1], 300, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(9001, None), (9002, [None] * 24), (9003, [float("nan")] * 24), (9004, [0.0] * 23 + [float("inf")])]
    got = W.whiten(frame(spark, rows + bad)).toPandas().sort_values(["vec_id", "component"])
    n, dev, white, share = plain(vectors)
    assert n == 400 and len(got) == len(rows) * 16 and set(got.n) == {n}
    assert got.deviation.tolist() == np.repeat(dev, 16).tolist()
    w = got.whitened.to_numpy().reshape(-1, 16)
    sign = np.sign((w * white).sum(0))
    assert np.allclose(w * sign, white, atol=1e-8)
    assert np.allclose(got.explained.to_numpy().reshape(-1, 16), share, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = W.whiten(df).toPandas().sort_values(["vec_id", "component"])
    rows = df.orderBy("vec_id").collect()
    n, dev, white, share = plain([r.embedding for r in rows])
    assert got.deviation.tolist() == np.repeat(dev, 16).tolist() and set(got.n) == {n}
    w = got.whitened.to_numpy().reshape(-1, 16)
    assert np.allclose(w * np.sign((w * white).sum(0)), white, atol=1e-7) and got.identity_error.max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 16), share, rtol=1e-9)


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d, r in ((1, 1), (2, 2), (7, 3), (16, 16), (33, 20)):
        # eigenvalues over twelve orders of magnitude keep their relative precision
        b = rng.normal(size=(d, r)) * 10.0 ** -np.linspace(0, 6 if d > 7 else 2, r)
        a = b @ b.T
        low = W.pivoted_cholesky(a)
        assert np.allclose(low @ low.T, a, atol=1e-12 * np.abs(a).max())
        values, vectors = W.one_sided_jacobi(low)
        assert np.allclose(vectors.T @ vectors, np.eye(low.shape[1]), atol=1e-12)
        assert np.allclose(vectors * values @ vectors.T, a, atol=1e-12 * np.abs(a).max()) and (np.diff(values) <= 0).all()
    assert W.pivoted_cholesky(np.zeros((4, 4))).shape == (4, 0)
    seen = sorted((int(a), int(b)) for x, y in W._rounds(7) for a, b in zip(x, y, strict=True))
    assert seen == [(a, b) for a in range(7) for b in range(a + 1, 7)]


def test_edges(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        got = W.whiten(frame(spark, rows))
        assert got.columns == columns and got.count() == 0
    # one direction only, a vector of another length, repeated rows and a null id
    rows = [(1, [0.0, 0.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [2.0, 4.0]), (5, [1.0])]
    got = sorted(W.whiten(frame(spark, rows)).collect(), key=str)
    assert len(got) == 4 and {r.component for r in got} == {1} and {r.n for r in got} == {3}
    assert sorted(round(r.whitened, 9) for r in got) == pytest.approx([-(1.5**0.5), 0, 0, 1.5**0.5], abs=1e-8)
    assert [r.explained for r in got] == pytest.approx([1.0] * 4)
    # entries too large for exact longs: the deviation is null, entries outside the grid leave their row out
    got = W.whiten(frame(spark, [(1, [1e12]), (2, [-1e12]), (3, [0.5]), (4, [3e38])])).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3] and {r.deviation for r in got if r.vec_id != 3} == {None}
