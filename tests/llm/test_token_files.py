import numpy as np

from tidebar.llm import token_files as T


def test_round_trip_counts(documents, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_IDS", 500)
    texts = [prose(i, 1 + 37 * i) for i in range(25)] + ["", None, "ä𝄞 \n\n x", "a" * 5000]
    out = T.count_tokens(documents(list(enumerate(texts))), str(tmp_path)).collect()
    enc = T.encoder()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    for r in out:  # the ids that stand there are the text's
        ids = np.fromfile(tmp_path / r.file, T.DTYPE)[r.start : r.start + r.n_tokens]
        assert enc.decode(ids.tolist()) == (texts[r.doc_id] or "")


def test_scan_of_any_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 9, 400).astype("<u2")
    ids[rng.integers(0, 400, 60)] = 7
    ids[-1] = 1
    ids.tofile(tmp_path / "a.bin")
    np.array([7, 7, 7], "<u2").tofile(tmp_path / "b.bin")
    want, start = [], 0
    for e in np.flatnonzero(ids == 7).tolist():
        want.append((len(want), start, e - start, True))
        start = e + 1
    want.append((len(want), start, 400 - start, False))
    files = spark.createDataFrame([(str(tmp_path / "a.bin"), 400), (str(tmp_path / "b.bin"), 3), (str(tmp_path / "c.bin"), 0)], "path string, ids long")
    for block in (1, 7, 64, 1000):
        got = T.scan_token_files(files, str(tmp_path), end=7, block_ids=block).collect()
        assert sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in got if r.path.endswith("a.bin")) == want
        assert sorted((r.ordinal, r.n_tokens) for r in got if r.path.endswith("b.bin")) == [(0, 0), (1, 0), (2, 0)]


def test_edges(documents, tmp_path):
    assert T.count_tokens(documents([]), str(tmp_path / "none")).collect() == []
    out = T.count_tokens(documents([(None, "x y"), (None, "x y")]), str(tmp_path / "twice")).collect()
    assert [(r.doc_id, r.n_tokens) for r in out] == [(None, 2)] * 2


def test_long_runs(monkeypatch):
    import random
    import re
    import time

    enc = T.encoder()
    rng = random.Random(2)
    # cut by hand or not, the ids are the same
    monkeypatch.setattr(T, "LONG_BLANK", re.compile(T.LONG_BLANK.pattern.replace("20000", "2")))
    for _ in range(300):
        text = "".join(rng.choice((" ", "  ", "\n", "\t", " ", "　", "\x1c", "a", "word", "1", "'s", ".", "é")) for _ in range(rng.randrange(30)))
        assert T.encode(enc, text) == enc.encode_ordinary(text)
    monkeypatch.undo()
    t0 = time.time()
    for text in (" " * 2_000_000, "a" + " \n" * 1_000_000 + "b", "x" * 2_000_000, "word " * 200_000):
        ids = T.encode(enc, text)
        assert enc.decode(ids) == text
    assert time.time() - t0 < 60
