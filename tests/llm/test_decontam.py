import random
import time
import tracemalloc

from tidebar.llm import decontam


def brute(item, text, n):
    """Greedy string tiling by the definition, word by word."""
    a, b = item.lower().split(), text.lower().split()
    n = min(n, len(a))
    ma, mb, tiles = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < n or not n:
            return sum(ma), tiles
        k, i, j = best
        ma[i : i + k] = [True] * k
        mb[j : j + k] = [True] * k
        tiles += 1


def test_against_brute_force(spark, documents, prose):
    rng = random.Random(3)
    items = [prose(i, n) for i, n in enumerate((30, 24, 12, 5, 3, 1, 40))]
    items[6] = " ".join(["a b c d e f g"] * 5)
    texts = [prose(100, 60), "", "a b c d e f g a b c d e f g"]
    for it in items:
        w = it.split()
        parts = [w[k : k + 8] for k in range(0, len(w), 8)]
        rng.shuffle(parts)
        hole = [x if rng.random() > 0.12 else "zzz" for x in w]
        texts += [f"{prose(5, 20)} {it.upper()} {prose(6, 20)}", " ".join(sum(([*p, "mid"] for p in parts), [])), " ".join(hole), " ".join(w[: len(w) // 3])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for share in (0.5, 0.8):
        got = {(r.doc_id, r.item_id): r for r in decontam.find_overlaps(documents(list(enumerate(texts))), bench, coverage=share).collect()}
        want = {}
        for d, t in enumerate(texts):
            for i, it in enumerate(items):
                covered, tiles = brute(it, t, decontam.MIN_MATCH)
                if covered and covered >= share * len(it.split()):
                    want[d, i] = (covered, tiles)
        assert {k: (r.covered_words, r.n_tiles) for k, r in got.items()} == want


def test_small_alphabets_against_brute_force(monkeypatch):
    """Texts of two or three words tie often and match in many places."""
    rng = random.Random(8)
    for step in (decontam.STEP, 7):
        monkeypatch.setattr(decontam, "STEP", step)
        for trial in range(60):
            words = "ab" if trial % 2 else "abc"
            items = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(3)] + ["a " * 20]
            texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(4)] + ["a " * 25 + "b"]
            share, n = rng.choice((0.1, 0.5, 0.9, 1.0)), rng.choice((2, 3, 5))
            got = {(d, i): (c, k) for d, i, c, k, _ in decontam.Items(list(range(4)), items, n, share).matches(texts)}
            want = {}
            for d, t in enumerate(texts):
                for i, it in enumerate(items):
                    covered, tiles = brute(it, t, n)
                    if covered and covered >= share * len(it.split()):
                        want[d, i] = (covered, tiles)
            assert got == want


def test_one_word_repeated_needs_no_square():
    tracemalloc.start()
    began = time.monotonic()
    text = "spam " * 200_000
    items = ["spam " * 400, "spam " * 400 + "ham", "egg " + "spam " * 700, "spam egg " * 300]
    got = {i: (c, k) for _, i, c, k, _ in decontam.Items(list(range(4)), items, 5).matches([text, None])}
    assert got == {0: (400, 1), 1: (400, 1), 2: (700, 1)}
    assert time.monotonic() - began < 60 and tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_a_common_stem_retrieves_no_item(prose):
    stem = "which of the following is"
    items = [f"{stem} {prose(i, 25)}" for i in range(3000)]
    own = decontam.Items(list(range(3000)), items, 5)
    met = []
    text = own._text
    own._text = lambda group, found, *rest: met.append(found) or text(group, found, *rest)
    assert list(own.matches([f"{prose(9001, 40)} {stem} {prose(9002, 40)}", f"x {items[7]} y"])) == [(1, 7, 30, 1, 30)]
    assert len(met) == 1


def test_blocks_give_the_same(spark, documents, prose, monkeypatch):
    items = [(i, prose(i, 20)) for i in range(12)]
    docs = documents([(i, f"{prose(50 + i, 30)} {t}") for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.find_overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, decontam.find_overlaps(docs, bench).collect())) == whole and len(whole) == 12
    assert decontam.drop_overlaps(docs, bench).count() == 0


def test_edges(spark, documents):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta"), (3, "omega")], "item_id long, text string")
    rows = [(1, None), (2, ""), (None, "x alpha beta gamma delta epsilon zeta"), (4, "Omega"), (4, "Omega"), (5, "clean words")]
    got = sorted(map(str, ((r.doc_id, r.item_id) for r in decontam.find_overlaps(documents(rows), bench).collect())))
    assert got == ["(4, 3)", "(4, 3)", "(None, None)"]
    kept = decontam.drop_overlaps(documents(rows), bench)
    assert kept.columns == documents(rows).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5"]
    assert decontam.find_overlaps(documents([]), bench).collect() == [] and decontam.find_overlaps(documents(rows), bench.limit(0)).collect() == []
