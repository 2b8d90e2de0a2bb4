import re

from tidebar.llm import license_scan as L


def grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def test_finds_every_template_wherever_it_stands(spark, documents, prose):
    rows, want = [], set()
    for i, (name, text) in enumerate(L.TEMPLATES.items()):
        for j, lead in enumerate((0, 3, 17, 131, 1200)):
            rows.append((10 * i + j, f"{prose(i, lead)} {text.upper() if j == 1 else text} {prose(i + 50, 300 - j)}"))
            want.add((10 * i + j, name))
    rows += [(900, prose(3, 5000)), (901, "the MIT of licensed under version work")]
    got = {(r.doc_id, r.license): r for r in L.scan(documents(rows), L.default_templates(spark)).collect()}
    assert want <= set(got)
    for (i, name), r in got.items():  # exact: the whole text holds at least the share that the window shows
        t = grams(L.TEMPLATES[name])
        assert len(t & grams(dict(rows)[i])) / len(t) >= r.containment >= L.CONTAINMENT
    assert not {i for i, _ in got} & {900, 901}


def test_bands_are_enough():
    assert 1 - (1 - L.SIMILARITY) ** L.BANDS >= L.TARGET


def test_edges(spark, documents):
    own = spark.createDataFrame([("two", "alpha beta"), ("none", None), ("none", ""), (None, "alpha beta gamma delta")], "license string, text string")
    rows = [(1, "alpha beta"), (2, None), (3, ""), (None, "x alpha beta gamma delta y"), (4, "alpha beta gamma delta"), (4, "alpha beta gamma delta")]
    got = {(r.doc_id, r.license): r.containment for r in L.scan(documents(rows), own).collect()}
    assert got == {(1, "two"): 1.0, (None, None): 1.0, (4, None): 1.0}
    assert L.scan(documents([]), own).collect() == []
    assert L.scan(documents(rows), own.limit(0)).collect() == []
