import hashlib
import math
import random
import zlib

import pytest

from tidebar.llm import prefix_trie as P


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", (text or "")[:32], digest, text or ""))
    own = {c: [(t[2], t[5]) for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:] if rebuild else ts)
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    out = {}

    for s in sorted(members, key=len, reverse=True):
        under = [out[k] for k in kids.get(s, [])]
        leaves = sum(u[5] for u in under) or 1
        saved = sum(u[6] for u in under) + (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0)
        ends = ",".join(str(c) for c in sorted(members[s]) if len(seqs[c]) == len(s))
        parent = min(members[s[:-1]]) if s else None
        out[s] = (min(members[s]), len(s), parent, len(members[s]), len(under), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def frame(spark, rows):
    """Conversations with columns of names that the operator uses inside."""
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn int, role string, text string, conv int, depth int, digest string")


def got(df):
    return sorted(tuple(r) for r in P.rebuilt_trie(df).collect())


def talks(rng, n, turns=12):
    """Conversations that branch often, with copies and prefixes of others."""
    pool, rows = [], []
    for c in range(n):
        seq = list(rng.choice(pool)[: rng.randrange(turns)]) if pool and rng.random() < 0.7 else []
        seq += [(rng.choice(("user", "assistant", None)), rng.choice(("a", "b", "ä", "", None, "a longer text"))) for _ in range(rng.randrange(turns // 2))]
        pool.append(seq)
        c = c * 3 + 1 if c % 2 else c * 5 - 20
        rows += [(c, i if i else None, r, t) for i, (r, t) in enumerate(seq)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = talks(rng, 150)
    assert got(frame(spark, rows)) == brute(rows)


def test_given_table_and_plain_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert got(df) == brute(rows)
    nodes, ends = P.conversation_trie(df)
    want = brute(rows, rebuild=False)
    assert sorted(tuple(r) for r in P.with_ends_digest(nodes, ends).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()) == want
    assert ends.count() == df.select("conv_id").distinct().count()


def test_long_conversations_cross_chunks_and_copies_fill_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 3)
    monkeypatch.setattr(P, "ID_BITS", 2)
    rng = random.Random(7)
    long = [("user", f"t{i % 5}") for i in range(90)]
    rows = []
    for c in (5, 10, 15, 20, 25, 33, 34, 38):
        seq = list(long)
        if c in (15, 25):
            seq[rng.randrange(30, 80)] = ("user", "other")
        seq = seq[: rng.randrange(20, 90)] if c in (20, 34) else seq
        rows += [(c, i, *t) for i, t in enumerate(seq)]
    rows += [(c, i, "user", f"same {i}") for c in range(100, 160) for i in range(11)]
    assert got(frame(spark, rows)) == brute(rows)


def test_edges(spark):
    assert got(frame(spark, [])) == [] and got(frame(spark, [(None, 1, "user", "x")])) == []
    rows = [(0, None, None, None), (0, None, "", ""), (0, 3, "user", "x"), (0, 3, "user", "x"), (1, 1, "user", "x"), (7, 2, "a", "é" * 3000), (7, 2, "b", ""), (-3, 0, "user", "x"), (None, 1, "u", "v"), (104, 1, "s", "y")]
    assert got(frame(spark, rows)) == brute(rows)
