"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Two sets of shingles link when ``den * |A & B| >= num * |A | B|``; words a shingle, num and
den are parameters, 3, 90 and 100 unless others are given. Sizes are cut into bands;
a band's instance serves pairs whose larger set lies in it, so a set takes part in its own
band's instance and, if its partners can be that large, in the next one's. In an instance
the two sets differ in at most ``k`` elements. The domain of shingle hashes is cut into
``k // 2 + 1`` parts, of which one must hold at most one difference; each part is cut into
three, and each pair of the three is a signature: with one difference, some pair is equal.
No linked pair is lost; every candidate is verified on the sets themselves.

Most sets link with nothing, and a few of their elements show it: of the first elements of
a set, by hash, a number that follows from its size must be among the first elements of other sets
(prefix filter). Only sets of which that holds get signatures.

Sets with equal elements are one node (their rows are copies). Signature groups are
compared star-wise with their head, and then only across components, so large groups of
alike texts are not expanded into all pairs. Parity bits of the sets, which travel with the
members of a group, bound their difference from below; only pairs within the bound are verified. Signatures that a sample shows to be very
frequent are salted; the sample only steers the work.

Edge cases: a null text counts as empty; a text without words has the empty set, links
with nothing and is its own component; repeated rows each give a row; null ids keep their
rows, and a component's id is the least id that isn't null. An empty table gives an empty
result; columns other than the id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.common import saved
from tidebar.llm.graph import components
from tidebar.llm.words import SMALL_BLOCK, block_words, mix, pieces, text_grams

WORDS = 3
MIN_NUM, MIN_DEN = 90, 100
BAND = 0.75
# ids of candidate sets go to the tasks only below this many; beyond, texts are shuffled to them
BROADCAST_ROWS = 500_000
# a signature is salted from this many rows of the sample on, for the most frequent ones
SAMPLE, HEAVY_ROWS, HEAVY_TOP, SALTS = 64, 64, 10_000, 64
STAR_ROUNDS = 4
# rows of a group that are compared in one run
RUN = 4_096
# a prefix is longer than needed by one element in so many, and a task's output holds about so many at once
EXTRA, HELD = 20, 250_000


@dataclass(frozen=True)
class Likeness:
    """Words a shingle, and the least Jaccard similarity of a link as a fraction."""

    words: int = WORDS
    num: int = MIN_NUM
    den: int = MIN_DEN

    def __post_init__(self) -> None:
        if self.words < 1 or not 0 < self.num <= self.den:
            raise ValueError(f"no likeness: {self}")


DEFAULT = Likeness()


def band_edges(largest: int, like: Likeness = DEFAULT) -> np.ndarray:
    """First size of each band up to the one that holds ``largest`` and the one after it; a linked set is at most one band up."""

    def after(edge: int) -> int:
        return max(int(edge / BAND), edge * like.den // like.num) + 1

    edges = [1]
    while edges[-1] <= largest:
        edges.append(after(edges[-1]))
    edges.append(after(edges[-1]))
    return np.array(edges, np.int64)


def differences(size: int, like: Likeness = DEFAULT) -> int:
    """Most elements in which two linked sets of at most ``size`` can differ."""
    return 2 * size * (like.den - like.num) // (like.den + like.num)


def signatures(elements: np.ndarray, edges: np.ndarray, like: Likeness = DEFAULT) -> np.ndarray:
    """All signatures of a set of mixed 64-bit elements."""
    n = len(elements)
    own = int(np.searchsorted(edges, n, "right")) - 1
    instances = [own] + [own + 1] * int(n * like.den // like.num >= edges[own + 1])
    out = []
    for j in instances:
        k = differences(int(edges[j + 1]) - 1, like)
        if not k:  # only equal sets link
            continue
        parts = 3 * (k // 2 + 1)
        place = ((elements >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, place, elements)
        sums = mix(sums + np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 3)
        tag = np.uint64(j * 4 + 1)
        out += [mix(sums[:, a] + sums[:, b] + tag + np.uint64(c)) for c, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)))]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _set_id(u: np.ndarray) -> int:
    return int(mix(np.array([int(np.bitwise_xor.reduce(u)) ^ int(mix(u).sum(dtype=np.uint64))], np.uint64)).view(np.int64)[0])


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    for _, some in pieces(texts):
        for _, bounds, h in block_words(some, budget=SMALL_BLOCK):
            g, gb = text_grams(h, bounds, words)
            for i in range(len(gb) - 1):
                yield np.unique(g[gb[i] : gb[i + 1]])


def least_shared(size: int) -> int:
    """Shared elements that a prefix is made to hold beyond the one it needs, by the size of a set."""
    return size // EXTRA + 1


def prefix(size: int, like: Likeness = DEFAULT) -> tuple[int, int]:
    """How many first elements of a set say whether it can link, and how many of them other sets must have among theirs.

    Of a set of n, at most n - ceil(n * num / den) elements are missing in a linked one, so the first l
    elements that both have, in one order of all elements, lie among the first n - ceil(n * num / den) + l of either.
    A linked set holds at least ceil(n * num / den) elements; its l may be that much less.
    """
    least = -(-size * like.num // like.den)
    smaller = -(-least * like.num // like.den)
    return size - least + min(least, least_shared(size)), min(smaller, least_shared(least))


def _batch(parts: list[np.ndarray], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(parts, axis=1)], names=list(names))


def _named(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sids, ns = [], []
        for u in _sets(batch.column(2), like.words):
            sids.append(_set_id(u) if len(u) else None)
            ns.append(len(u))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(ns, pa.int64())], names=["key", "tkey", "sid", "n"])


def _firsts(batches: Iterator[pa.RecordBatch], like: Likeness, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(sig, sid, 0) of the first elements of each set, by their hashes, and (sid, sid, number) of those that are ``heavy``.

    Copies within a task are left out.
    """
    seen: set[int] = set()
    out: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for u in _sets(batch.column(0), like.words):
            sid = _set_id(u) if len(u) else None
            if sid is None or sid in seen:
                continue
            if len(seen) > 1_000_000:  # forgets, and then repeats the elements of some copies
                seen.clear()
            seen.add(sid)
            sigs = u[: prefix(len(u), like)[0]].view(np.int64)
            often = np.isin(sigs, heavy)
            if often.any():
                sigs = sigs[~often]
                out.append(np.array([[sid], [sid], [often.sum()]], np.int64))
            out.append(np.stack([sigs, np.full(len(sigs), sid), np.zeros(len(sigs), np.int64)]))
            held += len(sigs)
            if held > HELD:
                yield _batch(out, "sig", "sid", "often")
                out, held = [], 0
    if out:
        yield _batch(out, "sig", "sid", "often")


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, sid): each sid of the runs with several ones, once a run; heavy ones go through with their number."""
    last = None  # the sig and sid before, and whether that sid was given
    for batch in batches:
        sig, sid, often = (batch.column(i).to_numpy() for i in range(3))
        if (often > 0).any():
            yield pa.RecordBatch.from_arrays([pa.array(sid[often > 0]), pa.array(often[often > 0])], names=["sid", "shared"])
            sig, sid = sig[often == 0], sid[often == 0]
        if not len(sig):
            continue
        if last is not None:
            sig, sid = np.concatenate([[last[0]], sig]), np.concatenate([[last[1]], sid])
        first = np.ones(len(sig), bool)
        first[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
        sig, sid = sig[first], sid[first]
        shared = np.zeros(len(sig), bool)
        shared[1:] = sig[1:] == sig[:-1]
        shared[:-1] |= shared[1:]
        given = last is not None and last[2]
        last = (sig[-1], sid[-1], bool(shared[-1]) or (given and len(sig) == 1))
        if given:
            shared[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(sid[shared]), pa.array(np.ones(shared.sum(), np.int64))], names=["sid", "shared"])


def parity(elements: np.ndarray) -> bytes:
    """The parity of a set's elements in each of at least two places an element, a power of two.

    Two sets differ in at least as many elements as their parities have different bits; with
    half the places the second half of the bytes is folded onto the first by exclusive or.
    """
    places = max(64, 1 << (2 * len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of parity bytes as words of eight bytes, folded to ``width`` bytes."""
    return np.ascontiguousarray(np.bitwise_xor.reduce(rows.reshape(len(rows), -1, width), axis=1)).view(np.uint64)


def _may_link(different: np.ndarray, sizes: np.ndarray, like: Likeness) -> np.ndarray:
    return different * (like.den + like.num) <= sizes * (like.den - like.num)


def _grams(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sids, sets, first, held = batch.column(0), [], 0, 0
        for i, u in enumerate(_sets(batch.column(1), words)):
            sets.append(u)
            held += len(u)
            if held > HELD or i == len(sids) - 1:
                sizes = np.array([len(x) for x in sets], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([sids[first : i + 1], pa.array(sizes), pa.array(map(parity, sets), pa.binary()), lists], names=["sid", "n", "bits", "grams"])
                sets, first, held = [], i + 1, 0


def _signed(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    edges = band_edges(1 << 20, like)
    out: list[np.ndarray] = []
    held = 0
    for batch in batches:
        lists = batch.column(1)
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        for sid, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
            if b - a > edges[-3]:
                edges = band_edges(2 * int(b - a), like)
            sigs = signatures(flat[a:b], edges, like).view(np.int64)
            out.append(np.stack([sigs, np.full(len(sigs), sid)]))
            held += len(sigs)
            if held > HELD:
                yield _batch(out, "sig", "sid")
                out, held = [], 0
    if out:
        yield _batch(out, "sig", "sid")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, salt, sid): each distinct sid of a run with the run's first one.

    Of plain runs (salt -1) the first row is left out, of salted ones it is given too.
    """
    before = (None, None, None)
    head = 0
    for batch in batches:
        sig, salt, sid = (batch.column(i).to_numpy() for i in range(3))
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
        new[0] = (sig[0], salt[0]) != before[:2]
        again = np.zeros(len(sig), bool)
        again[1:] = ~new[1:] & (sid[1:] == sid[:-1])
        again[0] = not new[0] and sid[0] == before[2]
        at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        heads = np.where(at >= 0, sid[np.maximum(at, 0)], head)
        keep = np.where(salt >= 0, ~again, ~new & ~again)
        before, head = (sig[-1], salt[-1], sid[-1]), heads[-1]
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(salt[keep]), pa.array(heads[keep]), pa.array(sid[keep])], names=["sig", "salt", "head", "sid"])


def _stars(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, salt): each one with the first of its run, of another component, where sizes and parities let them link."""
    head = None  # sig, salt, sid, comp, n and parity of the run's first row
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, salt, sid, comp, n = (batch.column(i).to_numpy() for i in range(5))
        bits = batch.column(5).to_pylist()
        if head is not None:
            sig, salt, sid, comp, n = (np.concatenate([[h], x]) for h, x in zip(head, (sig, salt, sid, comp, n)))
            bits = [head[5], *bits]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
        keep = (comp != comp[at]) & (np.minimum(n, n[at]) * like.den >= np.maximum(n, n[at]) * like.num)
        wide = np.array([len(b) for b in bits])
        found = []
        for own, other in {*zip(wide[keep].tolist(), wide[at[keep]].tolist())}:
            rows, width = np.flatnonzero(keep & (wide == own) & (wide[at] == other)), min(own, other)
            for part in np.array_split(rows, -(-len(rows) * max(own, other) // HELD)):
                x, y = (np.frombuffer(b"".join(bits[i] for i in p), np.uint8).reshape(len(p), -1) for p in (part, at[part]))
                different = np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(axis=1, dtype=np.int64)
                found.append(part[_may_link(different, n[part] + n[at[part]], like)])
        if found:
            rows = np.concatenate(found)
            a, b = sid[rows], sid[at[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        i = int(at[-1])
        head = (sig[i], salt[i], sid[i], comp[i], n[i], bits[i])


def _across(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, lo, hi): all pairs of different components that may link by size and parity, of the blocks lo and hi of a group."""

    def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.Table.from_batches(parts).sort_by("comp")
        lo, hi, block, sid, comp, n = (run.column(c).to_numpy() for c in ("lo", "hi", "block", "sid", "comp", "n"))
        bits = run.column("bits").to_pylist()
        width = min(map(len, bits))
        words = np.concatenate([_folded(np.frombuffer(b, np.uint8)[None], width) for b in bits])
        after = np.searchsorted(comp, comp, "right")
        for i in range(len(sid)):
            j = np.arange(after[i], len(sid))
            j = j[np.minimum(n[j], n[i]) * like.den >= np.maximum(n[j], n[i]) * like.num]
            if lo[0] != hi[0]:
                j = j[block[j] != block[i]]
            if len(j):
                j = j[_may_link(np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64), n[j] + n[i], like)]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[j], sid[i])), pa.array(np.maximum(sid[j], sid[i]))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and (a or any(held[0].column(i)[0].as_py() != keys[i, 0] for i in range(3))):
                yield from pairs(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from pairs(held)


def _heavy(sample: DataFrame) -> DataFrame:
    """The most frequent sigs of a sample, at most ``HEAVY_TOP`` rows."""
    often = sample.groupBy("sig").count().where(F.col("count") >= HEAVY_ROWS)
    return often.orderBy(F.desc("count"), "sig").limit(HEAVY_TOP).select("sig", F.lit(True).alias("heavy"))


def _alive(plain: DataFrame, own: DataFrame, like: Likeness) -> DataFrame:
    """The sets of ``own`` of whose first elements enough are other sets' first elements too; no linked set is lost.

    An element that a sample shows to be very frequent is shared, so its rows aren't shuffled.
    """
    def first(df: DataFrame, heavy: np.ndarray) -> DataFrame:
        return df.select("text").mapInArrow(lambda batches: _firsts(batches, like, heavy), "sig long, sid long, often long")

    sample = first(plain.where(F.pmod("tkey", F.lit(SAMPLE)) == 0), np.zeros(0, np.int64))
    heavy = np.array([r.sig for r in _heavy(sample).collect()], np.int64)
    shared = first(plain, heavy).repartition("sig").sortWithinPartitions("sig", "sid").mapInArrow(_several, "sid long, shared long")
    shared = shared.groupBy("sid").agg(F.sum("shared").alias("shared"))
    ceil = lambda n: F.floor((n * like.num + (like.den - 1)) / like.den)
    least = ceil(F.col("n"))
    need = F.least(ceil(least), F.floor(least / EXTRA) + 1)
    return saved(own.join(shared, "sid").where(F.col("shared") >= need).select("sid", "row.k", F.col("row.tkey").alias("tkey")))


def _groups(sets: DataFrame, like: Likeness) -> DataFrame:
    """(sig, sid, size of the group) of the signatures that several sets share; the same members are kept under one signature only."""
    signed = lambda df: df.select("sid", "grams").mapInArrow(lambda batches: _signed(batches, like), "sig long, sid long")
    heavy = F.broadcast(_heavy(signed(sets.where(F.pmod("sid", F.lit(SAMPLE)) == 0))))  # at most HEAVY_TOP rows
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("sid"), F.lit(SALTS))).otherwise(-1).cast("int")
    placed = signed(sets).join(heavy, "sig", "left").select("sig", salt.alias("salt"), "sid")
    runs = saved(placed.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "sid").mapInArrow(_runs, "sig long, salt int, head long, sid long"))
    tops = runs.where("salt >= 0").select("sig", F.col("head").alias("sid"))
    members = runs.select("sig", "sid").unionByName(runs.where("salt < 0").select("sig", F.col("head").alias("sid"))).unionByName(tops).distinct()
    shape = members.groupBy("sig").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("sid")).alias("print"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("print2"))
    one = shape.where("size > 1").groupBy("size", "print", "print2").agg(F.min("sig").alias("sig")).select("sig", "size")
    return saved(members.join(one, "sig"))


def _verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that link, by their elements; only sets of these pairs are shuffled."""
    met = saved(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct())
    grams = sets.select("sid", "grams").join(F.broadcast(met) if met.count() <= BROADCAST_ROWS else met, "sid", "left_semi")
    both = pairs.join(grams.toDF("b", "gb"), "b").join(grams.toDF("a", "ga"), "a")
    shared = both.select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("i"))
    return shared.where(F.col("i") * like.den >= (F.col("na") + F.col("nb") - F.col("i")) * like.num).select("a", "b")


def _labelled(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups that hold several components, with each member's component."""
    comp = components(links)
    out = groups.join(comp, groups.sid == comp.node, "left").select("sig", "sid", "size", F.coalesce("label", "sid").alias("comp"))
    mixed = out.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("sig")
    return saved(out.join(mixed, "sig"))


def _linked(groups: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links enough to span each component of the similarity graph."""
    bits = sets.select("sid", "n", "bits")
    parts = F.ceil(F.col("size") / RUN)
    links = tried = None
    state, total = groups.withColumn("comp", F.col("sid")), 0
    for r in range(STAR_ROUNDS):
        # each member meets one head of its group, or of its part of a large one; another in each round
        salt = F.pmod(F.xxhash64("sid", F.lit(r)), parts)
        order = F.xxhash64("comp", F.lit(r)), F.xxhash64("sid", F.lit(r))
        rows = state.join(bits, "sid").withColumn("salt", salt).repartition("sig", "salt").sortWithinPartitions("sig", "salt", *order)
        met = rows.select("sig", "salt", "sid", "comp", "n", "bits").mapInArrow(lambda batches: _stars(batches, like), "a long, b long").distinct()
        met = saved(met if tried is None else met.join(tried, ["a", "b"], "left_anti"))
        found = saved(_verified(met, sets, like))
        tried = met if tried is None else tried.unionByName(met)
        links = found if links is None else links.unionByName(found)
        state = _labelled(groups, links)
        n = found.count()
        total += n
        if r and 10 * n <= total:
            break
    # the pairs that are left: different components of one group, not met yet; large groups go by pairs of blocks
    block = state.join(bits, "sid").withColumn("block", F.pmod(F.xxhash64("sid"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    block = block.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    cells = block.select("sig", "lo", "hi", "block", "sid", "comp", "n", "bits").repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    rest = cells.mapInArrow(lambda batches: _across(batches, like), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    return links.unionByName(_verified(saved(rest), sets, like))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = DEFAULT) -> DataFrame:
    """One row per document: its set's size and the least id reachable by links."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    base = saved(plain.mapInArrow(lambda batches: _named(batches, like), "key long, tkey long, sid long, n long"))
    # the row that stands for a set: its least id, then its least text hash
    row = F.struct(F.coalesce("key", F.lit(-(1 << 63)).cast("long")).alias("k"), "tkey")
    own = base.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.min("key").alias("least"), F.count("*").alias("copies"), F.min(row).alias("row"))
    own = saved(own)
    wanted = _alive(plain, own, like)
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    picked = plain.withColumn("k", F.coalesce("key", F.lit(-(1 << 63)).cast("long"))).join(wanted, ["k", "tkey"]).select("sid", "text")
    sets = saved(picked.mapInArrow(lambda batches: _grams(batches, like.words), "sid long, n long, bits binary, grams array<long>"))
    if sets.groupBy("sid").count().where("count > 1").limit(1).count():  # a row given twice
        sets = saved(sets.dropDuplicates(["sid"]))
    groups = _groups(sets, like)
    labels = components(_linked(groups, sets, like))
    named = labels.join(own, labels.node == own.sid).select("sid", "label", "least")
    roots = named.groupBy("label").agg(F.min("least").alias("root"))
    # only sets with copies or links say more than the row itself
    told = own.where("copies > 1").select("sid", "least").join(named.join(roots, "label").select("sid", "root"), "sid", "full").select("sid", F.coalesce("root", "least").alias("root"))
    return base.join(told, "sid", "left").select(F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "key").alias("component_id"))
