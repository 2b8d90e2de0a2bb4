"""Benchmark decontamination by greedy string tiling.

Tiles are runs of equal words in a text and a benchmark item, none overlapping another on
either side. Seeds are the Karp-Rabin hashes of ``min_match`` words, rolled over all texts
of a block at once and joined to the hashes of the items. A pair of the wanted coverage
shares so many seeds that it must share one of the item's rarest, so only those retrieve;
then the pair's shared seeds, as sets of places in the item, have to be able to cover
enough of it. Only such pairs are tiled: equal seeds that follow each other on a diagonal
are one maximal run, of which the two ends are kept; the longest run is marked first, what
overlaps it is cut down and waits again, until no run of ``min_match`` words is left. Among
equally long runs the one that begins first in the item comes first, then the one that begins
first in the text. The share of an item's words under tiles is its coverage, so a passage
counts whatever the order of its parts.

The benchmark is a stated query set: it is read in blocks of bounded bytes, and each block
is sent to the tasks and held against all rows; no row is shuffled. In memory a block takes
about five times its bytes.

Edge cases: null or empty texts match nothing; items without words match nothing; items
shorter than ``min_match`` words must occur whole; repeated rows and items each give their
rows; texts are taken whole at any length, and where a seed occurs often in both text and
item, places are gone through in steps of ``STEP``, so memory follows the runs, of which one
repeated word makes as many as text and item have words together; empty tables give empty
results; columns other than those named are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.words import SMALL_BLOCK, block_words, grams, pieces

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_BYTES = 32 << 20
STEP = 1 << 20  # pairs of places looked at in one go
_BITS = 20


@dataclass
class Seeds:
    """Seeds of the items that are matched by runs of at least ``n`` words."""

    n: int
    members: np.ndarray  # items
    bounds: np.ndarray  # member m has the seeds bounds[m] to bounds[m + 1]
    seeds: np.ndarray
    rare: np.ndarray  # sorted seeds that retrieve
    owner: np.ndarray  # their members
    seen: np.ndarray  # leading bits of what retrieves


def _seeds(words: list[np.ndarray], members: np.ndarray, n: int, coverage: float) -> Seeds:
    sizes = np.array([len(words[i]) for i in members])
    count = sizes - n + 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    seeds = np.concatenate([grams(words[i], n) for i in members])
    owner = np.repeat(np.arange(len(members)), count)
    _, code, often = np.unique(seeds, return_inverse=True, return_counts=True)
    # a covered word lies under one of n places, so this many places are shared at least
    need = np.maximum(np.ceil(coverage * sizes / n - 1e-9).astype(np.int64), 1)
    order = np.lexsort((seeds, often[code], owner))
    rank = np.arange(len(seeds)) - bounds[owner]
    order = order[rank <= (count - need)[owner]]
    order = order[np.argsort(seeds[order], kind="stable")]
    seen = np.zeros(1 << _BITS, bool)
    seen[(seeds[order] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Seeds(n, members, bounds, seeds, seeds[order], owner[order], seen)


def _expand(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for the places lo to hi of each row, about ``STEP`` at a time."""
    many = hi - lo
    total = np.cumsum(many)
    first = 0
    while first < len(many):
        base = int(total[first] - many[first])
        last = max(int(np.searchsorted(total, base + STEP, "right")), first + 1)
        width = many[first:last]
        yield np.repeat(np.arange(first, last), width), np.arange(width.sum()) + np.repeat(lo[first:last] - (total[first:last] - width - base), width)
        first = last


def runs(item: np.ndarray, text: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place in item and text, and number of seeds, of each maximal run of equal seeds; seed i of the item is at the text's places order[lo[i]:hi[i]]."""
    ends = []
    for i, at in _expand(lo, hi):
        j = order[at]
        opens = (i == 0) | (j == 0) | (item[i - 1] != text[j - 1])
        closes = (i == len(item) - 1) | (j == len(text) - 1)
        closes |= item[np.minimum(i + 1, len(item) - 1)] != text[np.minimum(j + 1, len(text) - 1)]
        ends.append((i[opens], j[opens], i[closes], j[closes]))
    i, j, i_end, j_end = (np.concatenate(x) for x in zip(*ends, strict=True))
    begin, end = np.lexsort((i, j - i)), np.lexsort((i_end, j_end - i_end))
    return i[begin], j[begin], i_end[end] - i[begin] + 1


class Items:
    """The seeds of one block of benchmark items."""

    def __init__(self, ids: list, texts: list, min_match: int, coverage: float = COVERAGE):
        self.ids = ids
        self.coverage = coverage
        words: list[np.ndarray] = []
        for _, bounds, h in block_words(texts):
            words += [h[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
        self.sizes = np.array([len(w) for w in words], np.int64)
        spans = np.minimum(self.sizes, min_match)
        self.groups = [_seeds(words, np.flatnonzero(spans == n), int(n), coverage) for n in np.unique(spans[spans > 0])]

    def matches(self, texts: list) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, covered words, tiles, item words) of each pair that reaches the coverage."""
        for first, bounds, h in block_words(texts, budget=SMALL_BLOCK):
            for own in self.groups:
                g = grams(h, own.n)
                at = np.flatnonzero(own.seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
                doc = np.searchsorted(bounds, at, "right") - 1
                real = at + own.n <= bounds[np.minimum(doc + 1, len(bounds) - 1)]
                at, doc = at[real], doc[real]
                lo = np.searchsorted(own.rare, g[at], "left")
                real = own.rare[np.minimum(lo, len(own.rare) - 1)] == g[at]
                doc, lo = doc[real], lo[real]
                for d in np.unique(doc):
                    mine = np.unique(lo[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")])
                    yield from self._text(own, mine, g[bounds[d] : bounds[d + 1] - own.n + 1], first + int(d))

    def _text(self, own: Seeds, found: np.ndarray, text: np.ndarray, row: int) -> Iterator[tuple[int, int, int, int, int]]:
        hi = np.searchsorted(own.rare, own.rare[found], "right")
        members = np.zeros(0, np.int64)
        for _, at in _expand(found, hi):
            members = np.union1d(members, own.owner[at])
        order = np.argsort(text, kind="stable")
        ranked = text[order]
        for m in members:
            item, k = own.seeds[own.bounds[m] : own.bounds[m + 1]], int(own.members[m])
            size = int(self.sizes[k])
            lo, hi = np.searchsorted(ranked, item, "left"), np.searchsorted(ranked, item, "right")
            reach = np.zeros(size + 1, np.int64)
            shared = np.flatnonzero(hi > lo)
            reach[shared] += 1
            reach[shared + own.n] -= 1
            if (np.cumsum(reach[:size]) > 0).sum() < self.coverage * size:
                continue
            i, j, length = runs(item, text, order, lo, hi)
            covered, tiles = tile(i, j, length + own.n - 1, own.n, size)
            if covered >= self.coverage * size:
                yield row, k, covered, tiles, size


def tile(i: np.ndarray, j: np.ndarray, lengths: np.ndarray, n: int, size: int) -> tuple[int, int]:
    """(covered words, tiles) of the greedy tiling, from the first places and words of the maximal runs."""
    heap = list(zip((-lengths).tolist(), i.tolist(), j.tolist(), strict=True))
    heapq.heapify(heap)
    mine = np.zeros(size, bool)
    taken: dict[int, list[tuple[int, int]]] = defaultdict(list)  # marked spans of the text by 1024 words
    covered = tiles = 0
    room = size  # longest unmarked stretch of the item
    while heap and room >= n:
        k, a, b = heapq.heappop(heap)
        k = -k
        free = ~mine[a : a + k]
        if not free.any():
            continue
        for page in range(b >> 10, (b + k >> 10) + 1):
            for s, e in taken[page]:
                free[max(s - b, 0) : max(e - b, 0)] = False
        if free.all():
            mine[a : a + k] = True
            for page in range(b >> 10, (b + k >> 10) + 1):
                taken[page].append((b, b + k))
            covered, tiles = covered + k, tiles + 1
            room = int(np.diff(np.flatnonzero(np.concatenate([[True], mine, [True]]))).max()) - 1
            continue
        edge = np.diff(np.concatenate([[0], free.view(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if e - s >= n:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return covered, tiles


def item_blocks(items: DataFrame, id_col: str, text_col: str, min_match: int, coverage: float) -> Iterator[Items]:
    """The benchmark in blocks of bounded bytes."""
    own = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = total // BLOCK_BYTES + 1
    for b in range(count):
        part = own if count == 1 else own.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b)
        rows = sorted(map(tuple, part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield Items([r[0] for r in rows], [r[1] for r in rows], min_match, coverage)


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, covered_words, n_tiles) of each text and item whose tiles cover enough of the item."""
    out = None
    for block in item_blocks(items, item_col, item_text_col, min_match, coverage):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids = batch.column(0)
                found = list(own.matches(batch.column(1).to_pylist()))
                if found:
                    rows, item, covered, tiles, size = (list(x) for x in zip(*found, strict=True))
                    share = [c / s for c, s in zip(covered, size, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array([own.ids[k] for k in item], pa.int64()), pa.array(share), pa.array(covered, pa.int64()), pa.array(tiles, pa.int64())], names=["doc_id", "item_id", "coverage", "covered_words", "n_tiles"])

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, item_id long, coverage double, covered_words long, n_tiles long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_overlaps(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; no shuffle."""
    for block in item_blocks(items, item_col, item_text_col, min_match, coverage):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        place = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for first, texts in pieces(batch.column(place)):
                    for row, *_ in shared.value.matches(texts):
                        keep[first + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
