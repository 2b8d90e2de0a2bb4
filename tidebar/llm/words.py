"""Vectorised word hashing over Arrow batches, shared by operators that run numpy inside tasks.

Words are found and hashed on the bytes of a whole block of texts at once: a running sum of
position-weighted byte values gives each word's polynomial, and a mixer spreads it over 64
bits. A block holds texts up to a byte budget, so memory does not follow the batch size; one
longer text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
# for tasks that hold other things beside a block, whose tables take some thirty times its bytes
SMALL_BLOCK, PIECE_ROWS = 1 << 20, 1_024
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers can be undone
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# one random value a byte, with A-Z as a-z
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
# for texts whose punctuation doesn't count: all ASCII but letters and digits separates
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out[:n]


_POWERS = {"n": 0, "up": None, "down": None}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        if n > 4 * BLOCK_BYTES:  # a very long text: don't keep its tables
            return powers(_BASE, n), powers(_INVERSE, n)
        _POWERS.update(n=n, up=powers(_BASE, n), down=powers(_INVERSE, n))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, gap_bytes: np.ndarray = _SPACE, step: int = 2 * BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of non-space bytes; A-Z count as a-z. Long inputs go in steps that end at a space."""
    if len(data) <= step:
        return _word_hashes(data, gap_bytes)
    found, at = [], 0
    while at < len(data):
        end = min(at + step, len(data))
        while end < len(data) and not gap_bytes[data[end]]:
            gap = np.flatnonzero(gap_bytes[data[end : end + step]])
            end = end + int(gap[0]) if len(gap) else min(end + step, len(data))
        s, e, h = _word_hashes(data[at:end], gap_bytes)
        found.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _word_hashes(data: np.ndarray, gap_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(gap_bytes[data], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def blocks(texts: list, budget: int = BLOCK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last, bytes, text starts): texts in UTF-8 with a line feed between; null is empty."""
    first, size, parts = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if parts and size + len(b) > budget:
            yield first, i, *_joined(parts)
            first, size, parts = i, 0, []
        parts.append(b)
        size += len(b) + 1
    if parts:
        yield first, len(texts), *_joined(parts)


def pieces(column: pa.Array, rows: int = PIECE_ROWS) -> Iterator[tuple[int, list]]:
    """(first row, texts) of a column, some rows at a time: a task needs no second copy of a whole batch."""
    for first in range(0, len(column), rows):
        yield first, column.slice(first, rows).to_pylist()


def _joined(parts: list[bytes]) -> tuple[bytes, np.ndarray]:
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return b"\n".join(parts) + b"\n", at


def block_words(texts: list, gap_bytes: np.ndarray = _SPACE, budget: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bounds, hashes): text first+i has the words hashes[bounds[i]:bounds[i+1]]."""
    for first, _, data, at in blocks(texts, budget):
        starts, _, h = word_hashes(np.frombuffer(data, np.uint8), gap_bytes)
        yield first, np.searchsorted(starts, at), h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; a polynomial rolled over the words, then mixed."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
    return mix(out)


def text_grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of every text of a block with their bounds; a text of fewer words gives one gram of all of them."""
    count = np.diff(bounds)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_bounds = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=out_bounds[1:])
    out = np.empty(out_bounds[-1], np.uint64)
    whole = grams(h, n)
    long = np.flatnonzero(count >= n)
    if len(long):
        src = np.repeat(bounds[:-1][long] - out_bounds[:-1][long], made[long])
        dst = np.concatenate([np.arange(out_bounds[i], out_bounds[i + 1]) for i in long]) if len(long) < len(made) else np.arange(out_bounds[-1])
        out[dst] = whole[dst + src]
    for i in np.flatnonzero((count > 0) & (count < n)):
        g = int(count[i])
        for x in h[bounds[i] : bounds[i + 1]]:
            g = (g + int(x)) * _BASE & _MASK
        out[out_bounds[i]] = mix(np.array([g], np.uint64))[0]
    return out, out_bounds
