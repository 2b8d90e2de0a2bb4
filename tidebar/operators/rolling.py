"""Sliding figures of a chunk in numpy: one vector step per place of the frame.

An engine window folds its frame anew for every row and figure. Here a frame's
places are walked once, each as a shifted copy of the whole chunk, with the same order of
sums, so the last bits are those of the window functions. Nulls are skipped as there.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from .chunks import KEYS

# the functions travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# name -> kind, one input or two, first and last place of the frame
Spec = tuple[str, Column | tuple[Column, Column], int, int]


def _places(x: np.ndarray, lo: int, hi: int) -> Iterator[np.ndarray]:
    padded = np.concatenate([np.full(-lo, np.nan), x])
    for k in range(lo, hi + 1):
        yield padded[k - lo : k - lo + len(x)]


def _count(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return sum((~np.isnan(s) for s in _places(x, lo, hi)), np.zeros(len(x)))


def _max(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    for s in _places(x, lo, hi):
        out = np.fmax(out, s)
    return out


def _min(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return -_max(-x, lo, hi)


def _mean(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    n, total = np.zeros(len(x)), np.zeros(len(x))
    for s in _places(x, lo, hi):
        known = ~np.isnan(s)
        n += known
        total += np.where(known, s, 0.0)
    return total / n


def _std(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    n, mean, m2 = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for s in _places(x, lo, hi):
        known = ~np.isnan(s)
        n += known
        delta = np.where(known, s - mean, 0.0)
        step = delta / np.where(known, n, 1.0)
        mean += step
        m2 += delta * (delta - step)
    return np.sqrt(m2 / n)


def _slope(y: np.ndarray, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    size = len(x)
    n, xm, ym, ck, m2 = (np.zeros(size) for _ in range(5))
    for t, s in zip(_places(y, lo, hi), _places(x, lo, hi), strict=True):
        known = ~np.isnan(t) & ~np.isnan(s)
        n += known
        per = np.where(known, n, 1.0)
        dx, dy = np.where(known, s - xm, 0.0), np.where(known, t - ym, 0.0)
        ym += dy / per
        ck += np.where(known, dx * (t - ym), 0.0)
        xm += dx / per
        m2 += dx * (dx - dx / per)
    return np.where(m2 == 0, np.nan, ck / m2)


def _first_top(x: np.ndarray, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The first ``at`` of the greatest value of a frame."""
    best, where = np.full(len(x), -np.inf), np.full(len(x), np.nan)
    for s, i in zip(_places(x, lo, hi), _places(at, lo, hi), strict=True):
        better = (s > best) | (np.isnan(where) & ~np.isnan(i))
        best, where = np.where(better & ~np.isnan(s), s, best), np.where(better, i, where)
    return where


def _rank_share(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Share of a frame's values that are not above the current one."""
    below = sum((s <= x for s in _places(x, lo, hi)), np.zeros(len(x)))
    return below / _count(x, lo, hi)


def _drawdown(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Deepest relative fall below the running maximum of a frame."""
    top, deep = np.full(len(x), np.nan), np.zeros(len(x))
    for s in _places(x, lo, hi):
        top = np.fmax(top, s)
        deep = np.fmin(deep, s / top - 1.0)
    return np.where(np.isnan(top), np.nan, deep)


KINDS: dict[str, Callable[..., np.ndarray]] = {
    "count": _count, "max": _max, "min": _min, "mean": _mean, "std": _std, "slope": _slope, "first_top": _first_top,
    "rank_share": _rank_share, "drawdown": _drawdown,
}


def rolled(d: DataFrame, specs: dict[str, Spec], keys: Sequence[str] = KEYS, index: str = "bar_index", only: Column | None = None) -> DataFrame:
    """Inside ``over_chunks``: one double column per spec, null where its frame holds nothing; frames end at the row or before.

    Rows that ``only`` leaves out count in frames but don't leave the task. Chunks of one task
    lie behind one another with a gap as long as the longest frame, so short ones share a step.
    """
    inputs: dict[str, str] = {}
    columns: dict[str, Column] = {}
    plan, gap = [], 0
    for name, (kind, cols, lo, hi) in specs.items():
        if not lo <= hi <= 0:
            raise ValueError("frames end at the row or before")
        used = []
        for c in cols if isinstance(cols, tuple) else (cols,):
            at = inputs.setdefault(str(c), f"_in{len(inputs)}")
            columns[at] = c.cast("double")
            used.append(at)
        plan.append((name, kind, used, lo, hi))
        gap = max(gap, -lo)
    kept, read, whole = list(d.columns), list(columns), only is None
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema] + [f"`{n}` double" for n in specs])
    # the row number also lays every chunk into one task, in order
    place = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(index))
    d = d.withColumns(columns | {"_place": place} | ({} if whole else {"_only": only}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = {at: np.full(gap, np.nan) for at in read}
        for b in batches:
            starts = b.column("_place").to_numpy() == 1
            at_row = gap + np.arange(len(starts)) + gap * np.cumsum(starts)
            line = {}
            for at in read:
                x = np.full(gap + len(starts) + gap * int(starts.sum()), np.nan)
                x[:gap], x[at_row] = tails[at], b.column(at).to_numpy(zero_copy_only=False)
                line[at], tails[at] = x, x[len(x) - gap :]
            out = b.select(kept)
            with np.errstate(all="ignore"):
                for name, kind, used, lo, hi in plan:
                    found = KINDS[kind](*[line[u] for u in used], lo, hi)[at_row]
                    out = out.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
            yield out if whole else out.filter(b.column("_only"))

    return d.mapInArrow(run, schema)
