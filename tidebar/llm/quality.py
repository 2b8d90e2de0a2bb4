"""Quality by positive-unlabelled learning: the non-negative unbiased risk of trusted positives and unlabelled text.

Every text becomes a few figures of its surface (kinds of characters, word lengths, repeats of
words, of runs of words and of lines), counted over the whole text in the tasks. A small network is
fitted to two bounded samples: rows labelled 1 are trusted positives, and texts whose labels are not
looked at are unlabelled. With the class prior p and the logistic loss l, the risk is

    p * E_pos[l(+1)] + max(0, E_unl[l(-1)] - p * E_pos[l(-1)]),

where the second part estimates the loss on negatives that nobody labelled. Where a batch makes
that part negative, the network fits its positives by heart; the step is then turned round. Labels
0 take no part in the risk. The prior is a parameter; by default it is the share of label 1
among the learnable labels, and where these hold no other class, the least ratio of
unlabelled to positive texts above a score, over all scores, that a first fit finds.

The number of steps follows the loss on a part of the samples that is not fitted, never the
held-out rows. Scoring needs no shuffle: a text's figures and the network in one pass.

Edge cases: a null text counts as empty; an empty text has all figures 0 and is scored like any
other; repeated rows each give a row; labels that are null, neither 0 nor 1, or different for one
id are left out; null ids are scored but never learnt from. Without positives or without texts
to learn from all texts score 0.5. An empty table gives an empty result; other columns are
ignored. Texts are counted in blocks of bounded bytes; a longer one makes a block of its own and takes
about 30 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.toxicity import held_out
from tidebar.llm.words import blocks, grams, word_hashes

# bounds of the two samples; a row of a sample is FIGURES numbers
POSITIVES, UNLABELLED = 12_000, 24_000
THRESHOLD = 0.3
HIDDEN, RATE, BATCH = 16, 0.01, 512
# passes at most, passes without a better loss until the end, and the part that only measures
PASSES, PATIENCE, MEASURE = 200, 25, 5
SEEDS = (1, 2, 3)

_CLASS = np.full(256, 7, np.uint8)  # 0 blank, 1 lower, 2 upper, 3 digit, 4 stop, 5 exclamation, 6 other mark, 7 beyond ASCII
for _k, _chars in ((6, bytes(range(33, 127))), (0, b" \t\n\v\f\r"), (1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b".,;:'-?()\""), (5, b"!")):
    _CLASS[list(_chars)] = _k
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = 6
KINDS = 8
FIGURES = 22


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _again(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: how many keys it has, how many of them are distinct, and the most frequent one's count."""
    total = np.bincount(doc, minlength=n)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(key))))
    return total, np.bincount(doc[at], minlength=n), most


def figures(texts: list) -> Iterator[np.ndarray]:
    """One row of figures per text, a block of texts at a time, in order."""
    for first, last, raw, at in blocks(texts):
        n, data = last - first, np.frombuffer(raw, np.uint8)
        size = np.diff(at) - 1  # without the line feed that parts texts
        kind = _CLASS[data]
        counts = np.stack([np.add.reduceat((kind == k).view(np.uint8), at[:-1], dtype=np.int64) for k in range(KINDS)], 1)
        counts[:, 0] -= 1
        letters = counts[:, 1] + counts[:, 2] + counts[:, 7]
        starts, ends, h = word_hashes(data)
        owner = np.searchsorted(at, starts, "right") - 1
        length = ends - starts
        words, distinct, most = _again(h, owner, n)
        # words that end in two marks, are all upper case, or repeat the word before
        tail = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        marked = np.isin(tail, (5, 6)) & (length > 1)
        marked[marked] &= np.isin(kind[ends[marked] - 2], (4, 5, 6))
        edges = np.stack([starts, ends], 1).ravel()
        upper, lower = ((np.add.reduceat((kind == k).view(np.uint8), edges, dtype=np.int64)[::2] if len(edges) else edges) for k in (2, 1))
        loud = (upper > 1) & (lower == 0)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        runs = grams(h, 3)
        inside = owner[: len(runs)] == owner[2:] if len(runs) else np.zeros(0, bool)
        triples, triples_distinct, triples_most = _again(runs[inside], owner[: len(runs)][inside], n)
        # lines that hold words, by the sum of their words' hashes times their places
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        begins = np.ones(len(line), bool)
        begins[1:] = line[1:] != line[:-1]
        heads = np.flatnonzero(begins)
        place = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
        sums = np.add.reduceat(h * (place + 1).astype(np.uint64), heads) if len(heads) else np.zeros(0, np.uint64)
        lines, lines_distinct, _ = _again(sums, owner[heads], n)
        mean = _share(np.bincount(owner, weights=length, minlength=n), words)
        square = _share(np.bincount(owner, weights=length.astype(float) ** 2, minlength=n), words)

        def of_words(flag: np.ndarray) -> np.ndarray:
            return _share(np.bincount(owner[flag], minlength=n), words)  # noqa: B023

        out = np.empty((n, FIGURES))
        out[:, :KINDS] = _share(counts, size[:, None])
        out[:, 8] = _share(counts[:, 2], letters)
        out[:, 9], out[:, 10] = np.log1p(size), np.log1p(words)
        out[:, 11], out[:, 12] = mean / 10, np.sqrt(np.maximum(square - mean * mean, 0)) / 10
        out[:, 13], out[:, 14], out[:, 15] = of_words(marked), of_words(loud), of_words(same)
        out[:, 16], out[:, 17] = _share(words - distinct, words), _share(most, words)
        out[:, 18], out[:, 19] = _share(triples - triples_distinct, triples), _share(triples_most, triples)
        out[:, 20], out[:, 21] = _share(lines - lines_distinct, lines), _share(lines, words)
        yield out


@dataclass
class Network:
    """Figures, brought to unit scale, to one hidden layer, to the log odds of class 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.unit(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def unit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)


@dataclass
class Model:
    networks: list[Network]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.networks:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(np.mean([m.odds(x) for m in self.networks], 0), -60, 60)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(loss of class 1, unbiased estimate of the loss of class 0) from log odds."""
    down = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    return prior * np.logaddexp(0, -positive).mean(), down


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_network(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int) -> Network:
    """Adam steps on the non-negative risk until the risk of the measured part stands still."""
    rng = np.random.default_rng(seed)
    mean, scale = unl.mean(0), np.maximum(unl.std(0), 1e-6)
    net = Network(mean, scale, rng.normal(0, (2 / FIGURES) ** 0.5, (FIGURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), 0.0)
    pos, unl = rng.permutation(pos), rng.permutation(unl)
    p_test, u_test = max(1, len(pos) // MEASURE), max(1, len(unl) // MEASURE)
    p_fit, u_fit = net.unit(pos[p_test:] if len(pos) > 1 else pos), net.unit(unl[u_test:] if len(unl) > 1 else unl)
    steps = max(1, -(-max(len(p_fit), len(u_fit)) // BATCH))
    shape = [net.w1, net.b1, net.w2]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in [*shape, np.zeros(1)]]
    best, kept, since, t = np.inf, None, 0, 0
    for _ in range(PASSES):
        ps, us = np.array_split(rng.permutation(len(p_fit)), steps), np.array_split(rng.permutation(len(u_fit)), steps)
        for a, b in zip(ps, us, strict=True):
            if not len(a) or not len(b):
                continue
            x = np.concatenate([p_fit[a], u_fit[b]])
            hid = np.tanh(x @ net.w1 + net.b1)
            z = hid @ net.w2 + net.b2
            zp, zu = z[: len(a)], z[len(a) :]
            # gradients of both parts of the risk by the log odds
            down = np.concatenate([-prior * _sigmoid(zp) / len(a), _sigmoid(zu) / len(b)])
            up = np.concatenate([-prior * _sigmoid(-zp) / len(a), np.zeros(len(b))])
            g = up + down if risk(zp, zu, prior)[1] >= 0 else -down
            back = np.outer(g, net.w2) * (1 - hid * hid)
            t += 1
            for i, (value, grad) in enumerate(zip([*shape, None], [x.T @ back, back.sum(0), hid.T @ g, np.array([g.sum()])], strict=True)):
                m, v = moment[i]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                if value is None:
                    net.b2 -= float(step[0])
                else:
                    value -= step + (1e-4 * RATE * value if value.ndim > 1 or i == 2 else 0)
        own = risk(net.odds(pos[:p_test]), net.odds(unl[:u_test]), prior)
        loss = own[0] + max(0.0, own[1])
        if loss < best - 1e-5:
            best, kept, since = loss, [p.copy() for p in shape] + [net.b2], 0
        else:
            since += 1
            if since >= PATIENCE:
                break
    if kept:
        net.w1, net.b1, net.w2, net.b2 = kept
    return net


def mixture_prior(pos: np.ndarray, unl: np.ndarray, slack: float = 0.1) -> float:
    """The share of positives among ``unl`` as the least ratio of both tails over all scores.

    A network first tells positives from unlabelled texts; on rows it was not fitted to, positives
    above any score are at most all unlabelled ones above it. Few rows in a tail make its ratio uncertain, so a
    bound of its error is added.
    """
    half_p, half_u = len(pos) // 2, len(unl) // 2
    if not half_p or not half_u:
        return 0.5
    net = fit_network(pos[:half_p], unl[:half_u], 0.5, 0)
    zp, zu = np.sort(net.odds(pos[half_p:])), np.sort(net.odds(unl[half_u:]))
    at = np.unique(zp)
    qp, qu = 1 - np.searchsorted(zp, at) / len(zp), 1 - np.searchsorted(zu, at) / len(zu)
    error = np.sqrt(np.log(40) / (2 * len(zp))) + np.sqrt(np.log(40) / (2 * len(zu)))
    best = int(np.argmin((qu + (1 + slack) * error) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.01, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None) -> Model:
    """Networks from several starts, whose log odds are averaged; rows in a fixed order."""
    if not len(pos) or not len(unl):
        return Model([], 0.5)
    share = mixture_prior(pos, unl) if prior is None else float(np.clip(prior, 0.01, 0.99))
    return Model([fit_network(pos, unl, share, s) for s in SEEDS], share)


def _figured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.concatenate(list(figures(batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["o", "x"])


def _sample(own: DataFrame, ids: DataFrame, bound: int) -> np.ndarray:
    """Figures of the ids with the ``bound`` least hashes, one text for each, in that order."""
    few = ids.select("k", F.xxhash64("k").alias("o")).orderBy("o", "k").limit(bound).distinct()
    texts = own.join(F.broadcast(few), "k").groupBy("o", "k").agg(F.min("text").alias("text")).select("o", "text")  # at most ``bound`` ids
    found = sorted((r[0], bytes(r[1])) for r in texts.mapInArrow(_figured, "o long, x binary").toLocalIterator())  # FIGURES numbers for each
    return np.array([np.frombuffer(x) for _, x in found]).reshape(-1, FIGURES)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on rows of ids that are not held out: at most ``positives`` labelled 1 and ``unlabelled`` of any, by hashed id."""
    learnable = F.col(id_col).isNotNull() & ~held_out(id_col)
    own = docs.where(learnable).select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.where(learnable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = hi")
    counts = dict(map(tuple, known.groupBy(F.col("lo").cast("int")).count().collect()))  # two rows
    if prior is None and counts.get(0) and counts.get(1):
        prior = counts[1] / (counts[0] + counts[1])
    return fit(_sample(own, known.where("lo = 1"), positives), _sample(own, own, unlabelled), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in figures(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(shared.value.score(x))], names=[id_col, "score"])
                at += len(x)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def judged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted)."""
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
