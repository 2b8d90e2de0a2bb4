"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A text is the bag of its character 3- to 5-grams inside words, with the blanks around a
word as boundary marks, so an unseen misspelling shares most of its vectors with the word.
Gram vectors live in a fixed number of hashed rows. Training (stochastic gradient steps on
embeddings, softmax weights and bias together) runs on the driver over a bounded sample of
labelled rows whose bags are built by the tasks. After it, a gram's embedding and the softmax collapse to
one number, so scoring is a table look-up and a mean per text.

Edge cases: a null text counts as empty; an empty text has no grams and scores as the usual
text of class 0; repeated rows each give a row; labels that are null or repeated with different
values for an id are left out of training; without both classes to learn from, all texts
score 0. An empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.llm.common import give_back
from tidebar.llm.words import pieces

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
DIM = 8
# bounds of the training sample, which holds the classes in the shares of the labels: rows and code points;
# a code point has three grams at most, a gram of a bag 6 bytes on the driver
SAMPLE_ROWS, SAMPLE_CHARS = 13_500, 48_000_000
# most steps, steps between looks at the rows that aren't fitted, and steps without a loss better by a hundredth that end the training
STEPS, CHECK, PATIENCE = 3_000, 100, 600
BATCH = 32
# a text's share of each gram is about a thousandth, so embeddings take long steps
RATE_E, RATE_W = 300.0, 0.05
FOLDS = 5
# every average takes in so many grams of the usual weight of class 0, so that a few grams alone decide little
USUAL_GRAMS = 50
# code points handled at once; longer texts go in steps
STEP = 1 << 19
# bag entries looked at in one go
LOOK = 1 << 18
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def _space(codes: np.ndarray) -> np.ndarray:
    return (codes <= 32) | (codes == 0x85) | (codes == 0xA0) | ((codes >= 0x2000) & (codes <= 0x200A)) | (codes == 0x2028) | (codes == 0x2029) | (codes == 0x3000)


def _grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start positions, buckets) per gram length; a gram may begin or end with a blank but holds none inside."""
    blank = _space(codes)
    codes = np.where(blank, np.uint32(32), codes)
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        bad = np.zeros(m, bool)
        for k in range(1, n - 1):
            bad |= blank[k : k + m]
        at = np.flatnonzero(~bad)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h ^ codes[at + k]) * _MULT[k]
            h ^= h >> np.uint32(15)
        yield at, (h % np.uint32(BUCKETS)).astype(np.int64)


def _blocks(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, text starts, code points): lower-cased texts with a blank on either side."""
    first, size, parts = 0, 0, []

    def joined() -> tuple[int, np.ndarray, np.ndarray]:
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=at[1:])
        return first, at, np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)

    for i, t in enumerate(texts):
        t = (t or "").lower()
        if parts and size + len(t) > STEP:
            yield joined()
            first, size, parts = i, 0, []
        parts.append(t)
        size += len(t) + 1
    if parts:
        yield joined()


def _steps(at: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each gram, bucket) over the block in steps that overlap by a gram."""
    reach = max(GRAMS) - 1
    for lo in range(0, len(codes), STEP):
        part = codes[lo : lo + STEP + reach]
        for pos, bucket in _grams(part):
            keep = pos < STEP
            pos, bucket = pos[keep] + lo, bucket[keep]
            yield np.minimum(np.searchsorted(at, pos, "right") - 1, len(at) - 2), bucket


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) rows to (label, buckets, counts), both as packed integers."""
    for batch in batches:
        labels = batch.column(0)
        for first, at, codes in _blocks(batch.column(1).to_pylist()):
            n = len(at) - 1
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for doc, bucket in _steps(at, codes):
                k, c = np.unique(np.concatenate([keys, doc * BUCKETS + bucket]), return_inverse=True)
                counts = np.bincount(c, weights=np.concatenate([counts, np.ones(len(bucket), np.int64)]), minlength=len(k)).astype(np.int64)
                keys = k
            at = np.searchsorted(keys, np.arange(n + 1) * BUCKETS)
            packed = [pa.array([v[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary()) for v in ((keys % BUCKETS).astype("<u4"), np.minimum(counts, 65_535).astype("<u2"))]
            yield pa.RecordBatch.from_arrays([labels[first : first + n], *packed], names=["label", "buckets", "counts"])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    usual: float = 0.0

    def score(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        mean = (total + USUAL_GRAMS * self.usual) / (count + USUAL_GRAMS)
        return 1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -60, 60)))

    def of_block(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The score of each text of a block."""
        n = len(at) - 1
        total, count = np.zeros(n), np.zeros(n, np.int64)
        for doc, bucket in _steps(at, codes):
            total += np.bincount(doc, weights=self.weights[bucket], minlength=n)
            count += np.bincount(doc, minlength=n)
        return self.score(total, count)


def _cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The cut of the best F1; the middle one where many are as good within a hundredth."""
    order = np.argsort(-logit, kind="stable")
    z, hit = logit[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + max(1, y.sum()))
    ends = np.append(z[:-1] > z[1:], True)  # equal values lie on one side
    good = np.flatnonzero(ends & (f1 >= f1[ends].max() - 0.01))
    at = good[len(good) // 2]
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at])


def fit(rows: list, seed: int = 5) -> Model:
    """rows: (label, buckets, counts) as ``bags`` packs them, a bounded sample in a fixed order.

    Every fifth row is kept out of the steps: the loss on these rows, looked at every ``CHECK``
    steps, picks the weights and ends the training, and the bias is moved to their best cut.
    The number of steps doesn't follow the number of rows. Without both classes on either
    side (very few labels) all rows are fitted and looked at.
    """
    y = np.array([r[0] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), -60.0)
    rng = np.random.default_rng(seed)
    index = [np.frombuffer(r[1], "<u4") for r in rows]
    counts = [np.frombuffer(r[2], "<u2") for r in rows]
    size = np.array([c.sum(dtype=np.float64) for c in counts])
    many = np.array([len(x) for x in index], np.int64)

    def entries(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``part``, bucket and share of each entry; made anew each time, as all rows' would take the driver's memory."""
        lens = many[part]
        share = np.concatenate([counts[i] for i in part]) / np.repeat(np.maximum(1.0, size[part]), lens)
        return np.repeat(np.arange(len(part)), lens), np.concatenate([index[i] for i in part]).astype(np.int64), share.astype(np.float32)

    def means(part: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = []
        for some in np.split(part, np.flatnonzero(np.diff(np.cumsum(many[part]) // LOOK)) + 1):
            doc, idx, val = entries(some)
            out.append(np.bincount(doc, weights=val * weights[idx], minlength=len(some)))
        return np.concatenate(out)

    fitted = np.arange(len(rows)) % FOLDS > 0
    if len(set(y[fitted].tolist())) < 2 or len(set(y[~fitted].tolist())) < 2:
        used, seen = np.arange(len(rows)), np.arange(len(rows))
    else:
        used, seen = np.flatnonzero(fitted), np.flatnonzero(~fitted)
    e, w, b = rng.normal(0, 0.01, (DIM, BUCKETS)), rng.normal(0, 1.0, (DIM, 2)), np.zeros(2)
    least, best, since, order = np.inf, None, 0, np.zeros(0, np.int64)
    for step in range(STEPS):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(used)])
        part, order = order[:BATCH], order[BATCH:]
        fade = 1 - step / STEPS
        doc, idx, val = entries(part)
        hidden = np.stack([np.bincount(doc, weights=val * v[idx], minlength=len(part)) for v in e], 1)
        logit = hidden @ w + b
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(part)), y[part]] -= 1
        back, by_w, by_b = prob @ w.T, hidden.T @ prob / len(part), prob.mean(0)
        # plain steps: a gram that many texts share moves far, one of a single text hardly does
        for k in range(DIM):
            np.subtract.at(e[k], idx, val * (fade * RATE_E * back[:, k])[doc])
        w -= fade * RATE_W * by_w
        b -= fade * RATE_W * by_b
        if (step + 1) % CHECK == 0:
            weights, bias = (w[:, 1] - w[:, 0]) @ e, float(b[1] - b[0])
            z = means(seen, weights) + bias
            loss = np.logaddexp(0, np.where(y[seen] == 1, -z, z)).mean()
            since = 0 if loss < 0.99 * least else since + 1
            if loss < least:
                least, best = loss, (weights, bias)
            if since * CHECK >= PATIENCE:
                break
    weights, bias = best
    usual = float(means(used[y[used] == 0], weights).mean())
    model = Model(weights, bias, usual)
    total = means(seen, weights) * size[seen]
    model.bias -= _cut((total + USUAL_GRAMS * usual) / (size[seen] + USUAL_GRAMS) + bias, y[seen])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, chosen by hashed id.

    Each class ends at its share of ``sample_chars`` code points of text, after one row at least.

    Each class keeps its share of the labels, and one row at least, so the model doesn't depend
    on whether the labels fit the bound.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = hi")
    known = known.where(~held_out(id_col)).select(F.col(id_col).alias("k"), F.col("lo").cast("int").alias("label"), F.xxhash64(id_col).alias("o"))
    counts = dict(map(tuple, known.groupBy("label").count().collect()))  # two rows
    kept = min(1.0, sample_rows / max(1, sum(counts.values())))
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy("o", "k").limit(max(1, round(kept * counts.get(c, 0))))
        chosen = part if chosen is None else chosen.unionByName(part)
    own = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = own.join(F.broadcast(chosen), "k").groupBy("k", "label", "o").agg(F.min("text").alias("text"))  # at most sample_rows + 2 rows
    # at most sample_rows + 2 rows are ordered here
    so_far = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy("o", "k"))
    room = F.when(F.col("label") == 1, counts.get(1, 0)).otherwise(counts.get(0, 0)) * (sample_chars / max(1, sum(counts.values())))
    first = F.row_number().over(Window.partitionBy("label").orderBy("o", "k")) == 1
    picked = picked.select("k", "label", "text", first.alias("first"), (so_far <= room).alias("fits")).where("first or fits").repartition("k")
    rows = picked.select("label", "text").mapInArrow(bags, "label int, buckets binary, counts binary").toLocalIterator()  # bounded by the sample
    model = fit(sorted((int(r[0]), bytes(r[1]), bytes(r[2])) for r in rows))
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row, over its whole text."""
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.usual))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            ids = batch.column(0)
            for first, at, codes in _blocks(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([ids[first : first + len(at) - 1], pa.array(own.of_block(at, codes))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double")


def flagged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted)."""
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_flagged(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.usual))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            keep = [own.of_block(at, codes) < threshold for _, texts in pieces(batch.column(place)) for _, at, codes in _blocks(texts)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
