"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A document's grade is 0 if rated toxic, 1 if of low quality, 2 if good. One vector of weights over hashed words is shared by all
grades; ordered thresholds t1 < t2 cut its score: P(grade <= k) = sigmoid(t_k - w.x). So each document has an expected grade,
and tail probabilities P(grade >= k) for selection.

A word's punctuation at its ends is taken off and hashed by itself, so that "idiot," and "idiot" share a weight; of longer words
the first characters are hashed as well, so that inflected and compound words share those of their stem.

Training takes at most ``MOST`` labelled rows, those of the ``MOST`` least digests of doc_id, and of them those of the least
digests of id and text, whole texts, as hashed word weights, and runs on the driver until the gradient settles. The rows come in
pieces of ``PIECE`` and are held in 8 bytes a feature, 14 while they come in; a row has ``DIM`` features at most. The fit goes over them in
parts of ``PART`` features and adds no more than a part's work. The model, DIM numbers, is broadcast; all documents are scored where
they are, without a shuffle.

Cases: null and empty texts score by thresholds alone; labels of unknown documents or with nulls are ignored, of several labels
the lowest grade counts; with no labels, or of one grade only, everything has the same probabilities and is kept; doc_id may be
null or repeat; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table
from .wordhash import Words, bytes_hash, columns, lists

DIM_BITS, MOST, GRADES = 16, 20_000, 3
#: Rows in a piece on its way to the driver; features that the fit takes at a time, or one row's.
PIECE, PART = 250, 1 << 18
#: The fit ends where the gradient is ``SETTLED`` times the first one; ``MEMORY`` past steps give the curvature.
SETTLED, MEMORY, DECAY = 1e-3, 10, 2e-5
#: Numbers of characters at a word's start that are a feature too, where the word is longer.
STEMS = (4, 6)
#: ASCII punctuation, by byte.
PUNCTUATION = np.isin(np.arange(256), np.frombuffer(string.punctuation.encode(), np.uint8))
#: A document is kept whose probability of grade 1 or more, and of grade 2, reach these: chosen on held-out labels, see README.
LEAST_TAIL = (0.98, 0.5)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, index, value): hashed words, their stems, and the punctuation before and after them, 1 + ln(count), each text's values of length 1."""
    w = Words(data, offsets)
    inner = np.flatnonzero(~PUNCTUATION[data] & (data != 32) & ((data < 9) | (data > 13)))
    first, after = np.searchsorted(inner, w.start), np.searchsorted(inner, w.end)
    has = after > first  # words of punctuation alone stay whole
    start, end = w.start.copy(), w.end.copy()
    start[has], end[has] = inner[first[has]], inner[after[has] - 1] + 1
    before, behind = start > w.start, end < w.end
    starts, ends, text = [start, w.start[before], end[behind]], [end, start[before], w.end[behind]], [w.text, w.text[before], w.text[behind]]
    letters = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
    begin, beyond = np.searchsorted(letters, start), np.append(letters, len(data))
    for size in STEMS:
        stem = beyond[np.minimum(begin + size, len(letters))]
        longer = stem < end
        starts, ends, text = [*starts, start[longer]], [*ends, stem[longer]], [*text, w.text[longer]]
    starts, ends, text = map(np.concatenate, (starts, ends, text))
    place = (text.astype(np.int64) << DIM_BITS) | (bytes_hash(data, starts, ends) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
    place, counts = np.unique(place, return_counts=True)
    text, value = place >> DIM_BITS, 1 + np.log(counts)
    length = np.sqrt(np.bincount(text, value * value, minlength=len(offsets) - 1))
    return text, place & ((1 << DIM_BITS) - 1), value / length[text]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in columns(batch, "text", lower=True):
            text, index, value = features(data, offsets)
            sizes = np.bincount(text, minlength=j - i)
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), lists(index.astype(np.uint16).view(np.int16), sizes, np.int16), lists(value, sizes, np.float32)], names=["grade", "k", "index", "value"])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each score and k but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(grade: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> Model:
    """The most likely model with a small penalty, by full gradients (L-BFGS) until they settle. Thresholds stay ordered: t2 = t1 + exp(d)."""
    n, dim, at = len(grade), 1 << DIM_BITS, np.arange(len(grade))
    bounds = np.append(np.searchsorted(row, at.astype(row.dtype)), len(row))  # ``row`` ascends
    sizes, cuts = np.diff(bounds), [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + PART, "right")) - 1))
    parts = [(slice(i, j), slice(bounds[i], bounds[j])) for i, j in pairwise(cuts)]

    def scores(weights: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for rows, held in parts:
            full_rows = np.flatnonzero(sizes[rows])
            if len(full_rows):
                out[rows.start + full_rows] = np.add.reduceat(value[held] * weights[index[held]], bounds[rows][full_rows] - held.start)
        return out

    share = np.cumsum(np.bincount(grade, minlength=GRADES)[:-1] + 1) / (n + GRADES)
    t = np.log(share / (1 - share))
    x = np.append(np.zeros(dim), [t[0], np.log(max(t[1] - t[0], 1e-3))])

    def model(x: np.ndarray) -> Model:
        return Model(x[:dim], np.array([x[dim], x[dim] + np.exp(x[dim + 1])]))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        m = model(x)
        c = m.below(scores(m.weights))
        full = np.hstack([np.zeros((n, 1)), c, np.ones((n, 1))])
        slope = full * (1 - full)
        p = np.maximum(full[at, grade + 1] - full[at, grade], 1e-12)
        high, low = slope[at, grade + 1] / p, slope[at, grade] / p
        by_score = (high - low) / n  # of -ln p
        by_t = np.array([-(high * (grade + 1 == k) - low * (grade == k)).sum() / n for k in (1, 2)])
        by_w = np.zeros(dim)
        for rows, held in parts:
            np.add.at(by_w, index[held], value[held] * np.repeat(by_score[rows], sizes[rows]))
        by_w += DECAY * m.weights
        return -np.log(p).mean() + DECAY / 2 * (m.weights @ m.weights), np.append(by_w, [by_t.sum(), by_t[1] * np.exp(x[dim + 1])])

    f, g = loss(x)
    enough, past = SETTLED * np.linalg.norm(g), []
    while np.linalg.norm(g) > enough:
        step, shares = -g, []
        for s, y, r in reversed(past):
            shares.append(r * (s @ step))
            step = step - shares[-1] * y
        step = step * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(g))
        for (s, y, r), a in zip(past, reversed(shares), strict=True):
            step = step + (a - r * (y @ step)) * s
        new_f, new_g = loss(x + step)
        while not new_f <= f + 1e-4 * (g @ step) and np.abs(step).max() > 1e-10:
            step = step / 2
            new_f, new_g = loss(x + step)
        if not new_f < f:  # the loss itself has settled, as far as its digits go
            break
        y = new_g - g
        if step @ y > 1e-12 * (y @ y):
            past = [*past[1 - MEMORY :], (step, y, 1 / (step @ y))]
        x, f, g = x + step, new_f, new_g
    m = model(x)
    return Model(m.weights.astype(np.float32), m.thresholds)


def _by_key(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grade, row, index, value) for ``fit``, rows in order of k however they were dealt."""
    order = np.argsort(rows["k"].to_numpy(), kind="stable")
    sizes = pc.list_value_length(rows["index"]).to_numpy().astype(np.int64)
    begins = np.empty(len(order), np.int64)
    begins[order] = np.cumsum(sizes[order]) - sizes[order]
    index, value = np.empty(sizes.sum(), np.uint16), np.empty(sizes.sum(), np.float32)
    after = 0
    for batch in rows.to_batches():
        own, after = slice(after, after + batch.num_rows), after + batch.num_rows
        at = np.repeat(begins[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(sizes[own].sum())
        index[at] = batch["index"].flatten().to_numpy().view(np.uint16)
        value[at] = batch["value"].flatten().to_numpy()
    row = np.repeat(np.arange(len(order), dtype=np.min_scalar_type(len(order))), sizes[order])
    return rows["grade"].to_numpy().astype(np.int64)[order], row, index, value


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model | None:
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.expr("case when toxic >= 1 then 0 when quality >= 1 then 2 else 1 end")).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers
    vectors = known.select("grade", "text", row_key(F.col("doc_id"), F.col("text")).alias("k")).mapInArrow(_vectors, "grade int, k long, index array<smallint>, value array<float>")
    first = vectors.orderBy("k").limit(most)  # also where doc_ids repeat
    grade, *rest = _by_key(first.repartition(-(-most // PIECE)).toArrow())
    return fit(grade, *rest) if len(np.unique(grade)) > 1 else None


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value) if shared.value else None
        for batch in batches:
            for i, j, data, offsets in columns(batch, "text", lower=True):
                if model:
                    text, index, value = features(data, offsets)
                    below = model.below(np.bincount(text, value * model.weights[index], minlength=j - i))
                else:
                    below = np.zeros((j - i, GRADES - 1))
                tail = 1 - below
                kept = (tail >= np.array(LEAST_TAIL)).all(1)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(tail.sum(1)), pa.array(tail[:, 0]), pa.array(tail[:, 1]), pa.array(kept)], names=["doc_id", "expected_grade", "tail_1", "tail_2", "kept"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_1, tail_2 (probabilities of grade 1 or more, and of 2), kept of each row of ``docs`` (doc_id, text)."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds) if model else None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id long, expected_grade double, tail_1 double, tail_2 double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
