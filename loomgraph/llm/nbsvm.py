"""Naive Bayes support vectors: a linear classifier of n-gram indicators.

Indicators of word and word-shape n-grams, and of bands of a text's length, its
repetition and its lines, are scaled by the log-count ratio of
the two classes (add-alpha) and a hinge-loss linear
model is fitted on them by dual coordinate descent. Margins become
probabilities by a logistic curve fitted by cross-fitting on the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm import textvec as T

#: Buckets of the hashed n-gram space; the model is two arrays of this length.
BITS = 18

#: Labelled rows the classifier is fitted on at most (those of least hash of the id).
FIT_ROWS = 5_000

_SEED = [np.uint64(x) for x in (0x51ED270B1F3A4C5D, 0x2545F4914F6CDD1D, 0x6C62272E07BB0142, 0x27D4EB2F165667C5)]

#: Byte classes of a word's shape: lower case, upper case, digit, other ASCII, beyond ASCII.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4


def _row_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every indicator that is set, each once, in order of row."""
    with np.errstate(over="ignore"):
        start, end, row = T.word_spans(data, off)
        low = T.LOWER[data]
        prefix = T.Prefix(low)
        word = prefix.hash(start, end)
        # shape: which classes a word begins and ends with, its last byte where it is a symbol, its length band, whether all upper
        klass = _CLASS[data]
        sums = np.concatenate([[0], np.cumsum(klass == 1)])
        symbols = np.concatenate([[0], np.cumsum(klass == 3)])
        n = end - start
        upper, other = sums[end] - sums[start], symbols[end] - symbols[start]
        first, last = klass[start], klass[end - 1]
        tail = np.where(last == 3, data[end - 1], 0).astype(np.uint64)
        shape = (
            first.astype(np.uint64)
            + last.astype(np.uint64) * np.uint64(8)
            + np.minimum(n, 15).astype(np.uint64) // np.uint64(3) * np.uint64(64)
            + (upper * 2 > n).astype(np.uint64) * np.uint64(512)
            + np.minimum(other, 3).astype(np.uint64) * np.uint64(1024)
            + tail * np.uint64(8192)
        )
        same_row = row[1:] == row[:-1]
        again = np.zeros(len(row), bool)
        again[1:] = same_row & (word[1:] == word[:-1])
        pair = np.flatnonzero(same_row)
        triple = np.flatnonzero(same_row[1:] & same_row[:-1])
        grams = [
            (row, T.mix(word ^ _SEED[0])),
            (row[pair], T.mix(word[pair] * np.uint64(3) + T.mix(word[pair + 1] ^ _SEED[1]))),
            (row[pair], T.mix(shape[pair] * np.uint64(1 << 24) + shape[pair + 1] + _SEED[2])),
            (row[triple], T.mix(shape[triple] * np.uint64(1 << 42) + shape[triple + 1] * np.uint64(1 << 21) + shape[triple + 2] + _SEED[3])),
            (row[again], T.mix(np.full(int(again.sum()), _SEED[1]))),
        ]
        # documents as a whole: length band, repetition band
        words = np.bincount(row, minlength=len(off) - 1)
        keys = np.unique((row.astype(np.uint64) << np.uint64(44)) | (word >> np.uint64(20)))
        kinds = np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=len(off) - 1)
        ratio = np.floor(20 * kinds / np.maximum(words, 1)).astype(np.uint64)
        band = np.floor(np.log2(words + 1)).astype(np.uint64)
        rows = np.arange(len(off) - 1)
        grams += [(rows, T.mix(band + _SEED[0])), (rows, T.mix(ratio + band * np.uint64(64) + _SEED[2]))]
        line = data == 10
        lines = np.add.reduceat(np.concatenate([line, [0]]).astype(np.int64), np.minimum(off[:-1], len(data))) if len(data) else np.zeros(len(rows), np.int64)
        lines[off[:-1] == off[1:]] = 0
        grams += [(rows, T.mix(np.floor(np.log2(lines + 1)).astype(np.uint64) + _SEED[3])), (rows, T.mix(np.minimum(words // np.maximum(lines, 1), 63).astype(np.uint64) // np.uint64(4) + _SEED[1]))]
        key = np.concatenate([(r.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for r, h in grams])
        key = np.unique(key)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets of the rows' features, features) for bounded parts of a column."""
    data, off = T.flat(texts)
    for i, j in T.slices(off):
        part = off[i : j + 1] - off[i]
        row, feat = _row_features(data[off[i] : off[j]], part)
        yield i, np.searchsorted(row, np.arange(j - i + 1)), feat


def dual_coordinate_descent(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, c: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge loss (L1-loss dual); c: each row's upper bound."""
    w, alpha = np.zeros(width), np.zeros(len(y))
    squares = np.array([float(value[a:b] @ value[a:b]) for a, b in zip(indptr[:-1], indptr[1:], strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            a, b = indptr[i], indptr[i + 1]
            if squares[i] <= 0:
                continue
            x, at = value[a:b], index[a:b]
            g = y[i] * float(x @ w[at]) - 1
            old = alpha[i]
            new = min(max(old - g / squares[i], 0.0), c[i])
            if new != old:
                alpha[i] = new
                w[at] += (new - old) * y[i] * x
                worst = max(worst, abs(new - old) / c[i])
        if worst < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of P(y=1) = 1 / (1 + exp(-(a m + b))) by Newton with smoothed targets."""
    p, n = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, math.log((p + 1) / (n + 1))
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, s = q - t, q * (1 - q) + 1e-9
        ga, gb = float(d @ margin) + 1e-3 * a, float(d.sum())
        haa, hab, hbb = float(s @ (margin * margin)) + 1e-3, float(s @ margin), float(s.sum())
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (a, b) if a > 0 else (0.0, b)


@dataclass
class Model:
    """weight: hinge-loss weight times log-count ratio, per bucket."""

    weight: np.ndarray
    a: float
    b: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for i, ptr, feat in features(texts):
            sums = np.concatenate([[0.0], np.cumsum(self.weight[feat], dtype=np.float64)])
            n = np.maximum(np.diff(ptr), 1)
            out[i : i + len(n)] = (sums[ptr[1:]] - sums[ptr[:-1]]) / np.sqrt(n)
        return 1 / (1 + np.exp(-np.clip(self.a * out + self.b, -35, 35)))


def train(texts: pa.Array, labels: np.ndarray, alpha: float = 1.0, cost: float = 1.0) -> Model:
    """Fit on a bounded set of texts with labels 0/1.

    With one class or no rows the score is that class's smoothed share. Null
    and empty texts are rows without words; equal rows count each.
    """
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if not len(y) or (y == y[0]).all():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, math.log(((y > 0).sum() + 1) / ((y <= 0).sum() + 1)) if len(y) else 0.0)
    ptrs, feats = [np.zeros(1, np.int64)], []
    for _, ptr, feat in features(texts):
        ptrs.append(ptr[1:] + ptrs[-1][-1])
        feats.append(feat.astype(np.int32))
    indptr, index = np.concatenate(ptrs), np.concatenate(feats)
    del feats
    positive = np.repeat(y > 0, np.diff(indptr))
    count = np.stack([np.bincount(index[positive == k], minlength=1 << BITS) for k in (False, True)]).astype(float)
    del positive
    ratio = np.log((count[1] + alpha) / (count[1] + alpha).sum()) - np.log((count[0] + alpha) / (count[0] + alpha).sum())
    ratio[count.sum(0) == 0] = 0.0
    value = ratio.astype(np.float32)[index]
    value /= np.repeat(np.sqrt(np.maximum(np.diff(indptr), 1)).astype(np.float32), np.diff(indptr))
    share = (y > 0).mean()
    bound = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / (1 - share))
    # margins for the logistic curve come from the half of the rows that a fit hasn't seen
    margin = np.zeros(len(y))
    for k in (0, 1):
        mine, other = np.flatnonzero(np.arange(len(y)) % 2 == k), np.flatnonzero(np.arange(len(y)) % 2 != k)
        w = dual_coordinate_descent(*_take(indptr, index, value, mine), y[mine], 1 << BITS, bound[mine])
        p, i, v = _take(indptr, index, value, other)
        s = np.concatenate([[0.0], np.cumsum(v * w[i], dtype=np.float64)])
        margin[other] = s[p[1:]] - s[p[:-1]]
    a, b = platt(margin, y)
    w = dual_coordinate_descent(indptr, index, value, y, 1 << BITS, bound)
    return Model((w * ratio).astype(np.float32), a, b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> pa.Table:
    """(text, label) of the `fit_rows` labelled documents of least hash of their id.

    Which they are is decided on the labels alone; their texts then come from a
    scan of `docs` with a broadcast of that many ids, so no text is shuffled.
    Labels other than 0 and 1 and null ids are left out; of several labels of
    one id the largest counts.
    """
    order = F.xxhash64(id_col, F.lit(11))
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label")).orderBy(order, id_col).limit(fit_rows)
    return docs.select(id_col, "text").join(F.broadcast(chosen), id_col).orderBy(order, id_col, "text").limit(fit_rows).select("text", "label").toArrow()


def fit(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """Train on a bounded sample of the labelled documents (see labelled_sample and train).

    Texts are read whole, however long. Of an id that several rows repeat all
    count, within the bound. Columns but the id and the text aren't read.
    """
    rows = labelled_sample(docs, labels, label, id_col, fit_rows)
    return train(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), np.asarray(rows.column("label")))


def classify(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """`docs` with a model's score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts are scored as texts without words. Repeated rows get
    equal scores. Columns named score or predicted are replaced.
    """

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        result = pa.array(model.score(text))
        T.trim()
        return result

    scored = docs.drop("score", "predicted").withColumn("score", score(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _take(indptr, index, value, rows):
    n = indptr[rows + 1] - indptr[rows]
    ptr = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat((indptr[rows] - ptr[:-1]).astype(np.int32), n)
    at += np.arange(ptr[-1], dtype=np.int32)
    return ptr, index[at], value[at]
