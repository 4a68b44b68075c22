"""Toxicity by weak supervision.

Many voters look at a text: entries of a lexicon of words and word beginnings,
and patterns of spelling. The labels choose the voters, say which way they
point, anchor the model and calibrate it, but are no voter themselves. A
generative model of the votes is fitted by expectation maximisation: how often
each voter fires in each class (its accuracies) and, along a tree over the
voters, how that depends on the voter it goes with most (their correlations).
The posterior of each text is what the votes say, whatever its label; it
trains a linear (logistic) classifier on indicators of words and word
beginnings, and that classifier scores all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import textvec as T
from loomgraph.llm.nbsvm import labelled_sample

#: Labelled rows the models are fitted on at most (those of least hash of the id).
FIT_ROWS = 5_000

#: Lexicon voters and indicators of the classifier at most.
VOTERS, INDICATORS = 240, 4_000

#: Weight of the labels in the estimation of the voters' rates; the rest is the posterior's.
ANCHOR = 0.5

#: Lengths of word beginnings, in bytes.
STEMS = (4, 5, 6)

_SALT = [np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def indicators(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the words and word beginnings of each text, each once, in order of row.

    `wanted` is a table by the upper 20 bits of a key: others are left out.
    """
    with np.errstate(over="ignore"):
        start, end, row = T.letter_spans(data, off)
        prefix = T.Prefix(T.LOWER[data])
        rows, keys = [], []
        for k, size in enumerate((0, *STEMS)):
            if size:
                at = np.flatnonzero(end - start >= size)
                key = prefix.hash(start[at], start[at] + size) ^ _SALT[k]
            else:
                at, key = np.arange(len(start)), prefix.hash(start, end) ^ _SALT[0]
            if wanted is not None:
                hit = wanted[(key >> np.uint64(44)).astype(np.int64)]
                at, key = at[hit], key[hit]
            rows.append(row[at]), keys.append(key)
        r, k = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((k, r))
        r, k = r[order], k[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return r[new], k[new]


def pattern_votes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Votes of the spelling patterns for each text: shouting, exclamation, symbols, repetition, few words."""
    n = len(off) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[off[1:]] - sums[off[:-1]]

    size = np.maximum(np.diff(off), 1)
    upper, lower = per_row((data >= 65) & (data <= 90)), per_row((data >= 97) & (data <= 122))
    odd = per_row((data > 32) & (data < 128) & ~T.LETTER[data] & ~((data >= 48) & (data <= 57)) & ~np.isin(data, [44, 45, 46]))
    _, _, row = T.word_spans(data, off)
    words = np.bincount(row, minlength=n)
    return np.stack([upper > lower, per_row(data == 33) * 50 > size, odd * 20 > size, per_row(data == 63) * 50 > size, words < 12], 1)


@dataclass
class LabelModel:
    """rate[y, u, j]: how often voter j fires in class y where its parent voted u; prior of class 1; slope and shift of the calibration."""

    parent: np.ndarray
    rate: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of class 1 by the votes (1 fires, 0 doesn't) of each row, uncalibrated."""
        over = np.where(self.parent[None] >= 0, votes[:, self.parent], 0).astype(bool)
        odds = [[np.log(r[1]) - np.log(r[0]) for r in (self.rate[:, u], 1 - self.rate[:, u])] for u in (0, 1)]
        at = votes.astype(bool)
        z = np.where(over, np.where(at, odds[1][0], odds[1][1]), np.where(at, odds[0][0], odds[0][1])).sum(1)
        return np.log(self.prior / (1 - self.prior)) + z

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * self.evidence(votes) + self.shift)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrated(z: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """(slope, shift) of the logistic regression of y on z, by damped Newton steps; the slope stays positive."""
    scale = max(float(np.std(z)) if len(z) else 0.0, 1e-9)
    middle = float(z.mean()) if len(z) else 0.0
    x = np.stack([(z - middle) / scale, np.ones(len(z))], 1)
    ridge, rate = 0.05, (y.sum() + 0.5) / (len(y) + 1)
    w = np.array([0.0, np.log(rate / (1 - rate))])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ v).sum() - y @ (x @ v) + ridge * v[0] ** 2 / 2)

    now = loss(w)
    for _ in range(rounds):
        q = _logistic(x @ w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag([ridge, 1e-9]), x.T @ (q - y) + np.array([ridge * w[0], 0.0]))
        while (new := loss(w - step)) > now + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
        w, gain, now = w - step, now - new, new
        if gain < 1e-7:
            break
    slope = max(float(w[0]), 1e-3) / scale
    return slope, float(w[1]) - slope * middle


def _tree(votes: np.ndarray, p: np.ndarray, least: float = 0.002) -> np.ndarray:
    """Parent of each voter in the spanning forest of most class-conditional mutual information (none below `least` nats)."""
    m = votes.shape[1]
    v, gain = votes.astype(float), np.zeros((m, m))
    for w in (p, 1 - p):
        total = w.sum() + 1.0
        both = ((v * w[:, None]).T @ v + 0.25) / total
        one = ((v * w[:, None]).sum(0) + 0.5) / total
        cells = [both, one[:, None] - both, one[None] - both, 1 - one[:, None] - one[None] + both]
        apart = [one[:, None] * one[None], one[:, None] * (1 - one[None]), (1 - one[:, None]) * one[None], (1 - one[:, None]) * (1 - one[None])]
        gain += total / (len(p) + 2.0) * sum(np.maximum(c, 1e-9) * np.log(np.maximum(c, 1e-9) / np.maximum(a, 1e-9)) for c, a in zip(cells, apart, strict=True))
    np.fill_diagonal(gain, -1.0)
    parent = np.full(m, -1)
    if m:
        inside = np.zeros(m, bool)
        inside[0] = True
        best, of = gain[0].copy(), np.zeros(m, np.int64)
        for _ in range(m - 1):  # Prim's algorithm on the complete graph of voters
            k = int(np.where(inside, -np.inf, best).argmax())
            parent[k] = of[k] if best[k] >= least else -1
            inside[k] = True
            better = gain[k] > best
            best, of = np.where(better, gain[k], best), np.where(better, k, of)
    return parent


def label_model(votes: np.ndarray, start: np.ndarray, given: np.ndarray, rounds: int = 12, anchor: float = ANCHOR) -> LabelModel:
    """Fit by expectation maximisation from the posteriors `start`.

    Rates are estimated from the posteriors and, with the weight `anchor`, from
    the labels `given`: it keeps the classes from turning into something else
    the votes have in common, such as a language. Labels also set the prior and
    the calibration. The posterior of a row has its votes alone to go by.
    """
    p = np.clip(start.astype(float), 0.02, 0.98)
    v = votes.astype(float)
    prior = float(np.clip((given.sum() + 1) / (len(given) + 2), 1e-3, 1 - 1e-3))
    model = LabelModel(np.full(votes.shape[1], -1), np.zeros((2, 2, votes.shape[1])), prior)
    for _ in range(rounds):
        mixed = anchor * given + (1 - anchor) * p
        model.parent = _tree(votes, mixed)
        over = np.where(model.parent[None] >= 0, v[:, model.parent], 0.0)
        for y, w in enumerate((1 - mixed, mixed)):
            alone = ((w @ v) + 0.3) / (w.sum() + 2.0)
            for u, mask in enumerate((1 - over, over)):
                there = w @ mask
                model.rate[y, u] = np.clip((w @ (mask * v) + 2.0 * alone) / (there + 2.0), 1e-4, 1 - 1e-4)
        z = model.evidence(votes)
        model.slope, model.shift = _calibrated(z, given)
        new = model.posterior(votes)
        moved = float(np.abs(new - p).max())
        p = np.clip(new, 1e-6, 1 - 1e-6)
        if moved < 1e-3:
            break
    return model


@dataclass
class Classifier:
    keys: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        wanted = np.zeros(1 << 20, bool)
        wanted[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        data, off = T.flat(texts)
        out = np.full(len(texts), self.bias)
        for i, j in T.slices(off):
            if not len(self.keys):
                break
            row, key = indicators(data[off[i] : off[j]], off[i : j + 1] - off[i], wanted)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[i:j] += np.bincount(row[hit], weights=self.weight[at[hit]], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _association(count: np.ndarray, of: np.ndarray, total: float, positive: float) -> np.ndarray:
    """Signed root of the likelihood ratio of each indicator with the class."""
    expect = count * positive / total
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(of > 0, of * np.log(of / expect), 0) + np.where(count > of, (count - of) * np.log((count - of) / (count - expect)), 0)
    return np.sign(of - expect) * np.sqrt(np.maximum(2 * g, 0))


def train(texts: pa.Array, labels: np.ndarray) -> Classifier:
    """Fit both models on a bounded set of labelled texts; with one class or no rows the score is its smoothed share.

    Null and empty texts are rows for which no voter but those of few words fires; equal rows count each.
    """
    y = (np.asarray(labels) == 1).astype(float)
    prior = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    data, off = T.flat(texts)
    rows, keys, styles = [], [], []
    for i, j in T.slices(off):
        part, local = data[off[i] : off[j]], off[i : j + 1] - off[i]
        r, k = indicators(part, local)
        rows.append(r + i), keys.append(k), styles.append(pattern_votes(part, local))
    row, key, style = np.concatenate(rows), np.concatenate(keys), np.concatenate(styles)
    kinds, column = np.unique(key, return_inverse=True)
    count = np.bincount(column)
    often = np.flatnonzero(count >= 3)
    new = np.full(len(kinds), -1)
    new[often] = np.arange(len(often))
    seen = new[column] >= 0
    row, column, kinds = row[seen], new[column[seen]], kinds[often]
    count = np.bincount(column, minlength=len(kinds)).astype(float)

    link = _association(count, np.bincount(column, weights=y[row], minlength=len(kinds)), len(y), y.sum())
    voters = np.argsort(-link, kind="stable")[:VOTERS]
    voters = voters[link[voters] > 2.5]
    place = np.full(len(kinds), -1)
    place[voters] = np.arange(len(voters))
    mine = place[column] >= 0
    lexicon = np.zeros((len(y), len(voters)), np.int8)
    lexicon[row[mine], place[column[mine]]] = 1
    several = np.stack([lexicon.sum(1) >= k for k in (2, 4, 8)], 1) if len(voters) else np.zeros((len(y), 0), bool)
    votes = np.concatenate([lexicon, several, style], 1).astype(np.int8)
    tally = lexicon @ link[voters] if len(voters) else np.zeros(len(y))
    slope, shift = _calibrated(tally, y)
    p = label_model(votes, _logistic(slope * tally + shift), y).posterior(votes)

    link = _association(count, np.bincount(column, weights=p[row], minlength=len(kinds)), len(y), max(p.sum(), 1e-9))
    chosen = np.sort(np.argsort(-np.abs(link), kind="stable")[:INDICATORS])
    chosen = chosen[np.abs(link[chosen]) > 2.0]
    place[:] = -1
    place[chosen] = np.arange(len(chosen))
    mine = place[column] >= 0
    r, c = row[mine], place[column[mine]]
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    gw, gb, ridge = np.full(len(chosen), 1e-6), 1e-6, 2e-4
    for _ in range(400):
        q = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, weights=w[c], minlength=len(y)), -35, 35)))
        d = (q - p) / len(y)
        g, h = np.bincount(c, weights=d[r], minlength=len(chosen)) + ridge * w, float(d.sum())
        gw += g * g
        gb += h * h
        w -= 0.3 * g / np.sqrt(gw)
        b -= 0.3 * h / np.sqrt(gb)
    order = np.argsort(kinds[chosen])
    return Classifier(kinds[chosen][order], w[order], b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Classifier:
    """Train on the `fit_rows` labelled documents of least hash of their id (see nbsvm.labelled_sample and train).

    Texts are read whole, however long. Columns but the id and the text aren't read.
    """
    rows = labelled_sample(docs, labels, label, id_col, fit_rows)
    return train(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), np.asarray(rows.column("label")))
