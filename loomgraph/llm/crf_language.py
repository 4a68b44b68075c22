"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language by forward-backward over the whole text:
emissions add weights of the word itself (where a lexicon of training words
has it), of its beginnings, its endings and its byte trigrams; transitions
between neighbouring words are learned. Training sequences are spliced from
documents of different languages, so switches within a text are in the model.
A text's language is the one with the largest share of its words' marginals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.llm import textvec as T

#: Documents the model is fitted on at most: of each language (those of least hash of the id), and of all where there are many languages (one of each at least).
FIT_DOCS, FIT_TOTAL = 600, 24_000

#: Buckets of the hashed features.
BITS = 16

#: Bytes of text decoded together.
GROUP_BYTES = 12 << 20

AFFIXES = (1, 2, 3, 4)

_SALT = T.mix(np.arange(1, 32, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the features of the words at start..end of lower-cased bytes, in any order."""
    size = end - start
    all_words = np.arange(len(start))
    prefix = T.Prefix(data)
    whole = prefix.hash(start, end)
    at = np.minimum(np.searchsorted(lexicon, whole), max(len(lexicon) - 1, 0))
    known = lexicon[at] == whole if len(lexicon) else np.zeros(len(whole), bool)
    words, keys = [all_words], [np.where(known, whole ^ _SALT[0], _SALT[1])]
    for k in AFFIXES:
        w = np.flatnonzero(size >= k)
        words += [w, w]
        keys += [prefix.hash(start[w], start[w] + k) ^ _SALT[1 + k], prefix.hash(end[w] - k, end[w]) ^ _SALT[8 + k]]
    grams = np.maximum(size - 2, 0)
    w = np.repeat(all_words, grams)
    p = np.repeat(start, grams) + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    words.append(w)
    keys.append(prefix.hash(p, p + 3) ^ _SALT[20])
    return np.concatenate(words), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Field:
    languages: list[str]
    lexicon: np.ndarray
    weight: np.ndarray  # buckets x languages
    transition: np.ndarray  # log, from x to

    def emissions(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each word and language, row of each word); equal words are scored once."""
        with np.errstate(over="ignore"):
            low = T.LOWER[data]
            start, end, row = T.letter_spans(low, off)
            if not len(start):
                return np.zeros((0, len(self.languages)), np.float32), row
            _, where, back = np.unique(T.Prefix(low).hash(start, end), return_index=True, return_inverse=True)
            word, bucket = word_features(low, start[where], end[where], self.lexicon)
        score = np.stack([np.bincount(word, weights=self.weight[bucket, k], minlength=len(where)) for k in range(len(self.languages))], 1)
        return score.astype(np.float32)[back], row

    def marginal_sums(self, score: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Sums over each text's words of the languages' marginals; texts of `count` words follow each other in `score`."""
        k = len(self.languages)
        order = np.argsort(-count, kind="stable")
        size = count[order]
        base = (np.cumsum(count) - count)[order]
        emit = np.exp(score - score.max(1, keepdims=True)) if len(score) else score
        move = np.exp(self.transition - self.transition.max())
        alpha = np.empty_like(emit)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), "left")
        a = np.full((len(size), k), 1.0 / k, np.float32)
        for t in range(longest):
            n = int(active[t])
            at = base[:n] + t
            a = (a[:n] if t == 0 else a[:n] @ move) * emit[at]
            a /= a.sum(1, keepdims=True)
            alpha[at] = a
        total = np.zeros((len(size), k))
        beta = np.ones((len(size), k), np.float32)
        for t in range(longest - 1, -1, -1):
            n = int(active[t])
            at = base[:n] + t
            m = alpha[at] * beta[:n]
            total[:n] += m / m.sum(1, keepdims=True)
            b = (emit[at] * beta[:n]) @ move.T
            beta[:n] = b / b.max(1, keepdims=True)
        out = np.zeros((len(size), k))
        out[order] = total
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, its share of the words)."""
        data, off = T.flat(texts)
        n = len(texts)
        best, share = np.full(n, -1), np.zeros(n)
        if not self.languages:
            return best, share
        for i, j in T.slices(off, GROUP_BYTES):
            parts, counts = [], []
            inner = off[i : j + 1] - off[i]
            for a, b in T.slices(inner):
                score, row = self.emissions(data[off[i + a] : off[i + b]], inner[a : b + 1] - inner[a])
                parts.append(score), counts.append(np.bincount(row, minlength=b - a))
            total = self.marginal_sums(np.concatenate(parts), np.concatenate(counts))
            mass = total.sum(1)
            top = total.argmax(1)
            some = mass > 0
            best[i:j][some] = top[some]
            share[i:j][some] = total[np.arange(j - i), top][some] / mass[some]
        for i in np.flatnonzero(best >= 0).tolist():
            raw = data[off[i] : off[i + 1]]
            if not (((raw >= 97) & (raw <= 122)) | ((raw >= 65) & (raw <= 90))).any() and not any(c.isalpha() for c in raw.tobytes().decode()):
                best[i], share[i] = -1, 0.0
        return best, share


def train(texts: pa.Array, languages: list[str], seed: int = 3, rounds: int = 160, length: int = 60, width: int = 48) -> Field:
    """Fit on whole texts and their languages by stochastic gradients of the sequence likelihood.

    Null, empty and letterless texts add no word. With fewer than two languages
    or no word at all every weight is zero. Equal rows count each.
    """
    names = sorted(set(languages))
    k = len(names)
    label_of = np.array([names.index(x) for x in languages], np.int64)
    data, off = T.flat(texts)
    low = T.LOWER[data]
    empty = Field(names, np.zeros(0, np.uint64), np.zeros((1 << BITS, k)), np.zeros((k, k)))
    with np.errstate(over="ignore"):
        T._tables(len(low) + 1)
        start, end, row = T.letter_spans(low, off)
        if not len(start) or k < 2:
            return empty
        kinds, where, word, count = np.unique(T.Prefix(low).hash(start, end), return_index=True, return_inverse=True, return_counts=True)
        lexicon = kinds[count >= 3]
        feat_word, bucket = word_features(low, start[where], end[where], lexicon)
    order = np.argsort(feat_word, kind="stable")
    bucket = bucket[order]
    ptr = np.searchsorted(feat_word[order], np.arange(len(kinds) + 1))
    of_language = [np.flatnonzero(label_of[row] == y) for y in range(k)]
    usable = [y for y in range(k) if len(of_language[y])]
    rng = np.random.default_rng(seed)
    weight, move = np.zeros((1 << BITS, k)), np.zeros((k, k))
    gw, gm = np.full((1 << BITS, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(rounds):
        # sequences spliced from stretches of one language each
        words, y = np.empty((width, length), np.int64), np.empty((width, length), np.int64)
        for s in range(width):
            t = 0
            while t < length:
                lang = usable[rng.integers(len(usable))]
                n = min(length - t, int(rng.integers(8, length + 1)))
                pool = of_language[lang]
                at = int(rng.integers(max(1, len(pool) - n)))
                take = pool[at : at + n]
                words[s, t : t + len(take)], y[s, t : t + len(take)] = word[take], lang
                t += max(1, len(take)) if len(take) == n else len(take)
        flat = words.ravel()
        size = ptr[flat + 1] - ptr[flat]
        feats = bucket[np.repeat(ptr[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        owner = np.repeat(np.arange(len(flat)), size)
        score = np.stack([np.bincount(owner, weights=weight[feats, c], minlength=len(flat)) for c in range(k)], 1).reshape(width, length, k)
        emit, step = np.exp(score - score.max(2, keepdims=True)), np.exp(move)
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        a = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
        alpha[:, 0] = a
        for t in range(1, length):
            a = (a @ step) * emit[:, t]
            a /= a.sum(1, keepdims=True)
            alpha[:, t] = a
        pairs = np.zeros((k, k))
        for t in range(length - 1, 0, -1):
            right = emit[:, t] * beta[:, t]
            both = alpha[:, t - 1][:, :, None] * step[None] * right[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
            b = right @ step.T
            beta[:, t - 1] = b / b.max(1, keepdims=True)
        marginal = alpha * beta
        marginal /= marginal.sum(2, keepdims=True)
        gap = marginal.reshape(-1, k).copy()
        gap[np.arange(len(flat)), y.ravel()] -= 1
        want = np.zeros((k, k))
        np.add.at(want, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
        touched, slot = np.unique(feats, return_inverse=True)
        g = np.stack([np.bincount(slot, weights=gap[owner, c], minlength=len(touched)) for c in range(k)], 1) / width + 1e-3 * weight[touched]
        gw[touched] += g * g
        weight[touched] -= 0.15 * g / np.sqrt(gw[touched])
        h = (pairs - want) / width + 1e-3 * move
        gm += h * h
        move -= 0.15 * h / np.sqrt(gm)
    return Field(names, lexicon, weight.astype(np.float32), move)


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", fit_docs: int = FIT_DOCS, fit_total: int = FIT_TOTAL) -> Field:
    """Train on documents of every language there is, at most `fit_docs` of each: those of least hash of their id.

    With over fit_total / fit_docs languages each has an even share of
    `fit_total`, one document at least. Which they are is decided on ids and
    languages alone; their texts come from a scan with a broadcast of those few
    ids. Rows without id or language teach nothing, nor do null and empty
    texts; rows that repeat an id and a language are all read. Of no rows
    comes a model that knows no language. Other columns aren't read.
    """
    slim = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    languages = slim.select("_lang").distinct().count()
    if not languages:
        return Field([], np.zeros(0, np.uint64), np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    each = max(1, min(fit_docs, fit_total // languages))
    # the rank's limit is taken before the shuffle too, so a language of a third of all rows costs `each` rows a task
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id", F.lit(23)), "_id"))
    chosen = slim.distinct().withColumn("_r", place).where(F.col("_r") <= each).drop("_r")
    rows = docs.select(F.col(id_col).alias("_id"), "text", F.col(lang_col).alias("_lang")).join(F.broadcast(chosen), ["_id", "_lang"])
    rows = rows.orderBy(F.xxhash64("_id", F.lit(23)), "_id", "text").limit(each * languages).select("text", "_lang").toArrow()
    return train(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows.column("_lang").to_pylist())


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """`docs` with lang_pred and score (the share of the words' marginals that it has).

    lang_pred is `und`, with score 0, where the text is null or has no letter,
    or where no language was learned. Columns of these names are replaced.
    """
    names = [*field.languages, "und"]

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        best, share = field.predict(text)
        T.trim()
        return pa.StructArray.from_arrays([pa.array(names).take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(share)], ["lang_pred", "score"])

    out = docs.drop("lang_pred", "score").withColumn("_l", predict(F.col("text")))
    return out.select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "_l.lang_pred", "_l.score")
