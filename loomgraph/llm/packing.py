"""Packing of token sequences by length patterns and non-negative least squares.

Documents become pieces of at most `capacity` tokens. The histogram of piece
lengths is all the packing looks at: patterns of a few lengths that fill a
sequence exactly are enumerated, their repeat counts fitted to the histogram
by non-negative least squares and rounded down, and what remains is packed by
filling up the longest pieces as far as the others can. Both work on counts of equal lengths, never on single pieces, so the
plan's size is bounded by the capacity. Pieces then find their place by their
rank among those of their length.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.llm import textvec as T
from loomgraph.runtime import materialize

CAPACITY = 2048

#: Rows ranked in one group at most, about.
RANK_ROWS = 4000

#: Distinct pre-tokens a worker keeps, words encoded in one call, bytes of text encoded at a time.
CACHE, JOINED, SLICE_BYTES = 400_000, 500, 1 << 20

#: Pre-tokens of more code points are told apart by their text, not by a hash (at 2**10 a polynomial hash modulo 2**64 has collisions by construction); so many code points of them are kept.
LONG, LONG_KEPT = 64, 1 << 23

#: Code points of white space as the vocabulary's pattern takes them (fixed values).
_BLANKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Second letters of contractions: one letter, or two (fixed values).
_ONE, _TWO = "stmd", ("re", "ve", "ll")

_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 blank, by code point."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                table[c] = 1 if kind == "L" else 2
        table[_BLANKS] = 3
        _classes.append(table)
    return _classes[0]


def pretokens(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts given as code points; none crosses a text.

    The same cuts as the byte-level pattern makes: runs of letters, numbers or
    others with a space before them, contractions, and runs of blanks.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _class_table()[codes]
    cut = np.ones(n, bool)
    cut[1:] = kind[1:] != kind[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    cut[heads] = True
    text_end = np.zeros(n + 1, bool)
    text_end[off[1:]] = True
    fresh = cut.copy()
    runs = np.flatnonzero(cut)
    ends = np.append(runs[1:], n)
    last = ends[(kind[runs] == 3) & ~text_end[ends]] - 1  # the last blank of a run with something after it
    cut[last] = True
    cut[last[codes[last] == 32] + 1] = False
    quote = np.flatnonzero((codes == 39) & cut & fresh)
    quote = quote[~text_end[quote + 1]]
    quote = quote[kind[quote + 1] == 1]
    one = quote[np.isin(codes[quote + 1], [ord(x) for x in _ONE])]
    two = quote[~text_end[quote + 1] & ~text_end[np.minimum(quote + 2, n)]]
    two = two[np.isin(codes[two + 1].astype(np.int64) << 21 | codes[two + 2], [ord(x) << 21 | ord(y) for x, y in _TWO])]
    for at, k in ((one, 1), (two, 2)):
        cut[at + 1] = False
        after = (at + 1 + k)[~text_end[at + 1 + k]]
        cut[after] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of many texts; each distinct pre-token is encoded by the tokenizer once.

    What is known is four arrays sorted by the pre-token's hash, about 40 bytes
    an entry; at CACHE entries it starts anew.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.count, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.long: dict[str, int] = {}
        self.long_size = 0

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each) of pre-tokens that stay apart when written one after the other: a space and letters."""
        ids, counts = [], []
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            e = self.tokenizer.encode("".join(part), add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self, keys: np.ndarray, words: list[str], spaced: np.ndarray) -> None:
        apart, others = np.flatnonzero(spaced), np.flatnonzero(~spaced)
        ids, count = self._words([words[k] for k in apart.tolist()])
        more = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in others.tolist()], add_special_tokens=False)] if len(others) else []
        count = np.concatenate([count, np.array([len(x) for x in more], np.int64)])
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids, *(np.array(x, np.uint32) for x in more)])
        keys = np.concatenate([self.keys, keys[apart], keys[others]])
        order = np.argsort(keys)
        self.keys, self.count, self.first = keys[order], np.concatenate([self.count, count])[order], np.concatenate([self.first, first])[order]

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with `end_id` after each, their offsets).

        The tokenizer takes its added tokens out before it cuts: texts that hold one go through it whole.
        """
        ids, ptr = self._encode(data, off, end_id)
        raw = data.tobytes()
        if not any(t in raw for t in self.added):
            return ids, ptr
        texts = (raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
        parts = [ids[a:b] for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
        for k, text in enumerate(texts):
            if any(t in text for t in self.added):
                parts[k] = np.array([*self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, end_id], np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes().decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = head[off]
        with np.errstate(over="ignore"):
            start = pretokens(codes, at)
            end = np.append(start[1:], len(codes)) if len(start) else start
            key = T.Prefix(codes).hash(start, end)
        if len(self.keys) > CACHE or self.long_size > LONG_KEPT:
            self.clear()
        for k in np.flatnonzero(end - start > LONG).tolist():
            word = text[start[k] : end[k]]
            if word not in self.long:
                self.long[word] = len(self.long)
                self.long_size += len(word)
            key[k] = self.long[word]
        kinds, where, back = np.unique(key, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, kinds)
        known = np.zeros(len(kinds), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == kinds[inside]
        if not known.all():
            new = where[~known]
            a, b = start[new], end[new]
            spaced = (codes[a] == 32) & (b - a > 1)
            spaced[spaced] = _class_table()[codes[a[spaced] + 1]] == 1
            self._learn(kinds[~known], [text[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], spaced)
            slot = np.searchsorted(self.keys, kinds)
        count, first = self.count[slot][back], self.first[slot][back]
        ahead = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(first - ahead[:-1], count) + np.arange(ahead[-1])]
        row = np.searchsorted(at, start, "right") - 1
        size = np.bincount(row, weights=count, minlength=len(off) - 1).astype(np.int64)
        out_off = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(out_off[-1], end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
        return out, out_off


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


PIECES = "piece int, start long, length long, ids binary"


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids): each document's ids and `end_id`, cut into pieces.

    ids are little-endian unsigned 32-bit. Only a document of more than
    `capacity` ids is cut; all its pieces but the first have `capacity`. Null
    and empty texts have the one id `end_id`. Repeated rows each have pieces.
    The vocabulary at `path` must be installed at the same place everywhere.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        for batch in batches:
            data, off = T.flat(batch.column(1))
            for i, j in T.slices(off, SLICE_BYTES):
                ids, ptr = coder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
                rows, piece, start, length, raw = [], [], [], [], []
                for r in range(j - i):
                    total = int(ptr[r + 1] - ptr[r])
                    n = -(-total // capacity)
                    at = 0
                    for k in range(n):
                        size = total - capacity * (n - 1) if k == 0 else capacity
                        rows.append(i + r), piece.append(k), start.append(at), length.append(size)
                        raw.append(ids[ptr[r] + at : ptr[r] + at + size].astype("<u4").tobytes())
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary())],
                    [id_col, "piece", "start", "length", "ids"],
                )

    return docs.select(id_col, "text").mapInArrow(T.tidy(run), f"`{id_col}` {kind}, {PIECES}")


def patterns(lengths: np.ndarray, capacity: int, choices: int = 10) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths (longest first) that fill the capacity, and of equal ones that divide it."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    found: set[tuple[int, ...]] = set()
    for a in lengths[::-1].tolist():
        rest = capacity - a
        if rest and rest <= a and have[rest]:
            found.add((a, rest))
        thirds = lengths[(lengths <= min(a, rest - 1)) & (lengths * 2 >= rest)]
        thirds = thirds[have[rest - thirds]] if len(thirds) else thirds
        for b in thirds[np.unique(np.linspace(0, len(thirds) - 1, choices).astype(int))].tolist() if len(thirds) else []:
            found.add((a, b, rest - b))
        for b in lengths[np.unique(np.linspace(0, len(lengths) - 1, 4).astype(int))].tolist():
            left = rest - b
            if b > a or left < 2:
                continue
            fourths = lengths[(lengths <= min(b, left - 1)) & (lengths * 2 >= left)]
            fourths = fourths[have[left - fourths]] if len(fourths) else fourths
            for c in fourths[np.unique(np.linspace(0, len(fourths) - 1, 3).astype(int))].tolist() if len(fourths) else []:
                found.add((a, b, c, left - c))
        if capacity % a == 0:
            found.add((a,) * (capacity // a))
    return sorted(found, reverse=True)


def non_negative_fit(columns: list[dict[int, int]], want: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """x >= 0 with least squares of want - A x, by coordinate descent; A's columns are {row: count}."""
    left, x = want.astype(float).copy(), np.zeros(len(columns))
    flat = [(list(c.items()), float(sum(v * v for v in c.values()))) for c in columns]
    value = left.tolist()
    for _ in range(sweeps):
        moved = 0.0
        for p, (items, norm) in enumerate(flat):
            step = sum(value[r] * v for r, v in items) / norm
            new = x[p] + step
            if new < 0:
                new = 0.0
            d = new - x[p]
            if d:
                x[p] = new
                for r, v in items:
                    value[r] -= d * v
                moved = max(moved, abs(d))
        if moved < 0.25:
            break
    return x


def fill(counts: dict[int, int], capacity: int, ascending: bool = False) -> dict[int, int]:
    """{length: how many} with the longest length of `counts` whose sum is the greatest up to `capacity`.

    A bounded subset sum over bit sets of reachable sums, that takes longer or
    shorter lengths first.
    """
    longest = max(counts)
    room = capacity - longest
    reached, steps, mask = 1, [], (1 << (room + 1)) - 1
    for k in sorted(counts, reverse=not ascending):
        n = min(counts[k] - (k == longest), room // k)
        part = 1
        while n > 0 and not reached >> room & 1:
            part = min(part, n)
            steps.append((k, part, reached))
            reached |= reached << (k * part) & mask
            n -= part
            part *= 2
    out, total = {longest: 1}, reached.bit_length() - 1
    for k, part, before in reversed(steps):
        if not before >> total & 1:
            out[k] = out.get(k, 0) + part
            total -= k * part
    return out


def fitted(have: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern as {length: how many}, repeats) fitted to the histogram `have`, within it."""
    lengths = np.flatnonzero(have)
    chosen = patterns(lengths, capacity) if len(lengths) else []
    columns = [{k: p.count(k) for k in set(p)} for p in chosen]
    repeat = np.floor(non_negative_fit(columns, have) + 1e-9).astype(np.int64)
    left, out = have.copy(), []
    for p in np.argsort(-repeat, kind="stable").tolist():
        n = min([int(repeat[p]), *(int(left[k] // v) for k, v in columns[p].items())])
        if n > 0:
            out.append((columns[p], n))
            for k, v in columns[p].items():
                left[k] -= n * v
    return out


def filled(left: dict[int, int], capacity: int, ascending: bool) -> list[tuple[dict[int, int], int]]:
    """Patterns for all that is left: the longest length filled up as far as the others can, as often as that goes."""
    left, out = {k: n for k, n in left.items() if n}, []
    while left:
        best = fill(left, capacity, ascending)
        n = min(left[k] // v for k, v in best.items())
        out.append((best, n))
        left = {k: m for k, c in left.items() if (m := c - n * best.get(k, 0))}
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(runs, sequences): rows (length, first rank, count, first sequence, offset) that place every rank of every length.

    The residuals are packed longer lengths first. Where that needs more
    sequences than the tokens do, other ways are tried as well: shorter lengths
    first, and all pieces as residuals. The fewest sequences win.
    """
    whole = histogram.get(capacity, 0)
    have = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        have[k] = n if k < capacity else 0
    least = -(-int((have * np.arange(capacity + 1)).sum()) // capacity)
    best: list[tuple[dict[int, int], int]] = []
    for fit in (fitted(have, capacity), []):
        left = {int(k): int(have[k]) - sum(p.get(int(k), 0) * n for p, n in fit) for k in np.flatnonzero(have)}
        for ascending in (False, True):
            found = fit + filled(left, capacity, ascending)
            if not best or sum(n for _, n in found) < sum(n for _, n in best):
                best = found
            if sum(n for _, n in best) <= least:
                break
        if sum(n for _, n in best) <= least:
            break
    runs: list[tuple[int, int, int, int, int]] = [(capacity, 0, whole, 0, 0)] if whole else []
    used, sequences = np.zeros(capacity + 1, np.int64), whole
    for pattern, n in best:
        at = 0
        for k, v in sorted(pattern.items(), reverse=True):
            for _ in range(v):
                runs.append((k, int(used[k]), n, sequences, at))
                used[k] += n
                at += k
        sequences += n
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` (with a column length, 1 to capacity) with sequence_id and offset.

    Sequences are numbered from 0 and filled from 0 without gaps. `order`
    names columns that tell pieces of one length apart: it makes reruns agree.
    Which of equal pieces goes where makes no difference. No piece, no row.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table, _ = plan(histogram, capacity)
    keys, firsts = table[:, 0] << 44 | table[:, 1], table

    @F.arrow_udf("long")
    def locate(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, r = np.asarray(length), np.asarray(rank)
        run = firsts[np.searchsorted(keys, size << 44 | r, "right") - 1]
        return pa.array((run[:, 3] + r - run[:, 1]) << 16 | run[:, 4])

    parts = F.ceil(F.element_at(F.lit([max(1, -(-histogram.get(k, 0) // RANK_ROWS)) for k in range(1, capacity + 1)]), F.col("length").cast("int")))
    parted = pieces.withColumn("_h", F.xxhash64(*order)).withColumn("_part", F.pmod(F.col("_h"), parts))
    counts = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_h", *order)) - 1
    ranked = parted.withColumn("_rank", rank).join(counts, ["length", "_part"])
    placed = ranked.withColumn("_at", locate(F.col("length").cast("long"), (F.col("_rank") + F.col("_ahead")).cast("long")))
    return placed.select(*pieces.columns, F.shiftright("_at", 16).alias("sequence_id"), F.col("_at").bitwiseAND(65535).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Tokenize and pack: (id, piece, start, length, ids_crc32, sequence_id, offset).

    As tokenize and pack: null and empty texts are one id, long ones are cut,
    repeated rows (of one id too) each have their pieces, null ids take part,
    no document gives no row, and other columns aren't read.
    """
    pieces = tokenize(docs, path, capacity, id_col=id_col).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces), capacity, (id_col, "piece", "ids_crc32"))
