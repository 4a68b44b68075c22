"""Removal of repeated byte strings by a sparse, distributed suffix array.

Every string of `width` bytes holds an anchor: a position whose hash of the
next GRAM bytes is least in the string's range of such positions. Anchors
depend on the bytes around them only, so equal strings have theirs at the same
place, and only anchors whose gram occurs again can lie in a repeat. For these
the bytes to either side are taken as context; equal contexts are one class.

Classes are sorted by gram and what follows it: a suffix array of the anchors.
A stack scan over the lengths of neighbours' common prefixes visits the
intervals of its tree. In each, the members are ordered by what precedes them
and scanned likewise: an interval of that order whose members differ to the
left, and that doesn't lie within one child to the right, is a maximal repeat,
reported with all its members. All occurrences of a repeat but the first, in
order of document and place, are removed.

A gram with very many different contexts is split: all members are compared
with the commonest bytes to the left and to the right. Strings within these are
the same in all members that agree so far; what else a member repeats goes
further to the left or to the right, so members are dealt anew by one byte more
to either side, until groups are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm import textvec as T
from loomgraph.runtime import discard, materialize

#: Bytes of a repeat at least, and of an anchor's gram.
WIDTH, GRAM = 100, 24

#: Classes that are sorted in one task together at most; larger groups are split by longer keys.
CROWD = 4000

#: Low bits of a place that hold the bytes of context after it.
_AHEAD = 16


def anchors(data: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, T.Prefix]:
    """(positions, hashes of their grams) of the anchors of all texts, in order, and the prefix sums."""
    n = len(data)
    prefix = T.Prefix(data)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), prefix
    reach = width - gram + 1
    with np.errstate(over="ignore"):
        at = np.arange(n - gram + 1)
        h = prefix.hash(at, at + gram) | np.uint64(1)
    least = _sliding(h, reach, np.minimum)  # by start of the string
    inside = np.ones(len(least), bool)
    for e in off[1:-1]:
        inside[max(0, e - width + 1) : e] = False
    least[~inside] = 0
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    most = _sliding(padded, reach, np.maximum)
    found = np.flatnonzero(most[: len(h)] == h)
    return found, h[found], prefix


def anchored(data: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM, limit: int = T.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of all texts, about `limit` bytes of text at a time: (row, position, gram's hash, bytes before, bytes after, hash of these).

    Bytes before and after are those of the context. A longer text is taken in
    parts that overlap by more than an anchor depends on.
    """
    for i, j in T.slices(off, limit):
        start, stop = int(off[i]), int(off[j])
        for a in range(start, max(stop, start + 1), limit):
            b = stop if a + 2 * limit > stop else a + limit  # a part takes a short rest with it
            lo, hi = max(start, a - width), min(stop, b + width)
            local = off[i : j + 1] - lo if (lo, hi) == (start, stop) else np.array([0, hi - lo])
            at, h, prefix = anchors(data[lo:hi], local, width, gram)
            mine = (at + lo >= a) & (at + lo < b)
            at, h = at[mine], h[mine]
            row = np.searchsorted(local, at, "right") - 1
            back, ahead = np.minimum(at - local[row], width - gram), np.minimum(local[row + 1] - at, width)
            with np.errstate(over="ignore"):
                around = T.mix(prefix.hash(at - back, at + ahead) + back.astype(np.uint64))
            yield i + row, at + lo - off[i + row], h, back, ahead, around
            if b == stop:
                break


def _sliding(x: np.ndarray, reach: int, best) -> np.ndarray:
    """best over every `reach` neighbours, by doubling."""
    k = 1
    while k * 2 <= reach:
        x = best(x[:-k], x[k:])
        k *= 2
    if k < reach:
        x = best(x[: len(x) - (reach - k)], x[reach - k :])
    return x


def _intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of every interval of the common-prefix tree with value >= least; lcp[k] is of k - 1 and k."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(lcp) + 1):
        value = lcp[k] if k < len(lcp) else -1
        first = k - 1
        while stack and stack[-1][0] > value:
            v, first = stack.pop()
            if v >= least:
                yield v, first, k - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def maximal_repeats(left: np.ndarray, left_len: np.ndarray, right_lcp: np.ndarray, width: int, gram: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(l, r, members) of the maximal repeats of at least `width` bytes through one gram.

    Members are given in order of their right contexts; `left` holds their left
    contexts backwards, padded; right_lcp[k] is the common prefix of k - 1 and k.
    """
    whole = right_lcp.tolist()
    rank = np.empty(len(left), np.int64)
    rank[np.lexsort(left.T[::-1])] = np.arange(len(left))
    for r, lo, hi in _intervals(whole, gram):
        need = width - r
        rows = np.arange(lo, hi + 1)
        child = np.cumsum(right_lcp[lo : hi + 1] <= r)  # a new child begins where the prefix is no longer than r
        if r >= left.shape[1] + gram:
            child = rows
        order = np.argsort(rank[rows])
        rows, child = rows[order], child[order]
        lengths = left_len[rows]
        shared = np.zeros(len(rows), np.int64)
        shared[1:] = _common(left[rows[1:]], left[rows[:-1]], np.minimum(lengths[1:], lengths[:-1]))
        for l, a, b in _intervals(shared.tolist(), max(0, need)):
            inner = child[a : b + 1]
            if inner.min() != inner.max():
                yield l, r, rows[a : b + 1]


def _padded(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, raw = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    length = np.diff(off)
    out = np.zeros((len(length), size), np.uint8)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[row, place] = data[off[0] : off[-1]] if len(off) else data[:0]
    return out, length


_CLASS = "gram long, c1 long, doc long, mark long, place long"
_EXTENTS = "gram long, c1 long, l int, r int"
_GROUPS = f"repeat_id long, l int, r int, {_CLASS}, first boolean"


def _scan(batches: Iterator[pa.RecordBatch], width: int, gram: int, groups: bool = False) -> Iterator[pa.RecordBatch]:
    """Repeats of classes that come sorted by key and right context; a key's last rows wait for the next batch.

    Reports how far each class is covered to either side by repeats in which it
    isn't first or, for `groups`, every member of every maximal repeat.
    """
    held: list[pa.Table] = []

    def solve(table: pa.Table) -> pa.RecordBatch:
        flat = {k: np.asarray(table.column(k).combine_chunks()) for k in ("key", "gram", "c1", "doc", "mark", "place")}
        left, left_len = _padded(table.column("left"), width - gram)
        right, right_len = _padded(table.column("right"), width)
        n = len(left)
        time = np.empty(n, np.int64)
        time[np.lexsort((flat["place"], flat["mark"], flat["doc"]))] = np.arange(n)
        lcp = np.zeros(n, np.int64)
        if n > 1:
            lcp[1:] = _common(right[1:], right[:-1], np.minimum(right_len[1:], right_len[:-1]))
        edge = np.concatenate([[0], np.flatnonzero(flat["key"][1:] != flat["key"][:-1]) + 1, [n]])
        size = np.diff(edge)
        most_l, most_r = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        found: list[tuple[int, int, np.ndarray]] = []
        two = edge[:-1][size == 2]  # the most common case at once: one interval of two
        if len(two):
            back = _common(left[two], left[two + 1], np.minimum(left_len[two], left_len[two + 1]))
            hit = (back + lcp[two + 1] >= width) & (lcp[two + 1] >= gram)
            two, back = two[hit], back[hit]
            later = two + (time[two + 1] > time[two])
            most_l[later], most_r[later] = back, lcp[two + 1]
            if groups:
                found += [(int(b), int(lcp[k + 1]), np.array([k, k + 1])) for k, b in zip(two, back, strict=True)]
        for k in np.flatnonzero(size > 2).tolist():
            a, b = int(edge[k]), int(edge[k + 1])
            inner = lcp[a:b].copy()
            inner[0] = 0
            for l, r, members in maximal_repeats(left[a:b], left_len[a:b], inner, width, gram):
                m = members + a
                if groups:
                    found.append((l, r, m))
                later = m[time[m] != time[m].min()]
                most_l[later] = np.maximum(most_l[later], l)
                most_r[later] = np.maximum(most_r[later], r)
        if groups:
            m = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.int64)
            count = np.array([len(x[2]) for x in found], np.int64)
            rep = lambda v, kind: np.repeat(np.array(v, kind), count)
            first = [x[2][time[x[2]].argmin()] for x in found]
            name = [hash((int(flat["c1"][f]), l, r)) for f, (l, r, _) in zip(first, found, strict=True)]
            cols = [rep(name, np.int64), rep([x[0] for x in found], np.int32), rep([x[1] for x in found], np.int32), *(flat[k][m] for k in ("gram", "c1", "doc", "mark", "place")), m == rep(first, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["repeat_id", "l", "r", "gram", "c1", "doc", "mark", "place", "first"])
        at = np.flatnonzero(most_l >= 0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (flat["gram"][at], flat["c1"][at], most_l[at], most_r[at])], ["gram", "c1", "l", "r"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        keys = np.asarray(batch.column("key"))
        cut = np.flatnonzero(keys != keys[-1])
        start = int(cut[-1]) + 1 if len(cut) else 0
        if start or (len(held) > 1 and held[-2].column("key")[-1].as_py() != keys[0]):
            done = pa.concat_tables([*held[:-1], held[-1].slice(0, start)])
            held = [held[-1].slice(start)]
            yield solve(done)
    if held:
        yield solve(pa.concat_tables(held))


def _classes(docs: DataFrame, mark: Column, width: int, gram: int, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text, rows, classes).

    text: (doc, mark, text). rows: (gram, c1, doc, mark, place) of every anchor
    whose gram occurs again; c1 is the hash of its context, place packs the
    position and the bytes of context after it. classes: rows of one gram and
    context, with n and the first of them.
    """
    text = docs.select(_doc(id_col).alias("doc"), mark.alias("mark"), F.coalesce("text", F.lit("")).alias("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, *_ in anchored(*T.flat(batch.column(0)), width, gram):
                key, n = np.unique(h.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["gram", "n"])

    again = materialize(text.select("text").mapInArrow(T.tidy(grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for row, at, h, _, ahead, around in anchored(*T.flat(batch.column(2)), width, gram):
                cols = (h.view(np.int64), around.view(np.int64), doc[row], mark[row], at << _AHEAD | ahead)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "c1", "doc", "mark", "place"])

    rows = materialize(text.mapInArrow(T.tidy(places), _CLASS).join(again, "gram"))
    discard(again)
    first = F.min(F.struct("doc", "mark", "place")).alias("f")
    classes = materialize(rows.groupBy("gram", "c1").agg(F.count("*").alias("n"), first).select("gram", "c1", "n", "f.*"))
    return text, rows, classes


def _position() -> Column:
    return F.shiftright("place", _AHEAD)


def _ahead() -> Column:
    return F.col("place").bitwiseAND((1 << _AHEAD) - 1)


def _contexts(text: DataFrame, classes: DataFrame, width: int, gram: int) -> DataFrame:
    """`classes` whose gram has several contexts: with kinds, their number, and the bytes before (backwards) and after the first anchor of each."""
    kinds = classes.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = classes.join(kinds, "gram")
    per_text = several.groupBy("doc", "mark").agg(F.collect_list(F.struct("gram", "c1", "place", "kinds")).alias("at"))
    before = width - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.flat(batch.column(2))
            lists = batch.column(3)
            flat, bound = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            key, c1, place, kinds = (np.asarray(flat.field(k)) for k in range(4))
            at, ahead = place >> _AHEAD, place & ((1 << _AHEAD) - 1)
            row = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
            for a in range(0, len(at), 20_000):
                b = min(len(at), a + 20_000)
                r = row[a:b]
                p = off[r] + at[a:b]
                back = np.minimum(at[a:b], before)
                whose = [batch.column(k).take(pa.array(r)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[a:b]), pa.array(c1[a:b]), *whose, pa.array(place[a:b]), pa.array(kinds[a:b]), _cut(data, p - back, back, True), _cut(data, p, ahead[a:b], False)],
                    ["gram", "c1", "doc", "mark", "place", "kinds", "left", "right"],
                )

    return text.join(per_text, ["doc", "mark"]).select("doc", "mark", "text", "at").mapInArrow(T.tidy(cut), f"{_CLASS}, kinds long, left binary, right binary")


def _agreement(width: int, gram: int) -> Callable[..., Column]:
    @F.arrow_udf("a int, b int")
    def agree(left: pa.Array, first_left: pa.Array, right: pa.Array, first_right: pa.Array) -> pa.Array:
        out = []
        for x, y, size in ((left, first_left, width - gram), (right, first_right, width)):
            (p, n), (q, m) = _padded(x, size), _padded(y, size)
            out.append(pa.array(_common(p, q, np.minimum(n, m)).astype(np.int32)))
        return pa.StructArray.from_arrays(out, ["a", "b"])

    return agree


def _commonest(groups: DataFrame, side: str) -> DataFrame:
    counts = groups.groupBy("key", side).agg(F.count("*").alias("n"))
    return counts.groupBy("key").agg(F.max_by(side, F.struct("n", side)).alias(f"common_{side}"))


def _by_groups(contexts: DataFrame, width: int, gram: int, crowd: int, scan: Callable[[DataFrame], DataFrame], hit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `scan` finds in the groups of at most `crowd` contexts, and `hit` in members of larger ones.

    A member looks for strings that begin lo to hi bytes before its anchor; its
    group shares p bytes to the left and q to the right. With the group's
    commonest bytes it agrees in a to the left and b to the right. A string
    within these is known by where it begins alone, so its earliest member is
    the least of all that agree so far: a table of one row a string's beginning.
    Other strings begin more than a bytes before the anchor (whoever shares
    them shares a + 1 bytes to the left) or end more than b bytes after it: by
    these bytes the member is dealt to at most two groups, with ranges that
    don't overlap. Members alone with theirs are done. Nothing of a crowd's size
    ever meets in a task.
    """
    columns = [*(x.split()[0] for x in _CLASS.split(", ")), "left", "right"]
    state = ["key", "p", "q", "lo", "hi", "kinds"]
    agree, who = _agreement(width, gram), F.struct("doc", "mark", "place", "c1")
    p, q, lo, hi, a, b = (F.col(k) for k in ("p", "q", "lo", "hi", "a", "b"))
    found = [materialize(scan(_sorted(contexts.where(F.col("kinds") <= crowd).select(F.col("gram").alias("key"), *columns))))]
    starts = {"key": F.col("gram"), "p": F.lit(0), "q": F.lit(gram), "lo": F.greatest(F.lit(0), width - F.octet_length("right")), "hi": F.least(F.lit(width - gram), F.octet_length("left"))}
    large, scratch = contexts.where(F.col("kinds") > crowd).withColumns(starts).select(*columns, *state), []
    while large.limit(1).count():
        common = materialize(_commonest(large, "left").join(_commonest(large, "right"), "key"))
        compared = large.join(common, "key").withColumn("s", agree("left", "common_left", "right", "common_right")).select(*columns, *state, "s.a", "s.b")
        compared = materialize(compared)
        inside = compared.where(a + b >= width)
        ends = inside.groupBy("key", "a", "b").agg(F.min(who).alias("f")).groupBy("key").agg(F.collect_list(F.struct("a", "b", "f")).alias("ends"))  # a list of some thousand extents at most
        first = F.transform(F.sequence(F.lit(0), F.lit(width - gram)), lambda j: F.array_min(F.transform(F.filter("ends", lambda e: (e["a"] >= j) & (width - e["b"] <= j)), lambda e: e["f"])))
        known = inside.join(materialize(ends.select("key", "ends", first.alias("first"))), "key")
        later = F.filter(F.sequence(width - b, a), lambda j: F.get("first", j) != who)
        found.append(materialize(hit(known.withColumn("l", F.array_max(later)).withColumn("r", width - F.array_min(later)).where("l IS NOT NULL"))))

        step = lambda *values: F.struct(*[v.alias(k) for k, v in zip(("side", "p", "q", "lo", "hi"), values, strict=True)])
        options = F.array(step(F.lit(0), a + 1, q, F.greatest(lo, a + 1), hi), step(F.lit(1), p, b + 1, lo, F.least(hi, width - 1 - b, a)))
        ranges = F.filter(options, lambda o: (o["lo"] <= o["hi"]) & (o["p"] <= F.octet_length("left")) & (o["q"] <= F.octet_length("right")))
        split = compared.select(*columns, F.col("key").alias("of"), F.explode(ranges).alias("o")).select(*columns, "of", "o.*")
        shared = F.xxhash64("of", "side", "p", "q", F.substring("left", F.lit(1), p), F.substring("right", F.lit(1), q))
        dealt = split.withColumn("key", shared)
        groups = materialize(dealt.join(dealt.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "key").select(*columns, *state))
        found.append(materialize(scan(_sorted(groups.where(F.col("kinds") <= crowd).select("key", *columns)))))
        discard(compared, common, *scratch)
        large, scratch = groups.where(F.col("kinds") > crowd), [groups]
    discard(*scratch)
    return reduce(DataFrame.unionByName, found)


def _sorted(groups: DataFrame) -> DataFrame:
    """The suffix array of the anchors: classes dealt by key, sorted by what follows."""
    return groups.repartition("key").sortWithinPartitions("key", "right")


def repeat_groups(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id") -> DataFrame:
    """Every occurrence of every maximal repeat of at least `width` bytes: (repeat_id, doc, mark, start, length, first).

    first marks the earliest. A repeat is reported for each anchor in it, as
    far as the anchor's context of `width` bytes to either side goes, so a long
    one comes in overlapping parts. In a crowd of more than `crowd` contexts a
    repeat is what members have in common with the crowd's commonest bytes, and
    names those that agree with them just as far, and the earliest of all that
    hold it. doc and mark are those of repeated_spans.
    """
    text, rows, classes = _classes(docs, _mark(docs, id_col), width, gram, id_col)
    contexts = materialize(_contexts(text, classes, width, gram))

    def hit(known: DataFrame) -> DataFrame:
        first = F.array_min(F.transform(F.filter("ends", lambda e: (e["a"] >= F.col("a")) & (e["b"] >= F.col("b"))), lambda e: e["f"]))
        others = known.withColumn("f", first).where(F.struct("doc", "mark", "place", "c1") != F.col("f"))
        both = F.array(F.struct("c1", "doc", "mark", "place", F.lit(False).alias("first")), F.struct("f.c1", "f.doc", "f.mark", "f.place", F.lit(True).alias("first")))
        return others.select(F.xxhash64("key", "a", "b").alias("repeat_id"), F.col("a").alias("l"), F.col("b").alias("r"), "gram", F.explode(both).alias("m")).select("repeat_id", "l", "r", "gram", "m.*")

    found = _by_groups(contexts, width, gram, crowd, lambda g: g.mapInArrow(T.tidy(lambda b: _scan(b, width, gram, True)), _GROUPS), hit).distinct()
    alone = classes.where("n > 1").select(
        F.col("c1").alias("repeat_id"), F.least(_position(), F.lit(width - gram)).cast("int").alias("l"), _ahead().cast("int").alias("r"), "gram", "c1", "doc", "mark", "place", F.lit(True).alias("first")
    )
    both = materialize(found.unionByName(alone).select("repeat_id", "l", "r", "gram", "c1", "first", F.struct("doc", "mark", "place").alias("f")))
    every = rows.join(both, ["gram", "c1"]).withColumn("first", F.col("first") & (F.struct("doc", "mark", "place") == F.col("f")))
    return every.select("repeat_id", "doc", "mark", (_position() - F.col("l")).alias("start"), (F.col("l") + F.col("r")).alias("length"), "first")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id") -> DataFrame:
    """(doc, mark, spans): the maximal runs [start, end) of bytes that an earlier occurrence covers.

    doc is the id (null: the largest long), mark tells texts that share an id
    apart (0 where none do). Contexts are compared by 128 bits of hash, and
    classes of one gram byte by byte.
    """
    return _spans(docs, _mark(docs, id_col), width, gram, crowd, id_col)


def _spans(docs: DataFrame, mark: Column, width: int, gram: int, crowd: int, id_col: str) -> DataFrame:
    text, rows, classes = _classes(docs, mark, width, gram, id_col)
    contexts = materialize(_contexts(text, classes, width, gram))

    extents = _by_groups(contexts, width, gram, crowd, lambda g: g.mapInArrow(T.tidy(lambda b: _scan(b, width, gram)), _EXTENTS), lambda known: known.select("gram", "c1", "l", "r"))
    discard(contexts)
    most = extents.groupBy("gram", "c1").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    # written, so that the next join has two plain sides: only then is a crowded class split over tasks
    marked = materialize(classes.join(most, ["gram", "c1"], "left").where("n > 1 OR l IS NOT NULL").select("gram", "c1", "l", "r", F.struct("doc", "mark", "place").alias("f")))
    seen = rows.join(marked, ["gram", "c1"])
    first = F.struct("doc", "mark", "place") == F.col("f")
    start = _position() - F.when(first, F.col("l")).otherwise(F.least(_position(), F.lit(width - gram)))
    end = _position() + F.when(first, F.col("r")).otherwise(_ahead())
    found = seen.select("doc", "mark", start.alias("start"), end.alias("end")).where("start IS NOT NULL")
    per_text = found.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    per_text = materialize(per_text.select("doc", "mark", _merged(F.col("spans")).alias("spans")))
    discard(rows, classes, extents, marked)
    return per_text


def _merged(spans: Column) -> Column:
    @F.arrow_udf("array<struct<start: long, end: long>>")
    def merge(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        start, end = np.asarray(flat.field(0)), np.asarray(flat.field(1))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        reach = np.maximum.accumulate(end + row * (1 << 40)) - row * (1 << 40)  # ends so far within the row
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(row)) - 1
        count = np.bincount(row[head], minlength=len(lists))
        pairs = pa.StructArray.from_arrays([pa.array(start[head]), pa.array(reach[tail])], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pairs)

    return merge(spans)


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray, backwards: bool) -> pa.Array:
    """The byte ranges as binaries."""
    ends = np.cumsum(size)
    step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    base = np.repeat(start + size - 1 if backwards else start, size)
    raw = data[base - step if backwards else base + step]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))


def _mark(docs: DataFrame, id_col: str) -> Column:
    """A hash of the text where ids repeat, and for null ids; 0 for others."""
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    return text if repeated else F.when(F.col(id_col).isNull(), text).otherwise(F.lit(0).cast("long"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id", as_text: bool = False) -> DataFrame:
    """`docs` with n_bytes, spans (maximal removed runs [start, end)), n_removed and kept (the remaining bytes).

    A byte goes where a string of `width` bytes over it also starts earlier: in
    a document of smaller id, or earlier in the same. Overlaps count, and all
    is judged on the input. Null texts are empty. A null id is the largest.
    Texts that share an id are told apart by 64 bits of hash and ordered by it; rows
    that repeat both id and text are one document, each with the same result.
    With `as_text` kept is a string, without characters that were cut in part.
    Texts shorter than `width` stay whole. Input columns with the name of a
    result are replaced.
    """
    names = ["n_bytes", "spans", "n_removed", "kept"]
    mark = _mark(docs, id_col)
    spans = _spans(docs, mark, width, gram, crowd, id_col)
    per_text = spans.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))

    kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_removed", pa.int64()), ("kept", pa.string() if as_text else pa.binary())])

    @F.arrow_udf(f"n_bytes long, spans array<struct<start: long, end: long>>, n_removed long, kept {'string' if as_text else 'binary'}")
    def cut(text: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for x, lists in zip(text, found, strict=True):
            raw = (x.as_py() or "").encode()
            runs = [(v["start"], v["end"]) for v in lists.as_py() or []]
            kept, at = [], 0
            for s, e in runs:
                kept.append(raw[at:s])
                at = e
            out.append({"n_bytes": len(raw), "spans": [{"start": s, "end": e} for s, e in runs], "n_removed": sum(e - s for s, e in runs), "kept": b"".join([*kept, raw[at:]])})
            if as_text:
                out[-1]["kept"] = out[-1]["kept"].decode("utf-8", "ignore")
        result = pa.array(out, kind)
        del out
        T.trim()
        return result

    rows = docs.drop(*names).withColumn("_doc", _doc(id_col)).withColumn("_mark", mark)
    out = rows.join(per_text, ["_doc", "_mark"], "left").withColumn("_r", cut(F.col("text"), F.col("_spans")))
    return out.select(*[c for c in docs.columns if c not in names], "_r.*")
