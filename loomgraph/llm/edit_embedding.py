"""Document fingerprints by a randomised edit embedding.

A text of n characters is read by a random walk of 3 n steps: step j emits the
character under the pointer (with the two after it) and moves the pointer on
by a random bit that depends on j and the character alone. All texts share the
walks, so texts that differ by few edits emit the same at most steps: edit
distance becomes Hamming distance. A fingerprint keeps a hash of what was
emitted at a sample of steps. Which steps is fixed by a random priority of
each step: a text keeps its steps of least priority, so texts of different
length keep the same ones as far as they can.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm import textvec as T
from loomgraph.runtime import materialize

#: Steps a fingerprint keeps; steps walked between two looks at the sample.
SAMPLE, STRIDE = 128, 64

#: Texts still under way below which each is walked by itself.
FEW = 24

#: Bands of a fingerprint and sampled steps in each, for candidates.
BANDS, ROWS = 24, 3

#: Members of a band that are compared in one block.
BAND_BLOCK = 256

#: Bytes of text and documents of one neighbourhood group, about; ranges made in the first pass at most, and parts a range over four times too large is divided into in each further one.
GROUP_BYTES, GROUP, RANGES, PARTS = 6 << 20, 1500, 4096, 16

_BLOCK = 1 << 20


def _priority(steps: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.mix(steps.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0x1D8E4E27C47D124F))


@lru_cache(maxsize=40)
def _order(power: int) -> np.ndarray:
    return np.argsort(_priority(np.arange(1 << power)), kind="stable")


@lru_cache(maxsize=20000)
def sampled_steps(total: int) -> np.ndarray:
    """The SAMPLE steps of least priority below `total`, in that order."""
    order = _order(max(int(total - 1).bit_length(), 0))
    head = order[: 8 * SAMPLE]
    found = head[head < total][:SAMPLE]
    if len(found) < min(SAMPLE, total):
        found = order[order < total][:SAMPLE]
    return found.astype(np.int64)


def _moves(chunk: int) -> np.ndarray:
    """STRIDE bits for each of 255 character classes; the end of a text (class 255) never moves."""
    with np.errstate(over="ignore"):
        bits = T.mix((np.uint64(chunk) << np.uint64(8)) + np.arange(256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    bits[255] = 0
    return bits


def embed(texts: list[str]) -> list[str]:
    """The fingerprint of each text: its length and the sampled symbols, in hexadecimal."""
    n = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-n, kind="stable")
    codes = np.frombuffer("\0".join([texts[i] for i in order] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = n[order]
    base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    end = base + size
    kind, symbol = np.empty(len(codes), np.uint8), np.empty(len(codes), np.uint8)
    for a in range(0, len(codes), _BLOCK):
        b = min(len(codes), a + _BLOCK)
        with np.errstate(over="ignore"):
            # a text's end and what follows it count as one and the same character
            h = T.mix(np.concatenate([codes[a : b + 2], np.zeros(max(0, b + 2 - len(codes)), np.uint32)]).astype(np.uint64) + np.uint64(1))
            kind[a:b] = h[:-2] % np.uint64(255)
            third = np.where(codes[np.minimum(np.arange(a + 1, b + 1), len(codes) - 1)] == 0, np.uint64(0), h[2:])
            symbol[a:b] = T.mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + third * np.uint64(7)) % np.uint64(255)
    symbol += 1
    kind[end], symbol[end] = 255, 0  # only past the end
    total = 3 * size
    kept = [sampled_steps(int(t)) for t in total.tolist()]
    out = np.zeros((len(texts), SAMPLE), np.uint8)
    count = np.array([len(k) for k in kept], np.int64)
    step = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    who = np.repeat(np.arange(len(texts)), count)
    slot = np.arange(len(step)) - np.repeat(np.cumsum(count) - count, count)
    by_step = np.argsort(step, kind="stable")
    step, who, slot = step[by_step], who[by_step], slot[by_step]
    at = base.astype(np.int64)
    longest = int(total[0]) if len(total) else 0
    chunk = 0
    path = np.empty((STRIDE, len(texts)), np.int64)
    while chunk * STRIDE < longest:
        active = int(np.searchsorted(-total, -chunk * STRIDE, "left"))
        if active <= FEW:
            break
        bits, p = _moves(chunk), at[:active]
        for s in range(STRIDE):
            path[s, :active] = p
            p = p + ((bits[kind[p]] >> np.uint64(s)) & np.uint64(1)).astype(np.int64)
        at[:active] = p
        a, b = np.searchsorted(step, [chunk * STRIDE, (chunk + 1) * STRIDE])
        out[who[a:b], slot[a:b]] = symbol[path[step[a:b] - chunk * STRIDE, who[a:b]]]
        chunk += 1
    for t in range(min(FEW, len(texts))):
        if total[t] <= chunk * STRIDE:
            continue
        row = kind[base[t] : base[t] + size[t] + 1].tobytes()
        p, c, seen = int(at[t] - base[t]), chunk, []
        while c * STRIDE < total[t]:
            bits = _moves(c).tolist()
            for s in range(STRIDE):
                seen.append(p)
                p += bits[row[p]] >> s & 1
            c += 1
        mine = kept[t]
        late = np.flatnonzero(mine >= chunk * STRIDE)
        out[t, late] = symbol[base[t] + np.asarray(seen, np.int64)[mine[late] - chunk * STRIDE]]
    prints = [""] * len(texts)
    for k, i in enumerate(order.tolist()):
        prints[i] = f"{size[k]:08x}:{out[k, : count[k]].tobytes().hex()}"
    return prints


def _parsed(fingerprint: str) -> tuple[int, np.ndarray]:
    n, _, body = fingerprint.partition(":")
    return int(n, 16), np.frombuffer(bytes.fromhex(body), np.uint8)


def likeness_of(a: str, b: str) -> float:
    """Share of the longer text's sampled steps at which both walks emitted the same (1 for equal texts).

    Steps at which both walks had passed the end count for nothing.
    """
    if a == b:
        return 1.0
    (n, x), (m, y) = sorted((_parsed(a), _parsed(b)), key=lambda v: v[0])
    if not n:
        return 0.0
    both = sampled_steps(3 * m) < 3 * n
    # the steps that the longer text keeps below the shorter's end are the shorter's first ones
    other = np.zeros(len(y), np.uint8)
    other[both] = x[: int(both.sum())]
    told = (y > 0) | (other > 0)
    return float(((y == other) & told).sum() / max(1, told.sum()))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null is taken as empty."""

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(embed(pc.fill_null(column, "").to_pylist()))

    return of(text)


def likeness(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else likeness_of(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return of(a, b)


def band_keys(fp: str) -> list[int]:
    """Keys of the bands: each samples bits of up to ROWS steps that its hash deals to it."""
    n, symbols = _parsed(fp)
    if not n:
        return [0]
    steps = sampled_steps(3 * n)
    with np.errstate(over="ignore"):
        band = (T.mix(steps.astype(np.uint64) + np.uint64(99)) % np.uint64(BANDS)).astype(int)
        value = T.mix(steps.astype(np.uint64) * np.uint64(256) + symbols)
        keys = []
        for b in range(BANDS):
            mine = value[band == b][:ROWS]
            if len(mine):
                k = np.uint64(b + 1)
                for v in mine:
                    k = T.mix(np.array([k * np.uint64(31) + v]))[0]
                keys.append(int(np.int64(k.view(np.int64))))
    return keys


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(src, dst, likeness) of near documents, between the least ids of their fingerprints.

    Equal fingerprints are one class (its least id stands for it). Classes that
    share a band are candidates; their fingerprints are then compared. A crowded
    band is compared block by block, so no task holds more than two blocks.
    Null ids take no part; null texts are empty, and empty ones are one class.
    Rows that repeat an id are texts of their own. No row, no pair; other
    columns aren't read. Pairs hold representatives: `fingerprint_classes` has
    the documents of each.
    """
    prints = materialize(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), fingerprint(F.col("text")).alias("fp")).groupBy("fp").agg(F.min("id").alias("id")))

    @F.arrow_udf("array<long>")
    def keys(column: pa.Array) -> pa.Array:
        return pa.array([band_keys(x) for x in column.to_pylist()], pa.list_(pa.int64()))

    rows = prints.select("id", "fp", F.explode(keys(F.col("fp"))).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BAND_BLOCK))
    placed = rows.join(shared.drop("n"), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    tile = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b")))
    tiled = placed.select("key", "id", "fp", "block", F.explode(tile).alias("tile"))
    groups = tiled.groupBy("key", "tile").agg(F.sort_array(F.collect_list(F.struct("id", "fp", "block"))).alias("m"))
    pairs = groups.select("m", "tile", F.explode("m").alias("x")).select(
        "x", F.explode(F.filter("m", lambda y: (y.id > F.col("x.id")) & ((F.col("tile.a") == F.col("tile.b")) | (y.block != F.col("x.block"))))).alias("y")
    )
    pairs = pairs.select(F.col("x.id").alias("src"), F.col("y.id").alias("dst"), F.col("x.fp").alias("p"), F.col("y.fp").alias("q")).distinct()
    return pairs.select("src", "dst", likeness(F.col("p"), F.col("q")).alias("likeness")).where(F.col("likeness") >= threshold)


def fingerprint_classes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint, representative) of every row: the least id of those with an equal fingerprint, by which near_pairs names it."""
    prints = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col("text")).alias("fingerprint")))
    least = prints.groupBy("fingerprint").agg(F.min("id").alias("representative"))
    return prints.join(least, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "representative")


def next_edited(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    Documents are taken by descending id (nulls last, equal ids by text); after
    the last comes the first. The edited text has the last third of the code
    points replaced by as many of the next document's first ones (or all it
    has). Null texts are empty; the only document is its own neighbour.

    Ids are integers. They are cut into ranges at their quantiles, ranges of
    too much text again at theirs (unless they are one id); the first document
    of each range also goes to the range before it, so every neighbour is at
    hand and texts move once. The driver holds one id a range, that is one for
    some megabytes of text.
    """
    import hashlib

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    total, volume = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(1, min(RANGES, max(total // GROUP, volume // GROUP_BYTES)))
    cuts = lambda n: F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)
    bounds = sorted(set(rows.select(cuts(ranges)).first()[0] or [])) if ranges > 1 else []

    def ranged(bounds: list) -> DataFrame:
        @F.arrow_udf("int")
        def range_of(ids: pa.Array) -> pa.Array:
            at = np.searchsorted(np.array(bounds, np.int64), np.asarray(pc.fill_null(ids.cast(pa.int64()), 0)), "right")
            return pc.if_else(pc.is_null(ids), pa.scalar(-1, pa.int32()), pa.array(at.astype(np.int32)))

        # null ids follow all others, in a range of their own
        return rows.withColumn("range", range_of(F.col("doc_id")) if bounds else F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(0))

    while True:
        placed = ranged(bounds)
        found = placed.groupBy("range").agg(F.max("doc_id").alias("first"), F.min("doc_id").alias("last"), F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("volume")).collect()
        large = [r["range"] for r in found if r["range"] >= 0 and r["first"] != r["last"] and (r["volume"] > 4 * GROUP_BYTES or r["n"] > 4 * GROUP)]
        if not large:
            break
        marked = placed.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in large], "range int")), "range")
        new = {x for r in marked.groupBy("range").agg(cuts(PARTS).alias("at")).collect() for x in r["at"]} - set(bounds)
        # the greatest id is a bound as well, so that every pass divides a range of several ids
        new |= {r["first"] for r in found if r["range"] in set(large)} - set(bounds)
        if not new:
            break
        bounds = sorted(new.union(bounds))
    firsts = {r["range"]: r["first"] for r in found}
    falling = sorted(firsts, reverse=True)
    guest_of = {falling[k]: falling[k - 1] for k in range(len(falling))}  # the top range's first goes to the last range
    head = F.lit(None).cast("int")
    for_range = docs.sparkSession.createDataFrame([(r, firsts[r], guest_of[r]) for r in falling], f"range int, first {kind}, host int")
    placed = placed.join(F.broadcast(for_range), "range", "left")
    guest = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.col("host")).otherwise(head)
    spread = placed.withColumn("to", F.explode(F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("guest")), F.struct(guest.alias("r"), F.lit(True).alias("guest")))))
    spread = spread.where("to.r IS NOT NULL").select("doc_id", "text", F.col("to.r").alias("range"), F.col("to.guest").alias("guest"))

    def run(table: pa.Table) -> pa.Table:
        ids, texts, guests = table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("guest").to_pylist()
        key = lambda k: (ids[k] is None, -(ids[k] or 0), texts[k])
        own = sorted((k for k in range(len(ids)) if not guests[k]), key=key)
        follower = min((k for k in range(len(ids)) if guests[k]), key=key, default=None)
        after = own[1:] + [own[0] if follower is None else follower]
        edited = []
        for k, o in zip(own, after, strict=True):
            n = len(texts[k])
            edited.append(texts[k][: n - n // 3] + texts[o][: n // 3])
        known = [texts[k] for k in own] + ([texts[follower]] if follower is not None else [])
        prints = embed(known + edited)
        mine, changed = prints[: len(own)], prints[len(known) :]
        following = mine[1:] + [prints[len(own)] if follower is not None else mine[0]]
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(own, pa.int64())),
                "n_chars": pa.array([len(texts[k]) for k in own], pa.int64()),
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                "fingerprint": mine,
                "edited_fingerprint": changed,
                "near_edited": [likeness_of(a, b) for a, b in zip(mine, changed, strict=True)],
                "near_next": [likeness_of(a, b) for a, b in zip(mine, following, strict=True)],
            }
        )

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return spread.groupBy("range").applyInArrow(run, schema).withColumnRenamed("doc_id", id_col)
