"""SimHash near-duplicates by deletion-variant signatures.

The 64-bit fingerprints are cut into segments, few enough that of two
fingerprints within the distance (two bits: two segments; five: three) one
segment differs in at most one bit: both hold the same segment variant with
that bit left out. Every distinct fingerprint is indexed under its one-wildcard
variants of all segments, an equality join finds those that share one, and the
whole fingerprints are then compared. Variants shared by very many fingerprints
go another exact way: at two bits by groups of at most four, beyond in blocks
that only report what connects them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.minhash import jaccard_groups
from loomgraph.operators.components import connected_components
from loomgraph.runtime import materialize

#: Largest group of one variant whose members are compared with each other.
PAIRED = 32

#: Members of a crowded variant that are compared in one block.
CROWD_BLOCK = 4096

#: Shingles hashed at a time.
_BLOCK = 1 << 16


def fingerprint_of(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles (words lower-cased in ASCII, repeats included)."""
    words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(first), _BLOCK):
        spans = zip(first[i : i + _BLOCK].tolist(), last[i : i + _BLOCK].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(first)).tolist()))


def fingerprints(text: Column, width: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text as a long; of null, empty and blank texts 0."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        raw = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
        return pa.array(np.array([fingerprint_of(x.as_py(), width, seed) for x in raw], np.uint64).view(np.int64))

    return of(text)


def _block_links(distance: int):
    """A group function: edges that connect a tile's fingerprints as its pairs within the distance do."""

    def run(table: pa.Table) -> pa.Table:
        fp = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
        part = np.asarray(table.column("block").combine_chunks())
        a, b = table.column("tile")[0].as_py().values()
        left, right = fp[part == a], fp[part == b]
        at_left, at_right = np.flatnonzero(part == a), np.flatnonzero(part == b)
        root = np.arange(len(fp))
        step = max(1, (1 << 22) // max(1, len(right)))
        while True:
            new = root.copy()
            for i in range(0, len(left), step):
                near = np.bitwise_count(left[i : i + step, None] ^ right[None, :]) <= distance
                mine = at_left[i : i + step]
                low = np.where(near, new[at_right][None, :], len(fp)).min(1)
                new[mine] = np.minimum(new[mine], low)
                low = np.where(near, new[mine][:, None], len(fp)).min(0)
                new[at_right] = np.minimum(new[at_right], low)
            if (new == root).all():
                break
            root = new
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"src": fp[root[moved]].view(np.int64), "dst": fp[moved].view(np.int64)})

    return run


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(src, dst): edges between distinct fingerprints `fp` that differ in at most `distance` bits.

    Every such pair is joined by an edge or, in crowded variants, by a path of
    edges; edges join only what links connect.
    """
    cuts = np.linspace(0, 64, distance // 2 + 2).astype(int).tolist()
    keys = [
        F.shiftrightunsigned("fp", lo).bitwiseAND(((1 << (hi - lo)) - 1) ^ (1 << (i - lo))).bitwiseOR(F.lit(i << 32))
        for lo, hi in zip(cuts, cuts[1:], strict=False)
        for i in range(lo, hi)
    ]
    variants = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # by size Spark takes the exploded variants for as small as `prints` and would send them all through the driver
    members = materialize(variants.hint("merge").join(shared, "key"))

    group = members.where(F.col("n") <= PAIRED).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = group.select("fps", F.explode("fps").alias("src")).select(
        "src", F.explode(F.filter("fps", lambda x: (x > F.col("src")) & (F.bit_count(x.bitwiseXOR(F.col("src"))) <= distance))).alias("dst")
    )
    crowded = members.where(F.col("n") > PAIRED)
    if distance > 2:
        blocks = F.ceil(F.col("n") / CROWD_BLOCK)
        placed = crowded.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        tile = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b")))
        tiled = placed.select("key", "fp", "block", F.explode(tile).alias("tile"))
        star = tiled.groupBy("key", "tile").applyInArrow(_block_links(distance), "src long, dst long")
        return near.unionAll(star).distinct()
    # Two wildcards over all 64 bits leave at most four fingerprints to a key, all within two bits.
    crowd = crowded.select("fp").distinct()
    ij = F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("ij")
    wild = crowd.select("fp", ij).where("(ij >> 6) < (ij & 63)")
    mask = F.expr("shiftleft(1L, ij >> 6) | shiftleft(1L, ij & 63)")
    fours = wild.groupBy(F.col("fp").bitwiseAND(F.bitwise_not(mask)).alias("rest"), "ij").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    star = fours.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    return near.unionAll(star).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """(id, fp, fingerprint, component_id) of every row of `docs`.

    Rows whose fingerprints differ in at most `distance` bits link; component_id is
    the least id reachable by links. Null, empty and blank texts have
    fingerprint zero and link like any other. Rows with a null id take part;
    a group of such rows only has a null component_id. Repeated rows each get
    a row. Only distinct fingerprints are compared, so copies cost nothing.
    """
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), width, seed).alias("fp")))
    prints = materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(prints, distance)).withColumnRenamed("id", "fp")
    grouped = materialize(found.join(prints, "fp"))
    roots = grouped.groupBy("component_id").agg(F.min("least").alias("root"))
    linked = grouped.join(roots, "component_id").select("fp", "root")
    least = prints.join(linked, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    return slim.join(least, "fp").select(
        F.col("doc_id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedupe(docs: DataFrame, id_col: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """`docs` with one document of each group of near copies: that of the least id.

    Near copies have `width`-word shingle sets of a Jaccard similarity of
    `threshold` or more. Fingerprints don't reach these: at 0.8 some 10 of 64
    bits differ, so `minhash` finds and confirms them. Rows that repeat an id
    are one document and one of them stays. Rows with a null id stay. Columns
    are those of `docs`.
    """
    groups = materialize(jaccard_groups(docs, id_col, width=width, threshold=threshold))
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = docs.join(gone, id_col, "left_anti")
    repeated = groups.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        named = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        kept = named.unionByName(kept.where(F.col(id_col).isNull()))
    return kept.select(*docs.columns)
