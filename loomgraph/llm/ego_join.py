"""Embedding near-duplicates by an epsilon grid order join.

Two unit vectors with cosine c are sqrt(2 - 2c) apart, so a cosine threshold
is a radius. Vectors are rotated onto their principal dimensions, sorted by
the grid cells (of the radius' width) on the leading ones, and cut into blocks
of consecutive vectors. Pairs of blocks whose bounding boxes are further apart
than the radius are never joined; the others are joined by recursion on halves
of both sequences, skipping intervals that are provably distant, down to small
matrices whose cosines are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.operators.components import connected_components
from loomgraph.runtime import materialize

#: Distinct vectors of a block, about.
BLOCK = 4096

#: Vectors that the rotation is fitted on at most, and keys a block that the block bounds are; neither changes the result.
FIT, KEYS = 8192, 8

#: Least width of the cells by which block boxes find each other.
CELL = 0.05

#: Leading principal dimensions: of the grid, and of bounding boxes.
GRID, BOX = 8, 24

#: Rows and columns of a matrix of cosines.
LEAF = 256


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Interval:
    """Binary hierarchy of bounding boxes over a sequence of vectors."""

    def __init__(self, coordinates: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        if hi - lo <= LEAF:
            self.halves = ()
            self.least, self.most = coordinates[lo:hi].min(0), coordinates[lo:hi].max(0)
        else:
            mid = (lo + hi) // 2
            self.halves = (Interval(coordinates, lo, mid), Interval(coordinates, mid, hi))
            self.least = np.minimum(self.halves[0].least, self.halves[1].least)
            self.most = np.maximum(self.halves[0].most, self.halves[1].most)

    def distant(self, other: Interval, radius2: float) -> bool:
        gap = np.maximum(0.0, np.maximum(self.least - other.most, other.least - self.most))
        return float(gap @ gap) > radius2


def join_sequences(a: np.ndarray, b: np.ndarray | None, many_a: np.ndarray, many_b: np.ndarray, box_a: np.ndarray, box_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links of unit vectors a with b, or of a among themselves where b is None.

    Returns each side's number of links (counting multiplicities) and edges
    (i, j) over the joined sequence a + b that connect just what links connect.
    """
    own = b is None
    if own:
        b, many_b, box_b = a, many_a, box_a
    na = len(a)
    shift = 0 if own else na
    links_a, links_b, edges = np.zeros(na, np.int64), np.zeros(len(b), np.int64), []
    radius2 = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    if not na or not len(b):
        return links_a, links_b, edges
    left = Interval(box_a, 0, na)
    stack = [(left, left if own else Interval(box_b, 0, len(b)))]
    while stack:
        p, q = stack.pop()
        if p.distant(q, radius2):
            continue
        if p.halves or q.halves:
            if p is q:
                (x, y) = p.halves
                stack += [(x, x), (x, y), (y, y)]
            elif p.halves and (not q.halves or p.hi - p.lo >= q.hi - q.lo):
                stack += [(x, q) for x in p.halves]
            else:
                stack += [(p, y) for y in q.halves]
            continue
        near = a[p.lo : p.hi] @ b[q.lo : q.hi].T >= cosine
        if own and p is q:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        links_a[p.lo : p.hi] += near @ many_b[q.lo : q.hi]
        if not (own and p is q):
            (links_a if own else links_b)[q.lo : q.hi] += many_a[p.lo : p.hi] @ near
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near = near[np.ix_(rows, cols)]
        ri, ci = rows + p.lo, cols + q.lo + shift
        top = na + len(b) + 1
        lr, lc = ri.copy(), ci.copy()
        while True:  # least label over each connected part of the small matrix
            nr = np.minimum(lr, np.where(near, lc[None, :], top).min(1))
            nc = np.minimum(lc, np.where(near, nr[:, None], top).min(0))
            if (nr == lr).all() and (nc == lc).all():
                break
            lr, lc = nr, nc
        edges.append((np.concatenate([ri, ci]), np.concatenate([lr, lc])))
    return links_a, links_b, edges


def _roots(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index of each vertex's component, by pointer jumping."""
    root = np.arange(n)
    if not edges:
        return root
    u, v = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        new = new[new]
        if (new == root).all():
            return root
        root = new


def cosine_links(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`vectors` with n_links, component_id and kept.

    n_links counts the other rows whose vector has cosine >= `cosine` with the
    row's; component_id is the least id reachable by links, the row's own
    included; kept is id = component_id. A row links with nothing where its
    vector is null, empty, zero or holds null or non-finite components, or its
    id is null (component_id then is the id). Vectors of different length
    never link. Rows with equal vectors are compared once and counted each;
    rows that repeat an id are vectors of their own but one vertex. Input
    columns with the name of a result are replaced.
    """
    names = ["n_links", "component_id", "kept"]
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.drop(*names).withColumn("_ok", usable).withColumn("_p", F.xxhash64(v)).withColumn("_q", F.xxhash64(F.lit(7), v))
    distinct = materialize(
        rows.where("_ok").groupBy("_p", "_q").agg(F.min(id_col).alias("rep"), F.count("*").alias("many"), F.first(v.cast("array<double>")).alias("x"))
    )
    found = [r for (size,) in distinct.select(F.size("x")).distinct().collect() if (r := _joined(distinct.where(F.size("x") == size), size, cosine)) is not None]
    if not found:
        return rows.drop("_ok", "_p", "_q").withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col(id_col)).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    tiles = found[0]
    for more in found[1:]:
        tiles = tiles.unionByName(more)
    tiles = materialize(tiles)
    counts = tiles.groupBy("_p", "_q").agg(F.sum("links").alias("links"))
    edges = tiles.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst"))
    # rows of one vector link with each other, whatever their ids
    same = rows.where("_ok").join(distinct.where("many > 1").select("_p", "_q", "rep"), ["_p", "_q"]).where(F.col(id_col) != F.col("rep")).select(F.col(id_col).alias("src"), F.col("rep").alias("dst"))
    components = connected_components(edges.unionAll(same)).withColumnRenamed("id", "_id")
    per_vector = distinct.select("_p", "_q", "many").join(counts, ["_p", "_q"], "left").select("_p", "_q", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n"))
    out = rows.join(per_vector, ["_p", "_q"], "left").join(components, F.col(id_col) == F.col("_id"), "left")
    out = out.withColumn("n_links", F.when(F.col("_ok"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long")).withColumn(
        "component_id", F.coalesce(F.col("component_id"), F.col(id_col))
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))).select(*[c for c in vectors.columns if c not in names], *names)


def _joined(distinct: DataFrame, size: int, cosine: float) -> DataFrame | None:
    """(_p, _q, rep, root, links) of every tile of two blocks, for vectors of one length."""
    total = distinct.count()
    if total < 2:
        return None
    blocks = -(-total // BLOCK)
    fit = distinct.orderBy(F.xxhash64("_p", F.lit(3)), "_q").limit(FIT).select("x").toArrow()
    sample = _unit(_matrix(fit.column("x")))
    _, rotation = np.linalg.eigh(np.cov(sample.T) if size > 1 and len(sample) > 1 else np.eye(size))
    rotation = np.ascontiguousarray(rotation[:, ::-1])
    width = float(np.sqrt(max(2 - 2 * cosine, 1e-12)))
    grid = min(GRID, size)

    def ego_key(unit: np.ndarray) -> np.ndarray:
        """The grid cells as one number, the leading dimension first."""
        cell = np.clip(np.floor(unit @ rotation[:, :grid] / width) + 64, 0, 127).astype(np.int64)
        out = np.zeros(len(unit), np.int64)
        for k in range(grid):
            out = out * 128 + cell[:, k]
        return out

    # ties of one cell are spread by the next dimensions' position, so no cell is too large for a block
    def order_of(unit: np.ndarray) -> np.ndarray:
        key = np.zeros(len(unit), [("cell", np.int64), ("x", np.float64)])
        key["cell"], key["x"] = ego_key(unit), unit @ rotation[:, 0]
        return key

    if KEYS * blocks <= len(sample):
        keys = np.sort(order_of(sample))
    else:  # some keys of every block, by a hash of the vector: sixteen bytes each on the driver
        @F.arrow_udf("struct<cell: long, x: double>")
        def key_of(x: pa.Array) -> pa.Array:
            key = order_of(_unit(_matrix(x)))
            return pa.StructArray.from_arrays([pa.array(key["cell"].copy()), pa.array(key["x"].copy())], ["cell", "x"])

        some = F.pmod(F.xxhash64("_q", F.lit(5)), F.lit(1 << 30)) < min(1 << 30, (KEYS * blocks << 30) // total + 1)
        found = distinct.where(some).select(key_of(F.col("x")).alias("k")).select("k.*").toArrow()
        keys = np.zeros(found.num_rows, [("cell", np.int64), ("x", np.float64)])
        keys["cell"], keys["x"] = found.column("cell").to_numpy(), found.column("x").to_numpy()
        keys.sort()
    bounds = keys[(np.arange(1, blocks) * len(keys)) // blocks] if len(keys) else keys

    @F.arrow_udf("int")
    def block_of(x: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, order_of(_unit(_matrix(x))), "right").astype(np.int32))

    @F.arrow_udf("array<double>")
    def box_of(x: pa.Array) -> pa.Array:
        at = _unit(_matrix(x)) @ rotation[:, :BOX]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel()))

    placed = materialize(distinct.withColumn("block", block_of(F.col("x"))))
    m = min(BOX, size)
    sides = placed.select("block", box_of(F.col("x")).alias("b")).groupBy("block").agg(
        F.array(*[F.min(F.col("b")[k]) for k in range(m)]).alias("low"), F.array(*[F.max(F.col("b")[k]) for k in range(m)]).alias("high")
    )
    sides = materialize(sides)
    # boxes that come within the radius share a cell of the leading dimension, where one of them is widened by it
    cell = max(width, CELL)
    reach = sides.select("block", "low", "high", F.explode(F.sequence(F.floor((F.col("low")[0] - width) / cell), F.floor((F.col("high")[0] + width) / cell))).alias("cell"))
    home = sides.select(F.col("block").alias("other"), F.col("low").alias("l"), F.col("high").alias("h"), F.explode(F.sequence(F.floor(F.col("low")[0] / cell), F.floor(F.col("high")[0] / cell))).alias("cell"))
    gaps = F.transform(F.arrays_zip("low", "high", "l", "h"), lambda d: F.greatest(F.lit(0.0), d["low"] - d["h"], d["l"] - d["high"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
    near = reach.join(home, "cell").where((F.col("block") <= F.col("other")) & (apart <= (2 - 2 * cosine) * (1 + 1e-9) + 1e-12)).select("block", "other").distinct()
    tiles = materialize(near.select(F.col("block").alias("a"), F.col("other").alias("b"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block")))

    def join_tile(table: pa.Table) -> pa.Table:
        first, second = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        block = np.asarray(table.column("block"))
        unit = _unit(_matrix(table.column("x")))
        at = unit @ rotation[:, :BOX]
        order = np.lexsort((at[:, 0], ego_key(unit), block != first))
        unit, at, many = unit[order], at[order], np.asarray(table.column("many"))[order]
        cut = int((block == first).sum())
        own = first == second
        la, lb, edges = join_sequences(unit[:cut], None if own else unit[cut:], many[:cut], many[cut:], at[:cut], at[cut:], cosine)
        links = la if own else np.concatenate([la, lb])
        root = _roots(len(unit), edges)
        hit = np.flatnonzero(links > 0)
        rep = np.asarray(table.column("rep"))[order]
        take = pa.array(order[hit])
        return pa.table({"_p": table.column("_p").take(take), "_q": table.column("_q").take(take), "rep": rep[hit], "root": rep[root[hit]], "links": links[hit]})

    return placed.join(tiles, "block").groupBy("a", "b").applyInArrow(join_tile, "_p long, _q long, rep long, root long, links long")
