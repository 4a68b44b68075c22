"""Source mixing by entropy balancing.

The mix keeps, for every source, a target number of words while staying as
close as it can (in relative entropy) to taking every document once. The
solution is an exponential tilt: a document of size x in source s is taken at
rate min(cap, exp(lambda_s * x / mean_s)); the convex dual in lambda_s is
solved by Newton steps. Each step is one aggregation over the histogram of
(source, size), which is itself the pre-aggregation of the documents, so no
step ever moves a document. Rates are rounded into whole copies so that the
running total within a source, in order of size, stays with its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.runtime import discard, materialize

#: Word of the size count: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one histogram cell that one rounding group holds at most, about.
CELL_ROWS = 4000

#: Sources up to which a table of one row a source is broadcast; beyond, Spark joins it as it sees fit.
FEW_SOURCES = 10_000

#: Single-document moves that close a source's remaining gap after rounding.
FITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> list[tuple]:
    """[(source, source_size, target)], sources by code point, null last.

    `sizes` has one row per source (source, source_size). Weights repeat over
    the sources in that order and share `share` of all words; a target stops at
    `cap` times its source's size and the excess is reshared by weight among
    the sources below theirs until none is above.
    """
    rows = sizes.orderBy(F.encode("source", "UTF-8").asc_nulls_last()).collect()
    rows = sorted(((r["source"], int(r["source_size"])) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    weight = [float(weights[i % len(weights)]) for i in range(len(rows))]
    target = [0.0] * len(rows)
    left = share * sum(s for _, s in rows)
    free = set(range(len(rows)))
    while free:
        per = left / sum(weight[i] for i in free)
        full = {i for i in free if per * weight[i] > cap * rows[i][1]}
        for i in full or free:
            target[i] = cap * rows[i][1] if full else per * weight[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        free -= full
    return [(s, n, t) for (s, n), t in zip(rows, target, strict=True)]


def _per_source(df: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(df) if sources <= FEW_SOURCES else df


def _newton(histogram: DataFrame, targets: DataFrame, sources: int, cap: float, rounds: int, tolerance: float) -> DataFrame:
    """(_s, mean, total, target, lam): the dual variable of every source with words.

    Safeguarded Newton: a step that leaves the bracket is replaced by bisection
    or by a wider bracket. A target at the cap has its solution at infinity;
    lam stops growing there and `_rate` takes the cap itself.
    """
    far = 1e6
    state = histogram.groupBy("_s").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("rows"))
    state = state.join(targets, "_s").where("total > 0").withColumn("mean", F.col("total") / F.col("rows"))
    state = materialize(state.select("_s", "mean", "total", "target", F.lit(0.0).alias("lam"), F.lit(-far).alias("lo"), F.lit(far).alias("hi"), F.lit(False).alias("done")))
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        z = F.col("lam") * x
        free = z < math.log(cap)
        sums = (
            histogram.join(_per_source(state.where("NOT done"), sources), "_s")
            .groupBy("_s")
            .agg(
                F.sum(F.col("n") * F.col("size") * F.when(free, F.exp(z)).otherwise(cap)).alias("got"),
                F.sum(F.when(free, F.col("n") * F.col("size") * x * F.exp(z)).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        moved = (
            state.join(_per_source(sums, sources), "_s", "left")
            .withColumn("nlo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("nhi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("newton", F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope")))
        )
        middle = (
            F.when(F.col("nlo") <= -far, F.least(F.col("nhi") * 2, F.col("nhi") - 1))
            .when(F.col("nhi") >= far, F.greatest(F.col("nlo") * 2, F.col("nlo") + 1))
            .otherwise((F.col("nlo") + F.col("nhi")) / 2)
        )
        good = (F.col("newton") > F.col("nlo")) & (F.col("newton") < F.col("nhi"))
        over = F.col("done") | (F.abs(gap) <= tolerance * F.col("target")) | (F.abs("lam") > far / 10)
        before, state = state, materialize(
            moved.select(
                "_s", "mean", "total", "target",
                F.when(over, F.col("lam")).when(good, F.col("newton")).otherwise(middle).alias("lam"),
                F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), over.alias("done"),
            )
        )
        discard(before)
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("_s", "mean", "total", "target", "lam")


def _rate(cap: float) -> Column:
    z = F.col("lam") * F.col("size") / F.col("mean")
    return (
        F.when(F.col("lam").isNull() | (F.col("size") == 0), F.lit(1.0))
        .when((F.col("target") >= cap * F.col("total") * (1 - 1e-12)) | (z >= math.log(cap)), F.lit(cap))
        .otherwise(F.exp(z))
    )


def _rounded(histogram: DataFrame, duals: DataFrame, sources: int, cap: float) -> DataFrame:
    """Cells (_s, size) with n, rate, low, extra: `extra` rows get low + 1 copies, the rest low.

    Copies follow the running total of the rates in order of size, so words
    follow theirs to within half the largest document; a few single moves of
    the document nearest to a source's remaining gap then take up the rest.
    """
    cells = histogram.join(_per_source(duals, sources), "_s", "left").withColumn("rate", _rate(cap))
    cells = cells.withColumn("lane", F.floor(F.sqrt(F.col("size").cast("double"))))
    lanes = cells.groupBy("_s", "lane").agg(F.sum(F.col("n") * F.col("rate")).alias("lane_sum"))
    before = Window.partitionBy("_s").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.withColumn("ahead", F.coalesce(F.sum("lane_sum").over(before), F.lit(0.0))).drop("lane_sum")
    inside = Window.partitionBy("_s", "lane").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    run = F.col("ahead") + F.sum(F.col("n") * F.col("rate")).over(inside)
    cells = cells.join(lanes, ["_s", "lane"]).withColumn("run", run)
    whole = F.floor(F.col("run") + 0.5 + 1e-9) - F.floor(F.col("run") - F.col("n") * F.col("rate") + 0.5 + 1e-9)
    cells = cells.withColumn("low", F.floor(F.col("rate") + 1e-12).cast("long"))
    cells = cells.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), whole - F.col("low") * F.col("n"))).cast("long"))
    cells = materialize(cells.select("_s", "size", "n", "rate", "target", "low", "extra"))
    scratch = cells
    for _ in range(FITS):
        gaps = cells.groupBy("_s").agg((F.first("target") - F.sum(F.col("size") * (F.col("low") * F.col("n") + F.col("extra")))).alias("gap"))
        able = F.when(F.col("gap") > 0, F.col("low") * F.col("n") + F.col("extra") < cap * F.col("n")).otherwise(F.col("low") * F.col("n") + F.col("extra") > 0)
        left = F.abs(F.abs("gap") - F.col("size"))
        moves = (
            cells.join(_per_source(gaps, sources), "_s")
            .where(able & (left < F.abs("gap")))
            .groupBy("_s")
            .agg(F.min(F.struct(left.alias("left"), "size", F.signum("gap").cast("long").alias("step"))).alias("move"))
            .select("_s", F.col("move.size").alias("m_size"), F.col("move.step").alias("step"))
        )
        cells = cells.join(_per_source(moves, sources), "_s", "left")
        all_copies = F.col("low") * F.col("n") + F.col("extra") + F.when(F.col("m_size") == F.col("size"), F.col("step")).otherwise(0)
        low = F.floor(all_copies / F.col("n"))
        before, cells = scratch, materialize(cells.select("_s", "size", "n", "rate", "target", low.alias("low"), (all_copies - low * F.col("n")).alias("extra")))
        scratch = cells
        discard(before)
    return cells


def mix_sources(
    docs: DataFrame,
    weights=(3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    rounds: int = 40,
    tolerance: float = 1e-6,
    id_col: str = "doc_id",
) -> DataFrame:
    """Every row of `docs` with its size, source_size, target, rate, copies and taken.

    `copies` is how often the mix takes the document (0 up to `cap`), `taken`
    the words that makes. A null or blank text has size 0, rate 1 and one
    copy. A null source is a source of its own, the last. Rows that repeat an
    id are documents of their own; which of several equal rows of one source,
    size and id gets the extra copy makes no difference to the result. An
    input column with the name of a result column is replaced. Sources are
    taken to be few enough for one row each on the driver; nothing else is
    collected. No document, no row. Reruns agree: ties go by a hash of the id, then the id.
    """
    names = ["size", "source_size", "target", "rate", "copies", "taken"]
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "source"))
    rows = docs.drop(*names).withColumn("size", word_count(F.col("text"))).withColumn("_s", key)
    slim = materialize(rows.groupBy("_s", "source", "size").agg(F.count("*").alias("n")))
    goal = source_targets(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    targets = docs.sparkSession.createDataFrame([("-" if s is None else "=" + s, n, float(t)) for s, n, t in goal], "_s string, source_size long, target double")
    duals = _newton(slim, targets, len(goal), cap, rounds, tolerance)
    cells = _rounded(slim, duals, len(goal), cap)
    discard(slim, duals)

    # Rank the rows of a cell: a large cell is cut into parts by a hash of the id, the parts' sizes give each its first rank.
    few = cells.select("_s", "size", "rate", F.col("low").alias("_low"), F.col("extra").alias("_extra"), F.ceil(F.col("n") / CELL_ROWS).alias("_parts"))
    parted = rows.join(few, ["_s", "size"]).withColumn("_h", F.xxhash64(id_col)).withColumn("_part", F.pmod(F.shiftright("_h", 20), F.col("_parts")))
    ahead = Window.partitionBy("_s", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.where("_parts > 1").groupBy("_s", "size", "_part").agg(F.count("*").alias("_here"))
    parts = parts.withColumn("_first", F.coalesce(F.sum("_here").over(ahead), F.lit(0))).drop("_here")
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_part").orderBy("_h", id_col))
    out = parted.withColumn("_rank", rank).join(parts, ["_s", "size", "_part"], "left")
    copies = F.col("_low") + F.when(F.col("_rank") + F.coalesce("_first", F.lit(0)) <= F.col("_extra"), 1).otherwise(0)
    out = out.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size")).join(_per_source(targets, len(goal)), "_s")
    return out.select(*[c for c in docs.columns if c not in names], *names)
