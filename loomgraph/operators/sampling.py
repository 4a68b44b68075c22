"""Deterministic samples and stratified targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def order_key(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def stratified_targets(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, n, target): shares of `total`, rounded half to even, no more than there are."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    everything = df.count()
    return counts.select(stratum, "n", F.least(F.col("n"), F.bround(F.col("n") / everything * total).cast("long")).alias("target"))


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """At least one and about its share of `total` rows of each stratum, by a hash of the key."""
    targets = stratified_targets(df, stratum, total).select(stratum, F.greatest(F.col("target"), F.lit(1)).alias("_want"))
    ranked = df.join(targets, stratum).withColumn("_h", order_key(F.col(key), seed))
    # ranks in two steps: within slices of a stratum, then over what each slice may at most give
    slice_ = F.substring("_h", 1, 2)
    first = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, slice_).orderBy("_h", key))).where("_r <= _want")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))).where("_r <= _want").drop("_h", "_r", "_want")


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(order_key(F.col(key), seed), key).limit(n)
