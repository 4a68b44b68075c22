"""Resumable incremental ingest: a file stream of records upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomgraph.sources.sinks import Store


def ingest(
    spark: SparkSession, path: str, schema, store: Store, name: str, keys: list[str], checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 500, fmt: str = "parquet", seq: str | None = None,
) -> None:
    """Take all files that are new since the last call, `files_per_batch` at a time.

    Offsets live in `checkpoint`; a batch that is replayed after a failure
    upserts the same keys again, so the table is the same.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(name, transform(batch), keys, seq)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_sources(jobs: dict[str, Callable[[], None]], retries: int = 2) -> dict[str, str]:
    """Run each source's ingest, again up to `retries` times where it fails; one that still fails is reported and doesn't stop the others."""
    failed = {}
    for source, job in jobs.items():
        for attempt in range(retries + 1):
            try:
                job()
                break
            except Exception as e:  # noqa: BLE001
                if attempt == retries:
                    failed[source] = f"{type(e).__name__}: {e}"
    return failed


def up_to_targets(documents: DataFrame, done: DataFrame, targets: DataFrame, source: str = "source_system", key: str = "doc_id") -> DataFrame:
    """Documents of each source still to be taken until it has its target (source, target), those of least key first; `done` (source, key) are taken already."""
    had = done.groupBy(source).agg(F.count("*").alias("_had"))
    room = targets.join(had, source, "left").select(source, (F.col("target") - F.coalesce("_had", F.lit(0))).alias("_room")).where("_room > 0")
    rest = documents.join(done.select(key), key, "left_anti").join(room, source)
    # the rank's limit is taken in every task before rows of a source meet
    rank = F.row_number().over(Window.partitionBy(source).orderBy(key))
    return rest.withColumn("_r", rank).where("_r <= _room").drop("_r", "_room")
