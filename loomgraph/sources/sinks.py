"""Keyed tables on Parquet: idempotent upserts of nodes and edges, appends, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Deltas of a table that are read together at most; then they become one with the base, or with each other while they are small beside it.
DELTAS = 8


class Store:
    """Keyed tables below one root.

    A table is a base (b<n>) and the deltas (d<n>) written since. An upsert
    writes its own rows only; reading merges them by key, and every DELTAS
    upserts they are merged for good: with the base once they have grown to
    half its size, with each other until then. So a row is rewritten a number
    of times that grows with the logarithm of the table, not with its batches.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _parts(self, name: str) -> list[str]:
        """Folders of the live parts, oldest first: the latest base and what follows it."""
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        done = [f.getName() for f in found if f.getName()[:1] in "bd" and fs.exists(self._fs(f"{f}/_SUCCESS")[1])]
        done.sort(key=lambda n: (int(n[1:]), n[0] == "d"))
        base = max((k for k, n in enumerate(done) if n[0] == "b"), default=0)
        return done[base:]

    def _size(self, name: str, part: str) -> int:
        fs, p = self._fs(f"{self.root}/{name}/{part}")
        return fs.getContentSummary(p).getLength()

    def _order(self, name: str, keys: list[str] | None = None, seq: str | None = None) -> tuple[list[str], str | None]:
        """What the table is keyed and ordered by: written beside it at the first upsert."""
        fs, p = self._fs(f"{self.root}/{name}/_keys.json")
        if keys is None:
            stream = fs.open(p)
            try:
                return tuple(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        stream = fs.create(p, True)
        stream.write(bytearray(json.dumps([keys, seq]).encode()))
        stream.close()
        return keys, seq

    def _merged(self, name: str, parts: list[str]) -> DataFrame:
        """One row a key over the parts: the greatest `seq`, else the latest part, wins."""
        out = None
        for k, part in enumerate(parts):
            one = self.spark.read.parquet(f"{self.root}/{name}/{part}").withColumn("_part", F.lit(k))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out.drop("_part") if len(parts) == 1 else _latest(out, *self._order(name), "_part")

    def read(self, name: str) -> DataFrame | None:
        parts = self._parts(name)
        return self._merged(name, parts) if parts else None

    def upsert(self, name: str, rows: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
        """Insert or replace rows by key; of rows with one key the greatest `seq`, else the new one, wins. Replays change nothing."""
        parts = self._parts(name)
        n = int(parts[-1][1:]) + 1 if parts else 0
        part = f"d{n}" if parts else f"b{n}"
        path = f"{self.root}/{name}"
        _latest(rows.withColumn("_part", F.lit(0)), keys, seq, "_part").write.mode("overwrite").parquet(f"{path}/{part}")
        if not parts:
            self._order(name, keys, seq)
        parts.append(part)
        if len(parts) > DELTAS:
            sizes = [self._size(name, x) for x in parts]
            whole = 2 * sum(sizes[1:]) >= sizes[0]
            taken = parts if whole else parts[1:]
            self._merged(name, taken).write.mode("overwrite").parquet(f"{path}/{'b' if whole else 'd'}{n + 1}")
            for x in taken:  # what they held is in the new part
                fs, p = self._fs(f"{path}/{x}")
                fs.delete(p, True)
        return self.read(name)

    def upsert_edges(self, name: str, edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """Edges (from_id, to_id, type) whose both ends exist, one row each."""
        live = edges.join(sources.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(targets.select(F.col("id").alias("to_id")), "to_id", "left_semi")
        return self.upsert(name, live, ["from_id", "to_id", "type"])

    def append(self, name: str, rows: DataFrame, fmt: str = "json") -> None:
        rows.write.mode("append").format(fmt).save(f"{self.root}/{name}")

    def pending(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key isn't in the table of done ones yet."""
        done = self.read(name)
        return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def _latest(rows: DataFrame, keys: list[str], seq: str | None, part: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, part)]
    if not rest:
        return rows.select(*keys).distinct()
    order = ([seq] if seq else []) + [part]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}") for c in rest])


def write_structure(store: Store, documents: DataFrame, chunks: DataFrame, mentions: DataFrame) -> None:
    """Nodes of documents, chunks and mentions, and the edges between them; replays change nothing."""
    from loomgraph.operators.documents import structure_edges

    store.upsert("documents", documents, ["doc_id"])
    store.upsert("chunks", chunks, ["chunk_id"])
    store.upsert("mentions", mentions, ["mention_id"])
    store.upsert("structure", structure_edges(chunks, mentions), ["from_id", "to_id", "type"])


def write_ontology(store: Store, classes: DataFrame, relations: DataFrame) -> None:
    """Rows of an ontology's classes and relations, with SUBCLASS_OF edges."""
    store.upsert("classes", classes, ["name"])
    store.upsert("relations", relations.withColumn("source_forms", F.to_json("source_forms")), ["name"])
    store.upsert("class_edges", classes.where("parent IS NOT NULL").select(F.col("name").alias("from_id"), F.col("parent").alias("to_id"), F.lit("SUBCLASS_OF").alias("type")), ["from_id", "to_id", "type"])


def report(df: DataFrame, most: int = 1000) -> str:
    """A small result as JSON, for a report file: {"rows": the first `most`, "total": how many there are}."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    total = len(rows) if len(rows) <= most else df.count()
    return json.dumps({"rows": rows[:most], "total": total}, default=str, indent=1)
