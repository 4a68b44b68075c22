"""Documents to chunks and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions import ids, text as T


def chunks(documents: DataFrame, body: str = "body") -> DataFrame:
    """(chunk_id, doc_id, ordinal, text, char_start, char_end) of windows of 500 words."""
    rows = documents.select("doc_id", F.explode(T.chunks_with_offsets(F.col(body))).alias("c")).select("doc_id", "c.*")
    return rows.select(ids.node_id("chunk", F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), "doc_id", "ordinal", "text", "char_start", "char_end")


def mentions(chunked: DataFrame) -> DataFrame:
    """(mention_id, chunk_id, doc_id, ...) with offsets in the document."""
    rows = chunked.select("chunk_id", "doc_id", "char_start", F.explode(T.mentions(F.col("text"))).alias("m"))
    at = F.col("char_start") + F.col("m.char_offset")
    out = rows.select("chunk_id", "doc_id", F.col("m.mention_type").alias("mention_type"), F.col("m.surface").alias("surface"), F.col("m.surface_norm").alias("surface_norm"), at.alias("char_offset"))
    return out.select(ids.node_id("mention", F.col("doc_id"), F.col("char_offset"), F.col("surface")).alias("mention_id"), "*").dropDuplicates(["doc_id", "mention_type", "char_offset", "surface"])


def structure_edges(chunked: DataFrame, mentioned: DataFrame) -> DataFrame:
    """HAS_CHUNK and MENTIONS edges."""
    has = chunked.select(F.col("doc_id").alias("from_id"), F.col("chunk_id").alias("to_id"), F.lit("HAS_CHUNK").alias("type"))
    return has.unionByName(mentioned.select(F.col("chunk_id").alias("from_id"), F.col("mention_id").alias("to_id"), F.lit("MENTIONS").alias("type")))
