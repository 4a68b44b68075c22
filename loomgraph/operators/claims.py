"""Claims: extraction interface, ontology gate, evidence chunk, rows and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions import ids

BODY_LIMIT = 12_000


def gate(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """`claims` with `reason`: null where the predicate is known, subject and predicate are there.

    Claims without predicate or subject are dropped; unknown predicates keep
    their row with the reason. `relations` (name, literal) is an ontology's list.
    """
    rel = relations.select(F.col("name").alias("predicate"), F.col("literal").alias("_literal"))
    whole = claims.where("predicate IS NOT NULL AND trim(predicate) <> '' AND subject_id IS NOT NULL AND trim(subject_id) <> ''")
    out = whole.join(rel, "predicate", "left")
    return out.withColumn("reason", F.when(F.col("_literal").isNull(), F.concat(F.lit("unknown predicate: "), "predicate"))).withColumnRenamed("_literal", "is_literal")


def split_objects(claims: DataFrame) -> DataFrame:
    """object_id or object_literal from `object`, by the predicate's range."""
    return claims.withColumn("object_literal", F.when(F.col("is_literal"), F.col("object"))).withColumn("object_id", F.when(~F.col("is_literal"), F.lower(F.trim("object"))))


def evidence_chunk(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """`spans` (doc_id, span_start) with the ordinal of the chunk that holds the offset, the first chunk where none does.

    Chunks of a document are gathered in order (a bounded array per document),
    so an interval join becomes an equality join and a search in the array.
    """
    per_doc = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "char_start", "char_end"))).alias("_c"))
    hit = F.filter("_c", lambda c: (c["char_start"] <= F.col("span_start")) & (F.col("span_start") < c["char_end"]))
    return spans.join(per_doc, "doc_id", "left").withColumn("evidence_ordinal", F.coalesce(F.get(hit, 0)["ordinal"], F.get("_c", 0)["ordinal"])).drop("_c")


def claim_id(doc: Column) -> Column:
    return ids.node_id("claim", F.col("subject_id"), F.col("predicate"), F.coalesce("object_id", "object_literal", F.lit("")), doc)


def extract(documents: DataFrame, extractor: Callable[[DataFrame], DataFrame], relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, unmapped) that `extractor` finds in documents (doc_id, body cut to BODY_LIMIT, created_at).

    The extractor returns doc_id, predicate, subject, object, polarity,
    confidence, span_start, span_end. Defaults: affirm, 0.5, [0, 0], the
    document's date.
    """
    found = extractor(documents.select("doc_id", F.substring("body", 1, BODY_LIMIT).alias("body")))
    found = found.withColumn("subject_id", F.lower(F.trim("subject"))).join(documents.select("doc_id", "created_at", "source_system"), "doc_id")
    gated = gate(found, relations)
    good = split_objects(gated.where("reason IS NULL")).select(
        claim_id(F.col("doc_id")).alias("claim_id"), "predicate", "subject_id", "object_id", "object_literal",
        F.coalesce("polarity", F.lit("affirm")).alias("polarity"), F.col("created_at").alias("asserted_at"),
        F.coalesce("confidence", F.lit(0.5)).alias("extraction_confidence"), F.coalesce("span_start", F.lit(0)).alias("span_start"),
        F.coalesce("span_end", F.lit(0)).alias("span_end"), "doc_id", "source_system",
    ).where(F.col("polarity").isin("affirm", "negate"))
    return good.dropDuplicates(["claim_id"]), gated.where("reason IS NOT NULL").select("doc_id", "predicate", "subject_id", "reason")


def rule_extractor(predicates: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Finds `subject PREDICATE object` on a line; the deterministic stand-in for a model."""
    pattern = r"(?m)^\s*(\S.*?)\s+(" + "|".join(predicates) + r")\s+(\S.*?)\s*$"

    def run(docs: DataFrame) -> DataFrame:
        lines = docs.select("doc_id", "body", F.explode(F.regexp_extract_all("body", F.lit(f"({pattern})"), 1)).alias("line"))
        part = lambda k: F.regexp_extract("line", pattern, k)
        start = F.instr(F.col("body"), F.col("line")) - 1
        return lines.select("doc_id", part(2).alias("predicate"), part(1).alias("subject"), part(3).alias("object"), F.lit(None).cast("string").alias("polarity"),
                            F.lit(None).cast("double").alias("confidence"), start.alias("span_start"), (start + F.length("line")).alias("span_end"))

    return run


def edges(claims: DataFrame) -> DataFrame:
    """EVIDENCED_BY, ASSERTS and ABOUT edges of claims with evidence_chunk_id."""
    mention = lambda role, c: ids.node_id("mention", F.col("doc_id"), F.lit(role), c)
    rows = F.array(
        F.struct(F.lit("EVIDENCED_BY").alias("type"), F.col("evidence_chunk_id").alias("to_id")),
        F.struct(F.lit("ASSERTS").alias("type"), mention("claim-subject", F.col("subject_id")).alias("to_id")),
        F.struct(F.lit("ABOUT").alias("type"), F.when(F.col("object_id").isNotNull(), mention("claim-object", F.col("object_id"))).alias("to_id")),
    )
    return claims.select(F.col("claim_id").alias("from_id"), F.explode(rows).alias("e")).select("from_id", "e.to_id", "e.type").where("to_id IS NOT NULL")


def map_source_fields(fields: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations of raw source fields: (source_system, field) joined to the ontology's source forms."""
    forms = relations.select("name", F.explode("source_forms").alias("source_system", "fields")).select("name", "source_system", F.explode("fields").alias("field"))
    return fields.join(forms, ["source_system", "field"])
