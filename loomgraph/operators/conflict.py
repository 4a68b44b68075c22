"""Contradictory claims: detection, supersession, granularity, trust and adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions import text as T
from loomgraph.runtime import materialize

#: Authority of each source system (fixed values).
AUTHORITY = {
    "confluence": 0.95, "gdrive": 0.85, "jira": 0.85, "linear": 0.85, "github": 0.80,
    "hubspot": 0.80, "gmail": 0.65, "fireflies": 0.55, "slack": 0.45,
}
DEFAULT_AUTHORITY, RECENCY_DAYS, STALENESS_DAYS, UNDATED_DAYS = 0.5, 90, 365, 180
MARGIN, WINNER_TRUST, SUPERSEDED_DAYS = 0.12, 0.40, 14

GROUP = ["subject", "predicate"]


def object_key(object_id: Column, literal: Column) -> Column:
    def clean(c: Column) -> Column:
        return F.nullif(F.lower(F.trim(c)), F.lit(""))

    return F.coalesce(F.concat(F.lit("literal:"), clean(literal)), F.concat(F.lit("entity:"), clean(object_id)), F.lit("unknown"))


def resolve_subject(claims: DataFrame, alias_map: DataFrame | None) -> DataFrame:
    """`claims` with subject: the canonical id of subject_id, or itself.

    `alias_map` (alias, canonical_id) joins by equality; Spark broadcasts it where it is small.
    """
    if alias_map is None:
        return claims.withColumn("subject", F.col("subject_id"))
    names = alias_map.select(F.col("alias").alias("_alias"), F.col("canonical_id").alias("_canonical"))
    joined = claims.join(names, F.lower(F.trim("subject_id")) == F.col("_alias"), "left")
    return joined.withColumn("subject", F.coalesce("_canonical", "subject_id")).drop("_alias", "_canonical")


def functional_claims(claims: DataFrame, functional: list[str], alias_map: DataFrame | None = None) -> DataFrame:
    """Affirmed claims of single-valued predicates with subject and object_key."""
    kept = claims.where(F.col("predicate").isin(functional) & (F.col("polarity") != "negate"))
    return resolve_subject(kept, alias_map).withColumn("object_key", object_key(F.col("object_id"), F.col("object_literal")))


def candidates(claims: DataFrame) -> DataFrame:
    """(subject, predicate, n_claims, n_values, values) with more than one known object."""
    known = F.when(F.col("object_key") != "unknown", F.col("object_key"))
    grouped = claims.groupBy(*GROUP).agg(F.count("*").alias("n_claims"), F.count_distinct(known).alias("n_values"), F.array_sort(F.collect_set(known)).alias("values"))
    return grouped.where("n_values > 1")


def in_conflict(claims: DataFrame) -> DataFrame:
    """The claims of the candidates."""
    return claims.join(candidates(claims).select(*GROUP), GROUP, "left_semi")


def supersession(claims: DataFrame, gap_days: int = SUPERSEDED_DAYS) -> DataFrame:
    """Candidate claims with `superseded` and `group_superseded`.

    A dated claim is superseded where it differs from its group's newest claim
    and is more than `gap_days` older; a group whose other claims agree on one
    object is superseded as a whole. Of equally new claims the latest wins.
    """
    newest = claims.groupBy(*GROUP).agg(F.max(F.when(F.col("asserted_at").isNotNull(), F.struct("asserted_at", "seq", "object_key"))).alias("_newest"))
    gap = T.days_between(F.col("_newest.asserted_at"), F.col("asserted_at"))
    old = F.col("asserted_at").isNotNull() & (F.col("object_key") != F.col("_newest.object_key")) & (gap > gap_days)
    # aggregates joined back, not windows: a hot group is pre-aggregated and its join can be split
    marked = claims.join(newest, GROUP).withColumn("superseded", F.coalesce(old, F.lit(False))).drop("_newest")
    rest = marked.groupBy(*GROUP).agg(F.count_distinct(F.when(~F.col("superseded"), F.col("object_key"))).alias("_rest"))
    return marked.join(rest, GROUP).withColumn("group_superseded", F.col("_rest") <= 1).drop("_rest")


def granularity(claims: DataFrame) -> DataFrame:
    """(subject, predicate, values, compatible): every two values contain one another."""
    value = F.regexp_replace("object_key", "^(literal|entity):", "")
    grouped = claims.groupBy(*GROUP).agg(F.array_sort(F.collect_set(value)).alias("values"))
    fits = F.forall("values", lambda a: F.forall(F.col("values"), lambda b: F.contains(a, b) | F.contains(b, a)))
    return grouped.withColumn("compatible", fits)


def classify(claims: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(subject, predicate, classification) of each candidate.

    SUPERSEDES, then GRANULARITY, then DUPLICATE (fewer than two values left),
    then the verdict of a classifier given as a table (subject, predicate,
    classification), CONTRADICTION by default.
    """
    return _classified(materialize(supersession(claims)), verdicts)


def _classified(marked: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """`classify` of claims that supersession has marked."""
    rest = marked.where("NOT superseded")
    per_group = marked.groupBy(*GROUP).agg(F.bool_or("group_superseded").alias("gone"))
    left = rest.groupBy(*GROUP).agg(F.count_distinct("object_key").alias("left"))
    out = per_group.join(granularity(rest), GROUP, "left").join(left, GROUP, "left")
    if verdicts is None:
        given = F.lit("CONTRADICTION")
    else:
        out = out.join(verdicts.withColumnRenamed("classification", "_given"), GROUP, "left")
        given = F.coalesce("_given", F.lit("CONTRADICTION"))
    kind = (
        F.when(F.col("gone"), "SUPERSEDES")
        .when(F.col("compatible"), "GRANULARITY")
        .when(F.coalesce("left", F.lit(0)) < 2, "DUPLICATE")
        .otherwise(given)
    )
    return out.select(*GROUP, kind.alias("classification"))


def contradicting(claims: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Claims, not superseded, of the groups classified as contradictions."""
    marked = materialize(supersession(claims))
    kinds = _classified(marked, verdicts).where("classification = 'CONTRADICTION'").select(*GROUP)
    return marked.where("NOT superseded").join(kinds, GROUP, "left_semi")


def trust(claims: DataFrame) -> DataFrame:
    """Trust and its parts for every value of every group."""
    newest = F.max(F.struct(F.col("asserted_at").isNotNull(), "asserted_at", (-F.col("seq")).alias("s"), "source_system", "extraction_confidence"))
    values = claims.groupBy(*GROUP, "object_key").agg(
        F.count("*").alias("claim_count"),
        F.count_distinct("source_system").alias("n_sources"),
        F.array_sort(F.collect_set("source_system")).alias("sources"),
        newest.alias("_newest"),
    )
    values = values.withColumn("_reference", F.max("_newest.asserted_at").over(Window.partitionBy(*GROUP)))
    values = values.withColumn("confidence", F.coalesce("_newest.extraction_confidence", F.lit(0.5)))
    age = F.coalesce(T.days_between(F.col("_reference"), F.col("_newest.asserted_at")), F.lit(UNDATED_DAYS))
    pairs = [F.lit(x) for kv in AUTHORITY.items() for x in kv]
    authority = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_newest.source_system")), F.lit(DEFAULT_AUTHORITY))
    parts = (
        values.withColumn("authority", authority)
        .withColumn("recency", T.decay(age, RECENCY_DAYS))
        .withColumn("corroboration", F.least(F.lit(1.0), 0.5 + 0.25 * (F.col("n_sources") - 1)))
        .withColumn("specificity", F.when(F.col("object_key").startswith("literal:"), 1.0).otherwise(0.6))
        .withColumn("staleness", 1 - T.decay(age, STALENESS_DAYS))
    )
    score = (
        0.30 * F.col("authority") + 0.25 * F.col("recency") + 0.25 * F.col("corroboration")
        + 0.10 * F.col("specificity") + 0.05 * F.col("confidence") - 0.15 * F.col("staleness")
    )
    return parts.withColumn("trust", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("_reference", "_newest")


def adjudicate(values: DataFrame) -> DataFrame:
    """One row per group: status, winner, margin and rationale, from the trust of its values."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("trust"), "object_key")
    ranked = values.withColumn("_rank", F.row_number().over(w)).withColumn("second", F.lead("trust").over(w)).withColumn("second_key", F.lead("object_key").over(w))
    top = ranked.where("_rank = 1")
    margin = F.col("trust") - F.coalesce("second", F.lit(0.0))
    status = (
        F.when(F.col("second").isNotNull() & (margin < MARGIN), "CONTESTED")
        .when(F.col("trust") < WINNER_TRUST, "UNRESOLVED")
        .otherwise("RESOLVED")
    )
    top = top.withColumn("margin", F.round(margin, 4)).withColumn("resolution_status", status)
    why = (
        F.when(F.col("resolution_status") == "CONTESTED", F.format_string("two values are within %.2f: %s (%.2f) and %s (%.2f)", F.lit(MARGIN), "object_key", "trust", "second_key", "second"))
        .when(F.col("resolution_status") == "UNRESOLVED", F.format_string("%s has trust %.2f, below %.2f", "object_key", "trust", F.lit(WINNER_TRUST)))
        .when(F.col("second").isNull(), F.format_string("%s is the only value, with trust %.2f", "object_key", "trust"))
        .otherwise(F.format_string("%s wins with trust %.2f before %.2f", "object_key", "trust", "second"))
    )
    return top.select(*GROUP, "resolution_status", F.when(F.col("resolution_status") == "RESOLVED", F.col("object_key")).alias("winner"), "margin", F.round("trust", 6).alias("top_trust"), why.alias("rationale"))


def conflict_sets(claims: DataFrame, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sets, members) to store: adjudicated contradictions and the claims each involves."""
    left = materialize(contradicting(claims, verdicts))
    cid = F.concat(F.lit("ConflictSet:"), F.substring(F.md5(F.concat_ws("\x1f", *GROUP)), 1, 24)).alias("conflict_id")
    counts = left.groupBy(*GROUP).agg(F.count("*").alias("claim_count"), F.size(F.collect_set("source_system")).alias("n_systems"))
    sets = adjudicate(trust(left)).join(counts, GROUP).select(cid, "*")
    return sets, left.select(cid, "claim_id")


def report(claims: DataFrame) -> DataFrame:
    """Histogram of classifications and how many groups span several source systems."""
    systems = claims.groupBy(*GROUP).agg((F.count_distinct("source_system") > 1).alias("cross"))
    return classify(claims).join(systems, GROUP).groupBy("classification").agg(F.count("*").alias("n_groups"), F.count_if("cross").alias("n_cross_system"))
