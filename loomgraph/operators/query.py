"""Questions in batches: anchors, five traversals, abstention, citations and the answer row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions import text as T
from loomgraph.runtime import materialize

MAX_KEYS, MAX_HOPS, NEAR_MISSES = 30, 3, 3
WEAK_TRUST, FEW_SOURCES = 0.35, 2
CLAIM = ["claim_id", "predicate", "subject_id", "object_id", "object_literal", "asserted_at", "extraction_confidence", "evidence_chunk_id", "source_system"]


def anchors(questions: DataFrame, claims: DataFrame, alias_map: DataFrame | None = None, use_alias: bool = True) -> DataFrame:
    """(question_id, pos, name, normalized, canonical_id, known, resolved) of every entity of every question.

    An entity is known where a claim has it as subject or object, in its
    normalised form or as it was written (lower-cased); it is resolved where it
    is known or an alias leads to a person.
    """
    asked = questions.select("question_id", F.posexplode("entities").alias("pos", "name"))
    asked = asked.withColumn("normalized", T.normalize_surface(F.col("name"))).withColumn("literal", F.lower(F.trim("name")))
    terms = claims.select(F.lower(F.trim("subject_id")).alias("literal")).unionAll(claims.select(F.lower(F.trim("object_id")).alias("literal"))).where("literal IS NOT NULL").distinct()
    forms = asked.select("question_id", "pos", F.explode(F.array_distinct(F.array("literal", "normalized"))).alias("literal"))
    hits = forms.join(terms, "literal").groupBy("question_id", "pos").agg(F.array_sort(F.collect_set("literal")).alias("subject_ids"))
    out = asked.join(hits, ["question_id", "pos"], "left")
    if alias_map is not None and use_alias:
        one = alias_map.groupBy("alias").agg(F.min("canonical_id").alias("canonical_id"))
        out = out.join(one.select(F.col("alias").alias("literal"), F.col("canonical_id").alias("_a")), "literal", "left")
        out = out.join(one.select(F.col("alias").alias("normalized"), F.col("canonical_id").alias("_b")), "normalized", "left").withColumn("canonical_id", F.coalesce("_a", "_b"))
    else:
        out = out.withColumn("canonical_id", F.lit(None).cast("string"))
    known = F.col("subject_ids").isNotNull()
    return out.select("question_id", "pos", "name", "literal", "normalized", "canonical_id", F.coalesce("subject_ids", F.array().cast("array<string>")).alias("subject_ids"), known.alias("known"), (known | F.col("canonical_id").isNotNull()).alias("resolved"))


def match_keys(found: DataFrame, alias_map: DataFrame | None = None) -> DataFrame:
    """(question_id, pos, key): up to MAX_KEYS keys of each anchor: its forms, its person and the person's aliases."""
    own = F.array_union(F.col("subject_ids"), F.array_compact(F.array("literal", "normalized", "canonical_id")))
    out = found.select("question_id", "pos", "canonical_id", own.alias("keys"))
    if alias_map is not None:
        names = alias_map.groupBy("canonical_id").agg(F.slice(F.array_sort(F.collect_set("alias")), 1, MAX_KEYS).alias("aliases"))
        out = out.join(names, "canonical_id", "left").withColumn("keys", F.array_union("keys", F.coalesce("aliases", F.array().cast("array<string>"))))
    return out.select("question_id", "pos", F.explode(F.slice(F.array_sort(F.array_distinct("keys")), 1, MAX_KEYS)).alias("key"))


def _hinted(df: DataFrame) -> DataFrame:
    return df.where("predicate_hint IS NULL OR predicate = predicate_hint")


def _asked(questions: DataFrame, plan: str) -> DataFrame:
    return questions.where(F.coalesce("plan_class", F.lit("LOOKUP")) == plan).select("question_id", "predicate_hint")


def lookup(questions: DataFrame, found: DataFrame, claims: DataFrame, plan: str = "LOOKUP") -> DataFrame:
    """Claims whose subject is one of the anchors' known ids."""
    keys = found.select("question_id", F.explode("subject_ids").alias("_k")).distinct().join(_asked(questions, plan), "question_id")
    return _hinted(claims.join(keys, F.lower(F.trim("subject_id")) == F.col("_k"))).select("question_id", *CLAIM)


def aggregate(questions: DataFrame, keys: DataFrame, claims: DataFrame, plan: str = "AGGREGATE", need_hint: bool = True) -> DataFrame:
    """Claims with an anchor's key as subject or object."""
    asked = _asked(questions, plan)
    asked = asked.where("predicate_hint IS NOT NULL") if need_hint else asked
    k = keys.select("question_id", F.col("key").alias("_k")).distinct().join(asked, "question_id")
    ends = claims.select("*", F.explode(F.array_distinct(F.array_compact(F.array(F.lower(F.trim("subject_id")), F.lower(F.trim("object_id")))))).alias("_k"))
    return _hinted(ends.join(k, "_k")).select("question_id", *CLAIM).dropDuplicates(["question_id", "claim_id"])


def temporal(questions: DataFrame, keys: DataFrame, claims: DataFrame) -> DataFrame:
    """As aggregate, with `position` in order of time, undated ones first."""
    from pyspark.sql import Window

    w = Window.partitionBy("question_id").orderBy(F.asc_nulls_first("asserted_at"), "claim_id")
    return aggregate(questions, keys, claims, "TEMPORAL", need_hint=False).withColumn("position", F.row_number().over(w))


def conflicts(questions: DataFrame, keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Conflict sets about an anchor's keys."""
    k = keys.select("question_id", F.col("key").alias("_k")).distinct().join(_asked(questions, "CONFLICT"), "question_id")
    return _hinted(sets.join(k, F.lower(F.trim("subject")) == F.col("_k"))).drop("_k", "predicate_hint")


def multihop(starts: DataFrame, targets: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(question_id, hop, reached) of the first hop at which a question's frontier meets its targets.

    `starts` and `targets` are (question_id, key), `edges` (src, dst), walked
    either way. Edges are written once and the frontier once a hop; questions
    that have met their targets walk no further, and the last hop only follows
    edges into a target.
    """
    both = materialize(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = materialize(starts.select("question_id", "key").distinct())
    frontier, met = seen, None
    goal = materialize(targets.select("question_id", "key").distinct().join(seen, ["question_id", "key"], "left_anti"))
    for hop in range(1, max_hops + 1):
        walked = both if hop < max_hops else both.join(goal.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi")
        step = frontier.join(walked, F.col("key") == F.col("src")).select("question_id", F.col("dst").alias("key")).distinct()
        frontier = materialize(step.join(seen, ["question_id", "key"], "left_anti"))
        hit = materialize(frontier.join(goal, ["question_id", "key"], "left_semi").groupBy("question_id").agg(F.lit(hop).alias("hop"), F.array_sort(F.collect_set("key")).alias("reached")))
        met = hit if met is None else met.unionByName(hit)
        if hop < max_hops:
            frontier = frontier.join(hit.select("question_id"), "question_id", "left_anti")
            seen = seen.unionAll(frontier)
    return met


def multihop_claims(questions: DataFrame, keys: DataFrame, claims: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """All claims seen on the way from a question's first anchor to its second; none where it isn't reached.

    The hint holds for the first hop only. Adds `hops`, the depth of the hit.
    """
    asked = _asked(questions, "MULTIHOP")
    k = keys.join(asked, "question_id")
    starts, goal = k.where("pos = 0").select("question_id", "key"), k.where("pos = 1").select("question_id", "key")
    ends = claims.select(*CLAIM, F.lower(F.trim("subject_id")).alias("a"), F.lower(F.trim("object_id")).alias("b")).where("b IS NOT NULL")
    both = materialize(ends.unionAll(ends.select(*CLAIM, F.col("b").alias("a"), F.col("a").alias("b"))))
    seen = materialize(starts.distinct())
    frontier, walked, met = seen, None, None
    goal = goal.join(seen, ["question_id", "key"], "left_anti")
    for hop in range(1, max_hops + 1):
        step = frontier.join(both, F.col("key") == F.col("a"))
        if hop == 1:
            step = _hinted(step.join(asked, "question_id"))
        step = materialize(step.select("question_id", F.lit(hop).alias("hop"), *CLAIM, F.col("b").alias("key")))
        walked = step if walked is None else walked.unionByName(step)
        frontier = step.select("question_id", "key").distinct().join(seen, ["question_id", "key"], "left_anti")
        hit = materialize(frontier.join(goal, ["question_id", "key"], "left_semi").select("question_id", F.lit(hop).alias("hops")).distinct())
        met = hit if met is None else met.unionByName(hit)
        frontier = materialize(frontier.join(hit, "question_id", "left_anti"))
        seen = seen.unionAll(frontier)
    depth = met.groupBy("question_id").agg(F.min("hops").alias("hops"))
    return walked.join(depth, "question_id").where("hop <= hops").select("question_id", "hops", *CLAIM).dropDuplicates(["question_id", "claim_id"])


def paths(starts: DataFrame, targets: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(src, dst, hops, path): one shortest path (the least) from each start (key) to each target (key).

    A hop only follows edges to vertices from which a target can still be
    reached in the hops that are left; what is on a shortest path always can.
    """
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    goals = targets.select(F.col("key").alias("at")).distinct()
    near = [goals]  # by the hops that are left
    for _ in range(1, max_hops):
        near.append(materialize(near[-1].unionAll(both.join(near[-1], F.col("dst") == F.col("at"), "left_semi").select(F.col("src").alias("at"))).distinct()))
    at = starts.select(F.col("key").alias("from"), F.col("key").alias("at"), F.array("key").alias("path")).distinct()
    seen, out = at.select("from", "at"), None
    for hop in range(1, max_hops + 1):
        useful = both.join(near[max_hops - hop].select(F.col("at").alias("dst")), "dst", "left_semi")
        step = at.join(useful, F.col("at") == F.col("src")).select("from", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        at = step.join(seen, ["from", "at"], "left_anti").groupBy("from", "at").agg(F.min("path").alias("path"))
        hit = at.join(goals, "at", "left_semi").select(F.col("from").alias("src"), F.col("at").alias("dst"), F.lit(hop).alias("hops"), "path")
        out = hit if out is None else out.unionByName(hit)
        seen = seen.unionAll(at.select("from", "at"))
    return out


def near_misses(found: DataFrame, persons: DataFrame) -> DataFrame:
    """(question_id, near_misses): for unresolved anchors, the first names that begin with the same three letters."""
    lost = found.where("NOT resolved AND length(normalized) >= 3").select("question_id", "pos", F.substring("normalized", 1, 3).alias("stem")).distinct()
    names = persons.select(F.lower("name").alias("name")).where("name IS NOT NULL").distinct().withColumn("stem", F.substring("name", 1, 3))
    # the least names of a stem are found before the join, so a common stem costs three rows a question
    from pyspark.sql import Window

    first = names.withColumn("_r", F.row_number().over(Window.partitionBy("stem").orderBy("name"))).where(F.col("_r") <= NEAR_MISSES).drop("_r")
    hits = lost.join(first, "stem")
    return hits.groupBy("question_id").agg(F.slice(F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"]), 1, NEAR_MISSES).alias("near_misses"))


def reason(unresolved: Column, claim_count: Column, path_count: Column, max_trust: Column, sources: Column) -> Column:
    """Why to abstain; null where to answer. The three texts are fixed values."""
    return (
        F.when(unresolved & (claim_count == 0), "entity not found under any known alias")
        .when((path_count == 0) & (claim_count == 0), "entities exist but no relationship found within bound")
        .when((max_trust < WEAK_TRUST) & (sources < FEW_SOURCES), "only weak, uncorroborated evidence")
    )


def gate(questions: DataFrame, found: DataFrame, hits: DataFrame, conflict_counts: DataFrame | None = None) -> DataFrame:
    """Signals of each question and whether it abstains, with the reason.

    `hits` has the claims of every question. A conflict question with a
    conflict set is answered whatever its claims.
    """
    anchors_of = found.groupBy("question_id").agg((~F.bool_and("resolved")).alias("unresolved"))
    facts = hits.groupBy("question_id").agg(
        F.count("*").alias("claim_count"), F.max("extraction_confidence").alias("max_trust"), F.count_distinct("evidence_chunk_id").alias("evidence_sources")
    )
    q = questions.select("question_id", "plan_class").join(anchors_of, "question_id", "left").join(facts, "question_id", "left")
    if conflict_counts is not None:
        q = q.join(conflict_counts.select("question_id", F.col("n").alias("conflict_count")), "question_id", "left")
    else:
        q = q.withColumn("conflict_count", F.lit(0).cast("long"))
    q = q.fillna(0, ["claim_count", "evidence_sources", "conflict_count"]).fillna(0.0, ["max_trust"]).withColumn("unresolved", F.coalesce("unresolved", F.lit(True)))
    path_count = F.when(F.col("plan_class") == "CONFLICT", F.col("conflict_count")).otherwise(F.col("claim_count"))
    why = reason(F.col("unresolved"), F.col("claim_count"), path_count, F.col("max_trust"), F.col("evidence_sources"))
    why = F.when((F.col("plan_class") == "CONFLICT") & (F.col("conflict_count") > 0), None).otherwise(why)
    return q.withColumn("path_count", path_count).withColumn("reason", why).withColumn("abstained", F.col("reason").isNotNull())


def citations(hits: DataFrame, chunks: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """(question_id, claim_id, chunk_id, doc_id, ...): the chunk behind each claim, of the cited ones where any is cited.

    `chunks` has chunk_id, doc_id and whatever else a citation shows. One
    equality join for all questions.
    """
    rows = hits
    if cited is not None:
        some = cited.select("question_id").distinct().withColumn("_some", F.lit(True))
        mine = cited.select("question_id", "claim_id").distinct().withColumn("_cited", F.lit(True))
        rows = rows.join(some, "question_id", "left").join(mine, ["question_id", "claim_id"], "left").where("_some IS NULL OR _cited")
    return rows.select("question_id", "claim_id", F.col("evidence_chunk_id").alias("chunk_id")).join(chunks, "chunk_id")


def answer_text(hits: DataFrame) -> DataFrame:
    """(question_id, answer): the claims as sentences, in order of id; the deterministic stand-in for a written answer."""
    line = F.concat_ws(" ", "subject_id", "predicate", F.coalesce("object_literal", "object_id"))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("claim_id", line.alias("line")))), lambda x: x["line"]), "; ").alias("answer"))


def answers(gated: DataFrame, texts: DataFrame, cited: DataFrame, missed: DataFrame | None = None, consistency: str = "eventual") -> DataFrame:
    """The answer row of each question (flat columns; `contract` nests them)."""
    per = cited.groupBy("question_id").agg(F.count("*").alias("n_citations"), F.count_distinct("doc_id").alias("documents_touched"))
    q = gated.join(texts, "question_id", "left").join(per, "question_id", "left")
    q = q.join(missed, "question_id", "left") if missed is not None else q.withColumn("near_misses", F.array().cast("array<string>"))
    note = F.when(F.size(F.coalesce("near_misses", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" (nearest known names: "), F.array_join("near_misses", ", "), F.lit(")"))).otherwise("")
    summary = F.when(F.col("abstained"), F.concat("reason", note)).otherwise(F.concat(F.col("claim_count").cast("string"), F.lit(" claim(s) via "), "plan_class"))
    live = ~F.col("abstained")
    return q.select(
        "question_id", "plan_class", "abstained", F.when(live, F.coalesce("answer", F.lit(""))).alias("answer"),
        F.when(live, F.round("max_trust", 2)).otherwise(0.0).alias("confidence"),
        F.when(live, F.coalesce("n_citations", F.lit(0))).otherwise(0).alias("n_citations"),
        F.when(live, F.col("path_count")).otherwise(0).alias("path_count"), summary.alias("path_summary"),
        F.when(live, F.coalesce("documents_touched", F.lit(0))).otherwise(0).alias("documents_touched"), F.lit(consistency).alias("consistency"),
    )


def contract(flat: DataFrame) -> DataFrame:
    """(question_id, json) in the nested shape of an answer."""
    body = F.struct(
        "question_id", "plan_class", "answer", "abstained", "confidence", F.struct("path_count", "path_summary").alias("traversal"),
        F.struct(F.col("n_citations").alias("claims_considered"), "documents_touched", "consistency").alias("graph_stats"),
    )
    return flat.select("question_id", F.to_json(body).alias("json"))


def other_aliases(found: DataFrame, alias_map: DataFrame, most: int = 5) -> DataFrame:
    """(question_id, pos, aliases): up to `most` other names of an anchor's person."""
    names = found.where("canonical_id IS NOT NULL").join(alias_map, "canonical_id").where("alias <> literal")
    return names.groupBy("question_id", "pos").agg(F.slice(F.array_sort(F.collect_set("alias")), 1, most).alias("aliases"))
