"""Entity resolution: records, features, blocking, scoring, clustering, canonical persons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions import ids, text as T
from loomgraph.operators.components import connected_components
from loomgraph.runtime import materialize

#: Weights of the pair features (fixed values).
WEIGHTS = {
    "email_exact": 0.45, "handle_match": 0.25, "name_similarity": 0.15, "nickname_link": 0.15,
    "cooccurrence_path": 0.20, "team_overlap": 0.10, "temporal_plausibility": 0.05, "role_consistency": 0.05,
}
SAME_SENTENCE, LINK, UNCERTAIN, CONFIRMED, REFUTED = -0.40, 0.62, (0.45, 0.72), 0.72, 0.57
MIN_BUCKET, MAX_BUCKET, MAX_KEY_DOCS, MAX_CLUSTER, MAX_DROPS = 2, 250, 500, 12, 200

#: Pairs, or records under a key, that a task of the blocking has on the average; tasks that share an oversized bucket.
PER_TASK, SPREAD = 500_000, 16


def identity_records(documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """One record per non-blank author and per e-mail or handle mention (handles that end like a domain left out)."""
    authors = documents.where(F.length(F.trim("author_raw")) > 0).select(
        ids.node_id("er_author", F.col("doc_id")).alias("rid"), F.lit("author").alias("kind"), F.col("author_raw").alias("raw"),
        "doc_id", "source_system", "thread_key", F.col("created_at").alias("asserted_at"), F.lit(None).cast("string").alias("mention_id"), F.lit(None).cast("int").alias("sentence_ord"),
    )
    kept = mentions.where(F.col("mention_type").isin("email", "handle") & ~((F.col("mention_type") == "handle") & T.is_domain_handle(F.col("surface"))))
    of_docs = documents.select("doc_id", "body", "source_system", "thread_key", "created_at")
    mentioned = kept.join(of_docs, "doc_id").select(
        ids.node_id("er_mention", F.col("mention_id")).alias("rid"), F.concat("mention_type", F.lit("_mention")).alias("kind"), F.col("surface").alias("raw"),
        "doc_id", "source_system", "thread_key", F.col("created_at").alias("asserted_at"), "mention_id", T.sentence_ordinal(F.col("body"), F.col("char_offset")).alias("sentence_ord"),
    )
    return authors.unionByName(mentioned)


def features(records: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """`records` with email, handle, given, surname, nickname_given, department and identity_key."""
    raw = F.trim("raw")
    is_email = (F.col("kind") == "email_mention") | T.looks_like_email(raw)
    is_handle = ~is_email & ((F.col("kind") == "handle_mention") | T.looks_like_handle(raw))
    out = records.withColumn("email", F.when(is_email, F.lower(raw))).withColumn("handle", F.when(is_handle, F.lower(F.regexp_replace(raw, "^@+", ""))))
    spaced = F.translate(F.when(F.col("email").isNotNull(), T.local_part(F.col("email"))).otherwise(F.col("handle")), ".-_", "   ")
    name = T.normalize_name(F.coalesce(spaced, F.col("raw")))
    out = out.withColumn("_name", name).withColumn("given", T.given_name(F.col("_name"))).withColumn("surname", T.surname(F.col("_name"))).drop("_name")
    out = out.withColumn("nickname_given", F.when(F.col("given") != "", T.nickname(F.col("given"))).otherwise(""))
    if roster is None:
        out = out.withColumn("department", F.lit(None).cast("string"))
    else:
        staff = roster.groupBy(F.lower("email").alias("email")).agg(F.min("department").alias("department"))
        out = out.join(staff, "email", "left")
    return out.withColumn("identity_key", F.coalesce(F.concat(F.lit("e:"), "email"), F.concat(F.lit("h:"), "handle"), F.concat(F.lit("n:"), F.trim(F.concat_ws(" ", "given", "surname")))))


def blocking_keys(feats: DataFrame, soundex: Column | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
    """(rid, key_name, key): the nine blocking keys of each record; empty ones left out."""
    code = F.soundex("surname") if soundex is None else soundex
    keys = {
        "email": F.col("email"),
        "email_local": T.local_part(F.col("email")),
        "handle": F.col("handle"),
        "surname": F.col("surname"),
        "soundex": F.when(F.col("surname") != "", code),
        "nickname": F.col("nickname_given"),
        "given_team": F.when(F.col("nickname_given") != "", F.concat("nickname_given", F.lit("::"), "department")),
        "doc": F.col("doc_id"),
        "thread": F.concat("source_system", F.lit("::"), "thread_key"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key_name"), v.alias("key")) for k, v in keys.items() if names is None or k in names])
    return feats.select("rid", F.explode(rows).alias("k")).select("rid", "k.*").where("key IS NOT NULL AND key <> ''")


def candidate_pairs(keys: DataFrame, least: int = MIN_BUCKET, most: int = MAX_BUCKET) -> DataFrame:
    """(i, j, keys): pairs that share a bucket of `least` to `most` records.

    A bucket's size is a pre-aggregated count. Records of oversized buckets are
    dropped before any pair is made, by a join that spreads each bucket over
    SPREAD tasks; a bucket that is left makes 31,125 pairs at most. Pairs and
    keys are dealt to so many tasks that each has PER_TASK on the average.
    """
    counts = materialize(keys.groupBy("key_name", "key").agg(F.count("*").alias("n")))
    usual = counts.where(F.col("n").between(least, most))
    made, rows = usual.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, -(-max(made, rows) // PER_TASK))
    part = F.pmod(F.xxhash64("rid"), F.lit(SPREAD)).cast("int")
    large = counts.where(F.col("n") > most).select("key_name", "key", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))
    kept = keys.withColumn("_part", part).join(large, ["key_name", "key", "_part"], "left_anti").drop("_part")
    if least > 2:  # a bucket of one makes no pair in any case
        kept = kept.join(usual.select("key_name", "key"), ["key_name", "key"], "left_semi")
    kept = kept.repartition(tasks, "key_name", "key")
    other = kept.withColumnRenamed("rid", "j")
    pairs = kept.withColumnRenamed("rid", "i").join(other, ["key_name", "key"]).where("i < j").select("i", "j", "key_name")
    # dealt before they are grouped: a task of the join would gather all its pairs
    return pairs.repartition(tasks, "i", "j").groupBy("i", "j").agg(F.array_sort(F.collect_set("key_name")).alias("keys"))


def neighbours(feats: DataFrame, most_docs: int = MAX_KEY_DOCS) -> DataFrame:
    """(identity_key, neighbours): identities met in the same documents; those in over `most_docs` left out."""
    met = feats.select("doc_id", "identity_key").distinct()
    usual = met.groupBy("identity_key").agg(F.count("*").alias("n")).where(F.col("n") <= most_docs).select("identity_key")
    met = met.join(usual, "identity_key")
    pairs = met.join(met.withColumnRenamed("identity_key", "other"), "doc_id").where("identity_key <> other")
    return pairs.groupBy("identity_key").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def score(pairs: DataFrame, feats: DataFrame, met: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """`pairs` with each feature, hard_negative and score (0 to 1)."""
    cols = ["email", "handle", "given", "surname", "nickname_given", "department", "raw", "doc_id", "sentence_ord", "asserted_at"]
    have = feats if "asserted_at" in feats.columns else feats.withColumn("asserted_at", F.lit(None).cast("timestamp"))
    side = have.join(met, "identity_key", "left")
    if roster is not None:
        by_mail = roster.groupBy(F.lower("email").alias("email")).agg(F.min("name").alias("_m_name"), F.min("department").alias("_m_dept"))
        by_name = roster.groupBy(T.normalize_name(F.col("name")).alias("_full")).agg(F.min("name").alias("_n_name"), F.min("department").alias("_n_dept"))
        side = side.withColumn("_full", F.trim(F.concat_ws(" ", "given", "surname"))).join(by_mail, "email", "left").join(by_name, "_full", "left")
        side = side.withColumn("employee", F.coalesce("_m_name", "_n_name")).withColumn("department", F.coalesce("department", "_m_dept", "_n_dept"))
    else:
        side = side.withColumn("employee", F.lit(None).cast("string"))
    cols += ["employee", "neighbours"]
    a, b = (side.select(F.col("rid").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols]) for k in ("i", "j"))
    p = pairs.join(a, "i").join(b, "j")

    def both(name: str) -> Column:
        return F.coalesce((F.col(f"i_{name}") == F.col(f"j_{name}")) & (F.col(f"i_{name}") != ""), F.lit(False))

    def starts(x: str, y: str) -> Column:
        return F.coalesce(F.startswith(F.col(f"{y}_email"), F.concat(f"{x}_handle", F.lit("@"))), F.lit(False))

    def tokens(k: str) -> Column:
        return F.array_distinct(F.filter(F.array(F.col(f"{k}_given"), F.col(f"{k}_surname")), lambda x: x != ""))

    empty = F.array().cast("array<string>")
    gap = F.abs(T.days_between(F.col("i_asserted_at"), F.col("j_asserted_at")))
    near = T.jaccard(F.coalesce("i_neighbours", empty), F.coalesce("j_neighbours", empty))
    parts = {
        "email_exact": both("email").cast("double"),
        "handle_match": (both("handle") | starts("i", "j") | starts("j", "i")).cast("double"),
        "name_similarity": T.jaccard(tokens("i"), tokens("j")),
        "nickname_link": (both("nickname_given") & both("surname")).cast("double"),
        "cooccurrence_path": near,
        "team_overlap": both("department").cast("double"),
        "temporal_plausibility": F.when(gap.isNull(), 0.7).when(gap <= 365 * 5, 1.0).otherwise(0.3),
        "role_consistency": F.when(F.col("i_employee").isNull() | F.col("j_employee").isNull(), 0.5).otherwise(both("employee").cast("double")),
    }
    for name, value in parts.items():
        p = p.withColumn(name, value)
    negative = F.coalesce(both("doc_id") & (F.col("i_sentence_ord") == F.col("j_sentence_ord")) & (F.lower(F.trim("i_raw")) != F.lower(F.trim("j_raw"))), F.lit(False))
    total = sum((F.lit(w) * F.col(n) for n, w in WEIGHTS.items()), F.lit(0.0)) + F.when(negative, SAME_SENTENCE).otherwise(0.0)
    return p.withColumn("hard_negative", negative).select("i", "j", "keys", *parts, "hard_negative", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 9).alias("score"))


def uncertain(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("score") >= UNCERTAIN[0]) & (F.col("score") < UNCERTAIN[1]) & ~F.col("hard_negative"))


def adjudicate(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scores after verdicts (i, j, same_person, confidence): confirmed ones rise, the others fall; pairs without one stay."""
    joined = scored.join(verdicts, ["i", "j"], "left")
    sure = F.col("same_person") & (F.col("confidence") >= 0.5)
    moved = F.when(F.col("same_person").isNull(), F.col("score")).when(sure, F.greatest("score", F.lit(CONFIRMED))).otherwise(F.least("score", F.lit(REFUTED)))
    return joined.withColumn("score", moved).drop("same_person", "confidence")


def _split(members: list[dict], edges: list[tuple], negatives: set[tuple], largest: int, enforce: bool) -> list[list]:
    """Parts of one component after its weakest links are cut until every part is acceptable."""
    of = {m["rid"]: m for m in members}
    near: dict = {r: set() for r in of}
    for _, a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def reach(start, stop=None) -> set:
        seen, stack = {start}, [start]
        while stack:
            for y in near[stack.pop()] - seen:
                if y == stop:
                    return seen | {y}
                seen.add(y)
                stack.append(y)
        return seen

    def bad(part: set) -> bool:
        mails = {of[r]["email"] for r in part if of[r]["email"]}
        return len({of[r]["surface"] for r in part}) > largest or len(mails) > 1 or (enforce and any(a in part and b in part for a, b in negatives))

    done, work, drops = [], [], 0
    left = set(of)
    while left:
        part = reach(next(iter(left)))
        left -= part
        (work if bad(part) else done).append(part)
    for _, a, b in sorted(edges):
        part = next((p for p in work if a in p), None)
        if part is None or drops >= MAX_DROPS:
            continue
        drops += 1
        near[a].discard(b)
        near[b].discard(a)
        one = reach(a, b)
        if b not in one:
            work.remove(part)
            for half in (one, part - one):
                (work if bad(half) else done).append(half)
    return [list(p) for p in done + work]


def cluster(feats: DataFrame, scored: DataFrame, enforce_negatives: bool = True, count_surfaces: bool = True, threshold: float = LINK) -> DataFrame:
    """(rid, cluster_id) of every record.

    Components of links of at least `threshold`; a component with more than
    MAX_CLUSTER surfaces (or records), two e-mail addresses or, where enforced,
    a hard negative loses its weakest links until its parts are acceptable.
    Components come from the distributed star rounds; only those that need
    splitting are grouped.
    """
    links = scored.where((F.col("score") >= threshold) & ~F.col("hard_negative")).select("i", "j", "score")
    found = connected_components(links, "i", "j").withColumnRenamed("id", "rid")
    surface = F.lower(F.trim("raw")) if count_surfaces else F.col("rid").cast("string")
    members = feats.select("rid", F.coalesce("email", F.lit("")).alias("email"), surface.alias("surface")).join(found, "rid")
    inside = links.join(found.select(F.col("rid").alias("i"), "component_id"), "i")
    against = scored.where("hard_negative").select("i", "j").join(found.select(F.col("rid").alias("i"), "component_id"), "i").join(found.select(F.col("rid").alias("j"), F.col("component_id").alias("_cj")), "j").where("component_id = _cj")
    odd = members.groupBy("component_id").agg(F.count_distinct("surface").alias("n"), F.count_distinct(F.nullif("email", F.lit(""))).alias("m"))
    odd = odd.where((F.col("n") > MAX_CLUSTER) | (F.col("m") > 1)).select("component_id")
    if enforce_negatives:
        odd = odd.unionAll(against.select("component_id")).distinct()
    rid = feats.schema["rid"].dataType.simpleString()
    rows = members.select("component_id", "rid", "email", "surface", F.lit(None).cast(rid).alias("j"), F.lit(0.0).alias("score"), F.lit("m").alias("what"))
    rows = rows.unionByName(inside.select("component_id", F.col("i").alias("rid"), F.lit("").alias("email"), F.lit("").alias("surface"), "j", "score", F.lit("l").alias("what")))
    rows = rows.unionByName(against.select("component_id", F.col("i").alias("rid"), F.lit("").alias("email"), F.lit("").alias("surface"), "j", F.lit(0.0).alias("score"), F.lit("n").alias("what")))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        records = group[group.what == "m"][["rid", "email", "surface"]].to_dict("records")
        pairs = group[group.what == "l"]
        edges = list(zip(pairs.score, pairs.rid, pairs.j, strict=True))
        no = group[group.what == "n"]
        out = _split(records, edges, set(zip(no.rid, no.j, strict=True)), MAX_CLUSTER, enforce_negatives)
        return pd.DataFrame([(r, min(p)) for p in out for r in p], columns=["rid", "cluster_id"])

    cut = rows.join(odd, "component_id", "left_semi").groupBy("component_id").applyInPandas(split, f"rid {rid}, cluster_id {rid}")
    whole = found.join(odd, "component_id", "left_anti").select("rid", F.col("component_id").alias("cluster_id"))
    return feats.select("rid").join(whole.unionByName(cut), "rid", "left").select("rid", F.coalesce("cluster_id", "rid").alias("cluster_id"))


def invariants(scored: DataFrame, clusters: DataFrame, feats: DataFrame) -> DataFrame:
    """One row: clustered pairs of one sentence, clusters with several e-mail addresses."""
    c = clusters.select("rid", "cluster_id")
    bad = scored.where("hard_negative").join(c.withColumnRenamed("rid", "i"), "i").join(c.select(F.col("rid").alias("j"), F.col("cluster_id").alias("_c")), "j").where("cluster_id = _c")
    mails = feats.join(c, "rid").groupBy("cluster_id").agg(F.count_distinct("email").alias("n")).where("n > 1")
    rows = bad.select(F.lit("b").alias("what")).unionAll(mails.select(F.lit("m").alias("what")))
    return rows.agg(F.count_if(F.col("what") == "b").alias("cosentence_pairs"), F.count_if(F.col("what") == "m").alias("email_conflicts"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-null `value` per key; of equals the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def canonicalize(feats: DataFrame, clusters: DataFrame, roster: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(persons, alias_map) of the clusters."""
    f = feats.join(clusters, "rid")
    if roster is not None:
        f = f.join(roster.groupBy(F.lower("email").alias("email")).agg(F.min("name").alias("_roster")), "email", "left")
    else:
        f = f.withColumn("_roster", F.lit(None).cast("string"))
    f = f.withColumn("_pure", F.when(F.col("email").isNull() & F.col("handle").isNull(), F.trim("raw"))).withColumn("_raw", F.trim("raw"))
    names = [mode(f.select("cluster_id", F.col(c).alias(a)), ["cluster_id"], a) for c, a in (("_roster", "_r"), ("_pure", "_p"), ("_raw", "_w"), ("email", "_e"))]
    base = f.groupBy("cluster_id").agg(
        F.count("*").alias("cluster_size"), F.count_distinct(F.lower("_raw")).alias("alias_count"), F.array_sort(F.collect_set("source_system")).alias("source_systems")
    )
    for n in names:
        base = base.join(n, "cluster_id", "left")
    cid = F.concat(F.lit("Person:"), F.substring(F.md5(F.col("cluster_id").cast("string")), 1, 24)).alias("canonical_id")
    persons = base.select(cid, "cluster_id", F.coalesce("_r", "_p", "_w").alias("name"), F.col("_e").alias("primary_email"), "alias_count", "source_systems", "cluster_size")
    aliases = f.select(F.lower("_raw").alias("alias"), "cluster_id").groupBy("alias").agg(F.max("cluster_id").alias("cluster_id"))
    return persons, aliases.join(persons.select("cluster_id", "canonical_id"), "cluster_id").select("alias", "canonical_id")


def resolves_to(feats: DataFrame, clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """Edges mention → person; an author record gets a mention id of its own."""
    own = F.coalesce("mention_id", ids.node_id("author_mention", F.col("doc_id"))) if "mention_id" in feats.columns else ids.node_id("author_mention", F.col("rid"))
    return feats.withColumn("from_id", own).join(clusters, "rid").join(persons.select("cluster_id", "canonical_id"), "cluster_id").select("from_id", F.col("canonical_id").alias("to_id"), F.lit("RESOLVES_TO").alias("type"))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))
