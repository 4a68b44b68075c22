"""Registered queries of sources, records, extraction, aliases and full scores, and SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions import ids, text as T
from loomgraph.operators import claims as C
from loomgraph.operators import documents as O
from loomgraph.operators import er as R
from loomgraph.operators import query as Q
from loomgraph.plans import queries as P
from loomgraph.plans import views
from loomgraph.plans.queries import ORACLES, QUERIES, register
from loomgraph.runtime import materialize, shared_dir, table
from loomgraph.sources import adapters as A

__all__ = ["ORACLES", "QUERIES"]

SOURCES = list(A.ADAPTERS)


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources ------------------------------------------------------------------------------------------------------


def _fields(a: A.Adapter) -> list[str]:
    named = [a.author, a.container, *([a.thread] if a.thread else []), *re.findall(r"\{(\w+)\}", a.uri)]
    return sorted({f for f in named if "[" not in f and f not in ("native_id", a.created)})


def _raw(docs: DataFrame, source: str) -> DataFrame:
    """(path, raw): JSON records as the source would hold the documents that fall to it."""
    a, number = A.ADAPTERS[source], F.col("doc_id").cast("string")
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:20:30Z"))
    two = F.col("doc_id") % 2 == 0
    columns: list[Column] = [
        F.when(two, F.concat(F.lit("u"), number)).alias("dataset_doc_uuid"),
        F.concat(F.lit("Title "), number).alias("title"),
        F.when(two, F.array(F.lit("body"), F.lit("notes"))).alias("content_field_names"),
        F.col("text").alias("body"),
        F.when(two, F.col("lang")).alias("notes"),
        (F.concat((F.lit(1700000000) + F.col("doc_id")).cast("string"), F.lit(".25")) if a.unix else day).alias(a.created),
        *[F.concat(F.lit(f"{f} "), number).alias(f) for f in _fields(a)],
    ]
    if a.or_field:
        columns.append(F.when(two, F.concat(F.lit("at "), number)).alias(a.or_field))
    if "[" in a.author:
        columns.append(F.array(F.concat(F.lit("someone "), number)).alias(a.author.split("[")[0]))
    return docs.select(F.concat(F.lit(f"/corpus/{a.folder or source}/"), number, F.lit(".json")).alias("path"), F.to_json(F.struct(*columns)).alias("raw"))


def _source_sql(k: int, source: str) -> str:
    a = A.ADAPTERS[source]
    n, two = "CAST(doc_id AS VARCHAR)", "doc_id % 2 = 0"
    value = lambda f: f"'someone ' || {n}" if "[" in f else f"'{f} ' || {n}"
    native = f"CASE WHEN {two} THEN 'u' || {n} ELSE {n} END"
    parts = [f"'{x}'" if i % 2 == 0 else native if x == "native_id" else (f"CAST(1700000000 + doc_id AS VARCHAR) || '.25'" if x == a.created else value(x)) for i, x in enumerate(re.split(r"\{(\w+)\}", a.uri))]
    uri = " || ".join(parts) if a.uri else "NULL"
    if a.or_field:
        uri = f"CASE WHEN {two} THEN 'at ' || {n} ELSE {uri} END"
    created = "epoch_us(to_timestamp(1700000000 + doc_id + 0.25))" if a.unix else "epoch_us(make_timestamp(2024, 3, doc_id % 28 + 1, 10, 20, 30))"
    return f"""SELECT {native} AS native_id, '{source}' AS source_system, 'Title ' || {n} AS title, {created} AS created_us, {value(a.author)} AS author_raw, {value(a.thread) if a.thread and a.thread != a.created else 'NULL'} AS thread_key,
 {uri} AS uri, {value(a.container)} AS declared_container, CASE WHEN {two} THEN concat_ws(chr(10) || chr(10), CASE WHEN text <> '' THEN '## body' || chr(10) || text END, CASE WHEN lang <> '' THEN '## notes' || chr(10) || lang END) ELSE coalesce(text, '') END AS body FROM documents WHERE doc_id % 9 = {k}"""


_CORPUS_SQL = " UNION ALL ".join(_source_sql(k, s) for k, s in enumerate(SOURCES))


def _corpus(spark, d) -> DataFrame:
    """The documents table as documents of the nine sources, each through its adapter."""
    docs, out = table(spark, d, "documents"), None
    for k, source in enumerate(SOURCES):
        one = A.documents(_raw(docs.where(F.col("doc_id") % len(SOURCES) == k), source), source)
        out = one if out is None else out.unionByName(one)
    return out


@register(f"SELECT native_id, source_system, title, created_us, author_raw, thread_key, uri, declared_container, sha256(body) AS content_hash, length(body) AS n_chars FROM ({_CORPUS_SQL})")
def src_adapters(spark, d):
    return _corpus(spark, d).select(
        "native_id", "source_system", "title", F.unix_micros("created_at").alias("created_us"), "author_raw", "thread_key", "uri", "declared_container", "content_hash", F.length("body").cast("long").alias("n_chars")
    )


@register("SELECT 'item ' || CAST(item_id AS VARCHAR) AS native_id, 'jira' AS source_system, 'T' || CAST(item_id AS VARCHAR) AS title, text AS body, 'jira://P/K' || CAST(item_id AS VARCHAR) AS uri FROM benchmark")
def src_scan(spark, d):
    """One JSON file a record, found below the source's folder."""
    items, root = table(spark, d, "benchmark"), _folder(spark, "corpus")
    n = F.col("item_id").cast("string")
    rows = items.select("item_id", F.concat(F.lit("item "), n).alias("dataset_doc_uuid"), F.concat(F.lit("T"), n).alias("title"), F.col("text").alias("description"), F.lit("P").alias("project"), F.concat(F.lit("K"), n).alias("key"))
    rows.write.partitionBy("item_id").json(f"{root}/jira")
    return A.corpus_documents(spark, root, ["jira"]).select("native_id", "source_system", "title", "body", "uri")


@register("SELECT doc_id, lang, source, n_chars FROM documents")
def src_jsonl(spark, d):
    from loomgraph.sources.sinks import Store

    root = _folder(spark, "lines")
    Store(spark, root).append("documents", table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"))
    return A.jsonl(spark, f"{root}/documents", "doc_id long, lang string, source string, n_chars long")


@register("SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS native_id, 'google_drive/' || n_name || '.json' AS path, 'gdrive' AS source_system FROM nation UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'slack/' || r_name || '.json', 'slack' FROM region")
def src_uuid_index(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = table(spark, d, "nation").select(key("n", "n_nationkey").alias("k"), F.concat(F.lit("google_drive/"), "n_name", F.lit(".json")).alias("v"))
    rows = rows.unionAll(table(spark, d, "region").select(key("r", "r_regionkey").alias("k"), F.concat(F.lit("slack/"), "r_name", F.lit(".json")).alias("v")))
    path = _folder(spark, "index")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v"))))).write.text(path)
    return A.uuid_index(spark, f"{path}/*.txt")


@register("SELECT n_name AS name, lower(n_name) || '@example.com' AS email, r_name AS department, r_name || ' lead' AS manager FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_roster(spark, d):
    people = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.format_string("    - {name: '%s', email: '%s@Example.com', manager: '%s lead'}", "n_name", F.lower("n_name"), "r_name")
    blocks = people.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("p")).select(F.concat(F.lit("  "), "r_name", F.lit(":\n"), "p").alias("b"))
    path = _folder(spark, "roster")
    blocks.agg(F.concat(F.lit("departments:\n"), F.array_join(F.collect_list("b"), "\n"))).write.text(path)
    return A.roster(spark, f"{path}/*.txt")


_TBOX = """classes:
  Person: {}
  Engineer: {parent: Person}
relations:
""" + "\n".join(f"  {n}: {{domain: Person, range: {'literal string' if x else '[Thing, Item]'}, functional: {str(f).lower()}, source_forms: {{jira: [{n.lower()}, {n.lower()}_alt]}}}}" for n, f, x in P.RELATIONS)


def _tbox(spark):
    path = _folder(spark, "tbox")
    spark.range(1).select(F.lit(_TBOX)).write.text(path)
    return A.ontology(spark, f"{path}/*.txt")


@register("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {f}, {x}, {0 if x else 2})" for n, f, x in P.RELATIONS) + ") t(name, functional, literal, n_ranges)")
def src_ontology(spark, d):
    return _tbox(spark)[1].select("name", "functional", "literal", F.size("range").alias("n_ranges"))


@register("SELECT * FROM (VALUES " + ", ".join(f"('jira', '{n.lower()}{s}', '{n}')" for n, _, _ in P.RELATIONS for s in ("", "_alt")) + ") t(source_system, field, name)")
def src_field_forms(spark, d):
    fields = spark.createDataFrame([("jira", f"{n.lower()}{s}") for n, _, _ in P.RELATIONS for s in ("", "_alt", "_no")], "source_system string, field string")
    return C.map_source_fields(fields, _tbox(spark)[1]).select("source_system", "field", "name")


@register(f"SELECT native_id, CASE WHEN native_id IN (SELECT 'u' || CAST(item_id AS VARCHAR) FROM benchmark) THEN 0 ELSE 1 END AS priority FROM ({_CORPUS_SQL})")
def src_priority(spark, d):
    wanted = table(spark, d, "benchmark").select(F.concat(F.lit("u"), F.col("item_id").cast("string")).alias("native_id"))
    return A.with_priority(_corpus(spark, d), wanted).select("native_id", "priority")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def store_pending(spark, d):
    from loomgraph.sources.sinks import Store

    store = Store(spark, _folder(spark, "done"))
    store.upsert("done", table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), ["doc_id"])
    return store.pending("done", table(spark, d, "documents").select("doc_id"), "doc_id")


_KINDS = dict(T.MENTIONS)


@register(f"""WITH c AS ({_CORPUS_SQL}), m AS (SELECT native_id, 'email' AS kind, unnest(regexp_extract_all(body, '{_KINDS['email']}')) AS raw FROM c UNION ALL SELECT native_id, 'handle', unnest(regexp_extract_all(body, '{_KINDS['handle']}')) FROM c)
SELECT native_id, kind || '_mention' AS kind, raw, count(*) AS n FROM m WHERE NOT (kind = 'handle' AND regexp_matches(raw, '(?i)\\.({'|'.join(T.DOMAIN_ENDINGS)})$')) GROUP BY ALL UNION ALL SELECT native_id, 'author', author_raw, 1 FROM c""")
def er_records(spark, d):
    docs = materialize(_corpus(spark, d))
    found = O.mentions(O.chunks(docs))
    rows = R.identity_records(docs, found).join(docs.select("doc_id", "native_id"), "doc_id")
    return rows.groupBy("native_id", "kind", "raw").agg(F.count("*").alias("n"))


# ---- entity resolution in full: nine keys, a roster, dates ---------------------------------------------------------

_GIVEN, _SURNAMES = ("robert", "bob", "elizabeth", "liz", "james", "jim", "maria", "chen"), ("patel", "ortiz", "smith", "ashcraft", "tymczak", "lee")
_STAFF = [(f"{g} {s}".title(), f"{g}.{s}@example.com", f"team {k % 3}") for k, g in enumerate(_GIVEN) for j, s in enumerate(_SURNAMES) if (k + j) % 2]
#: Sound codes of the surnames by the standard rule (fixed values).
_SOUNDS = [("patel", "P340"), ("ortiz", "O632"), ("smith", "S530"), ("ashcraft", "A261"), ("tymczak", "T522"), ("lee", "L000")]
_FULL = f"""{P._FEATS}, staff(name, mail, team) AS (VALUES {', '.join(str(x) for x in _STAFF)}), sounds(sn, code) AS (VALUES {', '.join(str(x) for x in _SOUNDS)}),
ff AS (SELECT f.*, s.team AS mail_team, s.name AS mail_name, t.name AS full_name, t.team AS full_team, code, CASE WHEN rid % 7 = 0 THEN NULL ELSE make_timestamp(2000 + rid % 20, 1, 1, 0, 0, 0) END AS at FROM feats f LEFT JOIN staff s ON f.email = s.mail LEFT JOIN staff t ON lower(t.name) = trim(given || ' ' || surname) LEFT JOIN sounds ON surname = sn),
bk AS (SELECT rid, 'email' AS key_name, email AS key FROM ff WHERE email IS NOT NULL UNION ALL SELECT rid, 'email_local', split_part(email, '@', 1) FROM ff WHERE email IS NOT NULL UNION ALL SELECT rid, 'handle', handle FROM ff WHERE handle IS NOT NULL
  UNION ALL SELECT rid, 'surname', surname FROM ff WHERE surname <> '' UNION ALL SELECT rid, 'soundex', code FROM ff WHERE code IS NOT NULL UNION ALL SELECT rid, 'nickname', nickname_given FROM ff UNION ALL SELECT rid, 'given_team', nickname_given || '::' || mail_team FROM ff WHERE mail_team IS NOT NULL
  UNION ALL SELECT rid, 'doc', doc_id FROM ff UNION ALL SELECT rid, 'thread', source_system || '::' || thread_key FROM ff WHERE thread_key IS NOT NULL),
bz AS (SELECT key_name, key FROM bk GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 250), bj AS (SELECT b.* FROM bk b JOIN bz s ON b.key_name = s.key_name AND b.key = s.key),
fp AS (SELECT a.rid AS i, b.rid AS j, list_sort(list(DISTINCT a.key_name)) AS keys FROM bj a JOIN bj b ON a.key_name = b.key_name AND a.key = b.key AND a.rid < b.rid GROUP BY 1, 2)"""


def _full(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    rid = F.col("rid")
    dated = views.identities(spark, d).withColumn("asserted_at", F.when(rid % 7 != 0, F.make_timestamp((rid % 20 + 2000).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
    roster = spark.createDataFrame(_STAFF, "name string, email string, department string")
    feats = materialize(R.features(dated, roster))
    return feats, roster, R.candidate_pairs(R.blocking_keys(feats))


@register(f"WITH {_FULL} SELECT i, j, array_to_string(keys, ',') AS keys FROM fp")
def er_full_pairs(spark, d):
    return _full(spark, d)[2].select("i", "j", T.scalarize(F.col("keys")).alias("keys"))


_FULL_PARTS = P._SCORES[P._SCORES.index(", met AS"):].replace("FROM feats f LEFT", "FROM ff f LEFT").replace("FROM pairs p JOIN", "FROM fp p JOIN").replace("AS hard_negative\n", """AS hard_negative,
  CASE WHEN coalesce(a.mail_team, a.full_team) = coalesce(b.mail_team, b.full_team) THEN 1.0 ELSE 0.0 END AS team_overlap,
  CASE WHEN a.at IS NULL OR b.at IS NULL THEN 0.7 WHEN abs(floor((epoch_us(a.at) - epoch_us(b.at)) / 86400000000)) <= 1825 THEN 1.0 ELSE 0.3 END AS temporal,
  CASE WHEN coalesce(a.mail_name, a.full_name) IS NULL OR coalesce(b.mail_name, b.full_name) IS NULL THEN 0.5 WHEN coalesce(a.mail_name, a.full_name) = coalesce(b.mail_name, b.full_name) THEN 1.0 ELSE 0.0 END AS role
""").replace("0.05 * 0.7 + 0.05 * 0.5", "0.10 * team_overlap + 0.05 * temporal + 0.05 * role")


@register(f"WITH {_FULL}{_FULL_PARTS} SELECT i, j, team_overlap, temporal AS temporal_plausibility, role AS role_consistency, hard_negative, round(score, 6) AS score FROM scored")
def er_full_scores(spark, d):
    feats, roster, pairs = _full(spark, d)
    s = R.score(pairs, feats, R.neighbours(feats), roster)
    return s.select("i", "j", "team_overlap", "temporal_plausibility", "role_consistency", "hard_negative", F.round("score", 6).alias("score"))


# ---- claim extraction ---------------------------------------------------------------------------------------------

_SAID = f"""claims_v AS ({views.CLAIMS_SQL}), said AS (SELECT seq, subject_id, predicate, coalesce(object_literal, object_id) AS object, asserted_at FROM claims_v WHERE coalesce(object_literal, object_id) IS NOT NULL)"""
_LITERAL = "predicate IN (" + ", ".join(f"'{n}'" for n, _, x in P.RELATIONS if x) + ")"
_KNOWN = "predicate IN (" + ", ".join(f"'{n}'" for n, _, _ in P.RELATIONS) + ")"


def _extracted(spark, d) -> tuple[DataFrame, DataFrame]:
    """Claims found in texts that say what the claims view holds: one document a claim."""
    c = views.claims(spark, d).withColumn("object", F.coalesce("object_literal", "object_id")).where("object IS NOT NULL")
    line = F.concat_ws(" ", "subject_id", "predicate", "object")
    docs = c.select(F.col("seq").alias("doc_id"), F.concat(F.lit("minutes\n"), line, F.lit("\nend")).alias("body"), F.col("asserted_at").alias("created_at"), "source_system")
    relations = spark.createDataFrame([(n, x) for n, _, x in P.RELATIONS], "name string, literal boolean")
    return C.extract(docs, C.rule_extractor([n for n, _, _ in P.RELATIONS] + ["LINKED_TO"]), relations)


@register(f"WITH {_SAID} SELECT seq AS doc_id, predicate, subject_id, CASE WHEN NOT {_LITERAL} THEN object END AS object_id, CASE WHEN {_LITERAL} THEN object END AS object_literal, 'affirm' AS polarity, 0.5 AS extraction_confidence, 8 AS span_start, 8 + length(subject_id || ' ' || predicate || ' ' || object) AS span_end FROM said WHERE {_KNOWN}")
def claims_extract(spark, d):
    return _extracted(spark, d)[0].select("doc_id", "predicate", "subject_id", "object_id", "object_literal", "polarity", "extraction_confidence", "span_start", "span_end")


@register(f"WITH {_SAID} SELECT seq AS doc_id, predicate, subject_id, 'unknown predicate: ' || predicate AS reason FROM said WHERE NOT {_KNOWN}")
def claims_unmapped(spark, d):
    return _extracted(spark, d)[1]


@register(f"WITH {_SAID} SELECT 'ASSERTS' AS type, count(*) AS n FROM said WHERE {_KNOWN} UNION ALL SELECT 'EVIDENCED_BY', count(*) FROM said WHERE {_KNOWN} UNION ALL SELECT 'ABOUT', count(*) FROM said WHERE {_KNOWN} AND NOT {_LITERAL}")
def claims_edges(spark, d):
    found = _extracted(spark, d)[0].withColumn("evidence_chunk_id", ids.node_id("chunk", F.col("doc_id"), F.lit(0)))
    return C.edges(found).distinct().groupBy("type").agg(F.count("*").alias("n"))


# ---- questions with aliases ---------------------------------------------------------------------------------------

_ALIASES = f"""{P._QUESTIONS}, al AS (SELECT DISTINCT subject_id AS alias, 'person ' || CAST(CAST(substr(subject_id, 6) AS INT) % 10 AS VARCHAR) AS canonical_id FROM claims_v UNION SELECT 'user 9999', 'person 9'),
aa AS (SELECT anc.*, al.canonical_id FROM anc LEFT JOIN al ON e = alias),
named AS (SELECT canonical_id, list_slice(list_sort(list(DISTINCT alias)), 1, 30) AS names FROM al GROUP BY 1),
mk AS (SELECT question_id, pos, unnest(list_slice(list_sort(list_distinct(list_concat(list_filter([e, split_part(e, ' ', 1), canonical_id], lambda x: x IS NOT NULL), coalesce(names, [])))), 1, 30)) AS key FROM aa LEFT JOIN named USING (canonical_id))"""


def _aliased(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    claims, questions = views.claims(spark, d), views.questions(spark)
    people = claims.select(F.col("subject_id").alias("alias")).distinct().unionAll(spark.createDataFrame([("user 9999",)], "alias string")).distinct()
    aliases = materialize(people.select("alias", F.concat(F.lit("person "), (F.substring("alias", 6, 10).cast("int") % 10).cast("string")).alias("canonical_id")))
    return questions, Q.anchors(questions, claims, aliases), claims, aliases


@register(f"WITH {_ALIASES} SELECT question_id, pos, e AS literal, canonical_id, known, known OR canonical_id IS NOT NULL AS resolved FROM aa")
def q_anchors_alias(spark, d):
    return _aliased(spark, d)[1].select("question_id", "pos", "literal", "canonical_id", "known", "resolved")


@register(f"WITH {_ALIASES} SELECT question_id, pos, key FROM mk")
def q_match_keys(spark, d):
    _, found, _, aliases = _aliased(spark, d)
    return Q.match_keys(found, aliases)


@register(f"WITH {_ALIASES}, hit AS (SELECT DISTINCT k.question_id, c.claim_id, c.asserted_at FROM mk k JOIN qv q ON k.question_id = q.question_id JOIN claims_v c ON (c.subject_id = key OR c.object_id = key) AND (q.predicate_hint IS NULL OR c.predicate = q.predicate_hint) WHERE q.plan_class = 'TEMPORAL') SELECT question_id, claim_id, row_number() OVER (PARTITION BY question_id ORDER BY asserted_at NULLS FIRST, claim_id) AS position FROM hit")
def q_temporal_alias(spark, d):
    questions, found, claims, aliases = _aliased(spark, d)
    return Q.temporal(questions, Q.match_keys(found, aliases), claims).select("question_id", "claim_id", "position")


@register(f"WITH {_ALIASES} SELECT question_id, pos, list_slice(list_sort(list(DISTINCT alias)), 1, 5) AS aliases FROM aa JOIN al ON aa.canonical_id = al.canonical_id AND alias <> e GROUP BY 1, 2")
def q_other_aliases(spark, d):
    _, found, _, aliases = _aliased(spark, d)
    return Q.other_aliases(found, aliases)


@register(f"""WITH {P._GATE}, nm AS (SELECT list_slice(list_sort(list(DISTINCT subject_id)), 1, 3) AS names FROM claims_v WHERE starts_with(subject_id, 'use')), lost AS (SELECT DISTINCT question_id FROM anc WHERE NOT known)
SELECT g.question_id, reason IS NOT NULL AS abstained, CASE WHEN reason IS NULL THEN CAST(claim_count AS VARCHAR) || ' claim(s) via ' || plan_class ELSE reason || CASE WHEN l.question_id IS NOT NULL THEN ' (nearest known names: ' || array_to_string(names, ', ') || ')' ELSE '' END END AS path_summary
FROM gated g LEFT JOIN lost l ON g.question_id = l.question_id, nm""")
def q_contract(spark, d):
    """The nested answer, read back field by field."""
    gated, hits = P._gated(spark, d)
    found = P._asked(spark, d)[1]
    known = views.claims(spark, d).select(F.col("subject_id").alias("name"))
    flat = Q.answers(gated, Q.answer_text(hits), Q.citations(hits, P._chunk_table(spark, d)), Q.near_misses(found, known))
    shape = "question_id string, abstained boolean, traversal struct<path_summary: string>"
    return Q.contract(flat).select(F.from_json("json", shape).alias("r")).select("r.question_id", "r.abstained", "r.traversal.path_summary")


@register(f"WITH {P._GATE}, ct AS (SELECT question_id, min(claim_id) AS claim_id FROM hit GROUP BY 1 HAVING count(*) > 1) SELECT h.question_id, h.claim_id, d.doc_id FROM hit h JOIN documents d ON h.evidence_chunk_id = 'chunk:' || CAST(d.doc_id AS VARCHAR) LEFT JOIN ct ON h.question_id = ct.question_id WHERE ct.claim_id IS NULL OR ct.claim_id = h.claim_id")
def q_cited(spark, d):
    """Where an answer cites claims of its own, only those are shown."""
    hits = P._gated(spark, d)[1]
    cited = hits.groupBy("question_id").agg(F.min("claim_id").alias("claim_id"), F.count_distinct("claim_id").alias("n")).where("n > 1")
    return Q.citations(hits, P._chunk_table(spark, d), cited).select("question_id", "claim_id", "doc_id").distinct()


# ---- persons and invariants of whole components, which SQL can follow too ------------------------------------------

_WHOLE = f"""{P._SCORES}, link AS (SELECT i AS a, j AS b FROM scored WHERE score >= 0.62 AND NOT hard_negative UNION ALL SELECT j, i FROM scored WHERE score >= 0.62 AND NOT hard_negative),
reach(a, b) AS (SELECT rid, rid FROM feats UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a), cl AS (SELECT a AS rid, min(b) AS cluster_id FROM reach GROUP BY 1), fc AS (SELECT f.*, cluster_id, trim(raw) AS w FROM feats f JOIN cl ON f.rid = cl.rid)"""


def _whole(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    from loomgraph.operators.components import connected_components

    feats, scored = P._scored(spark, d)
    scored = materialize(scored)
    found = connected_components(scored.where((F.col("score") >= R.LINK) & ~F.col("hard_negative")), "i", "j").withColumnRenamed("id", "rid")
    return feats, scored, materialize(feats.select("rid").join(found, "rid", "left").select("rid", F.coalesce("component_id", "rid").alias("cluster_id")))


def _mode_sql(value: str, name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT cluster_id, min_by(v, (-n, v)) AS {name} FROM (SELECT cluster_id, {value} AS v, count(*) AS n FROM fc WHERE {value} IS NOT NULL AND {where} GROUP BY 1, 2) GROUP BY 1)"


@register(f"""WITH RECURSIVE {_WHOLE}, {_mode_sql('w', 'pure', 'email IS NULL AND handle IS NULL')}, {_mode_sql('w', 'anyraw')}, {_mode_sql('email', 'mail')}
SELECT 'Person:' || substr(md5(CAST(f.cluster_id AS VARCHAR)), 1, 24) AS canonical_id, f.cluster_id, coalesce(any_value(pure), any_value(anyraw)) AS name, any_value(mail) AS primary_email, count(DISTINCT lower(w)) AS alias_count, list_sort(list(DISTINCT source_system)) AS source_systems, count(*) AS cluster_size
FROM fc f LEFT JOIN pure ON f.cluster_id = pure.cluster_id LEFT JOIN anyraw ON f.cluster_id = anyraw.cluster_id LEFT JOIN mail ON f.cluster_id = mail.cluster_id GROUP BY f.cluster_id""")
def er_component_persons(spark, d):
    feats, _, found = _whole(spark, d)
    return R.canonicalize(feats, found)[0]


@register(f"""WITH RECURSIVE {_WHOLE} SELECT (SELECT count(*) FROM scored s JOIN cl a ON s.i = a.rid JOIN cl b ON s.j = b.rid WHERE hard_negative AND a.cluster_id = b.cluster_id) AS cosentence_pairs,
 (SELECT count(*) FROM (SELECT cluster_id FROM fc GROUP BY 1 HAVING count(DISTINCT email) > 1)) AS email_conflicts""")
def er_component_invariants(spark, d):
    feats, scored, found = _whole(spark, d)
    return R.invariants(scored, found, feats)


@register(f"WITH RECURSIVE {_WHOLE} SELECT alias, 'Person:' || substr(md5(CAST(c AS VARCHAR)), 1, 24) AS canonical_id FROM (SELECT lower(w) AS alias, max(cluster_id) AS c FROM fc GROUP BY 1)")
def er_alias_map(spark, d):
    feats, _, found = _whole(spark, d)
    return R.canonicalize(feats, found)[1]


@register(f"WITH RECURSIVE {_WHOLE} SELECT count(*) AS n_clusters, max(n) AS largest, count(*) FILTER (n = 1) AS singletons FROM (SELECT cluster_id, count(*) AS n FROM cl GROUP BY 1)")
def er_cluster_stats(spark, d):
    return R.cluster_stats(_whole(spark, d)[2])


@register(f"""WITH c AS ({_CORPUS_SQL}) SELECT 'documents' AS what, count(*) AS n FROM c UNION ALL SELECT 'chunks', sum((len(regexp_extract_all(body, '\\S+')) + 499) // 500) FROM c UNION ALL SELECT 'HAS_CHUNK', sum((len(regexp_extract_all(body, '\\S+')) + 499) // 500) FROM c
UNION ALL SELECT what, sum({' + '.join(f"len(regexp_extract_all(body, '{p}'))" for _, p in T.MENTIONS)}) FROM c, (VALUES ('mentions'), ('MENTIONS')) v(what) GROUP BY 1""")
def store_structure(spark, d):
    """Documents, chunks and mentions written twice, counted once."""
    from loomgraph.sources.sinks import Store, write_structure

    store, docs = Store(spark, _folder(spark, "store")), materialize(_corpus(spark, d))
    chunks = materialize(O.chunks(docs))
    found = materialize(O.mentions(chunks))
    for _ in range(2):
        write_structure(store, docs, chunks, found)
    out = store.read("structure").groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n"))
    for name in ("documents", "chunks", "mentions"):
        out = out.unionAll(store.read(name).agg(F.lit(name).alias("what"), F.count("*").alias("n")))
    return out


@register("SELECT * FROM (VALUES ('Engineer', 'Person', 'SUBCLASS_OF')) t(from_id, to_id, type) UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'relation', 'NAME')" for n, _, _ in P.RELATIONS) + ") r(from_id, to_id, type)")
def store_ontology(spark, d):
    from loomgraph.sources.sinks import Store, write_ontology

    store = Store(spark, _folder(spark, "tbox-store"))
    write_ontology(store, *_tbox(spark))
    return store.read("class_edges").select("from_id", "to_id", "type").unionAll(store.read("relations").select(F.col("name"), F.lit("relation"), F.lit("NAME")))


@register("""WITH t AS (SELECT source, least(n, CAST(round_even(n / sum(n) OVER () * 137, 0) AS BIGINT)) AS target FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)), h AS (SELECT source, count(*) AS had FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark) GROUP BY 1),
r AS (SELECT d.doc_id, d.source AS source_system, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS r, target - coalesce(had, 0) AS room FROM documents d JOIN t ON d.source = t.source LEFT JOIN h ON d.source = h.source WHERE doc_id NOT IN (SELECT item_id FROM benchmark)) SELECT doc_id, source_system FROM r WHERE r <= room""")
def ingest_targets(spark, d):
    from loomgraph.operators.sampling import stratified_targets
    from loomgraph.streaming.ingest import up_to_targets

    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_system"))
    done = docs.join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    return up_to_targets(docs, done, stratified_targets(docs, "source_system", 137))
