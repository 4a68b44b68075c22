"""Registered queries of the engine's own operators, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomgraph.functions import text as T
from loomgraph.operators import claims as C
from loomgraph.operators import conflict as K
from loomgraph.operators import dedupe as D
from loomgraph.operators import documents as O
from loomgraph.operators import er as R
from loomgraph.operators import evaluate as V
from loomgraph.operators import query as Q
from loomgraph.operators import retrieval, sampling
from loomgraph.operators.components import connected_components
from loomgraph.operators.providers import judged, plan_by_rules
from loomgraph.plans import views
from loomgraph.runtime import materialize, shared_dir, table

#: Ontology of the claims view: (relation, single-valued, literal).
RELATIONS = [("OWNS", True, False), ("STATUS", True, True), ("DEADLINE", True, True), ("WORKS_ON", False, False)]
FUNCTIONAL = [n for n, f, _ in RELATIONS if f]

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# ---- documents ----------------------------------------------------------------------------------------------------


@register("SELECT doc_id, source AS source_system, lang, sha256(text) AS content_hash, length(text) AS n_chars FROM documents")
def doc_normalize(spark, d):
    return _docs(spark, d).select("doc_id", F.col("source").alias("source_system"), "lang", T.content_hash(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("n_chars"))


@register("SELECT sha256(text) AS content_hash, min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_exact_dups(spark, d):
    return D.exact_duplicates(_docs(spark, d))


@register(r"""SELECT doc_id, k AS ordinal, len(c) AS n_words, c[1] AS first_word, c[len(c)] AS last_word FROM (SELECT doc_id, k, w[k * 500 + 1:k * 500 + 500] AS c FROM
(SELECT doc_id, w, unnest(range(0, (len(w) + 499) // 500)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)))""")
def doc_chunks(spark, d):
    cut = O.chunks(_docs(spark, d), "text")
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    return cut.select("doc_id", "ordinal", words.alias("w")).select("doc_id", "ordinal", F.size("w").alias("n_words"), F.element_at("w", 1).alias("first_word"), F.element_at("w", -1).alias("last_word"))


_MENTION_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS mention_type, unnest(regexp_extract_all(text, '{p}')) AS surface FROM texts" for k, p in T.MENTIONS)
_TEXTS = """SELECT 'd' || CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR), text FROM conversations UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages"""


@register(f"WITH texts AS ({_TEXTS}) SELECT doc_id, mention_type, surface, count(*) AS n FROM ({_MENTION_SQL}) GROUP BY ALL")
def doc_mentions(spark, d):
    key = lambda p, *c: F.concat(F.lit(p), F.concat_ws(".", *[F.col(x).cast("string") for x in c])).alias("doc_id")
    texts = _docs(spark, d).select(key("d", "doc_id"), "text").unionAll(table(spark, d, "conversations").select(key("c", "conv_id", "turn"), "text")).unionAll(table(spark, d, "pages").select(key("p", "page_id"), F.col("html").cast("string")))
    found = O.mentions(O.chunks(texts, "text"))
    return found.groupBy("doc_id", "mention_type", "surface").agg(F.count("*").alias("n"))


_SHINGLES = """SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)"""


@register(f"SELECT doc_id, len(s) AS n_shingles FROM ({_SHINGLES})")
def doc_shingles(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.shingles(F.col("text"))).alias("n_shingles"))


@register(f"""WITH s AS ({_SHINGLES}), r AS (SELECT min(doc_id) AS doc_id, any_value(list_sort(s)) AS s FROM s WHERE len(s) > 0 GROUP BY md5(array_to_string(list_sort(s), chr(10)))),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM r), c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_a, doc_b, round(k / (n + m - k), 4) AS similarity FROM c WHERE k / (n + m - k) >= 0.8""")
def doc_near_dups(spark, d):
    return D.near_duplicates(_docs(spark, d))


@register(f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) AS representative FROM ({_SHINGLES}) WHERE len(s) > 0""")
def doc_near_dup_classes(spark, d):
    """Whom each id in doc_near_dups and doc_lsh_candidates stands for."""
    return D.shingle_classes(_docs(spark, d))


@register()
def doc_lsh_candidates(spark, d):
    return D.lsh_candidates(_docs(spark, d))


@register()
def doc_simhash63(spark, d):
    return _docs(spark, d).select("doc_id", D.simhash63("text").alias("simhash"))


@register("SELECT source, n, least(n, CAST(round_even(n / sum(n) OVER () * 137, 0) AS BIGINT)) AS target FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def stratified_targets(spark, d):
    return sampling.stratified_targets(_docs(spark, d), "source", 137)


@register("""WITH t AS (SELECT source, greatest(1, least(n, CAST(round_even(n / sum(n) OVER () * 137, 0) AS BIGINT))) AS want FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1))
SELECT doc_id, source FROM (SELECT doc_id, d.source, want, row_number() OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS r FROM documents d JOIN t ON d.source = t.source) WHERE r <= want""")
def stratified_sample(spark, d):
    return sampling.stratified_sample(_docs(spark, d).select("doc_id", "source"), "source", "doc_id", 137)


@register("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 30")
def simple_sample(spark, d):
    return sampling.simple_sample(_docs(spark, d).select("doc_id"), "doc_id", 30)


# ---- claims and conflicts -----------------------------------------------------------------------------------------

_CLAIMS = f"claims_v AS ({views.CLAIMS_SQL})"
_KEYED = f"""{_CLAIMS}, keyed AS (SELECT *, subject_id AS subject, CASE WHEN object_literal IS NOT NULL THEN 'literal:' || lower(trim(object_literal)) WHEN object_id IS NOT NULL THEN 'entity:' || lower(trim(object_id)) ELSE 'unknown' END AS object_key
FROM claims_v WHERE predicate IN ('OWNS', 'STATUS', 'DEADLINE') AND polarity <> 'negate'),
cand AS (SELECT subject, predicate, count(*) AS n_claims, count(DISTINCT object_key) AS n_values, list_sort(list(DISTINCT object_key)) AS vals FROM keyed GROUP BY 1, 2 HAVING count(DISTINCT object_key) > 1),
conf AS (SELECT k.* FROM keyed k JOIN cand c ON k.subject = c.subject AND k.predicate = c.predicate)"""
_OLD = f"""{_KEYED}, newest AS (SELECT subject, predicate, max(struct_pack(t := asserted_at, s := seq, o := object_key)) AS nw FROM conf WHERE asserted_at IS NOT NULL GROUP BY 1, 2),
marked AS (SELECT c.*, coalesce(c.asserted_at IS NOT NULL AND c.object_key <> n.nw.o AND floor((epoch_us(n.nw.t) - epoch_us(c.asserted_at)) / 86400000000) > 14, false) AS superseded FROM conf c LEFT JOIN newest n ON c.subject = n.subject AND c.predicate = n.predicate),
rest AS (SELECT subject, predicate, count(DISTINCT CASE WHEN NOT superseded THEN object_key END) AS k FROM marked GROUP BY 1, 2),
sup AS (SELECT m.*, r.k <= 1 AS group_superseded FROM marked m JOIN rest r ON m.subject = r.subject AND m.predicate = r.predicate)"""
_GRAN = f"""{_OLD}, gvals AS (SELECT subject, predicate, list_sort(list(DISTINCT regexp_replace(object_key, '^(literal|entity):', ''))) AS vals FROM sup WHERE NOT superseded GROUP BY 1, 2),
gran AS (SELECT g.subject, g.predicate, any_value(g.vals) AS vals, bool_and(contains(a, b) OR contains(b, a)) AS compatible
  FROM gvals g, unnest(g.vals) AS x(a), unnest(g.vals) AS y(b) GROUP BY 1, 2)"""
_KIND = f"""{_GRAN}, kinds AS (SELECT s.subject, s.predicate, CASE WHEN bool_or(s.group_superseded) THEN 'SUPERSEDES' WHEN any_value(g.compatible) THEN 'GRANULARITY'
  WHEN count(DISTINCT CASE WHEN NOT s.superseded THEN s.object_key END) < 2 THEN 'DUPLICATE' ELSE 'CONTRADICTION' END AS classification
  FROM sup s LEFT JOIN gran g ON s.subject = g.subject AND s.predicate = g.predicate GROUP BY 1, 2)"""
_AUTH = ", ".join(f"('{k}', {v})" for k, v in K.AUTHORITY.items())
_TRUST = f"""{_KIND}, contra AS (SELECT s.* FROM sup s JOIN kinds k ON s.subject = k.subject AND s.predicate = k.predicate WHERE NOT s.superseded AND k.classification = 'CONTRADICTION'),
vals AS (SELECT subject, predicate, object_key, count(*) AS claim_count, count(DISTINCT source_system) AS n_sources,
  max(struct_pack(d := asserted_at IS NOT NULL, t := coalesce(asserted_at, TIMESTAMP '1900-01-01'), s := -seq, src := source_system, c := extraction_confidence, at := asserted_at)) AS nw, max(asserted_at) AS mx FROM contra GROUP BY 1, 2, 3),
refd AS (SELECT v.*, coalesce(a.w, 0.5) AS authority, coalesce(floor((epoch_us(max(mx) OVER (PARTITION BY subject, predicate)) - epoch_us(nw.at)) / 86400000000), 180) AS age FROM vals v LEFT JOIN (VALUES {_AUTH}) a(src, w) ON v.nw.src = a.src),
trusted AS (SELECT *, greatest(0, least(1, 0.30 * authority + 0.25 * pow(0.5, greatest(age, 0) / 90) + 0.25 * least(1.0, 0.5 + 0.25 * (n_sources - 1))
  + 0.10 * CASE WHEN object_key LIKE 'literal:%' THEN 1.0 ELSE 0.6 END + 0.05 * nw.c - 0.15 * (1 - pow(0.5, greatest(age, 0) / 365)))) AS trust FROM refd)"""
_SETS = f"""{_TRUST}, ranked AS (SELECT *, row_number() OVER w AS k, lead(trust) OVER w AS second FROM trusted WINDOW w AS (PARTITION BY subject, predicate ORDER BY trust DESC, object_key)),
sets AS (SELECT subject, predicate, CASE WHEN second IS NOT NULL AND trust - second < 0.12 THEN 'CONTESTED' WHEN trust < 0.40 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS resolution_status, object_key, round(trust - coalesce(second, 0), 4) AS margin, round(trust, 6) AS top_trust FROM ranked WHERE k = 1)"""


def _conflicting(spark, d) -> DataFrame:
    return materialize(K.in_conflict(K.functional_claims(views.claims(spark, d), FUNCTIONAL)))


def _relations(spark) -> DataFrame:
    return spark.createDataFrame([(n, x) for n, _, x in RELATIONS], "name string, literal boolean")


@register(f"WITH {_CLAIMS} SELECT claim_id, predicate, CASE WHEN predicate NOT IN ('OWNS', 'STATUS', 'DEADLINE', 'WORKS_ON') THEN 'unknown predicate: ' || predicate END AS reason FROM claims_v")
def tbox_gate(spark, d):
    return C.gate(views.claims(spark, d), _relations(spark)).select("claim_id", "predicate", "reason")


@register("""WITH c AS (SELECT doc_id, k AS ordinal, k * 1000 AS a, k * 1000 + 990 AS b FROM (SELECT doc_id, unnest(range(0, n_chars // 1000 + 1)) AS k FROM documents)), s AS (SELECT doc_id, (doc_id * 7919) % (n_chars + 200) AS span_start FROM documents)
SELECT s.doc_id, s.span_start, coalesce(min(c.ordinal), 0) AS evidence_ordinal FROM s LEFT JOIN c ON s.doc_id = c.doc_id AND c.a <= s.span_start AND s.span_start < c.b GROUP BY 1, 2""")
def evidence_chunk(spark, d):
    docs = _docs(spark, d)
    chunks = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 1000))).alias("ordinal"))
    chunks = chunks.select("doc_id", "ordinal", (F.col("ordinal") * 1000).alias("char_start"), (F.col("ordinal") * 1000 + 990).alias("char_end"))
    spans = docs.select("doc_id", (F.col("doc_id") * 7919 % (F.col("n_chars") + 200)).alias("span_start"))
    return C.evidence_chunk(spans, chunks)


@register(f"""WITH {_CLAIMS} SELECT coalesce(CASE WHEN subject_id IS NOT NULL THEN 'person ' || CAST(CAST(substr(subject_id, 6) AS INT) % 10 AS VARCHAR) END, subject_id) AS subject, count(*) AS n FROM claims_v GROUP BY 1""")
def alias_resolve(spark, d):
    claims = views.claims(spark, d)
    number = F.substring("subject_id", 6, 10).cast("int")
    aliases = claims.select(F.col("subject_id").alias("alias"), F.concat(F.lit("person "), (number % 10).cast("string")).alias("canonical_id")).distinct()
    return K.resolve_subject(claims, aliases).groupBy("subject").agg(F.count("*").alias("n"))


@register(f"WITH {_KEYED} SELECT subject, predicate, n_claims, n_values, vals AS \"values\" FROM cand")
def conflict_candidates(spark, d):
    return K.candidates(K.functional_claims(views.claims(spark, d), FUNCTIONAL))


@register(f"WITH {_OLD} SELECT claim_id, subject, predicate, superseded, group_superseded FROM sup")
def conflict_supersede(spark, d):
    return K.supersession(_conflicting(spark, d)).select("claim_id", "subject", "predicate", "superseded", "group_superseded")


@register(f"WITH {_GRAN} SELECT subject, predicate, vals AS \"values\", compatible FROM gran")
def conflict_granularity(spark, d):
    return K.granularity(K.supersession(_conflicting(spark, d)).where("NOT superseded"))


@register(f"WITH {_KIND} SELECT subject, predicate, classification FROM kinds")
def conflict_classify(spark, d):
    return K.classify(_conflicting(spark, d))


@register(f"WITH {_TRUST} SELECT subject, predicate, object_key, claim_count, n_sources, authority, round(trust, 6) AS trust FROM trusted")
def conflict_trust(spark, d):
    return K.trust(K.contradicting(_conflicting(spark, d))).select("subject", "predicate", "object_key", "claim_count", "n_sources", "authority", F.round("trust", 6).alias("trust"))


@register(f"WITH {_SETS} SELECT subject, predicate, resolution_status, CASE WHEN resolution_status = 'RESOLVED' THEN object_key END AS winner, margin, top_trust FROM sets")
def conflict_adjudicate(spark, d):
    return K.conflict_sets(_conflicting(spark, d))[0].select("subject", "predicate", "resolution_status", "winner", "margin", "top_trust")


@register(f"WITH {_KIND} SELECT classification, count(*) AS n_groups, count(*) FILTER (s > 1) AS n_cross_system FROM (SELECT k.classification, k.subject, k.predicate, count(DISTINCT c.source_system) AS s FROM kinds k JOIN conf c ON k.subject = c.subject AND k.predicate = c.predicate GROUP BY ALL) GROUP BY 1")
def conflict_report(spark, d):
    return K.report(_conflicting(spark, d))


@register(f"WITH {_KIND} SELECT s.subject, s.predicate, s.claim_id FROM sup s JOIN kinds k ON s.subject = k.subject AND s.predicate = k.predicate WHERE NOT s.superseded AND k.classification = 'CONTRADICTION'")
def conflict_members(spark, d):
    return K.contradicting(_conflicting(spark, d)).select("subject", "predicate", "claim_id")


def FLAGSHIP(spark, d):  # noqa: N802
    return conflict_adjudicate(spark, d)


# ---- entity resolution --------------------------------------------------------------------------------------------

_NICK = ", ".join(f"('{a}', '{b}')" for a, b in sorted(T.NICKNAME_OF.items()))
_FEATS = f"""idv AS ({views.IDENTITY_SQL}), nick(a, b) AS (VALUES {_NICK}),
f0 AS (SELECT *, CASE WHEN kind = 'email_mention' THEN lower(raw) END AS email, CASE WHEN kind = 'handle_mention' THEN lower(regexp_replace(raw, '^@+', '')) END AS handle FROM idv),
f1 AS (SELECT *, array_to_string(regexp_extract_all(lower(coalesce(translate(coalesce(split_part(email, '@', 1), handle), '.-_', '   '), raw)), '[a-z''\\-]+'), ' ') AS nm FROM f0),
f2 AS (SELECT *, split_part(nm, ' ', 1) AS given, CASE WHEN contains(nm, ' ') THEN string_split(nm, ' ')[-1] ELSE '' END AS surname FROM f1),
feats AS (SELECT f2.*, coalesce(nick.b, given) AS nickname_given, coalesce('e:' || email, 'h:' || handle, 'n:' || given || ' ' || surname) AS identity_key FROM f2 LEFT JOIN nick ON given = nick.a)"""
_BLOCKS = ("email", "email_local", "handle", "surname", "nickname", "doc", "thread")
_PAIRS = f"""{_FEATS}, bkeys AS (SELECT rid, 'email' AS key_name, email AS key FROM feats WHERE email IS NOT NULL UNION ALL SELECT rid, 'email_local', split_part(email, '@', 1) FROM feats WHERE email IS NOT NULL
  UNION ALL SELECT rid, 'handle', handle FROM feats WHERE handle IS NOT NULL UNION ALL SELECT rid, 'surname', surname FROM feats WHERE surname <> '' UNION ALL SELECT rid, 'nickname', nickname_given FROM feats
  UNION ALL SELECT rid, 'doc', doc_id FROM feats UNION ALL SELECT rid, 'thread', source_system || '::' || thread_key FROM feats WHERE thread_key IS NOT NULL),
sized AS (SELECT key_name, key FROM bkeys GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 250),
kept AS (SELECT b.* FROM bkeys b JOIN sized s ON b.key_name = s.key_name AND b.key = s.key),
pairs AS (SELECT a.rid AS i, b.rid AS j, list_sort(list(DISTINCT a.key_name)) AS keys FROM kept a JOIN kept b ON a.key_name = b.key_name AND a.key = b.key AND a.rid < b.rid GROUP BY 1, 2)"""
_SCORES = f"""{_PAIRS}, met AS (SELECT DISTINCT doc_id, identity_key FROM feats), usual AS (SELECT identity_key FROM met GROUP BY 1 HAVING count(*) <= 500),
met2 AS (SELECT m.* FROM met m JOIN usual u ON m.identity_key = u.identity_key),
nb AS (SELECT a.identity_key, list(DISTINCT b.identity_key) AS nbs FROM met2 a JOIN met2 b ON a.doc_id = b.doc_id AND a.identity_key <> b.identity_key GROUP BY 1),
side AS (SELECT f.*, coalesce(n.nbs, []) AS nbs, list_distinct(list_filter([given, surname], lambda x: x <> '')) AS tk FROM feats f LEFT JOIN nb n ON f.identity_key = n.identity_key),
sc AS (SELECT p.i, p.j, p.keys,
  CASE WHEN a.email = b.email THEN 1.0 ELSE 0.0 END AS email_exact,
  CASE WHEN a.handle = b.handle OR starts_with(b.email, a.handle || '@') OR starts_with(a.email, b.handle || '@') THEN 1.0 ELSE 0.0 END AS handle_match,
  CASE WHEN len(a.tk) + len(b.tk) > 0 THEN len(list_intersect(a.tk, b.tk)) / len(list_distinct(list_concat(a.tk, b.tk))) ELSE 0.0 END AS name_similarity,
  CASE WHEN a.nickname_given = b.nickname_given AND a.nickname_given <> '' AND a.surname = b.surname AND a.surname <> '' THEN 1.0 ELSE 0.0 END AS nickname_link,
  CASE WHEN len(a.nbs) + len(b.nbs) > 0 THEN len(list_intersect(a.nbs, b.nbs)) / len(list_distinct(list_concat(a.nbs, b.nbs))) ELSE 0.0 END AS cooccurrence_path,
  coalesce(a.doc_id = b.doc_id AND a.sentence_ord = b.sentence_ord AND lower(trim(a.raw)) <> lower(trim(b.raw)), false) AS hard_negative
  FROM pairs p JOIN side a ON p.i = a.rid JOIN side b ON p.j = b.rid),
scored AS (SELECT *, round(greatest(0, least(1, 0.45 * email_exact + 0.25 * handle_match + 0.15 * name_similarity + 0.15 * nickname_link + 0.20 * cooccurrence_path + 0.05 * 0.7 + 0.05 * 0.5 + CASE WHEN hard_negative THEN -0.40 ELSE 0 END)), 9) AS score FROM sc)"""


def _feats(spark, d) -> DataFrame:
    return R.features(views.identities(spark, d))


def _scored(spark, d) -> tuple[DataFrame, DataFrame]:
    feats = materialize(_feats(spark, d))
    pairs = R.candidate_pairs(R.blocking_keys(feats, names=_BLOCKS))
    return feats, R.score(pairs, feats, R.neighbours(feats))


@register(f"WITH {_FEATS} SELECT rid, kind, email, handle, given, surname, nickname_given, identity_key FROM feats")
def er_features(spark, d):
    return _feats(spark, d).select("rid", "kind", "email", "handle", "given", "surname", "nickname_given", "identity_key")


@register(f"WITH {_PAIRS} SELECT i, j, array_to_string(keys, ',') AS keys FROM pairs")
def er_block_pairs(spark, d):
    return R.candidate_pairs(R.blocking_keys(_feats(spark, d), names=_BLOCKS)).select("i", "j", T.scalarize(F.col("keys")).alias("keys"))


@register()
def er_soundex_pairs(spark, d):
    return R.candidate_pairs(R.blocking_keys(_feats(spark, d))).select("i", "j", T.scalarize(F.col("keys")).alias("keys"))


@register(f"WITH {_SCORES} SELECT i, j, email_exact, handle_match, round(name_similarity, 6) AS name_similarity, nickname_link, round(cooccurrence_path, 6) AS cooccurrence_path, hard_negative, round(score, 6) AS score FROM scored")
def er_scores(spark, d):
    s = _scored(spark, d)[1]
    return s.select("i", "j", "email_exact", "handle_match", F.round("name_similarity", 6).alias("name_similarity"), "nickname_link", F.round("cooccurrence_path", 6).alias("cooccurrence_path"), "hard_negative", F.round("score", 6).alias("score"))


@register(f"WITH {_SCORES} SELECT i, j, round(score, 6) AS score FROM scored WHERE score >= 0.45 AND score < 0.72 AND NOT hard_negative")
def er_uncertain(spark, d):
    return R.uncertain(_scored(spark, d)[1]).select("i", "j", F.round("score", 6).alias("score"))


@register(f"""WITH {_SCORES} SELECT i, j, round(CASE WHEN (i + j) % 3 = 0 THEN greatest(score, 0.72) WHEN (i + j) % 3 = 1 THEN least(score, 0.57) ELSE score END, 6) AS score FROM scored""")
def er_adjudicated(spark, d):
    s = _scored(spark, d)[1]
    verdicts = s.where((F.col("i") + F.col("j")) % 3 < 2).select("i", "j", ((F.col("i") + F.col("j")) % 3 == 0).alias("same_person"), F.lit(0.9).alias("confidence"))
    return R.adjudicate(s, verdicts).select("i", "j", F.round("score", 6).alias("score"))


@register(f"""WITH RECURSIVE {_SCORES}, link AS (SELECT i AS a, j AS b FROM scored WHERE score >= 0.62 AND NOT hard_negative UNION ALL SELECT j, i FROM scored WHERE score >= 0.62 AND NOT hard_negative),
reach(a, b) AS (SELECT a, a FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a) SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1""")
def er_components(spark, d):
    s = _scored(spark, d)[1].where((F.col("score") >= R.LINK) & ~F.col("hard_negative"))
    return connected_components(s, "i", "j")


@register()
def er_clusters(spark, d):
    feats, scored = _scored(spark, d)
    return R.cluster(feats, materialize(scored))


@register()
def er_persons(spark, d):
    feats, scored = _scored(spark, d)
    persons, _ = R.canonicalize(feats, materialize(R.cluster(feats, materialize(scored))))
    return persons


@register()
def er_invariants(spark, d):
    feats, scored = _scored(spark, d)
    scored = materialize(scored)
    return R.invariants(scored, materialize(R.cluster(feats, scored)), feats)


@register(f"WITH idv AS ({views.IDENTITY_SQL}) SELECT source_system, min(kind) AS kind FROM (SELECT source_system, kind, rank() OVER (PARTITION BY source_system ORDER BY count(*) DESC, kind) AS r FROM idv GROUP BY 1, 2) WHERE r = 1 GROUP BY 1")
def er_mode(spark, d):
    return R.mode(views.identities(spark, d), ["source_system"], "kind")


# ---- questions ----------------------------------------------------------------------------------------------------

_QUESTIONS = f"""{_CLAIMS}, qv AS ({views.QUESTIONS_SQL}), ent AS (SELECT question_id, plan_class, predicate_hint, k - 1 AS pos, lower(trim(entities[k])) AS e FROM (SELECT *, unnest(range(1, len(entities) + 1)) AS k FROM qv)),
terms AS (SELECT lower(trim(subject_id)) AS t FROM claims_v UNION SELECT lower(trim(object_id)) FROM claims_v WHERE object_id IS NOT NULL),
anc AS (SELECT ent.*, e IN (SELECT t FROM terms) AS known FROM ent)"""
_LOOKUP = f"""{_QUESTIONS}, lk AS (SELECT DISTINCT a.question_id, c.* FROM anc a JOIN claims_v c ON lower(trim(c.subject_id)) = a.e AND (a.predicate_hint IS NULL OR c.predicate = a.predicate_hint) WHERE a.known AND a.plan_class = 'LOOKUP')"""
_EITHER = f"""{_QUESTIONS}, ei AS (SELECT DISTINCT a.question_id, a.plan_class, a.predicate_hint, c.* FROM anc a JOIN claims_v c ON (lower(trim(c.subject_id)) = a.e OR lower(trim(c.object_id)) = a.e) AND (a.predicate_hint IS NULL OR c.predicate = a.predicate_hint))"""


def _asked(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    claims, questions = views.claims(spark, d), views.questions(spark)
    return questions, Q.anchors(questions, claims), claims


@register(f"WITH {_QUESTIONS} SELECT question_id, pos, e AS literal, known, known AS resolved FROM anc")
def q_anchors(spark, d):
    return _asked(spark, d)[1].select("question_id", "pos", "literal", "known", "resolved")


@register(f"WITH {_LOOKUP} SELECT question_id, claim_id, predicate FROM lk")
def q_lookup(spark, d):
    q, a, c = _asked(spark, d)
    return Q.lookup(q, a, c).select("question_id", "claim_id", "predicate")


@register(f"WITH {_EITHER} SELECT question_id, count(*) AS n_claims, count(DISTINCT subject_id) AS n_subjects FROM ei WHERE plan_class = 'AGGREGATE' AND predicate_hint IS NOT NULL GROUP BY 1")
def q_aggregate(spark, d):
    q, a, c = _asked(spark, d)
    return Q.aggregate(q, Q.match_keys(a), c).groupBy("question_id").agg(F.count("*").alias("n_claims"), F.count_distinct("subject_id").alias("n_subjects"))


@register(f"WITH {_EITHER} SELECT question_id, claim_id, row_number() OVER (PARTITION BY question_id ORDER BY asserted_at NULLS FIRST, claim_id) AS position FROM ei WHERE plan_class = 'TEMPORAL'")
def q_temporal(spark, d):
    q, a, c = _asked(spark, d)
    return Q.temporal(q, Q.match_keys(a), c).select("question_id", "claim_id", "position")


@register(f"WITH {_SETS}, qv AS ({views.QUESTIONS_SQL}) SELECT question_id, subject, predicate, resolution_status, margin FROM sets s JOIN (SELECT question_id, predicate_hint, unnest(entities) AS e FROM qv WHERE plan_class = 'CONFLICT') q ON s.subject = q.e AND (predicate_hint IS NULL OR predicate_hint = predicate)")
def q_conflict(spark, d):
    q, a, _ = _asked(spark, d)
    return Q.conflicts(q, Q.match_keys(a), K.conflict_sets(_conflicting(spark, d))[0]).select("question_id", "subject", "predicate", "resolution_status", "margin")


_WALK = f"""{_QUESTIONS}, mq AS (SELECT question_id, lower(trim(entities[1])) AS s, lower(trim(entities[2])) AS g, predicate_hint AS hint FROM qv WHERE plan_class = 'MULTIHOP'),
en AS (SELECT claim_id, predicate, lower(trim(subject_id)) AS a, lower(trim(object_id)) AS b FROM claims_v WHERE object_id IS NOT NULL UNION ALL SELECT claim_id, predicate, lower(trim(object_id)), lower(trim(subject_id)) FROM claims_v WHERE object_id IS NOT NULL),
w1 AS (SELECT question_id, claim_id, b AS k FROM mq JOIN en ON a = s WHERE hint IS NULL OR predicate = hint), f1 AS (SELECT question_id, k FROM w1 EXCEPT SELECT question_id, s FROM mq),
w2 AS (SELECT f.question_id, claim_id, b AS k FROM f1 f JOIN en ON a = f.k), f2 AS (SELECT question_id, k FROM w2 EXCEPT (SELECT question_id, s FROM mq UNION SELECT question_id, k FROM f1)),
w3 AS (SELECT f.question_id, claim_id, b AS k FROM f2 f JOIN en ON a = f.k), f3 AS (SELECT question_id, k FROM w3 EXCEPT (SELECT question_id, s FROM mq UNION SELECT question_id, k FROM f1 UNION SELECT question_id, k FROM f2)),
mt AS (SELECT f.question_id, min(h) AS hops FROM (SELECT *, 1 AS h FROM f1 UNION ALL SELECT *, 2 FROM f2 UNION ALL SELECT *, 3 FROM f3) f JOIN mq ON f.question_id = mq.question_id AND f.k = mq.g GROUP BY 1),
mh AS (SELECT DISTINCT w.question_id, hops, claim_id FROM (SELECT *, 1 AS h FROM w1 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 3 FROM w3) w JOIN mt ON w.question_id = mt.question_id AND h <= hops)"""


@register(f"WITH {_WALK} SELECT question_id, hops, claim_id FROM mh")
def q_multihop_claims(spark, d):
    q, a, c = _asked(spark, d)
    return Q.multihop_claims(q, Q.match_keys(a), c).select("question_id", "hops", "claim_id")


_HOPS = f"""ev AS ({views.EDGES_SQL}), st AS (SELECT 'customer ' || CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE c_custkey % 100 = 0),
bi AS (SELECT src, dst FROM ev UNION SELECT dst, src FROM ev),
h1 AS (SELECT DISTINCT k, dst FROM st JOIN bi ON k = src), h2 AS (SELECT DISTINCT k, b.dst FROM h1 JOIN bi b ON h1.dst = b.src), h3 AS (SELECT DISTINCT k, b.dst FROM h2 JOIN bi b ON h2.dst = b.src),
goal AS (SELECT lower(n_name) AS g FROM nation), m AS (SELECT k, 1 AS hop, dst FROM h1 UNION ALL SELECT k, 2, dst FROM h2 UNION ALL SELECT k, 3, dst FROM h3)"""


@register(f"WITH {_HOPS}, f AS (SELECT k, dst, min(hop) AS hop FROM m JOIN goal ON dst = g GROUP BY 1, 2), t AS (SELECT k, min(hop) AS hop FROM f GROUP BY 1) SELECT t.k AS question_id, t.hop, list_sort(list(f.dst)) AS reached FROM t JOIN f ON t.k = f.k AND t.hop = f.hop GROUP BY 1, 2")
def q_multihop(spark, d):
    starts = table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("key"))
    starts = starts.select(F.col("key").alias("question_id"), "key")
    goals = [F.lower(F.lit(r.n_name)) for r in table(spark, d, "nation").select("n_name").collect()]  # 25 nations, the goals of every question
    targets = starts.select("question_id", F.explode(F.array(*goals)).alias("key"))
    return Q.multihop(starts, targets, views.edges(spark, d))


@register("""WITH e AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS src, 'r' || CAST(n_regionkey AS VARCHAR) AS dst FROM nation UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier)
SELECT a.src, b.dst, 2 AS hops, [a.src, a.dst, b.dst] AS path FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 's%'""")
def q_paths(spark, d):
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, t = table(spark, d, "supplier"), table(spark, d, "nation")
    edges = t.select(n("n", "n_nationkey").alias("src"), n("r", "n_regionkey").alias("dst")).unionAll(s.select(n("s", "s_suppkey").alias("src"), n("n", "s_nationkey").alias("dst")))
    goals = table(spark, d, "region").select(n("r", "r_regionkey").alias("key"))
    return Q.paths(s.select(n("s", "s_suppkey").alias("key")), goals, edges, 2)


def _gated(spark, d) -> tuple[DataFrame, DataFrame]:
    q, a, c = _asked(spark, d)
    keys = Q.match_keys(a)
    hits = Q.lookup(q, a, c).unionByName(Q.aggregate(q, keys, c)).unionByName(Q.temporal(q, keys, c).drop("position")).unionByName(Q.multihop_claims(q, keys, c).drop("hops"))
    hits = materialize(hits)
    sets = materialize(Q.conflicts(q, keys, K.conflict_sets(_conflicting(spark, d))[0]).groupBy("question_id").agg(F.count("*").alias("n")))
    return materialize(Q.gate(q, a, hits, sets)), hits


_GATE = f"""{_SETS}, {_WALK.replace(_CLAIMS + ", ", "", 1).replace("ent AS", "ent0 AS").replace("FROM ent)", "FROM ent0)").replace("SELECT ent.*", "SELECT ent0.*").replace("anc AS", "anc0 AS")}, ent AS (SELECT question_id, plan_class, predicate_hint, unnest(entities) AS e FROM qv), subj AS (SELECT DISTINCT subject_id AS t FROM claims_v UNION SELECT object_id FROM claims_v WHERE object_id IS NOT NULL),
anc AS (SELECT *, e IN (SELECT t FROM subj) AS known FROM ent), hit AS (SELECT DISTINCT a.question_id, c.claim_id, c.extraction_confidence, c.evidence_chunk_id, c.subject_id, c.predicate, c.object_id, c.object_literal FROM anc a JOIN claims_v c ON (a.predicate_hint IS NULL OR c.predicate = a.predicate_hint)
  AND ((a.plan_class = 'LOOKUP' AND a.known AND c.subject_id = a.e) OR (a.plan_class = 'TEMPORAL' AND (c.subject_id = a.e OR c.object_id = a.e)) OR (a.plan_class = 'AGGREGATE' AND a.predicate_hint IS NOT NULL AND (c.subject_id = a.e OR c.object_id = a.e)))
  UNION SELECT mh.question_id, c.claim_id, c.extraction_confidence, c.evidence_chunk_id, c.subject_id, c.predicate, c.object_id, c.object_literal FROM mh JOIN claims_v c ON mh.claim_id = c.claim_id),
cs AS (SELECT question_id, count(*) AS n FROM anc JOIN sets s ON s.subject = anc.e AND (predicate_hint IS NULL OR predicate_hint = s.predicate) WHERE plan_class = 'CONFLICT' GROUP BY 1),
hs AS (SELECT question_id, count(*) AS claim_count, max(extraction_confidence) AS max_trust, count(DISTINCT evidence_chunk_id) AS evidence_sources FROM hit GROUP BY 1),
g0 AS (SELECT q.question_id, q.plan_class, (SELECT bool_or(NOT known) FROM anc WHERE anc.question_id = q.question_id) AS unresolved, coalesce(claim_count, 0) AS claim_count, coalesce(max_trust, 0) AS max_trust, coalesce(evidence_sources, 0) AS evidence_sources, coalesce(n, 0) AS conflict_count
  FROM qv q LEFT JOIN hs ON q.question_id = hs.question_id LEFT JOIN cs ON q.question_id = cs.question_id),
gated AS (SELECT *, CASE WHEN plan_class = 'CONFLICT' THEN conflict_count ELSE claim_count END AS path_count, CASE WHEN plan_class = 'CONFLICT' AND conflict_count > 0 THEN NULL WHEN unresolved AND claim_count = 0 THEN 'entity not found under any known alias'
  WHEN (CASE WHEN plan_class = 'CONFLICT' THEN conflict_count ELSE claim_count END) = 0 AND claim_count = 0 THEN 'entities exist but no relationship found within bound' WHEN max_trust < 0.35 AND evidence_sources < 2 THEN 'only weak, uncorroborated evidence' END AS reason FROM g0)"""


@register(f"WITH {_GATE} SELECT question_id, plan_class, claim_count, path_count, evidence_sources, round(max_trust, 6) AS max_trust, reason, reason IS NOT NULL AS abstained FROM gated")
def q_gate(spark, d):
    return _gated(spark, d)[0].select("question_id", "plan_class", "claim_count", "path_count", "evidence_sources", F.round("max_trust", 6).alias("max_trust"), "reason", "abstained")


def _chunk_table(spark, d) -> DataFrame:
    return _docs(spark, d).select(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", F.col("source").alias("source_system"), F.lit(0).alias("char_start"), F.col("n_chars").alias("char_end"))


@register(f"WITH {_GATE} SELECT h.question_id, h.claim_id, h.evidence_chunk_id AS chunk_id, d.doc_id, d.n_chars AS char_end FROM hit h JOIN documents d ON h.evidence_chunk_id = 'chunk:' || CAST(d.doc_id AS VARCHAR)")
def q_citations(spark, d):
    return Q.citations(_gated(spark, d)[1], _chunk_table(spark, d)).select("question_id", "claim_id", "chunk_id", "doc_id", "char_end")


@register(f"""WITH {_GATE}, cit AS (SELECT h.question_id, count(*) AS n, count(DISTINCT d.doc_id) AS m FROM hit h JOIN documents d ON h.evidence_chunk_id = 'chunk:' || CAST(d.doc_id AS VARCHAR) GROUP BY 1),
txt AS (SELECT question_id, array_to_string(list_transform(list_sort(list(struct_pack(c := claim_id, l := concat_ws(' ', subject_id, predicate, coalesce(object_literal, object_id))))), lambda x: x.l), '; ') AS answer FROM hit GROUP BY 1)
SELECT g.question_id, plan_class, reason IS NOT NULL AS abstained, CASE WHEN reason IS NULL THEN coalesce(answer, '') END AS answer, CASE WHEN reason IS NULL THEN round(max_trust, 2) ELSE 0.0 END AS confidence,
 CASE WHEN reason IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_citations, CASE WHEN reason IS NULL THEN path_count ELSE 0 END AS path_count, CASE WHEN reason IS NULL THEN CAST(claim_count AS VARCHAR) || ' claim(s) via ' || plan_class ELSE reason END AS path_summary,
 CASE WHEN reason IS NULL THEN coalesce(m, 0) ELSE 0 END AS documents_touched, 'eventual' AS consistency FROM gated g LEFT JOIN cit ON g.question_id = cit.question_id LEFT JOIN txt ON g.question_id = txt.question_id""")
def q_answers(spark, d):
    gated, hits = _gated(spark, d)
    return Q.answers(gated, Q.answer_text(hits), Q.citations(hits, _chunk_table(spark, d)))


@register("""WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_name IS NOT NULL), s AS (SELECT DISTINCT substr(name, 1, 3) AS stem FROM n WHERE length(name) >= 3 AND regexp_full_match(substr(name, 1, 3), '[a-z]{3}'))
SELECT stem AS question_id, list_slice(list_sort(list(name)), 1, 3) AS near_misses FROM n JOIN s ON substr(name, 1, 3) = stem GROUP BY 1""")
def q_near_miss(spark, d):
    people = table(spark, d, "part").select(F.col("p_name").alias("name"))
    stems = people.select(F.substring(F.lower("name"), 1, 3).alias("stem")).where("stem rlike '^[a-z]{3}$'").distinct()
    found = stems.select(F.col("stem").alias("question_id"), F.lit(0).alias("pos"), F.concat("stem", F.lit("zzz")).alias("normalized"), F.lit(False).alias("resolved"))
    return Q.near_misses(found, people)


@register("SELECT n_nationkey, n_name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1, 2")
def optional_count(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 9000")
    n = table(spark, d, "nation")
    return n.join(rich, n["n_nationkey"] == rich["s_nationkey"], "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("n_suppliers"))


@register(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\b(conflict|disagree|contradict)') THEN 'CONFLICT' WHEN regexp_matches(lower(text), '\b(how many|count|number of|list all)\b') THEN 'AGGREGATE'
 WHEN regexp_matches(lower(text), '\b(when|before|after|timeline|history|latest)\b') THEN 'TEMPORAL' WHEN regexp_matches(lower(text), '\b(connected|connection|relationship|related to|path|between)\b') THEN 'MULTIHOP' ELSE 'LOOKUP' END AS plan_class FROM conversations""")
def plan_rules(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", plan_by_rules(F.col("text")).alias("plan_class"))


# ---- retrieval and evaluation -------------------------------------------------------------------------------------

_BM25 = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf0) ELSE raw END AS idf FROM idf0),
qt AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term), st GROUP BY 1, 2)"""


@register(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 5")
def bm25_topk(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(queries, _docs(spark, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@register(f"WITH {_BM25}, top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0), c AS (SELECT query_id, list(t.doc_id ORDER BY rank) AS document_ids, string_agg('[' || t.doc_id || '] ' || coalesce(source, '') || chr(10) || substr(text, 1, 2000), chr(10) || chr(10) ORDER BY rank) AS context FROM top t JOIN documents d ON t.doc_id = d.doc_id WHERE rank <= 5 GROUP BY 1) SELECT item_id AS query_id, coalesce(document_ids, []) AS document_ids, coalesce(context, '') AS context, context IS NULL AS abstained FROM benchmark LEFT JOIN c ON item_id = query_id")
def bm25_answers(spark, d):
    queries, docs = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), _docs(spark, d)
    return retrieval.baseline_answers(retrieval.bm25(queries, docs), queries, docs.select("doc_id", F.col("source").alias("title"), F.col("text").alias("body")))


_EVAL = """ev AS (SELECT doc_id AS question_id, CASE WHEN doc_id % 11 = 0 THEN 'info_not_found' ELSE 'type' || CAST(doc_id % 11 AS VARCHAR) END AS question_type, quality = 1 AS correct, toxic = 1 AS abstained,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 4) / 3.0 END AS recall, CASE WHEN doc_id % 3 = 0 THEN 'MULTIHOP' ELSE 'LOOKUP' END AS plan_class FROM labels)"""


def _scored_answers(spark, d) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 11 == 0, V.ABSENT).otherwise(F.concat(F.lit("type"), (i % 11).cast("string")))
    got = F.when(i % 4 > 0, F.transform(F.sequence(F.lit(1), (i % 4).cast("int")), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    expected = F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1"), F.lit("2"), F.lit("3"), F.lit("3")))
    return table(spark, d, "labels").select(
        i.alias("question_id"), kind.alias("question_type"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("abstained"),
        V.document_recall(got, expected).alias("recall"), F.when(i % 3 == 0, "MULTIHOP").otherwise("LOOKUP").alias("plan_class"),
    )


@register(f"WITH {_EVAL} SELECT question_type, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(recall), 6) AS avg_recall, round(avg(abstained::INT), 6) AS abstention_rate FROM ev GROUP BY 1")
def eval_category(spark, d):
    r = V.by_category(_scored_answers(spark, d))
    return r.select("question_type", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "avg_recall", "abstention_rate")])


@register(f"""WITH {_EVAL}, c AS (SELECT question_type = 'info_not_found' AS absent, abstained AS outed FROM ev), n AS (SELECT count(*) FILTER (absent AND outed) AS a, count(*) FILTER (outed) AS b, count(*) FILTER (absent) AS c, count(*) FILTER (NOT absent AND outed) AS d, count(*) FILTER (NOT absent) AS e, count(*) FILTER (absent AND NOT outed) AS f FROM c)
SELECT round(a / b, 6) AS precision, round(a / c, 6) AS recall, round(d / e, 6) AS false_abstention, round(f / c, 6) AS confabulation FROM n""")
def eval_abstention(spark, d):
    r = V.abstention(_scored_answers(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@register(f"""WITH {_EVAL}, b AS (SELECT *, CASE WHEN plan_class = 'MULTIHOP' AND question_id % 2 = 0 THEN false ELSE correct END AS without FROM ev WHERE question_id % 7 <> 0)
SELECT count(*) AS n, round(avg(correct::INT), 6) AS accuracy_with, round(avg(without::INT), 6) AS accuracy_without, round(avg(correct::INT) - avg(without::INT), 6) AS delta, round(avg(CASE WHEN plan_class = 'MULTIHOP' THEN correct::INT END) - avg(CASE WHEN plan_class = 'MULTIHOP' THEN without::INT END), 6) AS multihop_delta FROM b""")
def eval_ablation(spark, d):
    full = _scored_answers(spark, d)
    less = full.where("question_id % 7 <> 0").withColumn("correct", F.when((F.col("plan_class") == "MULTIHOP") & (F.col("question_id") % 2 == 0), False).otherwise(F.col("correct")))
    r = V.ablation(full, less)
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy_with", "accuracy_without", "delta", "multihop_delta")])


@register("""WITH {ev}, f AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(question_id AS VARCHAR) || ':42'), question_id) AS r FROM ev WHERE NOT correct) SELECT question_id, CASE WHEN abstained AND question_type <> 'info_not_found' THEN 'false_abstention' WHEN NOT abstained AND question_type = 'info_not_found' THEN 'confabulation' WHEN recall < 0.5 THEN 'low_document_recall' ELSE 'wrong_answer' END AS category FROM f WHERE r <= 30""".replace("{ev}", _EVAL))
def eval_failures(spark, d):
    return V.failure_sample(_scored_answers(spark, d)).select("question_id", "category")


@register(f"""WITH {_EVAL} SELECT CASE WHEN abstained AND question_type <> 'info_not_found' THEN 'false_abstention' WHEN NOT abstained AND question_type = 'info_not_found' THEN 'confabulation' WHEN recall < 0.5 THEN 'low_document_recall' ELSE 'wrong_answer' END AS category, count(*) AS n FROM ev WHERE NOT correct GROUP BY 1""")
def eval_errors(spark, d):
    return V.error_counts(_scored_answers(spark, d))


@register(r"""WITH n AS (SELECT b.item_id, d.doc_id, array_to_string(regexp_extract_all(lower(b.text), '[a-z0-9]+'), ' ') AS g, array_to_string(regexp_extract_all(lower(d.text), '[a-z0-9]+'), ' ') AS a FROM benchmark b JOIN documents d ON b.item_id = d.doc_id) SELECT item_id, a <> '' AND contains(a, g) AS aligned FROM n""")
def eval_judge(spark, d):
    b, t = table(spark, d, "benchmark").select("item_id", F.col("text").alias("gold")), _docs(spark, d).select(F.col("doc_id").alias("item_id"), "text")
    return b.join(t, "item_id").select("item_id", judged(F.col("text"), F.col("gold")).alias("aligned"))


# ---- stores and streams -------------------------------------------------------------------------------------------


@register("SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def store_upsert(spark, d):
    from loomgraph.sources.sinks import Store

    store, rows = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), table(spark, d, "events").select("user_id", "event_id")
    store.upsert("latest", rows.where("event_id % 2 = 0"), ["user_id"], "event_id")
    store.upsert("latest", rows, ["user_id"], "event_id")
    return store.upsert("latest", rows, ["user_id"], "event_id").groupBy("user_id", "event_id").agg(F.count("*").alias("n"))


@register(f"WITH {_CLAIMS} SELECT event_type_subject AS subject_id, predicate, object_id FROM (SELECT DISTINCT subject_id AS event_type_subject, predicate, object_id FROM claims_v WHERE object_id IS NOT NULL)")
def store_edges(spark, d):
    from loomgraph.sources.sinks import Store

    c = views.claims(spark, d)
    nodes = c.select(F.col("subject_id").alias("id")).distinct()
    targets = c.where("object_id IS NOT NULL").select(F.col("object_id").alias("id")).distinct()
    edges = c.select(F.col("subject_id").alias("from_id"), F.col("object_id").alias("to_id"), F.col("predicate").alias("type")).where("to_id IS NOT NULL").distinct()
    out = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}").upsert_edges("edges", edges, nodes, targets)
    return out.select(F.col("from_id").alias("subject_id"), F.col("type").alias("predicate"), F.col("to_id").alias("object_id"))


@register("SELECT event_id, user_id, event_type FROM events")
def ingest_incremental(spark, d):
    from loomgraph.sources.sinks import Store
    from loomgraph.streaming.ingest import ingest

    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    events.where("event_id % 2 = 0").write.mode("append").parquet(f"{base}/in")
    store = Store(spark, f"{base}/store")
    for more in (events.where("event_id % 2 = 1"), None):
        ingest(spark, f"{base}/in", events.schema, store, "events", ["event_id"], f"{base}/checkpoint", files_per_batch=1)
        if more is not None:
            more.write.mode("append").parquet(f"{base}/in")
    return store.read("events")
