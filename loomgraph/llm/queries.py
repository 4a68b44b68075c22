"""The registered queries over the synthetic tables, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm import crf_language, edit_embedding, ego_join, mixing, nbsvm, packing, simhash, suffix_dedup, url_filter, weak_toxicity
from loomgraph.runtime import table


def _fold(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _fold(4) == 2)
    learn = table(spark, sf_dir, "labels").where(_fold(4) != 2)
    model = weak_toxicity.fit(docs.where("NOT held_out"), learn, "toxic")
    return nbsvm.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(action, h, q) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), j AS (
  SELECT p.*, r.action, r.h || r.q AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM j WHERE k = 1
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _fold(5) == 0)
    field = crf_language.fit(docs.where("NOT held_out"))
    return crf_language.identify(docs.drop("lang"), field).select("doc_id", "held_out", "lang_pred", "score")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, 1000 * i AS base, substr(h, 2000 * i + 1, 2198) AS s FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 900) // 1000)) AS i FROM d WHERE len(h) >= 200)),
w AS (SELECT doc_id, base + q AS p, hash(substr(s, 2 * q + 1, 200)) AS k FROM (SELECT doc_id, base, s, unnest(range(0, least(1000, len(s) // 2 - 99))) AS q FROM c)),
f AS (SELECT k, min((doc_id, p)) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT w.doc_id, p FROM w JOIN f ON w.k = f.k AND (w.doc_id, p) <> f.first),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY 1, 2),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
o AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM s GROUP BY 1),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.cosine_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.next_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _fold(5) == 0)
    learn = table(spark, sf_dir, "labels").where(_fold(5) != 0)
    model = nbsvm.fit(docs.where("NOT held_out"), learn, "quality")
    return nbsvm.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_embeddings": op6_embeddings,
    "op7_fingerprints": op7_fingerprints,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
}

ORACLES = {
    "op2_url_filter": OP2_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op6_embeddings": OP6_SQL,
}
