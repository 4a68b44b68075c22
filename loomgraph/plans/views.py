"""Views over the test tables that stand in for the engine's own tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomgraph.runtime import table

CLAIMS_SQL = """
SELECT concat('claim:', CAST(event_id AS STRING)) AS claim_id, event_id AS seq,
 CASE event_type WHEN 'signup' THEN 'OWNS' WHEN 'purchase' THEN 'STATUS' WHEN 'error' THEN 'DEADLINE'
      WHEN 'view' THEN 'WORKS_ON' ELSE 'LINKED_TO' END AS predicate,
 concat('user ', CAST(user_id AS STRING)) AS subject_id,
 CASE WHEN event_type IN ('signup','view','click') THEN concat('item ', CAST(event_id % 7 AS STRING)) END AS object_id,
 CASE WHEN event_type IN ('purchase','error') THEN concat('v', CAST(CAST(floor(value / 25) AS INT) AS STRING)) END AS object_literal,
 CASE WHEN event_id % 10 = 0 THEN 'negate' ELSE 'affirm' END AS polarity,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS asserted_at,
 CAST(event_id % 100 AS DOUBLE) / 100 AS extraction_confidence,
 concat('chunk:', CAST(event_id % 1000 AS STRING)) AS evidence_chunk_id,
 split_part('slack,gmail,linear,gdrive,hubspot,fireflies,github,jira,confluence', ',', CAST(event_id % 9 AS INT) + 1) AS source_system
FROM events"""

IDENTITY_SQL = """
SELECT c_custkey AS rid,
 CASE c_custkey % 3 WHEN 0 THEN 'author' WHEN 1 THEN 'email_mention' ELSE 'handle_mention' END AS kind,
 CASE c_custkey % 3 WHEN 0 THEN concat(given, ' ', surname)
      WHEN 1 THEN concat(given, '.', surname, '@example.com') ELSE concat('@', given, '.', surname) END AS raw,
 concat('doc:', CAST(CAST(floor(c_custkey / 5) AS INT) AS STRING)) AS doc_id,
 split_part('slack,jira,gmail', ',', CAST(c_custkey % 3 AS INT) + 1) AS source_system,
 CASE WHEN c_custkey % 4 = 0 THEN concat('t', CAST(c_custkey % 50 AS STRING)) END AS thread_key,
 CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 2 AS INT) END AS sentence_ord
FROM (SELECT c_custkey,
   split_part('robert,bob,elizabeth,liz,james,jim,maria,chen', ',', CAST(c_custkey % 8 AS INT) + 1) AS given,
   split_part('patel,ortiz,smith,ashcraft,tymczak,lee', ',', CAST(floor(c_custkey / 8) % 6 AS INT) + 1) AS surname
 FROM customer) x"""

EDGES_SQL = """
SELECT DISTINCT concat('customer ',CAST(o_custkey AS STRING)) AS src,'ORDERED' AS predicate, concat('part ',CAST(l_partkey AS STRING)) AS dst FROM orders JOIN lineitem ON o_orderkey=l_orderkey
UNION ALL SELECT DISTINCT concat('supplier ',CAST(l_suppkey AS STRING)),'SUPPLIES',concat('part ',CAST(l_partkey AS STRING)) FROM lineitem
UNION ALL SELECT concat('supplier ',CAST(s_suppkey AS STRING)),'LOCATED_IN',lower(n_name) FROM supplier JOIN nation ON s_nationkey=n_nationkey
UNION ALL SELECT lower(n_name),'PART_OF',lower(r_name) FROM nation JOIN region ON n_regionkey=r_regionkey"""

#: question_id, question_type, plan_class, entities, predicate_hint
QUESTIONS = [
    (f"q{k}", ["basic", "semantic", "conflicting_info", "completeness", "info_not_found"][k % 5],
     ["LOOKUP", "TEMPORAL", "CONFLICT", "AGGREGATE", "MULTIHOP"][k % 5],
     [f"user {9999 if k % 7 == 6 else 11 * k % 150}", f"item {k % 7}"][: 2 if k % 5 == 4 else 1],
     [None, "STATUS", "OWNS"][k % 3])
    for k in range(30)
]

QUESTIONS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{q}', '{t}', '{p}', [{', '.join(repr(e) for e in es)}], {'CAST(NULL AS VARCHAR)' if h is None else repr(h)})" for q, t, p, es, h in QUESTIONS
) + ") AS t(question_id, question_type, plan_class, entities, predicate_hint)"


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """`sql` with its tables read below `sf_dir`."""
    return spark.sql(_bound(sql, tables), **{t: table(spark, sf_dir, t) for t in tables})


def _bound(sql: str, tables: tuple[str, ...]) -> str:


    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CLAIMS_SQL, "events")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, IDENTITY_SQL, "customer")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EDGES_SQL, "orders", "lineitem", "supplier", "nation", "region")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id string, question_type string, plan_class string, entities array<string>, predicate_hint string")
