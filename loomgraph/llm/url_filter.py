"""URL filter by host-suffix and path-prefix expressions and hash-prefix lookup.

Every URL is expanded into the expressions a rule could have: each suffix of
its host of as many labels as some rule has, joined to each prefix of its path
whose length some rule has. Expressions meet the rules in an equi-join on a short hash
prefix; the full digest and the text of the expression then confirm the match.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Largest rule list that is broadcast; a longer one takes part in a shuffled join.
BROADCAST_RULES = 50_000

RULE_SCHEMA = "action string, host string, path string"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url: str = "url",
    default: str = "allow",
    prefix_digits: int = 8,
) -> DataFrame:
    """`pages` with host, path, rule (null if none fits) and verdict.

    `rules` are (action, host, path). A rule fits its host and all subdomains
    where the path starts with the rule's; of several the longest expression
    (host and path together) wins, and `block` beats `allow` on the same
    expression. A URL that no rule fits gets `default`.

    Null, empty and malformed URLs have an empty host and path and get the
    default. Repeated rows are judged alike and all kept. An input column
    named host, path, rule or verdict is replaced. No rule: all default. The
    work per URL depends on the distinct numbers of labels and path lengths of
    rules, not on the number of rules or of the URL's own labels; each distinct (host, path head) is
    judged once, so a host with a third of all pages is no hot group.
    """
    spark: SparkSession = pages.sparkSession
    longest = max((len(p) for _, _, p in rules), default=0)
    lengths = sorted({len(p) for _, _, p in rules}) or [0]
    rows = pages.drop("host", "path", "rule", "verdict").withColumn("_u", F.col(url))
    host, path = split_url(F.col("_u"))
    rows = rows.withColumn("host", host).withColumn("path", path).drop("_u").withColumn("_head", F.substring("path", 1, longest))

    rule_rows = spark.createDataFrame([(a, h.lower(), p) for a, h, p in rules], RULE_SCHEMA)
    rule_rows = (
        rule_rows.groupBy("host", "path")
        .agg(F.max("action").alias("action"))
        .select(F.concat("host", "path").alias("rule"), F.length("host").alias("rule_host"), "action")
        .withColumn("digest", _digest(F.concat(F.col("rule_host").cast("string"), F.lit("\x00"), "rule")))
        .withColumn("short", F.substring("digest", 1, prefix_digits))
    )
    if len(rules) <= BROADCAST_RULES:
        rule_rows = F.broadcast(rule_rows)

    keys = rows.select("host", "_head").distinct()
    labels = F.split("host", r"\.")
    counts = sorted({h.count(".") + 1 for _, h, _ in rules}) or [1]
    hosts = F.array_compact(F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in counts]))
    heads = F.array(*[F.when(F.length("_head") >= n, F.substring("_head", 1, n)) for n in lengths])
    expanded = (
        keys.where("host <> ''")
        .select("host", "_head", F.explode(F.array_distinct(hosts)).alias("h"))
        .select("host", "_head", "h", F.explode(F.array_compact(heads)).alias("p"))
        .select("host", "_head", F.concat("h", "p").alias("expression"), F.length("h").alias("h_len"))
        .withColumn("digest", _digest(F.concat(F.col("h_len").cast("string"), F.lit("\x00"), "expression")))
        .withColumn("short", F.substring("digest", 1, prefix_digits))
    )
    hits = expanded.join(rule_rows.withColumnRenamed("digest", "rule_digest"), "short").where("digest = rule_digest AND expression = rule")
    best = hits.groupBy("host", "_head").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.col("rule_host").alias("h"), "action", "rule")).alias("best")
    )
    return (
        rows.join(best, ["host", "_head"], "left")
        .withColumn("rule", F.col("best.rule"))
        .withColumn("verdict", F.coalesce("best.action", F.lit(default)))
        .drop("_head", "best")
    )
