"""Raw JSON records of nine source systems as documents: one declarative adapter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.functions import ids, text as T
from loomgraph.operators.dedupe import simhash63


@dataclass(frozen=True)
class Adapter:
    """Where a source keeps what documents need; `uri` is a pattern over fields, `or_field` wins where it is set."""

    created: str
    author: str
    container: str
    thread: str | None = None
    uri: str = ""
    or_field: str | None = None
    folder: str | None = None
    unix: bool = False


#: Field names, folders and uri patterns of the sources' records (fixed values).
ADAPTERS = {
    "confluence": Adapter("created_at", "author", "space", or_field="original_location"),
    "fireflies": Adapter("recorded_at", "redwood_owner", "customer_company", uri="fireflies://{meeting_id}"),
    "gdrive": Adapter("created_at", "owner", "drive_area", uri="gdrive://{native_id}", or_field="original_location", folder="google_drive"),
    "github": Adapter("created_at", "author", "repo", uri="github://{repo}/pull/{pr_number}"),
    "gmail": Adapter("first_email_at", "mailbox_owner", "mailbox_owner", "thread_id", "gmail://{thread_id}"),
    "hubspot": Adapter("created_at", "owner", "stage", uri="hubspot://{company_id}"),
    "jira": Adapter("created_at", "reporter", "project", uri="jira://{project}/{key}"),
    "linear": Adapter("created_at", "creator", "team", uri="linear://{team}/{key}"),
    "slack": Adapter("first_message_ts", "participants[0]", "channel", "thread_ts", "slack://{channel}/{thread_ts}", unix=True),
}


def raw_records(spark: SparkSession, corpus: str, source: str) -> DataFrame:
    """(path, raw): every JSON file below the source's folder, one object a file."""
    folder = ADAPTERS[source].folder or source
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(f"{corpus}/{folder}")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def documents(raw: DataFrame, source: str, parity: bool = False) -> DataFrame:
    """Documents of one source from rows (path, raw)."""
    a = ADAPTERS[source]

    def field(name: str) -> Column:
        return F.get_json_object("raw", f"$.{name}")

    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    rows = raw.withColumn("native_id", F.coalesce(field("dataset_doc_uuid"), stem)).withColumn("_tb", T.title_and_body(F.col("raw")))
    pattern, values = a.uri, []
    import re

    for name in re.findall(r"\{(\w+)\}", a.uri):
        pattern = pattern.replace("{" + name + "}", "%s")
        values.append(F.coalesce(F.col("native_id") if name == "native_id" else field(name), F.lit("None")))
    made = F.format_string(pattern, *values) if values else F.lit(None).cast("string")
    uri = F.coalesce(field(a.or_field), made) if a.or_field else made
    created = T.parse_unix(field(a.created)) if a.unix else T.parse_iso(field(a.created))
    body = F.col("_tb.body")
    return rows.select(
        ids.node_id("doc", F.lit(source), F.col("native_id"), parity=parity).alias("doc_id"), F.lit(source).alias("source_system"), "native_id",
        F.col("_tb.title").alias("title"), body.alias("body"), created.alias("created_at"), field(a.author).alias("author_raw"),
        (field(a.thread) if a.thread else F.lit(None).cast("string")).alias("thread_key"), uri.alias("uri"),
        T.content_hash(body).alias("content_hash"), simhash63(body).alias("simhash"), field(a.container).alias("declared_container"),
    )


def corpus_documents(spark: SparkSession, corpus: str, sources: list[str] | None = None) -> DataFrame:
    """Documents of all sources."""
    out = None
    for source in sources or ADAPTERS:
        one = documents(raw_records(spark, corpus, source), source)
        out = one if out is None else out.unionByName(one)
    return out


def with_priority(documents_: DataFrame, priority_ids: DataFrame) -> DataFrame:
    """`documents_` with priority 0 for those a question expects (native ids), else 1; one row per doc_id, priority first."""
    wanted = priority_ids.select("native_id").distinct().withColumn("_p", F.lit(0))
    marked = documents_.join(wanted, "native_id", "left").withColumn("priority", F.coalesce("_p", F.lit(1))).drop("_p")
    cols = [c for c in marked.columns if c != "doc_id"]
    best = marked.groupBy("doc_id").agg(F.min(F.struct("priority", *[c for c in cols if c != "priority"])).alias("r"))
    return best.select("doc_id", *[F.col(f"r.{c}") for c in cols])


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON-lines table; blank and malformed lines are left out."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def roster(spark: SparkSession, path: str) -> DataFrame:
    """(name, email, department, manager) of a YAML directory of departments."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    people = [
        (p.get("name"), (p.get("email") or "").lower(), dept, p.get("manager"))
        for dept, members in ((yaml.safe_load(text) or {}).get("departments") or {}).items()
        for p in members or []
    ]
    return spark.createDataFrame(people, "name string, email string, department string, manager string")


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes, relations) of a YAML ontology."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    tree = yaml.safe_load(text) or {}
    listed = lambda v: v if isinstance(v, list) else [v] if v else []
    classes = [(n, (d or {}).get("parent")) for n, d in (tree.get("classes") or {}).items()]
    relations = []
    for n, d in (tree.get("relations") or {}).items():
        span = listed(d.get("range"))
        literal = next((x for x in span if str(x).startswith("literal")), None)
        forms = {k: [str(x) for x in listed(v)] for k, v in (d.get("source_forms") or {}).items()}
        relations.append((n, listed(d.get("domain")), [] if literal else span, literal, bool(d.get("functional")), bool(d.get("temporal")), d.get("inverse"), forms))
    return (
        spark.createDataFrame(classes, "name string, parent string"),
        spark.createDataFrame(
            relations,
            "name string, domain array<string>, range array<string>, range_literal string, functional boolean, temporal boolean, inverse string, source_forms map<string,array<string>>",
        ).withColumn("literal", F.col("range_literal").isNotNull()),
    )


def uuid_index(spark: SparkSession, path: str) -> DataFrame:
    """(native_id, path, source_system) of a JSON object of ids and paths."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("native_id", "path"))
    return rows.withColumn("source_system", T.source_of_path(F.col("path")))
