"""Node schemas (as DDL), what a valid row is, and unique keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import versioned

_TIMES = "created_at timestamp, updated_at timestamp"
_EVIDENCE = "evidence struct<source_doi:string,source_title:string,section:string,quoted_text:string,char_offset_start:int,char_offset_end:int>"
_PARTS = "assumptions array<struct<text:string,implicit:boolean,confidence:double>>, constraints array<struct<text:string,type:string,confidence:double>>, datasets array<struct<name:string,url:string,available:boolean,size:string>>, metrics array<struct<name:string,description:string,baseline_value:double>>, baselines array<struct<name:string,paper_doi:string,performance:map<string,double>>>"

NODES = {
    "problem": f"id string, statement string, status string, {_PARTS}, {_EVIDENCE}, embedding array<float>, version int, {_TIMES}",
    "mention": f"id string, statement string, paper_doi string, section string, quoted_text string, {_PARTS}, embedding array<float>, concept_id string, match_confidence string, match_score double, match_method string, review_status string, {_TIMES}",
    "concept": f"id string, canonical_statement string, status string, embedding array<float>, human_edited boolean, mention_count int, paper_count int, first_mentioned_year int, last_mentioned_year int, version int, last_refined_at_count int, {_TIMES}",
    "paper": "doi string, title string, authors array<string>, venue string, year int, abstract string, arxiv_id string, pdf_url string, is_stub boolean, citation_count int, reference_count int, ingested_at timestamp",
    "author": "id string, name string, affiliations array<string>, orcid string, semantic_scholar_id string",
    "topic": f"id string, name string, description string, level string, parent_id string, source string, embedding array<float>, problem_count int, paper_count int, {_TIMES}",
    "model": f"id string, name string, description string, aliases array<string>, architecture string, model_type string, year_introduced int, is_canonical boolean, embedding array<float>, usage_count int, {_TIMES}",
    "method": f"id string, name string, description string, aliases array<string>, method_type string, embedding array<float>, usage_count int, {_TIMES}",
    "review": f"trace_id string, mention_id string, priority int, status string, assigned_to string, sla_deadline timestamp, resolution string, resolved_concept_id string, resolved_by string, {_TIMES}",
}
KEYS = {"paper": "doi", "review": "trace_id"}


def _ok(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def rules(label: str) -> dict[str, Column]:
    """Named conditions that a row of the label must meet."""
    c = F.col
    absent = lambda x, rule: x.isNull() | rule
    all_ = {
        "problem": {"statement_length": F.length("statement") >= 20, "resolved_has_source": ~c("status").isin("resolved", "deprecated") | c("evidence.source_doi").isNotNull()},
        "mention": {"paper_doi": c("paper_doi").startswith("10."), "match_score": absent(c("match_score"), c("match_score").between(0, 1))},
        "concept": {"years": absent(c("first_mentioned_year"), absent(c("last_mentioned_year"), c("first_mentioned_year") <= c("last_mentioned_year")))},
        "paper": {"doi": c("doi").startswith("10."), "title_length": F.length("title").between(2, 500), "year": absent(c("year"), c("year").between(1900, 2100))},
        "author": {"orcid": absent(c("orcid"), c("orcid").startswith("0000-"))},
        "topic": {"level": c("level").isin("domain", "area", "subtopic"), "domain_is_root": (c("level") != "domain") | c("parent_id").isNull()},
        "model": {"aliases": F.size(F.coalesce("aliases", F.array().cast("array<string>"))) <= 20, "name_length": F.length("name").between(2, 120), "description_length": absent(c("description"), F.length("description") <= 400)},
        "review": {"resolved_is_complete": (c("status") != "resolved") | (c("resolution").isNotNull() & c("resolved_by").isNotNull()), "linked_has_concept": absent(c("resolution"), (c("resolution") != "linked") | c("resolved_concept_id").isNotNull())},
    }
    return {k: _ok(v) for k, v in all_.get("model" if label == "method" else label, {}).items()}


def violations(rows: DataFrame, label: str) -> DataFrame:
    """(key, rule) for every rule that a row breaks, and `unique` for keys that occur twice."""
    key = KEYS.get(label, "id")
    broken = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules(label).items())))
    bad = rows.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))
    twice = rows.groupBy(F.col(key).alias("key")).count().where("count > 1").select("key", F.lit("unique").alias("rule"))
    return bad.unionByName(twice)


#: The version of NODES; a store of an older one gets the tables and columns that it lacks.
VERSION = 1


def initialize(spark: SparkSession, path: str, force: bool = False) -> bool:
    """Give a store (of sources.versioned) an empty table for every label that it lacks, and every table the columns that it lacks, all at once. False if it is of this version already."""
    have = versioned.manifest(spark, path)
    now = versioned.read(spark, path, "schema_version").agg(F.max("version")).first()[0] if "schema_version" in have else 0
    if now >= VERSION and not force:
        return False
    tables = {}
    for label, ddl in NODES.items():
        wanted = spark.createDataFrame([], ddl)
        old = versioned.read(spark, path, label) if label in have else wanted
        more = [f for f in wanted.schema if f.name not in old.columns]
        if label not in have or more:
            tables[label] = old.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in more))
    applied = spark.range(1).select(F.lit(VERSION).alias("version"), F.current_timestamp().alias("applied_at"))
    before = versioned.read(spark, path, "schema_version").where(F.col("version") != VERSION) if "schema_version" in have else applied.limit(0)
    versioned.publish(spark, path, {**tables, "schema_version": before.unionByName(applied)})
    return True


def info(spark: SparkSession, path: str) -> DataFrame:
    """(label, key, n_rows, columns, rules, version, target) of every table of a store."""
    have = versioned.manifest(spark, path)
    now = versioned.read(spark, path, "schema_version").agg(F.max("version")).first()[0] if "schema_version" in have else 0
    rows = [(label, KEYS.get(label, "id"), t["rows"], [f["name"] for f in t["schema"]["fields"]], sorted(rules(label)), now, VERSION) for label, t in have.items() if label in NODES]
    return spark.createDataFrame(rows, "label string, key string, n_rows long, columns array<string>, rules array<string>, version int, target int")


def put(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """Publish new states of labels, if no row of them breaks a rule or a unique key; the new version. Raises with the first violations otherwise, and nothing changes."""
    bad = reduce(DataFrame.unionByName, (violations(df, label).select(F.lit(label).alias("label"), F.col("key").cast("string").alias("key"), "rule") for label, df in tables.items()))
    some = bad.orderBy("label", "key", "rule").limit(10).collect()
    if some:
        raise ValueError("; ".join(f"{r['label']} {r['key']}: {r['rule']}" for r in some))
    return versioned.publish(spark, path, tables)
