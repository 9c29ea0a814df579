"""A three-level taxonomy as rows: checking, flattening, loading, exporting, and migration of plain domain names."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import upsert_topics

LEVELS = ("domain", "area", "subtopic")
NODE = "path string, parent_path string, name string, level string, description string"


def parse(spark: SparkSession, tree: list[dict]) -> DataFrame:
    """Nested mappings (name, level, description, children) as rows; paths are names from the root."""
    rows: list[tuple] = []

    def walk(node: dict, above: str | None) -> None:
        path = node["name"] if above is None else f"{above}/{node['name']}"
        rows.append((path, above, node["name"], node["level"], node.get("description")))
        for child in node.get("children") or []:
            walk(child, path)

    for root in tree:
        walk(root, None)
    return spark.createDataFrame(rows, NODE)


def problems(nodes: DataFrame) -> DataFrame:
    """(path, problem): short names, unknown levels, a level that does not follow its parent's, and siblings of one name and level."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    up = nodes.select(F.col("path").alias("parent_path"), F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).alias("above"))
    checks = F.array_compact(F.array(
        F.when(F.length(F.trim("name")) < 2, "name"),
        F.when(rank == 0, "level"),
        F.when((rank > 0) & (rank != F.coalesce("above", F.lit(0)) + 1), "parent"),
    ))
    bad = nodes.join(up.distinct(), "parent_path", "left").select("path", F.explode(checks).alias("problem"))
    return bad.unionByName(nodes.groupBy("path", "level").count().where("count > 1").select("path", F.lit("duplicate").alias("problem")))


def load(topics: DataFrame, nodes: DataFrame) -> DataFrame:
    """Merge the taxonomy into topics, level by level; ids of new topics follow from their paths."""
    new = nodes.select(
        F.substring(F.sha2("path", 256), 1, 16).alias("id"), "name", "level", F.when(F.col("parent_path").isNotNull(), F.substring(F.sha2("parent_path", 256), 1, 16)).alias("parent_id"), "description"
    )
    for level in LEVELS:
        known = topics.select(F.col("name").alias("k_name"), F.col("level").alias("k_level"), F.col("parent_id").alias("k_parent"), F.col("id").alias("k_id"))
        topics = upsert_topics(topics, new.where(F.col("level") == level))
        # children of a topic that was already there follow its id
        hit = new.where(F.col("level") == level).join(known, (F.col("name") == F.col("k_name")) & (F.col("level") == F.col("k_level")) & F.col("parent_id").eqNullSafe(F.col("k_parent"))).select(F.col("id").alias("parent_id"), "k_id")
        new = new.join(hit, "parent_id", "left").withColumn("parent_id", F.coalesce("k_id", "parent_id")).drop("k_id")
    return topics


def export(topics: DataFrame) -> DataFrame:
    """One row per domain: its subtree as nested arrays, children by name."""
    leaf = topics.where("level = 'subtopic'").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("name", "id"))).alias("subtopics"))
    area = topics.where("level = 'area'").join(leaf.withColumnRenamed("parent_id", "id"), "id", "left")
    mid = area.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("name", "id", F.coalesce("subtopics", F.array().cast("array<struct<name:string,id:string>>")).alias("subtopics")))).alias("areas"))
    return topics.where("level = 'domain'").select("id", "name").join(mid.withColumnRenamed("parent_id", "id"), "id", "left")


def flatten(topics: DataFrame) -> DataFrame:
    """(path, level, id) of every topic of a three-level taxonomy, paths being names from the root."""
    up = topics.select(F.col("id").alias("up_id"), F.col("name").alias("up_name"), F.col("parent_id").alias("up_parent"))
    top = topics.select(F.col("id").alias("top_id"), F.col("name").alias("top_name"))
    rows = topics.join(up, F.col("parent_id") == F.col("up_id"), "left").join(top, F.col("up_parent") == F.col("top_id"), "left")
    return rows.select(F.concat_ws("/", "top_name", "up_name", "name").alias("path"), "level", "id")


def to_text(topics: DataFrame) -> DataFrame:
    """(id, text): each domain with its subtree as indented YAML text, children by name."""
    line = lambda depth, name, level: F.concat(F.lit("  " * (2 * depth) + "- name: "), F.to_json(F.struct(name.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(name.alias("v")))) - 6), F.lit("\n" + "  " * (2 * depth) + f"  level: {level}"))
    inside = lambda depth, items: F.when(F.size(items) > 0, F.concat(F.lit("\n" + "  " * (2 * depth) + "  children:\n"), F.array_join(items, "\n"))).otherwise(F.lit(""))
    none = F.array().cast("array<string>")
    leaves = lambda a: F.transform(F.coalesce(a["subtopics"], F.array().cast("array<struct<name:string,id:string>>")), lambda s: line(2, s["name"], "subtopic"))
    areas = F.transform("areas", lambda a: F.concat(line(1, a["name"], "area"), inside(1, leaves(a))))
    return export(topics).select("id", F.concat(line(0, F.col("name"), "domain"), inside(0, F.coalesce(areas, none))).alias("text"))


def digest(tree: list[dict]) -> str:
    """Hash of a taxonomy that does not depend on the order of keys or on how missing children are written."""

    def plain(node: dict) -> dict:
        return {**node, "children": [plain(c) for c in node.get("children") or []]}

    return hashlib.sha256(json.dumps([plain(n) for n in tree], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def from_domains(problems_: DataFrame, topics: DataFrame, domain: str = "domain", source: str = "migrated") -> tuple[DataFrame, DataFrame]:
    """(topics, edges): every distinct domain name as an area topic of the source, unless there is one, and its problems under it."""
    names = problems_.where(F.trim(domain) != "").select(F.trim(domain).alias("name")).distinct()
    new = names.join(topics.where("level = 'area'").select("name"), "name", "left_anti")
    made = new.select(F.substring(F.sha2(F.concat(F.lit(f"{source}/"), "name"), 256), 1, 16).alias("id"), "name", F.lit("area").alias("level"), F.lit(None).cast("string").alias("parent_id"))
    out = topics.unionByName(made, allowMissingColumns=True)
    first = out.where("level = 'area'").groupBy("name").agg(F.min("id").alias("dst"))
    return out, problems_.select(F.col("id").alias("src"), F.trim(domain).alias("name")).join(first, "name").select("src", "dst")
