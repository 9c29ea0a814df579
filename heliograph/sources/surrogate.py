"""A research graph laid over the sample tables, and the same as SQL.

Regions, nations and market segments are topics of three levels; orders are problems, customers place them
under a segment; parts are papers, suppliers authors; successive lines of an order cite one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph

SQL = """
topic AS (
  SELECT 'R' || r_regionkey AS id, r_name AS name, 'domain' AS level, CAST(NULL AS VARCHAR) AS parent_id FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'area', 'R' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'S' || c_nationkey || '-' || c_mktsegment, c_mktsegment, 'subtopic', 'N' || c_nationkey FROM customer),
problem AS (
  SELECT 'O' || o_orderkey AS id, o_orderkey AS key, o_custkey AS custkey, o_orderpriority || ' order number ' || o_orderkey AS statement,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'resolved' END AS status, o_orderdate AS created_at, o_totalprice AS weight FROM orders),
belongs AS (
  SELECT 'O' || o_orderkey AS src, 'S' || c_nationkey || '-' || c_mktsegment AS dst FROM orders JOIN customer ON o_custkey = c_custkey),
paper AS (
  SELECT '10.1/' || p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 1990 + p_size % 35 END AS year, p_brand AS venue, p_retailprice AS weight FROM part),
author AS (SELECT 'A' || s_suppkey AS id, s_name AS name FROM supplier),
extracted AS (SELECT DISTINCT 'O' || l_orderkey AS src, '10.1/' || l_partkey AS dst FROM lineitem),
authored AS (
  SELECT '10.1/' || l_partkey AS src, 'A' || l_suppkey AS dst, min(l_linenumber) AS author_position FROM lineitem GROUP BY l_partkey, l_suppkey),
cites AS (
  SELECT DISTINCT '10.1/' || l_partkey AS src, '10.1/' || next AS dst
  FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS next FROM lineitem) WHERE next IS NOT NULL)"""


#: Rows of a task that sorts or compares lines; adaptive execution would put as many together as fill its target when compressed.
TASK_ROWS = 1 << 18


def tasks_for(rows: DataFrame) -> int:
    """As many tasks as keep each at TASK_ROWS; for fewer rows, one for each core."""
    n = rows.count()
    return max(1, -(-n // TASK_ROWS), min(n * 8 // TASK_ROWS, rows.sparkSession.sparkContext.defaultParallelism))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    key = lambda prefix, *c: F.concat(F.lit(prefix), *c)
    segment = F.concat(F.lit("S"), "c_nationkey", F.lit("-"), "c_mktsegment")
    topics = (
        t("region").select(key("R", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("domain").alias("level"), F.lit(None).cast("string").alias("parent_id"))
        .unionByName(t("nation").select(key("N", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("area").alias("level"), key("R", "n_regionkey").alias("parent_id")))
        .unionByName(t("customer").select(segment.alias("id"), F.col("c_mktsegment").alias("name"), F.lit("subtopic").alias("level"), key("N", "c_nationkey").alias("parent_id")).distinct())
    )
    orders, lines = t("orders"), t("lineitem")
    problems = orders.select(
        key("O", "o_orderkey").alias("id"),
        F.concat("o_orderpriority", F.lit(" order number "), "o_orderkey").alias("statement"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("resolved").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("weight"),
    )
    papers = t("part").select(
        key("10.1/", "p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 17 != 0, 1990 + F.col("p_size") % 35).alias("year"),
        F.col("p_brand").alias("venue"),
        F.col("p_retailprice").alias("weight"),
    )
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    tasks = tasks_for(lines)
    by_order = lines.select("l_orderkey", "l_linenumber", "l_partkey").repartition(tasks, "l_orderkey")
    pairs = by_order.select("l_partkey", following.alias("n")).where("n is not null").repartition(tasks, "l_partkey", "n").distinct()
    return Graph(
        {"topic": topics, "problem": problems, "paper": papers, "author": t("supplier").select(key("A", "s_suppkey").alias("id"), F.col("s_name").alias("name"))},
        {
            "subtopic_of": topics.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")),
            "belongs_to": orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(key("O", "o_orderkey").alias("src"), segment.alias("dst")),
            "extracted_from": lines.select("l_orderkey", "l_partkey").distinct().select(key("O", "l_orderkey").alias("src"), key("10.1/", "l_partkey").alias("dst")),
            "authored_by": lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("author_position")).select(key("10.1/", "l_partkey").alias("src"), key("A", "l_suppkey").alias("dst"), "author_position"),
            "cites": pairs.select(key("10.1/", "l_partkey").alias("src"), key("10.1/", "n").alias("dst")),
        },
    )
