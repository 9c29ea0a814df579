"""A graph kept as bucketed tables: nodes by id, edges once by each end, so that hops and counts along them need no shuffle.

Edges are kept different (src, dst) pairs, sorted in their buckets. An edge table can carry columns of the node at its other
end (`covering`), as they were when it was written; a pattern that compares both ends of an edge then needs no shuffle either.
Tables are external, in a folder of the caller's (by default the shared one); open_graph() names them again in another session.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .graph import Graph
from .scratch import new_dir, new_table

#: Bytes or so of a bucket, and of a row when nothing is known of it.
BUCKET_BYTES, ROW_BYTES = 128 << 20, 100


@dataclass(frozen=True)
class StoredGraph:
    spark: SparkSession
    path: str
    buckets: int
    tables: dict[str, str]

    def nodes(self, label: str) -> DataFrame:
        """Bucketed by id."""
        return self.spark.table(self.tables[f"nodes-{label}"])

    def out(self, kind: str) -> DataFrame:
        """Edges, bucketed by src; columns of the node at dst, if any were asked for, as dst_<name>."""
        return self.spark.table(self.tables[f"out-{kind}"])

    def into(self, kind: str) -> DataFrame:
        """Edges, bucketed by dst; columns of the node at src as src_<name>."""
        return self.spark.table(self.tables[f"into-{kind}"])

    def degree_counts(self, label: str, kind: str) -> DataFrame:
        """id, citation_count (edges in) and reference_count (edges out)."""
        into = self.into(kind).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("citation_count"))
        out = self.out(kind).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("reference_count"))
        return self.nodes(label).select("id").join(into, "id", "left").join(out, "id", "left").fillna(0, ["citation_count", "reference_count"])

    def exists(self, label: str, kind: str, end: str = "src", negate: bool = False) -> DataFrame:
        """Nodes that have, or have not, an edge at the given end."""
        edges = (self.out if end == "src" else self.into)(kind).select(F.col(end).alias("id"))
        return self.nodes(label).join(edges, "id", "left_anti" if negate else "left_semi")

    def hop(self, label: str, kind: str, end: str = "src") -> DataFrame:
        """Every node with each of its edges at that end: the node's columns, the edge's, and what the edge carries of the other end."""
        edges = (self.out if end == "src" else self.into)(kind)
        return self.nodes(label).join(edges.withColumnRenamed(end, "id"), "id")


def _name(spark: SparkSession, path: str, name: str, key: str, buckets: int, schema: StructType) -> str:
    table = new_table(spark, "stored")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
    return table


def _write(df: DataFrame, path: str, name: str, key: str, buckets: int) -> str:
    table = new_table(df.sparkSession, "stored")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{path}/{name}").saveAsTable(table)
    return table


def save(graph: Graph, covering: dict[str, dict[str, tuple[str, list[str]]]] | None = None, path: str | None = None, buckets: int | None = None) -> StoredGraph:
    """Write a graph. covering: kind -> {"dst" or "src": (label of the node there, columns)}. buckets: by default so many that the largest edge table has about BUCKET_BYTES in each."""
    spark = next(iter([*graph.nodes.values(), *graph.edges.values()])).sparkSession
    path = (path or new_dir(spark, "graph")).rstrip("/")
    if buckets is None:
        most = max((df.count() for df in graph.edges.values()), default=1)
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(most * ROW_BYTES / BUCKET_BYTES))
    tables, keys = {}, {}
    for label, nodes in graph.nodes.items():
        keys[f"nodes-{label}"] = "id"
        tables[f"nodes-{label}"] = _write(nodes, path, f"nodes-{label}", "id", buckets)
    for kind, edges in graph.edges.items():
        one = edges.dropDuplicates(["src", "dst"])
        for name, key, other in ((f"out-{kind}", "src", "dst"), (f"into-{kind}", "dst", "src")):
            rows, (label, columns) = one, (covering or {}).get(kind, {}).get(other, (None, []))
            if columns:
                far = spark.table(tables[f"nodes-{label}"]).select(F.col("id").alias(other), *(F.col(c).alias(f"{other}_{c}") for c in columns))
                rows = one.join(far, other, "left").select(*one.columns, *(f"{other}_{c}" for c in columns))
            keys[name] = key
            tables[name] = _write(rows, path, name, key, buckets)
    told = {name: {"key": key, "schema": spark.table(tables[name]).schema.jsonValue()} for name, key in keys.items()}
    spark.createDataFrame([(json.dumps({"buckets": buckets, "tables": told}),)], "value string").coalesce(1).write.text(f"{path}/tables")
    return StoredGraph(spark, path, buckets, tables)


def open_graph(spark: SparkSession, path: str) -> StoredGraph:
    """A graph that save() has written, in this session or another."""
    path = path.rstrip("/")
    told = json.loads(spark.read.text(f"{path}/tables").first()[0])
    tables = {name: _name(spark, path, name, t["key"], told["buckets"], StructType.fromJson(t["schema"])) for name, t in told["tables"].items()}
    return StoredGraph(spark, path, told["buckets"], tables)
