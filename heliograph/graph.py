"""A typed property graph: one DataFrame per node label and per edge type (columns src, dst and properties)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def with_edges(self, kind: str, edges: DataFrame) -> Graph:
        return replace(self, edges={**self.edges, kind: edges})

    def with_nodes(self, label: str, nodes: DataFrame) -> Graph:
        return replace(self, nodes={**self.nodes, label: nodes})

    def untyped(self) -> DataFrame:
        """Every edge as (kind, src, dst)."""
        return reduce(DataFrame.unionByName, (e.select(F.lit(k).alias("kind"), "src", "dst") for k, e in sorted(self.edges.items())))

    def without(self, ids: DataFrame) -> Graph:
        """Delete nodes (column id) and every edge that touches them."""
        gone = ids.select("id").distinct()
        keep = lambda df, c: df.join(gone.withColumnRenamed("id", c), c, "left_anti")
        return Graph({k: keep(n, "id") for k, n in self.nodes.items()}, {k: keep(keep(e, "src"), "dst").select(*e.columns) for k, e in self.edges.items()})
