"""Pattern matching: hops, existence, hierarchy closure and breadth-first search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import keep


def hop(start: DataFrame, edges: DataFrame, end: DataFrame, how: str = "inner") -> DataFrame:
    """start -[edges]-> end: columns of both ends, with start's id as src and end's id as dst. how="left" keeps starts without an edge."""
    near = start.select(F.col("id").alias("src"), *(c for c in start.columns if c != "id"))
    far = end.select(F.col("id").alias("dst"), *(c for c in end.columns if c != "id"))
    return near.join(edges, "src", how).join(far, "dst", how)


def exists(rows: DataFrame, edges: DataFrame, end: str = "src", negate: bool = False) -> DataFrame:
    """Rows (by id) that have, or have not, an edge at the given end."""
    return rows.join(edges.select(F.col(end).alias("id")).distinct(), "id", "left_anti" if negate else "left_semi")


def around(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges at ids in both directions as (id, other, direction); a self-loop counts once, as outgoing."""
    end = lambda a, b, name: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(name).alias("direction"))
    both = F.array(end("src", "dst", "outgoing"), F.when(F.col("src") != F.col("dst"), end("dst", "src", "incoming")))
    return edges.select(F.explode(both).alias("e")).where("e is not null").select("e.*").join(keep(ids.select("id"), "ids"), "id", "left_semi")  # stored, so that Spark knows how many there are


def closure(edges: DataFrame, levels: int) -> DataFrame:
    """(src, dst, depth) for every path of 0 to `levels` child-to-parent edges in a hierarchy (each node has one parent)."""
    step = edges.select("src", "dst").distinct()
    ids = step.select(F.col("src").alias("id")).unionByName(step.select(F.col("dst").alias("id"))).distinct()
    now = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("depth"))
    out = now
    for depth in range(1, levels + 1):
        up = step.select(F.col("src").alias("dst"), F.col("dst").alias("above"))
        now = now.join(up, "dst").select("src", F.col("above").alias("dst"), F.lit(depth).alias("depth"))
        out = out.unionByName(now)
    return out


def bfs(edges: DataFrame, anchors: DataFrame, depth: int, direction: str = "out", fan_out: int | None = None, order: Column | None = None) -> DataFrame:
    """(id, depth): every node within depth of the anchors, at the depth of its first discovery.

    fan_out is a limit of the traversal itself: so many neighbours of a node, least `order` (else least id) first.
    """
    by = edges.select("src", "dst", *([order.alias("__order")] if order is not None else []))
    if depth > 1:
        by = keep(by, "steps")  # read again at every depth
    ranks = [F.col("__order"), F.col("dst")] if order is not None else [F.col("dst")]
    turned = by.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *by.columns[2:])
    step = {"out": by, "in": turned}[direction] if direction in ("out", "in") else by.unionByName(turned)
    front = seen = keep(anchors.select("id").distinct().withColumn("depth", F.lit(0)), "front")  # stored, so that Spark knows how many there are
    for d in range(1, depth + 1):
        steps = step.join(front.select(F.col("id").alias("src")), "src", "left_semi")
        if fan_out is not None:  # only the edges of the front are put in order; repeated ones share a rank
            nth = F.dense_rank().over(Window.partitionBy("src").orderBy(*ranks))
            steps = steps.withColumn("nth", nth).where(F.col("nth") <= fan_out)
        found = steps.select(F.col("dst").alias("id")).distinct()
        front = keep(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), "front")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node of undirected edges (src, dst) reaches, by repeated hooking to least neighbours."""
    both = keep(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "links")
    now = keep(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumnRenamed("src", "id"), "labels")
    while True:
        # the least label of a neighbour, then that label's own label
        best = both.join(now.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        hooked = now.join(best.withColumnRenamed("src", "id"), "id").select("id", F.least("component", "near").alias("component"))
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        after = keep(hooked.join(jump, "component", "left").select("id", F.least("component", F.coalesce("beyond", "component")).alias("component")), "labels")
        changed = after.join(now.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        now = after
        if not changed:
            return now
