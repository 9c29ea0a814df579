"""State transitions: old state and a delta in, new state out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from ..scratch import keep


def normal_statement(c: str = "statement") -> Column:
    return F.lower(F.trim(c))


def one_per_key(delta: DataFrame, *key: str, ordinal: str = "ordinal") -> DataFrame:
    """Rows with one key as one row: of every column the last value that is not null, by `ordinal` if there is such a column, else by value. Null keys are keys."""
    rest = [c for c in delta.columns if c not in key]
    at = [F.col(ordinal)] if ordinal in delta.columns else []
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*at, F.col(c).cast("string"))))
    return delta.groupBy(*key).agg(*(last(c).alias(c) for c in rest)).select(*delta.columns) if rest else delta.distinct()


def insert(state: DataFrame, delta: DataFrame, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(new state, rejects): a row is rejected if its id or its trimmed lower-case statement exists, in the state or earlier in the delta."""
    nth = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(ordinal))
    d = delta.withColumn("s", normal_statement()).withColumn("n1", nth("id")).withColumn("n2", nth("s"))
    d = d.join(state.select("id", F.lit(True).alias("k1")).distinct(), "id", "left").join(state.select(normal_statement().alias("s"), F.lit(True).alias("k2")).distinct(), "s", "left")
    bad = (F.col("n1") > 1) | (F.col("n2") > 1) | F.col("k1").isNotNull() | F.col("k2").isNotNull()
    return state.unionByName(d.where(~bad).select(*state.columns)), d.where(bad).select(*delta.columns)


def patch(state: DataFrame, delta: DataFrame, key: str = "id", version: str | None = "version") -> DataFrame:
    """Non-null columns of delta (rows of one key as one_per_key() joins them) replace those of state; a patched row's version goes up. Unknown keys change nothing."""
    delta = one_per_key(delta, key)
    new = [c for c in delta.columns if c != key and c in state.columns]
    d = delta.select(key, *(F.col(c).alias(f"new_{c}") for c in new), F.lit(True).alias("hit"))
    out = {c: F.coalesce(f"new_{c}", c) for c in new}
    if version is not None:
        out[version] = F.col(version) + F.when(F.col("hit"), 1).otherwise(0)
    return state.join(d, key, "left").select(*(out[c].alias(c) if c in out else F.col(c) for c in state.columns))


def upsert_topics(topics: DataFrame, delta: DataFrame, fill: tuple[str, ...] = ("description",)) -> DataFrame:
    """Merge by (name, level, parent), where no parent equals no parent: matches take the delta's non-null values of fill, others are added. Repeated keys of the delta count once."""
    delta = one_per_key(delta, "name", "level", "parent_id")
    d = delta.select(*(F.col(c).alias(f"d_{c}") for c in delta.columns))
    same = (F.col("name") == F.col("d_name")) & (F.col("level") == F.col("d_level")) & F.col("parent_id").eqNullSafe(F.col("d_parent_id"))
    both = topics.join(d, same, "full_outer")
    value = {c: F.coalesce(f"d_{c}", c) if c in fill else F.coalesce(c, f"d_{c}") for c in topics.columns if f"d_{c}" in d.columns}
    return both.select(*(value.get(c, F.col(c)).alias(c) for c in topics.columns))


def link(edges: DataFrame, new: DataFrame, starts: DataFrame, ends: DataFrame, update: bool = False) -> DataFrame:
    """Add edges (src, dst and properties) that are not there yet and whose ends exist (column id); repeated new edges as one_per_key() joins them.

    With update, edges that are there take the new properties that are not null.
    """
    more = [c for c in new.columns if c in edges.columns and c not in ("src", "dst")]
    at = [c for c in ("ordinal",) if c in new.columns and c not in more]
    one = one_per_key(new.select("src", "dst", *more, *at), "src", "dst").drop(*at)
    fresh = one.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    fresh = fresh.join(starts.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi")
    if update and more:
        d = one.select("src", "dst", *(F.col(c).alias(f"new_{c}") for c in more))
        edges = edges.join(d, ["src", "dst"], "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in more else F.col(c) for c in edges.columns))
    return edges.unionByName(fresh, allowMissingColumns=True)


def related(edges: DataFrame, new: DataFrame, starts: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects) for typed relations (src, dst, relation, properties): a relation that is there, that comes again, whose ends do not exist or that leads to itself is rejected with a reason."""
    key = ["src", "dst", "relation"]
    at = "ordinal" if "ordinal" in new.columns else "relation"
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(at))
    known = edges.select(*key, F.lit(True).alias("known")).distinct()
    rows = new.withColumn("nth", nth).join(known, key, "left")
    rows = rows.join(starts.select(F.col("id").alias("src"), F.lit(True).alias("from_")).distinct(), "src", "left").join(ends.select(F.col("id").alias("dst"), F.lit(True).alias("to_")).distinct(), "dst", "left")
    why = F.when(F.col("from_").isNull() | F.col("to_").isNull(), "not_found").when(F.col("src") == F.col("dst"), "self").when(F.coalesce("known", F.lit(False)) | (F.col("nth") > 1), "exists")
    rows = rows.withColumn("reason", why)
    return edges.unionByName(rows.where("reason is null").select(*(c for c in edges.columns if c in new.columns)), allowMissingColumns=True), rows.where("reason is not null").select(*key, "reason")


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns)


def with_counter(nodes: DataFrame, edges: DataFrame, counter: str, end: str = "dst") -> DataFrame:
    """The counter column as the number of distinct edges, so that relinking never counts twice."""
    n = edges.select("src", "dst").distinct().groupBy(F.col(end).alias("id")).agg(F.count("*").alias(counter))
    return nodes.drop(counter).join(n, "id", "left").fillna(0, [counter])


def edge_changes(edges: DataFrame, changes: DataFrame, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(edges after, deltas) of links and unlinks (src, dst, linked, ordinal and properties) in one go. Of several changes of an edge the last counts.

    deltas (src, dst, delta): 1 for an edge that is new, -1 for one that went; an edge that is linked again or that was not there to
    unlink has none. Only edges that the changes name are looked at for it, however many there are. Edges that stay keep their properties.
    """
    more = [c for c in changes.columns if c in edges.columns and c not in ("src", "dst")]
    last = changes.groupBy("src", "dst").agg(F.max_by(F.struct("linked", *more), F.struct(ordinal, "linked")).alias("c"))
    there = edges.select("src", "dst").join(last.select("src", "dst"), ["src", "dst"], "left_semi").distinct().withColumn("there", F.lit(True))
    judged = keep(last.join(there, ["src", "dst"], "left").withColumn("there", F.coalesce("there", F.lit(False))), "changes")
    deltas = judged.where(F.col("c.linked") != F.col("there")).select("src", "dst", F.when(F.col("c.linked"), 1).otherwise(-1).cast("long").alias("delta"))
    gone = judged.where("there and not c.linked").select("src", "dst")
    new = judged.where("not there and c.linked").select("src", "dst", *(F.col(f"c.{c}").alias(c) for c in more))
    return edges.join(gone, ["src", "dst"], "left_anti").select(*edges.columns).unionByName(new, allowMissingColumns=True), deltas


def add_to_counter(nodes: DataFrame, deltas: DataFrame, counter: str, end: str = "dst") -> DataFrame:
    """The counter with the deltas of edge_changes() added; nodes without any keep theirs, and a counter that is null counts from zero."""
    by = deltas.groupBy(F.col(end).alias("id")).agg(F.sum("delta").alias("__delta"))
    after = F.when(F.col("__delta").isNotNull(), F.coalesce(counter, F.lit(0)) + F.col("__delta")).otherwise(F.col(counter))
    return nodes.join(by, "id", "left").select(*(after.alias(c) if c == counter else F.col(c) for c in nodes.columns))


def promote(papers: DataFrame, full: DataFrame) -> DataFrame:
    """Full records overwrite stubs, keep their counters, and clear is_stub; known papers stay as they are, new ones are added. Several records of a DOI count once."""
    full = one_per_key(full, "doi")
    same = [c for c in papers.columns if c in full.columns and c != "doi"]
    f = full.select("doi", *(F.col(c).alias(f"f_{c}") for c in same), F.lit(True).alias("hit"))
    change = (F.col("is_stub") & F.col("hit")) | F.col("is_stub").isNull()
    out = papers.join(f, "doi", "full_outer")
    return out.select(*(
        F.col("doi") if c == "doi" else (F.col("is_stub") & F.col("hit").isNull()).alias(c) if c == "is_stub" else F.when(F.coalesce(change, F.lit(True)), F.coalesce(f"f_{c}", c)).otherwise(F.col(c)).alias(c) if c in same else F.col(c)
        for c in papers.columns
    ))


def soft_delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    hit = ids.select(key, F.lit(True).alias("hit")).distinct()
    return rows.join(hit, key, "left").withColumn("status", F.when(F.col("hit"), "deprecated").otherwise(F.col("status"))).drop("hit").select(*rows.columns)


def purge(graph: Graph, dois: DataFrame, mention: str, concept: str, extracted: str, instance_of: str) -> tuple[Graph, DataFrame]:
    """Take out what was extracted from papers (column doi): their mentions with all edges, and concepts that no other mention has.

    Also returns the edges of those papers' concepts that stay because another mention shares them.
    """
    e, i = graph.edges[extracted], graph.edges[instance_of]
    hit = e.join(F.broadcast(dois.select(F.col("doi").alias("dst"))) if dois.count() <= 10_000 else dois.select(F.col("doi").alias("dst")), "dst", "left_semi")
    mentions = keep(hit.join(graph.nodes[mention].select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id")).distinct(), "purged")
    mine = mentions.select(F.col("id").alias("src"), F.lit(True).alias("mine"))
    theirs = i.join(mine, "src").select("dst").distinct()
    # only their concepts' edges tell which of them other mentions share
    fate = i.join(theirs, "dst", "left_semi").join(mine, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.bool_or(F.col("mine").isNull()).alias("shared"))
    fate = keep(fate, "concepts")
    shared, alone = fate.where("shared").select("id"), fate.where("not shared").select("id")
    kept = reduce(DataFrame.unionByName, (x.select(F.lit(k).alias("kind"), "src", "dst").join(shared.withColumnRenamed("id", "src"), "src", "left_semi") for k, x in graph.edges.items()))
    return graph.without(mentions.unionByName(alone)), kept
