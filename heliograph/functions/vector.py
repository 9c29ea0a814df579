"""Cosine similarity and nearest neighbours of a query set against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import keep

#: Rows of a block: two of them and the scores between them are what a task holds.
BLOCK = 4096
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _scaled(a: Column | str) -> Column:
    """The vector by its largest component, so that no square overflows or vanishes; a zero vector as it is."""
    return F.transform(F.array(a), lambda v: F.transform(v, lambda x: x.cast("double") / F.coalesce(F.nullif(F.array_max(F.transform(v, lambda y: F.abs(y.cast("double")))), F.lit(0.0)), F.lit(1.0))))[0]


def cosine(a: Column | str, b: Column | str) -> Column:
    """Zero where a norm is zero; null where a vector is null or lengths differ."""
    both = F.array(F.struct(_scaled(a).alias("a"), _scaled(b).alias("b")))
    norm = lambda v: F.sqrt(dot(v["a"], v["a"])) * F.sqrt(dot(v["b"], v["b"]))
    return F.when(F.size(a) == F.size(b), F.transform(both, lambda v: F.when(norm(v) == 0, 0.0).otherwise(dot(v["a"], v["b"]) / norm(v)))[0])


def _matrix(table: pa.Table) -> np.ndarray:
    """Vectors of a group, all of one length, with length 1 each (zero stays zero)."""
    return _units(np.array(table["vector"].combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows by their length; by their largest component first, so that no square overflows or vanishes."""
    top = np.abs(x).max(1, keepdims=True, initial=0.0)
    x = np.divide(x, top, out=np.zeros_like(x), where=top > 0)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0)


def unit_rows(table: pa.Table) -> np.ndarray:
    """As _matrix, for rows that may have no vector or one of another length than most: those are zero."""
    rows = table["vector"].to_pylist()
    size = max((len(v) for v in rows if v is not None), default=1)
    x = np.zeros((len(rows), size))
    for k, v in enumerate(rows):
        if v is not None and len(v) == size and None not in v and np.isfinite(v).all():
            x[k] = v
    return _units(x)


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, 9)  # equal vectors score alike in any block


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return rounded(a @ b.T)


def whole(vector: str = "vector") -> Column:
    """The vector has every component, and they are finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def meet(queries: DataFrame, nodes: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, within: list[str] = (), block: int = BLOCK, upper: bool = False) -> DataFrame:
    """run(some queries, some nodes) once for every block of queries with every block of nodes of the same vector length (and the same values of within).

    Rows hold `vector` (those with a null or infinite component take no part) and whatever run needs. Blocks are dealt by a
    hash and hold about `block` rows, so a group's size is bounded, and nothing passes through the driver; values of within
    that have no more rows than that share a group, in which run is called for each. upper: queries and nodes are the same
    rows, and each pair of blocks meets once.
    """
    keys = [*within, "__length"]
    row = lambda rows: rows.withColumn("vector", F.col("vector").cast("array<double>")).where(whole()).withColumn("__length", F.size("vector"))
    q, n = row(queries), row(nodes)
    count = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = count(q, "__of_queries").join(count(n, "__of_nodes"), keys)
    if not within:
        blocks = F.broadcast(blocks)  # a row for each length of vectors
    own = lambda size: F.pmod(F.xxhash64("vector", *([F.col("id")] if "id" in queries.columns and "id" in nodes.columns else [])), F.col(size)).cast("int")
    q, n = (rows.join(blocks, keys) for rows in (q, n))
    q = q.withColumn("__a", own("__of_queries")).withColumn("__b", F.explode(F.sequence(F.col("__a") if upper else F.lit(0), F.col("__of_nodes") - 1)))
    n = n.withColumn("__b", own("__of_nodes")).withColumn("__a", F.explode(F.sequence(F.lit(0), F.col("__b") if upper else F.col("__of_queries") - 1)))
    none = pa.schema([(c, ARROW[k]) for c, k in (x.split() for x in schema.split(", "))]).empty_table()

    def parts(table: pa.Table) -> dict[tuple, list[int]]:
        out: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(*(table[c].to_pylist() for c in keys))):
            out.setdefault(key, []).append(k)
        return out

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        if not within:
            return run(a, b) if a.num_rows and b.num_rows else none
        of_a, of_b = parts(a), parts(b)
        return pa.concat_tables([none, *(run(a.take(k), b.take(of_b[key])) for key, k in of_a.items() if key in of_b)])

    at = [*keys, "__a", "__b"]
    if within:
        cells = max(1, -(-max(q.count(), n.count()) // block))
        one = (F.col("__of_queries") <= 1) & (F.col("__of_nodes") <= 1)
        cell = F.when(one, F.pmod(F.xxhash64(*keys), F.lit(cells))).otherwise(F.xxhash64(*keys)).alias("__cell")
        q, n = q.select("*", cell), n.select("*", cell)
        at = ["__cell", "__a", "__b"]
    q, n = (rows.select(*(F.col(c).alias(c) for c in rows.columns if not c.startswith("__of_"))) for rows in (q, n))  # apart, even if both are the same rows
    return q.groupBy(*at).cogroup(n.groupBy(*at)).applyInArrow(both, schema)


def near_within(rows: DataFrame, key: str, least: float, block: int = BLOCK) -> DataFrame:
    """(key, id, other): pairs of rows (id, key, rank, vector) with one key at a cosine of least or more, the one of the lower rank first; equal ranks make no pair.

    A task gets the rows of many keys and works out their pairs side by side. Keys of more than a block of rows go through
    meet(). Vectors that are null or have a null or infinite component take no part.
    """
    kind = dict(rows.dtypes)["id"]
    good = rows.select("id", key, "rank", F.col("vector").cast("array<double>").alias("vector")).where(whole()).withColumn("length", F.size("vector"))
    schema = f"{key} {dict(rows.dtypes)[key]}, id {kind}, other {kind}"

    def some(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table[key].combine_chunks().dictionary_encode().indices), kind="stable")
        table = table.take(pa.array(order))
        of = np.array(table[key].combine_chunks().dictionary_encode().indices)
        rank, x, first, last = np.array(table["rank"]), _matrix(table), [], []
        for step in range(1, int(np.bincount(of).max())):
            i = np.flatnonzero((of[:-step] == of[step:]) & (rank[:-step] != rank[step:]))
            i = i[rounded(np.einsum("ij,ij->i", x[i], x[i + step])) >= least]
            turned = rank[i] > rank[i + step]
            first.append(np.where(turned, i + step, i))
            last.append(np.where(turned, i, i + step))
        i, j = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (first, last))
        return ends(table, table, i, j)

    def ends(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        return pa.table({key: a[key].take(pa.array(i)), "id": a["id"].take(pa.array(i)), "other": b["id"].take(pa.array(j))})

    def blocks(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = np.nonzero((_cosines(_matrix(a), _matrix(b)) >= least) & (np.array(a["rank"])[:, None] < np.array(b["rank"])[None, :]))
        return ends(a, b, i, j)

    large = keep(good.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > block).select(key), "large")
    found = []
    if not large.isEmpty():
        much = good.join(large, key, "left_semi").select("id", key, "rank", "vector")
        found = [meet(much, much, blocks, schema, within=[key], block=block)]
        good = good.join(large, key, "left_anti")
    cells = max(1, -(-good.count() // (4 * block)))
    dealt = good.withColumn("cell", F.pmod(F.xxhash64(key), F.lit(cells)))
    return reduce(DataFrame.unionByName, found, dealt.groupBy("cell", "length").applyInArrow(some, schema))


def scores(queries: DataFrame, nodes: DataFrame, k: int | None = None, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score) for queries and nodes (id, vector): of each query its k best nodes, or all of at least a score.

    Queries that fit into a block go to all tasks, each of which reads its nodes once and returns what they add to the
    answers. More queries are cut into blocks of near ones, as nodes are, and only blocks that may hold an answer meet
    (angles.py). Null vectors take no part; an id that occurs in several rows of queries is asked once for each
    different vector, and rows of nodes with one id are a candidate each.
    """
    from . import angles

    if k is None and least is None:
        raise ValueError("k or least is needed")
    asked = queries.select("id", F.col("vector").cast("array<double>").alias("vector")).where(whole()).distinct()
    few = asked.limit(block + 1).collect()
    if len(few) <= block:
        found = _scan([(r["id"], r["vector"]) for r in few], dict(queries.dtypes)["id"], nodes.select("id", "vector"), k, least)
    else:
        numbered = keep(asked, "asked").withColumn("ask", F.monotonically_increasing_id())
        found = angles.nearest(keep(numbered, "asked"), nodes.select("id", "vector"), k, least, block)
    if k is None:
        return found.drop("ask")
    nth = F.row_number().over(Window.partitionBy("ask", "query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth", "ask")


def _scan(asked: list[tuple], kind: str, nodes: DataFrame, k: int | None, least: float | None) -> DataFrame:
    """(ask, query_id, id, score): a block of queries against all nodes, read once. Of each query a task returns the k best of its own rows, with equals of the last."""
    node_kind = dict(nodes.dtypes)["id"]
    of: dict[int, list[int]] = {}
    for at, (_, v) in enumerate(asked):
        of.setdefault(len(v), []).append(at)
    x = {size: _units(np.array([asked[at][1] for at in rows], np.float64).reshape(len(rows), -1)) for size, rows in of.items()}
    ids = pa.array([i for i, _ in asked], ARROW[kind])
    schema = f"ask bigint, query_id {kind}, id {node_kind}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, pa.Array]] = {}  # ask, score and id of the best so far

        def best(size: int, ask: np.ndarray, score: np.ndarray, node: pa.Array) -> None:
            if size in held:
                old = held[size]
                ask, score, node = np.r_[old[0], ask], np.r_[old[1], score], pa.concat_arrays([old[2], node])
            order = np.lexsort((-score, ask))
            first = np.searchsorted(ask[order], ask[order])
            bar = score[order][np.minimum(first + k - 1, np.searchsorted(ask[order], ask[order], side="right") - 1)]
            stay = order[score[order] >= bar]
            held[size] = ask[stay], score[stay], node.take(pa.array(stay))

        def out(ask: np.ndarray, score: np.ndarray, node: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ask), ids.take(pa.array(ask)), node, pa.array(score)], ["ask", "query_id", "id", "score"])

        for batch in batches:
            length = batch.column("length").to_numpy()
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                y = _units(np.array(batch.column("vector").take(pa.array(at)).flatten(), np.float64).reshape(len(at), -1))
                score = _cosines(x[size], y)
                good = np.ones(score.shape, bool) if least is None else score >= least
                if k is not None and score.shape[1] > k:
                    good &= score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(good)
                ask, node = np.array(of[size], np.int64)[i], batch.column("id").take(pa.array(at[j]))
                if k is None:
                    yield out(ask, score[i, j], node)
                else:
                    best(size, ask, score[i, j], node)
        for ask, score, node in held.values():
            yield out(ask, score, node)

    rows = nodes.withColumn("vector", F.col("vector").cast("array<double>")).where(whole()).withColumn("length", F.size("vector"))
    rows = rows.where(F.col("length").isin(*of)) if of else rows.limit(0)
    return rows.select("id", "vector", "length").mapInArrow(run, schema)


def score_bins(queries: DataFrame, nodes: DataFrame, thresholds: list[float], block: int = BLOCK) -> DataFrame:
    """(same, bin, n): how many pairs of a query and another node (id, vector, label) have equal labels or not, by the number of thresholds (ascending) that their score reaches. Pairs are counted where they are compared."""

    def run(q: pa.Table, n: pa.Table) -> pa.Table:
        at = np.searchsorted(np.array(thresholds), _cosines(_matrix(q), _matrix(n)), side="right")
        a, b = ({c: np.array(t[c].to_pylist(), object) for c in ("id", "label")} for t in (q, n))
        same = (a["label"][:, None] == b["label"][None, :]).astype(bool)
        other = (a["id"][:, None] != b["id"][None, :]).astype(bool)
        counts = [(s, k, int(c)) for s in (False, True) for k, c in enumerate(np.bincount(at[(same == s) & other], minlength=len(thresholds) + 1))]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("same", "bin", "n"), zip(*counts), (pa.bool_(), pa.int32(), pa.int64()))})

    found = meet(queries.select("id", "vector", "label"), nodes.select("id", "vector", "label"), run, "same boolean, bin int, n bigint", block=block)
    return found.groupBy("same", "bin").agg(F.sum("n").alias("n"))


def connections(nodes: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(src, dst) that connect what pairs of nodes (id, vector) at a cosine of least or more connect: not every pair, but of each node one pair with every group of a block that it is near to, where a group is connected within its block. Only blocks that may hold such a pair meet (angles.py)."""
    from . import angles

    kind = dict(nodes.dtypes)["id"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x = _matrix(a)
        near = _cosines(x, x) >= least
        group = np.full(len(x), -1)
        for first in range(len(x)):
            front = np.array([first]) if group[first] < 0 else []
            while len(front):
                group[front] = first
                front = np.nonzero(near[front].any(0) & (group < 0))[0]
        own, far = a["id"].to_pylist(), b["id"].to_pylist()
        i, j = np.nonzero(_cosines(x, _matrix(b)) >= least)
        pairs = np.unique(j * len(x) + group[i])
        ends = [(own[k % len(x)], far[k // len(x)]) for k in pairs.tolist()]
        ends = [e for e in ends if e[0] != e[1]]
        return pa.table({c: pa.array([e[k] for e in ends], ARROW[kind]) for k, c in enumerate(("src", "dst"))})

    rows = nodes.select("id", "vector")
    return angles.join(rows, rows, least, run, f"src {kind}, dst {kind}", block, upper=True)


def embedding_text(statement: Column, assumptions: Column) -> Column:
    """What a problem is embedded by: its statement and its first three assumptions."""
    some = F.array_join(F.slice(assumptions, 1, 3), "; ")
    return F.when(F.size(assumptions) > 0, F.concat(statement, F.lit(" Assumptions: "), some)).otherwise(statement)


def named_text(name: Column, description: Column) -> Column:
    return F.when(F.length(description) > 0, F.concat_ws(": ", name, description)).otherwise(name)
