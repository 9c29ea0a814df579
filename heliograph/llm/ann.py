"""Operator 4: approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of bounded size by a hash. In a shard, equal vectors are one node; greedy
searches from the medoid propose neighbours for a node, relaxed distance pruning keeps diverse ones, and
edges are added both ways. A shard's graph is a file in the shared folder, and so is a block of queries: tasks get
pairs of paths, every block with every shard of its length. Beam search finds candidates, distances are
computed exactly in double precision, and the nearest of all shards are merged. The driver sees counts only. Searches
work in single precision, or in double precision in a shard whose vectors differ in size by more than TAME; both
take differences, so vectors close together are told apart wherever they lie. A query whose beam holds fewer rows than
it asks for is held against its whole shard.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of different
length have no distance, so each length is searched for itself; null ids take no part; rows with equal ids
are different rows, each a query of its own and a candidate for the others; other columns are ignored; an
empty table gives no rows. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_dir, parallelism, spool

SHARD = 16384
DEGREE = 32
BUILD_BEAM = 48
QUERY_BEAM = 192
EXPAND = 4
ALPHA = 1.2
QUERY_BLOCK = 4096
BATCH = 256
#: The largest vector of a shard, from their median, in median ones, up to which single precision serves.
TAME = 1e4
FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of queries[i] to each of points[i, :] or, if it has two dimensions, to each of points."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = points - queries[:, None, :]
        out = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
        for i, j in np.argwhere(~((out > 1e-150) & (out < 1e150))):  # squares that are too large or too small for a double
            part = np.abs(points[i, j] / 2 - queries[i] / 2) if points.ndim == 3 else np.abs(points[j] / 2 - queries[i] / 2)
            top = part.max(initial=0.0)
            out[i, j] = 2 * (top * np.sqrt(((part / top) ** 2).sum())) if top > 0 else 0.0
    return out


class Space:
    """Vectors moved to their median and scaled, for what only has to be near: searches and pruning."""

    def __init__(self, vectors: np.ndarray):
        top = float(np.abs(vectors).max(initial=0.0))
        self.shift = -int(np.frexp(top)[1]) if top else 0
        scaled = np.ldexp(vectors, self.shift)
        self.centre = np.median(scaled, axis=0)
        x = scaled - self.centre
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.kind = np.float32 if self.norm.max(initial=0.0) <= TAME * np.median(self.norm[self.norm > 0], axis=0, keepdims=True).max(initial=0.0) else np.float64
        self.x = x.astype(self.kind)

    def placed(self, queries: np.ndarray) -> np.ndarray:
        """Other vectors in this space; those far outside are moved to where their distances can be squared."""
        with np.errstate(over="ignore"):
            moved = np.ldexp(queries, self.shift) - self.centre
        most = 1e15 if self.kind is np.float32 else 1e140
        return np.clip(moved, -most, most).astype(self.kind)

    def near(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances to nodes[i, :]."""
        d = self.x[nodes]
        d -= queries[:, None, :]
        return np.einsum("ijk,ijk->ij", d, d)


def beam_search(space: Space, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """Nodes of each query's beam (-1: nothing); edges holds -1 where a node has fewer. EXPAND nodes of a beam are opened at a time."""
    n, q = len(edges), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, space.kind)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)  # the last column stands for -1
    seen[:, -1] = seen[:, start] = True
    ids[:, 0], open_[:, 0] = start, True
    dist[:, 0] = space.near(queries, np.full((q, 1), start))[:, 0]
    few = min(EXPAND, beam)
    while True:
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            return ids
        waiting = np.where(open_[rows], dist[rows], np.inf)
        best = np.argpartition(waiting, few - 1, axis=1)[:, :few]
        live = np.isfinite(np.take_along_axis(waiting, best, 1))
        open_[rows[:, None], best] = False
        near = edges[ids[rows[:, None], best]]
        near[~live] = -1
        near = np.sort(near.reshape(len(rows), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        d = np.where(fresh, space.near(queries[rows], near), np.inf).astype(space.kind)
        all_ids, all_dist = np.concatenate([ids[rows], np.where(fresh, near, -1)], 1), np.concatenate([dist[rows], d], 1)
        all_open = np.concatenate([open_[rows], fresh], 1)
        keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids[rows], dist[rows], open_[rows] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_dist, all_open))


def prune(space: Space, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of nodes out of their pools (-1: nothing): a kept one rules out those that are alpha times nearer to it."""
    pool = np.sort(np.where(pool == nodes[:, None], -1, pool), axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    points = space.x[pool] - space.x[nodes][:, None, :]  # as seen from the node
    far = np.einsum("ijk,ijk->ij", points, points)
    between = alpha * alpha * np.maximum(far[:, :, None] + far[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1)), 0)
    far[pool < 0] = np.inf
    out = np.full((len(nodes), degree), -1, np.int64)
    row = np.arange(len(nodes))
    for k in range(min(degree, pool.shape[1])):
        best = far.argmin(1)
        some = np.isfinite(far[row, best])
        if not some.any():
            break
        out[some, k] = pool[row, best][some]
        far[(between[row, best] <= far) & some[:, None]] = np.inf
        far[row, best] = np.inf
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges and medoid of distinct vectors."""
    n = len(vectors)
    space, rng = Space(vectors), np.random.default_rng(seed)
    medoid = int(space.norm.argmin())
    if n <= degree + 1:
        full = np.tile(np.arange(n), (n, 1))
        full[np.arange(n), np.arange(n)] = -1
        return full, medoid
    edges = rng.integers(0, n, (n, degree))
    edges[edges == np.arange(n)[:, None]] = -1
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            nodes = order[at : at + BATCH]
            found = beam_search(space, edges, medoid, space.x[nodes], beam)
            edges[nodes] = prune(space, nodes, np.concatenate([found, edges[nodes]], 1), degree, a)
            # the other way: nodes that gain edges are pruned again, those that gain few together
            to, of = edges[nodes].ravel(), np.repeat(nodes, degree)
            to, of = to[to >= 0], of[to >= 0]
            seq = np.argsort(to, kind="stable")
            to, of = to[seq], of[seq]
            gain, first, count = np.unique(to, return_index=True, return_counts=True)
            by_count = np.argsort(count, kind="stable")
            for part in range(0, len(gain), BATCH):
                some = by_count[part : part + BATCH]
                more = np.full((len(some), int(count[some].max())), -1, np.int64)
                row = np.repeat(np.arange(len(some)), count[some])
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                more[row, nth] = of[np.repeat(first[some], count[some]) + nth]
                edges[gain[some]] = prune(space, gain[some], np.concatenate([edges[gain[some]], more], 1), degree, a)
    return edges, medoid


class Graph:
    """A shard: distinct vectors, their edges, and which rows have each (the smallest ids first, as many as a search can return)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, keep: int):
        self.vectors, group = np.unique(data, axis=0, return_inverse=True)
        group = group.ravel()
        order = np.lexsort((rows, ids, group))
        nth = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        order = order[nth < keep]
        self.ids, self.rows = ids[order], rows[order]
        self.first = np.searchsorted(group[order], np.arange(len(self.vectors) + 1))
        self.edges, self.medoid = build(self.vectors)
        self.edges = self.edges.astype(np.int32)

    def search(self, rows: np.ndarray, queries: np.ndarray, k: int, beam: int) -> list[tuple[np.ndarray, ...]]:
        """For each query the rows, ids and distances of its k nearest of this shard but itself."""
        space, n = Space(self.vectors), len(self.vectors)
        placed, all_nodes = space.placed(queries), np.arange(n)
        beam = beam if space.kind is np.float32 else 2 * beam  # vectors of very different sizes are harder to search
        out = []
        for at in range(0, len(queries), BATCH):
            nodes = beam_search(space, self.edges, self.medoid, placed[at : at + BATCH], min(beam, n))
            exact = distances(queries[at : at + BATCH], self.vectors[nodes])
            for i, (own, near, far) in enumerate(zip(rows[at : at + BATCH], nodes, exact), at):
                near, far = near[near >= 0], far[near >= 0]
                if len(near) < min(k + 1, n):
                    near, far = all_nodes, distances(queries[i : i + 1], self.vectors)[0]
                some = np.argsort(far, kind="stable")[: k + 1]  # each holds a row at least, and one of them may be the query
                last = far[some[-1]]
                some = np.flatnonzero(far <= last)
                size = self.first[near[some] + 1] - self.first[near[some]]
                at_row = np.repeat(self.first[near[some]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                score = np.repeat(far[some], size)
                other = self.rows[at_row] != own
                at_row, score = at_row[other], score[other]
                best = np.lexsort((self.rows[at_row], self.ids[at_row], score))[:k]
                out.append((self.rows[at_row[best]], self.ids[at_row[best]], score[best]))
        return out


def usable(embeddings: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, vector (array<double>) and length of rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
    return spool(good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.size("vector").alias("length")), "vectors")


def index(vectors: DataFrame, keep: int, shard_size: int = SHARD) -> DataFrame:
    """length, shard and path of the file of each graph. Of equal vectors a shard lists the keep smallest ids, which is all that a search for fewer can return."""
    spark = vectors.sparkSession
    sizes = vectors.groupBy("length").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"))
    dealt = vectors.join(sizes, "length").withColumn("shard", F.pmod(F.xxhash64("row", "vec_id"), F.col("shards")).cast("int"))
    shards = sizes.agg(F.sum("shards")).first()[0] or 1
    out_dir = new_dir(spark, "graphs")

    def run(table: pa.Table) -> pa.Table:
        ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
        path = _write(Graph(ids, rows, np.array(table["vector"].combine_chunks().flatten()).reshape(len(ids), -1), keep), out_dir)
        return pa.table({"length": table["length"][:1], "shard": table["shard"][:1], "path": pa.array([path])})

    # a task for each shard: their number is known, so adaptive execution does not put several into one
    apart = dealt.repartitionByRange(int(shards), "length", "shard")
    return spool(apart.groupBy("length", "shard").applyInArrow(run, "length int, shard int, path string"), "graphs")


_OPEN: dict[str, Graph] = {}


def _read(uri: str) -> object:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return pickle.loads(f.read())


def _write(value: object, folder: str) -> str:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(pickle.dumps(value))
    return f"{folder}/{name}"


def _graph(uri: str) -> Graph:
    """The last graph that this worker process opened stays open."""
    if uri not in _OPEN:
        _OPEN.clear()
        _OPEN[uri] = _read(uri)
    return _OPEN[uri]


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """length and path of the file (rows, ids, vectors) of each block of queries."""
    folder = new_dir(queries.sparkSession, "queries")
    sizes = queries.groupBy("length").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = queries.join(sizes, "length").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))

    def run(table: pa.Table) -> pa.Table:
        vectors = np.array(table["vector"].combine_chunks().flatten()).reshape(table.num_rows, -1)
        path = _write((table["row"].to_numpy(), table["vec_id"].to_numpy(), vectors), folder)
        return pa.table({"length": table["length"][:1], "asked": pa.array([path])})

    return spool(dealt.groupBy("length", "block").applyInArrow(run, "length int, asked string"), "query-blocks")


def search(graphs: DataFrame, queries: DataFrame, k: int = 10, beam: int = QUERY_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the k nearest candidates of each query row (of usable()) other than itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, asked in zip(batch.column("path").to_pylist(), batch.column("asked").to_pylist()):
                rows, ids, vectors = _read(asked)
                found = _graph(path).search(rows, vectors, k, beam)
                size = [len(f[0]) for f in found]
                if sum(size):
                    near, near_id, score = (np.concatenate([f[c] for f in found]) for c in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(rows, size), np.repeat(ids, size), near, near_id, score)], [c.split()[0] for c in FOUND.split(", ")])

    blocks = query_blocks(queries, block)
    pairs = max(1, graphs.count() * blocks.count())  # of a shard and a block of queries: a pair is a share of a task's work
    meet = graphs.select("length", "path").join(blocks, "length").select("path", "asked")
    meet = meet.repartition(min(pairs, 64 * parallelism(graphs.sparkSession)), "path", "asked").sortWithinPartitions("path")
    found = meet.mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Search with the vectors whose id is divisible by every, against all others."""
    vectors = usable(embeddings)
    return search(index(vectors, k + 1), vectors.where(F.col("vec_id") % every == 0), k)


def recall(found: list[int], exact: list[int]) -> float:
    """Share of the exact neighbours that were found."""
    return len(set(found) & set(exact)) / max(1, len(exact))
