"""Exact pruning of cosine comparisons: blocks of vectors that lie close together, with the angles that they span.

Rows go to the nearest of a few pivots, and those of one pivot, in order of their angle to it, are cut into blocks. A
block is a file in the shared folder; what is known of it is a row: its size, and for every pivot the least and the
largest angle of its members. Angles between unit vectors obey the triangle inequality, so no two members of blocks A and
B are closer than lo(A, p) - hi(B, p) for any pivot p, and pairs of blocks that stay apart by more than the bar are never
opened. Pairs of pivots are ruled out first (by the radius of what lies around them), so the rows about blocks
are joined by pivot, not all with all. Tasks get pairs of paths; vectors are written once, and no vector is shuffled for a pair.

Vectors that are null or have a null or infinite component take no part. Zero vectors have no angle: their blocks have
the pivot -1, span every angle and meet every block.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import keep, new_dir
from . import vector as V

#: At most so many pivots (for each length of vectors), picked among so many rows.
PIVOTS, SAMPLE = 128, 4096
#: Angles are known to be right to this much, bars are moved by it.
SLACK = 1e-6
#: Scores that a task works out, about; blocks of nodes that a block of queries goes through in one go; bytes of blocks that a task keeps open.
SCORES, SHARE, OPEN = 1 << 26, 16, 64 << 20
#: Rows of a block that are compared at a time, and pairs for each of them that are scored by themselves; of more the rows are compared in double precision.
ROWS, PAIRS = 256, 16
BLOCK = "length int, cell int, path string, n int, lo array<double>, hi array<double>"


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def bar_of(least: float) -> float:
    """The angle beyond which no rounded cosine is least or more."""
    return math.pi + 1 if least <= -1 else math.acos(min(1.0, least - 2e-9)) + SLACK


def pivots_of(rows: DataFrame, block: int) -> dict[int, np.ndarray]:
    """Unit vectors for each length, spread out among a sample: each is drawn with a chance that grows with the square of its angle to those drawn before."""
    out = {}
    shares = rows.groupBy("length").agg(F.count("*").alias("n")).collect()
    for length, n in ((r["length"], r["n"]) for r in shares):
        h = F.xxhash64("vector")
        some = rows.where(F.col("length") == length)
        if n > 4 * SAMPLE:
            some = some.where(h < F.lit(int(2 * SAMPLE / n * 2**64) - 2**63))
        x = V._units(np.array([r["vector"] for r in some.orderBy(h, "vector").limit(SAMPLE).collect()], float).reshape(-1, length))
        x = x[x.any(1)]
        if not len(x):
            out[length] = np.zeros((0, length))
            continue
        rng, most = np.random.default_rng(1), max(1, min(PIVOTS, 2 * math.ceil(n / block), len(x)))
        picked = [int(rng.integers(len(x)))]
        far = angles(x, x[picked])[:, 0]
        while len(picked) < most and (far > 1e-6).any():
            picked.append(int(rng.choice(len(x), p=far**2 / (far**2).sum())))
            far = np.minimum(far, angles(x, x[picked[-1:]])[:, 0])
        out[length] = x[picked]
    return out


def usable(rows: DataFrame) -> DataFrame:
    v = rows.withColumn("vector", F.col("vector").cast("array<double>")).where(V.whole())
    return v.where(F.size("vector") > 0).withColumn("length", F.size("vector"))


def write_block(folder: str, table: pa.Table) -> str:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{root}/{name}.arrow") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    return f"{folder}/{name}.arrow"


def read_block(uri: str) -> pa.Table:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all()


def unit(table: pa.Table) -> np.ndarray:
    """The vectors of a block; each has length 1, or is zero."""
    return np.array(table["vector"].combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)


def index(rows: DataFrame, pivots: dict[int, np.ndarray], block: int = V.BLOCK) -> DataFrame:
    """The blocks (BLOCK) of rows of usable(); a file has the rows' columns, and vectors of length 1."""
    folder, names = new_dir(rows.sparkSession, "angles"), [c for c in rows.columns if c != "length"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            cell, angle = np.full(len(length), -1, np.int32), np.zeros(len(length))
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                x = V._units(np.array(batch.column("vector").take(pa.array(at)).flatten(), np.float64).reshape(len(at), -1))
                live = x.any(1) & bool(len(pivots[size]))
                if live.any():
                    a = angles(x[live], pivots[size])
                    cell[at[live]], angle[at[live]] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, size = [], None, 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            x = V._units(unit(table))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, of[0]), pa.int32()), pa.array(x.ravel()))
            body = table.set_column(table.schema.get_field_index("vector"), "vector", flat).select(names)
            a = angles(x, pivots[of[0]]) if of[1] >= 0 else np.array([[0.0] * len(pivots[of[0]]), [math.pi] * len(pivots[of[0]])])
            cols = [[of[0]], [of[1]], [write_block(folder, body)], [len(x)], [a.min(0).tolist()], [a.max(0).tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["length", "cell", "path", "n", "lo", "hi"])

        for batch in batches:
            key = np.stack([batch.column("length").to_numpy(), batch.column("cell").to_numpy()], 1)
            for part in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1) if len(key) else ():
                begin, stop, now = int(part[0]), int(part[-1]) + 1, tuple(key[part[0]].tolist())
                if held and now != of:
                    yield out()
                    held, size = [], 0
                of = now
                while begin < stop:
                    n = min(stop - begin, block - size)
                    held.append(batch.slice(begin, n))
                    begin, size = begin + n, size + n
                    if size == block:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    assigned = rows.mapInArrow(assign, f"{kind}, cell int, angle double")
    tasks = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // block)))
    order = ["length", "cell", "angle"]
    return keep(assigned.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(cut, BLOCK), "blocks")


def _cells(blocks: DataFrame) -> dict[tuple[int, int], tuple[float, int]]:
    """Radius and rows of what lies around each pivot."""
    own = F.when(F.col("cell") < 0, math.pi).otherwise(F.get("hi", F.col("cell")))
    return {(r["length"], r["cell"]): (r["radius"], r["n"]) for r in blocks.groupBy("length", "cell").agg(F.max(own).alias("radius"), F.sum("n").alias("n")).collect()}


def _between(pivots: np.ndarray, a: int, b: int) -> float:
    return 0.0 if a < 0 or b < 0 else float(angles(pivots[a : a + 1], pivots[b : b + 1])[0, 0])


def apart() -> Column:
    """No two members of blocks a and b are closer than this."""
    gaps = F.transform(F.arrays_zip("lo_a", "hi_a", "lo_b", "hi_b"), lambda z: F.greatest(z["lo_a"] - z["hi_b"], z["lo_b"] - z["hi_a"]))
    return F.when((F.col("cell_a") < 0) | (F.col("cell_b") < 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.array_max(gaps), F.lit(0.0))))


def block_pairs(a: DataFrame, b: DataFrame, pivots: dict[int, np.ndarray], bar: float | dict[tuple[int, int], float], upper: bool = False) -> DataFrame:
    """(path_a, path_b, apart) of the pairs of blocks that may hold rows within bar (of all, or of a's rows by length and pivot). upper: a and b are the same blocks, and each pair comes once.

    Pairs of pivots come from the driver, which knows a radius for each; pairs of blocks from a join by pivot.
    """
    spark, of_a, of_b = a.sparkSession, _cells(a), _cells(b)
    most = lambda key: bar if isinstance(bar, float) else bar.get(key, -1.0)
    near = [(length, p, q) for (length, p), (rp, _) in of_a.items() for (other, q), (rq, _) in of_b.items() if length == other and _between(pivots[length], p, q) - rp - rq <= most((length, p)) + SLACK]
    cells = spark.createDataFrame(near, "length int, cell_a int, cell_b int")
    left = a.select("length", F.col("cell").alias("cell_a"), F.col("path").alias("path_a"), F.col("n").alias("n_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), *([F.col("most")] if "most" in a.columns else []))
    right = b.select("length", F.col("cell").alias("cell_b"), F.col("path").alias("path_b"), F.col("n").alias("n_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    pairs = left.join(F.broadcast(cells), ["length", "cell_a"]).join(right, ["length", "cell_b"]).withColumn("apart", apart())
    own = F.col("most") if "most" in a.columns else F.lit(bar)
    pairs = pairs.where(F.col("apart") <= own + SLACK)
    return pairs.where("path_a <= path_b") if upper else pairs


def tasks_for(rows: DataFrame, most: int, scores: int) -> int:
    """As many tasks as the scores are worth, and no fewer than there are cores if there is something for each."""
    return max(1, min(most, max(scores // SCORES, 2 * rows.sparkSession.sparkContext.defaultParallelism)))


def meet(pairs: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(block a, block b) for every pair."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[str, pa.Table]] = {}

        def table(side: str, path: str) -> pa.Table:
            if side not in open_ or open_[side][0] != path:
                open_[side] = path, read_block(path)
            return open_[side][1]

        for batch in batches:
            for a, b in zip(batch.column("path_a").to_pylist(), batch.column("path_b").to_pylist()):
                yield from run(table("a", a), table("b", b)).to_batches()

    size = pairs.agg(F.count("*").alias("pairs"), F.sum(F.col("n_a").cast("long") * F.col("n_b")).alias("scores")).first()
    n = tasks_for(pairs, size["pairs"], size["scores"] or 0)
    dealt = pairs.select("path_a", "path_b").repartitionByRange(n, "path_a", "path_b").sortWithinPartitions("path_a", "path_b")
    return dealt.mapInArrow(each, schema)


def first_bars(queries: DataFrame, nodes: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """The blocks of queries, each now with a column `bar` in its file, the angle within which k nodes are known to be, and `most`, the largest of them: found among as many of the least distant blocks of nodes as hold k rows."""
    of_q, of_n = _cells(queries), _cells(nodes)
    near = []
    for length, p in of_q:
        rows = 0
        for q in sorted((q for other, q in of_n if other == length), key=lambda q: _between(pivots[length], p, q)):
            near.append((length, p, q))
            rows += of_n[length, q][1]
            if rows >= k:
                break
    cells = queries.sparkSession.createDataFrame(near, "length int, cell_a int, cell_b int")
    left = queries.select("length", F.col("cell").alias("cell_a"), F.col("path").alias("path_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = nodes.select("length", F.col("cell").alias("cell_b"), F.col("path").alias("path_b"), F.col("n").alias("n_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    middle = lambda side: F.zip_with(f"lo_{side}", f"hi_{side}", lambda x, y: x + y)
    away = F.aggregate(F.zip_with(middle("a"), middle("b"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = left.join(F.broadcast(cells), ["length", "cell_a"]).join(right, ["length", "cell_b"]).select("path_a", "path_b", "n_b", away.alias("away"))
    before = F.coalesce(F.sum("n_b").over(Window.partitionBy("path_a").orderBy("away", "path_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = pairs.withColumn("before", before).where(F.col("before") < k).groupBy("path_a").agg(F.collect_list("path_b").alias("paths"))
    folder = new_dir(queries.sparkSession, "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, others in zip(batch.column("path_a").to_pylist(), batch.column("paths").to_pylist()):
                q = read_block(path)
                x, best = unit(q), np.full((q.num_rows, k), -2.0)
                for other in others:
                    best = -np.partition(-np.concatenate([best, V.rounded(x @ unit(read_block(other)).T)], 1), k - 1, axis=1)[:, :k]
                bar = np.array([bar_of(s) for s in best[:, k - 1]])
                new = write_block(folder, q.append_column("bar", pa.array(bar)))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([new]), pa.array([float(bar.max())])], ["path", "asked", "most"])

    bars = keep(some.repartition(max(1, min(some.count(), 1024)), "path_a").mapInArrow(run, "path string, asked string, most double"), "bars")
    return queries.join(bars, "path").drop("path").withColumnRenamed("asked", "path").select("length", "cell", "path", "n", "lo", "hi", "most")


def _top(found: pa.Table, floor: np.ndarray, k: int) -> tuple[pa.Table, np.ndarray]:
    """The k best of found (at, score, id) for each `at`, equals by least id, and what a score must have from now on."""
    found = found.take(pc.sort_indices(found, sort_keys=[("at", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
    at = found["at"].to_numpy()
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    floor[at[nth == k - 1]] = np.maximum(floor[at[nth == k - 1]], found["score"].to_numpy()[nth == k - 1] - 1e-9)  # scores are rounded
    return found.filter(pa.array(nth < k)), floor


def reaching(x: np.ndarray, y: np.ndarray, short: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places (i, j) where x[i] @ y[j] is floor[i] or more, and that value. short: y in single precision, which rules out nearly all by a bar lower by more than its error; the others are scored in double precision."""
    slack = (x.shape[1] + 8) * 2.0**-23
    bars, first, out = (floor - slack).astype(np.float32), x.astype(np.float32), []
    for at in range(0, len(x), ROWS):
        cut = slice(at, at + ROWS)
        i, j = np.divmod(np.flatnonzero(first[cut] @ short.T >= bars[cut, None]), len(y))
        score = (x[cut] @ y.T)[i, j] if len(i) > PAIRS * ROWS else np.einsum("ij,ij->i", x[cut][i], y[j])
        good = score >= floor[cut][i]
        out.append((i[good] + at, j[good], score[good]))
    return tuple(np.concatenate(c) for c in zip(*out))


def best(pairs: DataFrame, k: int, least: float | None, schema: str) -> DataFrame:
    """Of each query the k best nodes in each share of the blocks of nodes. A block of queries goes through those of a share one after the other, nearest first, with the bar of each query rising, until no other can hold an answer."""
    sized = pairs.agg(F.sum(F.col("n_a").cast("long") * F.col("n_b")).alias("scores"), F.count_distinct("path_b").alias("blocks")).first()
    share = F.pmod(F.xxhash64("path_b"), F.lit(max(1, -(-sized["blocks"] // SHARE))))
    groups = keep(pairs.groupBy(share.alias("share"), "path_a").agg(F.sort_array(F.collect_list(F.struct("apart", "path_b"))).alias("others")), "shares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, tuple[pa.Array, np.ndarray, np.ndarray]] = OrderedDict()

        def opened(path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            if path not in held:
                table = read_block(path)
                y = unit(table)
                held[path] = table["id"].combine_chunks(), y, y.astype(np.float32)
                while len(held) > 1 and sum(y.nbytes + short.nbytes for _, y, short in held.values()) > OPEN:
                    held.popitem(last=False)
            held.move_to_end(path)
            return held[path]

        for batch in batches:
            for path, others in zip(batch.column("path_a").to_pylist(), batch.column("others").to_pylist()):
                q = read_block(path)
                x, found = unit(q), None
                floor = np.cos(np.minimum(np.array(q["bar"]), math.pi)) - 1e-6
                if least is not None:
                    floor = np.maximum(floor, least - 1e-9)
                for other in others:
                    if other["apart"] > bar_of(float(floor.min())) + SLACK:
                        break
                    ids, y, short = opened(other["path_b"])
                    i, j, score = reaching(x, y, short, floor)
                    score = V.rounded(score)
                    if least is not None:
                        i, j, score = (c[score >= least] for c in (i, j, score))
                    if len(i):
                        new = pa.table({"at": i, "score": score, "id": ids.take(pa.array(j))})
                        found, floor = _top(new if found is None else pa.concat_tables([found, new]), floor, k)
                if found is not None:
                    at = found["at"].combine_chunks()
                    yield from pa.table({"ask": q["ask"].take(at), "query_id": q["id"].take(at), "id": found["id"], "score": found["score"]}).combine_chunks().to_batches()

    n = tasks_for(pairs, groups.count(), sized["scores"] or 0)
    return groups.repartitionByRange(n, "share", "path_a").sortWithinPartitions("share", "path_a").mapInArrow(run, schema)


def nearest(asked: DataFrame, rows: DataFrame, k: int | None, least: float | None, block: int = V.BLOCK) -> DataFrame:
    """(ask, query_id, id, score) as vector.scores() gives them; asked: ask, id, vector; rows: id, vector."""
    q, n = (keep(usable(x), "vectors") for x in (asked, rows))
    sizes = keep(q.select("length").distinct(), "lengths")
    n = n.join(F.broadcast(sizes), "length", "left_semi").select("id", "vector", "length")
    pivots = pivots_of(n, block)
    q = q.where(F.col("length").isin(*pivots)) if pivots else q.limit(0)
    kind, node_kind = dict(asked.dtypes)["id"], dict(rows.dtypes)["id"]
    a, b = index(q.select("ask", "id", "vector", "length"), pivots, block), index(n, pivots, block)
    schema = f"ask bigint, query_id {kind}, id {node_kind}, score double"
    if k is not None:
        a = first_bars(a, b, pivots, k)
        bars = {(r["length"], r["cell"]): r["most"] for r in a.groupBy("length", "cell").agg(F.max("most").alias("most")).collect()}
        bar = {key: min(most, bar_of(least)) if least is not None else most for key, most in bars.items()}
        return best(block_pairs(a, b, pivots, bar), k, least, schema)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        score = V.rounded(unit(x) @ unit(y).T)
        i, j = np.nonzero(score >= least)
        return pa.table({"ask": x["ask"].take(i), "query_id": x["id"].take(i), "id": y["id"].take(j), "score": pa.array(score[i, j])})

    return meet(block_pairs(a, b, pivots, bar_of(least)), run, schema)  # zero vectors score 0 with all: their blocks meet every block


def join(a: DataFrame, b: DataFrame, least: float, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = V.BLOCK, upper: bool = False) -> DataFrame:
    """run(some rows of a, some rows of b) so that every two rows (id, vector, ...) at a cosine of least or more are together once. upper: a and b are the same rows, and each pair of blocks meets once."""
    if all(x.limit(block + 1).count() <= block for x in ((a,) if upper else (a, b))):
        return V.meet(a, b, run, schema, block=block, upper=upper)
    left = keep(usable(a), "vectors")
    right = left if upper else keep(usable(b), "vectors")
    pivots = pivots_of(right, block)
    if not pivots:
        return a.sparkSession.createDataFrame([], schema)
    blocks = index(left.where(F.col("length").isin(*pivots)), pivots, block)
    return meet(block_pairs(blocks, blocks if upper else index(right, pivots, block), pivots, bar_of(least), upper), run, schema)
