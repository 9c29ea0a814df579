"""Pruned cosine search and joins: the same as comparing everything, and on clustered vectors hardly anything is compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import angles as A
from heliograph.functions import vector as V

RNG = np.random.default_rng(12)


def clustered(n=1500, clusters=30, width=24, spread=0.05):
    centres = RNG.normal(size=(clusters, width))
    return centres[RNG.integers(0, clusters, n)] + spread * RNG.normal(size=(n, width))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)


def cosines(x, y):
    u = [np.divide(v, n := np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=n > 0) for v in (x, y)]
    return np.round(u[0] @ u[1].T, 9)


def best(score, k, least):
    out = set()
    for q, row in enumerate(score):
        order = sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]
        out |= {(q, j, round(float(row[j]), 8)) for j in order if least is None or row[j] >= least}
    return out


@pytest.mark.parametrize("kind, block, k, least", [
    ("clusters", 64, 5, None), ("plain", 64, 3, 0.5), ("zeros", 64, 5, None), ("zeros", 64, None, 0.9), ("plain", 4096, 5, None), ("zeros", 4096, 3, 0.5), ("clusters", 4096, None, 0.9),
])
def test_search_is_exact(spark, kind, block, k, least):
    x = clustered(400) if kind != "plain" else RNG.normal(size=(400, 8))
    q = x[:150] + (0.02 * RNG.normal(size=x[:150].shape) if kind == "plain" else 0)
    if kind == "zeros":
        x[5] = x[17] = q[3] = 0
        x[40:60] = x[40]
    found = V.scores(frame(spark, q), frame(spark, [*x, None, [1.0]]), k, least, block).collect()
    want = best(cosines(q, x), k or 400, least)
    assert {(r["query_id"], r["id"], round(r["score"], 8)) for r in found} == want and len(found) == len(want)


def test_search_of_several_lengths_and_repeated_rows(spark):
    x = [*RNG.normal(size=(90, 6)), *RNG.normal(size=(60, 3)), None, [float("nan")] * 3]
    rows = frame(spark, x)
    twice = rows.unionByName(rows)
    for block in (4096, 20):
        found = V.scores(rows, twice, 2, None, block).where("query_id = id").groupBy("id").count().collect()
        assert {r["id"]: r["count"] for r in found} == {i: 2 for i in range(150)}
        assert V.scores(rows.limit(0), rows, 2, None, block).count() == V.scores(rows, rows.limit(0), 2, None, block).count() == 0
    with pytest.raises(ValueError):
        V.scores(rows, rows)


def test_large_and_small_components(spark):
    d = spark.createDataFrame([(1, [1e200, 1.0], [1.0, 0.0]), (2, [1e-200, 0.0], [1e200, 1e200]), (3, [0.0, 0.0], [1.0, 1.0])], "id int, a array<double>, b array<double>")
    got = {r["id"]: r["s"] for r in d.select("id", V.cosine("a", "b").alias("s")).collect()}
    assert got[1] == pytest.approx(1) and got[2] == pytest.approx(0.5**0.5) and got[3] == 0
    rows = frame(spark, [[1e200, 1.0], [1.0, 0.0]])
    assert {r["score"] for r in V.scores(rows, rows, 2).collect()} == {1.0}


def pairs_of(rows, block, least):
    v = A.usable(rows)
    pivots = A.pivots_of(v, block)
    blocks = A.index(v, pivots, block)
    n = blocks.count()
    return blocks, A.block_pairs(blocks, blocks, pivots, A.bar_of(least), upper=True).count(), n * (n + 1) // 2


def test_clustered_vectors_are_hardly_compared(spark):
    x = clustered(3000, 40, 32)
    blocks, met, all_ = pairs_of(frame(spark, x), 50, 0.9)
    assert blocks.agg(F.sum("n")).first()[0] == 3000 and blocks.agg(F.max("n")).first()[0] <= 50
    assert met < 0.1 * all_, (met, all_)
    links = {(r["src"], r["dst"]) for r in V.connections(frame(spark, x), 0.9, 50).collect()}
    parent = list(range(3000))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[top(a)] = top(b)
    got = [top(i) for i in range(3000)]
    near = cosines(x, x) >= 0.9
    assert all(near[a, b] for a, b in list(links)[:2000])  # not all pairs, but no wrong ones
    label = np.arange(3000)
    while True:
        new = np.array([label[near[i]].min() for i in range(3000)])
        if (new == label).all():
            break
        label = new
    assert len(set(zip(got, label.tolist()))) == len(set(got)) == len(set(label.tolist()))


def test_top_k_opens_few_blocks_of_clustered_vectors(spark):
    x = clustered(3000, 40, 32)
    asked = A.usable(frame(spark, x[:600]).withColumn("ask", F.col("id")))
    rows = A.usable(frame(spark, x))
    pivots = A.pivots_of(rows, 50)
    a, b = A.index(asked.select("ask", "id", "vector", "length"), pivots, 50), A.index(rows, pivots, 50)
    bars = A.first_bars(a, b, pivots, 5)
    assert bars.count() == a.count() and bars.where("most > 3").count() == 0
    most = {(r["length"], r["cell"]): r["m"] for r in bars.groupBy("length", "cell").agg(F.max("most").alias("m")).collect()}
    met = A.block_pairs(bars, b, pivots, most)
    assert met.count() < 0.1 * a.count() * b.count()


def test_single_precision_rules_out_nothing_that_counts():
    """Bars at the very values, next to them, and so low that every pair counts."""
    x, y = (V._units(RNG.normal(size=(n, 48))) for n in (600, 500))
    y[:50], y[50:60] = x[:50], 0
    exact = x @ y.T
    for floor in (np.sort(exact, 1)[:, -5], np.sort(exact, 1)[:, -5] + 1e-9, np.full(600, -2.0), np.full(600, 2.0)):
        i, j, score = A.reaching(x, y, y.astype(np.float32), floor - 1e-12)
        want = np.nonzero(exact >= floor[:, None] - 1e-12)
        assert np.array_equal(i, want[0]) and np.array_equal(j, want[1])
        assert np.abs(score - exact[want]).max(initial=0) < 1e-14


def test_no_pair_within_the_bar_is_ruled_out(spark):
    x = np.concatenate([clustered(300, 6, 5, 0.3), np.zeros((3, 5))])
    v = A.usable(frame(spark, x))
    pivots = A.pivots_of(v, 20)
    blocks = A.index(v, pivots, 20)
    of = {}
    for r in blocks.collect():
        of.update(dict.fromkeys(A.read_block(r["path"])["id"].to_pylist(), r["path"]))
    assert sorted(of) == list(range(303))
    met = {(r["path_a"], r["path_b"]) for r in A.block_pairs(blocks, blocks, pivots, A.bar_of(0.8)).collect()}
    assert all((of[i], of[j]) in met for i, j in np.argwhere(cosines(x, x) >= 0.8).tolist())


def test_tasks_follow_the_scores_and_equals_stay_few(spark):
    """A few tasks for little work, however many pairs of blocks there are; of a crowd of equal nodes a query gets the k least ids of each share."""
    x = RNG.normal(size=(400, 8))
    x[100:] = x[100]
    asked = frame(spark, x[:120]).withColumn("ask", F.col("id"))
    found = A.nearest(asked, frame(spark, x), 3, None, 20)
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert found.groupBy("ask").count().agg(F.max("count")).first()[0] <= 3 * -(-20 // A.SHARE) * 2
    got = {(r["query_id"], r["id"]) for r in V.scores(asked.select("id", "vector"), frame(spark, x), 3, None, 20).where("query_id >= 100").collect()}
    assert got == {(q, j) for q in range(100, 120) for j in (100, 101, 102)}
