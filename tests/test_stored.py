"""The stored graph: the same answers without a shuffle; counters that follow changes."""

import random

import pytest
from pyspark.sql import functions as F

from heliograph import stored
from heliograph.graph import Graph
from heliograph.operators import aggregates as A
from heliograph.operators import state as U


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    nodes = spark.createDataFrame([(f"p{i}", 1990 + i % 7) for i in range(200)], "id string, year int").repartition(3)
    edges = spark.createDataFrame([(f"p{rng.randrange(150)}", f"p{rng.randrange(200)}") for _ in range(900)], "src string, dst string").repartition(5)
    return Graph({"paper": nodes}, {"cites": edges})


def plan(df):
    df.collect()  # the plan that ran
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def rows(df):
    return sorted(map(str, df.collect()))


def test_counts_hops_and_existence_without_a_shuffle(spark, graph):
    s = stored.save(graph, {"cites": {"dst": ("paper", ["year"]), "src": ("paper", ["year"])}}, buckets=5)
    for g in (s, stored.open_graph(spark, s.path)):
        counts = g.degree_counts("paper", "cites")
        assert rows(counts) == rows(A.degree_counts(graph.nodes["paper"], graph.edges["cites"]))
        one = graph.edges["cites"].distinct()
        far = graph.nodes["paper"].select(F.col("id").alias("dst"), F.col("year").alias("dst_year"))
        hop = g.hop("paper", "cites").select("id", "year", "dst", "dst_year")
        assert rows(hop) == rows(graph.nodes["paper"].join(one.withColumnRenamed("src", "id"), "id").join(far, "dst").select("id", "year", "dst", "dst_year"))
        older = hop.groupBy("id").agg(F.count_if(F.col("dst_year") < F.col("year")).alias("n"))
        idle = g.exists("paper", "cites", "dst", negate=True)
        assert rows(idle.select("id")) == rows(graph.nodes["paper"].join(one.select(F.col("dst").alias("id")), "id", "left_anti").select("id"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            for df in (counts, older, idle):
                again = df.select("*")
                assert "Exchange" not in plan(again), plan(again)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counters_follow_mixed_changes(spark):
    rng = random.Random(8)
    edges = spark.createDataFrame(sorted({(rng.randrange(30), rng.randrange(12)) for _ in range(120)}), "src long, dst long").withColumn("note", F.lit("old"))
    nodes = spark.range(14)
    for _ in range(3):
        changes = [(rng.randrange(30), rng.randrange(12), rng.random() < 0.5, k, f"new{k}") for k in range(80)]
        frame = spark.createDataFrame(changes, "src long, dst long, linked boolean, ordinal int, note string")
        counted = U.with_counter(nodes, edges, "n")
        after, deltas = U.edge_changes(edges, frame)
        now = {(r["src"], r["dst"]): r["note"] for r in edges.collect()}
        was = set(now)
        for s, d, linked, _, note in changes:
            if linked:
                now.setdefault((s, d), note)
            else:
                now.pop((s, d), None)
        got = {(r["src"], r["dst"]): r["note"] for r in after.collect()}
        assert set(got) == set(now) and all(got[e] == "old" or got[e].startswith("new") for e in got)
        assert {(r["src"], r["dst"]): r["delta"] for r in deltas.collect()} == {**dict.fromkeys(set(now) - was, 1), **dict.fromkeys(was - set(now), -1)}
        assert rows(U.add_to_counter(counted, deltas, "n").select("id", "n")) == rows(U.with_counter(nodes, after, "n").select("id", "n"))
        edges = spark.createDataFrame([(*e, "old") for e in now], "src long, dst long, note string")
    none = spark.createDataFrame([], "src long, dst long, linked boolean, ordinal int")
    after, deltas = U.edge_changes(edges, none)
    assert after.count() == edges.count() and deltas.count() == 0
