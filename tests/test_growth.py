"""What steps hold, send or compare as their input grows."""

import itertools

from pyspark.sql import functions as F

from heliograph.operators import match as M
from heliograph.operators import search as S
from heliograph.scratch import options_for
from heliograph.sources import papers as P
from heliograph.sources import surrogate


def most_rows(df):
    """Of the operators in the plan of df, after it ran, the most rows that one gave."""
    df.collect()
    worst, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if p.metrics().contains("numOutputRows"):
                worst = max(worst, p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(k) for k in range(p.children().size())]
    return worst


def boosts(spark, mentions, cites, of):
    return S.citation_boost(spark.createDataFrame(mentions, "id string, paper string"), spark.createDataFrame(cites, "src string, dst string"), spark.createDataFrame(of, "src string, concept string"))


def test_boosts_are_those_of_all_pairs_of_mentions(spark):
    mentions = [(f"m{k}", f"p{k * k % 7}") for k in range(12)] + [("m3", "p0"), ("m4", "p5"), ("m1", "p1"), ("m20", "p9"), ("m21", "p9"), ("m22", "p8")]
    cites = [("p1", "p1"), ("p9", "p9"), ("p8", "p8"), ("p0", "p2"), ("p2", "p4"), ("p4", "p0"), ("p0", "p2"), ("p5", "p5"), ("p8", "p4")]
    of = [(f"m{k}", f"c{k % 3}") for k in range(23)] + [("m5", "c0"), ("m20", "c9")]
    want = {(a, c) for (a, p), (b, q), (x, c) in itertools.product(mentions, mentions, of) if a != b and b == x and (p, q) in cites}
    got = [(r["mention"], r["concept"]) for r in boosts(spark, mentions, cites, of).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("m20", "c9") not in want and ("m3", "c0") in want


def test_boosts_do_not_join_mentions_with_mentions(spark):
    n = 300
    df = boosts(spark, [(f"a{k}", "p") for k in range(n)] + [(f"b{k}", "q") for k in range(n)], [("p", "q")], [(f"{x}{k}", "c") for x in "ab" for k in range(n)])
    assert df.count() == n and most_rows(df) <= 4 * n


def test_authors_without_an_id_do_not_meet_in_one_task(spark):
    rows = spark.range(4000).select(F.lit("d").alias("doi"), F.col("id").alias("position"), F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).alias("orcid"))
    known = spark.createDataFrame([("100", "A")], "orcid string, id2 string")
    with options_for(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        found = P.told_by(rows, "orcid", known, F.concat_ws("/", "doi", F.col("position").cast("string")))
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
        assert [(r["position"], r["id2"]) for r in found.where("id2 is not null").collect()] == [(100, "A")]


def test_near_pairs_within_keys_are_found_for_many_keys_at_once(spark, monkeypatch):
    from heliograph.functions import vector as V

    rows = [(k % 7, f"k{k % 5}", k % 3, [float(k % 4 == j) for j in range(4)] if k % 11 else None) for k in range(35)] + [(k, "big", k % 2, [1.0, k % 3 / 100]) for k in range(12)]
    want = sorted((p, a, b) for a, p, r, v in rows for b, q, s, w in rows if p == q and r < s and v and w and sum(x * y for x, y in zip(v, w)) >= 0.9)
    called = []
    meet = V.meet
    monkeypatch.setattr(V, "meet", lambda q, *a, **b: called.append(q.count()) or meet(q, *a, **b))
    got = V.near_within(spark.createDataFrame(rows, "id long, paper string, rank int, vector array<double>"), "paper", 0.9, block=8)
    assert sorted((r["paper"], r["id"], r["other"]) for r in got.collect()) == want and called == [12]  # only the key of more than a block


def test_merging_holds_only_the_names_that_stay(spark):
    from heliograph.operators import resolve as E

    canon = spark.createDataFrame([(1, "n002", ["z", " "])], "id long, name string, aliases array<string>")
    incoming = spark.range(2000).selectExpr("id % 2 + 1 AS id", "format_string('n%03d', id DIV 2 % 1000) AS name", "array(CAST(NULL AS STRING), 'a', ' ') AS aliases", "id AS ordinal")
    merged = E.merge_into(canon, incoming, most_aliases=4)
    assert [r["aliases"] for r in merged.collect()] == [["a", "n000", "n001", "n003"]]
    plan = merged._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "collect_set" not in plan


def test_a_search_orders_only_the_edges_of_its_front(spark):
    """200 edges at the front and 100 000 elsewhere, of which no exchange gets any; the same nodes as when all are ranked."""
    far = spark.range(100_000).select(F.concat(F.lit("x"), "id").alias("src"), F.concat(F.lit("y"), "id").alias("dst"))
    edges = spark.createDataFrame([("a", f"b{k % 150:03}") for k in range(200)], "src string, dst string").unionByName(far)
    context = spark.sparkContext
    context.setJobGroup("front", "front")
    found = M.bfs(edges, spark.createDataFrame([("a",)], "id string"), 2, "both", fan_out=3).collect()
    stages = [s for j in context.statusTracker().getJobIdsForGroup("front") for s in context.statusTracker().getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    store = context._jsc.sc().statusStore()
    read = [store.lastStageAttempt(s).shuffleReadRecords() for s in stages]
    assert {(r["id"], r["depth"]) for r in found} == {("a", 0), ("b000", 1), ("b001", 1), ("b002", 1)}
    assert max(read) < 1000


def test_edges_at_ids_are_read_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("c", "a"), ("c", "d"), ("a", "b")], "src string, dst string")
    seen = spark.sparkContext.accumulator(0)
    counted = edges.rdd.map(lambda r: (seen.add(1), r)[1]).toDF(edges.schema)
    got = sorted(tuple(r) for r in M.around(counted, spark.createDataFrame([("a",)], "id string")).collect())
    assert got == [("a", "a", "outgoing"), *[("a", "b", "incoming")], *[("a", "b", "outgoing")] * 2, ("a", "c", "incoming")]
    assert seen.value == 6


def test_tasks_over_lines_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(surrogate, "TASK_ROWS", 64)
    assert [surrogate.tasks_for(spark.range(n)) for n in (0, 8, 64, 1024)] == [1, 1, 4, 16]
