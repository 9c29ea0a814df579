"""Edge cases of the operators: nulls, ties, cycles, empty tables, thresholds met exactly."""

import pytest
from pyspark.sql import functions as F

from heliograph.functions import scalars as X
from heliograph.functions import text as T
from heliograph.functions import vector as V
from heliograph.graph import Graph
from heliograph.operators import aggregates as A
from heliograph.operators import match as M
from heliograph.operators import reads as R
from heliograph.operators import resolve as E
from heliograph.operators import review as Q
from heliograph.operators import search as S
from heliograph.operators import state as U
from heliograph.sources import papers as P


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_bfs_finds_each_node_once_in_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert got(M.bfs(e, start, 5), "id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert got(M.bfs(e, start, 1, "in"), "id", "depth") == [("a", 0), ("c", 1)]
    assert got(M.bfs(e.limit(0), start, 2, "both"), "id", "depth") == [("a", 0)]


def test_around_counts_a_self_loop_once(spark):
    e = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "src string, dst string")
    assert got(M.around(e, spark.createDataFrame([("a",)], "id string")), "other", "direction") == [("a", "outgoing"), ("b", "outgoing"), ("c", "incoming")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = dict(got(M.components(spark.createDataFrame(chain, "src long, dst long")), "id", "component"))
    assert {found[i] for i in range(41)} == {0} and found[102] == 100 and len(found) == 44
    assert M.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pages_put_nulls_first_in_descending_order(spark):
    p = spark.createDataFrame([("a", 2000), ("b", None), ("c", 2001)], "id string, year int")
    assert [r["id"] for r in R.page(p, F.col("year").desc_nulls_first(), F.col("id"), limit=2).collect()] == ["b", "c"]


def test_topic_of_a_name_is_the_deepest(spark):
    t = spark.createDataFrame([("1", "x", "domain"), ("3", "x", "subtopic"), ("2", "x", "subtopic")], "id string, name string, level string")
    assert got(R.topics_by_name(t), "id") == [("2",)]


def test_cosine_and_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [0.0, 1.0])], "id long, vector array<double>")
    same = v.where("id <> 3").select("id", V.cosine("vector", F.array(F.lit(1.0), F.lit(0.0))).alias("c"))
    assert got(same, "id", "c") == [(1, 1.0), (2, 0.0), (4, 1.0), (5, 0.0)]
    found = V.scores(v.where("id in (1, 3)"), v, 2)
    assert got(found, "query_id", "id", "score") == [(1, 1, 1.0), (1, 4, 1.0)]
    assert V.scores(v.limit(0), v, 2).count() == 0
    many = V.scores(v.where("id <> 3"), v, 1, block=1)
    assert many.count() == 4


def test_thresholds_hold_when_met_exactly(spark):
    for score, want in ((0.95, "high"), (0.9499, "medium"), (0.8, "medium"), (0.5, "low"), (0.4999, "rejected")):
        assert one(spark, S.confidence(F.lit(score))) == want
    assert [one(spark, Q.priority(F.lit(x).cast("double"))) for x in (None, 1.0, 0.0, 0.5)] == [10, 5, 10, 7]
    assert [one(spark, S.arbiter_route(F.lit(d), F.lit(c), F.lit(r))) for d, c, r in (("link", 0.9, 1), ("link", 0.5, 1), ("link", 0.5, 3), ("retry", 0.9, 3))] == ["link", "retry", "human_review", "link"]


def test_boosted_candidates_keep_their_raw_confidence(spark):
    f = spark.createDataFrame([("q", "a", 0.85), ("q", "b", 0.7)], "query_id string, id string, score double")
    b = spark.createDataFrame([("q", "b", 0.2)], "mention string, concept string, boost double")
    assert got(S.routes(S.candidates(f, b)), "id", "confidence", "route") == [("b", "low", "debate")]


def test_citation_boost(spark):
    m = spark.createDataFrame([("m1", "p1"), ("m2", "p2"), ("m3", None)], "id string, paper string")
    c = spark.createDataFrame([("p1", "p2"), ("p2", "p2")], "src string, dst string")
    i = spark.createDataFrame([("m2", "k")], "src string, concept string")
    assert got(S.citation_boost(m, c, i), "mention", "concept") == [("m1", "k")]


def test_sweep_has_zero_on_empty_denominators(spark):
    p = spark.createDataFrame([(0.9, True), (0.5, False), (0.5, True)], "score double, same boolean")
    s = A.threshold_sweep(p, [0.5, 0.95])
    assert got(s, "tp", "fp", "tn", "fn") == [(0, 0, 1, 2), (2, 1, 0, 0)]
    assert got(A.recommended(s), "threshold") == [(0.5,)]
    assert A.recommended(A.threshold_sweep(p.limit(0), [0.5])).count() == 0


def test_completeness_of_blanks(spark):
    p = spark.createDataFrame([("a,, b",), (None,), ("",), ("a",)], "failed_extractors string")
    assert got(A.completeness(p), "extractor", "share") == [("a", 0.5), ("b", 0.25)]


def test_sections_at_the_first_and_last_line(spark):
    body = " ".join(["word"] * 25)
    d = spark.createDataFrame([(1, f"Abstract\n{body}\n2. Related Work\n{body} end\nReferences"), (2, None), (3, ""), (4, "no heading")], "doc_id long, text string")
    assert got(T.segment(d), "doc_id", "section_type") == [(1, "abstract"), (1, "related_work"), (3, "unknown"), (4, "unknown")]


def test_text_functions(spark):
    assert one(spark, T.dehyphenate(F.lit("neu-\n  ral café-\nx Up-\nDown"))) == "neural caféx Up-\nDown"
    assert one(spark, T.dehyphenate(F.lit("a-\nb-\nc -\nd e--\nf"))) == "ab-\nc -\nd e--\nf"
    assert one(spark, T.clean(F.lit(" a\n\n\n\nlonger   line\t \nab\nCONFIDENTIAL 12\n"), drop=lambda x: x.rlike(r"^CONF"))) == "longer line"
    assert one(spark, T.jaccard(F.lit("A b  c"), F.lit("a d"))) == 0.25
    assert one(spark, T.jaccard(F.lit(""), F.lit(" "))) == 0.0
    assert one(spark, T.section_type(F.lit(" 3.  Limitations "))) == "limitations"
    assert one(spark, T.section_type(F.lit("Limitations of this"))) is None


def test_alias_links_are_whole_words(spark):
    m = spark.createDataFrame([(1, "p", "We use B.E.R.T here"), (2, "p", "robertson"), (3, "q", "roberta")], "mention_id long, p string, text string")
    e = spark.createDataFrame([("x", "p", ["roberta"]), ("y", "p", ["b.e.r.t"]), ("z", "p", [])], "entity_id string, p string, surfaces array<string>")
    assert got(T.alias_links(m, e, "p"), "mention_id", "entity_id") == [(1, "y")]


def test_identifiers(spark):
    cases = {"10.1234/x": "doi", " doi:1": "doi", "arXiv:1": "arxiv", "2106.01345v2": "arxiv", "hep-th/9901001": "arxiv", "w12": "openalex", "a" * 40: "semantic_scholar", "A" * 40: "semantic_scholar", "g" * 40: None, "": None}
    for value, want in cases.items():
        assert one(spark, P.identifier_type(F.lit(value))) == want, value
    assert one(spark, P.preprint_id(F.lit("https://arxiv.org/abs/2106.01345"))) == "2106.01345"
    assert one(spark, P.preprint_id(F.lit("none"))) == "none"


def test_abstract_with_gaps_and_clashes(spark):
    d = spark.createDataFrame([({"b": [2, 0], "a": [5]},), ({"x": []},), (None,), ({"p": [0], "q": [0]},)], "m map<string,array<int>>")
    texts = [r[0] for r in d.select(P.abstract_of(F.col("m"))).collect()]
    assert texts[0] == "b b a" and texts[1] is None and texts[2] is None and texts[3] in ("p", "q")


def test_insert_rejects_known_statements_and_ids(spark):
    s = spark.createDataFrame([("1", "Alpha problem")], "id string, statement string")
    d = spark.createDataFrame([("2", " alpha PROBLEM ", 0), ("3", "Beta", 1), ("4", "beta", 2), ("1", "Gamma", 3)], "id string, statement string, ordinal int")
    new, bad = U.insert(s, d)
    assert got(new, "id") == [("1",), ("3",)] and got(bad, "id") == [("1",), ("2",), ("4",)]


def test_upsert_takes_no_parent_as_equal(spark):
    t = spark.createDataFrame([("1", "x", "domain", None, "old")], "id string, name string, level string, parent_id string, description string")
    d = spark.createDataFrame([("x", "domain", None, None), ("x", "area", "1", "new")], "name string, level string, parent_id string, description string")
    assert got(U.upsert_topics(t, d), "level", "description") == [("area", "new"), ("domain", "old")]


def test_links_are_counted_once(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    new = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "zz")], "src string, dst string")
    linked = U.link(U.link(e, new, n, n), new, n, n)
    assert got(U.with_counter(n, linked, "k"), "id", "k") == [("a", 1), ("b", 1)]
    assert got(U.with_counter(n, U.unlink(linked, new), "k"), "id", "k") == [("a", 0), ("b", 0)]


def test_promote_overwrites_stubs_only(spark):
    p = spark.createDataFrame([("1", "stub", 3, True), ("2", "real", 4, False)], "doi string, title string, citation_count int, is_stub boolean")
    f = spark.createDataFrame([("1", "full"), ("2", "other"), ("3", "new")], "doi string, title string")
    assert got(U.promote(p, f), "doi", "title", "citation_count") == [("1", "full", 3), ("2", "real", 4), ("3", "new", None)]


def test_purge_keeps_what_other_mentions_share(spark):
    n = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    e = lambda *pairs: spark.createDataFrame(pairs, "src string, dst string")
    g = Graph({"m": n("m1", "m2"), "c": n("c1", "c2")}, {"from": e(("m1", "p1"), ("m2", "p2")), "of": e(("m1", "c1"), ("m1", "c2"), ("m2", "c1")), "more": e(("c1", "t"))})
    left, shared = U.purge(g, spark.createDataFrame([("p1",)], "doi string"), "m", "c", "from", "of")
    assert got(left.nodes["m"], "id") == [("m2",)] and got(left.nodes["c"], "id") == [("c1",)]
    assert got(left.edges["of"], "src", "dst") == [("m2", "c1")] and got(shared, "kind", "src") == [("more", "c1")]


def test_collisions_need_two_kinds(spark):
    e = spark.createDataFrame([("p", "model", "BERT", ["x"]), ("p", "method", "other", ["bert "]), ("p", "concept", "Solo", None), ("q", "model", "solo", [])], "paper string, kind string, name string, aliases array<string>")
    assert [(r["surface"], r["kinds"], r["exact"]) for r in E.collisions(e).collect()] == [("bert", ["method", "model"], True)]


def test_reviews(spark):
    m = spark.createDataFrame([("m1",), ("m2",)], "id string")
    s = spark.createDataFrame([("m1", f"c{i}", 0.9 - i / 10) for i in range(7)], "query_id string, id string, score double")
    r = Q.enqueue(m, s, F.lit("2024-01-01").cast("timestamp"))
    rows = {x["mention_id"]: x for x in r.collect()}
    assert len(rows["m1"]["suggested"]) == 5 and rows["m1"]["suggested"][0]["id"] == "c0" and rows["m2"]["priority"] == 10 and rows["m2"]["suggested"] is None
    d = spark.createDataFrame([("m1", "linked", None, "u"), ("m2", "rejected", None, "u")], "mention_id string, resolution string, concept_id string, resolved_by string")
    assert got(Q.resolve(r, d), "mention_id", "status") == [("m1", "pending"), ("m2", "resolved")]


def test_rows_of_one_key_multiply_nothing(spark):
    t = spark.createDataFrame([("1", "x", "domain", None, "old")], "id string, name string, level string, parent_id string, description string")
    d = spark.createDataFrame([("x", "domain", None, "a", 1), ("x", "domain", None, "b", 2), ("x", "domain", None, None, 3), ("y", "area", "1", "n", 1), ("y", "area", "1", "n", 2)], "name string, level string, parent_id string, description string, ordinal int")
    assert got(U.upsert_topics(t, d), "name", "description") == [("x", "b"), ("y", "n")]
    p = spark.createDataFrame([("1", "stub", True)], "doi string, title string, is_stub boolean")
    f = spark.createDataFrame([("1", "full", 1), ("1", "fuller", 2), ("3", "new", 1), ("3", "new", 2)], "doi string, title string, ordinal int")
    assert got(U.promote(p, f), "doi", "title") == [("1", "fuller"), ("3", "new")]
    r = spark.createDataFrame([("m", "pending")], "mention_id string, status string")
    e = spark.createDataFrame([("m", "rejected", None, "u", 1), ("m", "linked", "c", "w", 2), ("m", "linked", None, "x", 3)], "mention_id string, resolution string, concept_id string, resolved_by string, ordinal int")
    assert got(Q.resolve(r, e), "status", "resolution", "concept_id", "resolved_by") == [("resolved", "linked", "c", "w")]
    assert got(U.patch(r.withColumn("version", F.lit(1)), e.select("mention_id", F.col("resolution").alias("status")), "mention_id"), "status", "version") == [("rejected", 2)]


def test_merging_many_into_one(spark):
    c = spark.createDataFrame([(1, "a", ["z"], None, False, [1.0]), (2, "b", None, "kept", True, None), (3, "c", [], "", None, None)], "id long, name string, aliases array<string>, architecture string, is_canonical boolean, vector array<double>")
    i = spark.createDataFrame([(1, "n1", None, "", False, 1), (1, "n2", ["y", " "], "first", True, 2), (1, "n3", None, "second", True, 3), (2, "b", ["b"], "other", True, 1), (9, "lost", None, None, True, 1)], "id long, name string, aliases array<string>, architecture string, is_canonical boolean, ordinal int")
    rows = got(E.merge_into(c, i), "id", "name", "aliases", "architecture", "is_canonical", "vector")
    assert rows == [(1, "n2", ["a", "n1", "n3", "y", "z"], "first", True, [1.0]), (2, "b", [], "kept", True, None), (3, "c", [], "", False, None)]
    assert got(E.merge_into(c, i, most_aliases=2).where("id = 1"), "aliases") == [(["a", "n1"],)]
    assert E.merge_into(c, i.limit(0)).count() == 3 and E.merge_into(c.limit(0), i).count() == 0


def test_scores_of_repeated_queries_and_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0]), (4, [0.1, 1.0])], "id long, vector array<double>")
    found = got(V.scores(v.where("id = 1"), v.where("id <> 1"), 1), "query_id", "id")
    assert found == [(1, 2), (1, 4)]  # one answer for each different vector
    assert got(V.scores(v, v, 1, block=2).where("query_id = 3"), "id") == [(3,)]
    bins = {(r["same"], r["bin"]): r["n"] for r in V.score_bins(v.withColumn("label", F.col("id") % 2), v.withColumn("label", F.col("id") % 2), [0.5, 0.99], 2).collect()}
    assert sum(bins.values()) == 5 * 5 - 9 - 2  # of two numbers: all pairs but those of one id


def test_sections_of_repeated_and_null_keys(spark):
    body = " ".join(["word"] * 25)
    rows = [(1, f"Abstract\n{body}"), (1, f"Introduction\n{body}"), (None, f"1. Methods\n{body}"), (None, "plain")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(T.segment(d), "doc_id", "section_type") == [(1, "abstract"), (1, "introduction"), (None, "methods"), (None, "unknown")]
    lead = spark.createDataFrame([(5, f"ABSTRACT - {body}\n1. Introduction\n{body} more"), (6, f"Abstract: too short\nIntroduction\n{body}")], "doc_id long, text string")
    assert got(T.segment_with_abstract(lead), "doc_id", "section_type", "start_char") == [(5, "abstract", 0), (5, "introduction", 12 + len(body)), (6, "introduction", 20)]
    kinds = {"2 Our proposed Framework": "methods", "Results and  Discussion": "results", "Appendix B": "appendix", "3. References": None, "Experimental Setup": "experiments", "Open problems": "future_work"}
    for line, kind in kinds.items():
        assert one(spark, T.section_type(F.lit(line))) == kind, line
    for line, is_ in {"7": True, "- 7 -": True, "Page 3 of 9": True, "page 3": True, "3 of 9": False, "-7": False, "arXiv:2101.00001v2 [cs]": True, "Proceedings of X": True, "Page": False}.items():
        assert one(spark, X.page_furniture(F.lit(line))) is is_, line


def test_surfaces_may_hold_anything(spark):
    m = spark.createDataFrame([(1, "p", r"the a\Eb.* model")], "mention_id long, p string, text string")
    e = spark.createDataFrame([("x", "p", [r"a\Eb.*"]), ("y", "p", [r"a\Eb.x"])], "entity_id string, p string, surfaces array<string>")
    assert got(T.alias_links(m, e, "p"), "entity_id") == []  # no word boundary after the star
    m = spark.createDataFrame([(1, "p", r"the a\Eb model")], "mention_id long, p string, text string")
    assert got(T.alias_links(m, e.select("entity_id", "p", F.array(F.lit(r"a\Eb")).alias("surfaces")), "p"), "entity_id") == [("x",), ("y",)]


def test_accents_are_composed(spark):
    assert one(spark, T.clean(F.lit("cafe\u0301 line"))) == "caf\u00e9 line"
    for text in ("ab\nlonger\nab", "ab", " \n\tx\nline  here\n", "neu-\nab\nral net", ""):
        lines = [x for x in text.split("\n") if len(x.strip(" ")) >= 3 or x.strip(" ") == ""]
        want = one(spark, T.clean(F.lit("\n".join(lines)), min_line=1))
        assert one(spark, T.clean(F.lit(text))) == want, text


def test_edges_keep_their_properties(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b", 1)], "src string, dst string, author_position int")
    new = spark.createDataFrame([("a", "b", 5, 1), ("a", "c", 2, 1), ("a", "c", 3, 2), ("a", "zz", 4, 1)], "src string, dst string, author_position int, ordinal int")
    assert got(U.link(e, new, n, n), "dst", "author_position") == [("b", 1), ("c", 3)]
    assert got(U.link(e, new, n, n, update=True), "dst", "author_position") == [("b", 5), ("c", 3)]


def test_scratch_can_be_cleared(spark):
    from heliograph import scratch

    scratch.clear(spark)  # what other tests have set
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    scratch.set_option(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    scratch.set_option(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    kept = scratch.keep(spark.range(3), "x")
    path = kept.inputFiles()[0]
    assert scratch.clear(spark) >= 1
    import os

    assert not os.path.exists(path.removeprefix("file://"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_scope_removes_only_what_was_made_in_it(spark):
    from heliograph import scratch

    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    scratch.clear(spark)
    before = spark.conf.get(option)
    outside = scratch.keep(spark.range(3), "outside")
    scratch.set_option(spark, option, "7")
    with scratch.scope(spark):
        inside = scratch.keep(spark.range(4), "inside").inputFiles()[0]
        scratch.set_option(spark, option, "8")
        with pytest.raises(ValueError), scratch.scope(spark):
            inner = scratch.keep(spark.range(5), "inner").inputFiles()[0]
            raise ValueError
        import os

        assert not os.path.exists(inner.removeprefix("file://")) and os.path.exists(inside.removeprefix("file://"))
    assert not os.path.exists(inside.removeprefix("file://"))
    assert outside.count() == 3 and spark.conf.get(option) == "7"
    scratch.clear(spark)
    assert spark.conf.get(option) == before


def test_streamed_batches_make_versions(spark, tmp_path):
    from heliograph.streaming import ingest

    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k % 2, k)], "id long, v long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(src)
    merge = lambda old, new: (new if old is None else old.unionByName(new)).groupBy("id").agg(F.max("v").alias("v"))
    ingest.maintain(stream, str(tmp_path / "state"), merge, str(tmp_path / "cp")).awaitTermination()
    assert got(ingest.latest_state(spark, str(tmp_path / "state")), "id", "v") == [(0, 2), (1, 1)]
    spark.createDataFrame([(1, 7)], "id long, v long").coalesce(1).write.parquet(str(tmp_path / "more"))
    more = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "more"))
    for _ in range(2):  # another checkpoint goes on from the state that is there, and again from its own
        ingest.maintain(more, str(tmp_path / "state"), merge, str(tmp_path / "cp2"), hold=2).awaitTermination()
        assert got(ingest.latest_state(spark, str(tmp_path / "state")), "id", "v") == [(0, 2), (1, 7)]
    assert len(list((tmp_path / "state").iterdir())) == 2


def test_alias_links_are_those_of_a_pattern(spark):
    import re

    texts = ["We use Deep-Nets, deep nets and deepnets.", "C++ beats c+ here; x+++y", "naïve Bayes", "A GRU. a gru!", "", None, "the deep  nets", "été d'été", "foo.bar_baz", "a b c d e f", "\x01 odd \x01 text", "+++", "GRUs only"]
    names = ["deep nets", "Deep-Nets", "C++", "+++", "naïve", "NAÏVE BAYES", "gru", "été", "d'été", "bar", "bar_baz", "foo.bar", "a b c d", "b c d e f", "c d e g", "odd", ".", "deep  nets", "[", r"\E"]
    mentions = spark.createDataFrame([(p, f"m{p}{k}", t) for p in (1, 2) for k, t in enumerate(texts)] + [(None, "x", "gru")], "paper int, mention_id string, text string").repartition(3)
    entities = spark.createDataFrame([(1, f"e{k}", [n]) for k, n in enumerate(names)] + [(2, "both", ["zzz", "gru", None, ""]), (2, "none", []), (2, "null", None), (None, "y", ["gru"])], "paper int, entity_id string, surfaces array<string>")
    found = {tuple(r) for r in T.alias_links(mentions, entities, "paper").collect()}
    hit = lambda name, t: t is not None and re.search(rf"\b(?:{re.escape(name)})\b", t, re.I)
    want = {(f"m1{k}", f"e{j}") for k, t in enumerate(texts) for j, n in enumerate(names) if hit(n, t)} | {(f"m2{k}", "both") for k, t in enumerate(texts) if hit("gru", t)}
    assert found == want and len(want) > 12
    plan = T.alias_links(mentions, entities, "paper")._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
