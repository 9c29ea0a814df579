"""Several extractors in one pass, the integration of what they tell, migrations in steps, and helpers around them."""

import pytest
from pyspark.sql import functions as F

from heliograph.functions import models as G
from heliograph.operators import aggregates as A
from heliograph.operators import batch as B
from heliograph.operators import integrate as I
from heliograph.operators import migrate as Z
from heliograph.operators import resolve as E
from heliograph.sources import papers as P
from heliograph.sources import versioned


def test_one_failing_extractor_among_four(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None), (4, "")], "id int, text string")

    def bad(text):
        if text == "bad":
            raise ValueError("no")
        return float("nan") if text == "" else 1

    done = G.extract_all(rows, "text", {"words": lambda t: [{"name": w} for w in t.split()], "size": lambda t: {"n": len(t)}, "bad": bad, "none": lambda t: None})
    got = {r["id"]: r for r in done.select("id", "status", G.result("words", "array<struct<name:string>>").alias("w"), G.result("size.n", "int").alias("n"), G.result("bad", "int").alias("b"), G.result("words", "int").alias("x")).collect()}
    assert [[w["name"] for w in got[k]["w"]] for k in (1, 2, 4)] == [["a", "b"], ["bad"], []] and got[3]["w"] is None
    assert (got[1]["b"], got[2]["b"], got[4]["b"], got[2]["n"], got[1]["x"]) == (1, None, None, 3, None)
    assert got[2]["status"] == {"words": "ok", "size": "ok", "bad": "ValueError: no", "none": "ok"} and set(got[3]["status"].values()) == {"no text"}
    assert [(r["id"], r["extractor"]) for r in G.failures(done).orderBy("id").collect()] == [(2, "bad"), (4, "bad")]


def test_nested_properties_to_storage_and_back(spark):
    schema = "id int, evidence struct<doi:string,at:int>, parts array<struct<text:string>>, counts map<string,int>, names array<string>"
    rows = spark.createDataFrame([(1, ("10.1/x", 3), [("a",), ("b",)], {"k": 1}, ["n"]), (2, None, None, None, None)], schema)
    stored = P.stored_properties(rows)
    assert dict(stored.dtypes) == {"id": "int", "evidence": "string", "parts": "string", "counts": "string", "names": "array<string>"}
    assert sorted(map(str, P.loaded_properties(stored, schema).collect())) == sorted(map(str, rows.collect()))
    spoiled = stored.withColumn("evidence", F.lit("{no json"))
    assert {r["evidence"] for r in P.loaded_properties(spoiled, schema).collect()} == {None}


def test_entities_of_papers_from_text_to_graph(spark):
    filler = " ".join(["word"] * 25)
    docs = spark.createDataFrame([(k, f"Abstract: {filler} {w}\n1. Introduction\nuses {w} and more {filler}\nReferences\nnot {filler}") for k, w in enumerate(("gru", "lstm", "gru"))] + [(9, None)], "doc_id int, text string")
    find = lambda text: [{"name": n.upper(), "aliases": [n], "description": None} for n in ("gru", "lstm") if n in text] + [{"name": " "}]

    def fails(text):
        raise OSError("away")

    found, failed = I.paper_entities(docs, {"model": find, "method": fails, "concept": lambda t: [{"name": "more"}] if "more" in t else None})
    assert sorted((r["paper"], r["kind"], r["name"]) for r in found.collect()) == sorted([(k, kind, name) for k, n in enumerate(("GRU", "LSTM", "GRU")) for kind, name in (("model", n), ("concept", "more"))])
    assert {(r["paper"], r["extractor"], r["error"]) for r in failed.collect()} == {(k, "method", "OSError: away") for k in range(3)}
    vector = F.when(F.col("name") == "GRU", F.array(F.lit(1.0), F.lit(0.0))).when(F.col("name") == "LSTM", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0)))
    state = lambda rows: spark.createDataFrame(rows, "id string, name string, aliases array<string>, description string, vector array<double>")
    states, edges = I.integrate_entities({"model": state([("m1", "Gru", None, "", [1.0, 0.01])]), "concept": state([])}, found.withColumn("vector", vector), 0.95)
    models = {r["name"]: r for r in states["model"].collect()}
    assert set(models) == {"Gru", "LSTM"} and models["Gru"]["aliases"] == ["GRU", "gru"]
    assert states["concept"].count() == 1
    assert sorted((r["src"], r["kind"]) for r in edges.collect()) == [(k, kind) for k in range(3) for kind in ("concept", "model")]
    assert {r["dst"] for r in edges.where("src <> 1 and kind = 'model'").collect()} == {"m1"}
    incoming = found.where("kind = 'model'").withColumn("vector", vector).withColumn("ordinal", F.col("paper")).select("id", "name", "aliases", "description", "vector", "ordinal")
    told, _ = I.create_or_merge_described(state([("m1", "Gru", None, "", [1.0, 0.01]), ("z", "other", None, None, [1.0, -1.0])]), incoming, 0.95, lambda n: f"what {n} is", lambda n, t: n != "LSTM")
    assert {r["name"]: r["description"] for r in told.collect()} == {"Gru": "what Gru is", "LSTM": None, "other": None}
    with pytest.raises(ValueError, match="incoming id"):
        I.create_or_merge(state([("m1", "Gru", None, "", [1.0])]), incoming.withColumn("id", F.lit("m1")), 0.9)


def test_import_of_an_authors_papers(spark):
    author = "struct<name:string,affiliations:array<string>,external_ids:map<string,string>>"
    schema = f"doi string, title string, authors array<{author}>, venue string, year int, abstract string, external_ids map<string,string>, pdf_url string"
    who = lambda n, i: (n, [], {"s2": i} if i else {})
    records = spark.createDataFrame([
        ("10.1/a", "A", [who("Ann", "1"), who("Bob", None)], "v", 2001, None, {}, None), ("10.1/b", "B", [who("Cid", "3")], "v", 2002, None, {}, None),
        ("10.1/c", "C", [who("Cid", "3"), who("Ann", "1")], "v", None, None, {}, None), ("10.1/known", "K", [who("Ann", "1")], "v", 2000, None, {}, None),
    ], schema)
    papers = spark.createDataFrame([("10.1/known", "K", 2000)], "doi string, title string, year int")
    authors = spark.createDataFrame([("x1", "Ann", [], None, "1")], "id string, name string, affiliations array<string>, orcid string, semantic_scholar_id string")
    authored = spark.createDataFrame([("10.1/known", "x1", 7)], "src string, dst string, author_position int")
    new_papers, new_authors, edges, outcomes = I.import_author_papers(papers, authors, authored, records, spark.createDataFrame([("1",), ("1",)], "semantic_scholar_id string"), 2024)
    assert {r["doi"]: r["year"] for r in new_papers.collect()} == {"10.1/known": 2000, "10.1/a": 2001, "10.1/c": 2024}
    assert sorted(r["name"] for r in new_authors.collect()) == ["Ann", "Bob", "Cid"]
    assert {(r["src"], r["author_position"]) for r in edges.where("dst = 'x1'").collect()} == {("10.1/known", 7), ("10.1/a", 1), ("10.1/c", 2)}
    assert {r["doi"]: r["outcome"] for r in outcomes.collect()} == {"10.1/known": "skipped", "10.1/a": "created", "10.1/c": "created"}


def test_documents_behind_addresses(spark):
    body = "Introduction\n" + "we show many things here and there " * 8 + "\nLimitations\n" + "the method is slow on long inputs and it needs memory " * 6

    def fetch(url):
        if url == "gone":
            raise OSError("HTTP 404")
        return {"good": body, "empty": "", "odd": None}[url]

    def to_pages(text):
        half = len(text) // 2
        return [text[:half], text[half:]]

    urls = spark.createDataFrame([("good",), ("good",), ("gone",), ("empty",), ("odd",), (None,)], "url string")
    extract = lambda t: [{"statement": "the method is slow", "quoted_text": None, "confidence": 0.9}] if "slow" in t else []
    sections, problems, related, failed = I.process_urls(urls, fetch, to_pages, extract)
    assert {r["path"] for r in sections.collect()} == {"good"} and "limitations" in {r["section_type"] for r in sections.collect()}
    assert [(r["path"], r["statement"]) for r in problems.collect()] == [("good", "the method is slow")]
    got = {r["path"]: r["error"] for r in failed.collect()}
    assert set(got) == {"gone", "empty", "odd"} and got["gone"] == "OSError: HTTP 404" and got["empty"] == "no text" and got["odd"].startswith("TypeError")


def test_a_migration_that_stops_goes_on_at_the_first_open_step(spark, tmp_path):
    path, ran = f"file://{tmp_path}/m", []
    inputs = {"numbers": spark.range(5)}

    def step(name, f):
        def go(tables):
            ran.append(name)
            return f(tables)

        return name, go

    def stops(tables):
        raise KeyboardInterrupt

    first, last = step("double", lambda t: {"numbers": t["numbers"].selectExpr("id * 2 AS id"), "seen": t["numbers"]}), step("sum", lambda t: {"total": t["numbers"].agg(F.sum("id").alias("n"))})
    with pytest.raises(KeyboardInterrupt):
        Z.run(spark, path, [first, step("more", stops), last], inputs)
    assert [r["step"] for r in Z.ledger(spark, path).collect()] == ["double"] and versioned.versions(spark, path) == [1]
    steps = [first, step("more", lambda t: {"numbers": t["numbers"].unionByName(t["seen"])}), last]
    tables, ledger = Z.run(spark, path, steps, inputs)
    assert ran == ["double", "more", "more", "sum"]
    assert tables["total"].first()["n"] == 30 and [(r["nth"], r["step"], r["version"]) for r in ledger.orderBy("nth").collect()] == [(0, "double", 1), (1, "more", 2), (2, "sum", 3)]
    Z.run(spark, path, steps, inputs)
    assert ran[4:] == [] and versioned.versions(spark, path) == [1, 2, 3]
    with pytest.raises(ValueError, match="another migration"):
        Z.run(spark, path, steps[1:], inputs)


def test_counts_over_event_time(spark, tmp_path):
    from heliograph.streaming import ingest

    rows = [(k, "a" if k % 2 else "b", f"2024-01-01 0{k // 3}:10:00") for k in range(9)]
    spark.createDataFrame(rows, "id int, kind string, t string").withColumn("at", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, kind string, at timestamp").parquet(str(tmp_path / "in"))
    ingest.windowed_counts(stream, "at", "kind").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = {(k, h): sum(1 for i, kind, _ in rows if kind == k and i // 3 == h) for k in "ab" for h in range(3)}
    assert {(r["kind"], r["start"].hour): r["n"] for r in spark.table("counted").collect()} == want


def test_helpers_around_runs(spark):
    now = F.to_timestamp(F.lit("2024-01-02"))
    jobs = B.create(spark.createDataFrame([("a",), ("b",)], "source string"), "one", now)
    more = B.add(jobs, B.create(spark.createDataFrame([("b",), ("c",)], "source string"), "one", now).unionByName(B.create(spark.createDataFrame([("a",)], "source string"), "two", now)))
    assert more.count() == 4 and B.of_batch(more, "one").count() == 3
    versions = spark.createDataFrame([(1, None)], "version int, applied_at timestamp")
    assert A.current_version(spark, versions).first()["version"] == 1 and A.current_version(spark, versions.limit(0)).first()["version"] == 0
    assert sorted(r["version"] for r in A.with_version(spark, versions, 2, now).collect()) == [1, 2] and A.with_version(spark, versions, 1, now).count() == 1
    assert [(r["k"], r["n"]) for r in A.duplicates_of(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").collect()] == [(1, 2)]
    sweep = A.threshold_sweep(spark.createDataFrame([(0.9, True), (0.2, False)], "score double, same boolean"), [0.1, 0.5])
    assert [r["line"] for r in A.report_lines(sweep).collect()] == ["0.10  tp 1  fp 1  tn 0  fn 0  p 0.500  r 1.000  f1 0.667", "0.50  tp 1  fp 0  tn 1  fn 0  p 1.000  r 1.000  f1 1.000"]
    papers = spark.createDataFrame([("10.1/a",), ("10.1/b",)], "doi string")
    assert [r["doi"] for r in I.has_footprint(papers, spark.createDataFrame([("m", "10.1/b")], "src string, dst string")).collect()] == ["10.1/b"]
    found = spark.createDataFrame([("10.1/a", 1, "a statement", "", 0.9, None), ("10.1/a", 1, "a statement", "", 0.9, None)], "paper string, ordinal int, statement string, quoted_text string, confidence double, section string")
    one = I.problem_mentions(found, now).collect()
    assert len(one) == 1 and (one[0]["paper_doi"], one[0]["section"], one[0]["quoted_text"]) == ("10.1/a", "Unknown", "a statement")
    quotes = spark.createDataFrame([("p", "model", 1, "second"), ("p", "concept", 2, "first")], "paper string, kind string, ordinal int, quoted_text string")
    assert E.excerpt(quotes).first()["excerpt"] == "first ... second"
    assert spark.range(1).select(P.preprint_page(F.lit("arXiv:2106.01234v2"))).first()[0].endswith("/abs/2106.01234v2")
    outcomes = spark.createDataFrame([("r", str(k), "error", f"e{k}") for k in range(5)] + [("r", "9", "created", None)], "trace_id string, paper string, outcome string, message string")
    report = I.rows_per_run(outcomes, 3).first()
    assert report["error"] == 5 and set(report["errors"]) == {"0", "1", "2"} and I.errors_of_runs(outcomes).count() == 5
