"""Connectors, taxonomy, model hooks and integration, on records made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph import schema as C
from heliograph.functions import models as G
from heliograph.functions import scalars as X
from heliograph.functions import text as T
from heliograph.operators import integrate as I
from heliograph.operators import taxonomy as Y
from heliograph.sources import connectors as K
from heliograph.sources import papers as P

TREE = [{"name": "Computing", "level": "domain", "children": [{"name": "Vision", "level": "area", "description": "seeing", "children": [{"name": "Tracking", "level": "subtopic"}]}, {"name": "Speech", "level": "area"}]}]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def fake_fetch(query, offset, limit):
    return [{"paperId": f"{query}{offset + k}", "year": 2000 + offset + k} for k in range(limit)]


def test_paged_records(spark):
    found = K.records(spark, "tests.test_sources.fake_fetch", "q", "paperId string, year int", limit=7, page_size=3)
    assert got(found, "offset", "paperId", "year") == [(k, f"q{k}", 2000 + k) for k in range(7)]


def test_atom_feed_to_papers(spark):
    xml = """<feed><totalResults>2</totalResults>
    <entry><id>http://x.org/abs/2106.01345v1</id><title>A  title
      here</title><summary> s </summary><published>2021-06-02T17:00:00Z</published><author><name>Ann</name><affiliation>U</affiliation></author><author><name>Bo</name></author>
    <category term="cs.LG"/><link href="http://x.org/pdf/2106.01345v1" title="pdf"/></entry>
    <entry><id>http://x.org/abs/9901.00001</id><title>Old</title><summary/><published/><author><name>Cy</name></author><category term="hep"/><link href="z" rel="r"/></entry></feed>"""
    entries = K.atom_entries(spark.createDataFrame([(xml,)], "xml string"))
    papers = {r["title"]: r for r in P.from_preprints(entries).collect()}
    a = papers["A title here"]
    assert (a["year"], a["publication_date"], a["pdf_url"], a["fields"]) == (2021, "2021-06-02", "http://x.org/pdf/2106.01345v1", ["cs.LG"])
    assert [(x["name"], x["position"], x["affiliations"]) for x in a["authors"]] == [("Ann", 1, ["U"]), ("Bo", 2, [])]
    assert papers["Old"]["year"] == 1999


def test_records_of_three_sources_merge(spark):
    one = spark.createDataFrame(
        [("s1", {"DOI": "10.1/a"}, "Short", None, 2020, None, "V", None, 5, 2, None, ["x"], [{"authorId": "1", "name": "Ann"}])],
        "paperId string, externalIds map<string,string>, title string, abstract string, year int, publicationDate string, venue string, openAccessPdf struct<url:string>, citationCount int, referenceCount int, isOpenAccess boolean, fieldsOfStudy array<string>, authors array<struct<authorId:string,name:string>>",
    )
    two = spark.createDataFrame(
        [("https://openalex.org/W7", "https://doi.org/10.1/a", "A longer title", {"b": [1], "a": [0]}, 2021, "2021-01-02", "", "u", True, 9, 1, ["y"], [{"id": "https://openalex.org/A1", "name": "Ann", "affiliations": ["U"]}])],
        "id string, doi string, title string, abstract_inverted_index map<string,array<int>>, publication_year int, publication_date string, venue string, oa_url string, is_oa boolean, cited_by_count int, referenced_works_count int, concepts array<string>, authors array<struct<id:string,name:string,affiliations:array<string>>>",
    )
    rows = P.from_citation_index(one).withColumn("ordinal", F.lit(0)).unionByName(P.from_catalogue(two).withColumn("ordinal", F.lit(1)))
    m = P.merged(rows).collect()[0]
    assert (m["doi"], m["title"], m["abstract"], m["year"], m["venue"], m["pdf_url"], m["citation_count"], m["reference_count"], m["is_open_access"], m["fields"], m["source"]) == ("10.1/a", "A longer title", "a b", 2021, "V", "u", 9, 2, True, ["x", "y"], "merged")
    assert m["external_ids"] == {"DOI": "10.1/a", "S2": "s1", "OpenAlex": "W7"} and m["authors"][0]["affiliations"] == ["U"]


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\fPage 2 of 9\nneu-\nral text\f  ")
    (tmp_path / "b.bin").write_bytes(b"bad")

    def split(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return content.decode().split("\f")

    pages = K.pages(spark, str(tmp_path), split)
    assert got(pages.where("error is not null"), "error") == [("ValueError: unreadable",)]
    text = K.full_text(pages.where("error is null")).collect()[0]
    assert text["text"] == "one\n\nPage 2 of 9\nneu-\nral text" and text["scanned"]
    clean = spark.createDataFrame([(text["text"],)], "t string").select(T.clean(F.col("t"), drop=X.page_furniture)).first()[0]
    assert clean == "one\n\nneural text"


def test_taxonomy(spark):
    nodes = Y.parse(spark, TREE)
    assert Y.problems(nodes).count() == 0
    bad = Y.parse(spark, [{"name": "x", "level": "area", "children": [{"name": "Deep", "level": "domain"}, {"name": "Deep", "level": "domain"}]}])
    assert {r["problem"] for r in Y.problems(bad).collect()} == {"name", "parent", "duplicate"}
    none = spark.createDataFrame([], "id string, name string, level string, parent_id string, description string")
    once = Y.load(none, nodes)
    assert once.count() == 4 and got(Y.load(once, nodes), "id") == got(once, "id")
    known = spark.createDataFrame([("d9", "Computing", "domain", None, None)], once.schema)
    under = {r["name"]: r["parent_id"] for r in Y.load(known, nodes).collect()}
    assert under["Vision"] == under["Speech"] == "d9"
    tree = Y.export(once).collect()[0]
    assert [a["name"] for a in tree["areas"]] == ["Speech", "Vision"] and tree["areas"][1]["subtopics"][0]["name"] == "Tracking"
    again = [{"level": "domain", "children": TREE[0]["children"], "name": "Computing"}]
    assert Y.digest(TREE) == Y.digest(again) != Y.digest([])


def test_models_plug_in_and_fail_by_row(spark):
    d = spark.createDataFrame([(1, "a b"), (2, " "), (3, None), (4, "A B")], "id long, t string")
    e = {r["id"]: r["embedding"] for r in G.embed(d, "t").collect()}
    assert e[2] is None and e[3] is None and e[1] == e[4] and abs(sum(x * x for x in e[1]) - 1) < 1e-9
    items, failures = G.extract(d, "t", lambda t: [{"name": w} for w in t.split()], "name string")
    assert got(items, "id", "name") == [(1, "a"), (1, "b"), (4, "A"), (4, "B")] and got(failures, "id") == [(3,)]


def test_merging_in_order(spark):
    x = np.random.default_rng(5).normal(size=(60, 4))
    rows = [(i, v.tolist(), i, i % 3) for i, v in enumerate(x)]
    found = dict(got(I.merge_in_order(spark.createDataFrame(rows, "id long, vector array<double>, ordinal long, block long"), 0.8, block="block"), "id", "keep_id"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for b in range(3):
        kept = []
        for i in range(b, 60, 3):
            best = max(((round(float(u[k] @ u[i]), 9), -k) for k in kept), default=(0, 0))
            if best[0] >= 0.8:
                assert found[i] == -best[1]
            else:
                kept.append(i)
                assert found[i] == i


def test_schema_rules(spark):
    p = spark.createDataFrame([("10.1/a", "Fine", 2000), ("bad", "F", 1800), ("10.1/a", None, None)], "doi string, title string, year int")
    assert got(C.violations(p, "paper"), "key", "rule") == [("10.1/a", "title_length"), ("10.1/a", "unique"), ("bad", "doi"), ("bad", "title_length"), ("bad", "year")]
    for ddl in C.NODES.values():
        assert spark.createDataFrame([], ddl).columns


def test_waiting(spark):
    rows = spark.createDataFrame([("3", "x"), ("Wed, 1", "try again in 1.8s"), (None, "Try again in 20ms please"), (None, "no")], "h string, m string")
    assert [r[0] for r in rows.select(X.retry_after(F.col("h"), F.col("m"))).collect()] == [3.0, 1.8, 0.02, None]
    assert [r[0] for r in spark.range(8).select(X.backoff(F.col("id"))).collect()] == [1, 2, 4, 8, 16, 32, 60, 60]


def test_seeds(spark):
    from heliograph.sources import seeds

    m = seeds.models(spark, [{"name": " A ", "aliases": None, "year_introduced": 2017}, {"name": "B"}])
    assert got(m, "name", "aliases", "year_introduced") == [("A", [], 2017), ("B", [], None)]
    for bad in ([{"name": ""}], [{"name": "a"}, {"name": "A "}]):
        with pytest.raises(ValueError):
            seeds.models(spark, bad)
    assert got(seeds.pairs(spark, [{"a": "x", "b": "y", "label": "same"}]), "a", "b", "label") == [("x", "y", "same")]
    with pytest.raises(ValueError):
        seeds.pairs(spark, [{"a": "x", "b": "y", "label": "maybe"}])
    assert seeds.denied(["Model", {"term": " data "}, {"reason": "none"}], "MODEL") == ("data", "model")


def test_authors_are_found_by_either_id(spark):
    person = "struct<name:string,position:int,affiliations:array<string>,external_ids:map<string,string>>"
    lists = [("10.1/a", [("N1", 0, [], {"semantic_scholar": "s1"}), ("N2", 0, [], {"orcid": "0000-2"}), ("N3", 0, [], {})]), ("10.1/b", [("N1 again", 0, [], {"semantic_scholar": "s1", "orcid": "0000-1"}), ("K", 0, [], {"orcid": "0000-9"}), ("N1 third", 0, [], {"orcid": "0000-1"})]), (None, [("X", 0, [], {})])]
    records = spark.createDataFrame(lists, f"doi string, authors array<{person}>")
    known = spark.createDataFrame([("k", "Known", [], "0000-9", None)], "id string, name string, affiliations array<string>, orcid string, semantic_scholar_id string")
    authors, edges = P.link_authors(known, P.paper_authors(records))
    names = {r["id"]: r["name"] for r in authors.collect()}
    assert sorted(names.values()) == ["Known", "N1", "N2", "N3"]
    assert sorted((r["src"], names[r["dst"]], r["author_position"]) for r in edges.collect()) == [("10.1/a", "N1", 1), ("10.1/a", "N2", 2), ("10.1/a", "N3", 3), ("10.1/b", "Known", 2), ("10.1/b", "N1", 1)]


def test_json_in_json(spark):
    import json

    once = json.dumps({"name": 'a "quoted" \\ name'})
    rows = [(k, x) for k, x in enumerate((once, json.dumps(once), json.dumps(json.dumps(once)), "not json", None))]
    found = spark.createDataFrame(rows, "k int, v string").select("k", P.decode_json(F.col("v"), "name string")["name"].alias("n"))
    assert [r["n"] for r in found.orderBy("k").collect()] == ['a "quoted" \\ name'] * 3 + [None, None]


def test_taxonomy_as_text(spark):
    t = Y.load(spark.createDataFrame([], "id string, name string, level string, parent_id string, description string"), Y.parse(spark, TREE))
    assert {r["path"] for r in Y.flatten(t).collect()} == {r["path"] for r in Y.parse(spark, TREE).collect()}
    lines = [r["text"] for r in Y.to_text(t).collect()][0].split("\n")
    assert lines[0] == '- name: "Computing"' and '    - name: "Vision"' in lines and '        - name: "Tracking"' in lines


def test_texts_to_problems_and_relations(spark):
    like = "a very long open problem of sparse graphs and slow walks"
    body = f"We list things here. {like} in theory. {like} in practice. " + "filler words " * 20
    rows = [(1, f"Abstract: {'short talk ' * 15}\n1. Introduction\n{'intro text ' * 30}\nLimitations\n{body}"), (2, "Limitations\n" + "fail " * 40), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")

    def extractor(text):
        if text.startswith("fail"):
            raise ValueError("no answer")
        return [{"statement": s.strip(), "quoted_text": None, "confidence": 0.9 if "problem" in s else 0.2} for s in text.split(". ")]

    sections, problems, related, failures = I.process_texts(d, extractor)
    assert got(sections, "doc_id", "section_type") == [(1, "abstract"), (1, "introduction"), (1, "limitations"), (2, "limitations")]
    assert got(problems, "section", "statement") == [("limitations", f"{like} in practice"), ("limitations", f"{like} in theory")]
    assert got(related, "relation", "source", "target") == [("related_to", f"{like} in practice", f"{like} in theory")]
    assert got(failures, "doc_id", "section", "error") == [(2, "limitations", "ValueError: no answer")]


def test_descriptions_are_checked(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "b", "has one"), (3, "c", " "), (4, "d", "")], "id long, name string, description string")

    def f(name):
        if name == "d":
            raise ValueError("no answer")
        return f"about {name}"

    assert got(G.describe(d, "name", f, lambda name, told: name != "c"), "id", "description") == [(1, "about a"), (2, "has one"), (3, " "), (4, "")]
