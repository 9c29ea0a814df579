"""Lookups in batches of ids, paged sources with filters, cursors and streams, over a local provider."""

import pytest
from pyspark.sql import functions as F

from heliograph.sources import connectors, lookups, providers

LOCAL = "heliograph.sources.providers.StoredRecords"


class Faulty(providers.StoredRecords):
    """Fails for whole requests that have an odd id of 90 and more, and now and then for any."""

    calls = 0

    def by_ids(self, kind, ids):
        Faulty.calls += 1
        if Faulty.calls % 3 == 0:
            raise OSError("again")
        if any(int(i) >= 90 and int(i) % 2 for i in ids):
            raise ValueError("bad id")
        return super().by_ids(kind, ids)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("provider"))
    spark.range(100).selectExpr("id", "'Title ' || id AS title", "CAST(1990 + id % 20 AS INT) AS year", "id % 2 = 0 AS open").repartition(4).write.parquet(f"{at}/papers")
    spark.range(300).selectExpr("id % 60 AS cited", "id AS citing").coalesce(1).write.parquet(f"{at}/cites")
    return at


def options(folder):
    return {"records": f"{folder}/papers", "search": "title", "kind.citations": f"{folder}/cites", "kind.citations.key": "cited"}


def test_lookup_of_records_and_of_what_belongs_to_them(spark, folder):
    ids = spark.createDataFrame([(str(i),) for i in [*range(95, 105), 7, 7]] + [(None,)], "id string")
    found, failed = lookups.lookup(ids, LOCAL, options(folder), "title string, year int", size=3, at_once=4)
    assert sorted((r["id"], r["nth"], r["title"], r["year"]) for r in found.collect()) == sorted((str(i), 0, f"Title {i}", 1990 + i % 20) for i in [95, 96, 97, 98, 99, 7])
    assert sorted(str(tuple(r)) for r in failed.collect()) == sorted([*(f"('{i}', 'not found')" for i in range(100, 105)), "(None, 'no id')"])
    cited, none = lookups.lookup(spark.range(55, 65).selectExpr("CAST(id AS STRING) AS id"), LOCAL, options(folder), "citing long", "citations")
    assert {(r["id"], r["citing"]) for r in cited.collect()} == {(str(i % 60), i) for i in range(300) if 55 <= i % 60} and none.count() == 5
    assert lookups.lookup(ids.limit(0), LOCAL, options(folder), "title string")[0].count() == 0


def test_one_bad_id_does_not_take_others_with_it(spark, folder):
    ids = spark.range(80, 100).selectExpr("CAST(id AS STRING) AS id")
    found, failed = lookups.lookup(ids, "tests.test_providers.Faulty", options(folder), "title string", size=20, at_once=1, attempts=4)
    assert {r["id"] for r in found.collect()} == {str(i) for i in range(80, 100) if i < 90 or i % 2 == 0}
    assert {r["id"] for r in failed.where("error like '%bad id%' or error like '%again%'").collect()} == {"91", "93", "95", "97", "99"}


SCHEMA = "source string, id long, title string, year int"


class Told(providers.StoredRecords):
    """Writes down the ids of each request."""

    def by_ids(self, kind, ids):
        import os
        import uuid

        with open(f"{self.options['log']}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
            f.write(",".join(ids))
        return super().by_ids(kind, ids)


def test_ids_are_asked_for_once_and_near_ones_together(spark, folder, tmp_path):
    ids = spark.range(0, 120).selectExpr("CAST(id AS STRING) AS id")
    found, failed = lookups.lookup(ids, "tests.test_providers.Told", options(folder) | {"log": str(tmp_path)}, "title string", size=5, at_once=2)
    assert found.count() == 100 and failed.count() == 20 and found.agg(F.count_distinct("id")).first()[0] == 100
    asked = [[int(i) for i in f.read_text().split(",")] for f in tmp_path.iterdir()]
    assert sorted(i for a in asked for i in a) == list(range(120))
    assert max(max(a) - min(a) for a in asked) < 60


def test_stored_records_open_few_row_groups(spark, tmp_path, monkeypatch):
    from heliograph.scratch import keep_by_key
    import pyarrow.parquet as pq

    path = keep_by_key(spark.range(100_000).selectExpr("99999 - id AS id", "uuid() AS title").repartition(3), "id", "by_key", 1 << 17)
    served = providers.StoredRecords({"records": path})
    ends = [g.column(0).statistics for f in served._table(path).files for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert len(ends) > 10 and sum(e.min <= 50_100 and e.max >= 50_000 for e in ends) <= 2
    assert sorted(served.by_ids("records", [str(i) for i in range(50_000, 50_100)])) == [str(i) for i in range(50_000, 50_100)]
    split, opened = served.splits(4)[0], []
    assert len(served.splits(4)) == 4
    once = served._matching
    monkeypatch.setattr(served, "_matching", lambda *a: opened.append(a) or once(*a))
    cursor, pages = None, []
    while cursor is not None or not pages:
        records, cursor = served.page("", [("id", ">=", 1000)], split, cursor, 700)
        pages.append([r["id"] for r in records])
    assert len(opened) == 1 and len(pages) > 5
    assert [r["id"] for r in served.page("", [("id", ">=", 1000)], split, "1400", 700)[0]] == pages[2]  # a page for itself


def sources(folder):
    return {"first": (LOCAL, options(folder)), "second": (LOCAL, {"records": f"{folder}/papers", "search": "title"})}


def test_filters_reach_the_providers(spark, folder, capsys):
    rows = connectors.provider_records(spark, sources(folder), SCHEMA, "title", page_size=7, splits=3)
    assert rows.count() == 200 and rows.where("source = 'second'").count() == 100
    some = rows.where("source = 'first' AND year >= 2005 AND id IN (15, 16, 38, 99) AND length(title) > 7")
    assert sorted(r["id"] for r in some.collect()) == [15, 16, 38, 99]
    some.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.split("\n") if line.startswith("PushedFilters"))
    assert "EqualTo(source,first)" in pushed and "GreaterThanOrEqual(year,2005)" in pushed and "In(id" in pushed and "length" not in pushed
    assert rows.where("source = 'third'").count() == 0
    assert connectors.provider_records(spark, sources(folder), SCHEMA, "no such title").count() == 0


def test_only_what_passes_the_pushed_filters_leaves_the_source(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains
    from pyspark.sql.types import StructType
    import json

    reader = connectors.RecordSource({"providers": json.dumps(sources(folder)), "page_size": "5"}).reader(StructType.fromDDL(SCHEMA))
    left = [StringContains(("title",), "x"), EqualTo(("unknown",), 1)]
    assert list(reader.pushFilters([EqualTo(("source",), "second"), GreaterThan(("year",), 2008), *left])) == left
    parts = reader.partitions()
    assert {p.value[0] for p in parts} == {"second"} and len(parts) > 1
    assert sorted(r[1] for p in parts for r in reader.read(p)) == [i for i in range(100) if 1990 + i % 20 > 2008]


def test_a_stream_that_starts_again_reads_nothing_twice(spark, folder, tmp_path):
    at, out, check = str(tmp_path / "records"), str(tmp_path / "out"), str(tmp_path / "check")
    records = lambda a, b: spark.range(a, b).selectExpr("id", "'t' || id AS title", "2000 AS year").coalesce(1).write.mode("append").parquet(at)
    named = {"only": (LOCAL, {"records": at})}

    def go():
        stream = connectors.provider_stream(spark, named, SCHEMA, page_size=4)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    records(0, 10)
    assert go() == list(range(10))
    assert go() == list(range(10))
    records(10, 25)
    assert go() == list(range(25))
    assert spark.read.parquet(out).agg(F.count_distinct("source")).first()[0] == 1
