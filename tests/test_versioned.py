"""The two-phase sink: all tables of a publication or none of them."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from heliograph.sources import versioned as V


def test_tables_appear_together_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    state = spark.range(20).selectExpr("id", "id * 2 AS v").repartition(3)
    assert V.publish(spark, path, {"state": state, "report": spark.createDataFrame([("run1", 20)], "run string, n long")}) == 1
    assert V.read(spark, path, "state").agg(F.sum("v")).first()[0] == 380

    @F.udf("long")
    def broken(i):
        if i == 13:
            raise ValueError("a task fails")
        return i

    with pytest.raises(Exception, match="a task fails"):
        V.publish(spark, path, {"report": spark.createDataFrame([("run2", 99)], "run string, n long"), "state": state.select(broken("id").alias("id"), "v")})
    assert V.versions(spark, path) == [1]
    assert V.read(spark, path, "state").count() == 20 and V.read(spark, path, "report").collect() == [("run1", 20)]
    V.vacuum(spark, path)  # tasks that were stopped may have left files behind
    staged = [f for _, _, names in os.walk(f"{tmp_path}/state/staged") for f in names if f.endswith(".parquet")]
    assert len(staged) == sum(len(t["files"]) for t in V.manifest(spark, path).values())
    assert V.publish(spark, path, {"state": state.limit(0)}) == 2
    assert V.read(spark, path, "state").count() == 0 and V.read(spark, path, "state").dtypes == state.dtypes
    assert V.read(spark, path, "report").collect() == [("run1", 20)] and V.read(spark, path, "state", 1).count() == 20
    with pytest.raises(KeyError):
        V.read(spark, path, "other")


def test_the_second_of_two_publishers_is_told(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/state"
    one = spark.range(3)
    V.publish(spark, path, {"t": one})
    real = V.versions
    monkeypatch.setattr(V, "versions", lambda s, p: [v for v in real(s, p) if v < 2])  # has not seen version 2
    assert V.publish(spark, path, {"t": spark.range(5)}) == 2
    with pytest.raises(RuntimeError, match="publish again"):
        V.publish(spark, path, {"t": spark.range(7)})
    monkeypatch.undo()
    assert V.versions(spark, path) == [1, 2] and V.read(spark, path, "t").count() == 5
    assert V.publish(spark, path, {"t": spark.range(7)}) == 3


def test_old_versions_can_be_removed(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    for k in range(4):
        V.publish(spark, path, {"t": spark.range(k)} if k else {"t": spark.range(9), "kept": spark.range(2)})
    assert V.vacuum(spark, path, 2) == 1  # the first one still holds a table of the latest
    assert V.versions(spark, path) == [3, 4] and V.read(spark, path, "t").count() == 3 and V.read(spark, path, "kept").count() == 2


def test_kinds_of_values_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    rows = spark.createDataFrame([(1, "a", [1.5, None], {"k": 2}, datetime.datetime(2020, 1, 2, 3, 4, 5), datetime.date(2021, 1, 1), None), (2, None, None, None, None, None, (1, "x"))], "i int, s string, a array<double>, m map<string,int>, t timestamp, d date, r struct<x:int,y:string>")
    V.publish(spark, path, {"t": rows})
    assert sorted(map(str, V.read(spark, path, "t").collect())) == sorted(map(str, rows.collect()))


def test_a_store_with_a_schema(spark, tmp_path):
    from heliograph import schema as C

    path = f"file://{tmp_path}/store"
    assert C.initialize(spark, path) and not C.initialize(spark, path)
    told = {r["label"]: r for r in C.info(spark, path).collect()}
    assert set(told) == set(C.NODES) and {(r["n_rows"], r["version"]) for r in told.values()} == {(0, C.VERSION)} and told["paper"]["key"] == "doi"
    topic = spark.createDataFrame([("t1", "Nets", "area", None), ("t2", "All", "domain", None)], "id string, name string, level string, parent_id string")
    assert C.put(spark, path, {"topic": topic}) == 2
    wrong = topic.unionByName(spark.createDataFrame([("t3", "X", "field", None), ("t1", "Nets", "area", None)], topic.schema))
    with pytest.raises(ValueError, match="t1: unique; topic t3: level"):
        C.put(spark, path, {"author": spark.createDataFrame([("a", "0000-1")], "id string, orcid string"), "topic": wrong})
    assert V.versions(spark, path) == [1, 2] and V.read(spark, path, "topic").count() == 2
    assert C.initialize(spark, path, force=True)  # the topics get the columns that they lack
    assert set(V.read(spark, path, "topic").columns) == set(spark.createDataFrame([], C.NODES["topic"]).columns) and V.read(spark, path, "topic").count() == 2
    assert V.read(spark, path, "schema_version").count() == 1


def test_seed_models_load_again_and_again(spark):
    from heliograph.sources import seeds

    entries = [{"name": "GRU", "description": "gated", "aliases": ["gated unit"], "year_introduced": 2014}, {"name": "LSTM", "aliases": ["long memory"], "architecture": "recurrent"}, {"name": "Net", "description": "any"}]
    place = {"GRU": [1.0, 0.0, 0.0], "LSTM": [0.0, 1.0, 0.0], "Net": [0.0, 0.0, 1.0]}
    vector = F.element_at(F.create_map(*(x for n, v in place.items() for x in (F.lit(n), F.array(*map(F.lit, v))))), F.col("name"))
    rows = seeds.models(spark, entries).withColumn("vector", vector)
    state = spark.createDataFrame([("m", "lstm net", None, None, [0.0, 1.0, 0.01], False, None, None)], "id string, name string, description string, aliases array<string>, vector array<double>, is_canonical boolean, architecture string, year_introduced int")
    for want in ((2, 1), (0, 3), (0, 3)):
        state, report = seeds.load_models(state, rows)
        assert tuple(report.first()) == want
        state = spark.createDataFrame(state.collect(), state.schema)
    got = {r["name"]: r for r in state.collect()}
    assert set(got) == {"GRU", "LSTM", "Net"} and got["LSTM"]["id"] == "m" and got["LSTM"]["aliases"] == ["long memory", "lstm net"] and got["LSTM"]["architecture"] == "recurrent"
    assert all(r["is_canonical"] for r in got.values()) and got["GRU"]["year_introduced"] == 2014
