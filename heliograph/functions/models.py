"""Where language and embedding models plug in: a registry of functions over batches, with stand-ins that need no network."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


@register("hash_embedding")
def hash_embedding(texts: pd.Series) -> pd.Series:
    """64 signs from words' digests, summed: equal words, equal parts. Null for blank texts."""

    def one(text):
        if not isinstance(text, str) or not text.strip():
            return None
        v = np.zeros(64)
        for w in text.lower().split():
            v += np.unpackbits(np.frombuffer(hashlib.sha256(w.encode()).digest()[:8], np.uint8)) * 2.0 - 1.0
        return (v / max(1e-9, float(np.linalg.norm(v)))).tolist()

    return texts.map(one)


def embed(rows: DataFrame, text: str, name: str = "hash_embedding", into: str = "embedding") -> DataFrame:
    """Add an embedding; a row whose batch fails gets null, the others theirs."""
    f = REGISTRY[name]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            try:
                yield f(b)
            except Exception:  # noqa: BLE001  a model's failure is data here
                yield pd.Series([None] * len(b), dtype=object)

    return rows.withColumn(into, run(text))


def extract(rows: DataFrame, text: str, f: Callable[[str], list[dict]], schema: str) -> tuple[DataFrame, DataFrame]:
    """(items, failures): f turns a text into items of the schema; a text at which it fails becomes a row of its error."""
    kind = rows.select("id").schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, value in zip(b["id"], b[text]):
                try:
                    out.append((key, f(value), None))
                except Exception as e:  # noqa: BLE001
                    out.append((key, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["id", "items", "error"])

    done = rows.select("id", text).mapInPandas(run, f"id {kind}, items array<struct<{schema}>>, error string")
    return done.where("error is null").select("id", F.inline("items")), done.where("error is not null").select("id", "error")


def extract_all(rows: DataFrame, text: str, extractors: dict[str, Callable[[str], object]]) -> DataFrame:
    """(id, results, status): every text goes through all extractors in one task, once.

    results is one VARIANT with what each extractor told under its name (anything that JSON can hold), status a map from each
    extractor to `ok`, `no text` (a null text) or its error: one that fails does not keep the others from telling.
    """
    kind = rows.select("id").schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, value in zip(b["id"], b[text]):
                told, status = [], {}
                for name, f in extractors.items():
                    if value is None:
                        status[name] = "no text"
                        continue
                    try:
                        told.append(f"{json.dumps(name)}: {json.dumps(f(value), allow_nan=False)}")
                        status[name] = "ok"
                    except Exception as e:  # noqa: BLE001  a model's failure is data here
                        status[name] = f"{type(e).__name__}: {e}"[:500]
                out.append((key, "{" + ", ".join(told) + "}", json.dumps(status)))
            yield pd.DataFrame(out, columns=["id", "results", "status"])

    done = rows.select("id", text).mapInPandas(run, f"id {kind}, results string, status string")
    return done.select("id", F.parse_json("results").alias("results"), F.from_json("status", "map<string,string>").alias("status"))


def result(name: str, schema: str, results: str = "results") -> Column:
    """What one extractor told, as the schema; null where it failed or told something else."""
    return F.try_variant_get(results, f"$.{name}", schema)


def failures(done: DataFrame) -> DataFrame:
    """(id, extractor, error) of extract_all()."""
    return done.select("id", F.explode("status").alias("extractor", "error")).where("error not in ('ok', 'no text')")


def describe(rows: DataFrame, name: str, f: Callable[[str], str], check: Callable[[str, str], bool], into: str = "description") -> DataFrame:
    """Fill empty descriptions with those that f gives for a name and that pass a check of name and description; a row at which either fails stays without. rows have an id."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, value in zip(b["id"], b[name]):
                try:
                    told = f(value)
                    out.append((key, told if told and check(value, told) else None))
                except Exception:  # noqa: BLE001  a model's failure is data here
                    out.append((key, None))
            yield pd.DataFrame(out, columns=["id", "told"])

    empty = rows.where(F.col(into).isNull() | (F.trim(into) == ""))
    told = empty.select("id", name).dropDuplicates(["id"]).mapInPandas(run, f"id {kind}, told string")
    return rows.join(told, "id", "left").withColumn(into, F.coalesce("told", into)).select(*rows.columns)
