"""Lookups by id at a provider (providers.py): a Python table function that gathers ids into requests."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import keep, options_for

RESULT = "id string, nth int, record string, error string"


class _Lookup:
    """The ids of a partition (rows: id, ...) in requests of at most `size`. Every id gets a row for each of its records, or one that tells why there is none."""

    def __init__(self):
        self.ids, self.asked = [], None

    def eval(self, row, name: str, options: str, kind: str, size: int, attempts: int) -> Iterator[tuple]:
        if self.asked is None:
            from heliograph.sources.providers import provider

            self.asked = provider(name, json.loads(options)), kind, attempts
        if row["id"] is None:
            yield None, None, None, "no id"
            return
        self.ids.append(row["id"])
        if len(self.ids) >= size:
            yield from self._request(self.ids)
            self.ids = []

    def terminate(self) -> Iterator[tuple]:
        if self.ids:
            yield from self._request(self.ids)

    def _request(self, ids: list[str]) -> Iterator[tuple]:
        """One request, tried again; a request that fails for good is cut in two, so that one bad id does not take the others with it."""
        source, kind, attempts = self.asked
        for left in range(attempts - 1, -1, -1):
            try:
                found = source.by_ids(kind, ids)
            except Exception as e:  # noqa: BLE001  a provider's failure is data here
                if left:
                    continue
                if len(ids) == 1:
                    yield ids[0], None, None, f"{type(e).__name__}: {e}"[:500]
                    return
                for half in (ids[: len(ids) // 2], ids[len(ids) // 2 :]):
                    yield from self._request(half)
                return
            for i in ids:
                records = found.get(i, [])
                for n, record in enumerate(records):
                    yield i, n, json.dumps(record, default=str), None
                if not records:
                    yield i, None, None, "not found"
            return


def lookup(ids: DataFrame, provider: str, options: dict, schema: str, kind: str = "records", size: int = 500, at_once: int = 8, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of ids (column id, text): records with id, nth (of an id) and the fields of schema; failures with id and error.

    Each different id is asked for once. at_once requests run side by side, each gathering up to `size` ids of its share,
    which come by length and text, so that those of a request lie near one another in a provider's order.
    """
    share = F.pmod(F.xxhash64("id"), F.lit(at_once))
    rows = ids.select(F.col("id").cast("string").alias("id")).distinct().select("id", share.alias("share"), F.length("id").alias("length"))
    ask = F.udtf(_Lookup, returnType=RESULT)
    found = ask(rows.asTable().partitionBy("share").orderBy("length", "id"), F.lit(provider), F.lit(json.dumps(options)), F.lit(kind), F.lit(size), F.lit(attempts))
    # ids are small, and shares of them would be put together in one task
    with options_for(ids.sparkSession, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        found = keep(found, "found")
    parsed = found.withColumn("r", F.from_json("record", schema))
    good = F.col("error").isNull() & F.col("r").isNotNull()
    return parsed.where(good).select("id", "nth", "r.*"), parsed.where(~good).select("id", F.coalesce("error", F.lit("not of the schema")).alias("error"))
