"""What record sources ask of a provider, and one that serves stored tables.

A provider is named by a dotted path to a factory that takes its options (a mapping of texts). It has

  fields            the record fields that page() can filter by
  splits(want)      how a listing is shared out: texts, each of which page() lists for itself, `want` of them or fewer
  page(query, filters, split, cursor, size) -> (records, the next cursor or None)
                    filters: (field, operator, value) that hold together, with the operators of OPERATORS
  by_ids(kind, ids) -> mapping of each id that it knows to a list of records
  newest()          how many records there are so far, by arrival
  arrived(start, stop) -> the records of that range, always the same ones

A client for a network API is such a class; it raises where a request fails.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module
from itertools import chain, islice

#: Operators, with the same on pyarrow columns.
OPERATORS = {
    "=": lambda c, v: c == v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
}


def provider(name: str, options: dict):
    module, _, factory = name.rpartition(".")
    return getattr(import_module(module), factory)(dict(options))


class StoredRecords:
    """Parquet tables as a provider. Options: records (a folder or file of records), key, search (the field that a query is looked for in), and for each further kind of lookup `kind.<name>` (a table) and `kind.<name>.key`.

    Pages are in the order of the files. Lookups open row groups that may hold one of their ids, so tables for many of
    them lie in the order of their key, in small row groups (scratch.keep_by_key()).
    """

    def __init__(self, options: dict):
        self.options, self.key = options, options.get("key", "id")
        self._tables, self._reading = {}, (None, iter(()))

    def _table(self, path: str):
        import pyarrow.dataset as ds

        return ds.dataset(path.removeprefix("file://"), exclude_invalid_files=False)

    @property
    def fields(self) -> list[str]:
        return self._table(self.options["records"]).schema.names

    def splits(self, want: int) -> list[str]:
        """Row groups of files, some in each share."""
        groups = [(f.path, g) for f in self._table(self.options["records"]).get_fragments() for g in range(f.num_row_groups)]
        want = max(1, min(want, len(groups)))
        return [json.dumps(groups[k::want]) for k in range(want)]

    def _matching(self, query: str, filters: list[tuple], split: str) -> Iterator[dict]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        good = None
        for field, operator, value in filters:
            one = OPERATORS[operator](ds.field(field), value)
            good = one if good is None else good & one
        files: dict[str, list[int]] = {}
        for path, group in json.loads(split):
            files.setdefault(path, []).append(group)
        for path, groups in files.items():
            for fragment in self._table(path).get_fragments():
                for rows in fragment.subset(row_group_ids=groups).to_batches(schema=self._table(self.options["records"]).schema, filter=good, batch_size=8192, batch_readahead=2):
                    if query:
                        rows = rows.filter(pc.match_substring(pc.utf8_lower(rows[self.options["search"]]), query.lower()))
                    yield from rows.to_pylist()

    def page(self, query: str, filters: list[tuple], split: str, cursor: str | None, size: int) -> tuple[list[dict], str | None]:
        """The page after the last one goes on reading where that one ended; any other begins at the start."""
        asked, at = (query, repr(filters), split, size), int(cursor or 0)
        last, records = self._reading
        if last != (asked, at):
            records = islice(self._matching(query, filters, split), at, None)
        some, more = list(islice(records, size)), next(records, None)
        self._reading = ((asked, at + size), chain([more], records)) if more is not None else (None, iter(()))
        return some, str(at + size) if more is not None else None

    def by_ids(self, kind: str, ids: list[str]) -> dict[str, list[dict]]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        path, key = (self.options["records"], self.key) if kind == "records" else (self.options[f"kind.{kind}"], self.options[f"kind.{kind}.key"])
        if kind not in self._tables:  # its files' footers are read once
            self._tables[kind] = self._table(path)
        table, out = self._tables[kind], {}
        wanted = pc.cast(pa.array(ids), table.schema.field(key).type)
        ends, k = pc.min_max(wanted), ds.field(key)
        for row in table.to_table(filter=(k >= ends["min"]) & (k <= ends["max"]) & k.isin(wanted)).to_pylist():
            out.setdefault(str(row[key]), []).append(row)
        return out

    def newest(self) -> int:
        return self._table(self.options["records"]).count_rows()

    def arrived(self, start: int, stop: int) -> list[dict]:
        return self._table(self.options["records"]).to_table().sort_by(self.key).slice(start, stop - start).to_pylist()
