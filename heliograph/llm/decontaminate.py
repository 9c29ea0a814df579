"""Operator 9: benchmark decontamination with an Aho-Corasick automaton over normalised items.

A window is a run of consecutive item words. The automaton reads a document's words once, as numbers, and
finds every whole word block of an item (items are cut into blocks of (window + 1) // 2 words, so each
window holds one) and every item that is shorter than a window. The windows around a block are then looked
up among the items' windows, word by word, and hits are mapped to offsets in the original text.

A Spark job writes the automaton to the shared folder, one for each SHARD_CHARS characters of benchmark
text (about 20 bytes of memory a character), so for common benchmarks it is one; a task opens them one
after another and keeps them for its next batches. The driver sees their paths only.

Null or empty texts have no words and are clean; items without words have no window; rows with equal ids
are judged each for itself (items with equal ids count once); a null item_id counts as the string "null";
other columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_dir, with_row

SHARD_CHARS = 16 << 20
BATCH_BYTES = 2 << 20
#: Bytes that end a word become spaces, A-Z become a-z.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_RESULT = "doc_id long, text string, n_words long, hits array<struct<first:int,last:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Patterns:
    """The automaton of some items (id, text), and their windows by hash with the items that have them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.window, self.size = window, (window + 1) // 2
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            owners.setdefault(tuple(words_of(text)), set()).add(item_id)
        owners.pop((), None)
        self.vocabulary: dict[bytes, int] = {}
        self.owners = [sorted(ids) for ids in owners.values()]
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        keys: dict[tuple[int, ...], tuple[bool, list[int]]] = {}  # is it a block; short items that it is
        streams, starts, of, at = [], [], [], 0
        for n, words in enumerate(owners):
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            if len(ids) < window:
                block, short = keys.get(ids, (False, []))
                keys[ids] = (block, [*short, n])
                continue
            for k in range(0, len(ids) - self.size + 1, self.size):
                key = ids[k : k + self.size]
                keys[key] = (True, keys.get(key, (True, []))[1])
            streams.append(np.array(ids, np.int32))
            starts.append(np.arange(at, at + len(ids) - window + 1))
            of.append(np.full(len(ids) - window + 1, n, np.int32))
            at += len(ids)
        for key, (block, short) in keys.items():
            self.auto.add_word(key, (len(key), block, short))
        if keys:
            self.auto.make_automaton()
        self.stream = np.concatenate([*streams, np.zeros(window, np.int32)])
        start = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
        rows = self._rows(self.stream, start)
        hashes = self._hash(rows)
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1]).any(1)
        self.hashes, self.starts = hashes[order][new], start[order][new]
        self.first = np.r_[np.flatnonzero(new), len(order)]
        self.of = np.concatenate([*of, np.zeros(0, np.int32)])[order]

    def _rows(self, words: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(words, self.window)[start]

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        factor = np.random.default_rng(9).integers(1, 1 << 63, self.window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return (rows.astype(np.uint64) * factor).sum(1, dtype=np.uint64)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, last; they may overlap) and the items that hit."""
        known = self.vocabulary.get
        ids = tuple([known(w, 0) for w in words])
        runs, texts, near = [], set(), []
        for end, (size, block, short) in self.auto.iter(ids) if self.owners else ():
            if short:
                runs.append((end - size + 1, end))
                texts.update(short)
            if block:
                near.append(end - size + 1)
        last = len(ids) - self.window
        if near and last >= 0:
            around = np.unique(np.array(near)[:, None] - np.arange(self.window - self.size + 1))
            around = around[(around >= 0) & (around <= last)]
            rows = self._rows(np.array(ids, np.int32), around)
            hashes = self._hash(rows)
            at, stop = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, side="right")
            while (open_ := np.flatnonzero(at < stop)).size:  # more than once only where different windows share a hash
                same = open_[(self._rows(self.stream, self.starts[at[open_]]) == rows[open_]).all(1)]
                runs += [(a, a + self.window - 1) for a in around[same].tolist()]
                for k in np.unique(at[same]).tolist():
                    texts.update(self.of[self.first[k] : self.first[k + 1]].tolist())
                at[open_] += 1
        return runs, {i for n in texts for i in self.owners[n]}


def write_patterns(benchmark: DataFrame, window: int, shard_chars: int) -> list[str]:
    """Paths of the automata of all items, one for each shard_chars characters or part of them."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0]
    if not total:
        return []
    shards, out_dir = math.ceil(total / shard_chars), new_dir(benchmark.sparkSession, "patterns")

    def run(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        items = sorted(zip(table["id"].to_pylist(), table["text"].to_pylist()))
        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(pickle.dumps(Patterns(items, window)))
        return pa.table({"name": pa.array([name])})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    return [f"{out_dir}/{r['name']}" for r in dealt.groupBy("shard").applyInArrow(run, "name string").collect()]


_OPEN: dict[str, Patterns] = {}


def _patterns(uri: str, most: int = 2) -> Patterns:
    """Opened once in a worker process, which keeps the last few."""
    if uri not in _OPEN:
        from pyarrow import fs

        for old in list(_OPEN)[: max(0, len(_OPEN) - most + 1)]:
            del _OPEN[old]
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            _OPEN[uri] = pickle.loads(f.read())
    return _OPEN[uri]


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of 512 rows, joined to about most bytes if that is more than one of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            held.append(batch.slice(at, 512))
            if most <= BATCH_BYTES or sum(b.nbytes for b in held) >= most:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_batches(held)


def _merged(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"first": a, "last": b} for a, b in out]


def scan(documents: DataFrame, benchmark: DataFrame, window: int = 13, shard_chars: int = SHARD_CHARS, carry: list[str] = ()) -> DataFrame:
    """doc_id, text, n_words, hits (runs of hit words, by index) and items, one row per document; row: a struct of the columns in carry."""
    paths = write_patterns(benchmark, window, shard_chars)
    rows, schema = with_row(documents, carry, _RESULT)
    names = schema.names
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, min(64 << 20, BATCH_BYTES * len(paths))):
            words = [words_of(t) for t in part.column(1).to_pylist()]
            hits: list[list] = [[] for _ in words]
            items: list[set[str]] = [set() for _ in words]
            for path in paths:
                patterns = _patterns(path)
                for k, w in enumerate(words):
                    if w:
                        runs, own = patterns.scan(w)
                        hits[k] += runs
                        items[k] |= own
            made = ([len(w) for w in words], [_merged(h) for h in hits], [sorted(i) for i in items])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, k) for x, k in zip(made, kinds)), *part.columns[2:]], names)

    return rows.mapInArrow(run, schema)


def report(scanned: DataFrame) -> DataFrame:
    """The contract's columns: a document is contaminated if hits make up a twentieth of its words."""
    n_hit = hit_words()
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + (h["last"] - h["first"] + 1))


def contaminated() -> Column:
    return (hit_words() > 0) & (20 * hit_words() >= F.col("n_words"))


def spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of runs of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    points = lambda n: len(raw[:n].decode("utf-8", "surrogatepass"))
    return [(points(at[a][0]), points(at[b][1])) for a, b in hits]


def hit_spans(scanned: DataFrame) -> DataFrame:
    """doc_id and the hit passages, by offset in the original text, of documents with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, s, e, t[s:e]) for d, t, h in zip(*(batch.column(i).to_pylist() for i in range(3))) for s, e in spans(t, [(x["first"], x["last"]) for x in h])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "start", "stop", "passage"])

    return scanned.where(F.size("hits") > 0).select("doc_id", "text", "hits").mapInArrow(run, "doc_id long, start long, stop long, passage string")
