"""Operator 2: substring dedup with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of (window + 1) // 2 words; any window holds a
whole one. All rolling spans of that length probe the index of reference blocks (by hash ranges, one entry
a text block). Hits are extended to all windows around them; windows of one text block are compared by
their bytes, those of different text blocks are brought together by digests of 72 to 128 bits, each with the one before
it only, so that no group grows with its copies. Windows in a row with the same partner are one maximal
repeat: its words go to the partner's text block and are compared there with the partner's own, byte by byte,
and only what is equal is removed. A digest that two different windows share is an error, not a removal.

Words part at ASCII white space and stay unchanged. Null or empty texts have no words; rows with equal
doc_ids are different documents (so repeated rows remove each other's words); null doc_ids are kept;
other columns are ignored; an empty table gives no rows. Texts shorter than a window lose nothing; texts larger
than a block go through in parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .common import spool

RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,stop:long>>, kept binary"


class _Words:
    """The words of a block: where each starts and stops, and which document it is of."""

    def __init__(self, table: pa.Table):
        self.block_id, self.doc_ids, self.extras, sizes, body = B.opened(table)
        self._read(body, sizes)

    @classmethod
    def of(cls, text: bytes) -> _Words:
        """The words of one document."""
        words = cls.__new__(cls)
        words._read(np.frombuffer(text, np.uint8), np.array([text.count(b" ") + 1]))
        return words

    def _read(self, body: np.ndarray, sizes: np.ndarray) -> None:
        self.body, self.sizes = body, sizes
        space = np.flatnonzero(body == 32)
        n = int(self.sizes.sum())
        self.start = np.r_[0, space + 1][:n]
        self.stop = np.r_[space, len(body)][:n]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.nth = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def grams(self, size: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of runs of size words within a document, of those first words or of all."""
        n = len(self.start) - size + 1
        first = np.flatnonzero(self.doc[: max(n, 0)] == self.doc[size - 1 :][: max(n, 0)]) if at is None else at
        if not len(first):
            return first, np.zeros(0, np.uint64)
        return first, B.Rolling(self.body).spans(self.start[first], self.stop[first + size - 1])


def _normal(data: bytes) -> tuple[bytes, int]:
    words = data.split()
    return b" ".join(words), len(words)


def _distinct(hashes: np.ndarray, *flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct hashes, which occur twice here, flags that hold for any of each, and each hash's place."""
    order, first, group = B.groups(hashes)
    many = np.diff(np.r_[first, len(hashes)]) > 1
    any_of = [np.logical_or.reduceat(f[order], first) if len(first) else f for f in flags]
    return hashes[order][first], many, any_of, group


def _candidates(words: _Words, window: int, hit_first: np.ndarray, hit: np.ndarray, size: int) -> np.ndarray:
    """First words of the windows of a document that hold a hit."""
    n = len(words.start)
    reach = np.zeros(n + 1, np.int64)
    at = hit_first[hit]
    np.add.at(reach, np.maximum(at - (window - size), 0), 1)
    np.add.at(reach, at + 1, -1)
    near = np.cumsum(reach[:-1]) > 0
    first = np.flatnonzero(near[: max(n - window + 1, 0)])
    return first[words.doc[first] == words.doc[first + window - 1]]


CLAIMS = "range int, block_id long, n int, payload binary"
REPEATS = "block_id long, other long, n int, payload binary"
FOUND = "block_id long, range int, n int, payload binary"


def _digest(words: bytes, seed: int = 42) -> int:
    from xxhash import xxh3_128_intdigest

    return xxh3_128_intdigest(words, seed)


def _put(*columns: np.ndarray, more: bytes = b"") -> bytes:
    """Columns of equal length as byte planes, which leaves little of small values and steady steps, and further bytes."""
    return B.pack(b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns if len(c)) + more)


def _get(n: int, data: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    """What _put() packed: n values of each kind, and the rest."""
    raw, at, out = B.unpack(data), 0, []
    for kind in kinds:
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).reshape(-1))
        at += n * wide
    return out, raw[at:]


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences, from the first value on; np.cumsum takes them back."""
    return np.diff(values, prepend=values.dtype.type(0))


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _classes(words: _Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Which of the windows at these first words are equal, by their bytes: a class for each, where a class begins, its bytes."""
    body, known = words.body.tobytes(), {}
    of = [known.setdefault(body[a:b], len(known)) for a, b in zip(words.start[at].tolist(), words.stop[at + window - 1].tolist())]
    group = np.array(of, np.int64)
    first = at[np.unique(group, return_index=True)[1]] if len(at) else at
    return group, first, list(known)


def _with_the_one_before(table: pa.Table) -> pa.Table:
    """Of windows (digest, block, first word) with one digest, each after the first with the one before it: rows for the block of the later one."""
    ns, data = (table[c].to_pylist() for c in ("n", "payload"))
    parts = [_get(n, d, "<u8", "<u8", "<i4")[0] for n, d in zip(ns, data)]
    high = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    low, at = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    block = np.repeat(table["block_id"].to_numpy(), ns)
    order = np.lexsort((block, low, high))
    same = np.flatnonzero((high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1]))
    before, after = order[same], order[same + 1]
    by = np.lexsort((at[after], block[after]))
    before, after = before[by], after[by]
    cuts = np.r_[0, np.flatnonzero(np.diff(block[after])) + 1, len(after)] if len(after) else [0]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own, far = at[after[a:b]], at[before[a:b]]
        rows.append((table["range"][0].as_py(), int(block[after[a]]), int(b - a), _put(_steps(own), far - own, _steps(block[before[a:b]].astype("<i8")))))
    return _table(CLAIMS, rows)


def _repeats(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Maximal runs of windows with partners in a row, with their words, for the partners' blocks."""

    def run(block: pa.Table, claims: pa.Table) -> pa.Table:
        if not claims.num_rows:
            return _table(REPEATS, [])
        words = _Words(block)
        parts = [_get(n, d, "<i4", "<i4", "<i8")[0] for n, d in zip(claims["n"].to_pylist(), claims["payload"].to_pylist())]
        own, other = (np.concatenate([np.cumsum(p[k], dtype=np.int64) for p in parts]) for k in (0, 2))
        far = own + np.concatenate([p[1] for p in parts])
        order = np.lexsort((own, own - far, other))
        own, far, other = own[order], far[order], other[order]
        new = np.r_[True, (other[1:] != other[:-1]) | (own[1:] != own[:-1] + 1) | (far[1:] != far[:-1] + 1)]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(own)])
        body = words.body.tobytes()
        starts, stops = words.start[own[first]], words.stop[own[first] + size + window - 2]
        rows, cuts = [], np.r_[0, np.flatnonzero(np.diff(other[first])) + 1, len(first)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            some = slice(a, b)
            said = b"".join(body[x:y] for x, y in zip(starts[some].tolist(), stops[some].tolist()))
            head = [own[first[some]].astype("<i4"), far[first[some]].astype("<i4"), size[some].astype("<i4"), (stops - starts)[some].astype("<i8")]
            rows.append((int(other[first[a]]), words.block_id, b - a, _put(*head, more=said)))
        return _table(REPEATS, rows)

    return run


def _compared(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Runs whose words are those of the partner, for both blocks."""

    def run(block: pa.Table, repeats: pa.Table) -> pa.Table:
        if not repeats.num_rows:
            return _table(FOUND, [])
        words = _Words(block)
        body, rows, mine = words.body.tobytes(), [], []
        for other, n, data in zip(repeats["other"].to_pylist(), repeats["n"].to_pylist(), repeats["payload"].to_pylist()):
            (own, far, size, length), said = _get(n, data, "<i4", "<i4", "<i4", "<i8")
            ends = np.cumsum(length)
            starts, stops = words.start[far], words.stop[far + size + window - 2]
            for a, b, x, y in zip((ends - length).tolist(), ends.tolist(), starts.tolist(), stops.tolist()):
                if said[a:b] != body[x:y]:
                    raise ValueError("two different windows have one digest; take another seed")
            rows.append((other, 0, n, _put(own, size)))
            mine.append((far, size))
        far, size = (np.concatenate(x) for x in zip(*mine))
        return _table(FOUND, [*rows, (words.block_id, 0, len(far), _put(far.astype("<i4"), size.astype("<i4")))])

    return run


def dedup(documents: DataFrame, window: int = 35, carry: list[str] = (), seed: int = 42) -> DataFrame:
    """Remove every word covered by a window of words that also starts anywhere else. seed: of the windows' digests."""
    size = (window + 1) // 2
    blocks, total, long = B.make(documents, _normal, b" ", list(carry), _parts(window))
    count = total / 5.0
    ranges = B.ranges_for(count)
    drop = np.uint64(64 - min(64, max(32, math.ceil(math.log2(count + 2)) + 12)))  # probes may hit falsely once in 4096

    # bits of a digest beyond the first 64: two different windows share one with a chance below one in 2 ** 16 over the whole run
    spare = np.uint64((1 << max(8, min(64, 2 * math.ceil(math.log2(count + 2)) + 16 - 64))) - 1)

    def probes(words: _Words) -> tuple[np.ndarray, ...]:
        first, hashes = words.grams(size)
        hashes = hashes >> drop << drop
        return first, *_distinct(hashes, words.nth[first] % size == 0)

    def ask_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = _Words(pa.Table.from_batches([batch.slice(k, 1)]))
                _, values, many, (index,), _ = probes(words)
                yield B.sent_batch(list(B.send(words.block_id, values, ranges, many, index)))

    def judge_probes(values: np.ndarray, owner: np.ndarray, many: np.ndarray, index: np.ndarray) -> np.ndarray:
        order, first, group = B.groups(values)
        twice = (np.diff(np.r_[first, len(values)]) > 1) | np.logical_or.reduceat(many[order], first)
        return (twice & np.logical_or.reduceat(index[order], first))[group]

    def ask_windows(block: pa.Table, verdicts: pa.Table) -> pa.Table:
        words = _Words(block)
        first, _, _, _, group = probes(words)
        at = _candidates(words, window, first, B.verdict(verdicts)[group] if len(first) else np.zeros(0, bool), size)
        group, begin, said = _classes(words, at, window)
        digests = [_digest(s, seed) for s in said]
        high, low = (np.array([d >> k & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64) for k in (64, 0))
        order = np.argsort(high, kind="stable")
        high, low, begin_ = high[order], (low & spare)[order], begin[order].astype("<i4")
        cuts, rows = B.range_cuts(high, ranges), []
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if a < b:
                rows.append((k, words.block_id, b - a, _put(_steps(high[a:b]), low[a:b], begin_[a:b])))
        known = _put(_steps(at.astype("<i4")), _steps(group.astype("<i4")))
        return _table(CLAIMS, [*rows, (-1, words.block_id, len(at), known)])

    def repeated(block: pa.Table, found: pa.Table) -> tuple[_Words, np.ndarray]:
        words = _Words(block)
        hit = np.zeros(len(words.start) + 1, np.int64)
        at = group = np.zeros(0, np.int64)
        for kind, n, data in zip(*(found[c].to_pylist() for c in ("range", "n", "payload"))):
            if kind < 0:
                at, group = (np.cumsum(x, dtype=np.int64) for x in _get(n, data, "<i4", "<i4")[0])
            else:
                begin, many = _get(n, data, "<i4", "<i4")[0]
                np.add.at(hit, begin, 1)
                np.add.at(hit, begin + many, -1)
        if not len(at):
            return words, _gone(words, at, window)
        members = np.bincount(group)
        begin = at[np.unique(group, return_index=True)[1]]
        twice = (members > 1) | (np.cumsum(hit[:-1])[begin] > 0)
        return words, _gone(words, at[twice[group]], window)

    def remove(block: pa.Table, found: pa.Table) -> pa.Table:
        words, gone = repeated(block, found)
        return _result(words.doc_ids, words.extras, words, gone)

    def part(block: pa.Table, found: pa.Table) -> pa.Table:
        words, gone = repeated(block, found)
        at, own = block["start"][0].as_py(), block["own"][0].as_py()
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
        return B.part_row(block, words.doc_ids[0], words.body[: words.stop[own - 1]].tobytes(), [{"start": a + at, "stop": b + at} for a, b in zip(edge[::2], edge[1::2])], words.extras)

    def assemble(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("start")
        words = _Words.of(b" ".join(parts["body"].to_pylist()))
        gone = np.zeros(len(words.start), bool)
        for spans in parts["spans"].to_pylist():
            for s in spans:
                gone[s["start"] : s["stop"]] = True
        return _result([parts["doc_id"][0].as_py()], parts["extra"].combine_chunks()[:1], words, gone)

    sent = blocks.mapInArrow(ask_probes, B.SENT)
    hits = B.judged(sent, judge_probes, 2)
    asked = spool(B.meet(blocks, hits, ask_windows, CLAIMS), "windows", "none")
    claims = asked.where("range >= 0").groupBy("range").applyInArrow(_with_the_one_before, CLAIMS)
    repeats = B.meet(blocks, claims, _repeats(window), REPEATS)
    equal = B.meet(blocks, repeats, _compared(window), FOUND)
    known = asked.where("range < 0").select("block_id", "range", "n", "payload")
    return B.finished(blocks, equal.unionByName(known), remove, part, assemble, B.with_extra(RESULT, "extra", B.extra_kind(blocks)), long)


def _parts(window: int) -> Callable[[bytes, int], Iterator[tuple[int, int, bytes, int]]]:
    def cut(data: bytes, size: int) -> Iterator[tuple[int, int, bytes, int]]:
        stop = np.r_[np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data)]
        start, at = np.r_[0, stop[:-1] + 1], 0
        while at < len(stop):
            own = max(1, int(np.searchsorted(stop, start[at] + size, side="right")) - at)
            last = min(len(stop), at + own + window - 1)
            yield at, own, data[start[at] : stop[last - 1]], last - at
            at += own

    return cut


def _gone(words: _Words, first: np.ndarray, window: int) -> np.ndarray:
    """Which words of a block the windows at these first words cover."""
    n = len(words.start)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _result(doc_ids: list, extras: pa.Array, words: _Words, gone: np.ndarray) -> pa.Table:
    ends = np.cumsum(words.sizes)
    removed, spans, kept = [], [], []
    body = words.body.tobytes()
    for a, b in zip((ends - words.sizes).tolist(), ends.tolist()):
        out = gone[a:b]
        count = int(out.sum())
        removed.append(count)
        if not count:
            spans.append([])
            kept.append(body[words.start[a] : words.stop[b - 1]] if b > a else b"")
            continue
        edge = np.diff(np.r_[False, out, False].astype(np.int8))
        runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        spans.append([{"first": x, "stop": y} for x, y in runs])
        parts = [(x, y) for x, y in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), b - a]) if x < y]
        kept.append(b" ".join(body[words.start[a + x] : words.stop[a + y - 1]] for x, y in parts))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
    return pa.table({
        "doc_id": pa.array(doc_ids, pa.int64()),
        "n_words": pa.array(words.sizes, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "spans": pa.array(spans, kind),
        "kept": pa.array(kept, pa.binary()),
        "extra": extras,
    })
