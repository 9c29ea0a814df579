"""Operator 1: suffix-array dedup, blockwise with a difference cover.

Stage by stage:
1. Texts lie in blocks. Each window of `window` bytes is filed under its anchor, the ANCHOR-byte string in
   it with the least hash; windows with the same bytes have the same anchor at the same place. Blocks ask
   which anchors occur elsewhere; suffixes under other anchors can have no twin and are not sorted.
2. Suffixes under live anchors go, with the bytes they need, to suffix ranges; copies within a block go
   once, with their smallest doc_id.
3. A range ranks its difference-cover samples (columns c with c mod V in D), then sorts its suffixes one
   leading-byte bucket at a time: by HEAD bytes first; longer ties by the ranks of cover samples at
   the offset that both suffixes of a comparison have in the cover. Neighbours that share the window's
   bytes form a class, and its smallest doc_id tells which suffixes also start in an earlier document.
4. Verdicts return to the blocks as bits and become byte spans.

Null or empty texts have no bytes; documents with equal doc_ids never remove each other's bytes; a null
doc_id counts as larger than any other; other columns are ignored; an empty table gives no rows; texts
shorter than the window lose nothing; texts larger than a block go through in parts. Bytes are removed wherever the window says, so what is left need not
be whole characters; `kept` is binary for that reason.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .common import spool

ANCHOR = 20
HEAD = 16
#: A perfect difference set: every difference modulo V is that of two elements of D. Fixed values.
V, D = 13, (0, 1, 3, 9)
BUCKET_SUFFIXES = 1 << 18
NO_ID = np.iinfo(np.int64).max
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def common_offset(a: int, b: int) -> int:
    """The least offset below V at which residues a and b are both in the cover."""
    return next(t for t in range(V) if (a + t) % V in D and (b + t) % V in D)


class _Pieces:
    """Windows of a block by anchor: distinct pieces of bytes, each with the columns at which windows start."""

    def __init__(self, table: pa.Table, window: int):
        self.block_id, doc_ids, self.extras, self.sizes, self.body = B.opened(table)
        self.doc_ids, self.window = doc_ids, window
        ids = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
        self.slots = window - ANCHOR + 1
        self.width = window + self.slots - 1
        self.padded: np.ndarray | None = None
        body, n = self.body, len(self.body)
        count = max(n - window + 1, 0)
        if not count:
            self.at = np.zeros(0, np.int64)
            self.lo = self.hi = self.at
            self._empty()
            return
        h = B.Rolling(body).fixed(ANCHOR)
        key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        least, span = key, 1
        while 2 * span <= self.slots:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < self.slots:
            rest = self.slots - span
            least = np.minimum(least[:-rest], least[rest:])
        anchor = (least[:count] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        valid = doc[:count] == doc[window - 1 :]
        first = np.flatnonzero(valid & np.r_[True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]])
        stop = np.flatnonzero(valid & np.r_[(anchor[1:] != anchor[:-1]) | ~valid[1:], True])
        self.at = anchor[first]
        self.lo, self.hi = first - self.at + self.slots - 1, stop - self.at + self.slots - 1
        self.doc = doc[first]
        self.hash = B.mix(h[self.at])  # least hashes lie close together; mixed again they spread over the ranges
        # distinct pieces: the span of bytes and where windows start in it
        spans = B.Rolling(body).spans(first, stop + window)
        whole = B.mix(spans ^ B.mix((self.lo * 64 + self.hi).astype(np.uint64)))
        # by anchor, then by piece; hashes only bring together what the bytes then decide
        order = np.lexsort((ids[self.doc], whole, self.hash))
        new = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (self.hash[order][1:] != self.hash[order][:-1])]
        alike = np.flatnonzero(~new)
        for part in range(0, len(alike), 1 << 16):
            at = alike[part : part + (1 << 16)]
            one, other = order[at], order[at - 1]
            same = (self.lo[one] == self.lo[other]) & (self.hi[one] == self.hi[other])
            new[at] = ~same | (self._bytes(one) != self._bytes(other)).any(axis=1)
        self.head = order[new]  # of equal pieces the one with the smallest doc_id
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.least_id = ids[self.doc[self.head]]
        self.ids = ids
        anchors = self.hash[self.head]
        self.new_anchor = np.r_[True, anchors[1:] != anchors[:-1]]
        self.anchors = anchors[self.new_anchor]
        self.anchor_of = np.cumsum(self.new_anchor) - 1
        starts = np.flatnonzero(self.new_anchor)
        self.many = np.diff(np.r_[starts, len(anchors)]) > 1

    def _empty(self) -> None:
        self.head = self.group = self.anchor_of = self.least_id = np.zeros(0, np.int64)
        self.anchors = self.hash = np.zeros(0, np.uint64)
        self.many = np.zeros(0, bool)
        self.doc = np.zeros(0, np.int32)

    def _bytes(self, which: np.ndarray) -> np.ndarray:
        """Bytes around the anchors of pieces; zero outside their windows."""
        if self.padded is None:
            self.padded = np.concatenate([np.zeros(self.slots - 1, np.uint8), self.body, np.zeros(self.window, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(self.padded, self.width)[self.at[which]]
        column = np.arange(self.width, dtype=np.uint8)
        lo, hi = self.lo[which].astype(np.uint8)[:, None], self.hi[which].astype(np.uint8)[:, None]
        rows[(column < lo) | (column >= hi + np.uint8(self.window))] = 0
        return rows

    def rows(self, pick: np.ndarray) -> np.ndarray:
        """Bytes of the picked distinct pieces."""
        return self._bytes(self.head[pick])


def _words_at(rows: np.ndarray, r: np.ndarray, c: np.ndarray, depth: int) -> np.ndarray:
    """Big-endian 64-bit words of the depth bytes from column c of row r (rows are padded wide enough)."""
    view = np.lib.stride_tricks.sliding_window_view(rows, depth, axis=1)
    return np.ascontiguousarray(view[r, c]).view(">u8").astype(np.uint64)


def _string_ranks(strings: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of big-endian words, ties only being looked at further."""
    n, depth = strings.shape
    order = np.argsort(strings[:, 0], kind="stable")
    start = np.zeros(n, np.int64)
    tied, lo = order, None
    key = strings[order, 0]
    new = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
    start[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    for k in range(1, depth):
        s = start[order]
        same = np.r_[s[1:] == s[:-1], False]
        tied_at = np.flatnonzero(same | np.r_[False, same[:-1]])
        if not len(tied_at):
            break
        tied = order[tied_at]
        sub = np.lexsort((strings[tied, k], start[tied]))
        tied = tied[sub]
        order[tied_at] = tied
        g, key = start[tied], strings[tied, k]
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]
        start[tied] = np.maximum.accumulate(np.where(new, tied_at, 0))
    return start


class CoverRanks:
    """Ranks of the cover samples of rows: precomputed once, looked up by row and column."""

    def __init__(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int):
        width = int(hi.max()) + V + 1 if len(hi) else 1
        columns = np.array([c for c in range(width) if c % V in D])
        r, k = np.nonzero((columns >= lo[:, None]) & (columns < hi[:, None] + V))
        self.rank = np.full((len(rows), width), -1, np.int64)
        self.rank[r, columns[k]] = _string_ranks(_words_at(rows, r, columns[k], depth))

    def __getitem__(self, at: tuple) -> np.ndarray:
        return self.rank[at]


def suffix_order(rows: np.ndarray, r: np.ndarray, c: np.ndarray, cover: CoverRanks) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (r, c), and whether each in that order ties with the one before in its first HEAD bytes."""
    words = _words_at(rows, r, c, HEAD)
    order = np.lexsort((words[:, 1], words[:, 0]))
    w = words[order]
    tie = np.r_[False, (w[1:] == w[:-1]).all(axis=1)] if len(order) else np.zeros(0, bool)
    group = np.cumsum(~tie) - 1
    size = np.bincount(group)
    in_tie = size[group] > 1
    at = np.flatnonzero(in_tie)
    if not len(at):
        return order, tie
    own, g = order[at], group[at]
    residue = c[own] % V
    rank_at = lambda e, t: cover[r[own[e]], c[own[e]] + t]
    # within a residue, one offset serves all; across residues, count the smaller ones of each other residue
    place = np.zeros(len(own), np.int64)
    offsets = np.array([common_offset(a, a) for a in range(V)])
    members = [np.flatnonzero(residue == a) for a in range(V)]
    present = np.zeros((V, len(size)), bool)
    present[residue, g] = True
    span = np.int64(cover.rank.max() + 2)
    for a in range(V):
        e = members[a]
        if not len(e):
            continue
        key = g[e] * span + rank_at(e, offsets[a])
        seq = np.argsort(key, kind="stable")
        first = np.searchsorted(g[e][seq], g[e])
        pos = np.empty(len(e), np.int64)
        pos[seq] = np.arange(len(e))
        place[e] += pos - first
        for b in range(V):
            if b == a or not len(members[b]):
                continue
            mine = e[present[b, g[e]]]
            other = members[b][present[a, g[members[b]]]]
            if not len(mine) or not len(other):
                continue
            t = common_offset(a, b)
            theirs = np.sort(g[other] * span + rank_at(other, t))
            find = g[mine] * span + rank_at(mine, t)
            low = np.searchsorted(theirs, g[mine] * span)
            place[mine] += np.searchsorted(theirs, find, side="right" if b < a else "left") - low
    seq = np.lexsort((place, g))
    order[at] = own[seq]
    return order, tie


def earlier_starts(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For each row a bit mask of columns whose window also starts in a row with a smaller doc."""
    pad = -(-(int(hi.max()) + V + 1 + 8 * -(-window // 8)) // 8) * 8 if len(hi) else 0
    rows = np.pad(rows, ((0, 0), (0, max(0, pad - rows.shape[1]))))
    depth = 8 * (window // 8)
    cover = CoverRanks(rows, lo, hi, 8 * -(-window // 8))
    out = np.zeros(len(rows), np.uint64)
    sizes = hi - lo + 1
    r = np.repeat(np.arange(len(rows)), sizes)
    c = np.arange(len(r)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[r]
    lead = rows[r, c]
    load = np.cumsum(np.bincount(lead, minlength=256))
    by_lead = np.argsort(lead, kind="stable")
    begin, taken = 0, 0
    while begin < len(r):  # one bucket of leading bytes at a time
        upto = max(int(np.searchsorted(load, taken + BUCKET_SUFFIXES, side="right")) - 1, int(lead[by_lead[begin]]))
        stop = int(load[upto])
        bucket = by_lead[begin:stop]
        begin = taken = stop
        br, bc = r[bucket], c[bucket]
        order, tie = suffix_order(rows, br, bc, cover)
        br, bc = br[order], bc[order]
        at = np.flatnonzero(tie)
        same = np.zeros(len(order), bool)
        if len(at):
            view = np.lib.stride_tricks.sliding_window_view(rows, window - HEAD, axis=1)
            same[at] = (view[br[at], bc[at] + HEAD] == view[br[at - 1], bc[at - 1] + HEAD]).all(axis=1)
        starts = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(doc[br], starts), np.diff(np.r_[starts, len(br)]))
        hit = least < doc[br]
        np.bitwise_or.at(out, br[hit], np.uint64(1) << bc[hit].astype(np.uint64))
    return out


def _ranges(total: int) -> tuple[int, int]:
    """How many hash ranges for anchors (one per 14 bytes) and for pieces (80 bytes each, under 8 MB a range)."""
    return B.ranges_for(total / 14), max(1, math.ceil(total / 14 * 80 / (8 << 20)))


def dedup(documents: DataFrame, window: int = 50, carry: list[str] = (), as_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of window bytes that also starts in a document with a smaller doc_id.

    as_text: kept as a string, without the bytes of characters that were cut into.
    """
    if not 26 <= window <= ANCHOR + 62:
        raise ValueError("window must be 26 to 82 bytes")
    blocks, total, long = B.make(documents, lambda data: (data, len(data)), b"", list(carry), _parts(window))
    anchor_ranges, piece_ranges = _ranges(total)
    drop = np.uint64(64 - min(64, max(32, math.ceil(math.log2(total + 2)) + 10)))  # asked anchors may be live falsely once in thousands

    def asked(p: _Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors cut to fewer bits: distinct values, whether several pieces have one, and each piece's place."""
        cut = p.anchors >> drop << drop
        new = np.r_[True, cut[1:] != cut[:-1]] if len(cut) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        many = (np.logical_or.reduceat(p.many, first) | (np.diff(np.r_[first, len(cut)]) > 1)) if len(cut) else p.many
        return cut[new], many, (np.cumsum(new) - 1)[p.anchor_of] if len(cut) else p.anchor_of

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p = _Pieces(pa.Table.from_batches([batch.slice(k, 1)]), window)
                values, many, _ = asked(p)
                yield B.sent_batch(list(B.send(p.block_id, values, anchor_ranges, many)))

    def judge_anchors(values: np.ndarray, owner: np.ndarray, many: np.ndarray) -> np.ndarray:
        order, first, group = B.groups(values)
        return ((np.diff(np.r_[first, len(values)]) > 1) | np.logical_or.reduceat(many[order], first))[group]

    def send_pieces(block: pa.Table, verdicts: pa.Table) -> pa.Table:
        p = _Pieces(block, window)
        live = B.verdict(verdicts)
        pick = np.flatnonzero(live[asked(p)[2]]) if len(live) else np.zeros(0, np.int64)
        rows = []
        if len(pick):
            # the hash is the piece's anchor's, so all of an anchor meet in one range
            cuts = B.range_cuts(p.anchors[p.anchor_of[pick]], piece_ranges)
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if a < b:
                    some = pick[a:b]
                    head = p.head[some]
                    data = b"".join([p.lo[head].astype(np.uint8).tobytes(), p.hi[head].astype(np.uint8).tobytes(), p.least_id[some].astype("<i8").tobytes(), p.rows(some).tobytes()])
                    rows.append((k, p.block_id, b - a, B.pack(data)))
        rows.append((-1, p.block_id, len(live), B.pack(np.packbits(live).tobytes())))
        return pa.Table.from_batches([B.sent_batch(rows)])

    width = 2 * window - ANCHOR

    def sort_range(table: pa.Table) -> pa.Table:
        ns = np.array(table["n"].to_pylist(), np.int64)
        lo, hi, doc, rows = [], [], [], []
        for n, data in zip(ns.tolist(), table["payload"].to_pylist()):
            raw = np.frombuffer(B.unpack(data), np.uint8)
            lo.append(raw[:n])
            hi.append(raw[n : 2 * n])
            doc.append(raw[2 * n : 10 * n].view("<i8") if (2 * n) % 8 == 0 else np.frombuffer(raw[2 * n : 10 * n].tobytes(), "<i8"))
            rows.append(raw[10 * n :].reshape(n, width))
        lo, hi, doc, rows = (np.concatenate(x) for x in (lo, hi, doc, rows))
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        # equal pieces of different blocks are sorted once, under their smallest doc_id
        padded = np.pad(rows, ((0, 0), (0, -width % 8))).view(np.uint64)
        key = B.mix((lo * 64 + hi).astype(np.uint64))
        for k in range(padded.shape[1]):
            key = B.mix(key ^ padded[:, k])
        order, _, _ = B.groups(key)
        # hashes only bring together what the bytes then decide; equal pieces that a chance match parts are sorted apart, with the same result
        new = np.ones(len(order), bool)
        new[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1]) | (padded[order][1:] != padded[order][:-1]).any(axis=1)
        first = np.flatnonzero(new)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        head = order[first]
        least = np.minimum.reduceat(doc[order], first)
        mask = earlier_starts(rows[head], lo[head], hi[head], least, window)[group]
        # a piece whose own doc_id is not the smallest of its equals has all its windows in an earlier document
        every = ((np.uint64(1) << (hi + 1).astype(np.uint64)) - np.uint64(1)) & ~((np.uint64(1) << lo.astype(np.uint64)) - np.uint64(1))
        mask = np.where(least[group] < doc, every, mask)
        cuts = np.cumsum(np.r_[0, ns])
        bits = [B.pack(np.ascontiguousarray(mask[a:b].view(np.uint8).reshape(-1, 8).T).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"block_id": table["block_id"], "range": table["range"], "n": table["n"], "bits": pa.array(bits, pa.binary())})

    def masked(block: pa.Table, verdicts: pa.Table) -> tuple[_Pieces, np.ndarray]:
        p = _Pieces(block, window)
        rows = sorted(zip(*(verdicts[c].to_pylist() for c in ("range", "n", "bits"))))
        mask = np.zeros(len(p.head), np.uint64)
        if rows and rows[0][1]:
            live = np.unpackbits(np.frombuffer(B.unpack(rows[0][2]), np.uint8), count=rows[0][1]).astype(bool)
            pick = np.flatnonzero(live[asked(p)[2]])
            got = [np.ascontiguousarray(np.frombuffer(B.unpack(b), np.uint8).reshape(8, n).T).view(np.uint64).reshape(-1) for _, n, b in rows[1:]]
            if got:
                mask[pick] = np.concatenate(got)
        return p, _gone(p, mask)

    def remove(block: pa.Table, verdicts: pa.Table) -> pa.Table:
        p, gone = masked(block, verdicts)
        return _result(p.doc_ids, p.extras, p.sizes, p.body, gone, as_text)

    def part(block: pa.Table, verdicts: pa.Table) -> pa.Table:
        p, gone = masked(block, verdicts)
        at, own = block["start"][0].as_py(), block["own"][0].as_py()
        return B.part_row(block, p.doc_ids[0], p.body[:own].tobytes(), [{"start": a + at, "stop": b + at} for a, b in _runs(gone)], p.extras)

    def assemble(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("start")
        body = np.frombuffer(b"".join(parts["body"].to_pylist()), np.uint8)
        gone = np.zeros(len(body), bool)
        for spans in parts["spans"].to_pylist():
            for s in spans:
                gone[s["start"] : s["stop"]] = True
        return _result([parts["doc_id"][0].as_py()], parts["extra"].combine_chunks()[:1], np.array([len(body)]), body, gone, as_text)

    sent = blocks.mapInArrow(ask_anchors, B.SENT)
    live = B.judged(sent, judge_anchors, 1)
    pieces = spool(B.meet(blocks, live, send_pieces, B.SENT), "pieces", "none")
    sorted_ = pieces.where("range >= 0").groupBy("range").applyInArrow(sort_range, B.VERDICT)
    asked_for = pieces.where("range < 0").selectExpr("block_id", "range", "n", "payload as bits")
    schema = B.with_extra(RESULT.replace("kept binary", "kept string") if as_text else RESULT, "extra", B.extra_kind(blocks))
    return B.finished(blocks, sorted_.unionByName(asked_for), remove, part, assemble, schema, long)


def _parts(window: int) -> Callable[[bytes, int], Iterator[tuple[int, int, bytes, int]]]:
    def cut(data: bytes, size: int) -> Iterator[tuple[int, int, bytes, int]]:
        for at in range(0, len(data), size):
            piece = data[at : at + size + window - 1]
            yield at, min(size, len(data) - at), piece, len(piece)

    return cut


def _runs(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
    return list(zip(edge[::2], edge[1::2]))


def _gone(p: _Pieces, mask: np.ndarray) -> np.ndarray:
    """Which bytes of a block go."""
    n, window = len(p.body), p.window
    cover = np.zeros(n + 1, np.int32)
    if len(p.at):
        # of equal pieces in this block, those of larger doc_ids are repeats of the smallest
        later = p.ids[p.doc] > p.least_id[p.group]
        own = np.where(later, ~np.uint64(0), mask[p.group])
        for k in range(p.slots):
            on = np.flatnonzero((p.lo <= k) & (p.hi >= k) & ((own >> np.uint64(k)) & np.uint64(1)).astype(bool))
            start = p.at[on] - (p.slots - 1) + k  # all distinct
            cover[start] += 1
            cover[start + window] -= 1
    return np.cumsum(cover[:-1]) > 0


def _result(doc_ids: list, extras: pa.Array, sizes: np.ndarray, body: np.ndarray, gone: np.ndarray, as_text: bool) -> pa.Table:
    ends = np.cumsum(sizes)
    removed, spans, kept = [], [], []
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        out = gone[a:b]
        count = int(np.count_nonzero(out))
        removed.append(count)
        if not count:
            spans.append([])
            kept.append(body[a:b].tobytes())
            continue
        spans.append([{"start": x, "stop": y} for x, y in _runs(out)])
        kept.append(body[a:b][~out].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({
        "doc_id": pa.array(doc_ids, pa.int64()),
        "n_bytes": pa.array(sizes, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "spans": pa.array(spans, kind),
        "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
        "extra": extras,
    })
