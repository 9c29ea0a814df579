"""Operator 6: sum-of-squares online packing of tokenized documents into fixed windows.

Every input partition packs its own documents as they arrive, so nothing is shuffled and memory is the
open windows of one partition. A document's full windows stand alone; what is left of it goes to the fill
level that minimises the sum of squared counts of partially filled windows. When a partition ends, its
open windows are topped up by cutting the emptiest ones, so at most one window of a partition is padded.

Null or empty texts are one end token; null doc_ids are kept; repeated rows are packed each for itself;
other columns are ignored; an empty table gives no rows. The order of equal choices: a fuller level first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """level[h]: how many open windows hold h tokens. place() puts whole pieces, finish() cuts and tops up."""

    def __init__(self, window: int):
        self.window, self.level = window, np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple) -> list | None:
        """piece: (doc_id, start, ids, doc_tokens), shorter than the window. Gives the window that it fills up, if any."""
        n, size = len(piece[2]) // 4, self.window
        count = self.level
        # growth of the sum of squares, halved: into level h it is count[h+n] - count[h] + 1, or less if the window closes
        grow = count[n + 1 : size + 1] - count[1 : size - n + 1] + 1.0
        grow[-1] = 0.5 - count[size - n]
        grow[count[1 : size - n + 1] == 0] = np.inf
        best = len(grow) - 1 - int(np.argmin(grow[::-1]))
        if grow[best] <= count[n] + 0.5:
            h = best + 1
            window = self.open[h].pop()
            count[h] -= 1
        else:
            h, window = 0, []
        window.append(piece)
        if h + n == size:
            return window
        count[h + n] += 1
        self.open.setdefault(h + n, []).append(window)
        return None

    def finish(self) -> Iterator[list]:
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open = {}
        lo, hi = 0, len(windows) - 1
        while lo <= hi:
            window = windows[lo]
            room = self.window - sum(len(p[2]) // 4 for p in window)
            while room and lo < hi:
                doc_id, start, ids, total = windows[hi].pop()
                take = min(room, len(ids) // 4)
                window.append((doc_id, start, ids[: 4 * take], total))
                if take < len(ids) // 4:
                    windows[hi].append((doc_id, start + take, ids[4 * take :], total))
                room -= take
                if not windows[hi]:
                    hi -= 1
            yield window
            lo += 1


def pack(documents: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: where it comes from (doc_id, start, length), its ids (little-endian unsigned 32-bit), and its place (sequence_id, offset)."""
    end = int(end_id).to_bytes(4, "little")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), LevelPacker(window)
        base = TaskContext.get().partitionId() << 36
        made, rows, weight = 0, [], 0

        def emit(pieces: list) -> None:
            nonlocal made, weight
            at = 0
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc_id, start, n, ids, total, base + made, at))
                weight += len(ids)
                at += n
            made += 1

        def flush() -> pa.RecordBatch:
            nonlocal rows, weight
            out = pa.RecordBatch.from_arrays([pa.array(c, type=pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*rows))], names)
            rows, weight = [], 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    full = total // window * window
                    for s in range(0, full, window):
                        emit([(doc_id, s, ids[4 * s : 4 * (s + window)], total)])
                    if full < total and (done := packer.place((doc_id, full, ids[4 * full :], total))):
                        emit(done)
                if weight > 8 << 20:
                    yield flush()
        for pieces in packer.finish():
            emit(pieces)
        if rows:
            yield flush()

    return id_text(documents).mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """The contract's columns of packed pieces."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
