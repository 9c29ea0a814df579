"""Operator 10: language ID with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on the driver, from a bounded sample of
labelled rows (MAX_FIT documents, a documented parameter, shared out evenly over all languages), from the whole of
each text, cut into sequences of FIT_STEPS bytes, every one of which it sees. Prediction runs in tasks: whole texts are
cut into sequences of STEPS bytes, every position is labelled, and a document pools the probabilities of all
its positions.

Null texts and texts without a letter are `und` with score 0; rows with a null language are not learned
from (an empty one is a language); repeated rows are judged each for itself; a null doc_id is never held out and never learned from;
other columns are ignored; with nothing to learn from, every document is `und`; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import with_row

HIDDEN = 8
STEPS = 128
FIT_STEPS = 64
MAX_FIT = 1500
#: Sequences times languages that are worked on at once, so that memory does not grow with the number of languages.
CELLS = 1 << 16
#: A table of so many languages goes to all tasks; a larger one is joined.
MOST_BROADCAST = 1 << 14
UNKNOWN = "und"
RESULT = "doc_id long, lang_pred string, score double, shares array<double>"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteBiGRU:
    """Two gated recurrent layers, one for each direction, and a softmax at every position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, classes
        self.p: dict[str, np.ndarray] = {"o": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 1 / math.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(3 * hidden, np.float32)
            self.p["w" + d] = rng.normal(0, 1 / math.sqrt(hidden), (hidden, classes)).astype(np.float32)

    def _steps(self, d: str, data: np.ndarray, live: np.ndarray, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Hidden states; data is time-major. A padded position leaves the state as it was."""
        h, table, u = self.h, self.p["x" + d] + self.p["c" + d], self.p["u" + d]
        state = np.zeros((data.shape[1], h), np.float32)
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            x, s = table[data[t]], state @ u
            gates = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
            after = new + z * (state - new)
            after = np.where(live[t][:, None], after, state)
            if keep is not None:
                keep.append((t, state, s, z, r, new, after))
            state = after
            yield t, state

    def probabilities(self, data: np.ndarray, live: np.ndarray) -> np.ndarray:
        """(time, sequence, class)"""
        logits = np.broadcast_to(self.p["o"], (*data.shape, self.k)).copy()
        for d in "fb":
            w = self.p["w" + d]
            for t, state in self._steps(d, data, live):
                logits[t] += state @ w
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, live: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h, g = self.h, {k: np.zeros_like(v) for k, v in self.p.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        logits = np.broadcast_to(self.p["o"], (*data.shape, self.k)).copy()
        for d in "fb":
            for t, state in self._steps(d, data, live, kept[d]):
                logits[t] += state @ self.p["w" + d]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        n = max(1, int(live.sum()))
        of = np.take_along_axis(prob, np.broadcast_to(label[None, :, None], (*data.shape, 1)), 2)[:, :, 0]
        loss = float(-(np.log(of + 1e-9) * live).sum() / n)
        delta = prob
        delta[:, np.arange(len(label)), label] -= 1
        delta *= (live / n)[:, :, None]
        g["o"] = delta.sum((0, 1))
        for d in "fb":
            u, w = self.p["u" + d], self.p["w" + d]
            back = np.zeros((data.shape[1], h), np.float32)
            for t, state, s, z, r, new, after in reversed(kept[d]):
                g["w" + d] += after.T @ delta[t]
                da = back + delta[t] @ w.T
                on = live[t][:, None]
                dlive = np.where(on, da, 0)
                dnew = dlive * (1 - z) * (1 - new * new)
                dz = dlive * (state - new) * z * (1 - z)
                dr = dnew * s[:, 2 * h :] * r * (1 - r)
                dx = np.concatenate([dz, dr, dnew], 1)
                ds = np.concatenate([dz, dr, dnew * r], 1)
                np.add.at(g["x" + d], data[t], dx)
                g["c" + d] += dx.sum(0)
                g["u" + d] += state.T @ ds
                back = np.where(on, dlive * z, da) + ds @ u.T
        return loss, g

    def fit(self, data: np.ndarray, sizes: np.ndarray, label: np.ndarray, rounds: int = 260, batch: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """Adam over batches in random order, as many rounds as it takes to see every sequence, or more; data is (sequence, time), label the class of each sequence."""
        rng = np.random.default_rng(seed)
        rounds = max(rounds, -(-len(data) // batch))
        order = np.concatenate([rng.permutation(len(data)) for _ in range(-(-rounds * batch // len(data)))])
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for i in range(1, rounds + 1):
            some = order[(i - 1) * batch : i * batch]
            live = (np.arange(data.shape[1])[:, None] < sizes[some]).astype(bool)
            g, total, cut = {k: np.zeros_like(v) for k, v in self.p.items()}, max(1, int(live.sum())), max(8, CELLS // self.k)
            for at in range(0, len(some), cut):
                part = slice(at, at + cut)
                _, more = self.gradients(np.ascontiguousarray(data[some[part]].T), live[:, part], label[some[part]])
                for k, x in more.items():
                    g[k] += x * (max(1, int(live[:, part].sum())) / total)
            norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            now = rate * (0.5 + 0.5 * math.cos(math.pi * i / rounds))
            for k, x in g.items():
                x = x * scale
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-7)).astype(np.float32)


def sequences(texts: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time-major bytes, which of them are real, and the text of each sequence."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pieces = -(-sizes // steps)
    owner = np.repeat(np.arange(len(texts)), pieces)
    flat = np.frombuffer(b"".join(t.ljust(int(p) * steps, b"\0") for t, p in zip(texts, pieces)), np.uint8).reshape(-1, steps)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    live = np.arange(steps)[:, None] < np.minimum(sizes[owner] - nth * steps, steps)
    return np.ascontiguousarray(flat.T), live, owner


def held_out(doc_id: Column, mod: int, at: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; null ids do not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == at, F.lit(False))


def quota(counts: list[int], most: int) -> int:
    """The largest equal share, one at least, at which groups of these sizes give no more than most rows together."""
    left = most
    for k, n in enumerate(sorted(counts)):
        share = left // (len(counts) - k)
        if n > share:
            return max(1, share)
        left -= n
    return max(1, *counts)


def sample(labelled: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """lang and text (whole, each once in a language) of at most max_fit rows that teach something, or one of each language if those are more.

    Every language gives the same share of its texts, those with the least hashes, and all of them if it has no more
    than that. Where it has more, only about twice the share is sorted.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null and text <> ''").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    if not counts:
        return rows.select("lang", "text")
    share = quota(list(counts.values()), max_fit)
    reach = lambda n: 2**63 - 1 if n <= 2 * (share + 64) else int(2 * (share + 64) / n * 2**64) - 2**63
    cuts = spark.createDataFrame([(lang, reach(n)) for lang, n in counts.items()], "lang string, most long")
    cuts = F.broadcast(cuts) if len(counts) <= MOST_BROADCAST else cuts
    some = rows.join(cuts, "lang").where("h <= most").select("lang", "h", "text").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return some.withColumn("nth", nth).where(F.col("nth") <= share).select("lang", "text")


def train(labelled: DataFrame, max_fit: int = MAX_FIT) -> tuple[ByteBiGRU, list[str]] | None:
    """labelled: text and lang. Learns from sample(); null where there is nothing to learn from."""
    got = sorted((r["lang"], r["text"].encode("utf-8", "surrogatepass")) for r in sample(labelled, max_fit).collect())
    if not got:
        return None
    langs = sorted({lang for lang, _ in got})
    of = {lang: k for k, lang in enumerate(langs)}
    data, live, owner = sequences([text for _, text in got], FIT_STEPS)
    model = ByteBiGRU(len(langs))
    model.fit(np.ascontiguousarray(data.T), live.sum(0), np.array([of[lang] for lang, _ in got])[owner])
    return model, langs


def predict(documents: DataFrame, model: tuple[ByteBiGRU, list[str]] | None, batch: int = 4096, carry: list[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score and shares (pooled probability of each language) of every row; row: a struct of the columns in carry."""
    net, langs = model or (None, [])
    batch = max(16, min(batch, CELLS // max(1, len(langs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for part in _by_weight(table):
                texts = part.column(1).to_pylist()
                n = len(texts)
                known = np.array([net is not None and t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                data, live, owner = sequences([t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(texts, known)], STEPS)
                total = np.zeros((n, max(1, len(langs))))
                for at in range(0, len(owner), batch):
                    cut = slice(at, at + batch)
                    prob = net.probabilities(data[:, cut], live[:, cut])
                    prob *= live[:, cut][:, :, None]
                    np.add.at(total, owner[cut], prob.sum(0))
                shares = total / np.maximum(total.sum(1, keepdims=True), 1e-12)
                best = shares.argmax(1)
                names = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)]
                score = np.where(known, np.clip(shares.max(1), 0, 1), 0.0)
                out = [part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(shares.tolist(), pa.list_(pa.float64())), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "shares", *part.schema.names[2:]])

    rows, schema = with_row(documents, carry, RESULT)
    return rows.mapInArrow(run, schema)


def _by_weight(table: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about most bytes of text."""
    sizes = np.array([0 if s is None else s for s in pc.binary_length(table.column(1)).to_pylist()], np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < table.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield table.slice(at, stop - at)
        at = stop


def identify(documents: DataFrame, max_fit: int = MAX_FIT, carry: list[str] = ()) -> DataFrame:
    """Learn from three quarters of the labelled documents, by crc32 of the id, and predict for all."""
    learn = documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    found = predict(documents, train(learn, max_fit), carry=carry)
    return found.withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
