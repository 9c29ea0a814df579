"""Operator 11: language-model scores from a gated recurrent network with a class-factored output.

Words of all training documents are counted on the cluster. The MODEL_WORDS most frequent ones are the network's
words, filed by frequency into classes: P(word) = P(class | state) P(word | class, state). One more class stands for every
other word, known or not, and shares its probability by the counts over the whole corpus, so the model's
probabilities sum to one. The network is trained in numpy by backpropagation through windows of FIT_STEPS tokens, the
state going on from window to window. It begins on the driver, with the whole texts of at most MAX_FIT different training
documents (a documented bound), and goes on with every training document: shards of about SHARD_TOKENS tokens, dealt by
a hash of id and text (so copies of a text are spread), are gone through side by side, each by a copy of the network, and the copies' parameters are
averaged by tokens, so the result hangs on the documents alone and not on how they are stored. Texts are cut into words
and numbered once, for learning and scoring; ids lie in the shared folder in between. Scoring runs in tasks: documents stream through lanes, window by window, each with its state
carried from its first token to its end.

Counts of the most frequent words, at most COMMON (of at most COMMON_BYTES bytes), go to every task, a table of bounded size; the other
words of a document, none of which is frequent, meet their counts in a join, once each, and are summed by document.

A null text is empty: one token, the end. A null doc_id is learned from never and is never held out; rows of one id
are scored each for itself; repeated training rows count each time, and once where the network begins; other columns are ignored; with nothing to learn from every token has probability one (base and model), an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, spool
from .language import held_out

END = b""
MODEL_WORDS = 4096
CLASSES = 64
HIDDEN = 16
COMMON = 1 << 16
COMMON_BYTES = 256
MAX_FIT = 1500
FIT_STEPS = 32
FIT_LANES = 48
#: Rounds over the sample; more for a small one, so that the network is changed so many times at least.
ROUNDS = 2
LEAST_UPDATES = 300
STEPS = 32
LANES = 384
#: Tokens of a shard that a task learns from; the rate that it begins with; parameters that are averaged at a time.
SHARD_TOKENS = 1 << 21
SHARD_RATE = 0.004
CHUNK = 4096
#: Places whose class logits are held at a time, and parameters that a step changes at a time: what stays in a core's cache.
PLACES, PARAMETERS = 2048, 1 << 15
#: Logits below this need no shift before they are exponentiated, in single precision.
CALM = 80.0
#: Words that a task counts before it hands their counts over.
HELD_WORDS = 400_000

SUMS = "row long, doc_id long, n_tokens long, n_known long, base double, score double"
PARTS = f"{SUMS}, h long, ids binary, others array<struct<word:binary,times:long>>"


def tokens_of(text: str | None) -> list[bytes]:
    """Words, and one end. bytes.lower and bytes.split know ASCII only."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


@dataclass
class Vocabulary:
    """Counts over the training documents: all tokens and different ones, and the common words with theirs, most frequent first."""

    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    model_words: int = MODEL_WORDS
    classes: int = CLASSES

    def __post_init__(self):
        self.k = min(self.model_words, len(self.words))
        self.at = dict(zip(self.words, range(len(self.words))))
        self.base_over = self.total + 0.5 * (self.distinct + 1)
        #: The mass of all words that are not the network's, and of one that was never seen.
        self.other_over = self.total - float(self.counts[: self.k].sum()) + 0.5 * (self.distinct - self.k + 1)
        self.base = np.log10((self.counts + 0.5) / self.base_over)
        self.other = np.log10((self.counts + 0.5) / self.other_over)
        self.other[: self.k] = 0.0
        rooted = np.cumsum(np.sqrt(self.counts[: self.k].astype(np.float64)))
        of = np.minimum((rooted * self.classes / rooted[-1]).astype(np.int64), self.classes - 1) if self.k else np.zeros(0, np.int64)
        _, of = np.unique(of, return_inverse=True)  # classes that have a word, numbered anew
        self.c = int(of.max()) + 1 if self.k else 0
        #: Class of each of the network's words and of the one id (k) for all others, which has class c to itself.
        self.class_of = np.r_[of, self.c].astype(np.int64)
        #: How the network's ids are stored.
        self.kind = np.dtype("<u2" if self.k < 1 << 16 else "<u4")
        self.first = np.searchsorted(self.class_of, np.arange(self.c + 2))  # members lie side by side, as classes go by frequency


def _rate(first: float, done: float) -> float:
    return first * (0.52 + 0.48 * math.cos(math.pi * min(1.0, done)))


class Adam:
    """Steps along gradients, which are cut at a norm of one. The parameters become parts of one array, which changes in place."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.names, self.flat, at = list(p), np.concatenate([x.ravel() for x in p.values()]), 0
        for k, x in p.items():
            p[k], at = self.flat[at : at + x.size].reshape(x.shape), at + x.size
        self.m, self.v, self.g = (np.zeros_like(self.flat) for _ in range(3))
        self.i, self.held = 0, np.empty(PARAMETERS, self.flat.dtype)

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        np.concatenate([g[k].ravel() for k in self.names], out=self.g)
        scale = min(1.0, 1.0 / (math.sqrt(float(self.g @ self.g)) + 1e-9))
        self.i += 1
        ahead, spread = rate / (1 - 0.9**self.i), 1 / (1 - 0.99**self.i)
        for at in range(0, len(self.flat), PARAMETERS):
            p, m, v, x = (a[at : at + PARAMETERS] for a in (self.flat, self.m, self.v, self.g))
            t = self.held[: len(p)]
            x *= scale
            np.subtract(x, m, out=t)
            t *= 0.1
            m += t
            x *= x
            x -= v
            x *= 0.01
            v += x
            np.multiply(v, spread, out=t)
            np.sqrt(t, out=t)
            t += 1e-6
            np.divide(m, t, out=t)
            t *= ahead
            p -= t


class GatedLM:
    """A gated recurrent layer over words, a softmax over classes and one over the members of a class."""

    def __init__(self, vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 5):
        v, rng = vocabulary, np.random.default_rng(seed)
        self.h, self.k, self.c, self.class_of, self.first = hidden, v.k, v.c, v.class_of, v.first
        self.start = v.at.get(END, v.k) if v.at.get(END, v.k) < v.k else v.k
        mass = np.r_[v.counts[: v.k] + 0.5, v.other_over]
        of_class = np.bincount(self.class_of, mass, self.c + 1)
        self.p = {
            "x": rng.normal(0, 0.2, (self.k + 1, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, 1 / math.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32),
            "wc": rng.normal(0, 0.05, (hidden, self.c + 1)).astype(np.float32),
            "bc": np.log(of_class / of_class.sum()).astype(np.float32),
            "wm": rng.normal(0, 0.05, (self.k + 1, hidden)).astype(np.float32),
            "bm": np.log(mass / of_class[self.class_of]).astype(np.float32),
        }

    def states(self, given: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """(time, lane) states: the first, and the one after each word; then both gates, new contents and what the state adds to each. given: the word before each; fresh: a document begins."""
        h, kind, shape = self.h, self.p["u"].dtype, given.shape
        half = np.array([0.5, 0.5, 1], kind)[:, None, None]  # sigmoid(v) is tanh(v / 2) / 2 + 1 / 2
        x = np.take(self._split("x") * half, given, 1)
        u = self._split("u") * half
        path, new = np.empty((shape[0] + 1, shape[1], h), kind), np.empty((*shape, h), kind)
        gates, added = np.empty((2, *shape, h), kind), np.empty((3, *shape, h), kind)
        path[0] = state
        begins = fresh.any(1).tolist()
        for t in range(shape[0]):
            before, g, n, after = path[t], gates[:, t], new[t], path[t + 1]
            if begins[t]:
                before = before.copy()
                before[fresh[t]] = 0
            s = np.matmul(before, u, out=added[:, t])
            np.add(x[:2, t], s[:2], out=g)
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.multiply(g[1], s[2], out=n)
            n += x[2, t]
            np.tanh(n, out=n)
            np.subtract(before, n, out=after)
            after *= g[0]
            after += n
        return path, gates, new, added

    def _split(self, name: str) -> np.ndarray:
        """A parameter's columns for the update gate, the reset gate and new contents, one behind the other."""
        return np.ascontiguousarray(self.p[name].reshape(-1, 3, self.h).transpose(1, 0, 2))

    def _outputs(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights with biases as one more entry: of classes, of words; and whether all logits are small."""
        of_class, of_word = np.vstack([self.p["wc"], self.p["bc"]]), np.hstack([self.p["wm"], self.p["bm"][:, None]])
        most = max(1.0, float(np.abs(state).max(initial=0))) * max(float(np.abs(of_class).sum(0).max()), float(np.abs(of_word).sum(1).max()))
        return of_class, of_word, most < CALM

    def _by_class(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """The order by class, the states in it with a one behind each, the words in it; and for each class of more than one word its places and words."""
        of = self.class_of[word].astype(np.min_scalar_type(self.c))
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.c + 1)).tolist()
        flat = np.ones((len(word), self.h + 1), state.dtype)
        flat[:, : self.h] = state[order]
        first = self.first.tolist()
        return order, flat, word[order], [(cuts[k], cuts[k + 1], first[k], first[k + 1]) for k in range(self.c) if cuts[k] < cuts[k + 1] and first[k + 1] - first[k] > 1]

    def log_probabilities(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(word) after each state, for words side by side. The id k means its class as a whole."""
        (of_class, of_word, calm), (order, flat, word, members) = self._outputs(state), self._by_class(state, word)
        of, value = self.class_of[word], np.zeros(len(word), flat.dtype)
        for at in range(0, len(word) if self.c else 0, PLACES):
            cut = slice(at, at + PLACES)
            value[cut] = _log_shares(flat[cut] @ of_class, of[cut], calm)[0]
        for lo, hi, a, b in members:
            value[lo:hi] += _log_shares(flat[lo:hi] @ of_word[a:b].T, word[lo:hi] - a, calm)[0]
        out = np.empty_like(value)
        out[order] = value
        return out

    def gradients(self, given: np.ndarray, fresh: np.ndarray, live: np.ndarray, word: np.ndarray, state: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss of a window, its gradients (the state that it begins with is taken as given), and the last state."""
        h, kind = self.h, self.p["u"].dtype
        path, (z, r), new, added = self.states(given, fresh, state)
        at = np.flatnonzero(live.ravel())
        n, states = max(1, len(at)), path[1:].reshape(-1, h)[at]
        (of_class, of_word, calm), (order, flat, target, members) = self._outputs(states), self._by_class(states, word.ravel()[at])
        of, loss, back_flat = self.class_of[target], 0.0, np.empty((len(at), h), kind)
        g_class, g_word = np.zeros_like(of_class), np.zeros_like(of_word)
        for lo in range(0, len(at), PLACES):
            cut = slice(lo, lo + PLACES)
            value, delta = _log_shares(flat[cut] @ of_class, of[cut], calm, n)
            loss -= float(value.sum())
            g_class += flat[cut].T @ delta
            np.matmul(delta, self.p["wc"].T, out=back_flat[cut])
        for lo, hi, a, b in members:
            value, delta = _log_shares(flat[lo:hi] @ of_word[a:b].T, target[lo:hi] - a, calm, n)
            loss -= float(value.sum())
            g_word[a:b] = delta.T @ flat[lo:hi]
            back_flat[lo:hi] += delta @ self.p["wm"][a:b]
        da = np.zeros((*given.shape, h), kind)
        da.reshape(-1, h)[at[order]] = back_flat
        before = path[:-1].copy()
        before[fresh] = 0
        u, back, begins = self._split("u").transpose(0, 2, 1), np.zeros(state.shape, kind), fresh.any(1).tolist()
        g_u, ds, onto_new = [np.zeros((h, h), kind) for _ in range(3)], np.empty_like(added), np.empty_like(new)
        steps = max(1, PLACES // given.shape[1])
        for end in range(len(given), 0, -steps):
            cut = slice(max(0, end - steps), end)
            # what a change of the state after a word means for update gate, reset gate and new contents, and for what the state adds to each
            own, rest, onto = ds[:, cut], 1 - z[cut], onto_new[cut]
            np.multiply(new[cut], new[cut], out=onto)
            np.subtract(1, onto, out=onto)
            onto *= rest
            np.subtract(before[cut], new[cut], out=own[0])
            own[0] *= z[cut]
            own[0] *= rest
            np.multiply(onto, r[cut], out=own[2])
            np.multiply(own[2], added[2, cut], out=own[1])
            own[1] *= 1 - r[cut]
            for t in range(cut.stop - 1, cut.start - 1, -1):
                now = da[t]
                now += back
                ds[:, t] *= now
                through = np.matmul(ds[:, t], u)
                np.multiply(now, z[t], out=back)
                back += through[0]
                back += through[1]
                back += through[2]
                if begins[t]:
                    back[fresh[t]] = 0
            onto *= da[cut]
            rows = before[cut].reshape(-1, h).T
            for k in range(3):
                g_u[k] += rows @ own[k].reshape(-1, h)
        g = {"x": np.zeros_like(self.p["x"]), "u": np.hstack(g_u), "wc": g_class[:h], "bc": g_class[h], "wm": g_word[:, :h], "bm": g_word[:, h]}
        flat_given = given.ravel().astype(np.min_scalar_type(self.k))
        order = np.argsort(flat_given, kind="stable")
        words, first = np.unique(flat_given[order], return_index=True)
        sorted_ = np.empty((len(order), 3 * h), kind)
        for k, x in enumerate((ds[0], ds[1], onto_new)):
            sorted_[:, k * h : (k + 1) * h] = np.take(x.reshape(-1, h), order, 0)
        g["x"][words] = np.add.reduceat(sorted_, first)
        return loss / n, g, path[-1]

    def fit(self, documents: list[np.ndarray], lanes: int = FIT_LANES, steps: int = FIT_STEPS, rounds: int = ROUNDS, rate: float = 0.012) -> None:
        """Adam over windows of documents that stream through lanes."""
        adam = Adam(self.p)
        each = max(1, -(-sum(map(len, documents)) // (lanes * steps)))
        rounds = max(rounds, -(-LEAST_UPDATES // each)) if documents else 0
        total, i = rounds * each, 0
        for _ in range(rounds):
            state = np.zeros((lanes, self.h), np.float32)
            for window in windows(enumerate(documents), self.start, lanes, steps):
                _, g, state = self.gradients(window.given, window.fresh, window.owner >= 0, window.word, state[window.lanes])
                adam.step(g, _rate(rate, i / total))
                i += 1

    def go_on(self, documents: Iterator[np.ndarray], lanes: int = LANES, steps: int = FIT_STEPS, rate: float = SHARD_RATE) -> int:
        """One pass over documents that need not be held together; gives their number of tokens."""
        adam, state, tokens = Adam(self.p), np.zeros((lanes, self.h), np.float32), 0
        for window in windows(enumerate(documents), self.start, lanes, steps, True):
            live = window.owner >= 0
            _, g, state = self.gradients(window.given, window.fresh, live, window.word, state[window.lanes])
            adam.step(g, _rate(rate, tokens / SHARD_TOKENS))
            tokens += int(live.sum())
        return tokens

    def log_likelihoods(self, documents: Iterator[tuple[int, np.ndarray]], lanes: int = LANES, steps: int = STEPS) -> Iterator[tuple[int, float]]:
        """Key and natural logarithm of the probability of each document, in the order in which they end."""
        state, sums = np.zeros((lanes, self.h), np.float32), {}
        for window in windows(documents, self.start, lanes, steps, True):
            path = self.states(window.given, window.fresh, state[window.lanes])[0]
            state, at = path[-1], np.flatnonzero(window.owner.ravel() >= 0)
            value = self.log_probabilities(path[1:].reshape(-1, self.h)[at], window.word.ravel()[at])
            keys, nth = np.unique(window.owner.ravel()[at], return_inverse=True)
            for key, part in zip(keys.tolist(), np.bincount(nth, value.astype(np.float64)).tolist()):
                sums[key] = sums.get(key, 0.0) + part
            for key in window.ended:
                yield key, sums.pop(key)


def _log_shares(logits: np.ndarray, own: np.ndarray, calm: bool, of: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of each row's share for its own entry; and in place of the logits, if asked for a mean over so many rows, what a change of each means for the negative of that mean."""
    if not calm:
        logits -= logits.max(1, keepdims=True)
    places = np.arange(0, logits.size, logits.shape[1]) + own
    value = np.take(logits, places)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    value -= np.log(total)
    if of:
        logits *= (1 / (of * total))[:, None]
        logits.ravel()[places] -= logits.dtype.type(1 / of)
    return value, logits


@dataclass
class Window:
    """Time-major: the word, the one before it, whether a document begins, and whose it is (-1: nobody's); which lanes of the last window go on, and which documents end."""

    given: np.ndarray
    word: np.ndarray
    fresh: np.ndarray
    owner: np.ndarray
    lanes: np.ndarray
    ended: list[int]


def windows(documents: Iterator[tuple[int, np.ndarray]], start: int, lanes: int, steps: int, stretch: bool = False) -> Iterator[Window]:
    """Documents (key, word ids) in lanes: where one ends the next begins, and lanes that get nothing more go. stretch: the fewer lanes are left, the longer are the windows, so that one long document does not take hundreds of them alone."""
    documents, least, over = iter(documents), steps, False
    held: list[tuple[int, np.ndarray, int] | None] = [None] * lanes
    while True:
        if stretch and over:
            steps = least * lanes // max(1, sum(x is not None for x in held))
        given, word = (np.full((len(held), steps), start, np.int64) for _ in range(2))
        fresh, owner, ended = np.zeros((len(held), steps), bool), np.full((len(held), steps), -1, np.int64), []
        most = 0
        for lane, now in enumerate(held):
            at = 0
            while at < steps:
                if now is None:
                    key, ids = next(documents, (None, None))
                    if ids is None:
                        over = True
                        break
                    now = key, np.concatenate([[start], ids]), 0
                key, ids, pos = now
                n = min(steps - at, len(ids) - 1 - pos)
                given[lane, at : at + n], word[lane, at : at + n] = ids[pos : pos + n], ids[pos + 1 : pos + n + 1]
                fresh[lane, at], owner[lane, at : at + n] = pos == 0, key
                at, now = at + n, (key, ids, pos + n)
                if pos + n == len(ids) - 1:
                    ended.append(key)
                    now = None
            held[lane], most = now, max(most, at)
        live = np.flatnonzero((owner >= 0).any(1))
        if not len(live):
            return
        yield Window(*(np.ascontiguousarray(x[live, :most].T) for x in (given, word, fresh, owner)), live, ended)
        held = [held[k] for k in live]


def numbered(texts: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """tokens_of() many texts: the different words, with the end as the last; the number of each token's among them, text by text; and how many tokens each text has."""
    if texts.offset:  # ascii_lower of a slice goes wrong
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, size = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # before and behind whitespace at an end
    if empty.any():
        size -= np.bincount(np.repeat(np.arange(len(size)), size)[empty], minlength=len(size))
        words = words.filter(pa.array(~empty))
    words = words.dictionary_encode()
    different = words.dictionary.cast(pa.large_binary())
    ends = np.cumsum(size + 1) - 1
    nth = np.full(len(words) + len(size), len(different), np.int64)
    inner = np.ones(len(nth), bool)
    inner[ends] = False
    nth[inner] = words.indices.to_numpy()
    return pa.concat_arrays([different, pa.array([END], pa.large_binary())]), nth, size + 1


def word_counts(texts: DataFrame) -> DataFrame:
    """word and c, the number of times that it occurs in all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def summed() -> tuple[pa.LargeBinaryArray, np.ndarray]:
            words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
            return words.dictionary, np.bincount(words.indices.to_numpy(), np.concatenate([c for _, c in held]), len(words.dictionary))

        def out() -> pa.RecordBatch:
            words, c = summed()  # doubles, exact below 2^53
            return pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(c.astype(np.int64))], ["word", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            different, nth, _ = numbered(batch.column("text"))
            held.append((different, np.bincount(nth, minlength=len(different))))
            many += len(different)
            if many >= 3 * HELD_WORDS:
                held = [summed()]
                many = len(held[0][0])
                if many >= HELD_WORDS:
                    yield out()
                    held, many = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary_of(counts: DataFrame, model_words: int = MODEL_WORDS, common: int = COMMON) -> Vocabulary:
    """The common words are those of the highest counts, to an eighth of a power of two, that together are no more than `common`; so no task sends the driver more than there are."""
    step = F.floor(F.log2("c") * 8).cast("int")
    able = F.octet_length("word") <= COMMON_BYTES
    steps = counts.groupBy(step.alias("step")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(able).alias("able")).collect()
    least, room = None, common
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["able"]
        if room < 0:
            break
        least = r["step"]
    some = sorted(((-r["c"], bytes(r["word"])) for r in counts.where(able & (step >= least)).collect())) if least is not None else []
    return Vocabulary(sum(r["n"] for r in steps), sum(r["v"] for r in steps), [w for _, w in some], np.array([-c for c, _ in some], np.int64), model_words)


def _ids(vocabulary: Vocabulary, tokens: list[bytes]) -> np.ndarray:
    """Places among the common words, -1 for others."""
    return np.fromiter(map(vocabulary.at.get, tokens, repeat(-1)), np.int64, len(tokens))


def sample(learn: DataFrame, vocabulary: Vocabulary, max_fit: int = MAX_FIT) -> list[np.ndarray]:
    """Word ids of at most max_fit different texts, whole, those with the least hashes."""
    hashed = learn.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    different = hashed.agg(F.approx_count_distinct("h")).first()[0]
    if not different:
        return []
    some = hashed
    if different > 2 * max_fit:  # many more than are wanted have hashes above this, whatever the estimate's error
        some = hashed.where(F.col("h") < F.lit(int(min(2.0 * max_fit / different, 1.0) * 2**64) - 2**63))
    some = some.dropDuplicates(["h"]).orderBy("h").limit(max_fit)

    return [np.frombuffer(bytes(r["ids"]), vocabulary.kind) for r in sorted(encoded(some, vocabulary).collect())]


def _stored(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """Places among the common words as the network's ids; all words that are not its own have the last."""
    return np.minimum(ids.astype(np.uint64), vocabulary.k).astype(vocabulary.kind).tobytes()


def encoded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """h and ids, the network's word ids of each text; texts: h, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_stored(vocabulary, _ids(vocabulary, tokens_of(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(ids, pa.binary())], ["h", "ids"])

    return texts.select("h", "text").mapInArrow(run, "h long, ids binary")


def fit_on_all(learn: DataFrame, vocabulary: Vocabulary, net: GatedLM) -> None:
    """Every training document once: copies of the network go through a shard each, and their parameters, averaged by tokens, are the network's. learn: texts, or h and ids of parts()."""
    names, shards = sorted(net.p), max(1, -(-vocabulary.total // SHARD_TOKENS))
    if "ids" not in learn.columns:
        learn = encoded(learn.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))), vocabulary)
    dealt = learn.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task may have several shards, one after the other."""
        rows = ((shard, ids.as_buffer()) for batch in batches for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids")))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            copy = GatedLM(vocabulary, net.h)
            copy.p = {k: x.copy() for k, x in net.p.items()}
            tokens = copy.go_on(np.frombuffer(ids, vocabulary.kind) for _, ids in own)
            flat = np.concatenate([copy.p[k].ravel() for k in names])
            cut = [flat[at : at + CHUNK] for at in range(0, len(flat), CHUNK)]
            cols = [shard] * len(cut), range(len(cut)), [tokens] * len(cut), cut
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["shard", "part", "tokens", "values"])

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        n = np.array(table["tokens"], np.float64)
        x = np.array(table["values"].combine_chunks().flatten()).reshape(len(n), -1)
        return pa.table({"part": table["part"][:1], "values": pa.array([(n @ x / n.sum()).astype(np.float32)], pa.list_(pa.float32()))})

    # twice as many ranges as shards, so that each has one to itself; by hash several would meet in a task
    learned = dealt.repartitionByRange(2 * shards, "shard").sortWithinPartitions("shard", "h", "ids").mapInArrow(run, "shard int, part int, tokens long, values array<float>")
    found = learned.groupBy("part").applyInArrow(mean, "part int, values array<float>").collect()
    if not found:
        return
    flat, at = np.concatenate([np.array(r["values"], np.float32) for r in sorted(found)]), 0
    for k in names:
        net.p[k], at = flat[at : at + net.p[k].size].reshape(net.p[k].shape), at + net.p[k].size


def parts(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What counts say of each document: sums over its common words, and its other words with how often they occur; and the network's ids of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            different, nth, size = numbered(batch.column("text"))
            of = _ids(vocabulary, different.to_numpy(zero_copy_only=False).tolist())
            ids, stop = of[nth], np.cumsum(size)
            sums = []
            for lo, hi in zip((stop - size).tolist(), stop.tolist()):
                known = ids[lo:hi]
                known = known[known >= 0]
                sums.append((row, hi - lo, len(known), float(vocabulary.base[known].sum()), float(vocabulary.other[known].sum())))
                row += 1
            rows, n, known, base, score = (pa.array(c) for c in zip(*sums))
            at = np.flatnonzero(ids < 0)
            found, times = np.unique(np.searchsorted(stop, at, "right") * len(different) + nth[at], return_counts=True)
            whose, word = np.divmod(found, len(different))
            pairs = pa.StructArray.from_arrays([different.take(pa.array(word)).cast(pa.binary()), pa.array(times.astype(np.int64))], ["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(len(size) + 1)), pa.int32()), pairs)
            flat = _stored(vocabulary, ids)
            stored = [flat[lo:hi] for lo, hi in zip((vocabulary.kind.itemsize * (stop - size)).tolist(), (vocabulary.kind.itemsize * stop).tolist())]
            cols = [rows, batch.column("doc_id"), n, known, base, score, batch.column("h"), pa.array(stored, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_tokens", "n_known", "base", "score", "h", "ids", "others"])

    return id_text(documents).withColumn("h", F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).mapInArrow(run, PARTS)


def with_network(found: DataFrame, vocabulary: Vocabulary, net: GatedLM) -> DataFrame:
    """The sums of parts(), with what the network says of each document's ids added to its score."""
    names = [f.split()[0] for f in SUMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple] = {}

        def read() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for *sums, ids in zip(*(batch.column(name).to_pylist() for name in names), batch.column("ids")):
                    waiting[sums[0]] = sums
                    yield sums[0], np.frombuffer(ids.as_buffer(), vocabulary.kind)

        def out(done: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.float64()) for k, c in enumerate(zip(*done))], names)

        done: list[list] = []
        for key, value in net.log_likelihoods(read()):
            *sums, score = waiting.pop(key)
            done.append([*sums, score + value / math.log(10)])
            if len(done) >= 512:
                yield out(done)
                done = []
        if done:
            yield out(done)

    return found.select(*names, "ids").mapInArrow(run, SUMS)


def score(documents: DataFrame, max_fit: int = MAX_FIT, model_words: int = MODEL_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    rows = id_text(documents)
    out_of = held_out(F.col("doc_id"), 5, 1)
    own = F.col("doc_id").isNotNull() & ~out_of
    learn = rows.where(own).select("text")
    counts = spool(word_counts(learn), "word-counts")
    vocabulary = vocabulary_of(counts, model_words)
    net = GatedLM(vocabulary)
    net.fit(sample(learn, vocabulary, max_fit))
    found = spool(parts(documents, vocabulary), "lm-parts")
    fit_on_all(found.where(own).select("h", "ids"), vocabulary, net)
    others = found.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times").join(counts.hint("shuffle_hash"), "word", "left")
    c = F.coalesce("c", F.lit(0)) + 0.5
    more = others.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * F.log10(c / vocabulary.base_over)).alias("base"), (F.col("times") * F.log10(c / vocabulary.other_over)).alias("score"))
    sums = with_network(found, vocabulary, net).unionByName(more).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")))
    return sums.select("doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
