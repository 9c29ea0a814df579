"""Token ids of whole texts, with the tokenizers library and a bounded cache of words.

A byte-level BPE of this family starts a new word at every single space before a non-space, so
a text can be cut there and the cuts encoded once each: ids of a text are the ids of its cuts in order.
A text that holds one of the tokenizer's added tokens is encoded whole, as the library does it.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r" (?=\S)")
_PARTS = re.compile(r"([^\W\d_]+)([^\w\s]*)(?:\n([^\W\d_]+)([^\w\s]*))?")
#: Marks that are cut off behind ASCII letters and digits.
MARKS = ".,;:!?"
_PLAIN, _MARK_OF = np.zeros(256, bool), np.zeros(256, np.int64)
_PLAIN[[k for k in range(128) if chr(k).isalnum()]] = True
_MARK_OF[list(MARKS.encode())] = np.arange(1, len(MARKS) + 1)
CACHE_ENTRIES = 650_000
#: Characters of texts whose cuts are numbered together; a longer text goes alone.
GROUP_CHARS = 4 << 20
#: New words that are encoded in one go.
RUN = 20_000


class WordEncoder:
    """encode(texts) -> one bytes object per text: its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes that each id stands for; a byte-level vocabulary writes a byte as one character.
        self.bytes_of = np.zeros(self.vocab_size, np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[k] = len(token)
        self.marks = self._direct(list(MARKS))
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], sep: str) -> list[bytes]:
        """Ids of letters-only words, encoded as running text: each with its space (sep " ") or as the start of a line (sep newline)."""
        out: list[bytes] = []
        for at in range(0, len(words), RUN):
            part = words[at : at + RUN]
            run = sep + sep.join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([run], add_special_tokens=False)[0].ids, dtype="<u4")
            size = np.fromiter(map(len, part if run.isascii() else map(str.encode, part)), np.int64, len(part))
            stop = np.cumsum(size + 1)
            begin = stop - size - (sep == " ")  # a newline is a word of its own
            ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
            lo, hi = (np.minimum(np.searchsorted(ends, x), len(ids)) for x in (begin, stop))
            if np.array_equal(ends[lo], begin) and np.array_equal(ends[hi], stop):  # ids end where words do
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip((4 * lo).tolist(), (4 * hi).tolist())]
            else:
                out += self._direct([sep.strip(" ") and w or " " + w for w in part])
        return out

    def _of(self, cuts: list[str]) -> list[bytes]:
        """Ids of different cuts, each as it stands after its space, or with the newline that it begins with. Words, with or without a newline, and odd cuts are kept, and tails, with a space before them as no cut has it; words with tails or with the next line's first word are put together."""
        cache = self.cache
        out = list(map(cache.get, cuts))
        words, lines, tails, other = {}, {}, {}, {}
        waiting: list[tuple[int, list[str]]] = []
        for k in [k for k, x in enumerate(out) if x is None]:
            cut = cuts[k]
            if cut.isalpha():  # most of them are words
                words[cut] = k
            elif cut[0] == "\n" and cut[1:].isalpha():
                lines[cut] = k
            elif (m := _PARTS.fullmatch(cut)) is None or not m[1].isalpha() or (m[3] and not m[3].isalpha()):
                other[cut] = k
            else:
                word, tail, word2, tail2 = m.groups()
                waiting.append((k, [word, *([" " + tail] if tail else []), *(["\n" + word2] if word2 else []), *([" " + tail2] if tail2 else [])]))
        for k, keys in waiting[:]:
            ids = list(map(cache.get, keys))
            if None not in ids:
                out[k] = b"".join(ids)
            for key, x in zip(keys, ids):
                if x is None:
                    {" ": tails, "\n": lines}.get(key[0], words).setdefault(key, -1)
        newline = self._direct(["\n"])[0] if lines else b""
        for new, found in (
            (words, self._words(list(words), " ")),
            (lines, [newline + x for x in self._words([w[1:] for w in lines], "\n")]),
            (tails, self._direct([t[1:] for t in tails])),
            (other, self._direct([c if c[0] == "\n" else " " + c for c in other])),
        ):
            cache.update(zip(new, found))
            for k, x in zip(new.values(), found):
                if k >= 0:
                    out[k] = x
        for k, keys in waiting:
            if out[k] is None:
                out[k] = b"".join([cache[key] for key in keys])
        return out

    @property
    def vocab_size(self) -> int:
        """One more than the largest id, added tokens included."""
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {k for k, t in enumerate(texts) if any(a in t for a in self.added)}
        if not whole:
            return self._by_cuts(texts)
        cut = iter(self._by_cuts([t for k, t in enumerate(texts) if k not in whole]))
        return [self._direct([t])[0] if k in whole else next(cut) for k, t in enumerate(texts)]

    def _by_cuts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and chars < GROUP_CHARS:
                chars += len(texts[end])
                end += 1
            out += self._group(texts[at:end])
            at = end
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        """Cuts of many texts are numbered together, so that each different one is looked up once; one mark behind a letter or digit is a cut of its own."""
        if len(self.cache) > self.cache_entries:
            for k in list(islice(reversed(self.cache), self.cache_entries // 3)):  # the frequent words came early
                del self.cache[k]
        parts = [t.partition(" ") for t in texts]
        cuts, n_cuts = _cut([rest for _, space, rest in parts if space])
        size = np.zeros(len(texts), np.int64)
        size[[k for k, x in enumerate(parts) if x[1]]] = n_cuts
        stems, marks = _stems(cuts)
        stems = stems.dictionary_encode()
        different, nth = stems.dictionary, stems.indices.to_numpy()
        odd = _odd(different)
        if odd.any():  # whitespace side by side, or at an end: these texts are cut one by one
            of = np.repeat(np.arange(len(texts)), size)
            some = np.unique(of[odd[nth]])
            by_one = [_CUT.split(texts[k]) for k in some.tolist()]
            keep = ~np.isin(of, some)
            more = pa.array([c for x in by_one for c in x[1:]], pa.large_string())
            stems = pa.concat_arrays([different.take(pa.array(nth[keep])), more]).dictionary_encode()
            different, nth = stems.dictionary, stems.indices.to_numpy()
            marks = np.r_[marks[keep], np.zeros(len(more), np.int64)]
            for k, x in zip(some.tolist(), by_one):
                parts[k], size[k] = (x[0], " ", ""), len(x) - 1
            order = np.r_[np.setdiff1d(np.arange(len(texts)), some), some]
        else:
            order = np.arange(len(texts))
        ids = [b"", *self.marks, *self._of(different.to_numpy(zero_copy_only=False).tolist())]
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, pool = np.cumsum(each) - each, np.frombuffer(b"".join(ids), "<u4")
        nth = np.stack([nth.astype(np.int64) + 1 + len(MARKS), marks], 1).ravel()
        n = each[nth]
        stop = np.cumsum(n)
        flat = pool[np.repeat(begin[nth] - stop + n, n) + np.arange(len(pool) and int(n.sum()))].tobytes()
        ends = (4 * np.r_[0, stop][2 * np.cumsum(size[order])]).tolist()
        heads = self._direct([x[0] for x in parts])
        out: list[bytes] = [b""] * len(texts)
        for k, a, b in zip(order.tolist(), [0, *ends], ends):
            out[k] = heads[k] + flat[a:b]
        return out


def _bytes_of(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins, with the end of the last; and all bytes, at least one."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def _cut(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Cuts of texts, at every space and before every newline, and how many each has."""
    lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _stems(cuts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Cuts without the one mark behind a letter or digit of theirs, and which mark that is (from 1; 0: none)."""
    stems = pc.ascii_rtrim(cuts, characters=MARKS)
    (at, data), (stem_at, stem_data) = _bytes_of(cuts), _bytes_of(stems)
    size = np.diff(stem_at)
    less = np.diff(at) - size
    one = (less == 1) & (size > 0) & _PLAIN[stem_data[np.maximum(stem_at[1:] - 1, 0)]]
    marks = np.where(one, _MARK_OF[data[np.maximum(at[1:] - 1, 0)]], 0)
    kept = one | (less == 0)
    return (stems if kept.all() else pc.if_else(pa.array(kept), stems, cuts)), marks


def _odd(cuts: pa.LargeStringArray) -> np.ndarray:
    """Cuts that are empty or begin with whitespace, but for a newline before something else."""
    at, data = _bytes_of(cuts)
    empty = at[1:] == at[:-1]
    first = data[np.minimum(at[:-1], len(data) - 1)]
    odd = empty.copy()
    for k in np.flatnonzero(~empty & ((first <= 32) | (first >= 128))).tolist():
        cut = cuts[k].as_py()
        odd[k] = cut[:1].isspace() and not (cut[0] == "\n" and cut[1:2] and not cut[1:2].isspace())
    return odd


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
