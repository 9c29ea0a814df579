"""The training-data operators against brute force, exact round trips and held-out labels; nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import ann, blocks, chat, decontaminate, language, packing, quality, simhash, substring, suffix, token_files
from heliograph.llm.queries import bpe_path

RNG = np.random.default_rng(1)
WORDS = ["the", "of", "and", "lumen", "ardor", "été", "straße", "niño", "kern", "tessel", "quill", "orbit", "vale", "mirth"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block_id string, row string, extra string, fp string"


def prose(n):
    return " ".join(RNG.choice(WORDS, n).tolist())


SHARED = prose(80)
TEXTS = [
    prose(200), "intro " + SHARED + " outro", prose(30) + "\n" + SHARED, None, "", "   \n\t", "x", "a" * 400, "b" + "a" * 300, prose(20_000),
    SHARED, SHARED, prose(40) + " " + SHARED[: len(SHARED) // 2], "It's 12 o'clock!  Double  spaces \n and\ttabs.", "ÀÉ" * 60, prose(36), "a mark <|endoftext|> inside",
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(10, TEXTS[10]), (None, SHARED), (20, "y" * 60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "c", "r", "e", "f") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(rows):
    return sorted(rows, key=str)


def B_ROWS(docs):
    """All documents as one block."""
    import pyarrow as pa

    made, _, _ = blocks.make(docs.coalesce(1), lambda data: (data, len(data)), b"", [], suffix._parts(50))
    return pa.Table.from_pylist([r.asDict() for r in made.collect()], schema=pa.schema([("block_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("extras", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("body", pa.binary())]))


@pytest.mark.parametrize("block_bytes", [blocks.BLOCK_BYTES, 3000])
def test_suffix_dedup(docs, monkeypatch, block_bytes):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    seen = {}
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], suffix.NO_ID if i is None else i)
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < (suffix.NO_ID if i is None else i):
                gone[k : k + 50] = True
        runs = int(np.diff(np.r_[False, gone].astype(int)).clip(0).sum())
        want.append((i, len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    rows = suffix.dedup(docs, carry=["lang", "extra"]).collect()
    assert key((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows) == key(want)
    assert {tuple(r["extra"]) for r in rows} == {("en", "e")}


def test_parts_of_long_texts():
    data = bytes(RNG.integers(97, 123, 1000).astype(np.uint8))
    parts = list(suffix._parts(50)(data, 300))
    assert [(a, o, n) for a, o, _, n in parts] == [(0, 300, 349), (300, 300, 349), (600, 300, 349), (900, 100, 100)]
    assert b"".join(p[:o] for _, o, p, _ in parts) == data
    words = [b"w" * int(k) for k in RNG.integers(1, 60, 200)]
    cut = list(substring._parts(35)(b" ".join(words), 400))
    assert sum(o for _, o, _, _ in cut) == 200 and all(p.split() == words[a : a + o + 34] and len(p.split()) == n for a, o, p, n in cut)
    assert all(len(b" ".join(words[a : a + o])) <= 400 for a, o, _, _ in cut) and b" ".join(b" ".join(p.split()[:o]) for _, o, p, _ in cut) == b" ".join(words)
    assert [o for _, o, _, _ in substring._parts(35)(b"x" * 900 + b" y", 400)] == [1, 1]


def test_long_texts_with_carried_columns(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 500)
    shared = prose(200)
    d = spark.createDataFrame([(1, prose(300) + " " + shared, "a"), (2, "b " + shared + " " + prose(300), "b"), (3, "short", "c"), (None, "x" * 3000, None)], "doc_id long, text string, extra string")
    for found in (suffix.dedup(d, carry=["extra"], as_text=True), substring.dedup(d, carry=["extra"])):
        rows = {r["doc_id"]: r for r in found.collect()}
        assert len(rows) == 4 and {k: r["extra"]["extra"] for k, r in rows.items()} == {1: "a", 2: "b", 3: "c", None: None}
        assert rows[2]["n_removed"] >= 200 and len(rows[2]["spans"]) == 1


def test_carried_columns_come_back_as_they_were(spark):
    d = spark.sql("SELECT id AS doc_id, repeat('text ', 30) AS text, timestamp'2024-01-02 03:04:05.123456' AS at, double('NaN') AS x, CASE WHEN id > 3 THEN map('k', array(id, null)) END AS m, decimal(1.10) AS d FROM range(7)")
    carry = ["at", "x", "m", "d", "doc_id"]
    for found in (suffix.dedup(d, carry=carry), substring.dedup(d, carry=carry)):
        assert found.schema["extra"].dataType.fieldNames() == carry
        assert key(map(str, (r["extra"] for r in found.collect()))) == key(map(str, d.select(*carry).collect()))


def test_equal_hashes_of_different_bytes_remove_nothing(docs, monkeypatch):
    want = {(r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in suffix.dedup(docs).collect()}
    table, verdicts = [], B_ROWS(docs)
    for mix in (lambda h: h & np.uint64(7), lambda h: h * np.uint64(0)):
        monkeypatch.setattr(blocks, "mix", mix)
        p = suffix._Pieces(verdicts, 50)
        same = {}
        for k in range(len(p.at)):
            same.setdefault(int(p.group[k]), set()).add((int(p.lo[k]), int(p.hi[k]), p._bytes(np.array([k])).tobytes()))
        table.append(max(map(len, same.values())))
    assert table == [1, 1] and want


def test_suffix_order_is_that_of_the_suffixes(monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_SUFFIXES", 64)
    rows = RNG.integers(97, 99, (60, 80)).astype(np.uint8)
    rows[1::3] = rows[0]
    rows[2::6, 5:75] = rows[0, 0:70]
    lo, hi = np.zeros(60, np.int64), np.full(60, 30, np.int64)
    doc = RNG.permutation(60).astype(np.int64)
    wide = np.pad(rows, ((0, 0), (0, 40)))
    r, c = np.repeat(np.arange(60), 31), np.tile(np.arange(31), 60)
    order, _ = suffix.suffix_order(wide, r, c, suffix.CoverRanks(wide, lo, hi, 56))
    strings = [wide[a, b : b + 50].tobytes() for a, b in zip(r[order], c[order])]
    assert strings == sorted(strings)
    least = {}
    for a, b in zip(r, c):
        s = rows[a, b : b + 50].tobytes()
        least[s] = min(least.get(s, 1 << 60), doc[a])
    want = [sum(1 << b for b in range(31) if least[rows[a, b : b + 50].tobytes()] < doc[a]) for a in range(60)]
    assert suffix.earlier_starts(rows, lo, hi, doc, 50).tolist() == want


def test_cover_has_every_difference():
    assert all((a + suffix.common_offset(a, b)) % suffix.V in suffix.D for a in range(suffix.V) for b in range(suffix.V))


@pytest.mark.parametrize("block_bytes", [blocks.BLOCK_BYTES, 3000])
def test_substring_dedup(docs, monkeypatch, block_bytes):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in ROWS]
    count = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = []
    for (i, _), w in zip(ROWS, words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring.dedup(docs).collect()]
    assert key(got) == key(want)


def test_windows_with_one_digest_are_no_repeat(docs, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    plain = lambda seed: sorted(map(str, substring.dedup(docs, seed=seed).collect()))
    assert plain(42) == plain(7)
    monkeypatch.setattr(substring, "_digest", lambda words, seed: 7)
    with pytest.raises(Exception, match="one digest"):
        substring.dedup(docs).collect()


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_substring", "op7_chat", "op9_decontaminate"])
def test_query_against_its_sql(spark, name):
    import os

    from heliograph.llm import queries

    duckdb, data = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no sample tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, data).toPandas()[list(want.columns)]
    assert key(map(str, got.values.tolist())) == key(map(str, want.values.tolist()))


def test_dedup_of_empty_tables(none):
    assert suffix.dedup(none).count() == 0
    assert substring.dedup(none).count() == 0


def fingerprint(text):
    import xxhash

    low = (text or "").encode().lower().decode() if text is None or text.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    fps = [fingerprint(t) for _, t in ROWS]
    root = list(range(len(ROWS)))
    for a in range(len(ROWS)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    ids = {k: min((ROWS[j][0] for j in range(len(ROWS)) if root[j] == k and ROWS[j][0] is not None), default=None) for k in set(root)}
    want = [(ROWS[j][0], f"{fps[j]:016x}", ids[root[j]]) for j in range(len(ROWS))]
    got = [tuple(r)[:3] for r in simhash.report(simhash.near_duplicates(docs)).collect()]
    assert key(got) == key(want)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("segments", [2, 3])
def test_simhash_finds_every_pair_within_the_radius(spark, segments):
    base = [int(x) for x in RNG.integers(0, 1 << 63, 30)]
    fps = {b ^ sum(1 << int(x) for x in RNG.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5)}
    want = {(a, b) for a in fps for b in fps if a != b and bin(a ^ b).count("1") <= 4}
    nodes = spark.createDataFrame([(f, f) for f in fps], "fp long, class long")
    assert {(r["a"], r["b"]) for r in simhash.matches(nodes, 4, segments).collect()} == want
    assert simhash.segments_for(10**6, 4) == 3 and simhash.segments_for(10**10, 4) == 2


def test_simhash_classes(spark):
    """A crowd of near copies, a long chain, and a centre whose neighbours are only near to it."""
    crowd = {0x5555 << 40 | sum(1 << int(x) for x in RNG.choice(40, 2, replace=False)) for _ in range(400)}
    chain = {0xF << 60 | (1 << 4 * k) - 1 for k in range(15)}
    star = {0xABCD << 44 | 0xF << 4 * k for k in range(11)} | {0xABCD << 44}
    fps = [f - (1 << 64) if f >> 63 else f for f in crowd | chain | star | {3 << 30 | 0xFF}]
    of = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 and of[a] != of[b]:
                old, new = of[a], of[b]
                of = {f: new if r == old else r for f, r in of.items()}
    got = {r["fp"]: r["class"] for r in simhash.classes(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    group = lambda of: {frozenset(f for f in of if of[f] == r) for r in of.values()}
    assert group(got) == {g for g in group(of) if len(g) > 1}
    loose = spark.createDataFrame([(k, k - 1 if k else 1) for k in range(60)], "node long, parent long")
    assert {tuple(r) for r in simhash.trees(loose).collect()} == {(k, 0) for k in range(60)}


def test_ann(spark):
    x = RNG.normal(size=(1200, 16))
    x[100:500] = x[0]
    twin = RNG.normal(size=16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, twin.tolist()), (800, x[800].tolist())]  # a query id with another vector, and one repeated
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (None, x[1].tolist())]
    other = [(6000, [1.0]), (6001, [3.0]), (6002, [2.0])]
    e = spark.createDataFrame(rows + odd + other, "vec_id long, embedding array<double>")
    vectors = ann.usable(e)
    assert vectors.count() == 1205
    graphs = ann.index(vectors, 11, shard_size=400)
    assert graphs.count() == 5
    found = ann.search(graphs, vectors.where("vec_id % 100 = 0"), block=5).collect()
    y, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    want = Counter()
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != q][:10]
        want.update((int(ids[q]), k + 1, int(ids[j]), round(float(d[j]), 9)) for k, j in enumerate(order))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found if r["query_id"] != 6000)
    assert sum(got.values()) == sum(want.values()) == 14 * 10
    assert sum((got & want).values()) >= 0.95 * 140
    ties = lambda c: {x for x in c if x[0] < 500}
    assert ties(got) == ties(want)  # copies of one vector: ties go to the smaller ids
    assert (800, 1, 800, 0.0) in got and got[(800, 1, 800, 0.0)] == 2  # repeated rows are candidates for one another
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 6000] == [(1, 6002, 1.0), (2, 6001, 2.0)]
    assert ann.nearest(e.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "width"), [(3000, 64), (1500, 256)])
def test_ann_recall_without_any_clusters(n, width):
    x = RNG.normal(size=(n, width))
    g = ann.Graph(np.arange(n), np.arange(n), x, 11)
    q = np.arange(0, n, 30)
    d = ((x[q][:, None] - x[None]) ** 2).sum(2)
    d[np.arange(len(q)), q] = np.inf
    found = g.search(q, x[q], 10, ann.QUERY_BEAM)
    assert np.mean([ann.recall(f[1].tolist(), w.tolist()) for f, w in zip(found, np.argsort(d, axis=1)[:, :10])]) >= 0.95


@pytest.mark.parametrize("kind", ["1e6", "1e12", "1e30", "1e200", "scales", "clusters", "crowd"])
def test_ann_recall_with_outliers_and_mixed_scales(spark, kind):
    rng, n = np.random.default_rng(9), 2000
    x = rng.normal(size=(n, 32))
    if kind == "scales":
        x *= 10.0 ** rng.integers(-6, 7, n)[:, None]
    elif kind == "clusters":
        x = rng.normal(size=(8, 32))[rng.integers(0, 8, n)] * 1e6 + x
    elif kind == "crowd":
        x[: n // 3] = 1 + x[: n // 3] * 1e-5
    else:
        x[17, 3] = float(kind)
    x = x.astype(np.float32).astype(float) if kind != "1e200" else x
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = ann.usable(rows)
    found = ann.search(ann.index(vectors, 11, shard_size=1000), vectors.where("vec_id % 40 = 0 or vec_id = 17"), block=30).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {*range(0, n, 40), 17} and {len(g) for g in got.values()} == {10}
    hits = []
    for q, g in got.items():
        with np.errstate(over="ignore"):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert all(s == pytest.approx(math.dist(x[v], x[q]), rel=1e-12) for v, s in g)
        d[q] = np.inf
        if q != 17:
            hits.append(ann.recall([v for v, _ in g], np.lexsort((np.arange(n), d))[:10].tolist()))
    assert np.mean(hits) >= 0.95


def test_distances_neither_overflow_nor_vanish():
    a, b = np.array([[1e200, 0.0], [1e-200, 0.0], [1.0, 2.0]]), np.array([[-1e200, 0.0], [0.0, 0.0], [1.0, 2.0]])
    assert np.allclose(ann.distances(a, b), [[2e200, 1e200, 1e200], [1e200, 1e-200, math.sqrt(5)], [1e200, math.sqrt(5), 0]], rtol=1e-12)


def test_quality(spark, docs, none):
    junk = lambda: " | ".join(RNG.choice(WORDS, 80).tolist()) + "!!! ###"
    rows = [(i, prose(90) if i % 4 else junk()) for i in range(600)] + [(9001, None), (9002, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)] + [(None, 1), (77777, 0), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(d, labels).collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held if r["doc_id"] < 9000)
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0


def test_quality_is_a_ridge_on_cosines_and_a_calibration_on_other_rows(spark):
    rows = [(RNG.normal(size=len(quality.FEATURES)).tolist(), float(k % 5 < 2), k % 3 == 0) for k in range(300)]
    labelled = spark.createDataFrame([(s, y + 0.0, c) for s, y, c in rows], "stats array<double>, y double, calibrate boolean").repartition(5)
    m = quality.fit(labelled, cosines=40)
    x, y = np.array([s for s, _, c in rows if not c]), np.array([y for _, y, c in rows if not c])
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, x.std(0))
    phi = np.array([[*(math.sqrt(2 / 40) * math.cos(float(np.clip((s - m.mean) / m.scale, -6, 6) @ m.turn[:, j] + m.phase[j])) for j in range(40)), 1.0] for s in x])
    a = phi.T @ phi + quality.RIDGE * len(x) / 41 * np.diag([1.0] * 40 + [0.0])
    assert np.allclose(m.weight, np.linalg.solve(a, phi.T @ y), atol=1e-8)
    raw = sorted((float(m.raw(np.array([s]))[0]), y) for s, y, c in rows if c)
    bins = {}
    for r, v in raw:
        bins.setdefault(math.floor(max(-1.0, min(2.0, r)) * quality.BINS / 3 + 0.5), []).append((r, v))
    want = quality.isotonic(*(np.array([f(b) for b in bins.values()]) for f in (lambda b: sum(r for r, _ in b) / len(b), lambda b: sum(v for _, v in b) / len(b), len)))
    assert np.allclose(m.knots, want[0]) and np.allclose(m.levels, want[1]) and (np.diff(m.levels) > 0).all()
    assert np.allclose(m.score(x[:5]), [np.interp(float(m.raw(x[k : k + 1])[0]), m.knots, m.levels) for k in range(5)])


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


def encode(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_path()).encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_plain_library_call():
    from heliograph.llm.tokens import WordEncoder

    texts = ["end <|endoftext|> next", "<|endoftext|>", "a  b <|endoftext|><|endoftext|>\n", "plain words, no mark", "", " <|endoftext |>"]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(bpe_path()).encode(texts)] == [encode(t) for t in texts]


def test_a_word_is_looked_up_once():
    """And ids are still the library's: of letters beyond ASCII, of letters that only one side knows as such, of lines and tails."""
    from heliograph.llm.tokens import WordEncoder

    class Counted(dict):
        asked = 0

        def __contains__(self, key):
            Counted.asked += 1
            return dict.__contains__(self, key)

        def __getitem__(self, key):
            Counted.asked += 1
            return dict.__getitem__(self, key)

        def get(self, key):
            Counted.asked += 1
            return dict.get(self, key)

    odd = "".join(map(chr, (0x1E922, 0x2EBF0, 0x1DF25, 0x10D4A, 0xA7DA)))
    texts = ["zum straße été Ωmega", f"x {odd} a{odd[1]}b {odd[4]} end", "one,\ntwo three.\nVier fünf! \n six", "e\u0301 a\u0308b 中文 字", "it's they've x"]
    enc = WordEncoder(bpe_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [encode(t) for t in texts]
    enc.cache = Counted(enc.cache)
    again = enc.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in again] == [encode(t) for t in texts]
    assert Counted.asked <= sum(t.count(" ") + 1 for t in texts)


def test_a_word_that_occurs_often_is_looked_up_once_for_many_texts():
    """With a mark behind it or without. And a cut that looks like a key of a tail or of a line is none."""
    from heliograph.llm.tokens import WordEncoder

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return dict.get(self, key)

    texts = ["x" + " word, word. word" * 300 + " end", "y word word\nword word,"]
    enc = WordEncoder(bpe_path())
    enc.encode(texts)
    enc.cache = Counted(enc.cache)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [encode(t) for t in texts]
    assert Counted.asked <= 10
    odd = ["a one,,\nTwo \0,, \1Two b", "a \0, \1Two b,", "a  b, c.\n\n\nd e;\n", "a\nb \nc, \td", " lead", "trail, ", "\n", "a .\nb , c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(odd)] == [encode(t) for t in odd]


def test_width_of_ids_follows_the_vocabulary():
    from heliograph.llm.tokens import WordEncoder

    assert WordEncoder(bpe_path()).vocab_size == 50257
    assert [token_files.id_kind(*x)[0] for x in ((50257, 2), (65536, 2), (65537, 2), (100, 70000))] == ["<u2", "<u2", "<u4", "<u4"]
    assert token_files.narrowed(np.array([65535, 3], "<u4").tobytes(), "<u2").tolist() == [65535, 3]
    with pytest.raises(ValueError):
        token_files.narrowed(np.array([65536], "<u4").tobytes(), "<u2")


def test_packing(docs, none):
    want = Counter((i, tuple([*encode(t), 0])) for i, t in ROWS)
    rows = packing.pack(docs, bpe_path()).collect()
    ids = lambda r: np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    seqs = {}
    for r in rows:
        assert r["length"] == len(ids(r)) > 0
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    padding = sum(1024 - sum(n for _, n in p) for p in seqs.values())
    assert padding <= 3 * 1023  # at most one window of each partition
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids(r)))
    total = sum(len(t) * n for (_, t), n in want.items())
    assert sum(r["length"] for r in rows) == total
    for (i, t), n in want.items():
        parts = sorted(by[(i, len(t))])
        if n == 1 and sum(1 for (a, b) in want if a == i and len(b) == len(t)) == 1:
            assert [x for _, p in parts for x in p] == list(t)
    assert packing.pack(none, bpe_path()).count() == 0


def test_level_packer_chooses_the_least_sum_of_squares():
    p = packing.LevelPacker(10)
    piece = lambda n: (0, 0, b"\0" * 4 * n, n)
    for n in RNG.integers(1, 10, 400).tolist():
        before = p.level.copy()
        options = []
        for h in [0, *(h for h in range(1, 10) if before[h])]:
            if h + n <= 10:
                after = before.copy()
                after[h] -= h > 0
                after[h + n] += h + n < 10
                options.append(int((after[1:10] ** 2).sum()))
        p.place(piece(n))
        assert int((p.level[1:10] ** 2).sum()) == min(options)


@pytest.mark.parametrize("file_tokens", [token_files.FILE_TOKENS, 3000])
def test_token_files(spark, docs, none, monkeypatch, file_tokens):
    monkeypatch.setattr(token_files, "FILE_TOKENS", file_tokens)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = [*encode(t), 2]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_files.export(docs, bpe_path()).collect()]
    assert key(got) == key(want)
    assert token_files.export(none, bpe_path()).count() == 0


def test_token_files_are_fixed_size_lists_with_masks(spark, docs, tmp_path):
    import pyarrow as pa

    token_files.FILE_TOKENS, whole = 2000, token_files.FILE_TOKENS
    try:
        m = token_files.write(docs, bpe_path(), f"file://{tmp_path}", seq_len=64, batch_sequences=4).collect()
        back = token_files.read(spark, f"file://{tmp_path}", token_files.write(docs, bpe_path(), f"file://{tmp_path}", seq_len=64, batch_sequences=4), 64)
        assert key((r["doc_id"], bytes(r["ids"])) for r in back.collect()) == key((i, np.array([*encode(t), 2], "<u4").tobytes()) for i, t in ROWS)
    finally:
        token_files.FILE_TOKENS = whole
    assert len(m) > 4 and [(r["part"], r["nth"]) for r in m] == sorted((r["part"], r["nth"]) for r in m)
    assert sum(r["n_docs"] for r in m) == len(ROWS)
    for row in m:
        with pa.memory_map(row["path"]) as f:
            t = pa.ipc.open_file(f).read_all()
            assert t.schema.field("ids").type == pa.list_(pa.uint16(), 64)
            assert sum(sum(x) for x in t["mask"].to_pylist()) == row["n_tokens"]


def test_chat(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "back\\slash \\[INST] <<SYS>>", None, "", "new\nline</s>\n", "<s>[user]\n"]
    rows = [(k % 3, k, "assistant" if k % 2 else "user", t, "x") for k, t in enumerate(texts)] + [(1, 4, "assistant", "tie", "x"), (1, 4, "assistant", "tie", "x"), (None, None, None, "n", "x"), (0, 99, "ro]le<s>", "z", "x"), (2, 98, "a\x00]<s>\\]", "w", "x")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    want = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, role, t in mine if role == "assistant")
        want.append((conv, len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    for chars in (chat.PART_CHARS, 5):
        parts = chat.render(chat.events_of(c), part_chars=chars)
        assert key(tuple(r)[:5] for r in chat.digests(parts).collect()) == key(want)
    assert chat.render(chat.events_of(c.limit(0))).count() == 0
    for t in texts[:3] + ["\\", "\\\\<s>"]:
        assert chat.unescape(chat.escape(t)) == t and not any(x in chat.escape(t) for x in chat.CONTROL)


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", None, "llo"), (1, 1, 4, "regenerate", None, "Good "), (1, 1, 5, "delta", None, "day"), (1, 0, 6, "edit", None, "hey"), (1, 3, 9, "delta", "user", "alone")]
    e = spark.createDataFrame(log, "conv_id long, target long, seq long, kind string, role string, text string")
    r = chat.render(e).collect()
    assert [x["formatted"] for x in r] == ["<s>[user]\nhey</s>\n<s>[assistant]\nGood day</s>\n<s>[user]\nalone</s>\n"]
    assert [r[0]["formatted"][s["start"] : s["stop"]] for s in r[0]["loss"]] == ["Good day"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("shard_chars", [decontaminate.SHARD_CHARS, 200])
def test_decontamination(spark, docs, none, shard_chars):
    items = [(1, SHARED), (2, "Lumen, ARDOR!"), (3, None), (4, "..."), (None, "été quill"), (1, prose(20)), (5, prose(40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = []
    for i, t in items:
        w = words_of(t)
        n = min(13, len(w))
        windows += [("null" if i is None else str(i), w[k : k + n]) for k in range(len(w) - n + 1 if w else 0)]
    want = []
    for i, t in ROWS:
        w = words_of(t)
        hit, own = set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    own.add(item)
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)))
    scanned = decontaminate.scan(docs, bench, shard_chars=shard_chars)
    assert key(map(tuple, decontaminate.report(scanned).collect())) == key(want)
    passages = [r for r in decontaminate.hit_spans(scanned).collect() if r["doc_id"] == 1]
    assert any(words_of(r["passage"])[:5] == words_of(SHARED)[:5] for r in passages)
    assert decontaminate.scan(none, bench).count() == 0
    assert decontaminate.report(decontaminate.scan(docs, bench.limit(0))).where("contaminated").count() == 0


def test_decontamination_with_windows_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(decontaminate.Patterns, "_hash", lambda self, rows: np.zeros(len(rows), np.uint64))
    items = [(str(k), prose(n)) for k, n in enumerate((13, 20, 31, 26, 5, 1))]
    p = decontaminate.Patterns([*items, ("twin", items[1][1])], 13)
    words = words_of(prose(9) + " " + items[1][1] + " " + items[2][1][:150] + " " + prose(40))
    runs, own = p.scan([w.encode() for w in words])
    want, names = set(), set()
    for i, t in [*items, ("twin", items[1][1])]:
        w = words_of(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            for a in range(len(words) - n + 1):
                if words[a : a + n] == w[k : k + n]:
                    want |= set(range(a, a + n))
                    names.add(i)
    assert {x for a, b in runs for x in range(a, b + 1)} == want and own == names and "twin" in own


def test_a_large_benchmark_is_one_automaton_and_one_scan(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 400)) for _ in range(4500)]  # 10 MB and more
    assert sum(map(len, texts)) > 10_000_000
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(4)
    assert len(decontaminate.write_patterns(bench, 13, decontaminate.SHARD_CHARS)) == 1
    d = spark.createDataFrame([(1, "x " + " ".join(texts[77].split()[100:113]) + " y"), (2, " ".join(texts[78].split()[100:112]))], "doc_id long, text string")
    scanned = decontaminate.scan(d, bench)
    assert scanned._jdf.queryExecution().toString().count("MapInArrow") <= 4  # one operator in each of the four plans
    assert {r["doc_id"]: (r["n_words"], [(h["first"], h["last"]) for h in r["hits"]], r["items"]) for r in scanned.collect()} == {1: (15, [(1, 13)], ["77"]), 2: (12, [], [])}


def test_language(spark, docs, none):
    made = {"aa": "kalo mira tuva sene", "bb": "schlo pfurz krach btz", "cc": "ño ció que ías"}
    rows = [(i, " ".join(RNG.choice(made[l].split(), 12).tolist()), l) for i in range(300) for l in [sorted(made)[i % 3]]] + [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "kalo mira", None), (903, "", "cc")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(d, carry=["doc_id", "lang"]).collect()}
    assert len(got) == 304 and got[900]["lang_pred"] == got[901]["lang_pred"] == got[903]["lang_pred"] == "und" and got[900]["score"] == 0
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["lang_pred"] == r["row"]["lang"] for r in held) >= 0.95 * len(held)
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(none).count() == 0


def test_gradients_of_the_network():
    net = language.ByteBiGRU(3, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, live, label = RNG.integers(0, 5, (6, 4)), np.ones((6, 4), bool), np.array([0, 1, 2, 0])
    live[4:, 1] = False
    net.p["xf"], net.p["xb"] = net.p["xf"] * 1.0, net.p["xb"] * 1.0
    _, g = net.gradients(data, live, label)
    for k, at in [(k, tuple(0 for _ in net.p[k].shape)) for k in ("uf", "wb", "cf", "ub", "o")] + [(k, (int(data[2, 1]), c)) for k in ("xf", "xb") for c in (0, 4, 8)]:
        old, eps = net.p[k][at], 1e-3
        net.p[k][at] = old + eps
        up, _ = net.gradients(data, live, label)
        net.p[k][at] = old - eps
        down, _ = net.gradients(data, live, label)
        net.p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3, k


def test_language_learns_from_every_language_and_from_copies_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language.ByteBiGRU, "fit", lambda self, data, sizes, label, **_: seen.update(data=data, label=label))
    rows = [("always the same words " * 5, "aa")] * 3000 + [(f"{i} different words {i * 7919}", "bb") for i in range(1000)]
    rows += [(f"rare {i}", f"r{i:03}") for i in range(120)] + [("", "void"), (None, "void"), ("no name for it", ""), ("nothing to learn", None)]
    model, langs = language.train(spark.createDataFrame(rows, "text string, lang string").repartition(3), 400)
    assert langs == sorted({lang for t, lang in rows if t and lang is not None}) and "" in langs and model.k == 123
    per = np.bincount(seen["label"], minlength=123)
    assert per[langs.index("aa")] == 2  # one text in two sequences
    assert per[langs.index("bb")] == 400 - 122 and sorted(per.tolist())[:-2] == [1] * 121


def test_language_keeps_every_row_below_the_bound_and_exact_shares_above(spark):
    rows = [(f"{lang} text {i % n}", lang) for lang, n in (("aa", 385), ("bb", 444), ("cc", 3)) for i in range(n + 50)]
    d = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    size = lambda most: {r["lang"]: r["count"] for r in language.sample(d, most).groupBy("lang").count().collect()}
    assert size(832) == size(5000) == {"aa": 385, "bb": 444, "cc": 3}
    assert size(600) == {"aa": 298, "bb": 298, "cc": 3} and size(103) == {"aa": 50, "bb": 50, "cc": 3} and size(2) == {"aa": 1, "bb": 1, "cc": 1}
    assert language.sample(d, 103).distinct().count() == 103


def test_language_learns_from_the_whole_of_a_text(spark, monkeypatch):
    head = "the same opening words for all of them, whatever follows " * 4
    made = {"aa": "kalo mira tuva sene", "bb": "schlo pfurz krach btz"}
    text = lambda l, i: head + " ".join(RNG.choice(made[l].split(), 300).tolist()) + str(i)
    rows = [(i, text(l, i), l) for i in range(120) for l in [sorted(made)[i % 2]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    with monkeypatch.context() as m:
        m.setattr(language.ByteBiGRU, "fit", lambda self, data, sizes, label, **_: seen.update(data=data, sizes=sizes, label=label))
        _, langs = language.train(d.select("text", "lang"))
    assert seen["sizes"].sum() == sum(len(t.encode()) for _, t, _ in rows)
    joined = {lang: b"".join(bytes(x[:n]) for x, n, k in zip(seen["data"], seen["sizes"], seen["label"]) if langs[k] == lang) for lang in langs}
    assert all(t.encode() in joined[lang] for _, t, lang in rows)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(d).collect()}
    assert sum(got[i] == l for i, _, l in rows) >= 0.95 * len(rows)


def test_language_quota():
    assert [language.quota(c, 10) for c in ([3, 100], [100, 100], [1, 2], [5] * 20)] == [7, 5, 2, 1]


def test_prediction_is_that_of_a_plain_loop(spark):
    net = language.ByteBiGRU(3, hidden=4, seed=2)
    langs, sig = ["x", "y", "z"], lambda v: 1 / (1 + np.exp(-v))
    texts = ["short", prose(70), "é" * 200, "a"]

    def states(d, data):
        p, h, out = net.p, np.zeros(4), {}
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            x, s = p["x" + d][data[t]] + p["c" + d], h @ p["u" + d]
            z, r = sig(x[:4] + s[:4]), sig(x[4:8] + s[4:8])
            new = np.tanh(x[8:] + r * s[8:])
            h = z * h + (1 - z) * new
            out[t] = h
        return out

    want = []
    for t in texts:
        total = np.zeros(3)
        for at in range(0, len(t.encode()), language.STEPS):
            data = t.encode()[at : at + language.STEPS]
            f, b = states("f", data), states("b", data)
            for k in range(len(data)):
                e = np.exp(f[k] @ net.p["wf"] + b[k] @ net.p["wb"] + net.p["o"])
                total += e / e.sum()
        want.append(total / total.sum())
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(d, (net, langs), batch=16).collect()}
    for k, w in enumerate(want):
        assert np.allclose(got[k]["shares"], w, atol=1e-5) and got[k]["lang_pred"] == langs[int(w.argmax())] and abs(got[k]["score"] - w.max()) < 1e-5


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    texts = [prose(150) for _ in range(12)]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(50, texts[3], "en", "s", 1), (51, texts[4] + " tail", "en", "s", 1), (52, None, None, "s", 0), (53, "12 34", "en", "s", 5), (54, prose(60) + " " + texts[5][:400] + " " + prose(60), None, "s", 1)]
    item = prose(30)
    rows += [(55, item + " " + prose(20), "fr", "s", 1)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [len(P.STAGES), P.STAGES[0][0]] == [5, "language_id"]
    kept = docs
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name, stage in P.STAGES[:-1]:
        before, kept = ids(kept), stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        gone = before - ids(kept)
        if name == "language_id":
            assert gone == {52, 53}
        elif name == "near_dedup":
            assert {50} <= gone <= {50, 51}
        elif name == "suffix_dedup":
            text = {r["doc_id"]: r["text"] for r in kept.collect()}
            assert texts[5][:400] not in text[54] and text[0] == texts[0] and gone <= {51}
        else:
            assert gone == {55}
    assert P.packed(spark, kept, str(tmp_path)).select("doc_id").distinct().count() == kept.count()
    assert P.packed(spark, kept.limit(0), str(tmp_path)).count() == 0
