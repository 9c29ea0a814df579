"""Language-model scores, importance resampling and whitening against plain loops, exact arithmetic and SQL."""

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import importance, lm, queries, whitening

SCHEMA = "doc_id long, text string, lang string, row string, word string, c string, own string, length string, x string, score string, rank string"
RNG = np.random.default_rng(2)
WORDS = ["The", "of", "AND", "lumen", "été", "straße", "kern-el", "quill", "orbit", "v1", "mirth", "3x"]
TEXTS = [" ".join(RNG.choice(WORDS, int(RNG.integers(1, 60))).tolist()) for _ in range(60)]
TEXTS += [None, "", "  \n\t", "...", "rare" + "e" * 300 + " word", "ÀÉ A B c\u0085d", "one two", TEXTS[3], TEXTS[3], "\x0bmid\x0cdle\x1fend", " ".join(RNG.choice(WORDS, 3000).tolist()), "." * 1000]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(7, TEXTS[8]), (7, TEXTS[9]), (None, TEXTS[5])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["q"] * 9) for i, t in rows], SCHEMA).repartition(3)


# --- language model -------------------------------------------------------------------------------------------------


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), ""]


def test_scores_of_the_base_model(spark):
    found = lm.score(frame(spark, ROWS), max_fit=20, model_words=8).collect()
    train = [t for i, t in ROWS if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found) == want
    assert {r["train_tokens"] for r in found} == {n}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in found)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_scores_without_rows_or_anything_to_learn(spark):
    assert lm.score(frame(spark, ROWS).limit(0)).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1]
    only = lm.score(frame(spark, [(i, "a b") for i in held]))
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in only.collect()} == {(3, 0, 0, 0.0, 0.0)}


def toy(n_words=9, seed=1, model_words=7, classes=3):
    counts = np.sort(np.random.default_rng(seed).integers(1, 50, n_words))[::-1].astype(np.int64)
    words = [b"", *(bytes([97 + k]) for k in range(n_words - 1))]
    return lm.Vocabulary(int(counts.sum()), n_words, words, counts, model_words, classes)


def plain(net, v, ids):
    """log P of a document, a step at a time."""
    sig, h, state, out, given = (lambda a: 1 / (1 + np.exp(-a))), net.h, np.zeros(net.h), 0.0, net.start
    p = {k: x.astype(float) for k, x in net.p.items()}
    for word in ids:
        x, s = p["x"][given], state @ p["u"]
        z, r = sig(x[:h] + s[:h]), sig(x[h : 2 * h] + s[h : 2 * h])
        new = np.tanh(x[2 * h :] + r * s[2 * h :])
        state = z * state + (1 - z) * new
        k = v.class_of[word]
        of_class = np.exp(state @ p["wc"] + p["bc"])
        members = np.flatnonzero(v.class_of == k)
        of_word = np.exp(p["wm"][members] @ state + p["bm"][members])
        out += math.log(of_class[k] / of_class.sum() * of_word[list(members).index(word)] / of_word.sum())
        given = word
    return out


def some_net(v, seed=0):
    net, rng = lm.GatedLM(v, hidden=4), np.random.default_rng(seed)
    for k, x in net.p.items():
        net.p[k] = (x + rng.normal(0, 0.4, x.shape)).astype(np.float32)
    return net


@pytest.mark.parametrize("lanes, steps", [(1, 3), (4, 5), (16, 64)])
def test_state_is_carried_through_whole_documents(lanes, steps):
    v, rng = toy(), np.random.default_rng(3)
    net = some_net(v)
    docs = [rng.integers(0, v.k + 1, n) for n in (1, 40, 3, 17, 5, 5, 64, 2)]
    got = dict(net.log_likelihoods(enumerate(docs), lanes, steps))
    assert sorted(got) == list(range(8))
    for k, ids in enumerate(docs):
        assert got[k] == pytest.approx(plain(net, v, ids), abs=1e-3)


def test_probabilities_sum_to_one():
    """Over the network's words, the other known ones and one unseen."""
    v = toy()
    net = some_net(v)
    state = np.random.default_rng(1).normal(size=(1, 4)).astype(np.float32)
    own = np.exp(net.log_probabilities(np.repeat(state, v.k + 1, 0), np.arange(v.k + 1)))
    others = [10 ** x for x in v.other[v.k :]] + [0.5 / v.other_over]
    assert own.sum() == pytest.approx(1, abs=1e-5) and sum(others) == pytest.approx(1)
    fresh = lm.GatedLM(v, hidden=4)
    fresh.p["wc"][:], fresh.p["wm"][:] = 0, 0  # what it knows before any training are the counts
    base = np.exp(fresh.log_probabilities(state, np.array([2])))
    assert base[0] == pytest.approx((v.counts[2] + 0.5) / v.base_over, rel=1e-4)


def test_gradients_of_the_language_model():
    v = toy()
    net = some_net(v)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    docs = [np.random.default_rng(k).integers(0, v.k + 1, 4 + k) for k in range(5)]
    first, second = list(lm.windows(enumerate(docs), net.start, 2, 6))[:2]
    _, _, state = net.gradients(first.given, first.fresh, first.owner >= 0, first.word, np.zeros((2, 4)))
    args = second.given, second.fresh, second.owner >= 0, second.word, state[second.lanes].astype(np.float64)
    _, grads, _ = net.gradients(*args)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in g.shape)
            old, around = net.p[name][at], []
            for e in (1e-3, -1e-3):
                net.p[name][at] = old + e
                around.append(net.gradients(*args)[0])
            net.p[name][at] = old
            assert g[at] == pytest.approx((around[0] - around[1]) / 2e-3, abs=2e-3), name


def test_the_network_learns_what_follows_what(spark):
    """Two languages that share no word, and pairs of words in one order: counts alone cannot know."""
    rng = np.random.default_rng(5)
    text = lambda k: " ".join(w for _ in range(int(rng.integers(5, 40))) for x in [rng.integers(4)] for w in (f"a{k}{x}", f"b{k}{x}"))
    rows = [(i, text(i % 2)) for i in range(300)]
    got = lm.score(frame(spark, rows)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.min(F.col("score") - F.col("base_score"))).first()
    assert got[0] > 0.7 * got[1] and got[2] > -1


def test_fit_sample_is_bounded_and_of_whole_different_texts(spark):
    v = toy()
    rows = spark.createDataFrame([(f"a b {k % 40} " + "c " * 700,) for k in range(400)], "text string")
    got = lm.sample(rows, v, 12)
    assert len(got) == 12 and {len(g) for g in got} == {704}
    assert len(lm.sample(rows, v, 100)) == 40


def test_every_training_document_changes_the_network(spark, monkeypatch):
    """Which words follow each other only documents outside the sample tell; shards are averaged, and how rows are stored does not matter."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4000)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(w for x in rng.integers(0, 4, 30).tolist() for w in (f"a{x}", f"b{x}"))) for i in range(400)]
    learn = spark.createDataFrame([(t,) for _, t in rows], "text string")
    v = lm.vocabulary_of(lm.word_counts(learn))
    before = lm.GatedLM(v)
    docs = [np.minimum(lm._ids(v, lm.tokens_of(t)).astype(np.uint64), v.k).astype(np.int64) for _, t in rows]
    of = lambda net: sum(x for _, x in net.log_likelihoods(enumerate(docs)))
    nets = []
    for parts in (1, 5):
        net = lm.GatedLM(v)
        lm.fit_on_all(learn.repartition(parts), v, net)
        nets.append(net)
    assert all(np.array_equal(nets[0].p[k], nets[1].p[k]) for k in before.p)
    assert not any(np.array_equal(nets[0].p[k], before.p[k]) for k in ("x", "u", "wc", "bc"))
    assert of(nets[0]) > of(before)
    called = []
    monkeypatch.setattr(lm, "fit_on_all", lambda learn, v, net: called.append(learn.count()))
    lm.score(frame(spark, rows), max_fit=1).first()
    assert called == [sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows)]


def test_copies_of_a_text_are_spread_over_shards_and_words_are_numbered_once(spark, monkeypatch):
    """Learning gets the ids that scoring gets, and documents with one text do not meet in one shard."""
    given = []
    monkeypatch.setattr(lm, "fit_on_all", lambda learn, v, net: given.extend(learn.collect()))
    rows = [(i, "same words again and again") for i in range(300)]
    assert lm.score(frame(spark, rows)).count() == 300
    assert len({bytes(r["ids"]) for r in given}) == 1 and len(given) == sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(300))
    shards = Counter(r["h"] % 4 for r in given)
    assert len(shards) == 4 and max(shards.values()) < 0.5 * len(given)


@pytest.mark.parametrize("held", [1, 400_000])
def test_words_of_many_texts_are_numbered_together(spark, monkeypatch, held):
    import pyarrow as pa

    texts = [*TEXTS, "a\x0b", " K İ \x1c b\tc", None]
    for part in (pa.array(texts), pa.array(["ÀÉ", *texts, "ü"])[1:-1], pa.array([None], pa.string())):  # slices too
        words, nth, size = lm.numbered(part)
        words = words.to_pylist()
        want = [lm.tokens_of(t) for t in part.to_pylist()]
        assert [words[k] for k in nth] == [w for t in want for w in t] and size.tolist() == list(map(len, want))
        assert len(set(words)) == len(words) and words[-1] == lm.END
    monkeypatch.setattr(lm, "HELD_WORDS", held)
    found = lm.word_counts(frame(spark, list(enumerate(texts))).select("text"))
    assert {bytes(r["word"]): r["c"] for r in found.collect()} == Counter(w for t in texts for w in lm.tokens_of(t))


def test_a_long_document_does_not_take_windows_alone():
    docs = [np.full(n, 1) for n in (1000, 1, 7, 30, 3)]
    found = list(lm.windows(enumerate(docs), 0, 4, 5, True))
    assert len(found) <= 2 + 1000 // 20 + 5 and all(w.word.size <= 4 * 5 for w in found)
    assert [int(sum((w.owner == k).sum() for w in found)) for k in range(5)] == [1000, 1, 7, 30, 3]
    assert sorted(k for w in found for k in w.ended) == [0, 1, 2, 3, 4]
    assert all((w.owner[-1] >= 0).any() for w in found)


def test_large_logits(spark):
    """Beyond what single precision can exponentiate."""
    v, rng = toy(), np.random.default_rng(3)
    net = some_net(v)
    net.p["wm"] *= 150
    net.p["wc"] *= 150
    docs = [rng.integers(0, v.k + 1, n) for n in (1, 9, 5)]
    for k, value in net.log_likelihoods(enumerate(docs), 2, 4):
        assert value == pytest.approx(plain(net, v, docs[k]), rel=1e-3)


def test_common_words_are_the_most_frequent_ones(spark):
    rows = [(f"w{k:03}".encode(), 1 + k * k) for k in range(200)] + [(b"x" * 300, 10**6)]
    v = lm.vocabulary_of(spark.createDataFrame(rows, "word binary, c long").repartition(4), 10, 50)
    assert v.total == sum(c for _, c in rows) and v.distinct == 201 and 40 <= len(v.words) <= 50
    assert v.words == [w for w, _ in sorted(rows[:-1], key=lambda r: -r[1])][: len(v.words)] and v.counts[0] == 1 + 199 * 199
    assert len(lm.vocabulary_of(spark.createDataFrame(rows, "word binary, c long"), 10, 1000).words) == 200


# --- importance resampling ---------------------------------------------------------------------------------------------


def resampled(docs, target, percent=25):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2) for i in range(len(w) - n + 1)]
    s, t = (Counter(b for x in texts for b in runs(words(x))) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    out = []
    for i, text in docs:
        f = runs(words(text))
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        import hashlib

        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) if i is not None else None
        out.append([i, len(f), weight, score, None, len(words(text))])
    able = sorted((r for r in out if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0], -r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(str, (r[:5] for r in out)))


TARGET = ["lumen kern", None, "The orbit of THE quill " * 3, ""]


@pytest.mark.parametrize("long_bytes, chunk", [(1 << 16, 4096), (40, 5), (40, 1)])
def test_importance(spark, monkeypatch, long_bytes, chunk):
    monkeypatch.setattr(importance, "LONG_BYTES", long_bytes)
    monkeypatch.setattr(importance.chunks_of, "__defaults__", (chunk, 2))
    target = spark.createDataFrame([(t, "x") for t in TARGET], "text string, doc_id string")
    found = importance.resample(frame(spark, ROWS), target)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == resampled(ROWS, TARGET)
    assert dict(found.dtypes) == dict.fromkeys(["doc_id", "n_words", "n_features", "weight", "score", "rank"], "bigint")


def test_importance_of_empty_tables(spark):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert importance.resample(frame(spark, ROWS).limit(0), target).count() == 0
    found = importance.resample(frame(spark, ROWS), target.limit(0)).collect()
    assert sorted(str([r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")]) for r in found) == resampled(ROWS, [])
    assert all(r["rank"] is None for r in importance.resample(frame(spark, [(1, "a b"), (2, None)]), target).collect())


def test_draw_takes_everything_and_breaks_ties_by_id(spark):
    rows = [(i, " ".join(["same"] * 25)) for i in [*range(30), 4, 4]]
    got = importance.resample(frame(spark, rows), spark.createDataFrame([("a",)], "text string"), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 33))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [r["doc_id"] for r in sorted(got, key=lambda r: (-r["score"], r["doc_id"]))]


def test_chunks_own_every_start_once():
    words = [str(k).encode() for k in range(23)]
    for n in (1, 2, 3):
        whole = importance.buckets_of(words, 23, n)
        for size in (1, 4, 23, 50):
            parts = [importance.buckets_of(w, own, n) for w, own in importance.chunks_of(words, size, n)]
            assert sorted(np.concatenate(parts)) == sorted(whole)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_importance_query_against_its_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con, folder = duckdb.connect(), f"/root/testdata/{sf}"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_importance"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op12_importance(spark, folder).collect())


# --- whitening ---------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], "vec_id long, embedding array<double>, x string, length string, n string").repartition(3)


def exact(rows):
    """n, sums, and for each row the deviation, in big integers."""
    x = {k: tuple(max(min(math.floor(256 * c), 2**63 - 1), -(2**63)) if abs(256 * c) != math.inf else (2**63 - 1 if c > 0 else -(2**63)) for c in v) for k, (_, v) in enumerate(rows)}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    return n, s, fit, {k: (sum((n * a - b) ** 2 for a, b in zip(v, s)), v) for k, v in x.items()}


@pytest.mark.parametrize("outlier", [0.0, 1e6, 1e12, 1e30, 1e306])
def test_whitening(spark, outlier):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    if outlier:
        data[5, 2], data[7] = outlier, -outlier
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(90, data[3].tolist()), (91, data[3].tolist())]
    n, s, fit, want = exact(rows)
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert {(r["vec_id"], r["component"]) for r in found} == {(i, k) for i, _ in rows for k in range(1, 5)} and len(found) == 4 * len(rows)
    assert {r["n"] for r in found} == {n}
    deviation = {rows[k][0]: d for k, (d, _) in want.items()}
    assert all(r["deviation"] == (deviation[r["vec_id"]] if deviation[r["vec_id"]] < 10**38 else None) for r in found)
    assert {r["identity_error"] <= 1e-4 for r in found} == {True}
    white = np.zeros((len(rows), 4))
    at = {i: k for k, (i, _) in enumerate(rows)}
    for r in found:
        white[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    cov = [[Fraction(sum((n * a[i] - s[i]) * (n * a[j] - s[j]) for a in fit), n**3) for j in range(6)] for i in range(6)]
    trace = sum(cov[i][i] for i in range(6))
    share = {r["component"]: r["explained"] for r in found}
    # the projection's own axis, found from the whitened values, is an eigenvector with that eigenvalue
    _, axes = whitening.basis(np.array([[int(c * n**3) for c in line] for line in cov], object), n**3)
    for k in range(4):
        v = [Fraction(int(a), 1 << whitening.POINT) for a in axes[:, k]]
        image, e = [sum(c * b for c, b in zip(line, v)) for line in cov], Fraction(share[k + 1]) * trace
        assert abs(float(sum(b * b for b in v)) - 1) < 1e-12
        assert all(abs(float((a - e * b) / e)) < 1e-6 for a, b in zip(image, v))
        for j, (_, x) in want.items():
            y = float(sum((Fraction(c) - Fraction(m, n)) * b for c, m, b in zip(x, s, v))) / math.sqrt(float(e))
            assert min(abs(white[j, k] - y), abs(white[j, k] + y)) < 1e-6 * max(1, abs(y))
    if not outlier:
        e, q = np.linalg.eigh(np.cov(np.array(fit, float).T, bias=True))
        assert np.allclose([share[k] for k in range(1, 5)], e[::-1][:4] / e.sum(), rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, []), (None, [3.0, -2.0]), (5, [1.0, 2.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-0.0, 0.0]), (9, [0.0, 0.0]), (10, [4.0])]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted(map(str, {(r["vec_id"], r["n"]) for r in found})) == ["(1, 3)", "(10, 1)", "(5, 3)", "(8, 3)", "(9, 3)", "(None, 3)"]
    of = {(r["vec_id"], r["component"]): r for r in found}
    assert of[8, 1]["whitened"] == of[9, 1]["whitened"] and of[1, 2]["whitened"] == of[5, 2]["whitened"]
    assert (of[10, 1]["whitened"], of[10, 1]["explained"], of[10, 1]["identity_error"], of[10, 1]["deviation"]) == (None, None, None, 0)
    assert of[1, 1]["identity_error"] < 1e-9
    flat = {(r["component"], r["whitened"] is None, r["explained"]) for r in whitening.whiten(vectors(spark, [(i, [float(i), 5.0]) for i in range(4)])).collect()}
    assert flat == {(1, False, 1.0), (2, True, 0.0)}
    assert whitening.whiten(vectors(spark, rows).limit(0)).count() == 0


def test_slices_of_digits_are_exact(monkeypatch):
    rng = np.random.default_rng(6)
    for top in (1 << 7, 1 << 15, 1 << 16, 1 << 40, (1 << 63) - 1):
        x = rng.integers(-top, top, (50, 3), endpoint=True)
        x[0], x[1] = top, -top
        assert all((sum(int(p[i, j]) << (whitening.LIMB * k) for k, p in enumerate(whitening.limbs(x))) == x[i, j]) for i in range(50) for j in range(3))
        monkeypatch.setattr(whitening, "EXACT_ROWS", 7)
        g = whitening.Gram(3)
        g.add(x[:20])
        g.join()
        g.add(x[20:])
        g.join()
        o = x.astype(object)
        assert g.n == 50 and (g.sums == o.sum(0)).all() and (g.products == o.T.dot(o)).all()
