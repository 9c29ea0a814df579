"""Operators over the whole of their input, where part of it would look right: links between any two rows, in any place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import resolve as E
from heliograph.operators import search as S
from heliograph.plans import registry

NEAR = 0.9


def _vectors(n=150):
    """Rows with close twins, exact copies, and rows without a direction."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 6))
    x[61], x[103], x[47] = x[1] + 0.01, x[1] + 0.02, x[2]
    x[120:140] = x[7]
    x[11] = x[13] = 0
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)]


def _links(rows, least):
    x = np.array([v for _, v in rows if v is not None])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return np.round(x @ x.T, 9) >= least


@pytest.mark.parametrize("block", [4096, 40])
def test_groups_over_all_pairs(spark, block):
    rows = _vectors()
    near, of = _links(rows, NEAR), list(range(150))
    for _ in rows:
        of = [min([of[i], *(of[j] for j in np.nonzero(near[i])[0])]) for i in range(150)]
    found = {r["id"]: r["component"] for r in E.near_groups(spark.createDataFrame(rows, "id long, vector array<double>"), NEAR, block).collect()}
    assert found == {**dict(enumerate(of)), 900: 900}
    assert found[103] == 1 and found[47] == 2 and found[139] == 7 and found[13] == 13
    assert E.near_groups(spark.createDataFrame([], "id long, vector array<double>"), NEAR).count() == 0
    with pytest.raises(ValueError):
        E.near_groups(spark.createDataFrame(rows, "id long, vector array<double>"), 0)


def test_registered_groups_use_every_row(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(60, 64))
    x[33], x[51] = x[21], x[21] + 0.01  # no id divisible by 20
    d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    d.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r["id"]: r["component"] for r in registry.QUERIES["dedup_components"](spark, str(tmp_path)).collect()}
    assert found[33] == found[51] == found[21] <= 21
    one = registry.QUERIES["canonical_of_components"](spark, str(tmp_path)).where(F.col("component") == found[21]).first()
    assert one["members"] >= 3


def test_similar_texts_over_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = [rng.choice(30, rng.integers(1, 12)).tolist() for _ in range(12)]
    rows = []
    for t in range(90):
        words = list(base[t % 12])
        if t % 3:
            words[0] = int(rng.integers(30))
        rows.append((t % 2, t, " ".join(f"W{x}" for x in rng.permutation(words))))
    rows += [(0, 500, "a b c d e f g h i j"), (0, 700, "A B C D E F G"), (0, 800, " "), (0, 801, None), (0, 802, "")]
    sets = {(c, t): frozenset((x or "").lower().split()) for c, t, x in rows}
    want = {(c, a, b) for c, a in sets for e, b in sets if c == e and a < b and sets[c, a] and len(sets[c, a] & sets[c, b]) / len(sets[c, a] | sets[c, b]) >= 0.7}
    assert (0, 500, 700) in want and any(b - a > 2 for _, a, b in want)
    found = S.similar_texts(spark.createDataFrame(rows, "c long, t long, text string").repartition(3), "c", "t").collect()
    rep = {(r["c"], r["target"]): r["source"] for r in found if r["relation"] == "same_words"}
    links = {(r["c"], r["source"], r["target"]) for r in found if r["relation"] == "related_to"}
    assert len(rep) + len(links) == len(found) and rep
    of = lambda c, t: rep.get((c, t), t)
    ends = lambda c, a, b: (c, min(of(c, a), of(c, b)), max(of(c, a), of(c, b)))
    got = {(c, a, b) for c, a in sets for e, b in sets if c == e and a < b and (of(c, a) == of(c, b) or ends(c, a, b) in links)}
    assert got == want


def _folded(rows, threshold):
    kept, out = [], {}
    for i, v in rows:
        x = np.array(v) / np.linalg.norm(v) if v is not None and any(v) else None
        best = max(((round(float(u @ x), 9), -n, k) for n, (k, u) in enumerate(kept)), default=(0, 0, None)) if x is not None else (0, 0, None)
        out[i] = best[2] if best[0] >= threshold else i
        if out[i] == i and x is not None:
            kept.append((i, x))
    return out


def test_merging_in_order_reaches_everything_kept_before(spark):
    from heliograph.operators import integrate as I

    rows = _vectors()
    frame = spark.createDataFrame([(i, v, i) for i, v in rows], "id long, vector array<double>, ordinal long").repartition(3)
    for size in (4096, 40):
        assert {r["id"]: r["keep_id"] for r in I.merge_in_order(frame, 0.8, size).collect()} == _folded(rows, 0.8)
    assert I.merge_in_order(frame.limit(0), 0.8).count() == 0


def test_registered_merge_has_no_blocks(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(200, 64))
    x[190] = x[5]  # in other blocks of 64 ids
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r["id"]: r["keep_id"] for r in registry.QUERIES["sequential_merge"](spark, str(tmp_path)).collect()}
    assert found == _folded(rows, 0.35) and found[190] == found[5]


def test_one_connected_group_is_merged_in_a_few_rounds(spark):
    """A chain of 20 000 rows around a circle, each near the next ones only, in mixed order: one group, and no turn for each block of it."""
    from heliograph.operators import integrate as I

    n, step = 20_000, 2 * np.pi / 20_000
    angle = np.random.default_rng(2).permutation(n) * step
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    threshold = float(np.cos(2.5 * step))
    place = np.round(angle / step).astype(int)
    kept, want = {}, {}
    for i, p in enumerate(place.tolist()):
        near = [(abs(d), kept[(p + d) % n]) for d in (-2, -1, 0, 1, 2) if (p + d) % n in kept]
        if not near:
            kept[p] = i
        want[i] = min(near)[1] if near else i
    rows = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "id long, vector array<double>, ordinal long").repartition(6)
    found = {r["id"]: r["keep_id"] for r in I.merge_in_order(rows, threshold, 2048).collect()}
    # cosines of neighbours differ by less than what scores are rounded to, so any kept one within reach may be the nearest
    assert {i for i in found if found[i] == i} == set(kept.values())
    reach = lambda a, b: min((place[a] - place[b]) % n, (place[b] - place[a]) % n)
    assert all(reach(i, k) <= 2 and k <= i for i, k in found.items())
    nodes = rows.select("id", "vector", F.lit(False).alias("fixed"))
    _, rounds = I.first_greedy(nodes, threshold, 2048)
    assert rounds <= 5


def test_one_crowd_and_an_ordered_chain(spark):
    from heliograph.operators import integrate as I

    rng = np.random.default_rng(5)
    crowd = rng.normal(size=(1, 16)) + 0.25 * rng.normal(size=(900, 16))
    line = [[float(np.cos(t)), float(np.sin(t)), *[0.0] * 14] for t in np.arange(300) * 0.02]
    rows = [(i, list(map(float, v)), i) for i, v in enumerate([*crowd, *line])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>, ordinal long").repartition(4)
    want = _folded([(i, v) for i, v, _ in rows], 0.9995)
    assert {r["id"]: r["keep_id"] for r in I.merge_in_order(frame, 0.9995, 100).collect()} == want
    want = _folded([(i, v) for i, v, _ in rows], 0.93)
    assert {r["id"]: r["keep_id"] for r in I.merge_in_order(frame, 0.93, 128).collect()} == want
