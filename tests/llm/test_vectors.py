import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, impact


def vectors():
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).round(3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [math.nan] * 6), (404, [math.inf] * 6), (405, []), (None, [1.0] * 6), (406, [5.0, 5.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label string, id int")


def usable(rows, zero):
    out = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = np.array(v, np.float32).astype(float)
        if zero or v.any():
            out.append((i, v))
    return out


def brute(rows, every, k, score):
    want = {}
    for q, a in rows:
        if q % every == 0:
            found = sorted((-score(a, b), i) for i, b in rows if i != q and len(a) == len(b))[:k]
            want[q] = [(i, -s) for s, i in found]
    return want


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("blocks", [(10_000, 10_000), (50, 7)])
def test_nearest_are_exact(spark, blocks):
    got = result(ann.nearest_neighbours(frame(spark, vectors()), F.col("id") % 20 == 0, 20, candidate_rows=blocks[0], query_rows=blocks[1]))
    want = brute(usable(vectors(), False), 20, 20, lambda a, b: ann.products(a[None], b[None])[0])
    want = {q: x for q, x in want.items() if x}
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(s == t for q in got for (_, s), (_, t) in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("blocks", [(10_000, 10_000), (50, 7)])
def test_impact_index_is_exact(spark, blocks):
    got = result(impact.top_k(frame(spark, vectors()), F.col("id") % 50 == 0, 5, candidate_rows=blocks[0], query_rows=blocks[1]))
    want = brute(usable(vectors(), True), 50, 5, lambda a, b: int((np.floor(256 * a) * np.floor(256 * b)).sum()))
    assert got == {q: x for q, x in want.items() if x}


def test_bounds_hold():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(40, 33)) * 10.0 ** r.integers(-6, 6, (40, 1)), r.normal(size=(50, 33))
    qa, sa, na, ra = ann.int8_codes(a)
    qb, sb, nb, rb = ann.int8_codes(b)
    near = (qa @ qb.T).astype(float) * sa[:, None] * sb
    assert (np.abs(near - a @ b.T) <= (na[:, None] * rb + ra[:, None] * (nb + rb)) * (1 + 1e-9) + 1e-12 * (na + ra)[:, None] * (nb + rb)).all()


@pytest.mark.parametrize("dense", [0.0, 0.02, 2.0])
def test_impact_stops_only_on_proof(monkeypatch, dense):
    monkeypatch.setattr(impact, "DENSE", dense)
    r = np.random.default_rng(1)
    m = np.floor(256 * r.standard_cauchy((400, 12)))
    q = np.floor(256 * r.normal(size=(30, 12)))
    index = impact.ImpactIndex(m)
    i, rows, score = index.search(q, np.zeros((400, 30), bool), np.arange(400), 5)
    for k in range(30):
        assert sorted(score[i == k].tolist(), reverse=True) == sorted((m @ q[k]).tolist(), reverse=True)[:5]
    # every non-zero cell is in one posting list, levels descend
    assert len(index.row) == np.count_nonzero(m)
    sizes = [np.abs(index.impact[index.start[12 * n] : index.start[12 * n + 12]]) for n in range(len(impact.LEVELS))]
    assert all(a.min() >= b.max() for a, b in zip(sizes, sizes[1:], strict=False) if len(a) and len(b))


def test_many_components_lose_nothing():
    # codes of 127 throughout: their products pass what single precision adds exactly
    r = np.random.default_rng(9)
    m = 1.0 + r.integers(0, 2, (3000, 4096)) * 2.0**-20
    q = m[::100] * r.choice([1.0, 0.5], (30, 1))
    ids = np.arange(10, 3010)
    qi, ci, score = ann.nearest(20)(ids, m)(np.arange(-30, 0), q)
    for i in range(30):
        exact = ann.products(np.broadcast_to(q[i], m.shape), m)
        want = sorted(zip(-exact, ids, strict=True))[:20]
        got = sorted(zip(-score[qi == i], ids[ci[qi == i]], strict=True))
        assert [x[1] for x in got] == [x[1] for x in want]


def test_repeated_ids(spark):
    big = 2**53 + 2
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, -1.0]), *[(k, [float(k), 1.0]) for k in range(1, 9)], (5, [5.0, 1.0]), (5, [9.0, 9.0]), (big, [100.0, 1.0]), (big + 1, [100.0, 1.0])]
    for search, k in ((ann.nearest_neighbours, 4), (impact.top_k, 4)):
        got = search(frame(spark, rows), F.col("id") == 0, k).collect()
        # two different vectors ask; the row that comes twice is two candidates
        assert len(got) == 2 * k and sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4] * 2)
        one = sorted([r for r in got if r.score in {x.score for x in got if x.score > 0}], key=lambda r: (r["rank"], r.vec_id))
        assert [r.vec_id for r in one if r["rank"] == 1] == [big, big] and [r.vec_id for r in one if r["rank"] == 2] == [big + 1, big + 1]
        again = search(frame(spark, [*rows[3:], (20, [1.0, 1.0])]), F.col("id") == 20, 8).collect()
        assert collections.Counter(r.vec_id for r in again)[5] == 3


def test_no_rows_and_few_rows(spark):
    none = frame(spark, [])
    assert ann.nearest_neighbours(none, F.col("id") % 20 == 0).count() == 0
    assert impact.top_k(none, F.col("id") % 50 == 0).count() == 0
    two = frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])
    assert [(r.query_id, r.vec_id) for r in ann.nearest_neighbours(two, F.col("id") % 20 == 0).collect()] == [(0, 1)]
