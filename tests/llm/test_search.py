"""Curve search against brute force."""

import numpy as np

from llm import curve_search as C

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k=10, every=100):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(np.float64)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        d = np.sqrt(((x - good[i]) ** 2).sum(axis=1))
        out[int(i)] = [(float(d[j]), int(ids[j])) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def found(df, **more):
    out = {}
    for r in sorted(C.search(df, **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall(spark):
    """Random directions, the hardest case: nothing but all coordinates tells neighbours apart."""
    x = np.random.default_rng(1).normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist(), "", 0) for i, v in enumerate(x)]
    got, want = found(spark.createDataFrame(rows, SCHEMA).repartition(4)), brute(rows)
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == 10 and got[q] == sorted(got[q]) for q in got)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4)).round(2)
    rows = [(i, v.tolist(), "", 0) for i, v in enumerate(x)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0], "", 0) for i in range(300, 700)]  # copies: ties go to small ids
    rows += [(800, None, "", 0), (900, [0.0] * 4, "", 0), (1000, [1.0, None, 0.0, 0.0], "", 0), (1100, [float("nan")] * 4, "", 0), (1200, [float("inf"), 1.0, 1.0, 1.0], "", 0), (None, [1.0] * 4, "", 0), (1300, [1.0, 2.0], "", 0)]
    rows += [rows[3], rows[0]]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = brute([r for r in rows if r[0] != 1300])
    assert got == want
    assert found(spark.createDataFrame(rows[:4], SCHEMA)) == brute(rows[:4])
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame(rows[:1], SCHEMA)) == {}


def test_few_classes_held(spark, monkeypatch):
    """Classes that a task sends more than once are one class again."""
    rows = [(i, [float(1 + i % 7), 1.0, 0.0], "", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    want = found(df)
    monkeypatch.setattr(C, "HELD", 2)
    assert found(df) == want == brute(rows)


def test_hilbert_is_a_walk():
    """Every cell once, and neighbours on the curve are neighbours in space."""
    for d, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = C.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
