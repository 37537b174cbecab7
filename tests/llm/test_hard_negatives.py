"""Hard negatives against a plain version over all rows."""

import math
import random

import pytest
from llm import hard_negatives as neg


def plain(rows, every=100, positives=5, k=10):
    """Lines as the operator returns them; rows are (id, vector, label)."""
    ok = [(i, u, [math.floor(256 * x) for x in v], lab) for u, (i, v, lab) in enumerate(rows)
          if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in ok:
        if a[0] % every:
            continue
        order = sorted((-score(a, b), b[0], b[1], b[3]) for b in ok if b[1] != a[1])
        for s, i, _, _ in [o for o in order if o[3] == a[3]][:positives]:
            window = [o for o in order if o[3] != a[3] and -30 * s <= -100 * o[0] <= -90 * s]
            out += [(a[0], i, r + 1, o[1], -s, -o[0]) for r, o in enumerate(window[:k])]
    return sorted(out)


def found(spark, rows, **given):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    return sorted(map(tuple, neg.hard_negatives(table, **given).collect()))


def make(n, d, seed, values=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(values)) if values else (lambda: rng.gauss(0.1, 0.2))
    return [(i, [draw() for _ in range(d)], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("few", [0, 4])
def test_equals_plain_version(spark, few):
    rows = make(420, 7, 1)
    assert plain(rows) and found(spark, rows, few=few) == plain(rows)
    assert found(spark, rows, few=few, group_elements=400) == plain(rows)  # many small groups


def test_ties_copies_repeats_and_lengths(spark):
    rows = make(330, 3, 2, [0.0, 0.5, 1.0]) + [(500 + i, [1.0, 1.0, 1.0], 9) for i in range(120)]
    rows += [(200, [1.0, 1.0, 0.5], 0), (7, [1.0, 1.0, 1.0], 2), (7, [1.0, 1.0, 1.0], 2), (903, [1.0], 1), (904, [1.0, 0.5, 1.0, 5.0], 1), (906, [], 1)]
    assert plain(rows) and found(spark, rows, few=0) == plain(rows)


def test_large_components_stay_exact(spark):
    for scale in (1e3, 3e6):  # double, then 64-bit integer products
        rows = [(i, [x * scale for x in v], lab) for i, v, lab in make(210, 4, 3)]
        assert plain(rows) and found(spark, rows, few=0) == plain(rows)


def test_rows_that_take_no_part(spark):
    bad = [(0, None, 1), (100, [1.0, None], 1), (200, [float("nan"), 1.0], 1), (300, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 1), (400, [1.0, 1.0], None)]
    assert found(spark, bad) == [] and found(spark, []) == []
    rows = bad + make(205, 2, 4)
    assert found(spark, rows) == plain(rows)
    huge = [(i, [1e300 * (-1) ** i, 1.0], i % 3) for i in range(120)]
    found(spark, huge)  # beyond 64 bits: wrapped, no crash


def test_clashing_columns(spark):
    rows = make(150, 3, 5)
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label long, uid int, group int, score int")
    assert sorted(map(tuple, neg.hard_negatives(table).collect())) == plain(rows)
