import numpy as np
import pytest

from llm.elias_fano import EliasFano, encode


@pytest.mark.parametrize(("n", "universe"), [(0, 1), (1, 1), (5, 5), (100, 100), (1000, 10**6), (3000, 2**61), (777, 800), (64, 2**33)])
def test_round_trip(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    blob = b"xxxxxxxx" + encode(v, universe) + b"tail"
    e = EliasFano(blob, 8)
    assert e.end == len(blob) - 4
    assert (e.get(np.arange(n)) == v).all()
    x = np.concatenate([v, rng.integers(0, universe, 500, dtype=np.uint64), np.array([0, universe - 1, universe], dtype=np.uint64)])
    assert (e.successor(x) == np.searchsorted(v, x)).all()


def test_compact():
    v = np.sort(np.random.default_rng(0).integers(0, 2**40, 100000, dtype=np.uint64))
    assert len(encode(v, 2**40)) * 8 / len(v) < 2 + 40 - 16.6 + 2.5
