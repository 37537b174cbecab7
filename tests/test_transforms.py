"""Kernels against direct sums and each other."""

import numpy as np
import pytest

from gridshuttle.config import CompressionConfig
from gridshuttle.enums import CompressionMode, R2RKind
from gridshuttle.functions import block_codec as B
from gridshuttle.functions import compression as C
from gridshuttle.functions import kernels as K
from gridshuttle.functions import transforms as tf

rng = np.random.default_rng(0)


def matrix(kind, n):
    j, k = np.arange(n)[None], np.arange(n)[:, None]
    pi = np.pi
    alt = (-1.0) ** k
    if kind == R2RKind.DCT_1:
        m = 2 * np.cos(pi * j * k / (n - 1))
        m[:, :1], m[:, -1:] = 1, alt
    elif kind == R2RKind.DCT_2:
        m = 2 * np.cos(pi * (j + 0.5) * k / n)
    elif kind == R2RKind.DCT_3:
        m = 2 * np.cos(pi * j * (k + 0.5) / n)
        m[:, :1] = 1
    elif kind == R2RKind.DCT_4:
        m = 2 * np.cos(pi * (j + 0.5) * (k + 0.5) / n)
    elif kind == R2RKind.DST_1:
        m = 2 * np.sin(pi * (j + 1) * (k + 1) / (n + 1))
    elif kind == R2RKind.DST_2:
        m = 2 * np.sin(pi * (j + 0.5) * (k + 1) / n)
    elif kind == R2RKind.DST_3:
        m = 2 * np.sin(pi * (j + 1) * (k + 0.5) / n)
        m[:, -1:] = alt
    else:
        m = 2 * np.sin(pi * (j + 0.5) * (k + 0.5) / n)
    return m


@pytest.mark.parametrize("kind", list(R2RKind))
@pytest.mark.parametrize("n", [2, 3, 8, 17])
def test_real_kinds(kind, n):
    x = rng.normal(size=(3, n, 2))
    got = tf.r2r(x, 1, kind)
    assert np.allclose(got, np.einsum("kj,ajb->akb", matrix(kind, n), x), atol=1e-11)
    assert np.allclose(tf.r2r(got, 1, tf.INVERSE[kind]) / tf.round_trip_factor(kind, n), x, atol=1e-12)
    assert tf.r2r(x.astype("f4"), 1, kind).dtype == np.float32


def test_complex():
    x = rng.normal(size=(4, 5, 6)) + 1j * rng.normal(size=(4, 5, 6))
    assert np.allclose(tf.c2c(tf.c2c(x, (0, 2), True), (0, 2), False) / 24, x)
    for n in (6, 7):
        r = rng.normal(size=(3, n))
        assert np.allclose(tf.c2r(tf.r2c(r, 1), 1, n) / n, r)


def test_permutations():
    a = np.arange(33 * 7 * 21).reshape(21, 7, 33)
    f, b = K.permute_forward(a), K.permute_backward(a)
    assert f[3, 4, 5] == a[4, 5, 3] and b[3, 4, 5] == a[5, 3, 4]
    assert (K.permute_backward(f) == a).all() and (K.permute_backward_end(K.permute_backward_start(a)) == b).all()
    p = K.pack(a, (2, 1, 3), (5, 2, 4))
    assert (K.unpack(p, np.zeros_like(a), (2, 1, 3), (5, 2, 4))[3:7, 1:3, 2:7] == a[3:7, 1:3, 2:7]).all() and p.size == 40
    m = np.arange(90 * 57).reshape(57, 90)
    assert (K.permute_forward(m) == m.T).all()


@pytest.mark.parametrize("dtype", ["f4", "f8", "c8", "c16"])
def test_codecs(dtype):
    a = rng.normal(size=(16, 16)).astype(dtype) + (1j * rng.normal(size=(16, 16))).astype(dtype) if dtype[0] == "c" else rng.normal(size=(16, 16)).astype(dtype)
    a = a.astype(dtype)
    back = lambda c: C.decompress(C.compress(a, c), dtype, a.shape)
    assert (back(CompressionConfig()) == a).all()
    near = back(CompressionConfig(mode=CompressionMode.FIXED_ACCURACY, tolerance=1e-2))
    assert max(abs((near - a).real).max(), abs((near - a).imag).max()) <= 1.001e-2
    near = back(CompressionConfig(mode=CompressionMode.FIXED_PRECISION, precision=20))
    top = 2.0 ** np.ceil(np.log2(max(abs(a.real).max(), abs(a.imag).max())))  # precision counts bit planes of a block
    assert max(abs((near - a).real).max(), abs((near - a).imag).max()) <= B.error_bound(2, B.planes_of(2) - 20) * top / 2.0**B.FRACTION
    assert len(C.compress(np.zeros((64, 64)), CompressionConfig())) < 200
