"""Fourier-type transforms of NumPy arrays, unscaled in either direction.

Complex transforms use a negative exponent forward. The eight real kinds
follow the usual FFTW conventions and are computed as FFTs of the extended
signal, whose symmetry is that of the kind.
"""

from __future__ import annotations

import numpy as np

from ..enums import R2RKind

#: The kind that undoes each kind, and the factor a round trip leaves on an axis of n.
INVERSE = {
    R2RKind.DCT_1: R2RKind.DCT_1, R2RKind.DCT_2: R2RKind.DCT_3, R2RKind.DCT_3: R2RKind.DCT_2, R2RKind.DCT_4: R2RKind.DCT_4,
    R2RKind.DST_1: R2RKind.DST_1, R2RKind.DST_2: R2RKind.DST_3, R2RKind.DST_3: R2RKind.DST_2, R2RKind.DST_4: R2RKind.DST_4,
}


def round_trip_factor(kind: R2RKind, n: int) -> int:
    return 2 * (n - 1) if kind == R2RKind.DCT_1 else 2 * (n + 1) if kind == R2RKind.DST_1 else 2 * n


def c2c(a: np.ndarray, axes: tuple[int, ...], forward: bool) -> np.ndarray:
    return np.fft.fftn(a, axes=axes) if forward else np.fft.ifftn(a, axes=axes, norm="forward")


def r2c(a: np.ndarray, axis: int) -> np.ndarray:
    return np.fft.rfft(a, axis=axis)


def c2r(a: np.ndarray, axis: int, n: int) -> np.ndarray:
    """Needs the real length, as both parities have the same spectrum size."""
    return np.fft.irfft(a, n=n, axis=axis, norm="forward")


def r2r(a: np.ndarray, axis: int, kind: R2RKind) -> np.ndarray:
    x = np.moveaxis(a, axis, -1)
    n = x.shape[-1]
    k = np.arange(n)
    kind = R2RKind(kind)
    if kind == R2RKind.DCT_1:  # even about both ends
        y = np.fft.rfft(np.concatenate([x, x[..., -2:0:-1]], axis=-1), axis=-1).real
    elif kind == R2RKind.DST_1:  # odd about the points before and after
        zero = np.zeros((*x.shape[:-1], 1), x.dtype)
        y = -np.fft.rfft(np.concatenate([zero, x, zero, -x[..., ::-1]], axis=-1), axis=-1).imag[..., 1 : n + 1]
    elif kind in (R2RKind.DCT_2, R2RKind.DST_2):
        sine = kind == R2RKind.DST_2
        v = x * (1 - 2 * (k % 2)) if sine else x  # a sine transform is a cosine transform of alternating signs, reversed
        f = np.fft.fft(np.concatenate([v, v[..., ::-1]], axis=-1), axis=-1)[..., :n]
        y = (f * np.exp(-0.5j * np.pi * k / n)).real
        y = y[..., ::-1] if sine else y
    elif kind in (R2RKind.DCT_3, R2RKind.DST_3):
        sine = kind == R2RKind.DST_3
        v = x[..., ::-1] if sine else x
        c = v * np.exp(0.5j * np.pi * k / n)
        c = np.concatenate([c, np.zeros_like(c)], axis=-1)
        y = 2 * np.fft.ifft(c, axis=-1, norm="forward")[..., :n].real - v[..., :1].real
        y = y * (1 - 2 * (k % 2)) if sine else y
    else:  # the fourth kinds: half-sample shifts on both sides
        sine = kind == R2RKind.DST_4
        v = x[..., ::-1] if sine else x
        c = v * np.exp(-0.5j * np.pi * k / n)
        f = np.fft.fft(np.concatenate([c, np.zeros_like(c)], axis=-1), axis=-1)[..., :n]
        y = 2 * (f * np.exp(-0.5j * np.pi * (k + 0.5) / n)).real
        y = y * (1 - 2 * (k % 2)) if sine else y
    return np.moveaxis(y.astype(a.dtype, copy=False), -1, axis)
