"""Local data movement on arrays indexed [z, y, x] (x fastest)."""

from __future__ import annotations

import numpy as np


def permute_forward(a: np.ndarray) -> np.ndarray:
    """(x, y, z) in memory becomes (y, z, x); (x, y) becomes (y, x)."""
    return np.ascontiguousarray(a.transpose(2, 0, 1) if a.ndim == 3 else a.T)


def permute_backward(a: np.ndarray) -> np.ndarray:
    """(x, y, z) in memory becomes (z, x, y)."""
    return np.ascontiguousarray(a.transpose(1, 2, 0) if a.ndim == 3 else a.T)


def permute_backward_start(a: np.ndarray) -> np.ndarray:
    """First half of the backward permutation: (x, y, z) becomes (z, y, x)."""
    return np.ascontiguousarray(a.transpose(2, 1, 0))


def permute_backward_end(a: np.ndarray) -> np.ndarray:
    """Second half: swaps the two slower axes of what the first half made."""
    return np.ascontiguousarray(a.transpose(1, 0, 2))


def written(a: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """``a`` with its axes in the order ``axes``, read in order and written with strides."""
    out = np.empty([a.shape[k] for k in axes], a.dtype)
    out.transpose(np.argsort(axes))[...] = a
    return out


def pack(a: np.ndarray, starts, counts) -> np.ndarray:
    """A sub-box (fastest axis first) as a contiguous run."""
    return a[tuple(slice(s, s + n) for s, n in zip(reversed(starts), reversed(counts), strict=True))].ravel()


def unpack(run: np.ndarray, out: np.ndarray, starts, counts) -> np.ndarray:
    """A contiguous run into a sub-box of ``out``."""
    out[tuple(slice(s, s + n) for s, n in zip(reversed(starts), reversed(counts), strict=True))] = run.reshape(tuple(reversed(counts)))
    return out


def copy(a: np.ndarray) -> np.ndarray:
    """The same values in memory of their own."""
    return np.array(a, order="C")


def pack_forward(a: np.ndarray, starts, counts) -> np.ndarray:
    """A sub-box permuted forward as it is packed."""
    return permute_forward(pack(a, starts, counts).reshape(tuple(reversed(counts)))).ravel()


def pack_backward(a: np.ndarray, starts, counts) -> np.ndarray:
    """A sub-box permuted backward as it is packed."""
    return permute_backward(pack(a, starts, counts).reshape(tuple(reversed(counts)))).ravel()


def get_fused(kernel):
    """What a kernel becomes when a partner's part is packed at a time."""
    return {permute_forward: pack_forward, permute_backward: pack_backward}.get(kernel, pack)
