"""A lossy codec of blocks of four values an axis.

Each block is scaled to integers by the exponent of its largest value, turned
by reversible lifting steps along every axis (means and differences, the
finer differences less what their neighbours predict), put into negabinary
and written bit plane by bit plane from the top. A plane says how many
coefficients, in the order of smoothness, have been met so far and gives one
bit of each of those. So any prefix of a block's bits is a coarser block, and
a rate, a precision or a tolerance is no more than a place to stop.

All blocks of an array are worked on together, a chunk at a time.
"""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np

#: Bits behind the block's exponent; how much an error in all coefficients can grow along one axis.
FRACTION, GROWTH = 50, 2.375
EXPONENT_BITS, BIAS, CHUNK = 16, 1 << 14, 2048
_MASK = np.uint64(0xAAAAAAAAAAAAAAAA)


def planes_of(d: int) -> int:
    """Bit planes of a block of ``d`` axes: fraction, growth of the lifting, two of the sign-free form."""
    return FRACTION + 2 * d + 2


@cache
def order_of(d: int) -> tuple[int, ...]:
    """Coefficients by smoothness: mean of all, difference of halves, finer differences."""
    weight = (0, 1, 2, 2)
    return tuple(sorted(range(4**d), key=lambda k: (sum(weight[k // 4**a % 4] for a in range(d)), k)))


def _blocks(x: np.ndarray) -> np.ndarray:
    """(block, 4, ..) of ``x``, whose edge values fill the last blocks."""
    d = x.ndim
    x = np.pad(x, [(0, -n % 4) for n in x.shape], mode="edge")
    x = x.reshape([m for n in x.shape for m in (n // 4, 4)])
    return x.transpose(*range(0, 2 * d, 2), *range(1, 2 * d, 2)).reshape(-1, *[4] * d)


def _array(blocks: np.ndarray, shape: tuple[int, ...], axes: tuple[int, ...]) -> np.ndarray:
    """The array of ``shape``, its axes taken in the order ``axes``."""
    d, grid = len(shape), [-(-n // 4) for n in shape]
    x = blocks.reshape(*grid, *[4] * d).transpose([k for a in axes for k in (a, d + a)])
    return x.reshape([4 * grid[a] for a in axes])[tuple(slice(shape[a]) for a in axes)]


def lift(q: np.ndarray) -> np.ndarray:
    """Values to coefficients along every axis but the first."""
    for a in range(1, q.ndim):
        w, x, y, z = (q.take(k, axis=a) for k in range(4))
        d0, d1 = x - w, z - y
        s0, s1 = w + (d0 >> 1), y + (d1 >> 1)
        rise = s1 - s0
        slope = (rise + 2) >> 2
        q = np.stack([s0 + (rise >> 1), rise, d0 - slope, d1 - slope], axis=a)
    return q


def unlift(q: np.ndarray) -> np.ndarray:
    """Undoes ``lift`` exactly."""
    for a in range(q.ndim - 1, 0, -1):
        mean, rise, d0, d1 = (q.take(k, axis=a) for k in range(4))
        slope = (rise + 2) >> 2
        d0, d1 = d0 + slope, d1 + slope
        s0 = mean - (rise >> 1)
        s1 = s0 + rise
        w, y = s0 - (d0 >> 1), s1 - (d1 >> 1)
        q = np.stack([w, w + d0, y, y + d1], axis=a)
    return q


def error_bound(d: int, plane: int) -> float:
    """The largest error, in integer steps, of a block cut below ``plane``."""
    return (2.0**plane + 2) * GROWTH**d + 1


def lowest_planes(exponents: np.ndarray, d: int, tolerance: float) -> np.ndarray:
    """The last plane each block needs for ``tolerance``; -1 where none is enough."""
    allowed = np.ldexp(tolerance, FRACTION - exponents)
    limits = np.array([error_bound(d, p) for p in range(planes_of(d) + 1)])
    return np.searchsorted(limits, allowed, side="right") - 1


def _chunk_bits(x: np.ndarray, exponents: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, which of them are there) of each block's planes from the top to ``lowest``."""
    d = x.ndim - 1
    size, planes = 4**d, planes_of(d)
    q = np.rint(np.ldexp(x, (FRACTION - exponents).reshape(-1, *[1] * d))).astype(np.int64)
    u = ((lift(q).reshape(len(x), size)[:, order_of(d)].astype(np.uint64) + _MASK) ^ _MASK)
    bits = np.zeros((len(x), planes, 1 + 2 * d + size), bool)
    here = np.zeros_like(bits)
    met = np.zeros(len(x), np.int64)
    for k, p in enumerate(range(planes - 1, -1, -1)):
        plane = (u >> np.uint64(p)) & np.uint64(1) == 1
        now = np.maximum(met, np.where(plane.any(axis=1), size - np.argmax(plane[:, ::-1], axis=1), 0))
        more, live = now > met, p >= lowest
        bits[:, k, 0], here[:, k, 0] = more, live
        bits[:, k, 1 : 1 + 2 * d] = ((now - 1)[:, None] >> np.arange(2 * d)) & 1 == 1
        here[:, k, 1 : 1 + 2 * d] = (more & live)[:, None]
        bits[:, k, 1 + 2 * d :] = plane
        here[:, k, 1 + 2 * d :] = (np.arange(size) < now[:, None]) & live[:, None]
        met = now
    return bits.reshape(len(x), -1), here.reshape(len(x), -1)


def block_bits(rate: float, d: int) -> int:
    """Bits of a block at ``rate`` bits a value, its exponent included."""
    return max(EXPONENT_BITS + 1, int(rate * 4**d))


def encode(x: np.ndarray, rate: float | None = None, precision: int | None = None, tolerance: float | None = None) -> bytes | None:
    """``x`` (finite, its first axis are fields apart) by one of three stops;
    None where a tolerance is finer than the integers."""
    d = x.ndim - 1
    blocks = np.concatenate([_blocks(f.astype(np.float64)) for f in x])
    flat = blocks.reshape(len(blocks), -1)
    top = np.abs(flat).max(axis=1, initial=0.0)
    exponents = np.frexp(top)[1].astype(np.int64)
    lowest = np.zeros(len(blocks), np.int64)
    if tolerance is not None:
        lowest = np.where(top <= tolerance, planes_of(d), lowest_planes(exponents, d, tolerance))
        if (lowest < 0).any():
            return None
    elif precision is not None:
        lowest += max(planes_of(d) - precision, 0)
    lowest[top == 0] = planes_of(d)
    budget = block_bits(rate, d) - EXPONENT_BITS if rate is not None else 0
    out, sizes = [], []
    for at in range(0, len(blocks), CHUNK):
        part = slice(at, at + CHUNK)
        bits, here = _chunk_bits(blocks[part], exponents[part], lowest[part])
        if rate is not None:
            place = np.cumsum(here, axis=1)
            here &= place <= budget
            fixed = np.zeros((len(bits), budget), bool)
            rows, columns = np.nonzero(here)
            fixed[rows, place[rows, columns] - 1] = bits[rows, columns]
            out.append(fixed.ravel())
        else:
            out.append(bits[here])
            sizes.append(here.sum(axis=1))
    head = np.where(top == 0, 0, exponents + BIAS).astype("<u2").tobytes()
    lengths = b"" if rate is not None else np.concatenate(sizes or [np.zeros(0, np.int64)]).astype("<u2").tobytes()
    return head + lengths + np.packbits(np.concatenate(out) if out else np.zeros(0, bool)).tobytes()


def decode(data: bytes, shape: tuple[int, ...], rate: float | None = None, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Fields of ``shape`` (first axis: fields), the other axes in the order ``axes``."""
    d = len(shape) - 1
    size, planes, each = 4**d, planes_of(d), int(np.prod([-(-n // 4) for n in shape[1:]], dtype=np.int64))
    n = shape[0] * each
    head = np.frombuffer(data, "<u2", n).astype(np.int64)
    if rate is not None:
        lengths, start = np.full(n, block_bits(rate, d) - EXPONENT_BITS), 2 * n
    else:
        lengths, start = np.frombuffer(data, "<u2", n, 2 * n).astype(np.int64), 4 * n
    stream = np.unpackbits(np.frombuffer(data, np.uint8, offset=start)).astype(bool)
    begins = np.cumsum(lengths) - lengths
    blocks = np.empty((n, size))
    for at in range(0, n, CHUNK):
        long = lengths[at : at + CHUNK]
        m, width = len(long), int(long.max(initial=0))
        bits = np.zeros((m, width + 1 + 2 * d + size), np.uint64)
        given = np.arange(width) < long[:, None]
        bits[:, :width][given] = stream[begins[at] : begins[at] + long.sum()]
        u, met, where = np.zeros((m, size), np.uint64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        rows, offsets = np.arange(m), np.arange(size)
        for p in range(planes - 1, -1, -1):
            live = where < long
            if not live.any():
                break
            more = live & (bits[rows, np.minimum(where, width)] == 1)
            where = where + live
            told = (bits[rows[:, None], np.minimum(where, width)[:, None] + np.arange(2 * d)] << np.arange(2 * d, dtype=np.uint64)).sum(axis=1).astype(np.int64) + 1
            met = np.where(more, np.maximum(met, told), met)
            where = where + 2 * d * more
            plane = bits[rows[:, None], np.minimum(where, width)[:, None] + offsets] * ((offsets < met[:, None]) & live[:, None])
            u |= plane << np.uint64(p)
            where = where + met * live
        q = np.empty((m, size), np.int64)
        q[:, order_of(d)] = ((u ^ _MASK) - _MASK).astype(np.int64)
        e = head[at : at + CHUNK]
        values = np.ldexp(unlift(q.reshape(m, *[4] * d)).reshape(m, size).astype(np.float64), (e - BIAS - FRACTION)[:, None])
        blocks[at : at + CHUNK] = np.where(e[:, None] == 0, 0.0, values)
    order = axes or tuple(range(d))
    return np.stack([_array(blocks[f * each : (f + 1) * each].reshape(each, *[4] * d), shape[1:], order) for f in range(shape[0])])
