"""Block codecs for exchanges.

Lossless is zlib on byte planes. The lossy modes are the block codec's: a
fixed rate (the size follows from the shape alone), a precision in bit planes
of a block, or a tolerance that no value's error exceeds. They keep the bounds
their settings state, not the bit patterns of any other codec. Values that are
not finite, and tolerances too fine for the block codec, go the lossless way.
A block that would not shrink is stored as it is, so none grows by more than
its mark of one byte.
"""

from __future__ import annotations

import zlib

import numpy as np

from ..config import CompressionConfig
from ..enums import CompressionMode
from ..errors import ErrorCode, check
from . import block_codec

RAW, PLANES, RATE, BLOCKS = 0, 1, 2, 3


def _fields(a: np.ndarray) -> np.ndarray:
    """A complex array is two fields of reals."""
    return np.stack([a.real, a.imag]) if np.iscomplexobj(a) else a[None]


def fixed_size(shape: tuple[int, ...], rate: float, fields: int = 1) -> int:
    """Bytes of an array of ``shape`` at a fixed rate."""
    blocks, d = fields * int(np.prod([-(-n // 4) for n in shape])), len(shape)
    return 9 + 2 * blocks + -(-blocks * (block_codec.block_bits(rate, d) - block_codec.EXPONENT_BITS) // 8)


def _lossy(x: np.ndarray, config: CompressionConfig) -> bytes | None:
    if config.mode == CompressionMode.LOSSLESS or not np.isfinite(x).all():
        return None
    if config.mode == CompressionMode.FIXED_RATE:
        return bytes([RATE]) + np.float64(config.rate).tobytes() + block_codec.encode(x, rate=config.rate)
    given = {"precision": config.precision} if config.mode == CompressionMode.FIXED_PRECISION else {"tolerance": config.tolerance - (np.spacing(np.float32(np.abs(x).max(initial=0))) if x.itemsize == 4 else 0)}
    data = block_codec.encode(x, **given)
    return None if data is None else bytes([BLOCKS]) + data


def compress(a: np.ndarray, config: CompressionConfig) -> bytes:
    x = np.ascontiguousarray(_fields(a))
    config.validate(8 * x.itemsize)
    raw = x.tobytes()
    data = _lossy(x, config) if x.size else None
    if data is None:  # bytes of equal weight together compress better
        planes = x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T
        data = bytes([PLANES]) + zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)
    return data if len(data) <= len(raw) else bytes([RAW]) + raw


def decompress(data: bytes, dtype: np.dtype, shape: tuple[int, ...], axes: tuple[int, ...] | None = None) -> np.ndarray:
    """The array of ``shape`` that was given to ``compress``; with ``axes`` its
    axes in that order, into which blocks are decoded straight away."""
    dtype = np.dtype(dtype)
    fields = 2 if dtype.kind == "c" else 1
    real = np.dtype(f"f{dtype.itemsize // fields}")
    order = axes or tuple(range(len(shape)))
    if data[0] in (RATE, BLOCKS):
        rate = float(np.frombuffer(data, np.float64, 1, 1)[0]) if data[0] == RATE else None
        x = block_codec.decode(data[9 if data[0] == RATE else 1 :], (fields, *shape), rate, order).astype(real)
    else:
        raw = data[1:] if data[0] == RAW else np.ascontiguousarray(np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(real.itemsize, -1).T).tobytes()
        x = np.frombuffer(raw, real)
        check(x.size == fields * int(np.prod(shape)), ErrorCode.COMPRESSION_NOT_USED, "a block of another size")
        x = x.reshape(fields, *shape).transpose(0, *(1 + a for a in order))
    return (x[0] + 1j * x[1]).astype(dtype) if fields == 2 else np.ascontiguousarray(x[0])
