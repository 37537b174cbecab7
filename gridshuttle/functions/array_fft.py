"""Fourier-type transforms of array columns with DataFrame functions alone.

A row holds a whole line of the grid. Lengths that are products of small
primes go through mixed-radix steps, each one pass over the array; others
through a chirp: a convolution on the next power of two. Either way the work
is n log n, and no Python runs. Nothing is scaled.

Inside, a complex line is an ``array<struct<re, im>>``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..enums import R2RKind

#: The largest prime that gets a step of its own.
LARGEST = 13


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often it
    is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table(values: np.ndarray) -> Column:
    """Numbers as one constant array."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def radices(n: int) -> list[int] | None:
    """Factors of ``n`` for the steps, None if one is too large."""
    out = []
    while n % 4 == 0:
        out.append(4)
        n //= 4
    for p in range(2, LARGEST + 1):
        while n % p == 0:
            out.append(p)
            n //= p
    return out if n == 1 else None


def _point(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _at(x: Column, i: Column) -> Column:
    return F.get(x, i)


def _indices(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _sum(terms: list[tuple[float, Column]]) -> Column:
    """Of factor times column; factors of zero and one cost nothing."""
    out = None
    for c, x in terms:
        if c:
            one = x if abs(c) == 1 else x * abs(c)
            out = (one if c > 0 else -one) if out is None else out + one if c > 0 else out - one
    return out


def _step(x: Column, n: int, done: int, radix: int, sign: int) -> Column:
    """One step: of the ``done`` interleaved lines left to transform, each
    becomes ``radix`` shorter ones. What a point needs lies n / ``radix`` places
    apart, so the array is cut into ``radix`` slices that are read side by side."""
    width, left = n // radix, n // done
    angle = lambda i: sign * 2 * np.pi * i
    spin = np.arange(width) // done  # place within its line
    turns = []
    for s in range(1, radix if left > radix else 1):
        w = np.exp(1j * angle((spin * s) % left) / left)
        turns += [table(w.real), table(w.imag)]
    side = F.arrays_zip(*[F.slice(x, 1 + t * width, width) for t in range(radix)], *turns)  # fields are named by number

    def points(p: Column) -> Column:
        out = []
        for s in range(radix):
            roots = [complex(np.exp(1j * angle((t * s) % radix) / radix)) for t in range(radix)]
            roots = [complex(round(w.real), round(w.imag)) if (4 * t * s) % radix == 0 else w for t, w in enumerate(roots)]  # quarter turns are exact
            re = _sum([(w.real, p[f"{t}"]["re"]) for t, w in enumerate(roots)] + [(-w.imag, p[f"{t}"]["im"]) for t, w in enumerate(roots)])
            im = _sum([(w.real, p[f"{t}"]["im"]) for t, w in enumerate(roots)] + [(w.imag, p[f"{t}"]["re"]) for t, w in enumerate(roots)])
            if s and turns:
                c, d = p[f"{radix + 2 * s - 2}"], p[f"{radix + 2 * s - 1}"]
                re, im = re * c - im * d, re * d + im * c
            out.append(_point(re, im))
        return F.array(*out)

    return F.flatten(F.transform(side, points))


def _order(n: int, steps: list[int]) -> np.ndarray:
    """Where each frequency lies after all steps."""
    at, frequency, weight = np.zeros(1, int), np.zeros(1, int), 1
    for r in steps:
        at, frequency = (at[:, None] * r + np.arange(r)).ravel(), (frequency[:, None] + weight * np.arange(r)).ravel()
        weight *= r
    out = np.empty(n, int)
    out[frequency] = at
    return out


def fft(x: Column, n: int, forward: bool = True) -> Column:
    """The complex transform of ``x``, an array of ``n`` points."""
    steps = radices(n)
    if steps is None:
        return _chirp(x, n, forward)
    places = F.split(F.lit(",".join(map(str, _order(n, steps).tolist()))), ",").cast("array<int>")

    def go(x: Column, done: int, left: list[int]) -> Column:
        if not left:
            return F.transform(places, lambda i: F.get(x, i)) if steps else x
        return let(_step(x, n, done, left[0], -1 if forward else 1), lambda y: go(y, done * left[0], left[1:]))

    return let(x, lambda x: go(x, 1, steps))


def _times(x: Column, re: Column, im: Column, n: int) -> Column:
    """The first ``n`` points, each times its pair of two constant arrays."""
    return F.transform(F.slice(x, 1, n), lambda p, i: _point(p["re"] * _at(re, i) - p["im"] * _at(im, i), p["re"] * _at(im, i) + p["im"] * _at(re, i)))


def _chirp(x: Column, n: int, forward: bool) -> Column:
    """nk = (n² + k² - (k - n)²) / 2 turns the transform into a convolution."""
    m = 1 << (2 * n - 1).bit_length()
    k = np.arange(n)
    wave = np.exp((-1j if forward else 1j) * np.pi * ((k * k) % (2 * n)) / n)
    kernel = np.zeros(m, complex)
    kernel[:n] = wave.conj()
    kernel[m - n + 1 :] = wave.conj()[:0:-1]
    kernel = np.fft.fft(kernel) / m
    zero = F.array_repeat(_point(F.lit(0.0), F.lit(0.0)), m - n)
    once = lambda x: F.concat(_times(x, table(wave.real), table(wave.imag), n), zero)
    twice = let(let(x, once), lambda x: let(fft(x, m), lambda y: _times(y, table(kernel.real), table(kernel.imag), m)))
    return let(fft(twice, m, False), lambda y: _times(y, table(wave.real), table(wave.imag), n))


def complex_line(re: Column, im: Column | None = None) -> Column:
    return F.transform(re, lambda r: _point(r.cast("double"), F.lit(0.0))) if im is None else F.zip_with(re, im, lambda r, i: _point(r.cast("double"), i.cast("double")))


def r2c(v: Column, n: int) -> Column:
    """Points 0 to n div 2 of a real line's transform."""
    return F.slice(fft(complex_line(v), n), 1, n // 2 + 1)


def c2r(x: Column, n: int) -> Column:
    """The real line of ``n`` values of a half spectrum."""
    whole = lambda x: F.concat(x, F.transform(F.sequence(F.lit((n - 1) // 2), F.lit(1), F.lit(-1)), lambda i: _point(_at(x, i)["re"], -_at(x, i)["im"]))) if n > 2 else x
    ends = lambda x: F.transform(_indices(n // 2 + 1), lambda i: _point(_at(x, i)["re"], F.when((i == 0) | (i * 2 == n), 0.0).otherwise(_at(x, i)["im"])))
    return F.transform(fft(let(let(x, ends), whole), n, False), lambda p: p["re"])


def _real(v: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Real values by value and place."""
    return F.transform(v, lambda a, i: f(a, i))


def r2r(v: Column, n: int, kind: R2RKind) -> Column:
    """A real transform of ``n`` values, as a complex one of the extended line."""
    kind = R2RKind(kind)
    k = np.arange(n)
    sign = lambda y: _real(y, lambda a, i: F.when(i % 2 == 0, a).otherwise(-a))
    sine = kind in (R2RKind.DST_2, R2RKind.DST_3, R2RKind.DST_4)
    if kind == R2RKind.DCT_1:
        if n == 1:
            return v
        long = let(v, lambda v: F.concat(v, F.reverse(F.slice(v, 2, n - 2)) if n > 2 else F.array().cast("array<double>")))
        return F.transform(F.slice(fft(complex_line(long), 2 * (n - 1)), 1, n), lambda p: p["re"])
    if kind == R2RKind.DST_1:
        zero = F.array(F.lit(0.0))
        long = let(v, lambda v: F.concat(zero, v, zero, F.transform(F.reverse(v), lambda a: -a)))
        return F.transform(F.slice(fft(complex_line(long), 2 * (n + 1)), 2, n), lambda p: -p["im"])
    if kind in (R2RKind.DCT_2, R2RKind.DST_2):
        wave = np.exp(-0.5j * np.pi * k / n)
        long = let(sign(v) if sine else v, lambda v: F.concat(v, F.reverse(v)))
        y = F.transform(_times_of(fft(complex_line(long), 2 * n), wave, n), lambda p: p["re"])
        return F.reverse(y) if sine else y
    given = F.reverse(v) if sine else v
    inverse = kind in (R2RKind.DCT_3, R2RKind.DST_3)
    wave = np.exp((0.5j if inverse else -0.5j) * np.pi * k / n)
    zero = F.array_repeat(_point(F.lit(0.0), F.lit(0.0)), n)

    def turned(v: Column) -> Column:
        f = fft(F.concat(_times_of(complex_line(v), wave, n), zero), 2 * n, not inverse)
        if inverse:
            return let(f, lambda f: F.transform(F.slice(f, 1, n), lambda p: 2 * p["re"] - F.get(v, F.lit(0))))
        return F.transform(_times_of(f, 2 * np.exp(-0.5j * np.pi * (k + 0.5) / n), n), lambda p: p["re"])

    y = let(given, turned)
    return sign(y) if sine else y


def _times_of(x: Column, wave: np.ndarray, n: int) -> Column:
    return let(x, lambda x: _times(x, table(wave.real), table(wave.imag), n))
