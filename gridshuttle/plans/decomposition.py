"""How a grid is split over ranks: pure arithmetic on sizes, and layout tables.

Axes are numbered 0 (x, fastest), 1 (y), 2 (z). A rank's part is a ``Box`` of
``starts`` and ``counts`` in that order; ``order`` says how a layout keeps it
in memory, fastest axis first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame, SparkSession

from ..enums import Layout
from ..errors import ErrorCode, check

LAYOUT_SCHEMA = "rank int, layout int, starts array<int>, counts array<int>, size long"
HOST_TILE = 4


@dataclass(frozen=True)
class Box:
    starts: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def size(self) -> int:
        return prod(self.counts)

    @classmethod
    def of(cls, starts: Sequence[int], counts: Sequence[int]) -> Box:
        check(len(starts) == len(counts), ErrorCode.PENCIL_ARRAYS_SIZE_MISMATCH)
        check(len(starts) in (2, 3), ErrorCode.PENCIL_ARRAYS_INVALID_SIZES)
        check(min(starts) >= 0, ErrorCode.PENCIL_INVALID_STARTS)
        check(min(counts) >= 0, ErrorCode.PENCIL_INVALID_COUNTS)
        return cls(tuple(starts), tuple(counts))

    def meets(self, other: Box) -> Box | None:
        lo = tuple(map(max, self.starts, other.starts))
        hi = tuple(min(a + n, b + m) for a, n, b, m in zip(self.starts, self.counts, other.starts, other.counts, strict=True))
        return Box(lo, tuple(h - s for s, h in zip(lo, hi, strict=True))) if all(s < h for s, h in zip(lo, hi, strict=True)) else None


def split(n: int, parts: int, r: int) -> tuple[int, int]:
    """(start, count) of part ``r``; what doesn't divide goes to the last parts."""
    q, m = divmod(n, parts)
    extra = max(0, r - (parts - m))
    return r * q + extra, q + (r >= parts - m)


def dims_create(n: int, k: int) -> tuple[int, ...]:
    """``n`` as ``k`` factors as near to each other as can be, largest first."""
    if k == 1:
        return (n,)
    root = max(d for d in range(1, int(n**0.5) + 1) if n % d == 0) if k == 2 else min((d for d in range(1, n + 1) if n % d == 0), key=lambda d: (abs(d - n ** (1 / k)), -d))
    rest = dims_create(n // root, k - 1)
    return tuple(sorted((root, *rest), reverse=True))


def rank_coords(rank: int, grid: Sequence[int]) -> tuple[int, ...]:
    """Grid coordinates, last axis fastest."""
    out = []
    for n in reversed(grid):
        rank, c = divmod(rank, n)
        out.append(c)
    return tuple(reversed(out))


def default_grid(dims: Sequence[int], parts: int, z_slab: bool = True, y_slab: bool = False) -> tuple[tuple[int, ...], bool, bool]:
    """(grid, z-slab used, y-slab used) for ``parts`` ranks."""
    if len(dims) == 2:
        return (1, parts), False, False
    by_z, by_y = parts <= dims[2], parts <= dims[0] and parts <= dims[1]
    if by_z:
        return (1, 1, parts), z_slab, False
    if by_y:
        return (1, parts, 1), False, y_slab
    a, b = dims_create(parts, 2)
    return (1, a, b), False, False


def grid_of_boxes(dims: Sequence[int], values: int, least: int = 1) -> tuple[int, ...]:
    """The grid of fewest ranks, ``least`` at least, whose pencils hold at most
    about ``values`` points: slabs along z while they do, else y and z cut
    alike (as far as the axes allow, so that no rank is empty)."""
    parts = max(least, -(-prod(dims) // values))
    if len(dims) == 2:
        return (1, max(1, min(parts, *dims)))
    if parts <= dims[2]:
        return (1, 1, parts)
    most_y, most_z = min(dims[0], dims[1]), min(dims[1], dims[2])
    z = min(most_z, max(1, round(parts**0.5)))
    y = min(most_y, -(-parts // z))
    return (1, y, min(most_z, -(-parts // y)))


def slab_use(dims, grid, z_slab: bool, y_slab: bool) -> tuple[bool, bool]:
    """Which slab shortcut a given grid allows."""
    if len(dims) == 2:
        return False, False
    z = z_slab and grid[1] == 1
    return z, (not z) and y_slab and grid[2] == 1


#: Memory order (fastest first) and the grid axis that splits each axis x, y, z.
ORDERS = {3: {Layout.X_PENCILS: (0, 1, 2), Layout.Y_PENCILS: (1, 2, 0), Layout.Z_PENCILS: (2, 0, 1)}, 2: {Layout.X_PENCILS: (0, 1), Layout.Y_PENCILS: (1, 0)}}
SPLITS = {3: {Layout.X_PENCILS: (0, 1, 2), Layout.Y_PENCILS: (1, 0, 2), Layout.Z_PENCILS: (1, 2, 0)}, 2: {Layout.X_PENCILS: (0, 1), Layout.Y_PENCILS: (1, 0)}}


def order_of(layout: Layout, ndims: int) -> tuple[int, ...]:
    same = {Layout.X_BRICKS: Layout.X_PENCILS, Layout.X_PENCILS_FOURIER: Layout.X_PENCILS, Layout.Z_BRICKS: Layout.Z_PENCILS if ndims == 3 else Layout.Y_PENCILS}
    return ORDERS[ndims][same.get(layout, layout)]


def pencil_boxes(dims: Sequence[int], grid: Sequence[int], layout: Layout) -> list[Box]:
    """Every rank's box in a pencil layout over ``grid`` (first entry 1)."""
    axes = SPLITS[len(dims)][layout]
    out = []
    for rank in range(prod(grid)):
        c = rank_coords(rank, grid)
        parts = [split(n, grid[a], c[a]) for n, a in zip(dims, axes, strict=True)]
        out.append(Box(tuple(s for s, _ in parts), tuple(n for _, n in parts)))
    return out


def brick_boxes(dims: Sequence[int], grid: Sequence[int]) -> list[Box]:
    """Bricks over a full grid, first axis fastest, the whole remainder in the
    last coordinate."""
    out = []
    for rank in range(prod(grid)):
        starts, counts, r = [], [], rank
        for n, g in zip(dims, grid, strict=True):
            r, c = divmod(r, g)
            starts.append(c * (n // g))
            counts.append(n // g + (n % g if c == g - 1 else 0))
        out.append(Box(tuple(starts), tuple(counts)))
    return out


def validate_boxes(boxes: Sequence[Box | None]) -> tuple[int, ...]:
    """Global sizes of boxes that tile a grid; the error of those that don't."""
    check(all(isinstance(b, Box) for b in boxes), ErrorCode.PENCIL_NOT_INITIALIZED)
    check(len({len(b.starts) for b in boxes} | {len(b.counts) for b in boxes}) == 1, ErrorCode.PENCIL_ARRAYS_SIZE_MISMATCH)
    n = len(boxes[0].starts)
    check(n in (2, 3), ErrorCode.PENCIL_ARRAYS_INVALID_SIZES)
    check(all(min(b.starts) >= 0 for b in boxes), ErrorCode.PENCIL_INVALID_STARTS)
    check(all(min(b.counts) >= 0 for b in boxes), ErrorCode.PENCIL_INVALID_COUNTS)
    dims = tuple(max(b.starts[a] + b.counts[a] for b in boxes) for a in range(n))
    full = [b for b in boxes if b.size]
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    for i, j in pairs:  # boxes that start alike in two axes are alike in both
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for x in full:
            at, size = (x.starts[i], x.starts[j]), (x.counts[i], x.counts[j])
            check(seen.setdefault(at, size) == size, ErrorCode.PENCIL_SHAPE_MISMATCH)
    live: list[Box] = []
    for x in sorted(full, key=lambda b: b.starts[-1]):  # sweep along the last axis
        live = [y for y in live if y.starts[-1] + y.counts[-1] > x.starts[-1]]
        check(not any(x.meets(y) for y in live), ErrorCode.PENCIL_OVERLAP)
        live.append(x)
    check(sum(b.size for b in boxes) == prod(dims), ErrorCode.PENCIL_NOT_CONTINUOUS)
    return dims


def is_even(boxes: Sequence[Box]) -> bool:
    return len({b.counts for b in boxes}) == 1


def is_distributed(boxes: Sequence[Box], axis: int = 0) -> bool:
    return len({b.starts[axis] for b in boxes}) > 1


def varying_groups(boxes: Sequence[Box], axis: int) -> list[list[int]]:
    """Ranks that agree on all but ``axis``, in the order of ``axis``."""
    groups: dict[tuple, list[int]] = {}
    for r, b in enumerate(boxes):
        groups.setdefault(tuple((s, c) for a, (s, c) in enumerate(zip(b.starts, b.counts, strict=True)) if a != axis), []).append(r)
    return [sorted(g, key=lambda r: boxes[r].starts[axis]) for _, g in sorted(groups.items())]


def bricks_grid(boxes: Sequence[Box], tile: int = HOST_TILE) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(brick grid P0 x P1 x P2, factors (Qy, Qz) that the ranks along x give
    to the other axes) for bricks that form a grid."""
    n = len(boxes[0].starts)
    brick = tuple(len({b.starts[a] for b in boxes}) for a in range(n))
    check(prod(brick) == len(boxes), ErrorCode.INVALID_CART_COMM)
    fast = brick[0]
    if n == 2:
        return brick, (fast,)
    y, z = (min(b.counts[a] for b in boxes) for a in (1, 2))
    roomy = lambda extent, parts: extent > tile * parts
    even = lambda extent, parts: extent % parts == 0 and extent >= tile * parts
    # whole to z, else whole to y, else the smallest divisor that cuts both evenly, else as square as can be
    wishes = [(1, fast)] * roomy(z, fast) + [(fast, 1)] * roomy(y, fast)
    wishes += [tuple(sorted((d, fast // d))) for d in range(2, fast + 1) if fast % d == 0 and even(z, d) and even(y, d)]
    return brick, (*wishes, dims_create(fast, 2))[0]


def pencils_from_bricks(boxes: Sequence[Box], tile: int = HOST_TILE) -> list[Box]:
    """X-pencils, rank by rank: the ranks that share a brick row along x cut
    its other extents among them."""
    n, dims = len(boxes[0].starts), validate_boxes(boxes)
    _, q = bricks_grid(boxes, tile)
    out: list[Box | None] = [None] * len(boxes)
    for group in varying_groups(boxes, 0):
        for k, rank in enumerate(group):
            b = boxes[rank]
            at = (k,) if n == 2 else (k // q[1], k % q[1])
            cut = [split(b.counts[a], q[a - 1], at[a - 1]) for a in range(1, n)]
            out[rank] = Box((0, *(b.starts[a] + cut[a - 1][0] for a in range(1, n))), (dims[0], *(c for _, c in cut)))
    return out  # type: ignore[return-value]


def pencils_from_pencils(boxes: Sequence[Box], dims: Sequence[int], layout: Layout) -> list[Box]:
    """Y- and Z-pencils that follow user-made X-pencils: an axis that becomes
    whole is exchanged within the ranks that share the rest."""
    n = len(dims)
    ys = sorted({(b.starts[1], b.counts[1]) for b in boxes})
    if layout == Layout.X_PENCILS:
        return list(boxes)
    if n == 2:
        return [Box((s, 0), (c, dims[1])) for s, c in (split(dims[0], len(boxes), sorted(range(len(boxes)), key=lambda r: boxes[r].starts[1]).index(r)) for r in range(len(boxes)))]
    regular = all((b.starts[1], b.counts[1]) in ys for b in boxes)
    check(regular, ErrorCode.INVALID_CART_COMM)
    rows = {r: g for g in varying_groups(boxes, 1) for r in g}
    columns = {r: g for g in varying_groups(boxes, 2) for r in g}
    out = []
    for r, b in enumerate(boxes):
        g = rows[r]
        x = split(dims[0], len(g), g.index(r))
        if layout == Layout.Y_PENCILS:
            out.append(Box((x[0], 0, b.starts[2]), (x[1], dims[1], b.counts[2])))
        else:
            h = columns[r]
            y = split(dims[1], len(h), h.index(r))
            out.append(Box((x[0], y[0], 0), (x[1], y[1], dims[2])))
    return out


def groups_of(ranks: Sequence[int], size: int, strided: bool = False) -> list[list[int]]:
    """``ranks`` in groups: neighbours, ``size`` a group, or (strided) every
    ``size``-th rank together, ``size`` groups."""
    colors: dict[int, list[int]] = {}
    for k, r in enumerate(ranks):
        colors.setdefault(k % size if strided else k // size, []).append(r)
    return [g for _, g in sorted(colors.items())]


def fourier_grid(boxes: Sequence[Box], parts: int) -> tuple[int, ...]:
    """Sizes of the brick grid on the spectral side, by axis: the last axis has
    a neighbour group's size, the other that of a strided group."""
    n = len(boxes[0].starts)
    along = varying_groups(boxes, n - 2)[0]
    last, other = len(groups_of(along, parts)[0]), len(groups_of(along, parts, strided=True)[0])
    return (other, last) if n == 2 else (len({b.starts[0] for b in boxes}), other, last)


def fourier_bricks(boxes: Sequence[Box], parts: int) -> list[Box]:
    """Bricks on the spectral side: in runs of ``parts`` ranks along the last
    split axis, the last axis is split and the other extent is shared."""
    n = len(boxes[0].starts)
    last, other = n - 1, n - 2
    out: list[Box | None] = [None] * len(boxes)
    for group in varying_groups(boxes, other):
        for run in groups_of(group, parts):
            lo, total = min(boxes[r].starts[other] for r in run), sum(boxes[r].counts[other] for r in run)
            for k, r in enumerate(run):
                s, c = split(boxes[r].counts[last], len(run), k)
                starts, counts = list(boxes[r].starts), list(boxes[r].counts)
                starts[last], counts[last], starts[other], counts[other] = s, c, lo, total
                out[r] = Box(tuple(starts), tuple(counts))
    return out  # type: ignore[return-value]


def layout_frame(spark: SparkSession, boxes: Sequence[Box], layout: Layout) -> DataFrame:
    """The layout as a table, a row a rank."""
    return spark.createDataFrame([(r, int(layout), list(b.starts), list(b.counts), b.size) for r, b in enumerate(boxes)], LAYOUT_SCHEMA)


def is_product(boxes: Sequence[Box]) -> bool:
    """Whether the boxes are all combinations of one set of cuts an axis."""
    full = [b for b in boxes if b.size]
    return prod(len({(b.starts[a], b.counts[a]) for b in full}) for a in range(len(full[0].starts))) == len(full) == len(boxes)
