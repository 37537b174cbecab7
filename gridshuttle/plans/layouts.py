"""Layouts as tables, a row a rank: made, checked and looked up with Spark.

A layout table has ``rank, layout, starts, counts, size``. Checks run as
grouped sums and one join on coarse cells, so tables of very many boxes are
checked where they lie; the driver gets no more than the sizes, and boxes only
once a plan is made of them, if they are few. Those of more than ``MANY`` ranks
stay in their table (``TableBoxes``), pencils of as many are worked out rank by
rank (``Pencils``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import Layout
from ..errors import ErrorCode, GridError
from ..functions.array_fft import let
from .decomposition import SPLITS, Box, rank_coords, split

#: Boxes of one cell beyond which the cell is compared in several tasks.
HOT = 1024
#: Ranks beyond which boxes are no list on the driver.
MANY = 512
AXES = ("x", "y", "z")


def split_columns(n: Column, parts: int, r: Column) -> tuple[Column, Column]:
    """(start, count) of part ``r``; what doesn't divide goes to the last parts."""
    q, m = F.floor(n / parts), n % parts
    late = F.greatest(r - (parts - m), F.lit(0))
    return (r * q + late).cast("int"), (q + F.when(r >= parts - m, 1).otherwise(0)).cast("int")


def pencil_table(dims: DataFrame, grid: Sequence[int], layout: Layout) -> DataFrame:
    """Every rank's box in a pencil layout, for each row of ``dims`` (its
    columns are the sizes, x first)."""
    n, axes = len(grid), SPLITS[len(grid)][layout]
    ranks = int(np.prod(grid))
    out = dims.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    below = [int(np.prod(grid[k + 1 :])) for k in range(n)]
    parts = [split_columns(F.col(dims.columns[a]), grid[k], F.floor(F.col("rank") / below[k]) % grid[k]) for a, k in enumerate(axes)]
    counts = F.array(*[c for _, c in parts])
    size = F.aggregate(counts, F.lit(1).cast("long"), lambda a, c: a * c)
    return out.select("rank", F.lit(int(layout)).alias("layout"), F.array(*[s for s, _ in parts]).alias("starts"), counts.alias("counts"), size.alias("size"))


def sizes_of(layout: DataFrame) -> tuple[int, ...]:
    """Global sizes: the furthest end on each axis."""
    ends = layout.select(F.posexplode(F.zip_with("starts", "counts", lambda s, c: s + c)).alias("a", "end"))
    return tuple(r["n"] for r in ends.groupBy("a").agg(F.max("end").alias("n")).orderBy("a").collect())  # a row an axis


def malformed(layout: DataFrame) -> DataFrame:
    """(rank, code) of boxes that are none, the first fault of each."""
    size = F.size("starts")
    code = (
        F.when(F.col("starts").isNull() | F.col("counts").isNull(), int(ErrorCode.PENCIL_NOT_INITIALIZED))
        .when(size != F.size("counts"), int(ErrorCode.PENCIL_ARRAYS_SIZE_MISMATCH))
        .when(~size.isin(2, 3), int(ErrorCode.PENCIL_ARRAYS_INVALID_SIZES))
        .when(F.exists("starts", lambda s: s.isNull() | (s < 0)), int(ErrorCode.PENCIL_INVALID_STARTS))
        .when(F.exists("counts", lambda c: c.isNull() | (c < 0)), int(ErrorCode.PENCIL_INVALID_COUNTS))
    )
    return layout.select("rank", code.alias("code")).where("code IS NOT NULL")


def mismatches(layout: DataFrame) -> DataFrame:
    """(axis_a, axis_b, start_a, start_b, boxes): places where boxes start
    alike in two axes but don't have the same extent there."""
    n = F.size("starts")
    literal = lambda *pairs: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    pairs = F.when(n == 2, literal((0, 1))).when(n == 3, literal((0, 1), (0, 2), (1, 2)))
    at = layout.where("size > 0").select(F.explode(pairs).alias("p"), "starts", "counts")
    of = lambda w, k: F.get(w, F.col(f"p.{k}"))
    at = at.select(F.col("p.a").alias("axis_a"), F.col("p.b").alias("axis_b"), of("starts", "a").alias("start_a"), of("starts", "b").alias("start_b"), of("counts", "a").alias("x"), of("counts", "b").alias("y"))
    # numbers, as a smallest struct would need every row sorted
    met = at.groupBy("axis_a", "axis_b", "start_a", "start_b").agg(*[f(c).alias(f"{w}_{c}") for c in "xy" for w, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("boxes"))
    return met.where("lo_x <> hi_x OR lo_y <> hi_y").select("axis_a", "axis_b", "start_a", "start_b", "boxes")


def _level(count: Column) -> Column:
    """The power of two that an extent fits into."""
    return F.when(count <= 1, 0).otherwise(F.length(F.bin(count - 1)))


def _shifted(kind: Column, a: int) -> Column:
    """How many bits the cells of a kind (five bits an axis) have on axis ``a``."""
    return F.shiftright(kind, 5 * a).bitwiseAND(F.lit(31)) + 1


def overlaps(layout: DataFrame, hot: int = HOT) -> DataFrame:
    """(rank_a, rank_b) of boxes that share a point, each pair once.

    A box's class says, axis by axis, what power of two it fits into. Two boxes
    are compared on cells twice as large as the larger of their classes, where
    each lies in at most two cells an axis (2.6 in all for boxes of 5 x 7 x 3);
    so a box is only sent to the cells of the few sizes that its class can
    meet, as a row of plain numbers, and both sides of the comparison read one
    shuffle. Boxes that don't overlap leave little room for others of their
    class in a cell, so cells hold few boxes unless the layout is wrong; where
    some hold more than ``hot``, cells are cut up.
    """
    full = layout.where("size > 0")
    classes = sorted({tuple(r.levels) for r in full.select(F.transform("counts", _level).alias("levels")).distinct().collect()})  # at most 32 sizes an axis
    if not classes:
        return layout.limit(0).select(F.col("rank").alias("rank_a"), F.col("rank").alias("rank_b"))
    n = len(classes[0])
    kind_of = lambda levels: sum(k << 5 * a for a, k in enumerate(levels))
    starts, counts = [f"s{a}" for a in range(n)], [f"n{a}" for a in range(n)]
    box = ["rank", *starts, *counts]
    flat = full.select("rank", *[F.get(w, F.lit(a)).cast("long").alias(f"{k}{a}") for w, k in (("starts", "s"), ("counts", "n")) for a in range(n)])
    own = sum((F.shiftleft(_level(F.col(c)), 5 * a) for a, c in enumerate(counts)), F.lit(0))
    at = None
    for a in classes:
        targets = F.array(*[F.lit(k) for k in sorted({kind_of(map(max, a, b)) for b in classes})])
        at = F.when(F.col("own") == kind_of(a), targets) if at is None else at.when(F.col("own") == kind_of(a), targets)
    sent = flat.withColumn("own", own).select(*box, F.explode(at).alias("kind"))
    cell = lambda place, a: F.call_function("shiftright", place, _shifted(F.col("kind"), a))
    for a in range(n):
        sent = sent.withColumn(f"c{a}", F.explode(F.sequence(cell(F.col(f"s{a}"), a), cell(F.col(f"s{a}") + F.col(f"n{a}") - 1, a))))
    key = ["kind", *[f"c{a}" for a in range(n)]]
    crowds = sent.groupBy(*key).agg(F.count("*").alias("boxes")).where(F.col("boxes") > hot)
    side = lambda w: [F.col(c).alias(f"{c}_{w}") for c in box]
    if crowds.isEmpty():
        dealt = sent.select(*key, *box).repartition(*key)
        met = dealt.select(*key, *side("a")).join(dealt.select(*key, *side("b")), key)
    else:
        salted = sent.join(crowds, key, "left").withColumn("salts", F.coalesce(F.ceil(F.col("boxes") / hot), F.lit(1)).cast("int"))
        left = salted.select(*key, F.pmod(F.xxhash64("rank"), F.col("salts")).cast("int").alias("salt"), *side("a"))
        right = salted.select(*key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *side("b"))
        met = left.join(right, [*key, "salt"])
    meets = F.col("rank_a") < F.col("rank_b")
    for a in range(n):
        s, t, m, k = (F.col(f"{c}{a}_{w}") for c in "sn" for w in "ab")
        meets = meets & (s < t + k) & (t < s + m)
    for a in range(n):
        s, t, m, k = (F.col(f"{c}{a}_{w}") for c in "sn" for w in "ab")
        # on the cells of the pair's own size, in that of the overlap's first point, so that a pair is met once
        size, most = F.call_function("shiftleft", F.lit(1).cast("long"), _shifted(F.col("kind"), a)), F.greatest(m, k)
        meets = meets & (2 * most <= size) & (4 * most > size) & (cell(F.greatest(s, t), a) == F.col(f"c{a}"))
    return met.where(meets).select("rank_a", "rank_b")


def uncovered(layout: DataFrame) -> DataFrame:
    """One row: volume of the boxes and of the grid they span (equal for a
    layout without overlaps that leaves no hole)."""
    n = F.size("starts")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.struct(a.alias("a"), (F.get("starts", a) + F.get("counts", a)).alias("end")))
    whole = layout.select(F.explode(ends).alias("e")).groupBy("e.a").agg(F.max("e.end").cast("long").alias("n")).agg(F.collect_list("n").alias("all"))  # three numbers
    return layout.agg(F.sum(F.col("size").cast("long")).alias("volume")).crossJoin(whole.select(F.aggregate("all", F.lit(1).cast("long"), lambda a, x: a * x).alias("whole")))


def checked(layout: DataFrame) -> tuple[int, ...]:
    """Global sizes of a layout table that tiles a grid; the first error of one
    that doesn't, in the order in which plans check boxes."""
    bad = malformed(layout).agg(F.min_by("code", F.struct(F.when(F.col("code") == int(ErrorCode.PENCIL_NOT_INITIALIZED), 0).otherwise(1), "code")).alias("code")).first()
    if bad is not None and bad.code is not None:
        raise GridError(ErrorCode(bad.code))
    for found, code in ((mismatches, ErrorCode.PENCIL_SHAPE_MISMATCH), (overlaps, ErrorCode.PENCIL_OVERLAP)):
        first = found(layout).first()
        if first is not None:
            raise GridError(code, str(first.asDict()))
    sums = uncovered(layout).first()
    if sums.volume != sums.whole:
        raise GridError(ErrorCode.PENCIL_NOT_CONTINUOUS, f"{sums.volume} of {sums.whole} points")
    return sizes_of(layout)


def boxes_of(layout: DataFrame) -> list[Box]:
    """Boxes in the order of ranks, which run from 0 without gaps."""
    rows = sorted((r.rank, tuple(r.starts), tuple(r.counts)) for r in layout.select("rank", "starts", "counts").collect())  # a row a rank
    if [r for r, _, _ in rows] != list(range(len(rows))):
        raise GridError(ErrorCode.PENCIL_NOT_INITIALIZED, "ranks run from 0 without gaps")
    return [Box(s, c) for _, s, c in rows]


def _extents(n: int, wanted: str = "sn") -> list[str]:
    """Columns of a box: its starts ``s0 ...`` and counts ``n0 ...``."""
    return [f"{w}{a}" for w in wanted for a in range(n)]


class Pencils(Sequence):
    """A pencil layout of any number of ranks; a box is made when asked for."""

    def __init__(self, dims: Sequence[int], grid: Sequence[int], layout: Layout):
        self.dims, self.grid, self.axes = tuple(dims), tuple(grid), SPLITS[len(dims)][layout]

    def __len__(self) -> int:
        return int(np.prod(self.grid, dtype=object))

    def __getitem__(self, rank: int) -> Box:
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        c = rank_coords(rank, self.grid)
        parts = [split(n, self.grid[k], c[k]) for n, k in zip(self.dims, self.axes, strict=True)]
        return Box(tuple(s for s, _ in parts), tuple(n for _, n in parts))

    def splits(self, axis: int) -> bool:
        return min(self.grid[self.axes[axis]], self.dims[axis]) > 1

    def _below(self, k: int) -> int:
        return int(np.prod(self.grid[k + 1 :], dtype=object))

    def owner(self) -> Column:
        """The rank at the point of the columns ``x, y[, z]``."""
        rank = F.lit(0)
        for a, k in enumerate(self.axes):
            q, m = divmod(self.dims[a], self.grid[k])
            at, first = F.col(AXES[a]), (self.grid[k] - m) * q  # points of the parts of q
            late = self.grid[k] - m + F.call_function("div", at - first, F.lit(q + 1))
            rank = rank + (F.when(at < first, F.call_function("div", at, F.lit(q))).otherwise(late) if q else late) * self._below(k)
        return rank.cast("int")

    def with_rank(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", self.owner())

    def with_extents(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a ``rank`` and their rank's ``s0 ...`` and ``n0 ...``."""
        parts = [split_columns(F.lit(self.dims[a]), self.grid[k], F.floor(F.col("rank") / self._below(k)) % self.grid[k]) for a, k in enumerate(self.axes)]
        return rows.select("*", *[c.alias(f"{w}{a}") for j, w in enumerate("sn") for a, c in enumerate(p[j] for p in parts)])


class TableBoxes(Sequence):
    """Boxes of very many ranks, left in their (checked) table; points find
    theirs by a join. Asking for single boxes fetches them all."""

    def __init__(self, table: DataFrame, dims: Sequence[int]):
        self.table, self.dims, n = table, tuple(dims), len(dims)
        self.flat = table.select("rank", "size", *[F.get(w, F.lit(a)).alias(f"{k}{a}") for w, k in (("starts", "s"), ("counts", "n")) for a in range(n)])
        ranks = table.agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("all")).first()
        if (ranks["low"], ranks["high"], ranks["all"]) != (0, ranks["n"] - 1, ranks["n"]):
            raise GridError(ErrorCode.PENCIL_NOT_INITIALIZED, "ranks run from 0 without gaps")
        self._count, self._boxes = ranks["n"], None

    def __len__(self) -> int:
        return self._count

    def __getitem__(self, rank: int) -> Box:
        if self._boxes is None:
            self._boxes = boxes_of(self.table)
        return self._boxes[rank]

    def starts(self, axis: int) -> list[int]:
        """The distinct starts on an axis, at most its size."""
        return sorted(r[0] for r in self.flat.where("size > 0").select(f"s{axis}").distinct().collect())

    def splits(self, axis: int) -> bool:
        return self.flat.where("size > 0").select(f"s{axis}").distinct().limit(2).count() > 1

    def is_product(self) -> bool:
        """Whether the boxes are all combinations of one set of cuts an axis."""
        full, cuts = self.flat.where("size > 0"), 1
        for a in range(len(self.dims)):
            cuts *= full.select(f"s{a}", f"n{a}").distinct().count()
        return cuts == len(self) == full.count()

    def with_rank(self, rows: DataFrame, extents: bool = False) -> DataFrame:
        """``rows`` (with ``x, y[, z]``) with the rank of the box that holds the
        point, and its starts and counts if asked for. Boxes lie in the cells
        of their class (at most two an axis), a point in one cell a class."""
        n, kept = len(self.dims), [c for c in rows.columns if c != "rank"]
        full = self.flat.where("size > 0").drop("size").withColumn("kind", sum((F.shiftleft(_level(F.col(f"n{a}")), 5 * a) for a in range(n)), F.lit(0)))
        kinds = sorted(r[0] for r in full.select("kind").distinct().collect())  # at most 32 sizes an axis
        cell = lambda place, a: F.call_function("shiftright", place, _shifted(F.col("kind"), a))
        inside = F.lit(True)
        for a in range(n):
            full = full.withColumn(f"c{a}", F.explode(F.sequence(cell(F.col(f"s{a}"), a), cell(F.col(f"s{a}") + F.col(f"n{a}") - 1, a))))
            inside = inside & F.col(AXES[a]).between(0, self.dims[a] - 1)
        key = ["kind", *[f"c{a}" for a in range(n)]]
        outside = F.raise_error(F.lit(f"{ErrorCode.INVALID_LAYOUT.name}: a point outside the grid")).cast("array<int>")
        near = rows.select(*kept, F.explode(F.when(inside, F.array(*[F.lit(k) for k in kinds])).otherwise(outside)).alias("kind"))
        near = near.select("*", *[cell(F.col(AXES[a]), a).alias(f"c{a}") for a in range(n)])
        met = near.join(full, key)
        for a in range(n):
            met = met.where((F.col(AXES[a]) >= F.col(f"s{a}")) & (F.col(AXES[a]) - F.col(f"s{a}") < F.col(f"n{a}")))
        return met.select("rank", *kept, *(_extents(n) if extents else []))

    def with_extents(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a ``rank`` and their rank's ``s0 ...`` and ``n0 ...``."""
        return rows.join(self.flat.drop("size"), "rank")


class CutTree:
    """Rank of a point in any layout of boxes, by cuts at planes.

    Inner nodes have an axis and a place, leaves a rank; a few numbers a node,
    sent along as constant arrays. A box that a cut goes through is on both
    sides, which guillotine layouts never need.
    """

    def __init__(self, boxes: Sequence[Box]):
        low = np.array([b.starts for b in boxes], np.int64)
        high = low + np.array([b.counts for b in boxes], np.int64)
        self.axis, self.place, self.below, self.depth = [], [], [], 0
        stack = [(np.flatnonzero((high > low).all(axis=1)), -1, 1)]
        while stack:
            ranks, parent, depth = stack.pop()
            me = len(self.axis)
            if parent >= 0:
                self.below[parent] = me  # the upper side, made last
            self.depth = max(self.depth, depth)
            self.axis.append(-1)
            self.place.append(int(ranks[0]) if len(ranks) else -1)
            self.below.append(-1)
            if len(ranks) < 2:
                continue
            axis, place = self._cut(low[ranks], high[ranks])
            self.axis[me], self.place[me] = axis, place
            stack.append((ranks[high[ranks, axis] > place], me, depth + 1))
            stack.append((ranks[low[ranks, axis] < place], -1, depth + 1))  # next, so it follows its parent

    @staticmethod
    def _cut(low: np.ndarray, high: np.ndarray) -> tuple[int, int]:
        """The cut that goes through fewest boxes, of those the most even one."""
        best = None
        for a in range(low.shape[1]):
            s, e = np.sort(low[:, a]), np.sort(high[:, a])
            places = np.unique(s)[1:]
            under, over = np.searchsorted(s, places), len(e) - np.searchsorted(e, places, "right")
            if len(places):
                through = under + over - len(s)
                k = np.lexsort((np.abs(under - over), through))[0]
                found = (int(through[k]), int(abs(under[k] - over[k])), a, int(places[k]))
                best = min(best, found) if best else found
        if best is None:
            raise GridError(ErrorCode.PENCIL_OVERLAP, "boxes that share a start are not apart")
        return best[2], best[3]

    def rank(self, axes: Sequence[str]) -> Column:
        """The rank at the point of the columns ``axes``."""
        array = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<int>")
        axis, place, upper = array(self.axis), array(self.place), array(self.below)

        def down(point: Column) -> Column:
            step = lambda node, _: F.when(F.get(axis, node) < 0, node).when(F.get(point, F.get(axis, node)) < F.get(place, node), node + 1).otherwise(F.get(upper, node))
            return F.get(place, F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step))

        return let(F.array(*[F.col(a).cast("int") for a in axes]), down)
