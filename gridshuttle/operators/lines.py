"""Grids as rows of whole lines or planes, moved without leaving the JVM.

A row holds ``rank``, the coordinates ``x, y[, z]`` of its first point and its
values as arrays (``v``, or ``re`` and ``im``) along the *inner* axes, fastest
first; the other axes are its keys. ``regroup`` exchanges: rows are cut into
runs, runs that will share rows meet in one shuffle, and each meeting is
turned like a matrix into the new rows. Points are never rows in between.

The rank is worked out from a row's coordinates, so it says where the row
belongs; how rows lie in partitions is up to Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..enums import Layout
from ..errors import ErrorCode, GridError
from ..functions.array_fft import let
from ..plans.decomposition import Box, order_of
from ..plans.layouts import Pencils, TableBoxes
from ..ship import ship
from .exchange import AXES, BOXES, _arrow, _kinds, owner_column, to_memory

#: Values that meet in one group at most, unless a single run is longer; the
#: groups wanted at least; the shortest run worth a row.
MEETING, GROUPS, SHORTEST = 1 << 20, 64, 16


def is_lines(held: DataFrame) -> bool:
    return "data" not in held.columns


def values_of(df: DataFrame) -> list[str]:
    return [c for c in ("v", "re", "im") if c in df.columns]


def inner_of(layout: Layout, n: int) -> tuple[int, ...]:
    """The axis along which a layout keeps its lines."""
    return order_of(layout, n)[:1]


def _place(axes: Sequence[int], dims: Sequence[int]) -> Column:
    """Index of a point in the flattened ``axes``, fastest first."""
    out, stride = F.lit(0), 1
    for a in axes:
        out, stride = out + F.col(AXES[a]) * stride, stride * dims[a]
    return out.cast("int")


def _coordinates(index: Column, axes: Sequence[int], dims: Sequence[int]) -> dict[int, Column]:
    """The point of a flattened index."""
    out, stride = {}, 1
    for a in axes:
        at = F.call_function("div", index, F.lit(stride)) if stride > 1 else index
        out[a] = (at % dims[a]).cast("int") if a != axes[-1] else at.cast("int")
        stride *= dims[a]
    return out


def _value(name: str, i: Column) -> Callable[[Column], Column]:
    return lambda p: F.get(p[name], i)


def _error(text: str) -> Column:
    return F.raise_error(F.lit(f"{ErrorCode.PENCIL_NOT_CONTINUOUS.name}: {text}"))


def with_rank(rows: DataFrame, boxes: Sequence[Box]) -> DataFrame:
    if isinstance(boxes, TableBoxes):
        return boxes.with_rank(rows.select(*AXES[: len(boxes.dims)], *values_of(rows)))
    n = len(boxes[0].starts)
    return rows.select(owner_column(boxes).alias("rank"), *AXES[:n], *values_of(rows))


def _is_cut(boxes: Sequence[Box], axis: int) -> bool:
    """Whether boxes start at different places of an axis."""
    if isinstance(boxes, (Pencils, TableBoxes)):
        return boxes.splits(axis)
    return len({b.starts[axis] for b in boxes if b.size}) > 1


def from_points(points: DataFrame, dims: Sequence[int], inner: Sequence[int], boxes: Sequence[Box], kind: str = "double") -> DataFrame:
    """Points to rows. A missing, repeated or outside point in a row is an error."""
    n, values = len(dims), values_of(points)
    keys = [a for a in range(n) if a not in inner]
    cut, in_table = all(_is_cut(boxes, a) for a in inner), isinstance(boxes, TableBoxes)  # bricks: a row stays within its rank
    given = points.select(*[F.col(AXES[a]).cast("int").alias(AXES[a]) for a in range(n)], *[F.col(v).cast(kind).alias(v) for v in values])
    if cut and in_table:
        given = boxes.with_rank(given, extents=True)
    elif cut:
        given = given.withColumn("rank", owner_column(boxes))
    by = [*(["rank"] if cut else []), *[AXES[a] for a in keys], *([f"n{a}" for a in inner] if cut and in_table else [])]
    grouped = given.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(_place(inner, dims).alias("at"), *values))).alias("all"))
    first = F.get("all", F.lit(0))["at"]
    size = prod((F.col(f"n{a}") for a in inner), start=F.lit(1)) if cut and in_table else _size_of_box(boxes, inner) if cut else F.lit(prod(dims[a] for a in inner))
    whole = (F.size("all") == size) & F.forall(F.transform("all", lambda p, i: p["at"] - i), lambda d: d == first)
    if not cut:
        whole = whole & (first == 0)
    for a in keys:
        whole = whole & F.col(AXES[a]).between(0, dims[a] - 1)
    checked = grouped.withColumn("all", F.when(whole, F.col("all")).otherwise(_error("a row has other points than its places")))
    start = _coordinates(first, inner, dims)
    held = ["rank"] if cut and in_table else []
    rows = checked.select(*held, *[(start[a] if a in start else F.col(AXES[a])).alias(AXES[a]) for a in range(n)], *[F.col(f"all.{v}").alias(v) for v in values])
    return rows if held else with_rank(rows, boxes)


def _of_rank(values: Sequence[int]) -> Column:
    """The row's rank's number of a constant array."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), F.col("rank"))


def _size_of_box(boxes: Sequence[Box], inner: Sequence[int]) -> Column:
    return _of_rank([prod(b.counts[a] for a in inner) for b in boxes])


def to_points(rows: DataFrame, dims: Sequence[int], inner: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Rows to points."""
    n, values = len(dims), values_of(rows)
    flat = rows.withColumn("first", _place(inner, dims)).select(*keep, *[AXES[a] for a in range(n) if a not in inner], "first", F.posexplode(F.arrays_zip(*values)).alias("pos", "p"))
    at = _coordinates(F.col("first") + F.col("pos"), inner, dims)
    return flat.select(*keep, *[(at[a] if a in at else F.col(AXES[a])).alias(AXES[a]) for a in range(n)], *[F.col(f"p.{v}").alias(v) for v in values])


def placement(rows: DataFrame, dims: Sequence[int], inner: Sequence[int], boxes: Sequence[Box], layout: Layout) -> DataFrame:
    """Points with the rank that holds them and their place in its memory."""
    n, kept = len(dims), isinstance(boxes, (Pencils, TableBoxes))
    extents = [f"{w}{a}" for w in "sn" for a in range(n)] if kept else []
    points = to_points(boxes.with_extents(rows) if kept else rows, dims, inner, ["rank", *extents])
    offset, stride = F.lit(0).cast("long"), F.lit(1).cast("long")
    for a in order_of(layout, n):
        starts, counts = (F.col(f"s{a}"), F.col(f"n{a}")) if kept else (_of_rank([getattr(b, w)[a] for b in boxes]) for w in ("starts", "counts"))
        offset, stride = offset + (F.col(AXES[a]) - starts) * stride, stride * counts
    return points.select("rank", offset.alias("local_offset"), *AXES[:n], *values_of(points))


def run_length(dims: Sequence[int], source: Sequence[int], target: Sequence[int]) -> int:
    """How long the runs are into which ``regroup`` cuts a row."""
    size = lambda axes: prod(dims[a] for a in axes)
    row, column = size(source), size(target)
    others = prod(dims) // (row * column)
    return min(row, max(SHORTEST, min(MEETING // column, -(-row * others // GROUPS))))


def regroup(rows: DataFrame, dims: Sequence[int], source: Sequence[int], target: Sequence[int], boxes: Sequence[Box]) -> DataFrame:
    """Rows along the axes ``source`` to rows along ``target`` in one shuffle."""
    n, values = len(dims), values_of(rows)
    size = lambda axes: prod(dims[a] for a in axes)
    row, column, run = size(source), size(target), run_length(dims, source, target)
    shared = [a for a in range(n) if a not in source and a not in target]
    place = _place(target, dims).alias("place")
    if run < row:
        pieces = F.transform(F.sequence(F.lit(0), F.lit(row - 1), F.lit(run)), lambda at: F.struct(at.alias("at"), *[F.slice(v, at + 1, F.lit(run)).alias(v) for v in values]))
        cut = rows.select(*[AXES[a] for a in shared], place, F.explode(pieces).alias("p")).select(*[AXES[a] for a in shared], "place", "p.*")
    else:
        cut = rows.select(*[AXES[a] for a in shared], place, F.lit(0).alias("at"), *values)
    met = cut.groupBy(*[AXES[a] for a in shared], "at").agg(F.sort_array(F.collect_list(F.struct("place", *values))).alias("all"))
    whole = (F.size("all") == column) & (F.get("all", F.lit(0))["place"] == 0) & (F.get("all", F.lit(column - 1))["place"] == column - 1)
    met = met.withColumn("all", F.when(whole, F.col("all")).otherwise(_error(f"a meeting lacks some of its {column} rows or has some twice")))
    turned = let(F.col("all"), lambda all_: F.transform(F.sequence(F.lit(0), F.size(F.get(all_, F.lit(0))[values[0]]) - 1), lambda i: F.struct(*[F.transform(all_, _value(v, i)).alias(v) for v in values])))
    out = met.select(*[AXES[a] for a in shared], "at", F.posexplode(turned).alias("pos", "p"))
    at = _coordinates(F.col("at") + F.col("pos"), source, dims)
    out = out.select(*[(at[a] if a in at else F.lit(0) if a in target else F.col(AXES[a])).alias(AXES[a]) for a in range(n)], *[F.col(f"p.{v}").alias(v) for v in values])
    return with_rank(out, boxes)


def joined(rows: DataFrame, dims: Sequence[int], inner: Sequence[int], boxes: Sequence[Box]) -> DataFrame:
    """Parts of lines (bricks) to whole rows along ``inner``, in one shuffle."""
    n, values = len(dims), values_of(rows)
    keys = [AXES[a] for a in range(n) if a not in inner]
    met = rows.withColumn("at", _place(inner, dims)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", *values))).alias("all"))
    out = met.select(*keys, *[F.lit(0).alias(AXES[a]) for a in inner], *[F.flatten(F.col(f"all.{v}")).alias(v) for v in values])
    size = prod(dims[a] for a in inner)
    out = out.select(*AXES[:n], *[F.when(F.size(v) == size, F.col(v)).otherwise(_error("parts don't fill their row")).alias(v) for v in values])
    return with_rank(out, boxes)


def parted(rows: DataFrame, dims: Sequence[int], inner: Sequence[int], axis: int, boxes: Sequence[Box]) -> DataFrame:
    """Whole rows along ``inner`` to the parts of lines along ``axis`` that
    ``boxes`` cut; nothing is shuffled, as only the rank changes."""
    n, values = len(dims), values_of(rows)
    if inner != (axis,):  # planes: their lines first
        width = dims[axis]
        if inner[0] != axis:
            raise GridError(ErrorCode.INVALID_LAYOUT, "lines of a plane lie along its first axis")
        lines = F.transform(F.sequence(F.lit(0), F.lit(prod(dims[a] for a in inner) - 1), F.lit(width)), lambda at: F.struct(at.alias("at"), *[F.slice(v, at + 1, F.lit(width)).alias(v) for v in values]))
        flat = rows.select(*[AXES[a] for a in range(n) if a not in inner], F.explode(lines).alias("p"))
        at = _coordinates(F.col("p.at"), inner, dims)
        rows = flat.select(*[(at[a] if a in at else F.col(AXES[a])).alias(AXES[a]) for a in range(n)], *[F.col(f"p.{v}").alias(v) for v in values])
    cuts = boxes.starts(axis) if isinstance(boxes, TableBoxes) else sorted({b.starts[axis] for b in boxes if b.size})
    ends = [*cuts[1:], dims[axis]]
    parts = F.array(*[F.struct(F.lit(s).alias("at"), *[F.slice(v, s + 1, e - s).alias(v) for v in values]) for s, e in zip(cuts, ends, strict=True)])
    out = rows.select(*[AXES[a] for a in range(n) if a != axis], F.explode(parts).alias("p")).select(*[(F.col("p.at") if a == axis else F.col(AXES[a])).alias(AXES[a]) for a in range(n)], *[F.col(f"p.{v}").alias(v) for v in values])
    return with_rank(out, boxes)


def worked(rows: DataFrame, dims: Sequence[int], inner: Sequence[int], work: Callable[[np.ndarray, int], np.ndarray], dtype_in: np.dtype, dtype_out: np.dtype) -> DataFrame:
    """``work`` on batches of rows, given as arrays indexed [z, y, x]."""
    ship(rows.sparkSession)
    n, dtype_in, dtype_out = len(dims), np.dtype(dtype_in), np.dtype(dtype_out)
    values, made = values_of(rows), ["re", "im"] if dtype_out.kind == "c" else ["v"]
    kind = T.DoubleType() if dtype_out.itemsize // len(made) == 8 else T.FloatType()
    schema = T.StructType([f for f in rows.schema if f.name not in values] + [T.StructField(v, T.ArrayType(kind)) for v in made])
    others = [a for a in range(n) if a not in inner]
    labels = [others[0], *reversed(inner), *others[1:]]  # what each axis of a batch is: rows, inner slowest first, single ones
    to_grid = [labels.index(a) for a in reversed(range(n))]
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [batch.column(k) for k, c in enumerate(names) if c not in values]
            for at in range(0, batch.num_rows, 1024):
                m = min(1024, batch.num_rows - at)
                part = [np.asarray(batch.column(names.index(v)).slice(at, m).flatten()) for v in values]
                a = (part[0] + 1j * part[1] if len(values) == 2 else part[0]).astype(dtype_in, copy=False)
                a = a.reshape(m, *[dims[x] for x in reversed(inner)], *[1] * (len(others) - 1)).transpose(to_grid)
                out = work(a, 0).transpose(np.argsort(to_grid)).reshape(m, -1)
                sizes = pa.array(np.arange(m + 1, dtype=np.int32) * out.shape[1])
                flat = [np.ascontiguousarray(w).ravel() for w in ((out.real, out.imag) if len(made) == 2 else (out,))]
                lists = [pa.ListArray.from_arrays(sizes, pa.array(f)) for f in flat]
                yield pa.RecordBatch.from_arrays([*[k.slice(at, m) for k in keep], *lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def of_boxes(held: DataFrame, n: int, inner: Sequence[int], dtype: np.dtype) -> DataFrame:
    """Boxes to rows, where they lie."""
    ship(held.sparkSession)
    dtype, axis = np.dtype(dtype), inner[0]
    values = ["re", "im"] if dtype.kind == "c" else ["v"]
    kind = T.DoubleType() if dtype.itemsize // len(values) == 8 else T.FloatType()
    schema = T.StructType([T.StructField("rank", T.IntegerType()), *[T.StructField(a, T.IntegerType()) for a in AXES[:n]], *[T.StructField(v, T.ArrayType(kind)) for v in values]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                order = order_of(Layout(row["layout"]), n)
                shape = tuple(row["counts"][a] for a in reversed(order))
                a = np.frombuffer(row["data"], dtype).reshape(-1, row["counts"][axis])  # the inner axis is the fastest
                at = dict(zip(reversed(order[1:]), np.unravel_index(np.arange(len(a)), shape[:-1]), strict=True))
                for k in range(0, len(a), 1024):
                    part = a[k : k + 1024]
                    m = len(part)
                    where = [pa.array(((at[x][k : k + m] if x in at else 0) + np.full(m, row["starts"][x])).astype(np.int32)) for x in range(n)]
                    sizes = pa.array(np.arange(m + 1, dtype=np.int32) * part.shape[1])
                    lists = [pa.ListArray.from_arrays(sizes, pa.array(np.ascontiguousarray(w).ravel())) for w in ((part.real, part.imag) if len(values) == 2 else (part,))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, row["rank"], np.int32)), *where, *lists], names=schema.names)

    return held.mapInArrow(run, schema)


def to_boxes(rows: DataFrame, dims: Sequence[int], inner: Sequence[int], boxes: Sequence[Box], layout: Layout, dtype: np.dtype, work: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """Rows to boxes, each put together in its rank's task."""
    ship(rows.sparkSession)
    n, dtype, values = len(dims), np.dtype(dtype), values_of(rows)
    order, names = order_of(layout, n), ["rank", *AXES[: len(dims)], *values_of(rows)]

    def build(batches):
        held: dict[int, list] = {}
        for batch in batches:
            c = [batch.column(k) for k in range(batch.num_columns)]
            rank, start = c[0].to_numpy(zero_copy_only=False), [c[1 + a].to_numpy(zero_copy_only=False) for a in range(n)]
            arrays = [c[names.index(v)] for v in values]
            for k in range(batch.num_rows):
                r = int(rank[k])
                b = boxes[r]
                if r not in held:
                    held[r] = [np.zeros(tuple(reversed(b.counts)), dtype), 0]
                part = [np.asarray(a[k].values) for a in arrays]
                line = part[0] + 1j * part[1] if len(part) == 2 else part[0]
                at = tuple(slice(int(start[a][k]) - b.starts[a], int(start[a][k]) - b.starts[a] + len(line)) if a == inner[0] else int(start[a][k]) - b.starts[a] for a in reversed(range(n)))
                held[r][0][at] = line
                held[r][1] += len(line)
        for r in sorted(held):
            a, count = held.pop(r)
            if count != a.size:
                raise GridError(ErrorCode.PENCIL_NOT_CONTINUOUS, f"rank {r} has {count} points for {a.size} places")
            out = work(a, r) if work else a
            yield _arrow([(r, int(layout), list(boxes[r].starts), list(reversed(out.shape)), to_memory(out, order).tobytes())], ("rank", "layout", "starts", "counts", "data"), _kinds(False))

    return rows.select(*names).repartitionById(len(boxes), F.col("rank")).mapInArrow(build, BOXES)
