"""Moving a grid between layouts.

Points ``(x, y[, z], values)`` become *boxes*, a row a rank: ``rank, layout,
starts, counts, data`` with the values in the layout's memory order. A box is
as large as the grid divided by the ranks, so ranks are chosen for boxes that
fit a task. Each box is cut into the pieces its new owners need (packed bytes,
optionally compressed), the pieces go to their owner's partition, and are put
in place as they arrive; one shuffle of as many rows as there are overlapping
pairs of boxes. A box is permuted whole before it is cut, or (fused) piece by
piece, which needs no second copy of it. The exchange without packing works
on rows of lines (``lines``).

Whatever runs on a box before or after (a transform) joins the same task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CompressionConfig
from ..enums import AccessMode, Layout, TransposeMode
from ..errors import ErrorCode, GridError
from ..functions import compression as codec
from ..functions import kernels
from ..plans.decomposition import Box, order_of
from ..plans.layouts import CutTree, Pencils
from ..ship import ship

AXES = ("x", "y", "z")
BOXES = "rank int, layout int, starts array<int>, counts array<int>, data binary"
PIECES = "dest int, starts array<int>, counts array<int>, data binary, raw long, sent long"
CHUNK = 65536
Work = Callable[[np.ndarray, int], np.ndarray]


def _arrow(rows: list[tuple], names: Sequence[str], kinds: Sequence):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _kinds(pieces: bool):
    import pyarrow as pa

    ints = pa.list_(pa.int32())
    return [pa.int32(), ints, ints, pa.binary()] if pieces else [pa.int32(), pa.int32(), ints, ints, pa.binary()]


def _memory(order: Sequence[int]) -> tuple[int, ...]:
    """Axes of an array in memory order (slowest first), as positions in [.., y, x]."""
    n = len(order)
    return tuple(n - 1 - a for a in reversed(order))


#: The kernel that brings [z, y, x] into each memory order (of the same number of axes as the array).
KERNELS = {(0, 1, 2): np.ascontiguousarray, (1, 2, 0): kernels.permute_forward, (2, 0, 1): kernels.permute_backward, (0, 1): np.ascontiguousarray, (1, 0): kernels.permute_forward}


def to_memory(a: np.ndarray, order: Sequence[int], access: AccessMode = AccessMode.READ) -> np.ndarray:
    """[z, y, x] as the layout keeps it: reading with strides, or (``WRITE``)
    reading in order and writing with strides."""
    if access == AccessMode.WRITE and not a.transpose(_memory(order)).flags.c_contiguous:
        return kernels.written(a, _memory(order))
    return KERNELS[tuple(order)](a)


def from_memory(data, counts: Sequence[int], order: Sequence[int], dtype) -> np.ndarray:
    """A layout's values as a [z, y, x] view."""
    shape = tuple(counts[a] for a in reversed(order))
    back = np.argsort(_memory(order))
    return np.frombuffer(data, dtype).reshape(shape).transpose(back)


def owner_column(boxes: Sequence[Box]):
    """Rank of a point: by arithmetic on the distinct cuts of each axis if the
    boxes are their product, else down a tree of cuts."""
    if isinstance(boxes, Pencils):
        return boxes.owner()
    n = len(boxes[0].starts)
    full = [(r, b) for r, b in enumerate(boxes) if b.size]
    cuts = [sorted({b.starts[a] for _, b in full}) for a in range(n)]
    if np.prod([len(c) for c in cuts]) == len(full):  # the boxes are a product of cuts
        index, stride = F.lit(0), 1
        for a in range(n):
            axis = F.col(AXES[a])
            at = sum((F.when(axis >= c, 1).otherwise(0) for c in cuts[a][1:]), F.lit(0)) if len(cuts[a]) <= 16 else F.array_position(F.array(*[F.lit(c) for c in cuts[a]]), F.array_max(F.filter(F.array(*[F.lit(c) for c in cuts[a]]), lambda c: c <= axis))).cast("int") - 1
            index, stride = index + at * stride, stride * len(cuts[a])
        place, nth = {}, [{c: k for k, c in enumerate(axis)} for axis in cuts]
        for r, b in full:
            key, stride = 0, 1
            for a in range(n):
                key, stride = key + nth[a][b.starts[a]] * stride, stride * len(cuts[a])
            place[key] = r
        table = [place[k] for k in range(len(full))]
        return F.get(F.array(*[F.lit(r) for r in table]), index.cast("int")) if table != list(range(len(table))) else index.cast("int")
    return CutTree(boxes).rank(AXES[:n])


def scatter(points: DataFrame, boxes: Sequence[Box], layout: Layout, dtype: np.dtype, work: Work | None = None) -> DataFrame:
    """Points to boxes. A missing, repeated or outside point is an error, not a zero."""
    ship(points.sparkSession)
    dtype, n = np.dtype(dtype), len(boxes[0].starts)
    values = ["re", "im"] if dtype.kind == "c" else ["v"]
    order = order_of(layout, n)
    keyed = points.select(owner_column(boxes).alias("rank"), *[F.col(AXES[a]).cast("int") for a in range(n)], *[F.col(v).cast("double" if dtype.itemsize // len(values) == 8 else "float") for v in values])

    def build(batches):
        held: dict[int, list] = {}
        for batch in batches:
            c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            if batch.column(0).null_count:
                raise GridError(ErrorCode.INVALID_LAYOUT, "a point outside every box")
            ranks = c[0].astype(np.int64)
            order_by = np.argsort(ranks, kind="stable")
            edges = np.flatnonzero(np.diff(ranks[order_by], prepend=-1, append=-1))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                s = order_by[i:j]
                r = int(ranks[s[0]])
                b = boxes[r]
                if r not in held:
                    held[r] = [np.zeros(tuple(reversed(b.counts)), dtype), np.zeros(tuple(reversed(b.counts)), bool), 0]
                at = tuple(c[1 + a][s] - b.starts[a] for a in reversed(range(n)))
                for a, x in zip(reversed(range(n)), at, strict=True):
                    if x.min() < 0 or x.max() >= b.counts[a]:
                        raise GridError(ErrorCode.INVALID_LAYOUT, "a point outside the grid")
                held[r][0][at] = c[1 + n][s] + 1j * c[2 + n][s] if dtype.kind == "c" else c[1 + n][s]
                held[r][1][at] = True
                held[r][2] += len(s)
        for r in sorted(held):
            a, seen, count = held.pop(r)
            if count != a.size or not seen.all():
                raise GridError(ErrorCode.PENCIL_NOT_CONTINUOUS, f"rank {r} has {count} points for {a.size} places")
            out = work(a, r) if work else a
            yield _arrow([(r, int(layout), list(boxes[r].starts), list(reversed(out.shape)), to_memory(out, order).tobytes())], ("rank", "layout", "starts", "counts", "data"), _kinds(False))

    return keyed.repartitionById(len(boxes), F.col("rank")).mapInArrow(build, BOXES)


def gather(held: DataFrame, n: int, dtype: np.dtype, work: Work | None = None, offsets: bool = False) -> DataFrame:
    """Boxes to points; with ``offsets`` also each point's rank and place in memory."""
    ship(held.sparkSession)
    dtype = np.dtype(dtype)
    kind = "double" if dtype.itemsize // (2 if dtype.kind == "c" else 1) == 8 else "float"
    values = [("re", kind), ("im", kind)] if dtype.kind == "c" else [("v", kind)]
    fields = T.StructType()
    if offsets:
        fields = fields.add("rank", "integer").add("local_offset", "long")
    for a in range(n):
        fields = fields.add(AXES[a], "integer")
    for v, k in values:
        fields = fields.add(v, k)

    def spill(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                order = order_of(Layout(row["layout"]), n)
                shape = tuple(row["counts"][a] for a in reversed(order))
                flat = np.frombuffer(row["data"], dtype)
                if work:
                    a = work(from_memory(row["data"], row["counts"], order, dtype), row["rank"])
                    flat, shape = to_memory(a, order).ravel(), to_memory(a, order).shape
                for at in range(0, flat.size, CHUNK):
                    k = np.arange(at, min(at + CHUNK, flat.size))
                    place = dict(zip(reversed(order), np.unravel_index(k, shape), strict=True))
                    cols = [pa.array(np.full(len(k), row["rank"], np.int32)), pa.array(k)] if offsets else []
                    cols += [pa.array((place[a] + row["starts"][a]).astype(np.int32)) for a in range(n)]
                    part = flat[k]
                    cols += [pa.array(np.ascontiguousarray(part.real)), pa.array(np.ascontiguousarray(part.imag))] if dtype.kind == "c" else [pa.array(part)]
                    yield pa.RecordBatch.from_arrays(cols, names=fields.names)

    return held.mapInArrow(spill, fields)


def redistribute(
    held: DataFrame, source: Layout, target: Layout, boxes: Sequence[Box], dtype_in: np.dtype, dtype_out: np.dtype | None = None, before: Work | None = None, after: Work | None = None,
    mode: TransposeMode = TransposeMode.PACK, compression: CompressionConfig | None = None, fused: bool = False, access: AccessMode = AccessMode.READ, observed: Observation | None = None,
) -> DataFrame:
    """Boxes in ``source`` to ``boxes`` in ``target``. ``before`` runs on a box
    ahead of packing (its result is of ``dtype_out``), ``after`` on the new one.
    ``observed`` takes the bytes of each rank's pieces, raw and as sent, on the
    pieces of this exchange itself: once its job has run it holds ``raw``,
    ``sent`` and the ranks' lowest, highest and mean rate."""
    ship(held.sparkSession)
    n = len(boxes[0].starts)
    dtype_out = np.dtype(dtype_out or dtype_in)
    order_in, order_out = order_of(source, n), order_of(target, n)
    starts = np.array([b.starts for b in boxes])
    ends = starts + np.array([b.counts for b in boxes])

    def pack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a = from_memory(row["data"], row["counts"], order_in, dtype_in)
                a = before(a, row["rank"]) if before else a
                lo, hi = np.array(row["starts"]), np.array(row["starts"]) + np.array(list(reversed(a.shape)))
                order = order_out if mode == TransposeMode.PACK else order_in
                whole = None if fused else to_memory(a, order, access)
                needed = np.flatnonzero(((starts < hi) & (ends > lo)).all(axis=1) & (ends > starts).all(axis=1)).tolist()
                raw = sent = 0
                for d in needed:
                    s, e = np.maximum(lo, starts[d]), np.minimum(hi, ends[d])
                    if fused:
                        part = kernels.get_fused(KERNELS[order])(a, s - lo, e - s)
                    else:
                        part = kernels.pack(whole, (s - lo)[list(order)], (e - s)[list(order)])
                    part = part.reshape(tuple((e - s)[list(reversed(order))]))
                    data = codec.compress(part, compression) if compression else part.tobytes()
                    raw, sent = raw + part.nbytes, sent + len(data)
                    told = (raw, sent) if d == needed[-1] else (None, None)  # a rank's sums, once
                    yield _arrow([(int(d), s.tolist(), (e - s).tolist(), data, *told)], ("dest", "starts", "counts", "data", "raw", "sent"), [*_kinds(True), "int64", "int64"])

    def unpack(batches):
        new: dict[int, list] = {}
        order = order_out if mode == TransposeMode.PACK else order_in
        placed = mode == TransposeMode.PACK and not compression
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dest"]
                b = boxes[d]
                if d not in new:  # in memory order where pieces come so
                    new[d] = [np.empty(tuple(b.counts[x] for x in (reversed(order_out) if placed else reversed(range(n)))), dtype_out), 0]
                at = np.array(row["starts"]) - b.starts
                counts = np.array(row["counts"])
                if placed:
                    part = np.frombuffer(row["data"], dtype_out)
                    kernels.unpack(part, new[d][0], at[list(order_out)], counts[list(order_out)])
                else:
                    if compression:  # decoded straight into [z, y, x]
                        part = codec.decompress(row["data"], dtype_out, tuple(counts[list(reversed(order))].tolist()), tuple(np.argsort(_memory(order)).tolist()))
                    else:
                        part = from_memory(row["data"], row["counts"], order, dtype_out)
                    kernels.unpack(part, new[d][0], at, counts)
                new[d][1] += part.size
        for d in sorted(new):
            a, got = new.pop(d)
            a = a.transpose(np.argsort(_memory(order_out))) if placed else a
            if got != a.size:
                raise GridError(ErrorCode.PENCIL_NOT_CONTINUOUS, f"rank {d} got {got} of {a.size} points")
            out = after(a, d) if after else a
            yield _arrow([(d, int(target), list(boxes[d].starts), list(reversed(out.shape)), to_memory(out, order_out).tobytes())], ("rank", "layout", "starts", "counts", "data"), _kinds(False))

    pieces = held.mapInArrow(pack, PIECES)
    if observed is not None:
        rate = F.col("raw") / F.col("sent")
        pieces = pieces.observe(observed, F.sum("raw").alias("raw"), F.sum("sent").alias("sent"), F.min(rate).alias("lowest"), F.max(rate).alias("highest"), F.avg(rate).alias("mean"))
    pieces = pieces.drop("raw", "sent")
    return pieces.repartitionById(len(boxes), F.col("dest")).mapInArrow(unpack, BOXES)


def apply(held: DataFrame, n: int, dtype: np.dtype, work: Work) -> DataFrame:
    """``work`` on every box where it lies."""
    ship(held.sparkSession)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                order = order_of(Layout(row["layout"]), n)
                a = work(from_memory(row["data"], row["counts"], order, dtype), row["rank"])
                yield _arrow([(row["rank"], row["layout"], row["starts"], list(reversed(a.shape)), to_memory(a, order).tobytes())], ("rank", "layout", "starts", "counts", "data"), _kinds(False))

    return held.mapInArrow(run, BOXES)
