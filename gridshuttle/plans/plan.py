"""Plans: how a grid of given sizes is transformed and moved, step by step.

A plan is made on the driver from sizes alone; what it returns are lazy
DataFrames. ``execute`` takes and returns points; ``transpose`` and
``reshape`` take and return what ``scatter`` makes and ``gather`` takes: rows
of lines with the default backend, packed boxes with the others. Nothing is
scaled. One shuffle a step; slab plans save one.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from math import prod
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..enums import COMPRESSED, CUFFTMP_FAMILY, FUSED, MPI_FAMILY, NCCL_FAMILY, PIPELINED, RMA, Backend, CompressionMode, Effort, Execute, Executor, Layout, Platform, Precision, R2RKind, Reshape, Transpose, TransposeMode
from ..errors import ErrorCode, GridError, check
from ..functions import array_fft
from ..functions import transforms as tf
from ..operators import exchange as ex
from ..operators import lines
from .decomposition import Box, default_grid, fourier_bricks, is_distributed, is_product, layout_frame, pencil_boxes, pencils_from_bricks, pencils_from_pencils, slab_use, validate_boxes
from .layouts import MANY, Pencils, TableBoxes, boxes_of, checked
from .physical import described
from .requests import Request

L = Layout
STEPS = {
    Transpose.X_TO_Y: (L.X_PENCILS, L.Y_PENCILS), Transpose.Y_TO_X: (L.Y_PENCILS, L.X_PENCILS), Transpose.Y_TO_Z: (L.Y_PENCILS, L.Z_PENCILS),
    Transpose.Z_TO_Y: (L.Z_PENCILS, L.Y_PENCILS), Transpose.X_TO_Z: (L.X_PENCILS, L.Z_PENCILS), Transpose.Z_TO_X: (L.Z_PENCILS, L.X_PENCILS),
}


class Timing(NamedTuple):
    """Seconds of one trial's iterations."""

    name: str
    longest: float
    shortest: float
    mean: float


#: Bytes of one box, or of one row of lines, that a binary or an array can hold.
LARGEST_VALUE = (1 << 31) - 1


class Rates:
    """Compression rates of one exchange, from the job that runs it."""

    def __init__(self, name: str):
        self.name, self.observed, self._plan = name, Observation(), None

    def of(self, plan: Plan) -> None:
        self._plan = plan

    def get(self) -> dict:
        """``raw`` and ``sent`` bytes and the ranks' ``lowest``, ``highest`` and
        ``mean`` rate; waits for the job. The plan's ``report`` tells of them
        from then on."""
        found = self.observed.get
        self._plan.rates.append((self.name, found["lowest"], found["highest"], found["mean"]))
        return found


class Plan:
    """What the three kinds of plan share."""

    real = False  # values are real before the first transform

    def __init__(
        self, dims: Sequence[int] | None = None, parts: int | None = None, *, boxes: Sequence[Box] | DataFrame | None = None, grid: Sequence[int] | None = None, precision: int = Precision.DOUBLE,
        effort: int = Effort.ESTIMATE, executor: int = Executor.NONE, config: Config | None = None, spark: SparkSession | None = None,
    ):
        self.config = (config or Config.load(spark)).validate()
        if isinstance(boxes, DataFrame):  # a layout table, checked where it lies
            dims, layout = checked(boxes), boxes
            boxes = None
            if self.config.backend == Backend.MPI_DATATYPE and effort == Effort.ESTIMATE and layout.count() > MANY:
                found = TableBoxes(layout, dims)
                boxes = found if not found.is_product() else None  # irregular ones stay where they lie
            boxes = boxes_of(layout) if boxes is None else boxes
            parts = len(boxes)
        elif boxes is not None:
            dims = validate_boxes(boxes)
            parts = len(boxes)
        check(dims is not None and len(dims) in (2, 3), ErrorCode.INVALID_N_DIMENSIONS)
        check(all(int(n) > 0 for n in dims), ErrorCode.INVALID_DIMENSION_SIZE)
        check(precision in set(Precision), ErrorCode.INVALID_PRECISION)
        check(effort in set(Effort), ErrorCode.INVALID_EFFORT)
        check(executor in set(Executor), ErrorCode.INVALID_EXECUTOR)
        check(self.config.platform == Platform.HOST, ErrorCode.INVALID_PLATFORM)
        check(executor not in (Executor.CUFFT, Executor.VKFFT), ErrorCode.INVALID_PLATFORM_EXECUTOR)
        for b in (self.config.backend, self.config.reshape_backend):
            check(b not in NCCL_FAMILY | CUFFTMP_FAMILY, ErrorCode.INVALID_PLATFORM_BACKEND)
        check(Backend.ADAPTIVE != self.config.backend or effort >= Effort.PATIENT, ErrorCode.INVALID_BACKEND)
        if effort >= Effort.PATIENT:
            check(self.config.enable_datatype_backend or self.config.enable_mpi_backends, ErrorCode.BACKENDS_DISABLED)
        self.dims, self.ndims = tuple(int(n) for n in dims), len(dims)
        self.precision, self.effort, self.executor = Precision(precision), Effort(effort), Executor(executor)
        parts = int(parts or (prod(grid) if grid else 1))
        check(parts > 0, ErrorCode.INVALID_COMM_TYPE)
        self.parts, self.backend, self.transpose_mode = parts, self.config.backend, self.config.transpose_mode
        self.reshape_backend = compatible(self.config.reshape_backend, self.backend)
        self._user_boxes = boxes if boxes is None or isinstance(boxes, TableBoxes) else list(boxes)
        self.reshape_enabled = isinstance(boxes, TableBoxes) or (boxes is not None and is_distributed(boxes))
        self._active: dict[str, Request] = {}
        self._alive = True
        self._given_grid = grid is not None
        self._place(grid)
        self.timings: list[Timing] = []
        self.rates: list[tuple[str, float, float, float]] = []
        self.directions: dict[tuple[Layout, Layout], Backend] = {}
        self._ended: list[Request] = []
        self.piecewise: bool | None = None  # whether boxes are permuted a piece at a time; None: as the backend says
        self._check_sizes()
        if effort > Effort.ESTIMATE:
            spark = spark or SparkSession.getActiveSession()
            check(spark is not None, ErrorCode.INVALID_EFFORT, "trials need a session")
            self._tune(spark)
        if self.config.enable_log:
            logging.getLogger("gridshuttle").info("%s", self.report())

    # --- layouts

    def _place(self, grid: Sequence[int] | None) -> None:
        n = self.ndims
        if grid is not None:
            grid = tuple(int(g) for g in grid)
            check(len(grid) <= n, ErrorCode.INVALID_COMM_DIMS)
            if len(grid) == 1:
                grid = (*([1] * (n - 1)), grid[0])
            check(len(grid) == n, ErrorCode.INVALID_COMM_DIMS)
            check(grid[0] == 1, ErrorCode.INVALID_COMM_FAST_DIM)
            check(prod(grid) == self.parts, ErrorCode.INVALID_CART_COMM)
        if isinstance(self._user_boxes, TableBoxes) or (self._user_boxes is not None and not is_product(self._user_boxes)):
            # any other tiling: pencils of their own, met by a reshape
            self.grid, self.z_slab_enabled, self.y_slab_enabled = default_grid(self.dims, self.parts, self.config.enable_z_slab, self.config.enable_y_slab)
            self._first, self.reshape_enabled = None, True
        elif self._user_boxes is not None:
            first = pencils_from_bricks(self._user_boxes) if self.reshape_enabled else self._user_boxes
            ys, zs = len({b.starts[1] for b in first}), len({b.starts[-1] for b in first})
            self.grid = (1, zs) if n == 2 else (1, ys, zs)
            check(prod(self.grid) == self.parts, ErrorCode.INVALID_CART_COMM)
            self.z_slab_enabled, self.y_slab_enabled = slab_use(self.dims, self.grid, self.config.enable_z_slab, self.config.enable_y_slab)
            self._first = first
        elif grid is not None:
            self.grid, self._first = grid, None
            self.z_slab_enabled, self.y_slab_enabled = slab_use(self.dims, grid, self.config.enable_z_slab, self.config.enable_y_slab)
        else:
            self.grid, self.z_slab_enabled, self.y_slab_enabled = default_grid(self.dims, self.parts, self.config.enable_z_slab, self.config.enable_y_slab)
            self._first = None
        self._boxes: dict[Layout, list[Box]] = {}
        self.fourier_reshape = False
        if self.reshape_enabled and self._first is not None and self.config.enable_fourier_reshape and not self.z_slab_enabled:
            along = len({b.starts[-1] for b in self._user_boxes})
            if along > 1 and self.last_layout == (L.Y_PENCILS if n == 2 else L.Z_PENCILS):
                self._boxes[L.Z_BRICKS] = fourier_bricks(self.boxes(self.last_layout), along)
                self.fourier_reshape = True

    def _check_sizes(self) -> None:
        """No single value beyond what a row can hold: rows of lines split a box
        of any size, so only a line (a slab's plane) is limited there."""
        if self.moves_lines:
            rows = [tuple(self.spectral_dims[a] for a in axes) for _, axes in self.line_stages()]
            most = max(prod(r) for r in [*rows, self.dims[:1]]) * 8
            check(most <= LARGEST_VALUE, ErrorCode.ALLOC_FAILED, f"a row of {most} bytes")
        else:
            check(self.alloc_bytes <= LARGEST_VALUE, ErrorCode.ALLOC_FAILED, f"a box of {self.alloc_bytes} bytes: use more ranks, or the backend MPI_DATATYPE, which splits boxes into lines")

    @property
    def spectral_dims(self) -> tuple[int, ...]:
        return self.dims

    @property
    def last_layout(self) -> Layout:
        return L.Y_PENCILS if self.ndims == 2 or self.y_slab_enabled else L.Z_PENCILS

    def boxes(self, layout: Layout) -> list[Box]:
        """Every rank's box; spectral sizes for all layouts after the first."""
        layout = Layout(layout)
        if layout not in self._boxes:
            if layout == L.X_BRICKS:
                check(self.reshape_enabled, ErrorCode.INVALID_LAYOUT)
                found = self._user_boxes
            elif layout == L.Z_BRICKS:
                raise GridError(ErrorCode.INVALID_LAYOUT)
            elif layout == L.Z_PENCILS and self.ndims == 2:
                raise GridError(ErrorCode.INVALID_LAYOUT)
            else:
                dims = self.dims if layout == L.X_PENCILS else self.spectral_dims
                kind = L.X_PENCILS if layout == L.X_PENCILS_FOURIER else layout
                if self._first is not None:
                    first = [Box(b.starts, (dims[0], *b.counts[1:])) for b in self._first]
                    found = pencils_from_pencils(first, dims, kind)
                else:
                    found = Pencils(dims, self.grid, kind) if self.parts > MANY else pencil_boxes(dims, self.grid, kind)
            self._boxes[layout] = found
        return self._boxes[layout]

    def get_pencil(self, spark: SparkSession, layout: Layout) -> DataFrame:
        check(layout in set(Layout), ErrorCode.INVALID_LAYOUT)
        return layout_frame(spark, self.boxes(layout), layout)

    # --- properties

    @property
    def complex_dtype(self) -> np.dtype:
        return np.dtype("c8" if self.precision == Precision.SINGLE else "c16")

    @property
    def real_dtype(self) -> np.dtype:
        return np.dtype("f4" if self.precision == Precision.SINGLE else "f8")

    def dtype_of(self, layout: Layout) -> np.dtype:
        return self.complex_dtype

    @property
    def element_size(self) -> int:
        return self.dtype_of(L.X_PENCILS).itemsize

    def local_sizes(self) -> list[dict]:
        """A row a rank: in and out box, and the elements its buffers need."""
        layouts = [L.X_PENCILS, L.Y_PENCILS, *([L.Z_PENCILS] if self.ndims == 3 else []), *([L.X_BRICKS] if self.reshape_enabled else []), *([L.Z_BRICKS] if self.fourier_reshape else [])]
        first = L.X_BRICKS if self.reshape_enabled else L.X_PENCILS
        last = L.Z_BRICKS if self.fourier_reshape else self.last_layout
        out = []
        for r in range(self.parts):
            a, b = self.boxes(first)[r], self.boxes(last)[r]
            need = max(self.boxes(k)[r].size * (self.dtype_of(k).itemsize // self.element_size) for k in layouts)
            if self.real and self.spectral_dims != self.dims:
                need = max(need, 2 * self.boxes(L.X_PENCILS_FOURIER)[r].size)
            out.append({"rank": r, "in_starts": a.starts, "in_counts": a.counts, "out_starts": b.starts, "out_counts": b.counts, "alloc_size": need})
        return out

    @property
    def alloc_size(self) -> int:
        return max(s["alloc_size"] for s in self.local_sizes())

    @property
    def alloc_bytes(self) -> int:
        return self.alloc_size * self.element_size

    @property
    def aux_size_transpose(self) -> int:
        """Elements in flight in a transpose: none where points move one by one, else a box's."""
        return 0 if self.backend == Backend.MPI_DATATYPE else self.alloc_size

    @property
    def aux_size_reshape(self) -> int:
        return self.alloc_size if self.reshape_enabled and self.reshape_backend != Backend.MPI_DATATYPE else 0

    @property
    def aux_size(self) -> int:
        """What ``execute`` needs: the larger of both, and a box between two steps."""
        return max(self.aux_size_transpose, self.aux_size_reshape) + self.alloc_size

    @property
    def aux_bytes(self) -> int:
        return self.aux_size * self.element_size

    @property
    def aux_bytes_transpose(self) -> int:
        return self.aux_size_transpose * self.element_size

    @property
    def aux_bytes_reshape(self) -> int:
        return self.aux_size_reshape * self.element_size

    @property
    def platform(self) -> Platform:
        return self.config.platform

    def report(self, done: DataFrame | None = None) -> str:
        """The plan in words; with a result of it, which is run for that, also
        what Spark did: exchanges, bytes, spills."""
        out = [
            f"{type(self).__name__} of {' x '.join(map(str, self.dims))}, {self.precision.name.lower()} precision",
            f"grid {' x '.join(map(str, self.grid))}, z-slab {self.z_slab_enabled}, y-slab {self.y_slab_enabled}",
            f"executor {self.executor.name}, effort {self.effort.name}, backend {self.backend.name}, transpose mode {self.transpose_mode.name}",
        ]
        if self.reshape_enabled:
            out.append(f"reshape backend {self.reshape_backend.name}, spectral bricks {self.fourier_reshape}")
        out += [f"{b.name} for {s.name} to {t.name}" for (s, t), b in self.directions.items()]
        out += [f"{t.name}: longest {t.longest:.3f} s, shortest {t.shortest:.3f} s, mean {t.mean:.3f} s" for t in self.timings]
        out += [f"compression of {name}: from {lo:.2f} to {hi:.2f}, mean {mean:.2f}" for name, lo, hi, mean in self.rates]
        return "\n".join(out + ([described(done)] if done is not None else []))

    def destroy(self) -> None:
        """Ends the plan, cancels what still runs and deletes what its requests wrote."""
        while self._active:
            self._active.popitem()[1].cancel()
        while self._ended:
            self._ended.pop().free()
        self._alive = False

    def _check_alive(self) -> None:
        check(self._alive, ErrorCode.PLAN_NOT_CREATED)

    # --- exchanges

    def _how(self, backend: Backend, reshape: bool = False) -> dict | None:
        """Options of the block exchange; none for lines."""
        config = self.config.reshape_compression if reshape else self.config.compression
        if backend == Backend.ADAPTIVE:
            backend = Backend.MPI_P2P
        fused = backend in FUSED if self.piecewise is None else self.piecewise
        return None if backend == Backend.MPI_DATATYPE else {"mode": self.transpose_mode, "compression": config if backend in COMPRESSED else None, "fused": fused, "access": self.config.access_mode}

    def _between(self, source: Layout, target: Layout) -> Backend:
        """The backend of a direction."""
        same = lambda k: L.X_PENCILS if k == L.X_PENCILS_FOURIER else k
        return self.directions.get((same(source), same(target)), self.backend)

    @property
    def moves_lines(self) -> bool:
        """Whether grids are held as rows of lines, not as boxes."""
        return self.backend == Backend.MPI_DATATYPE and not self.directions

    def dims_of(self, layout: Layout) -> tuple[int, ...]:
        return self.dims if layout in (L.X_PENCILS, L.X_BRICKS) else self.spectral_dims

    def _kind(self, layout: Layout) -> str:
        return "float" if self.precision == Precision.SINGLE else "double"

    def _lines(self, points: DataFrame, layout: Layout, inner: tuple[int, ...] | None = None) -> DataFrame:
        return lines.from_points(points, self.dims_of(layout), inner or lines.inner_of(layout, self.ndims), self.boxes(layout), self._kind(layout))

    def scatter(self, points: DataFrame, layout: Layout) -> DataFrame:
        self._check_alive()
        return self._lines(points, layout) if self.moves_lines else ex.scatter(points, self.boxes(layout), layout, self.dtype_of(layout))

    def gather(self, held: DataFrame, layout: Layout) -> DataFrame:
        if lines.is_lines(held):
            return lines.to_points(held, self.dims_of(layout), lines.inner_of(layout, self.ndims))
        return ex.gather(held, self.ndims, self.dtype_of(layout))

    def placement(self, held: DataFrame, layout: Layout) -> DataFrame:
        """Points with the rank that holds them and their place in its memory."""
        if lines.is_lines(held):
            return lines.placement(held, self.dims_of(layout), lines.inner_of(layout, self.ndims), self.boxes(layout), layout)
        return ex.gather(held, self.ndims, self.dtype_of(layout), offsets=True)

    def _move_lines(self, rows: DataFrame, source: Layout, target: Layout, inner: tuple[int, ...], to: tuple[int, ...]) -> DataFrame:
        """Rows along ``inner`` to rows along ``to`` in ``target``."""
        dims, boxes = self.dims_of(target), self.boxes(target)
        if source in (L.X_BRICKS, L.Z_BRICKS):
            return lines.joined(rows, dims, to, boxes)
        if target in (L.X_BRICKS, L.Z_BRICKS):
            return lines.parted(rows, dims, inner, to[0], boxes)
        return lines.regroup(rows, dims, inner, to, boxes)

    def _exchange(self, held: DataFrame, source: Layout, target: Layout, after=None, backend: Backend | None = None, reshape: bool = False, observed: Observation | None = None) -> DataFrame:
        """Boxes or lines in ``source`` to the same in ``target``."""
        n, dtype = self.ndims, self.dtype_of(source)
        how = self._how(backend or (self.reshape_backend if reshape else self._between(source, target)), reshape)
        inner, to, were_lines = lines.inner_of(source, n), lines.inner_of(target, n), lines.is_lines(held)
        if how is None or were_lines:
            rows = held if were_lines else lines.of_boxes(held, n, inner, dtype)
            rows = self._move_lines(rows, source, target, inner, to)
            return rows if were_lines else lines.to_boxes(rows, self.dims_of(target), to, self.boxes(target), target, dtype, after)
        return ex.redistribute(held, source, target, self.boxes(target), dtype, dtype, None, after, observed=observed, **how)

    def _ends(self, kind: Transpose) -> tuple[Layout, Layout]:
        return tuple(L.X_PENCILS_FOURIER if k == L.X_PENCILS and self.real and self.spectral_dims != self.dims else k for k in STEPS[kind])

    def _reshape_ends(self, kind: Reshape) -> tuple[Layout, Layout]:
        last = self.last_layout
        return {Reshape.X_BRICKS_TO_PENCILS: (L.X_BRICKS, L.X_PENCILS), Reshape.X_PENCILS_TO_BRICKS: (L.X_PENCILS, L.X_BRICKS), Reshape.Z_PENCILS_TO_BRICKS: (last, L.Z_BRICKS), Reshape.Z_BRICKS_TO_PENCILS: (L.Z_BRICKS, last)}[Reshape(kind)]

    def transpose(self, held: DataFrame, kind: Transpose, rates: Rates | None = None) -> DataFrame:
        """One pencil layout to another, values unchanged. ``rates`` are filled
        by the job that runs the exchange (block exchanges only)."""
        self._check_alive()
        check(kind in set(Transpose), ErrorCode.INVALID_TRANSPOSE_TYPE)
        kind = Transpose(kind)
        if self.ndims == 2:
            check(abs(kind) == 1, ErrorCode.INVALID_TRANSPOSE_TYPE)
        if abs(kind) == 3:
            check(self.z_slab_enabled, ErrorCode.INVALID_TRANSPOSE_TYPE)
        return self._exchange(held, *self._ends(kind), observed=self._watched(rates))

    def _watched(self, rates: Rates | None) -> Observation | None:
        if rates is not None:
            rates.of(self)
        return rates.observed if rates is not None else None

    def reshape(self, held: DataFrame, kind: Reshape, rates: Rates | None = None) -> DataFrame:
        """Between bricks and pencils, axis order unchanged."""
        self._check_alive()
        check(self.reshape_enabled, ErrorCode.RESHAPE_NOT_SUPPORTED)
        check(kind in set(Reshape), ErrorCode.INVALID_RESHAPE_TYPE)
        source, target = self._reshape_ends(kind)
        if L.Z_BRICKS in (source, target):
            check(self.fourier_reshape, ErrorCode.RESHAPE_NOT_SUPPORTED)
        return self._exchange(held, source, target, reshape=True, observed=self._watched(rates))

    def _start(self, what: str, df: DataFrame) -> Request:
        check(what not in self._active, ErrorCode.TRANSPOSE_ACTIVE if what == "transpose" else ErrorCode.RESHAPE_ACTIVE)
        request = Request(what, df)
        self._active[what] = request
        return request

    def _end(self, what: str, request: Request | int) -> DataFrame:
        check(what in self._active, ErrorCode.TRANSPOSE_NOT_ACTIVE if what == "transpose" else ErrorCode.RESHAPE_NOT_ACTIVE)
        mine = self._active[what]
        check(isinstance(request, (Request, int)) and int(request) == mine.handle, ErrorCode.INVALID_REQUEST)
        del self._active[what]
        self._ended.append(mine)
        return mine.result()

    def cancel(self, request: Request | int) -> None:
        """Ends a started exchange; no job of it is left running."""
        for what, mine in list(self._active.items()):
            if int(request) == mine.handle:
                del self._active[what]
                mine.cancel()
                return
        raise GridError(ErrorCode.INVALID_REQUEST)

    def transpose_start(self, held: DataFrame, kind: Transpose) -> Request:
        return self._start("transpose", self.transpose(held, kind))

    def transpose_end(self, request: Request | int) -> DataFrame:
        return self._end("transpose", request)

    def reshape_start(self, held: DataFrame, kind: Reshape) -> Request:
        return self._start("reshape", self.reshape(held, kind))

    def reshape_end(self, request: Request | int) -> DataFrame:
        return self._end("reshape", request)

    # --- execution

    def _work(self, axes: tuple[int, ...], forward: bool):
        """The transform of a box along ``axes`` (None without an executor)."""
        raise NotImplementedError

    def stages(self) -> list[tuple[Layout, tuple[int, ...]]]:
        """Forward: layouts in turn, each with the axes transformed there."""
        if self.ndims == 2:
            return [(L.X_PENCILS, (0,)), (L.Y_PENCILS, (1,))]
        if self.z_slab_enabled:
            return [(L.X_PENCILS, (0, 1)), (L.Z_PENCILS, (2,))]
        if self.y_slab_enabled:
            return [(L.X_PENCILS, (0,)), (L.Y_PENCILS, (1, 2))]
        return [(L.X_PENCILS, (0,)), (L.Y_PENCILS, (1,)), (L.Z_PENCILS, (2,))]

    def execute(self, points: DataFrame, kind: Execute) -> DataFrame:
        """Points to points: every axis transformed, or (executor none) only
        moved through the layouts."""
        self._check_alive()
        check(kind in set(Execute), ErrorCode.INVALID_EXECUTE_TYPE)
        check(not self._active, ErrorCode.TRANSPOSE_ACTIVE if "transpose" in self._active else ErrorCode.RESHAPE_ACTIVE)
        forward = kind == Execute.FORWARD
        if self.executor == Executor.SQL or self.moves_lines:
            return self._execute_lines(points, forward)
        if forward:
            held, at = self._to_spectrum(points)
            return ex.gather(held, self.ndims, self.dtype_of(at))
        layout, axes = self.stages()[-1]
        if self.fourier_reshape:
            held = self._exchange(self._scatter(points, L.Z_BRICKS, None), L.Z_BRICKS, layout, self._work(axes, False), reshape=True)
        else:
            held = self._scatter(points, layout, self._work(axes, False))
        return self._from_spectrum(held)

    def round_trip(self, points: DataFrame) -> DataFrame:
        """Points to points, forward and backward, as ``execute`` twice; boxes
        stay boxes in between, so points are only dealt out once."""
        self._check_alive()
        if self.executor == Executor.SQL or self.moves_lines:
            return self.execute(self.execute(points, Execute.FORWARD), Execute.BACKWARD)
        check(not self._active, ErrorCode.TRANSPOSE_ACTIVE if "transpose" in self._active else ErrorCode.RESHAPE_ACTIVE)
        held, at = self._to_spectrum(points)
        layout, axes = self.stages()[-1]
        work = self._work(axes, False)
        if self.fourier_reshape:
            held = self._exchange(held, at, layout, work, reshape=True)
        elif work:
            held = ex.apply(held, self.ndims, self.dtype_of(at), work)
        return self._from_spectrum(held)

    def _to_spectrum(self, points: DataFrame) -> tuple[DataFrame, Layout]:
        """Points to boxes of the spectrum, and their layout."""
        steps = self.stages()
        if self.reshape_enabled:
            held = self._scatter(points, L.X_BRICKS, None)
            held = self._exchange(held, L.X_BRICKS, L.X_PENCILS, self._work(steps[0][1], True), reshape=True)
        else:
            held = self._scatter(points, L.X_PENCILS, self._work(steps[0][1], True))
        at = self._after_first()
        for layout, axes in steps[1:]:
            held, at = self._exchange(held, at, layout, self._work(axes, True)), layout
        if self.fourier_reshape:
            held, at = self._exchange(held, at, L.Z_BRICKS, reshape=True), L.Z_BRICKS
        return held, at

    def _from_spectrum(self, held: DataFrame) -> DataFrame:
        """Boxes in the last layout, whose axes are transformed back, to points."""
        back = self.stages()[::-1]
        at = back[0][0]
        for layout, axes in back[1:]:
            held, at = self._exchange(held, at, self._after_first() if layout == L.X_PENCILS else layout, self._work(axes, False)), layout
        if self.reshape_enabled:
            held = self._exchange(held, L.X_PENCILS, L.X_BRICKS, reshape=True)
        return ex.gather(held, self.ndims, self.dtype_of(L.X_PENCILS))

    def line_stages(self) -> list[tuple[Layout, tuple[int, ...]]]:
        """Stages on rows: the array transforms take one axis at a time."""
        if self.executor != Executor.SQL:
            return self.stages()
        return [(L.X_PENCILS, (0,)), (L.Y_PENCILS, (1,)), (L.Z_PENCILS, (2,))][: self.ndims]

    def _execute_lines(self, points: DataFrame, forward: bool) -> DataFrame:
        """``execute`` on rows of lines (slab stages: of planes)."""
        steps = self.line_stages() if forward else self.line_stages()[::-1]
        (at, axes), real = steps[0], self._after_first()
        bricks = L.X_BRICKS if forward and self.reshape_enabled else L.Z_BRICKS if not forward and self.fourier_reshape else None
        if bricks and not isinstance(self._user_boxes, TableBoxes):  # points have no rank yet: lines at once, not cut at a table's boxes first
            rows = self._move_lines(self._lines(points, bricks), bricks, at, (), axes)
        else:
            rows = self._lines(points, at, axes)
        rows = self._transformed(rows, axes, forward)
        for layout, to in steps[1:]:
            here = real if layout == L.X_PENCILS else layout
            rows = self._transformed(self._move_lines(rows, at, here, axes, to), to, forward)
            at, axes = layout, to
        bricks = L.Z_BRICKS if forward and self.fourier_reshape else L.X_BRICKS if not forward and self.reshape_enabled else None
        if bricks and self._first is not None:  # parts of irregular boxes would be as small as their finest cut
            rows, axes, at = self._move_lines(rows, at, bricks, axes, lines.inner_of(bricks, self.ndims)), lines.inner_of(bricks, self.ndims), bricks
        return lines.to_points(rows, self.spectral_dims if forward else self.dims, axes)

    def _transformed(self, rows: DataFrame, axes: tuple[int, ...], forward: bool) -> DataFrame:
        if self.executor == Executor.SQL:
            made = self._array_work(axes[0], forward)
            return rows.select("rank", *ex.AXES[: self.ndims], made.alias("made")).select("rank", *ex.AXES[: self.ndims], *self._unpacked())
        work = self._work(axes, forward)
        if work is None:
            return rows
        real, spectral = self.dtype_of(L.X_PENCILS), self.dtype_of(L.Y_PENCILS)
        first = 0 in axes
        dims = self.dims if first and forward else self.spectral_dims
        return lines.worked(rows, dims, axes, work, real if first and forward else spectral, real if first and not forward else spectral)

    def _array_work(self, axis: int, forward: bool):
        """The transform of a row's line along ``axis``, as a column."""
        raise NotImplementedError

    def _unpacked(self):
        """Values of the column ``made``: complex ones are in two fields."""
        kind = f"array<{self._kind(L.X_PENCILS)}>"
        return [F.col(f"made.{v}").cast(kind).alias(v) for v in ("re", "im")]

    def _after_first(self) -> Layout:
        return L.X_PENCILS_FOURIER if self.real and self.spectral_dims != self.dims else L.X_PENCILS

    def _scatter(self, points, layout, work):
        return ex.scatter(points, self.boxes(layout), layout, self.dtype_of(layout), work)

    # --- autotuning

    def _tune(self, spark: SparkSession) -> None:
        """Trial runs on a grid of zeros, written to nowhere; the fastest stays.

        MEASURE tries the grids, PATIENT the backends (ADAPTIVE: for each
        direction by itself), EXHAUSTIVE also transpose modes, the reshape
        backend and (``enable_kernel_autotune``) boxes permuted whole or by pieces. A trial makes the exchanges that ``execute`` makes forward,
        the half spectrum's for real-to-complex plans.
        """
        first = self._after_first()
        zeros = self._zeros(spark, self.spectral_dims, self.dtype_of(first))

        def timed(name: str, run) -> float:
            for _ in range(self.config.n_measure_warmup_iters):
                run()
            each = []
            for _ in range(self.config.n_measure_iters):
                began = time.perf_counter()
                run()
                each.append(time.perf_counter() - began)
            self.timings.append(Timing(name, max(each), min(each), sum(each) / len(each)))
            return self.timings[-1].mean

        def sunk(held: DataFrame) -> None:
            held.write.format("noop").mode("overwrite").save()

        def exchanges():
            held, at = self.scatter(zeros, first), first
            for layout, _ in self.stages()[1:]:
                held, at = self._exchange(held, at, layout), layout
            sunk(held)

        def best(what, options, put, run=exchanges):
            times = []
            for o in options:
                put(o)
                times.append((timed(f"{what} {getattr(o, 'name', o)}", run), o))
            found = min(times, key=lambda t: t[0])[1]
            put(found)
            return found

        if self.effort >= Effort.MEASURE and self._user_boxes is None and not self._given_grid and self.ndims == 3:
            best("grid", self._grids() or [self.grid], self._place)
        options = self._candidates()
        if self.effort >= Effort.PATIENT and options:
            if self.config.backend == Backend.ADAPTIVE:
                layouts = [first, *[layout for layout, _ in self.stages()[1:]]]
                for a, b in zip(layouts, layouts[1:], strict=False):
                    for source, target in ((a, b), (b, a)):
                        held = ex.scatter(zeros, self.boxes(source), source, self.dtype_of(first))
                        key = tuple(L.X_PENCILS if k == L.X_PENCILS_FOURIER else k for k in (source, target))
                        best("backend", options, lambda o, key=key: self.directions.__setitem__(key, o), lambda held=held, s=source, t=target: sunk(self._exchange(held, s, t)))
            else:
                best("backend", options, lambda o: setattr(self, "backend", o))
            self.reshape_backend = compatible(self.config.reshape_backend, options[0] if self.backend == Backend.ADAPTIVE else self.backend)
        if self.effort >= Effort.EXHAUSTIVE:
            best("mode", list(TransposeMode), lambda m: setattr(self, "transpose_mode", m))
            if self.config.enable_kernel_autotune and not self.moves_lines:
                best("kernel", [False, True], lambda o: setattr(self, "piecewise", o))
            if self.reshape_enabled and options:
                bricks = ex.scatter(self._zeros(spark, self.dims, self.dtype_of(L.X_BRICKS)), self.boxes(L.X_BRICKS), L.X_BRICKS, self.dtype_of(L.X_BRICKS))
                best("reshape", options, lambda o: setattr(self, "reshape_backend", o), lambda: sunk(self._exchange(bricks, L.X_BRICKS, L.X_PENCILS, reshape=True)))

    def _zeros(self, spark: SparkSession, dims, dtype: np.dtype) -> DataFrame:
        from ..sources.grids import coordinates

        return coordinates(spark, dims).withColumns({v: F.lit(0.0) for v in (("re", "im") if dtype.kind == "c" else ("v",))})

    def _grids(self) -> list[tuple[int, int, int]]:
        """Every pair of divisors, both ways, that leaves no rank empty."""
        out = []
        for i in range(1, self.parts + 1):
            g = (1, i, self.parts // i)
            if self.parts % i == 0 and g[1] <= min(self.spectral_dims[0], self.dims[1]) and g[2] <= min(self.dims[1:]):
                out.append(g)
        return out

    def _candidates(self) -> list[Backend]:
        """Backends that the settings allow and that do differ here."""
        c = self.config
        allowed = [b for b in sorted(MPI_FAMILY) if (c.enable_datatype_backend if b == Backend.MPI_DATATYPE else c.enable_mpi_backends)]
        allowed = [b for b in allowed if (b not in PIPELINED or c.enable_pipelined_backends) and (b not in RMA or c.enable_rma_backends) and (b not in FUSED or c.enable_fused_backends)]
        allowed = [b for b in allowed if b not in COMPRESSED or (c.enable_compressed_backends and c.compression.mode == CompressionMode.FIXED_RATE)]
        different = {}
        for b in allowed:
            different.setdefault(str(self._how(b)), b)
        return list(different.values())


def compatible(reshape: Backend, backend: Backend) -> Backend:
    """The reshape backend, or the transpose backend if the families differ."""
    gpu = NCCL_FAMILY | CUFFTMP_FAMILY
    return backend if (reshape in gpu) != (backend in gpu) else reshape


class PlanC2C(Plan):
    def _work(self, axes, forward):
        if self.executor == Executor.NONE:
            return None
        at = tuple(self.ndims - 1 - a for a in axes)
        dtype = self.complex_dtype
        return lambda a, rank: tf.c2c(a, at, forward).astype(dtype, copy=False) if a.size else a

    def _array_work(self, axis, forward):
        return array_fft.fft(array_fft.complex_line(F.col("re"), F.col("im")), self.dims[axis], forward)


class PlanR2C(Plan):
    """Real points ``v`` to the half spectrum ``re``, ``im`` (x up to n div 2)."""

    real = True

    @property
    def spectral_dims(self):
        return (self.dims[0] // 2 + 1, *self.dims[1:])

    def dtype_of(self, layout):
        return self.real_dtype if layout in (L.X_PENCILS, L.X_BRICKS) else self.complex_dtype

    def execute(self, points, kind):
        check(self.executor != Executor.NONE, ErrorCode.R2C_EXECUTE_CALLED)
        return super().execute(points, kind)

    def _work(self, axes, forward):
        n, nx, complex_, real = self.ndims, self.dims[0], self.complex_dtype, self.real_dtype
        rest = tuple(n - 1 - a for a in axes if a)

        def run(a, rank):
            if forward:
                a = tf.r2c(a, n - 1) if 0 in axes else a
                return (tf.c2c(a, rest, True) if rest else a).astype(complex_, copy=False)
            a = tf.c2c(a, rest, False) if rest else a
            return tf.c2r(a, n - 1, nx).astype(real, copy=False) if 0 in axes else a.astype(complex_, copy=False)

        return run

    def _array_work(self, axis, forward):
        if axis == 0 and forward:
            return array_fft.r2c(F.col("v"), self.dims[0])
        given = array_fft.complex_line(F.col("re"), F.col("im"))
        if axis == 0:
            real = array_fft.c2r(given, self.dims[0])
            return F.transform(real, lambda a: F.struct(a.alias("v")))
        return array_fft.fft(given, self.dims[axis], forward)

    def _transformed(self, rows, axes, forward):
        if self.executor == Executor.SQL and axes == (0,) and not forward:
            made = rows.select("rank", *ex.AXES[: self.ndims], self._array_work(0, False).alias("made"))
            return made.select("rank", *ex.AXES[: self.ndims], F.col("made.v").cast(f"array<{self._kind(L.X_PENCILS)}>").alias("v"))
        return super()._transformed(rows, axes, forward)


class PlanR2R(Plan):
    """Real points ``v``; a kind for each axis."""

    real = True

    def __init__(self, dims=None, parts=None, kinds: Sequence[int] | None = None, **more):
        executor = more.get("executor", Executor.NONE)
        if executor != Executor.NONE:
            check(kinds is not None, ErrorCode.MISSING_R2R_KINDS)
            boxes = more.get("boxes")
            n = len(dims if dims is not None else boxes.first().starts if isinstance(boxes, DataFrame) else boxes[0].starts)
            check(len(kinds) == n and all(k in set(R2RKind) for k in kinds), ErrorCode.INVALID_R2R_KINDS)
        self.kinds = [R2RKind(k) for k in kinds] if kinds is not None else None
        super().__init__(dims, parts, **more)

    def dtype_of(self, layout):
        return self.real_dtype

    def _work(self, axes, forward):
        if self.executor == Executor.NONE:
            return None
        n, kinds, dtype = self.ndims, self.kinds, self.real_dtype

        def run(a, rank):
            for x in axes if a.size else ():
                a = tf.r2r(a, n - 1 - x, kinds[x] if forward else tf.INVERSE[kinds[x]])
            return a.astype(dtype, copy=False)

        return run

    def _array_work(self, axis, forward):
        kind = self.kinds[axis] if forward else tf.INVERSE[self.kinds[axis]]
        return array_fft.r2r(F.col("v").cast("array<double>"), self.dims[axis], kind)

    def _unpacked(self):
        return [F.col("made").cast(f"array<{self._kind(L.X_PENCILS)}>").alias("v")]

    def round_trip_factor(self) -> int:
        return prod(tf.round_trip_factor(k, n) for k, n in zip(self.kinds, self.dims, strict=True))
