"""One exception with a code; the numbers are fixed values of the interface."""

from __future__ import annotations

from enum import IntEnum


class ErrorCode(IntEnum):
    SUCCESS = 0
    MPI_FINALIZED = -1
    PLAN_NOT_CREATED = 1
    INVALID_TRANSPOSE_TYPE = 2
    INVALID_N_DIMENSIONS = 3
    INVALID_DIMENSION_SIZE = 4
    INVALID_COMM_TYPE = 5
    INVALID_PRECISION = 6
    INVALID_EFFORT = 7
    INVALID_EXECUTOR = 8
    INVALID_COMM_DIMS = 9
    INVALID_COMM_FAST_DIM = 10
    MISSING_R2R_KINDS = 11
    INVALID_R2R_KINDS = 12
    R2C_TRANSPOSE_PLAN = 13
    INPLACE_TRANSPOSE = 14
    INVALID_AUX = 15
    INVALID_LAYOUT = 16
    INVALID_USAGE = 17
    PLAN_IS_CREATED = 18
    ALLOC_FAILED = 19
    FREE_FAILED = 20
    INVALID_ALLOC_BYTES = 21
    DLOPEN_FAILED = 22
    DLSYM_FAILED = 23
    PENCIL_ARRAYS_SIZE_MISMATCH = 25
    PENCIL_ARRAYS_INVALID_SIZES = 26
    PENCIL_INVALID_COUNTS = 27
    PENCIL_INVALID_STARTS = 28
    PENCIL_SHAPE_MISMATCH = 29
    PENCIL_OVERLAP = 30
    PENCIL_NOT_CONTINUOUS = 31
    PENCIL_NOT_INITIALIZED = 32
    INVALID_MEASURE_WARMUP_ITERS = 33
    INVALID_MEASURE_ITERS = 34
    INVALID_REQUEST = 35
    TRANSPOSE_ACTIVE = 36
    TRANSPOSE_NOT_ACTIVE = 37
    INVALID_RESHAPE_TYPE = 38
    RESHAPE_ACTIVE = 39
    RESHAPE_NOT_ACTIVE = 40
    INPLACE_RESHAPE = 41
    INVALID_EXECUTE_TYPE = 43
    RESHAPE_NOT_SUPPORTED = 44
    R2C_EXECUTE_CALLED = 45
    INVALID_CART_COMM = 46
    INVALID_TRANSPOSE_MODE = 47
    INVALID_ACCESS_MODE = 48
    R2R_FFT_NOT_SUPPORTED = 101
    GPU_INVALID_STREAM = 201
    INVALID_BACKEND = 202
    GPU_NOT_SET = 203
    VKFFT_R2R_2D_PLAN = 204
    BACKENDS_DISABLED = 205
    NOT_DEVICE_PTR = 300
    NOT_NVSHMEM_PTR = 301
    INVALID_PLATFORM = 400
    INVALID_PLATFORM_EXECUTOR = 401
    INVALID_PLATFORM_BACKEND = 402
    COMPRESSION_CUDA_NOT_SUPPORTED = 500
    COMPRESSION_INVALID_RATE = 501
    COMPRESSION_INVALID_PRECISION = 502
    COMPRESSION_INVALID_TOLERANCE = 503
    COMPRESSION_INVALID_MODE = 504
    COMPRESSION_INVALID_LIBRARY = 505
    COMPRESSION_NOT_USED = 506


def error_string(code: int) -> str:
    """Plain words for a code."""
    try:
        name = ErrorCode(code).name
    except ValueError:
        return "unknown error"
    return name.lower().replace("_", " ")


class GridError(RuntimeError):
    def __init__(self, code: ErrorCode, detail: str = ""):
        self.code = ErrorCode(code)
        super().__init__(f"{self.code.name} ({self.code.value})" + (f": {detail}" if detail else ""))


def check(ok: bool, code: ErrorCode, detail: str = "") -> None:
    if not ok:
        raise GridError(code, detail)
