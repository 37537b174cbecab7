"""The codes users pass and read. Their numbers are part of the interface."""

from __future__ import annotations

from enum import IntEnum


class Execute(IntEnum):
    FORWARD = 11
    BACKWARD = 12


class Transpose(IntEnum):
    X_TO_Y = 1
    Y_TO_X = -1
    Y_TO_Z = 2
    Z_TO_Y = -2
    X_TO_Z = 3
    Z_TO_X = -3


class Reshape(IntEnum):
    X_BRICKS_TO_PENCILS = 11
    X_PENCILS_TO_BRICKS = 12
    Z_PENCILS_TO_BRICKS = 13
    Z_BRICKS_TO_PENCILS = 14
    Y_PENCILS_TO_BRICKS = 13  # the last axis of 2-D plans
    Y_BRICKS_TO_PENCILS = 14


class Layout(IntEnum):
    X_BRICKS = 1
    X_PENCILS = 2
    X_PENCILS_FOURIER = 3
    Y_PENCILS = 4
    Z_PENCILS = 5
    Z_BRICKS = 6


class Effort(IntEnum):
    ESTIMATE = 0
    MEASURE = 1
    PATIENT = 2
    EXHAUSTIVE = 3


class Precision(IntEnum):
    SINGLE = 0
    DOUBLE = 1


class R2RKind(IntEnum):
    DCT_1 = 3
    DCT_3 = 4
    DCT_2 = 5
    DCT_4 = 6
    DST_1 = 7
    DST_3 = 8
    DST_2 = 9
    DST_4 = 10


class Executor(IntEnum):
    NONE = 0
    NUMPY = 1  # batched transforms on Arrow batches; every kind
    SQL = 2  # the transform as a sum in DataFrame functions; complex and real-to-complex
    CUFFT = 3
    VKFFT = 4


class Backend(IntEnum):
    MPI_DATATYPE = 21
    MPI_P2P = 22
    MPI_A2A = 23
    NCCL = 24
    CUFFTMP = 25
    MPI_P2P_PIPELINED = 26
    NCCL_PIPELINED = 27
    CUFFTMP_PIPELINED = 28
    MPI_RMA = 29
    MPI_RMA_PIPELINED = 30
    MPI_P2P_SCHEDULED = 31
    MPI_P2P_FUSED = 32
    MPI_RMA_FUSED = 33
    MPI_P2P_COMPRESSED = 34
    MPI_RMA_COMPRESSED = 35
    ADAPTIVE = 36
    NCCL_COMPRESSED = 37


class Platform(IntEnum):
    HOST = 1
    CUDA = 2


class TransposeMode(IntEnum):
    PACK = 15
    UNPACK = 16


class AccessMode(IntEnum):
    WRITE = -1
    READ = 1


class CompressionMode(IntEnum):
    LOSSLESS = 1
    FIXED_RATE = 2
    FIXED_PRECISION = 3
    FIXED_ACCURACY = 4


class CompressionLib(IntEnum):
    ZFP = 11


B = Backend
PIPELINED = frozenset({B.MPI_P2P_PIPELINED, B.MPI_RMA_PIPELINED, B.NCCL_PIPELINED, B.CUFFTMP_PIPELINED, B.MPI_P2P_FUSED, B.MPI_RMA_FUSED, B.MPI_P2P_COMPRESSED, B.MPI_RMA_COMPRESSED, B.NCCL_COMPRESSED})
FUSED = frozenset({B.MPI_P2P_FUSED, B.MPI_RMA_FUSED, B.MPI_P2P_COMPRESSED, B.MPI_RMA_COMPRESSED, B.NCCL_COMPRESSED})
RMA = frozenset({B.MPI_RMA, B.MPI_RMA_PIPELINED, B.MPI_RMA_FUSED, B.MPI_RMA_COMPRESSED})
COMPRESSED = frozenset({B.MPI_P2P_COMPRESSED, B.MPI_RMA_COMPRESSED, B.NCCL_COMPRESSED})
NCCL_FAMILY = frozenset({B.NCCL, B.NCCL_PIPELINED, B.NCCL_COMPRESSED})
CUFFTMP_FAMILY = frozenset({B.CUFFTMP, B.CUFFTMP_PIPELINED})
MPI_FAMILY = frozenset(set(B) - NCCL_FAMILY - CUFFTMP_FAMILY - {B.ADAPTIVE})


def backend_string(b: Backend) -> str:
    return Backend(b).name


def precision_string(p: Precision) -> str:
    return Precision(p).name


def executor_string(e: Executor) -> str:
    return Executor(e).name


def is_numpy_enabled() -> bool:
    return True


def is_cuda_enabled() -> bool:
    return False


def is_compression_enabled() -> bool:
    return True


__all__ = [
    "AccessMode", "Backend", "CompressionLib", "CompressionMode", "Effort", "Execute", "Executor", "Layout", "Platform", "Precision", "R2RKind", "Reshape", "Transpose", "TransposeMode",
    "PIPELINED", "FUSED", "RMA", "COMPRESSED", "NCCL_FAMILY", "CUFFTMP_FAMILY", "MPI_FAMILY",
    "backend_string", "precision_string", "executor_string", "is_numpy_enabled", "is_cuda_enabled", "is_compression_enabled",
]
