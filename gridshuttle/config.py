"""Settings. An argument wins over the session's ``gridshuttle.*`` setting,
that over the environment (``GRIDSHUTTLE_*``), that over the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from .enums import AccessMode, Backend, CompressionLib, CompressionMode, Platform, TransposeMode
from .errors import ErrorCode, check

PREFIX = "gridshuttle"


@dataclass(frozen=True)
class CompressionConfig:
    lib: CompressionLib = CompressionLib.ZFP
    mode: CompressionMode = CompressionMode.LOSSLESS
    rate: float = 8.0
    precision: int = 16
    tolerance: float = 1e-6

    def validate(self, bits: int = 64) -> CompressionConfig:
        check(self.lib in set(CompressionLib), ErrorCode.COMPRESSION_INVALID_LIBRARY)
        check(self.mode in set(CompressionMode), ErrorCode.COMPRESSION_INVALID_MODE)
        if self.mode == CompressionMode.FIXED_RATE:
            check(1 < self.rate < bits, ErrorCode.COMPRESSION_INVALID_RATE)
        if self.mode == CompressionMode.FIXED_PRECISION:
            check(self.precision > 1, ErrorCode.COMPRESSION_INVALID_PRECISION)
        if self.mode == CompressionMode.FIXED_ACCURACY:
            check(self.tolerance > 0, ErrorCode.COMPRESSION_INVALID_TOLERANCE)
        return self


@dataclass(frozen=True)
class Config:
    enable_log: bool = False
    enable_z_slab: bool = True
    enable_y_slab: bool = False
    n_measure_warmup_iters: int = 2
    n_measure_iters: int = 5
    platform: Platform = Platform.HOST
    backend: Backend = Backend.MPI_DATATYPE
    reshape_backend: Backend = Backend.MPI_DATATYPE
    enable_datatype_backend: bool = True
    enable_mpi_backends: bool = False
    enable_pipelined_backends: bool = True
    enable_rma_backends: bool = True
    enable_fused_backends: bool = True
    enable_nccl_backends: bool = True
    enable_nvshmem_backends: bool = True
    enable_compressed_backends: bool = False
    enable_kernel_autotune: bool = False
    enable_fourier_reshape: bool = False
    transpose_mode: TransposeMode = TransposeMode.PACK
    access_mode: AccessMode = AccessMode.WRITE
    compression: CompressionConfig = CompressionConfig()
    reshape_compression: CompressionConfig = CompressionConfig()

    @classmethod
    def load(cls, spark=None, **given) -> Config:
        """The settings that hold now."""
        out = {}
        for f in fields(cls):
            if f.name in given:
                out[f.name] = given[f.name]
                continue
            default = getattr(cls, f.name)
            if isinstance(default, CompressionConfig):  # gridshuttle.compression.rate, GRIDSHUTTLE_COMPRESSION_RATE
                parts = {p.name: (getattr(default, p.name), _setting(spark, f.name, p.name)) for p in fields(default)}
                out[f.name] = replace(default, **{k: _parsed(d, raw) for k, (d, raw) in parts.items() if raw is not None})
                continue
            raw = _setting(spark, f.name)
            if raw is not None:
                out[f.name] = _parsed(default, raw)
        return cls(**out).validate()

    def validate(self) -> Config:
        check(self.n_measure_warmup_iters >= 0, ErrorCode.INVALID_MEASURE_WARMUP_ITERS)
        check(self.n_measure_iters >= 1, ErrorCode.INVALID_MEASURE_ITERS)
        check(self.platform in set(Platform), ErrorCode.INVALID_PLATFORM)
        check(self.backend in set(Backend) and self.reshape_backend in set(Backend), ErrorCode.INVALID_BACKEND)
        check(self.transpose_mode in set(TransposeMode), ErrorCode.INVALID_TRANSPOSE_MODE)
        check(self.access_mode in set(AccessMode), ErrorCode.INVALID_ACCESS_MODE)
        self.compression.validate()
        self.reshape_compression.validate()
        return self

    def with_(self, **more) -> Config:
        return replace(self, **more).validate()


def _setting(spark, *name: str) -> str | None:
    raw = spark.conf.get(".".join((PREFIX, *name)), None) if spark is not None else None
    return raw if raw is not None else os.environ.get("_".join((PREFIX, *name)).upper())


def _parsed(default, raw: str):
    """``raw`` as the kind of ``default``; anything unreadable counts as unset."""
    text = str(raw).strip().lower()
    if isinstance(default, bool):
        return {"1": True, "true": True, "on": True, "yes": True, "0": False, "false": False, "off": False, "no": False}.get(text, default)
    if isinstance(default, (Platform, Backend, TransposeMode, AccessMode, CompressionLib, CompressionMode)):
        names = {e.name.lower(): e for e in type(default)}
        return names.get(text, default)
    try:
        return type(default)(text)
    except ValueError:
        return default
