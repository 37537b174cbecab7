"""Codecs, rates, trials and settings of the exchanges."""

import numpy as np
import pytest

from gridshuttle import Config, Effort, Execute, Executor, Layout, PlanC2C, PlanR2C, Transpose, version
from gridshuttle import queries as Q
from gridshuttle.config import CompressionConfig
from gridshuttle.enums import AccessMode, Backend, CompressionMode
from gridshuttle.functions import block_codec as B
from gridshuttle.functions import compression as C
from gridshuttle.functions import kernels as K
from gridshuttle.plans import decomposition as D
from gridshuttle.plans.plan import Rates
from gridshuttle.sources import grids as G

FEW = dict(enable_mpi_backends=True, n_measure_warmup_iters=0, n_measure_iters=2)


def smooth(*shape):
    at = np.meshgrid(*[np.arange(n) / 7 for n in shape], indexing="ij")
    return sum(np.sin(x + k) for k, x in enumerate(at)) * 1e3


@pytest.mark.parametrize("shape", [(33,), (17, 12), (9, 5, 13), (4, 4, 4), (1, 2, 3)])
@pytest.mark.parametrize("rough", [False, True])
def test_block_codec_bounds(shape, rough):
    x = smooth(*shape) + (np.random.default_rng(1).normal(size=shape) * 50 if rough else 0)
    d, top = len(shape), 2.0 ** (np.floor(np.log2(np.abs(x).max())) + 1)
    kept = lambda a, **c: C.decompress(C.compress(a, CompressionConfig(**c)), a.dtype, a.shape)
    for tolerance in (1.0, 1e-4, 1e-9, 1e-15):
        assert np.abs(kept(x, mode=CompressionMode.FIXED_ACCURACY, tolerance=tolerance) - x).max() <= tolerance
        single = x.astype("f4")
        assert np.abs(kept(single, mode=CompressionMode.FIXED_ACCURACY, tolerance=tolerance).astype("f8") - single).max() <= tolerance
    for bits in (2, 20, 40):
        bound = B.error_bound(d, max(B.planes_of(d) - bits, 0)) * top / 2.0**B.FRACTION
        assert np.abs(kept(x, mode=CompressionMode.FIXED_PRECISION, precision=bits) - x).max() <= bound
    errors = [np.abs(kept(x, mode=CompressionMode.FIXED_RATE, rate=r) - x).max() for r in (8.0, 16.0, 31.5)]
    assert errors[0] >= errors[1] >= errors[2] and errors[2] <= top * 1e-3
    for r in (2.0, 8.0, 12.5):
        data = C.compress(np.tile(x, (2,) * d), CompressionConfig(mode=CompressionMode.FIXED_RATE, rate=r))
        assert data[0] == C.RAW or len(data) == C.fixed_size(tuple(2 * n for n in shape), r)
    z = x + 1j * x[::-1]
    assert np.abs(kept(z, mode=CompressionMode.FIXED_ACCURACY, tolerance=1e-3) - z).max() <= 1.5e-3


def test_block_codec_decodes_into_other_axes():
    x = smooth(6, 9, 5)
    for mode in (CompressionMode.LOSSLESS, CompressionMode.FIXED_ACCURACY, CompressionMode.FIXED_RATE):
        data = C.compress(x, CompressionConfig(mode=mode, rate=20.0, tolerance=1e-3))
        plain = C.decompress(data, x.dtype, x.shape)
        for axes in ((0, 1, 2), (2, 0, 1), (1, 2, 0), (2, 1, 0)):
            assert (C.decompress(data, x.dtype, x.shape, axes) == plain.transpose(axes)).all()
    q = np.random.default_rng(2).integers(-(2**50), 2**50, (50, 4, 4, 4))
    assert (B.unlift(B.lift(q)) == q).all() and np.abs(B.lift(q)).max() < 2**57


def test_blocks_never_grow():
    raw = np.frombuffer(np.random.default_rng(1).bytes(8 * 50), "f8")
    for mode in (CompressionMode.LOSSLESS, CompressionMode.FIXED_RATE):
        c = CompressionConfig(mode=mode, rate=60.0)
        assert len(C.compress(raw, c)) <= raw.nbytes + 1
    kept = C.decompress(C.compress(raw, CompressionConfig()), raw.dtype, raw.shape)
    assert kept.tobytes() == raw.tobytes()
    zero = np.zeros(300)
    assert (C.decompress(C.compress(zero, CompressionConfig(mode=CompressionMode.FIXED_RATE)), zero.dtype, zero.shape) == 0).all()
    odd = np.array([np.inf, np.nan, 1.0])
    assert np.array_equal(C.decompress(C.compress(odd, CompressionConfig(mode=CompressionMode.FIXED_RATE)), odd.dtype, odd.shape), odd, equal_nan=True)


def test_groups_of_ranks():
    assert D.groups_of(range(7), 2) == [[0, 1], [2, 3], [4, 5], [6]] and D.groups_of(range(7), 2, strided=True) == [[0, 2, 4, 6], [1, 3, 5]]


def test_fused_kernels():
    a = np.arange(4 * 5 * 6.0).reshape(4, 5, 6)
    sub = a[1:3, 0:4, 2:5]
    assert (K.get_fused(K.permute_forward)(a, (2, 0, 1), (3, 4, 2)) == K.permute_forward(sub).ravel()).all()
    assert (K.get_fused(K.permute_backward)(a, (2, 0, 1), (3, 4, 2)) == K.permute_backward(sub).ravel()).all()
    assert K.get_fused(np.ascontiguousarray) is K.pack and (K.copy(a) == a).all() and K.copy(a) is not a


def test_access_modes_and_kernel_trials(spark, caplog):
    a = np.arange(4 * 5 * 6.0).reshape(4, 5, 6)
    for axes in ((2, 0, 1), (1, 2, 0), (0, 1, 2)):
        assert (K.written(a, axes) == a.transpose(axes)).all() and K.written(a, axes).flags.c_contiguous
    points = G.random_grid(spark, (6, 8, 4))
    want = np.fft.fftn(G.collect_ndarray(points, (6, 8, 4)))
    for access in AccessMode:
        plan = PlanC2C((6, 8, 4), 6, grid=(1, 2, 3), executor=Executor.NUMPY, config=Q.BLOCK.with_(access_mode=access))
        assert np.allclose(G.collect_ndarray(plan.execute(points, Execute.FORWARD), (6, 8, 4)), want)
    with caplog.at_level("INFO", "gridshuttle"):
        tuned = PlanC2C((6, 8, 4), 4, effort=Effort.EXHAUSTIVE, spark=spark, config=Config(backend=Backend.MPI_P2P, enable_datatype_backend=False, enable_kernel_autotune=True, enable_log=True, **FEW))
    assert {"kernel False", "kernel True"} <= {t.name for t in tuned.timings} and tuned.piecewise is not None and "backend MPI_P2P" in caplog.text


def test_trials(spark):
    plan = PlanC2C((6, 8, 4), 4, effort=Effort.PATIENT, config=Config(backend=Backend.ADAPTIVE, **FEW), executor=Executor.NUMPY)  # the active session
    steps = {(Layout.X_PENCILS, Layout.Z_PENCILS), (Layout.Z_PENCILS, Layout.X_PENCILS)} if plan.z_slab_enabled else None
    assert plan.directions and (steps is None or set(plan.directions) == steps) and all(t.shortest <= t.mean <= t.longest for t in plan.timings)
    points = G.random_grid(spark, (6, 8, 4))
    a = G.collect_ndarray(points, (6, 8, 4))
    assert np.allclose(G.collect_ndarray(plan.execute(points, Execute.FORWARD), (6, 8, 4)), np.fft.fftn(a))
    bricks = PlanR2C(boxes=D.brick_boxes((8, 8, 4), (2, 2, 1)), effort=Effort.EXHAUSTIVE, spark=spark, config=Config(**FEW), executor=Executor.NUMPY)
    names = [t.name for t in bricks.timings]
    assert f"reshape {bricks.reshape_backend.name}" in names and {"backend MPI_P2P", "reshape MPI_P2P", "reshape MPI_DATATYPE", "mode PACK"} <= set(names)
    with pytest.raises(Exception, match="BACKENDS_DISABLED"):
        PlanC2C((4, 4), 2, effort=Effort.PATIENT, spark=spark, config=Config(enable_datatype_backend=False))


def test_rates_of_the_running_exchange(spark):
    plan, rates = PlanC2C((12, 8), 3, config=Q.RATE), Rates("x to y")
    out = plan.transpose(plan.scatter(G.random_grid(spark, (12, 8)), Layout.X_PENCILS), Transpose.X_TO_Y, rates=rates)
    assert "compression of x to y" not in plan.report()
    assert out.count() == 3  # one job moves the boxes and measures them
    found = rates.get()
    assert found["raw"] == 12 * 8 * 16 and 1 < found["lowest"] <= found["mean"] <= found["highest"] and "compression of x to y: from" in plan.report()


def test_codec_settings(monkeypatch):
    monkeypatch.setenv("GRIDSHUTTLE_COMPRESSION_MODE", "fixed_rate")
    monkeypatch.setenv("GRIDSHUTTLE_COMPRESSION_RATE", "20")
    monkeypatch.setenv("GRIDSHUTTLE_RESHAPE_COMPRESSION_PRECISION", "9")
    c = Config.load()
    assert (c.compression.mode, c.compression.rate, c.reshape_compression.precision, c.reshape_compression.mode) == (CompressionMode.FIXED_RATE, 20.0, 9, CompressionMode.LOSSLESS)
    assert version(3, 2, 1) > version(3, 2, 0) > version(3, 1, 9) and version() == version(0, 2, 0)
