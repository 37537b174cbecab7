"""Rows of lines: exchange, array transforms, plans, requests and reports."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridshuttle import Config, Effort, Execute, Executor, Layout, PlanC2C, PlanR2C, PlanR2R, R2RKind, Reshape, Transpose
from gridshuttle import enums as E
from gridshuttle import queries as Q
from gridshuttle.functions import array_fft, transforms
from gridshuttle.operators import lines
from gridshuttle.plans import decomposition as D
from gridshuttle.plans import plan as P
from gridshuttle.plans import physical
from gridshuttle.plans.plan import compatible
from gridshuttle.sources import grids as G

LINES = Config()


def complex_grid(spark, dims, seed=3):
    p = G.random_grid(spark, dims, seed)
    return p, G.collect_ndarray(p, dims)


@pytest.mark.parametrize("n", [1, 2, 17, 60, 97])
def test_array_transforms(spark, n):
    a = np.random.default_rng(n).normal(size=(2, n)) + 1j * np.random.default_rng(n + 1).normal(size=(2, n))
    rows = spark.createDataFrame([(x.real.tolist(), x.imag.tolist()) for x in a], "re array<double>, im array<double>")
    given = array_fft.complex_line(F.col("re"), F.col("im"))
    values = lambda found: np.array([[p["re"] + 1j * p["im"] for p in r[0]] for r in found.collect()])
    for forward in (True, False):
        assert np.allclose(values(rows.select(array_fft.fft(given, n, forward))), transforms.c2c(a, (1,), forward))
    half = np.fft.rfft(a.real, axis=1)
    assert np.allclose(values(rows.select(array_fft.r2c(F.col("re"), n))), half)
    back = spark.createDataFrame([(x.real.tolist(), x.imag.tolist()) for x in half], rows.schema).select(array_fft.c2r(given, n))
    assert np.allclose(np.array([r[0] for r in back.collect()]), transforms.c2r(half, 1, n))


@pytest.mark.parametrize("n", [2, 5, 12])
def test_array_real_kinds(spark, n):
    a = np.random.default_rng(n).normal(size=(2, n))
    rows = spark.createDataFrame([(x.tolist(),) for x in a], "v array<double>")
    for kind in R2RKind:
        assert np.allclose(np.array([r[0] for r in rows.select(array_fft.r2r(F.col("v"), n, kind)).collect()]), transforms.r2r(a, 1, kind)), kind


def test_steps_grow_with_n_log_n():
    """The steps' radices, not the length, say how often a point is read."""
    for n in (128, 1000, 1024, 9 * 7 * 5):
        assert sum(array_fft.radices(n)) <= 4 * np.log2(n)
    assert array_fft.radices(97) is None and array_fft.radices(1) == []


@pytest.mark.parametrize("more", [dict(parts=7), dict(parts=6, grid=(1, 3, 2)), dict(parts=3, grid=(1, 3, 1), config=LINES.with_(enable_y_slab=True)), dict(boxes=(2, 2, 1)), dict(boxes=(2, 1, 2)), dict(boxes=(2, 1, 1))])
@pytest.mark.parametrize("executor", [Executor.NUMPY, Executor.SQL])
def test_3d_ways_agree(spark, more, executor):
    dims, more = (7, 9, 5), dict(more)
    if more.get("boxes"):
        more["config"] = LINES.with_(enable_fourier_reshape=True, enable_z_slab=more["boxes"] == (2, 1, 1))
        more["boxes"] = D.brick_boxes(dims, more["boxes"])
    points, a = complex_grid(spark, dims)
    plan = PlanC2C(None if "boxes" in more else dims, executor=executor, **{"config": LINES, **more})
    f = plan.execute(points, Execute.FORWARD)
    assert np.allclose(G.collect_ndarray(f, dims), np.fft.fftn(a))
    assert np.allclose(G.collect_ndarray(plan.execute(f, Execute.BACKWARD), dims), a * a.size)


def test_half_spectra_single_precision_and_kinds(spark):
    dims = (9, 6, 5)
    points = G.random_grid(spark, dims, 5, ("v",))
    a = G.collect_ndarray(points, dims)
    for executor in (Executor.NUMPY, Executor.SQL):
        plan = PlanR2C(dims, 4, executor=executor)
        f = plan.execute(points, Execute.FORWARD)
        assert np.allclose(G.collect_ndarray(f, plan.spectral_dims), np.fft.rfftn(a)) and np.allclose(G.collect_ndarray(plan.execute(f, Execute.BACKWARD), dims), a * a.size)
        mixed = PlanR2R(dims, 3, kinds=[R2RKind.DCT_2, R2RKind.DST_1, R2RKind.DCT_4], executor=executor)
        assert np.allclose(G.collect_ndarray(mixed.execute(mixed.execute(points, Execute.FORWARD), Execute.BACKWARD), dims), a * mixed.round_trip_factor())
        single = PlanR2C(dims, 4, executor=executor, precision=E.Precision.SINGLE)
        f = single.execute(points, Execute.FORWARD)
        assert dict(f.dtypes)["re"] == "float" and np.allclose(G.collect_ndarray(f, plan.spectral_dims), np.fft.rfftn(a), rtol=1e-3, atol=1e-3)


def test_runs_and_the_plan(spark, monkeypatch):
    """Long lines are cut; the exchange is one shuffle without Python or points."""
    dims = (40, 33)
    points, a = complex_grid(spark, dims)
    assert lines.run_length(dims, (0,), (1,)) == 16 and lines.run_length((128, 128, 128), (0,), (1,)) == 128
    plan = PlanC2C(dims, 4)
    held = plan.scatter(points, Layout.X_PENCILS)
    moved = plan.transpose(held, Transpose.X_TO_Y)
    assert np.allclose(G.collect_ndarray(plan.gather(moved, Layout.Y_PENCILS), dims), a) and moved.count() == 40
    text = moved._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in text and text.count("Exchange ") == 2
    nodes = physical.executed(plan.transpose(plan.scatter(points, Layout.X_PENCILS), Transpose.X_TO_Y))
    assert len(physical.exchanges(nodes)) == 2 and "exchanges 2" in plan.report(moved)


def test_incomplete_grids_fail(spark):
    dims = (4, 4, 4)
    plan = PlanR2R(dims, 4, grid=(1, 2, 2))
    points = G.random_grid(spark, dims, 1, ("v",))
    for bad in (points.where("x + y + z > 0"), points.where("y > 0"), points.union(points.limit(1)), points.selectExpr("x + 1 AS x", "y", "z", "v"), points.selectExpr("x", "y + 1 AS y", "z", "v")):
        with pytest.raises(Exception, match="PENCIL_NOT_CONTINUOUS|outside"):
            plan.execute(bad, Execute.FORWARD).collect()


def test_lines_and_boxes_meet(spark):
    """Boxes with lines as reshape backend, and directions of both kinds."""
    dims = (6, 8, 4)
    points, a = complex_grid(spark, dims)
    plan = PlanC2C(boxes=D.brick_boxes(dims, (2, 2, 1)), executor=Executor.NUMPY, config=Q.BLOCK.with_(reshape_backend=E.Backend.MPI_DATATYPE))
    assert np.allclose(G.collect_ndarray(plan.execute(points, Execute.FORWARD), dims), np.fft.fftn(a))
    held = plan.scatter(points, Layout.X_BRICKS)
    there = plan.reshape(held, Reshape.X_BRICKS_TO_PENCILS)
    assert np.allclose(G.collect_ndarray(plan.gather(plan.reshape(there, Reshape.X_PENCILS_TO_BRICKS), Layout.X_BRICKS), dims), a)
    mixed = PlanC2C(dims, 6, grid=(1, 2, 3), executor=Executor.NUMPY, config=Q.BLOCK)
    mixed.directions = {(Layout.X_PENCILS, Layout.Y_PENCILS): E.Backend.MPI_DATATYPE, (Layout.Z_PENCILS, Layout.Y_PENCILS): E.Backend.MPI_DATATYPE}
    f = mixed.execute(points, Execute.FORWARD)
    assert np.allclose(G.collect_ndarray(f, dims), np.fft.fftn(a)) and np.allclose(G.collect_ndarray(mixed.execute(f, Execute.BACKWARD), dims), a * a.size)


def running(spark, tag):
    tracker = spark.sparkContext.statusTracker()
    return [j for j in tracker.getActiveJobsIds() if tag in str(spark.sparkContext._jsc.sc().statusStore().job(j).jobTags())]


def test_cancelled_request(spark):
    plan = PlanR2R((4, 4), 2)
    slow = F.udf(lambda v: time.sleep(0.5) or v, "double")
    points = G.random_grid(spark, (4, 4), 1, ("v",)).withColumn("v", slow("v"))
    request = plan.transpose_start(plan.scatter(points, Layout.X_PENCILS), Transpose.X_TO_Y)
    until = time.time() + 60
    while not running(spark, request.tag) and time.time() < until:
        time.sleep(0.05)
    assert running(spark, request.tag)
    plan.cancel(request)
    assert request.done and not running(spark, request.tag)
    assert Q.code_of(lambda: plan.transpose_end(request)) == 37 and Q.code_of(lambda: plan.cancel(request)) == 35
    again = plan.transpose_start(plan.scatter(G.random_grid(spark, (4, 4), 1, ("v",)), Layout.X_PENCILS), Transpose.X_TO_Y)
    assert plan.transpose_end(again).count() == 4


def test_failed_and_parallel_requests(spark):
    plan, other = PlanR2R((4, 4), 2), PlanR2R((4, 4), 2)
    points = G.random_grid(spark, (4, 4), 1, ("v",))
    bad = plan.transpose_start(plan.scatter(points.where("y > 0"), Layout.X_PENCILS), Transpose.X_TO_Y)
    good = other.transpose_start(other.scatter(points, Layout.X_PENCILS), Transpose.X_TO_Y)
    assert other.transpose_end(good).count() == 4
    with pytest.raises(Exception, match="PENCIL_NOT_CONTINUOUS"):
        plan.transpose_end(bad)
    path = spark._jvm.org.apache.hadoop.fs.Path(good.path)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    other.destroy()
    assert not files.exists(path) and threading.active_count() > 0


def test_size_guard(spark, monkeypatch):
    """Boxes beyond one value fail at once; lines move them all the same."""
    dims = (12, 9, 5)
    points, a = complex_grid(spark, dims)
    monkeypatch.setattr(P, "LARGEST_VALUE", 1000)
    assert Q.code_of(lambda: PlanC2C(dims, 2, config=Q.BLOCK)) == 19
    assert Q.code_of(lambda: PlanC2C((200, 4), 2)) == 19
    plan = PlanC2C(dims, 2, executor=Executor.NUMPY, config=LINES.with_(enable_z_slab=False))
    assert plan.alloc_bytes > 1000
    f = plan.execute(points, Execute.FORWARD)
    assert np.allclose(G.collect_ndarray(plan.execute(f, Execute.BACKWARD), dims), a * a.size)


def test_collector_fetches_boxes(spark):
    dims = (12, 9, 50)
    points, a = complex_grid(spark, dims)
    assert a.shape == (50, 9, 12) and np.array_equal(G.collect_ndarray(points, dims, box_values=200), a)
    with pytest.raises(Exception, match="PENCIL_NOT_CONTINUOUS"):
        G.collect_ndarray(points.where("z <> 3"), dims, box_values=200)


def test_tuning_times_lines_and_boxes(spark):
    plan = PlanR2C((6, 4, 4), 4, effort=Effort.PATIENT, spark=spark, config=Config(n_measure_warmup_iters=0, n_measure_iters=1, enable_mpi_backends=True))
    assert {"backend MPI_DATATYPE", "backend MPI_P2P"} <= {t.name for t in plan.timings}


def test_names_and_flags():
    assert E.backend_string(E.Backend.MPI_P2P) == "MPI_P2P" and E.backend_string(21) == "MPI_DATATYPE" and E.precision_string(0) == "SINGLE" and E.executor_string(1) == "NUMPY"
    assert E.is_numpy_enabled() and E.is_compression_enabled() and not E.is_cuda_enabled()
    for f in (E.backend_string, E.precision_string, E.executor_string):
        with pytest.raises(ValueError):
            f(99)


def test_backend_families():
    assert E.PIPELINED == {26, 27, 28, 30, 32, 33, 34, 35, 37} and E.FUSED == {32, 33, 34, 35, 37} and E.RMA == {29, 30, 33, 35} and E.COMPRESSED == {34, 35, 37}
    assert E.NCCL_FAMILY == {24, 27, 37} and E.CUFFTMP_FAMILY == {25, 28} and E.MPI_FAMILY == set(range(21, 36)) - {24, 25, 27, 28}
    assert [int(compatible(b, E.Backend.MPI_P2P)) for b in (E.Backend.NCCL, E.Backend.MPI_RMA)] == [22, 29]
