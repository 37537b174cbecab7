"""Plans against NumPy for every number of ranks, layouts, settings, requests."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from gridshuttle import Config, Execute, Executor, GridError, Layout, PlanC2C, PlanR2C, PlanR2R, Precision, R2RKind, Reshape, Transpose, error_string
from gridshuttle import queries as Q
from gridshuttle.enums import Backend, Effort, TransposeMode
from gridshuttle.plans import decomposition as D
from gridshuttle.sources import grids as G

BLOCK = Q.BLOCK


def test_split():
    assert [D.split(10, 4, r) for r in range(4)] == [(0, 2), (2, 2), (4, 3), (7, 3)]
    for n in range(1, 30):
        for p in range(1, 9):
            parts = [D.split(n, p, r) for r in range(p)]
            assert [s for s, _ in parts] == [sum(c for _, c in parts[:k]) for k in range(p)] and sum(c for _, c in parts) == n


@pytest.mark.parametrize("p", range(1, 9))
@pytest.mark.parametrize("dims", [(34, 57), (12, 8, 4), (5, 3, 2)])
def test_layouts_tile(p, dims):
    plan = PlanC2C(dims, p)
    for k in D.ORDERS[len(dims)]:
        assert D.validate_boxes(plan.boxes(k)) == dims
    assert plan.alloc_size >= max(b.size for b in plan.boxes(Layout.X_PENCILS)) and "grid" in plan.report()
    bricks = D.brick_boxes(dims, (2, 2) if len(dims) == 2 else (2, 2, 1))
    assert D.validate_boxes(bricks) == dims and D.validate_boxes(D.pencils_from_bricks(bricks)) == dims


def test_layout_cases():
    for name, (boxes, code) in Q.CASES.items():
        assert Q.code_of(lambda b=boxes: D.validate_boxes(b)) == code, name
    for name, (f, code) in Q.WRONG.items():
        assert Q.code_of(f) == code, name
    assert D.default_grid((64, 48, 32), 8) == ((1, 1, 8), True, False) and D.default_grid((64, 48, 2), 8, y_slab=True) == ((1, 8, 1), False, True)
    assert D.default_grid((4, 4, 4), 6)[0] == (1, 3, 2) and D.dims_create(12, 2) == (4, 3)


def complex_grid(spark, dims, seed=3):
    p = G.random_grid(spark, dims, seed)
    return p, G.collect_ndarray(p, dims)


@pytest.mark.parametrize("p", [1, 2, 3, 5, 8])
def test_2d_every_rank_count(spark, p):
    dims = (17, 12)
    points, a = complex_grid(spark, dims)
    plan = PlanC2C(dims, p, executor=Executor.NUMPY, config=BLOCK)
    f = plan.execute(points, Execute.FORWARD)
    assert np.allclose(G.collect_ndarray(f, dims), np.fft.fft2(a))
    assert np.allclose(G.collect_ndarray(plan.execute(f, Execute.BACKWARD), dims), a * 17 * 12)


@pytest.mark.parametrize("more", [dict(parts=7), dict(parts=6, grid=(1, 3, 2)), dict(parts=3, grid=(1, 3, 1), config=BLOCK.with_(enable_y_slab=True)), dict(parts=4, config=Config()), dict(boxes=(2, 2, 1)), dict(boxes=(2, 1, 2)), dict(boxes=(3, 1, 2)), dict(parts=9)])
def test_3d_ways_agree(spark, more):
    dims = (7, 9, 5)
    more = dict(more)
    if more.get("boxes"):
        more["boxes"] = D.brick_boxes(dims, more["boxes"])
        more["config"] = BLOCK.with_(enable_fourier_reshape=True, enable_z_slab=False)
    points, a = complex_grid(spark, dims)
    plan = PlanC2C(None if "boxes" in more else dims, executor=Executor.NUMPY, **{"config": BLOCK, **more})
    f = plan.execute(points, Execute.FORWARD)
    assert np.allclose(G.collect_ndarray(f, dims), np.fft.fftn(a))
    assert np.allclose(G.collect_ndarray(plan.execute(f, Execute.BACKWARD), dims), a * a.size)


@pytest.mark.parametrize("dims", [(8, 5), (9, 5), (9, 4, 6)])
@pytest.mark.parametrize("executor", [Executor.NUMPY, Executor.SQL])
def test_real_to_complex(spark, dims, executor):
    points = G.random_grid(spark, dims, 5, ("v",))
    a = G.collect_ndarray(points, dims)
    plan = PlanR2C(dims, 3, executor=executor, config=BLOCK)
    f = plan.execute(points, Execute.FORWARD)
    assert np.allclose(G.collect_ndarray(f, plan.spectral_dims), np.fft.rfftn(a))
    assert np.allclose(G.collect_ndarray(plan.execute(f, Execute.BACKWARD), dims), a * a.size)


def test_single_precision(spark):
    dims = (12, 10)
    points, a = complex_grid(spark, dims)
    plan = PlanC2C(dims, 4, executor=Executor.NUMPY, precision=Precision.SINGLE, config=BLOCK)
    f = plan.execute(points, Execute.FORWARD)
    assert dict(f.dtypes)["re"] == "float" and plan.element_size == 8
    assert np.allclose(G.collect_ndarray(f, dims), np.fft.fft2(a), rtol=1e-4, atol=1e-4)


def test_incomplete_grids_fail(spark):
    dims = (4, 4)
    plan = PlanR2R(dims, 2, config=BLOCK)
    points = G.random_grid(spark, dims, 1, ("v",))
    for bad in (points.where("x + y > 0"), points.union(points.limit(1)), points.selectExpr("x + 1 AS x", "y", "v")):
        with pytest.raises(Exception, match="PENCIL_NOT_CONTINUOUS|INVALID_LAYOUT"):
            plan.execute(bad, Execute.FORWARD).collect()


def test_more_ranks_than_points(spark):
    dims = (3, 2)
    points, a = complex_grid(spark, dims)
    plan = PlanC2C(dims, 5, executor=Executor.NUMPY, config=BLOCK)
    assert np.allclose(G.collect_ndarray(plan.execute(points, Execute.FORWARD), dims), np.fft.fft2(a))


def test_requests(spark):
    dims = (6, 5)
    points, a = complex_grid(spark, dims)
    plan = PlanC2C(dims, 3, config=BLOCK)
    held = plan.scatter(points, Layout.X_PENCILS)
    r = plan.transpose_start(held, Transpose.X_TO_Y)
    assert int(r) == r.handle and r.kind == "transpose" and "handle" in repr(r)
    assert Q.code_of(lambda: plan.transpose_start(held, Transpose.X_TO_Y)) == 36 and Q.code_of(lambda: plan.execute(points, Execute.FORWARD)) == 36
    assert Q.code_of(lambda: plan.transpose_end(10**9)) == 35
    assert np.allclose(G.collect_ndarray(plan.gather(plan.transpose_end(int(r)), Layout.Y_PENCILS), dims), a)
    assert Q.code_of(lambda: plan.transpose_end(r)) == 37
    bricks = PlanC2C(boxes=D.brick_boxes((6, 8), (2, 2)), config=BLOCK)
    assert not bricks.fourier_reshape
    flat = PlanC2C(boxes=D.brick_boxes((6, 8), (2, 2)), executor=Executor.NUMPY, config=BLOCK.with_(enable_fourier_reshape=True))
    points, a = complex_grid(spark, (6, 8))
    assert flat.fourier_reshape and D.validate_boxes(flat.boxes(Layout.Z_BRICKS)) == (6, 8)
    f = flat.execute(points, Execute.FORWARD)
    assert np.allclose(G.collect_ndarray(f, (6, 8)), np.fft.fft2(a)) and np.allclose(G.collect_ndarray(flat.execute(f, Execute.BACKWARD), (6, 8)), a * 48)
    r = bricks.reshape_start(bricks.scatter(points, Layout.X_BRICKS), Reshape.X_BRICKS_TO_PENCILS)
    assert Q.code_of(lambda: bricks.execute(points, Execute.FORWARD)) == 39
    assert np.allclose(G.collect_ndarray(bricks.gather(bricks.reshape_end(r), Layout.X_PENCILS), (6, 8)), a)
    plan.destroy()
    assert Q.code_of(lambda: plan.execute(points, Execute.FORWARD)) == 1


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("GRIDSHUTTLE_ENABLE_Z_SLAB", "0")
    monkeypatch.setenv("GRIDSHUTTLE_BACKEND", "mpi_p2p")
    monkeypatch.setenv("GRIDSHUTTLE_N_MEASURE_ITERS", "nonsense")
    c = Config.load()
    assert not c.enable_z_slab and c.backend == Backend.MPI_P2P and c.n_measure_iters == 5
    spark.conf.set("gridshuttle.enable_z_slab", "true")
    try:
        assert Config.load(spark).enable_z_slab and not Config.load(spark, enable_z_slab=False).enable_z_slab
    finally:
        spark.conf.unset("gridshuttle.enable_z_slab")
    assert error_string(29) == "pencil shape mismatch" and isinstance(GridError(2), RuntimeError)


def test_tuning(spark):
    plan = PlanC2C((6, 4, 4), 4, effort=Effort.EXHAUSTIVE, spark=spark, config=Config(n_measure_warmup_iters=0, n_measure_iters=1, enable_mpi_backends=True), executor=Executor.NUMPY)
    assert len(plan.timings) >= 5 and plan.transpose_mode in set(TransposeMode)
    points, a = complex_grid(spark, (6, 4, 4))
    assert np.allclose(G.collect_ndarray(plan.execute(points, Execute.FORWARD), (6, 4, 4)), np.fft.fftn(a))


def test_mixed_kinds(spark):
    dims, kinds = (8, 12), [R2RKind.DST_2, R2RKind.DST_3]
    points = G.random_grid(spark, dims, 5, ("v",))
    a = G.collect_ndarray(points, dims)
    plan = PlanR2R(dims, 3, kinds=kinds, executor=Executor.NUMPY, config=BLOCK)
    back = plan.execute(plan.execute(points, Execute.FORWARD), Execute.BACKWARD)
    assert np.allclose(G.collect_ndarray(back, dims), a * plan.round_trip_factor())


def test_entry(spark):
    assert entry.entry(spark).count() == 24 * 17
    assert set(entry.oracle_sql()) <= set(entry.queries())
    random.seed(0)


def test_one_shuffle_a_step(spark):
    """A plan of two layouts shuffles twice: into the first, and between them."""
    points, _ = complex_grid(spark, (8, 6, 4))
    f = PlanC2C((8, 6, 4), 4, executor=Executor.NUMPY, config=BLOCK).execute(points, Execute.FORWARD)
    assert f._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2


def test_round_trip_keeps_boxes_that_fit_a_task(spark):
    from gridshuttle import queries as Q
    from gridshuttle.plans import decomposition as D
    from gridshuttle.sources import grids as G

    for dims in ((1000, 35, 50), (60_000, 35, 50), (360_000, 35, 50), (53, 7, 1), (4096, 4096)):
        grid = D.grid_of_boxes(dims, Q.BOX_VALUES, 8)
        boxes = [b for k in (Q.Layout.X_PENCILS, Q.Layout.Y_PENCILS) for b in D.pencil_boxes(dims, grid, k)]
        assert max(b.size for b in boxes) <= 2 * Q.BOX_VALUES and min(b.size for b in boxes) > 0, (dims, grid)
    dims = (12, 9, 5)
    for grid in (D.grid_of_boxes(dims, 1 << 20, 4), D.grid_of_boxes(dims, 40)):
        plan, points = Q.PlanC2C(dims, grid=grid, executor=Q.NP, config=Q.BLOCK), G.random_grid(spark, dims, seed=5)
        back = G.scaled(plan.round_trip(points), 12 * 9 * 5)
        r = G.random_error(back, dims, seed=5).first()
        assert r["points"] == 540 and r["max_error"] < 1e-12
        assert abs(r["max_error"] - G.max_error(points, back).first()[0]) < 1e-15
    assert G.random_error(points.where("x > 0"), dims, seed=5).first()["points"] == 495
    bricks = Q.spectral_plan(Q.PlanR2C, executor=Q.NP)
    real = G.random_grid(spark, Q.LI, values=("v",))
    assert G.random_error(G.scaled(bricks.round_trip(real), 384), Q.LI).first()["max_error"] < 1e-12
