"""Layout tables: made, checked by joins, looked up by cut trees, planned from."""

import random

import numpy as np
import pytest

from gridshuttle import Execute, Executor, Layout, PlanC2C, PlanR2R, R2RKind
from gridshuttle import queries as Q
from gridshuttle.enums import Reshape
from gridshuttle.errors import GridError
from gridshuttle.plans import decomposition as D
from gridshuttle.plans import layouts as lay
from gridshuttle.sources import grids as G


def table(spark, boxes):
    return spark.createDataFrame([(r, 1, list(s), list(c), int(np.prod(c))) for r, (s, c) in enumerate(boxes)], D.LAYOUT_SCHEMA)


def shattered(rng, dims, pieces):
    """A tiling by random cuts of random boxes."""
    boxes = [((0,) * len(dims), tuple(dims))]
    while len(boxes) < pieces:
        k = rng.randrange(len(boxes))
        s, c = boxes[k]
        a = rng.randrange(len(dims))
        if c[a] > 1:
            at = rng.randrange(1, c[a])
            low, high = list(c), list(c)
            low[a], high[a] = at, c[a] - at
            start = list(s)
            start[a] += at
            boxes[k] = (s, tuple(low))
            boxes.append((tuple(start), tuple(high)))
    rng.shuffle(boxes)
    return boxes


@pytest.mark.parametrize("dims", [(40, 30), (20, 16, 12)])
@pytest.mark.parametrize("hot", [lay.HOT, 4])
def test_overlaps_equal_all_pairs(spark, dims, hot):
    rng = random.Random(7)
    boxes = shattered(rng, dims, 40)
    assert lay.overlaps(table(spark, boxes), hot).count() == 0 and lay.sizes_of(table(spark, boxes)) == dims
    boxes += [(tuple(rng.randrange(n) for n in dims), tuple(rng.choice([0, 1, 2, 9, 33]) for _ in dims)) for _ in range(12)] + [boxes[0], boxes[0]]
    full = [D.Box(s, c) for s, c in boxes]
    want = {(i, j) for i in range(len(full)) for j in range(i + 1, len(full)) if full[i].size and full[j].size and full[i].meets(full[j])}
    got = [tuple(r) for r in lay.overlaps(table(spark, boxes), hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_checks_agree_with_the_drivers(spark):
    for name, (boxes, code) in Q.CASES.items():
        rows = [(r, 1, None, None, None) if b is None else (r, 1, list(b.starts), list(b.counts), b.size) for r, b in enumerate(boxes)]
        assert Q.code_of(lambda rows=rows: lay.checked(spark.createDataFrame(rows, D.LAYOUT_SCHEMA))) == code, name
    odd = [([0, 0], [1, 1, 1], 25), ([0], [1], 26), ([0, 0], [1, -1], 27)]
    for s, c, code in odd:
        assert Q.code_of(lambda s=s, c=c: lay.checked(spark.createDataFrame([(0, 1, s, c, 1)], D.LAYOUT_SCHEMA))) == code
    dims = spark.createDataFrame([(34, 57, 12)], "nx int, ny int, nz int")
    for k in (Layout.X_PENCILS, Layout.Y_PENCILS, Layout.Z_PENCILS):
        got = lay.boxes_of(lay.pencil_table(dims, (1, 3, 5), k))
        assert got == D.pencil_boxes((34, 57, 12), (1, 3, 5), k)


@pytest.mark.parametrize("dims", [(23, 17), (11, 9, 13)])
def test_cut_tree_finds_every_point(spark, dims):
    boxes = shattered(random.Random(3), dims, 50)
    if len(dims) == 2:  # a pinwheel, which no straight cut takes apart
        boxes = [((0, 0), (15, 6)), ((15, 0), (8, 11)), ((8, 11), (15, 6)), ((0, 6), (8, 11)), ((8, 6), (7, 5))]
    tree = lay.CutTree([D.Box(s, c) for s, c in boxes])
    points = G.coordinates(spark, dims)
    for r in points.select("*", tree.rank(("x", "y", "z")[: len(dims)]).alias("rank")).collect():
        s, c = boxes[r["rank"]]
        assert all(a <= r[k] < a + n for k, a, n in zip("xyz", s, c, strict=False))


def test_plan_of_five_thousand_ranks(spark):
    dims, rng = (400, 300), random.Random(1)  # in three axes, boxes that start alike in two must be alike in both
    layout = table(spark, shattered(rng, dims, 5000))
    plan = PlanC2C(boxes=layout, executor=Executor.NUMPY)
    assert plan.parts == 5000 and plan.dims == dims and plan.reshape_enabled
    points = G.random_grid(spark, dims)
    a = G.collect_ndarray(points, dims)
    f = plan.execute(points, Execute.FORWARD)
    assert np.allclose(G.collect_ndarray(f, dims), np.fft.fftn(a))
    real = PlanR2R(boxes=layout, kinds=[R2RKind.DCT_2] * 2)
    held = real.scatter(points.selectExpr("x", "y", "re AS v"), Layout.X_BRICKS)
    sizes = {r["rank"]: r["n"] for r in real.placement(held, Layout.X_BRICKS).groupBy("rank").agg({"local_offset": "max"}).toDF("rank", "n").collect()}
    assert all(sizes[r] == b.size - 1 for r, b in enumerate(real.boxes(Layout.X_BRICKS)))


def test_block_exchange_of_an_irregular_layout(spark):
    dims = (24, 20)
    boxes = [D.Box(s, c) for s, c in shattered(random.Random(5), dims, 9)]
    plan = PlanC2C(boxes=boxes, executor=Executor.NUMPY, config=Q.BLOCK)
    points = G.random_grid(spark, dims)
    a = G.collect_ndarray(points, dims)
    f = plan.execute(points, Execute.FORWARD)
    assert np.allclose(G.collect_ndarray(f, dims), np.fft.fftn(a)) and np.allclose(G.collect_ndarray(plan.execute(f, Execute.BACKWARD), dims), a * a.size)


def test_checks_of_layouts_sort_and_send_little(spark):
    layout = table(spark, shattered(random.Random(2), (40, 30, 20), 60))
    assert "SortAggregate" not in lay.mismatches(layout)._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = lay.overlaps(layout)
        assert pairs.count() == 0
        plan = pairs._jdf.queryExecution()
        sent = plan.executedPlan().toString().split("Exchange hashpartitioning")[1].splitlines()[0]
        pairs.collect()
        done = plan.executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "levels" not in sent and "ReusedExchange" in done  # both sides read one shuffle
    large = [((0, 0), (1 << 29, 3)), (((1 << 29) - 1, 2), (1 << 29, 1 << 29))]
    assert [tuple(r) for r in lay.overlaps(table(spark, large)).collect()] == [(0, 1)]


def test_boxes_of_very_many_ranks_stay_in_their_table(spark):
    dims = (60, 50)
    boxes = shattered(random.Random(9), dims, 700)
    layout, points = table(spark, boxes), G.random_grid(spark, dims)
    plan = PlanC2C(boxes=layout, executor=Executor.NUMPY)
    back = G.scaled(plan.execute(plan.execute(points, Execute.FORWARD), Execute.BACKWARD), 60 * 50)
    assert G.max_error(points, back).first()[0] < 1e-12
    moved = plan.gather(plan.reshape(plan.reshape(plan.scatter(points, Layout.X_BRICKS), Reshape.X_BRICKS_TO_PENCILS), Reshape.X_PENCILS_TO_BRICKS), Layout.X_BRICKS)
    assert moved.exceptAll(points.select(moved.columns)).isEmpty() and moved.count() == 3000
    for layout_, held in ((Layout.X_BRICKS, boxes), (Layout.Y_PENCILS, [(b.starts, b.counts) for b in D.pencil_boxes(dims, (1, 700), Layout.Y_PENCILS)])):
        for r in plan.placement(plan.scatter(points, layout_), layout_).collect():
            (s, c), order = held[r["rank"]], D.order_of(layout_, 2)
            at = [r["xy"[a]] - s[a] for a in order]
            assert r["local_offset"] == at[0] + c[order[0]] * at[1] and 0 <= at[0] < c[order[0]] and 0 <= at[1] < c[order[1]]
    assert plan._user_boxes._boxes is None  # none of this fetched the boxes
    with pytest.raises(Exception, match="outside the grid"):
        plan.scatter(points.selectExpr("x", "y + 1 AS y", "re", "im"), Layout.X_BRICKS).collect()
    with pytest.raises(GridError):
        PlanC2C(boxes=layout.selectExpr("rank + 1 AS rank", "layout", "starts", "counts", "size"))


@pytest.mark.parametrize("dims,grid", [((34, 57, 12), (1, 3, 5)), ((7, 5, 40), (1, 9, 3)), ((33, 20), (1, 90))])
def test_pencils_are_worked_out_by_rank(spark, dims, grid):
    for k in (Layout.X_PENCILS, Layout.Y_PENCILS, Layout.Z_PENCILS)[: len(dims)]:
        pencils, boxes = lay.Pencils(dims, grid, k), D.pencil_boxes(dims, grid, k)
        assert list(pencils) == boxes
        for r in pencils.with_rank(G.coordinates(spark, dims)).collect():
            b = boxes[r["rank"]]
            assert all(s <= r[x] < s + c for x, s, c in zip("xyz", b.starts, b.counts, strict=False))
