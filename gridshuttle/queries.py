"""The registered queries and the SQL they are held against."""

from __future__ import annotations

from math import prod

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .config import CompressionConfig, Config
from .enums import Backend, CompressionMode, Effort, Execute, Executor, Layout, Precision, R2RKind, Reshape, Transpose, TransposeMode
from .errors import GridError
from .functions import block_codec, kernels
from .operators import exchange as ex
from .plans import decomposition as dec
from .plans import layouts as lay
from .plans.physical import exchanges, executed
from .plans.plan import PlanC2C, PlanR2C, PlanR2R, Rates
from .ship import ship
from .sources import grids

QUERIES: dict = {}
SQL: dict[str, str] = {}
AX = ("x", "y", "z")
LI, EV = (12, 8, 4), (24, 17)
BLOCK = Config(backend=Backend.MPI_P2P, reshape_backend=Backend.MPI_P2P)
NP = Executor.NUMPY


def add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in ("re", "im", "v") else F.col(c) for c in df.columns])


# --- SQL of the input grids and of transforms along one axis

LI_SQL = """(SELECT a.x, a.y, a.z, coalesce(sum(l_quantity), 0) / 1000 AS v FROM
 (SELECT CAST(i % 12 AS INT) AS x, CAST(i // 12 % 8 AS INT) AS y, CAST(i // 96 AS INT) AS z FROM range(384) t(i)) a LEFT JOIN
 (SELECT month(l_shipdate) - 1 AS x, l_suppkey % 8 AS y, l_linenumber % 4 AS z, l_quantity FROM lineitem) l ON a.x = l.x AND a.y = l.y AND a.z = l.z GROUP BY a.x, a.y, a.z)"""
EV_SQL = """(SELECT a.x, a.y, CAST(count(e.x) AS DOUBLE) AS v FROM (SELECT CAST(i % 24 AS INT) AS x, CAST(i // 24 AS INT) AS y FROM range(408) t(i)) a LEFT JOIN
 (SELECT hour(ts) AS x, user_id % 17 AS y FROM events) e ON a.x = e.x AND a.y = e.y GROUP BY a.x, a.y)"""
EM_SQL = "(SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS x, CAST(vec_id AS INT) AS y, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
EM_N = "(SELECT max(vec_id) + 1 FROM embeddings)"


def sql_complex(grid: str, axes: str) -> str:
    return f"(SELECT {', '.join(axes)}, v AS re, CAST(0 AS DOUBLE) AS im FROM {grid})"


def sql_dft(grid: str, axes: str, axis: str, n, forward: bool = True, last=None) -> str:
    sign, t = ("+", "-") if forward else ("-", "+"), f"2 * pi() * ((CAST(s.{axis} AS BIGINT) * f.k) % {n}) / {n}"
    keys = [a for a in axes if a != axis]
    top = f"{n}" if last is None else f"{last} + 1"
    return f"""(SELECT {', '.join([*(f's.{k}' for k in keys), f'CAST(f.k AS INT) AS {axis}'])}, sum(s.re * cos({t}) {sign[0]} s.im * sin({t})) AS re, sum(s.im * cos({t}) {sign[1]} s.re * sin({t})) AS im
 FROM {grid} s CROSS JOIN (SELECT unnest(range(0, {top})) AS k) f GROUP BY {', '.join([*(f's.{k}' for k in keys), 'f.k'])})"""


def sql_all(grid: str, dims, forward: bool = True) -> str:
    axes = AX[: len(dims)]
    out = sql_complex(grid, axes)
    for a, n in zip(axes, dims, strict=True):
        out = sql_dft(out, axes, a, n, forward)
    return out


def sql_half(grid: str, dims) -> str:
    axes = AX[: len(dims)]
    out = sql_dft(sql_complex(grid, axes), axes, "x", dims[0], True, dims[0] // 2)
    for a, n in list(zip(axes, dims, strict=True))[1:]:
        out = sql_dft(out, axes, a, n)
    return out


def sql_round(grid: str, axes, values=("re", "im"), digits: int = 6, scale: str = "1") -> str:
    return f"SELECT {', '.join(axes)}, {', '.join(f'round({v} / {scale}, {digits}) + 0.0 AS {v}' for v in values)} FROM {grid}"


R2R_SQL = {  # kernel of input j and output k on an axis of n
    R2RKind.DCT_1: "CASE WHEN j = 0 THEN 1 WHEN j = {n} - 1 THEN CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END ELSE 2 * cos(pi() * ((j * k) % (2 * ({n} - 1))) / ({n} - 1)) END",
    R2RKind.DCT_2: "2 * cos(pi() * (((2 * j + 1) * k) % (4 * {n})) / (2 * {n}))",
    R2RKind.DCT_3: "CASE WHEN j = 0 THEN 1 ELSE 2 * cos(pi() * ((j * (2 * k + 1)) % (4 * {n})) / (2 * {n})) END",
    R2RKind.DCT_4: "2 * cos(pi() * (((2 * j + 1) * (2 * k + 1)) % (8 * {n})) / (4 * {n}))",
    R2RKind.DST_1: "2 * sin(pi() * (((j + 1) * (k + 1)) % (2 * ({n} + 1))) / ({n} + 1))",
    R2RKind.DST_2: "2 * sin(pi() * (((2 * j + 1) * (k + 1)) % (4 * {n})) / (2 * {n}))",
    R2RKind.DST_3: "CASE WHEN j = {n} - 1 THEN CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END ELSE 2 * sin(pi() * (((j + 1) * (2 * k + 1)) % (4 * {n})) / (2 * {n})) END",
    R2RKind.DST_4: "2 * sin(pi() * (((2 * j + 1) * (2 * k + 1)) % (8 * {n})) / (4 * {n}))",
}


def sql_r2r(grid: str, axes, axis: str, n: int, kind: R2RKind) -> str:
    keys = [a for a in axes if a != axis]
    own = ", ".join([*keys, f"CAST(k AS INT) AS {axis}"])
    return f"(SELECT {own}, sum(v * ({R2R_SQL[kind].format(n=n)})) AS v FROM (SELECT *, CAST({axis} AS BIGINT) AS j FROM {grid}) CROSS JOIN (SELECT unnest(range(0, {n})) AS k) GROUP BY {', '.join([*keys, 'k'])})"


# --- layouts


def flat(spark: SparkSession, boxes) -> DataFrame:
    names = [f"{a}_{w}" for a in AX[: len(boxes[0].starts)] for w in ("start", "count")]
    rows = [(r, *(int(v) for s, c in zip(b.starts, b.counts, strict=True) for v in (s, c)), b.size) for r, b in enumerate(boxes)]
    return spark.createDataFrame(rows, ", ".join(["rank int", *(f"{n} int" for n in names), "size long"]))


def sql_split(n: int, p: int, c: str) -> tuple[str, str]:
    return f"({c} * {n // p} + greatest(0, {c} - {p - n % p}))", f"({n // p} + CASE WHEN {c} >= {p - n % p} THEN 1 ELSE 0 END)"


def sql_coords(grid) -> list[str]:
    """Grid coordinates of rank r, the last fastest."""
    out, below = [], 1
    for g in reversed(grid):
        out.append(f"(r // {below} % {g})")
        below *= g
    return out[::-1]


def sql_boxes(dims, grid, layout: Layout) -> str:
    """(rank, starts and counts of each axis) of a pencil layout."""
    who = {Layout.X_PENCILS: (0, 1, 2), Layout.Y_PENCILS: (1, 0, 2), Layout.Z_PENCILS: (1, 2, 0)}[layout]
    c = sql_coords(grid)
    cols = []
    for a, (n, k) in enumerate(zip(dims, who, strict=False)):
        s, t = sql_split(n, grid[k], c[k])
        cols += [f"CAST({s} AS INT) AS {AX[a]}_start", f"CAST({t} AS INT) AS {AX[a]}_count"]
    return f"(SELECT CAST(r AS INT) AS rank, {', '.join(cols)} FROM range({prod(grid)}) t(r))"


#: Sizes of a grid that a table gives: suppliers, five places a line number, quantities.
SIZES_SQL = "(SELECT count(DISTINCT l_suppkey) AS nx, 5 * max(l_linenumber) AS ny, count(DISTINCT l_quantity) AS nz FROM lineitem)"
BIG_GRID = (1, 2, 3)


def table_sizes(spark, sf_dir) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.agg(F.countDistinct("l_suppkey").alias("nx"), (5 * F.max("l_linenumber")).alias("ny"), F.countDistinct("l_quantity").alias("nz"))


def table_dims(spark, sf_dir) -> tuple[int, ...]:
    return tuple(table_sizes(spark, sf_dir).first())  # one row


def sql_table_boxes(grid, layout: Layout, half: bool = False) -> str:
    """The pencil layout of the table's grid (or half spectrum), flat."""
    who = {Layout.X_PENCILS: (0, 1, 2), Layout.Y_PENCILS: (1, 0, 2), Layout.Z_PENCILS: (1, 2, 0)}[layout]
    c, cols = sql_coords(grid), []
    for a, k in enumerate(who):
        n = "(nx // 2 + 1)" if half and a == 0 else f"n{AX[a]}"
        late = f"greatest(0, {c[k]} - ({grid[k]} - {n} % {grid[k]}))"
        cols += [f"CAST({c[k]} * ({n} // {grid[k]}) + {late} AS INT) AS {AX[a]}_start", f"CAST({n} // {grid[k]} + CASE WHEN {c[k]} >= {grid[k]} - {n} % {grid[k]} THEN 1 ELSE 0 END AS INT) AS {AX[a]}_count"]
    return f"(SELECT CAST(r AS INT) AS rank, {', '.join(cols)} FROM {SIZES_SQL}, range({prod(grid)}) t(r))"


def flat(layout: DataFrame) -> DataFrame:
    return layout.select("rank", *[F.get(w, F.lit(a)).alias(f"{AX[a]}_{w[:-1]}") for a in range(3) for w in ("starts", "counts")], "size")


for _l in (Layout.X_PENCILS, Layout.Y_PENCILS, Layout.Z_PENCILS):

    @add(f"layout_{_l.name.lower()}", f"SELECT *, CAST(x_count * y_count * z_count AS BIGINT) AS size FROM {sql_table_boxes(BIG_GRID, _l)}")
    def _(spark, sf_dir, layout=_l):
        return flat(lay.pencil_table(table_sizes(spark, sf_dir), BIG_GRID, layout))


@add(
    "layout_bricks",
    f"""SELECT CAST(r AS INT) AS rank, CAST(r % 2 * (nx // 2) AS INT) AS x_start, CAST(nx // 2 + CASE WHEN r % 2 = 1 THEN nx % 2 ELSE 0 END AS INT) AS x_count,
 CAST(r // 2 % 3 * (ny // 3) AS INT) AS y_start, CAST(ny // 3 + CASE WHEN r // 2 % 3 = 2 THEN ny % 3 ELSE 0 END AS INT) AS y_count,
 CAST(r // 6 * (nz // 2) AS INT) AS z_start, CAST(nz // 2 + CASE WHEN r // 6 = 1 THEN nz % 2 ELSE 0 END AS INT) AS z_count,
 CAST(x_count * y_count * z_count AS BIGINT) AS size FROM {SIZES_SQL}, range(12) t(r)""",
)
def _(spark, sf_dir):
    return flat(dec.layout_frame(spark, dec.brick_boxes(table_dims(spark, sf_dir), (2, 3, 2)), Layout.X_BRICKS))


_VOLUME = "{0}.x_count * {0}.y_count * {0}.z_count".format


@add(
    "local_sizes",
    f"""SELECT rank, {_VOLUME('a')} AS in_size, {_VOLUME('b')} AS out_size, CAST(greatest({_VOLUME('a')}, 2 * {_VOLUME('f')}, 2 * {_VOLUME('c')}, 2 * {_VOLUME('b')}) AS BIGINT) AS alloc_size
 FROM {sql_table_boxes(BIG_GRID, Layout.X_PENCILS)} a JOIN {sql_table_boxes(BIG_GRID, Layout.X_PENCILS, True)} f USING (rank)
 JOIN {sql_table_boxes(BIG_GRID, Layout.Y_PENCILS, True)} c USING (rank) JOIN {sql_table_boxes(BIG_GRID, Layout.Z_PENCILS, True)} b USING (rank)""",
)
def _(spark, sf_dir):
    plan = PlanR2C(table_dims(spark, sf_dir), 6, grid=BIG_GRID)
    rows = [(s["rank"], int(prod(s["in_counts"])), int(prod(s["out_counts"])), int(s["alloc_size"])) for s in plan.local_sizes()]
    return spark.createDataFrame(rows, "rank int, in_size int, out_size int, alloc_size long")


_FLAGS = " UNION ALL ".join(
    f"SELECT '{k.name}' AS layout, count(DISTINCT (x_count, y_count, z_count)) = 1 AS is_even, count(DISTINCT x_start) > 1 AS splits_x FROM {sql_table_boxes(BIG_GRID, k)}" for k in (Layout.X_PENCILS, Layout.Y_PENCILS, Layout.Z_PENCILS)
)


@add("even_flags", _FLAGS)
def _(spark, sf_dir):
    dims, rows = table_dims(spark, sf_dir), []
    for k in (Layout.X_PENCILS, Layout.Y_PENCILS, Layout.Z_PENCILS):
        b = dec.pencil_boxes(dims, BIG_GRID, k)
        rows.append((k.name, dec.is_even(b), dec.is_distributed(b)))
    return spark.createDataFrame(rows, "layout string, is_even boolean, splits_x boolean")


def _boxes(*rows) -> list[dec.Box]:
    return [dec.Box(tuple(s), tuple(c)) for s, c in rows]


#: Fixed test layouts of four ranks and the code each must give.
CASES = {
    "shape mismatch": (_boxes(((0, 0, 0), (4, 12, 12)), ((0, 8, 0), (4, 8, 12)), ((0, 8, 12), (4, 8, 12)), ((0, 0, 12), (4, 8, 12))), 29),
    "overlap": (_boxes(((0, 0, 0), (4, 8, 12)), ((0, 0, 0), (4, 8, 12)), ((0, 0, 12), (4, 8, 12)), ((0, 0, 13), (4, 8, 12))), 30),
    "not continuous": (_boxes(((0, 0, 0), (4, 8, 12)), ((0, 10, 0), (4, 8, 12)), ((0, 10, 12), (4, 8, 12)), ((0, 0, 12), (4, 8, 12))), 31),
    "valid": (_boxes(((0, 0, 0), (4, 8, 12)), ((0, 8, 0), (4, 8, 12)), ((0, 8, 12), (4, 8, 12)), ((0, 0, 12), (4, 8, 12))), 0),
    "negative start": (_boxes(((-1, 0, 0), (4, 8, 12)), ((0, 0, 0), (4, 8, 12)), ((0, 0, 8), (4, 8, 12)), ((0, 0, 8), (4, 8, 12))), 28),
    "uninitialised": ([None, None, None, None], 32),
}


def code_of(f) -> int:
    try:
        f()
    except GridError as e:
        return int(e.code)
    return 0


#: A box an order: tiles of 5 x 7 x 3 in blocks of ten by ten, and what is wrong with some.
FAULTS = {
    "valid": {}, "shape mismatch": {"x_count": "CASE WHEN o_orderkey % 997 = 5 THEN 6 ELSE 5 END"}, "overlap": {"z_start": "3 * (o_orderkey DIV 100) + CASE WHEN o_orderkey % 1499 = 7 THEN 1 ELSE 0 END"},
    "not continuous": {"filter": "o_orderkey % 1009 <> 3"}, "negative start": {"y_start": "7 * (o_orderkey DIV 10 % 10) - CASE WHEN o_orderkey = 11 THEN 8 ELSE 0 END"}, "uninitialised": {"y_count": "CASE WHEN o_orderkey <> 12 THEN 7 END"},
}
CODES = {"valid": 0, "shape mismatch": 29, "overlap": 30, "not continuous": 31, "negative start": 28, "uninitialised": 27}
_TILE = {"x_start": "5 * (o_orderkey % 10)", "x_count": "5", "y_start": "7 * (o_orderkey DIV 10 % 10)", "y_count": "7", "z_start": "3 * (o_orderkey DIV 100)", "z_count": "3"}


def tiles(spark, sf_dir, *faults) -> DataFrame:
    """The layout table of all orders with the faults of that name."""
    how = dict(_TILE)
    for f in faults:
        how |= FAULTS[f]
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").where(how.pop("filter", "true"))
    c = {k: F.expr(v).cast("int") for k, v in how.items()}
    counts = F.array(*[c[f"{a}_count"] for a in AX])
    return t.select(F.col("o_orderkey").cast("int").alias("rank"), F.lit(int(Layout.X_BRICKS)).alias("layout"), F.array(*[c[f"{a}_start"] for a in AX]).alias("starts"), counts.alias("counts"), F.aggregate(counts, F.lit(1).cast("long"), lambda a, n: a * n).alias("size"))


def tiles_sql(*faults) -> str:
    how = dict(_TILE)
    for f in faults:
        how |= FAULTS[f]
    keep = how.pop("filter", "true")
    return f"(SELECT CAST(o_orderkey AS INT) AS rank, {', '.join(f'CAST({v} AS INT) AS {k}' for k, v in how.items()).replace(' DIV ', ' // ')} FROM orders WHERE {keep})"


@add("layout_errors", " UNION ALL ".join(f"SELECT '{n}' AS name, {c} AS code, CAST(count(*) AS BIGINT) AS boxes FROM {tiles_sql(n)}" for n, c in CODES.items()))
def _(spark, sf_dir):
    """The first error of layout tables with a box an order."""
    return spark.createDataFrame([(n, code_of(lambda t=t: lay.checked(t)), t.count()) for n, t in ((n, tiles(spark, sf_dir, n)) for n in CODES)], "name string, code int, boxes long")


_APART = " AND ".join(f"a.{x}_start < b.{x}_start + b.{x}_count AND b.{x}_start < a.{x}_start + a.{x}_count" for x in AX)


@add("box_overlap", f"SELECT a.rank AS rank_a, b.rank AS rank_b FROM {tiles_sql('shape mismatch', 'overlap')} a JOIN {tiles_sql('shape mismatch', 'overlap')} b ON a.rank < b.rank AND {_APART}")
def _(spark, sf_dir):
    """All pairs of boxes that meet, by a join on cells."""
    return lay.overlaps(tiles(spark, sf_dir, "shape mismatch", "overlap"))


@add(
    "box_mismatch",
    " UNION ALL ".join(
        f"SELECT {i} AS axis_a, {j} AS axis_b, {AX[i]}_start AS start_a, {AX[j]}_start AS start_b, CAST(count(*) AS BIGINT) AS boxes FROM {tiles_sql('shape mismatch')} GROUP BY ALL HAVING count(DISTINCT ({AX[i]}_count, {AX[j]}_count)) > 1"
        for i, j in ((0, 1), (0, 2), (1, 2))
    ),
)
def _(spark, sf_dir):
    return lay.mismatches(tiles(spark, sf_dir, "shape mismatch"))


@add("box_continuity", " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(sum(x_count * y_count * z_count) AS BIGINT) AS volume, CAST(max(x_start + x_count) * max(y_start + y_count) * max(z_start + z_count) AS BIGINT) AS whole FROM {tiles_sql(n)}" for n in ("valid", "not continuous")))
def _(spark, sf_dir):
    a, b = (lay.uncovered(tiles(spark, sf_dir, n)).select(F.lit(n).alias("name"), "volume", "whole") for n in ("valid", "not continuous"))
    return a.union(b)


#: Bricks along x alone, one shape for each way to spread six ranks over the other axes: (y, z, parts of y, parts of z).
SPREADS = {"all to z": ("ny", "nz", 1, 6), "all to y": ("ny", "8", 6, 1), "an even pair": ("12", "8", 2, 3), "as square as can be": ("5", "7", 3, 2)}


def _spread_sql(name: str, y: str, z: str, qy: int, qz: int) -> str:
    cut = lambda n, p, c: (f"({c}) * ({n} // {p}) + greatest(0, ({c}) - ({p} - {n} % {p}))", f"{n} // {p} + CASE WHEN ({c}) >= {p} - {n} % {p} THEN 1 ELSE 0 END")
    a, b = cut(y, qy, f"r // {qz}"), cut(z, qz, f"r % {qz}")
    return f"SELECT '{name}' AS way, CAST(r AS INT) AS rank, CAST(nx AS INT) AS x_count, CAST({a[0]} AS INT) AS y_start, CAST({a[1]} AS INT) AS y_count, CAST({b[0]} AS INT) AS z_start, CAST({b[1]} AS INT) AS z_count FROM {SIZES_SQL}, range(6) t(r)"


@add("bricks_to_pencils", " UNION ALL ".join(_spread_sql(n, *v) for n, v in SPREADS.items()))
def _(spark, sf_dir):
    """Pencils of bricks, as long in x as the table says."""
    sizes, rows = dict(zip(("nx", "ny", "nz"), table_dims(spark, sf_dir), strict=True)), []
    for name, (y, z, _, _) in SPREADS.items():
        dims = (sizes["nx"], *(sizes[k] if k in sizes else int(k) for k in (y, z)))
        for r, b in enumerate(dec.pencils_from_bricks(dec.brick_boxes(dims, (6, 1, 1)))):
            rows.append((name, r, b.counts[0], b.starts[1], b.counts[1], b.starts[2], b.counts[2]))
    return spark.createDataFrame(rows, "way string, rank int, x_count int, y_start int, y_count int, z_start int, z_count int")


#: Two boxes a vector, cut at a place of its own: a layout that is no product of cuts.
_CUT = "(8 + vec_id * 37 % 48)"


def ragged(spark, sf_dir) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.expr(_CUT).cast("int").alias("cut"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    start, count = F.when(F.col("side") == 0, 0).otherwise(F.col("cut")), F.when(F.col("side") == 0, F.col("cut")).otherwise(64 - F.col("cut"))
    return t.select((2 * F.col("vec_id") + F.col("side")).cast("int").alias("rank"), F.lit(int(Layout.X_BRICKS)).alias("layout"), F.array(start, F.col("vec_id").cast("int")).alias("starts"), F.array(count, F.lit(1)).alias("counts"), count.cast("long").alias("size"))


@add("plan_of_layout_placement", f"SELECT CAST(2 * y + CASE WHEN x < c THEN 0 ELSE 1 END AS INT) AS rank, CAST(CASE WHEN x < c THEN x ELSE x - c END AS BIGINT) AS local_offset, x, y, v FROM (SELECT *, {_CUT.replace('vec_id', 'y')} AS c FROM {EM_SQL})")
def _(spark, sf_dir):
    """Points to the ranks of an irregular layout table."""
    points, _ = grids.embeddings_grid(spark, sf_dir)
    plan = PlanR2R(boxes=ragged(spark, sf_dir))
    return plan.placement(plan.scatter(points, Layout.X_BRICKS), Layout.X_BRICKS)


@add("plan_of_layout_execute", sql_round(sql_dft(sql_dft(sql_complex(EM_SQL, "xy"), "xy", "x", 64, True, 32), "xy", "y", EM_N), AX[:2]))
def _(spark, sf_dir):
    """A real-to-complex plan made of an irregular layout table."""
    points, _ = grids.embeddings_grid(spark, sf_dir)
    return rounded(PlanR2C(boxes=ragged(spark, sf_dir), executor=NP).execute(points, Execute.FORWARD))


# --- where values lie after transposes and reshapes


def sql_owner(n: int, p: int, i: str) -> str:
    q, m = divmod(n, p)
    return f"(CASE WHEN {i} < {(p - m) * q} THEN {i} // {q} ELSE {p - m} + ({i} - {(p - m) * q}) // {q + 1} END)"


def sql_placement(grid_sql: str, dims, grid, layout: Layout) -> str:
    who = {Layout.X_PENCILS: (0, 1, 2), Layout.Y_PENCILS: (1, 0, 2), Layout.Z_PENCILS: (1, 2, 0)}[layout]
    order = {Layout.X_PENCILS: (0, 1, 2), Layout.Y_PENCILS: (1, 2, 0), Layout.Z_PENCILS: (2, 0, 1)}[layout]
    c = {k: sql_owner(dims[a], grid[k], AX[a]) for a, k in enumerate(who)}
    rank = "0"
    for k, g in enumerate(grid):
        rank = f"({rank} * {g} + {c[k]})"
    s = [sql_split(dims[a], grid[k], c[k]) for a, k in enumerate(who)]
    a, b, d = order
    off = f"({AX[a]} - {s[a][0]}) + {s[a][1]} * (({AX[b]} - {s[b][0]}) + {s[b][1]} * ({AX[d]} - {s[d][0]}))"
    return f"SELECT CAST({rank} AS INT) AS rank, CAST({off} AS BIGINT) AS local_offset, x, y, z, v FROM {grid_sql}"


MOVES = {"x_to_y": (Transpose.X_TO_Y, (1, 2, 3)), "y_to_x": (Transpose.Y_TO_X, (1, 2, 3)), "y_to_z": (Transpose.Y_TO_Z, (1, 2, 3)), "z_to_y": (Transpose.Z_TO_Y, (1, 3, 2)), "x_to_z": (Transpose.X_TO_Z, (1, 1, 4)), "z_to_x": (Transpose.Z_TO_X, (1, 1, 4))}
ENDS = {Transpose.X_TO_Y: Layout.Y_PENCILS, Transpose.Y_TO_X: Layout.X_PENCILS, Transpose.Y_TO_Z: Layout.Z_PENCILS, Transpose.Z_TO_Y: Layout.Y_PENCILS, Transpose.X_TO_Z: Layout.Z_PENCILS, Transpose.Z_TO_X: Layout.X_PENCILS}
STARTS = {Transpose.X_TO_Y: Layout.X_PENCILS, Transpose.Y_TO_X: Layout.Y_PENCILS, Transpose.Y_TO_Z: Layout.Y_PENCILS, Transpose.Z_TO_Y: Layout.Z_PENCILS, Transpose.X_TO_Z: Layout.X_PENCILS, Transpose.Z_TO_X: Layout.Z_PENCILS}


def moved(spark, sf_dir, kind, grid, config=BLOCK):
    points, dims = grids.lineitem_grid(spark, sf_dir)
    plan = PlanR2R(dims, prod(grid), grid=grid, config=config)
    return plan.placement(plan.transpose(plan.scatter(points, STARTS[kind]), kind), ENDS[kind])


for _name, (_kind, _grid) in MOVES.items():

    @add(f"transpose_{_name}", sql_placement(LI_SQL, LI, _grid, ENDS[_kind]))
    def _(spark, sf_dir, kind=_kind, grid=_grid):
        return moved(spark, sf_dir, kind, grid, Config())

    @add(f"transpose_block_{_name}", sql_placement(LI_SQL, LI, _grid, ENDS[_kind]))
    def _(spark, sf_dir, kind=_kind, grid=_grid):
        return moved(spark, sf_dir, kind, grid)


for _name, _config in {
    "key_exchange": Config(), "unpack_mode": BLOCK.with_(transpose_mode=TransposeMode.UNPACK), "fused": BLOCK.with_(backend=Backend.MPI_P2P_FUSED),
    "compressed_lossless": BLOCK.with_(backend=Backend.MPI_P2P_COMPRESSED), "scheduled": BLOCK.with_(backend=Backend.MPI_P2P_SCHEDULED),
    "pipelined": BLOCK.with_(backend=Backend.MPI_P2P_PIPELINED), "all_to_all": BLOCK.with_(backend=Backend.MPI_A2A), "one_sided": BLOCK.with_(backend=Backend.MPI_RMA),
}.items():

    @add(f"transpose_{_name}", sql_placement(LI_SQL, LI, (1, 2, 3), Layout.Y_PENCILS))
    def _(spark, sf_dir, config=_config):
        return moved(spark, sf_dir, Transpose.X_TO_Y, (1, 2, 3), config)


@add("transpose_async", sql_placement(LI_SQL, LI, (1, 2, 3), Layout.Y_PENCILS))
def _(spark, sf_dir):
    points, dims = grids.lineitem_grid(spark, sf_dir)
    plan = PlanR2R(dims, 6, grid=(1, 2, 3), config=BLOCK)
    request = plan.transpose_start(plan.scatter(points, Layout.X_PENCILS), Transpose.X_TO_Y)
    return plan.placement(plan.transpose_end(request), Layout.Y_PENCILS)


@add("compression_bound", "SELECT CAST(0 AS BIGINT) AS violations, CAST(count(*) AS BIGINT) AS points FROM " + LI_SQL)
def _(spark, sf_dir):
    tol = 1e-3
    lossy = BLOCK.with_(backend=Backend.MPI_P2P_COMPRESSED, compression=CompressionConfig(mode=CompressionMode.FIXED_ACCURACY, tolerance=tol))
    near = moved(spark, sf_dir, Transpose.X_TO_Y, (1, 2, 3), lossy)
    points, _ = grids.lineitem_grid(spark, sf_dir)
    both = near.withColumnRenamed("v", "w").join(points, list(AX))
    return both.agg(F.sum((F.abs(F.col("v") - F.col("w")) > tol * 1.000001).cast("long")).alias("violations"), F.count("*").alias("points"))


def codec_config(**more):
    return BLOCK.with_(backend=Backend.MPI_P2P_COMPRESSED, compression=CompressionConfig(**more))


RATE = codec_config(mode=CompressionMode.FIXED_RATE, rate=6.0)
_MEET = {a: f"greatest(least(s.{a}_start + s.{a}_count, t.{a}_start + t.{a}_count) - greatest(s.{a}_start, t.{a}_start), 0)" for a in AX}
_VALUES, _BLOCKS = " * ".join(_MEET.values()), " * ".join(f"ceil(({m}) / 4)" for m in _MEET.values())


@add(
    "compression_rates",
    f"""WITH p AS (SELECT s.rank, {_VALUES} AS n, {_BLOCKS} AS b FROM {sql_boxes(LI, (1, 2, 3), Layout.X_PENCILS)} s, {sql_boxes(LI, (1, 2, 3), Layout.Y_PENCILS)} t),
 c AS (SELECT rank, 8 * n AS raw, 9 + 2 * b + ceil(b * (6 * 64 - 16) / 8) AS coded FROM p WHERE n > 0),
 r AS (SELECT rank, sum(raw) AS raw, sum(CASE WHEN coded <= raw THEN coded ELSE raw + 1 END) AS sent FROM c GROUP BY rank)
 SELECT CAST(384 AS BIGINT) AS points, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(sent) AS BIGINT) AS sent, round(min(raw / sent), 9) AS lowest, round(max(raw / sent), 9) AS highest, round(avg(raw / sent), 9) AS mean FROM r""",
)
def _(spark, sf_dir):
    """One job moves the grid, counts its points and measures what was sent."""
    points, dims = grids.lineitem_grid(spark, sf_dir)
    plan, rates = PlanR2R(dims, 6, grid=(1, 2, 3), config=RATE), Rates("x to y")
    n = plan.gather(plan.transpose(plan.scatter(points, Layout.X_PENCILS), Transpose.X_TO_Y, rates), Layout.Y_PENCILS).count()
    found = rates.get()
    return spark.createDataFrame([(n, *(found[k] for k in ("raw", "sent")), *(round(found[k], 9) for k in ("lowest", "highest", "mean")))], "points long, raw long, sent long, lowest double, highest double, mean double")


def violations(points, plan, bound):
    """How many values an exchange with a lossy codec moved by more than
    ``bound``: a number, or a share of the power of two above the largest."""
    near = plan.gather(plan.transpose(plan.scatter(points, Layout.X_PENCILS), Transpose.X_TO_Y), Layout.Y_PENCILS)
    axes = list(AX[: plan.ndims])
    top = points.agg(F.pow(F.lit(2.0), F.floor(F.log2(F.max(F.abs("v")))) + 1).alias("top"))
    both = near.withColumnRenamed("v", "w").join(points, axes).crossJoin(F.broadcast(top))  # one row
    limit = F.lit(bound) if isinstance(bound, float) else F.col("top") * bound[0]
    return both.agg(F.sum((F.abs(F.col("v") - F.col("w")) > limit).cast("long")).alias("violations"), F.count("*").alias("points"), (F.max(F.abs(F.col("v") - F.col("w"))) > 0).alias("lossy"))


def _share(d, plane):
    """A block codec's bound for blocks cut below ``plane``, as a share of the block's top."""
    return (block_codec.error_bound(d, plane) / 2.0**block_codec.FRACTION,)


def _bounds(d):
    size, planes = 1 + 2 * d + 4**d, block_codec.planes_of(d)
    whole = (block_codec.block_bits(32.0, d) - block_codec.EXPONENT_BITS) // size  # planes that fit whatever they hold
    return {
        "accuracy": (codec_config(mode=CompressionMode.FIXED_ACCURACY, tolerance=1e-4), 1e-4),
        "precision": (codec_config(mode=CompressionMode.FIXED_PRECISION, precision=30), _share(d, planes - 30)),
        "rate": (codec_config(mode=CompressionMode.FIXED_RATE, rate=32.0), _share(d, planes - whole)),
    }


for _name in ("accuracy", "precision", "rate"):

    @add("compression_rate_bound" if _name == "rate" else f"compression_{_name}_lineitem", "SELECT CAST(0 AS BIGINT) AS violations, CAST(count(*) AS BIGINT) AS points, true AS lossy FROM " + LI_SQL)
    def _(spark, sf_dir, name=_name):
        points, dims = grids.lineitem_grid(spark, sf_dir)
        config, bound = _bounds(3)[name]
        return violations(points.withColumn("v", F.col("v") / 7), PlanR2R(dims, 2, grid=(1, 2, 1), config=config), bound)

    @add(f"compression_{_name}_embeddings", "SELECT CAST(0 AS BIGINT) AS violations, CAST(count(*) AS BIGINT) AS points, true AS lossy FROM " + EM_SQL)
    def _(spark, sf_dir, name=_name):
        points, dims = grids.embeddings_grid(spark, sf_dir)
        config, bound = _bounds(2)[name]
        return violations(points, PlanR2R(dims, 8, config=config), bound)


@add("compression_permuted", sql_placement(LI_SQL, LI, (1, 2, 3), Layout.Y_PENCILS))
def _(spark, sf_dir):
    """Blocks sent in the old order of axes and decoded into the new one."""
    kept = codec_config(mode=CompressionMode.FIXED_ACCURACY, tolerance=1e-9).with_(transpose_mode=TransposeMode.UNPACK)
    out = moved(spark, sf_dir, Transpose.X_TO_Y, (1, 2, 3), kept)
    return out.withColumn("v", F.round("v", 6))


def brick_plan(config=BLOCK, kind=PlanR2R, **more):
    return kind(boxes=dec.brick_boxes(LI, (2, 2, 1)), config=config, **more)


BRICK = "SELECT CAST(y // 4 * 2 + x // 6 AS INT) AS rank, CAST(x % 6 + 6 * (y % 4 + 4 * z) AS BIGINT) AS local_offset, x, y, z, v FROM " + LI_SQL
PENCIL = "SELECT CAST(y // 2 AS INT) AS rank, CAST(x + 12 * (y % 2 + 2 * z) AS BIGINT) AS local_offset, x, y, z, v FROM " + LI_SQL


@add("reshape_x_bricks_to_pencils", PENCIL)
def _(spark, sf_dir):
    plan = brick_plan()
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return plan.placement(plan.reshape(plan.scatter(points, Layout.X_BRICKS), Reshape.X_BRICKS_TO_PENCILS), Layout.X_PENCILS)


@add("reshape_x_pencils_to_bricks", BRICK)
def _(spark, sf_dir):
    plan = brick_plan()
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return plan.placement(plan.reshape(plan.scatter(points, Layout.X_PENCILS), Reshape.X_PENCILS_TO_BRICKS), Layout.X_BRICKS)


# spectral side of bricks 2 x 1 x 2: x stays cut in two, z is cut in two again, y is whole
NO_SLAB = BLOCK.with_(enable_z_slab=False, enable_fourier_reshape=True)


def spectral_plan(kind=PlanR2R, **more):
    return kind(boxes=dec.brick_boxes(LI, (2, 1, 2)), config=NO_SLAB, **more)


@add("reshape_z_pencils_to_bricks", f"SELECT CAST(z // 2 * 2 + x // 6 AS INT) AS rank, CAST(z % 2 + 2 * (x % 6 + 6 * y) AS BIGINT) AS local_offset, x, y, z, v FROM {LI_SQL}")
def _(spark, sf_dir):
    plan = spectral_plan()
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return plan.placement(plan.reshape(plan.scatter(points, Layout.Z_PENCILS), Reshape.Z_PENCILS_TO_BRICKS), Layout.Z_BRICKS)


@add("reshape_z_bricks_to_pencils", f"SELECT CAST(y // 4 * 2 + x // 6 AS INT) AS rank, CAST(z + 4 * (x % 6 + 6 * (y % 4)) AS BIGINT) AS local_offset, x, y, z, v FROM {LI_SQL}")
def _(spark, sf_dir):
    plan = spectral_plan()
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return plan.placement(plan.reshape(plan.scatter(points, Layout.Z_BRICKS), Reshape.Z_BRICKS_TO_PENCILS), Layout.Z_PENCILS)


# --- kernels on one box


KERNEL_GRID = (1, 2, 2)
_BOX = f"(SELECT CAST(y // 4 * 2 + z // 2 AS INT) AS rank, x, y % 4 AS y, z % 2 AS z, v FROM {LI_SQL})"
_PART = "x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 2"


def on_boxes(spark, sf_dir, run):
    """A kernel on every rank's box, 12 x 4 x 2 points each."""
    points, dims = grids.lineitem_grid(spark, sf_dir)
    held = ex.scatter(points, dec.pencil_boxes(dims, KERNEL_GRID, Layout.X_PENCILS), Layout.X_PENCILS, np.dtype("f8"))

    def local(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                out = run(np.frombuffer(row["data"], "f8").reshape(tuple(reversed(row["counts"])))).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(out.size, row["rank"], np.int32)), pa.array(np.arange(out.size)), pa.array(out)], names=["rank", "local_offset", "v"])

    return held.mapInArrow(local, "rank int, local_offset long, v double")


_SUB = ((2, 1, 0), (5, 2, 2))
KERNEL_CASES = {
    "permute_forward": ("y + 4 * (z + 2 * x)", "", kernels.permute_forward), "permute_backward": ("z + 2 * (x + 12 * y)", "", kernels.permute_backward),
    "permute_backward_start": ("z + 2 * (y + 4 * x)", "", kernels.permute_backward_start), "permute_backward_end": ("z + 2 * (x + 12 * y)", "", lambda a: kernels.permute_backward_end(kernels.permute_backward_start(a))),
    "pack": ("(x - 2) + 5 * ((y - 1) + 2 * z)", _PART, lambda a: kernels.pack(a, *_SUB)), "copy": ("x + 12 * (y + 4 * z)", "", kernels.copy),
    "pack_forward": ("(y - 1) + 2 * (z + 2 * (x - 2))", _PART, lambda a: kernels.get_fused(kernels.permute_forward)(a, *_SUB)), "pack_backward": ("z + 2 * ((x - 2) + 5 * (y - 1))", _PART, lambda a: kernels.get_fused(kernels.permute_backward)(a, *_SUB)),
}
for _name, (_at, _where, _run) in KERNEL_CASES.items():

    @add("transpose_kernels_fused" if _name == "pack_forward" else f"kernel_{_name}", f"SELECT rank, CAST({_at} AS BIGINT) AS local_offset, v FROM {_BOX} WHERE {_where or 'true'}")
    def _(spark, sf_dir, run=_run):
        return on_boxes(spark, sf_dir, run)


@add("kernel_unpack", f"SELECT rank, CAST(x + 12 * (y + 4 * z) AS BIGINT) AS local_offset, CASE WHEN {_PART} THEN v ELSE 0 END AS v FROM {_BOX}")
def _(spark, sf_dir):
    return on_boxes(spark, sf_dir, lambda a: kernels.unpack(kernels.pack(a, *_SUB), np.zeros_like(a), *_SUB))


# --- transforms


@add("fft_c2c_2d_fwd", sql_round(sql_all(EV_SQL, EV), AX[:2]))
def _(spark, sf_dir):
    points, dims = grids.events_grid(spark, sf_dir)
    return rounded(PlanC2C(dims, 4, executor=NP, config=BLOCK).execute(grids.complex_of(points), Execute.FORWARD))


@add("fft_c2c_2d_bwd", sql_round(sql_all(EV_SQL, EV, False), AX[:2]))
def _(spark, sf_dir):
    points, dims = grids.events_grid(spark, sf_dir)
    return rounded(PlanC2C(dims, 4, executor=NP, config=BLOCK).execute(grids.complex_of(points), Execute.BACKWARD))


@add("fft_embeddings_2d", sql_round(sql_dft(sql_dft(sql_complex(EM_SQL, "xy"), "xy", "x", 64, True, 32), "xy", "y", EM_N), AX[:2]))
def _(spark, sf_dir):
    points, dims = grids.embeddings_grid(spark, sf_dir)
    return rounded(PlanR2C(dims, 8, executor=NP, config=BLOCK).execute(points, Execute.FORWARD))


@add("fft_r2c_1d", sql_round(sql_dft(sql_complex(EM_SQL, "xy"), "xy", "x", 64, True, 32), AX[:2]))
def _(spark, sf_dir):
    """Rows alone: one pass over arrays, no shuffle."""
    ship(spark)
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("y"), "embedding")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                a = np.asarray(batch.column(1).flatten(), dtype="f8").reshape(batch.num_rows, -1)
                f = np.fft.rfft(a, axis=1)
                k = f.shape[1]
                y = np.repeat(batch.column(0).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(k, dtype=np.int32), batch.num_rows)), pa.array(y), pa.array(f.real.ravel()), pa.array(f.imag.ravel())], names=["x", "y", "re", "im"])

    return rounded(t.mapInArrow(run, "x int, y int, re double, im double"))


THREE = {
    "generic": dict(parts=6, grid=(1, 2, 3)), "zslab": dict(parts=4), "yslab": dict(parts=4, grid=(1, 4, 1), config=BLOCK.with_(enable_y_slab=True, enable_z_slab=False)),
    "sql": dict(parts=1, executor=Executor.SQL), "key_exchange": dict(parts=6, grid=(1, 2, 3), config=Config()), "planes": dict(parts=4, config=Config()),
}
for _name, _more in THREE.items():

    @add(f"fft_c2c_3d_{_name}", sql_round(sql_all(LI_SQL, LI), AX))
    def _(spark, sf_dir, more=_more):
        points, dims = grids.lineitem_grid(spark, sf_dir)
        return rounded(PlanC2C(dims, **{"executor": NP, "config": BLOCK, **more}).execute(grids.complex_of(points), Execute.FORWARD).select("x", "y", "z", "re", "im"))


#: Lines of a given length: one of small primes, a power of two, a prime.
LENGTHS = (1000, 128, 97)


def long_sql(n: int) -> str:
    return f"""(SELECT a.x, a.y, coalesce(sum(l.v), 0) / 1e6 AS v FROM (SELECT CAST(i % {n} AS INT) AS x, CAST(i // {n} AS INT) AS y FROM range({4 * n}) t(i)) a LEFT JOIN
 (SELECT (l_orderkey * 7 + l_suppkey) % {n} AS x, l_linenumber % 4 AS y, l_quantity AS v FROM lineitem) l ON a.x = l.x AND a.y = l.y GROUP BY a.x, a.y)"""


def long_grid(spark, sf_dir, n):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = t.select(((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).cast("int").alias("x"), (F.col("l_linenumber") % 4).cast("int").alias("y"), F.col("l_quantity").cast("double").alias("v"))
    return grids.densify(p, (n, 4)).withColumn("v", F.col("v") / 1e6)


for _n in LENGTHS:

    @add(f"fft_array_{_n}", sql_round(sql_all(long_sql(_n), (_n, 4)), AX[:2]))
    def _(spark, sf_dir, n=_n):
        """Array transforms in DataFrame functions, against sums."""
        points = grids.complex_of(long_grid(spark, sf_dir, n))
        return rounded(PlanC2C((n, 4), 4, executor=Executor.SQL).execute(points, Execute.FORWARD))


@add("fft_array_half_97", sql_round(sql_half(long_sql(97), (97, 4)), AX[:2]))
def _(spark, sf_dir):
    return rounded(PlanR2C((97, 4), 4, executor=Executor.SQL).execute(long_grid(spark, sf_dir, 97), Execute.FORWARD))


@add("roundtrip_array_128", sql_round(long_sql(128), AX[:2], ("v",)))
def _(spark, sf_dir):
    return round_trip(PlanR2C((128, 4), 4, executor=Executor.SQL), long_grid(spark, sf_dir, 128), 512)


@add("fft_c2c_3d_bwd", sql_round(sql_all(LI_SQL, LI, False), AX))
def _(spark, sf_dir):
    points, dims = grids.lineitem_grid(spark, sf_dir)
    return rounded(PlanC2C(dims, 6, grid=(1, 2, 3), executor=NP, config=BLOCK).execute(grids.complex_of(points), Execute.BACKWARD))


for _name, _more in {"generic": dict(parts=6, grid=(1, 2, 3)), "zslab": dict(parts=4), "sql": dict(parts=1, executor=Executor.SQL)}.items():

    @add(f"fft_r2c_3d_{_name}", sql_round(sql_half(LI_SQL, LI), AX))
    def _(spark, sf_dir, more=_more):
        points, dims = grids.lineitem_grid(spark, sf_dir)
        return rounded(PlanR2C(dims, **{"executor": NP, "config": BLOCK, **more}).execute(points, Execute.FORWARD).select("x", "y", "z", "re", "im"))


@add("fft_r2c_2d", sql_round(sql_half(EV_SQL, EV), AX[:2]))
def _(spark, sf_dir):
    points, dims = grids.events_grid(spark, sf_dir)
    return rounded(PlanR2C(dims, 5, executor=NP, config=BLOCK).execute(points, Execute.FORWARD))


def round_trip(plan, points, factor):
    there = plan.execute(points, Execute.FORWARD)
    return rounded(grids.scaled(plan.execute(there, Execute.BACKWARD), factor))


for _name, _more in {"generic": dict(parts=6, grid=(1, 2, 3)), "zslab": dict(parts=4), "yslab": dict(parts=2, grid=(1, 2, 1), config=BLOCK.with_(enable_y_slab=True, enable_z_slab=False))}.items():

    @add(f"roundtrip_c2c_{_name}", f"SELECT x, y, z, round(v, 6) + 0.0 AS re, CAST(0 AS DOUBLE) AS im FROM {LI_SQL}")
    def _(spark, sf_dir, more=_more):
        points, dims = grids.lineitem_grid(spark, sf_dir)
        return round_trip(PlanC2C(dims, **{"executor": NP, "config": BLOCK, **more}), grids.complex_of(points), prod(dims))

    @add(f"roundtrip_r2c_{_name}", sql_round(LI_SQL, AX, ("v",)))
    def _(spark, sf_dir, more=_more):
        points, dims = grids.lineitem_grid(spark, sf_dir)
        return round_trip(PlanR2C(dims, **{"executor": NP, "config": BLOCK, **more}), points, prod(dims))


@add("roundtrip_c2r_odd", sql_round(f"(SELECT y AS x, x AS y, v FROM {EV_SQL})", AX[:2], ("v",)))
def _(spark, sf_dir):
    points, dims = grids.events_grid(spark, sf_dir)
    turned = points.select(F.col("y").alias("x"), F.col("x").alias("y"), "v")
    return round_trip(PlanR2C((dims[1], dims[0]), 3, executor=NP, config=BLOCK), turned, prod(dims))


for _kind in R2RKind:

    @add(f"r2r_{_kind.name.lower()}", sql_round(sql_r2r(sql_r2r(EV_SQL, AX[:2], "x", EV[0], _kind), AX[:2], "y", EV[1], _kind), AX[:2], ("v",)))
    def _(spark, sf_dir, kind=_kind):
        points, dims = grids.events_grid(spark, sf_dir)
        return rounded(PlanR2R(dims, 4, kinds=[kind, kind], executor=NP, config=BLOCK).execute(points, Execute.FORWARD))


@add("r2r_mixed_3d", sql_round(sql_r2r(sql_r2r(sql_r2r(LI_SQL, AX, "x", 12, R2RKind.DST_2), AX, "y", 8, R2RKind.DCT_3), AX, "z", 4, R2RKind.DCT_1), AX, ("v",)))
def _(spark, sf_dir):
    points, dims = grids.lineitem_grid(spark, sf_dir)
    return rounded(PlanR2R(dims, 4, kinds=[R2RKind.DST_2, R2RKind.DCT_3, R2RKind.DCT_1], executor=NP, config=BLOCK).execute(points, Execute.FORWARD))


@add("r2r_mixed_sql", SQL["r2r_mixed_3d"])
def _(spark, sf_dir):
    points, dims = grids.lineitem_grid(spark, sf_dir)
    return rounded(PlanR2R(dims, 1, kinds=[R2RKind.DST_2, R2RKind.DCT_3, R2RKind.DCT_1], executor=Executor.SQL).execute(points, Execute.FORWARD).select("x", "y", "z", "v"))


@add("roundtrip_r2r", sql_round(EV_SQL, AX[:2], ("v",)))
def _(spark, sf_dir):
    points, dims = grids.events_grid(spark, sf_dir)
    plan = PlanR2R(dims, 4, kinds=[R2RKind.DST_3, R2RKind.DCT_4], executor=NP, config=BLOCK)
    return round_trip(plan, points, plan.round_trip_factor())


@add("brick_execute_fwd", sql_round(sql_all(LI_SQL, LI), AX))
def _(spark, sf_dir):
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return rounded(brick_plan(BLOCK, PlanC2C, executor=NP).execute(grids.complex_of(points), Execute.FORWARD))


@add("brick_execute_roundtrip", sql_round(LI_SQL, AX, ("v",)))
def _(spark, sf_dir):
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return round_trip(spectral_plan(PlanR2C, executor=NP), points, prod(LI))


@add("fourier_reshape_execute", sql_round(sql_half(LI_SQL, LI), AX))
def _(spark, sf_dir):
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return rounded(spectral_plan(PlanR2C, executor=NP).execute(points, Execute.FORWARD))


@add("transpose_only_execute", sql_round(LI_SQL, AX, ("v",)))
def _(spark, sf_dir):
    points, dims = grids.lineitem_grid(spark, sf_dir)
    return rounded(PlanR2R(dims, 6, grid=(1, 2, 3), config=BLOCK).execute(points, Execute.FORWARD))


@add("single_precision_roundtrip", "SELECT CAST(0 AS BIGINT) AS violations, CAST(count(*) AS BIGINT) AS points FROM " + LI_SQL)
def _(spark, sf_dir):
    points, dims = grids.lineitem_grid(spark, sf_dir)
    plan = PlanC2C(dims, 6, grid=(1, 2, 3), executor=NP, precision=Precision.SINGLE, config=BLOCK)
    back = plan.execute(plan.execute(grids.complex_of(points), Execute.FORWARD), Execute.BACKWARD)
    both = grids.scaled(back, prod(dims)).join(points, list(AX))
    worst = F.abs(F.col("re") - F.col("v")) / F.greatest(F.abs("v"), F.lit(1.0))
    return both.agg(F.sum((worst > grids.tolerance(prod(dims), True)).cast("long")).alias("violations"), F.count("*").alias("points"))


#: Points of a box on a grid that grows with a table.
BOX_VALUES = 1 << 20


@add("random_roundtrip_error", f"SELECT CAST(nx * ny * nz AS BIGINT) AS points, true AS within FROM {SIZES_SQL}")
def _(spark, sf_dir):
    """Random values on a grid as large as the table says, in boxes that fit a
    task: eight, more where the grid is larger."""
    dims = table_dims(spark, sf_dir)
    points = grids.random_grid(spark, dims)
    plan = PlanC2C(dims, grid=dec.grid_of_boxes(dims, BOX_VALUES, 8), executor=NP, config=BLOCK)
    back = grids.scaled(plan.round_trip(points), prod(dims))
    return grids.random_error(back, dims).select("points", (F.col("max_error") <= grids.tolerance(prod(dims))).alias("within"))


EV_PAD = (24, 16)
EV2_SQL = f"(SELECT * FROM {EV_SQL} WHERE y < 16)"


def flat_bricks(kind=PlanR2R, **more):
    return kind(boxes=dec.brick_boxes(EV_PAD, (2, 2)), config=BLOCK.with_(enable_fourier_reshape=True), **more)


def flat_points(spark, sf_dir):
    return grids.events_grid(spark, sf_dir)[0].where("y < 16")


@add("brick_execute_2d", sql_round(sql_all(EV2_SQL, EV_PAD), AX[:2]))
def _(spark, sf_dir):
    return rounded(flat_bricks(PlanC2C, executor=NP).execute(grids.complex_of(flat_points(spark, sf_dir)), Execute.FORWARD))


@add("reshape_y_pencils_to_bricks", f"SELECT CAST(x // 12 * 2 + y // 8 AS INT) AS rank, CAST(y % 8 + 8 * (x % 12) AS BIGINT) AS local_offset, x, y, v FROM {EV2_SQL}")
def _(spark, sf_dir):
    plan = flat_bricks()
    out = plan.placement(plan.reshape(plan.scatter(flat_points(spark, sf_dir), Layout.Y_PENCILS), Reshape.Y_PENCILS_TO_BRICKS), Layout.Z_BRICKS)
    names = {r: k for k, r in enumerate(sorted(range(4), key=lambda r: plan.boxes(Layout.Z_BRICKS)[r].starts))}
    return out.withColumn("rank", F.get(F.array(*[F.lit(names[r]) for r in range(4)]), F.col("rank")))


@add("reshape_y_bricks_to_pencils", f"SELECT x, y, v FROM {EV2_SQL}")
def _(spark, sf_dir):
    plan = flat_bricks()
    return plan.gather(plan.reshape(plan.scatter(flat_points(spark, sf_dir), Layout.Z_BRICKS), Reshape.Y_BRICKS_TO_PENCILS), Layout.Y_PENCILS)


@add("brick_execute_zslab", sql_round(sql_all(LI_SQL, LI), AX))
def _(spark, sf_dir):
    points, _ = grids.lineitem_grid(spark, sf_dir)
    plan = PlanC2C(boxes=dec.brick_boxes(LI, (2, 1, 1)), config=BLOCK, executor=NP)
    return rounded(plan.execute(grids.complex_of(points), Execute.FORWARD))


@add("reshape_key_exchange", PENCIL)
def _(spark, sf_dir):
    plan = brick_plan(Config())
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return plan.placement(plan.reshape(plan.scatter(points, Layout.X_BRICKS), Reshape.X_BRICKS_TO_PENCILS), Layout.X_PENCILS)


@add("reshape_lines_back", BRICK)
def _(spark, sf_dir):
    plan = brick_plan(Config())
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return plan.placement(plan.reshape(plan.scatter(points, Layout.X_PENCILS), Reshape.X_PENCILS_TO_BRICKS), Layout.X_BRICKS)


@add("brick_execute_lines", sql_round(sql_half(LI_SQL, LI), AX))
def _(spark, sf_dir):
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return rounded(PlanR2C(boxes=dec.brick_boxes(LI, (2, 1, 2)), config=Config(enable_z_slab=False, enable_fourier_reshape=True), executor=NP).execute(points, Execute.FORWARD))


@add("brick_roundtrip_lines", sql_round(LI_SQL, AX, ("v",)))
def _(spark, sf_dir):
    """Bricks, planes of a slab, bricks."""
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return round_trip(PlanR2C(boxes=dec.brick_boxes(LI, (2, 1, 1)), config=Config(), executor=NP), points, prod(LI))


@add("report_of_the_plan", "SELECT CAST(2 AS BIGINT) AS exchanges, true AS moved, CAST(0 AS BIGINT) AS spilled, CAST(0 AS BIGINT) AS python")
def _(spark, sf_dir):
    """What the executed plan says of itself: points to lines, those to other
    lines, two exchanges without Python."""
    points, dims = grids.lineitem_grid(spark, sf_dir)
    written = store.written(points, store.new_path(spark, "report"))
    plan = PlanR2R(dims, 6, grid=(1, 2, 3))
    nodes = executed(plan.transpose(plan.scatter(written, Layout.X_PENCILS), Transpose.X_TO_Y))
    found = exchanges(nodes)
    return spark.createDataFrame([(len(found), all(n.bytes > 0 for n in found), sum(n.spilled for n in nodes), sum(n.name == "MapInArrow" for n in nodes))], "exchanges long, moved boolean, spilled long, python long")


@add("reshape_async", PENCIL)
def _(spark, sf_dir):
    plan = brick_plan()
    points, _ = grids.lineitem_grid(spark, sf_dir)
    return plan.placement(plan.reshape_end(plan.reshape_start(plan.scatter(points, Layout.X_BRICKS), Reshape.X_BRICKS_TO_PENCILS)), Layout.X_PENCILS)


@add("adaptive_transpose", sql_placement(LI_SQL, LI, (1, 2, 3), Layout.Y_PENCILS))
def _(spark, sf_dir):
    """Backends timed for each direction; whichever wins, values lie alike."""
    points, dims = grids.lineitem_grid(spark, sf_dir)
    tuned = Config(backend=Backend.ADAPTIVE, enable_mpi_backends=True, enable_pipelined_backends=False, n_measure_warmup_iters=0, n_measure_iters=1)
    plan = PlanR2R(dims, 6, grid=(1, 2, 3), effort=Effort.PATIENT, spark=spark, config=tuned)
    assert (Layout.X_PENCILS, Layout.Y_PENCILS) in plan.directions and len(plan.directions) == 4
    return plan.placement(plan.transpose(plan.scatter(points, Layout.X_PENCILS), Transpose.X_TO_Y), Layout.Y_PENCILS)


_TUNED = "(SELECT count(DISTINCT month(l_shipdate)) AS nx, max(l_linenumber) AS ny, 2 * count(DISTINCT l_returnflag) AS nz FROM lineitem)"


@add(
    "tuning_trials",
    f"""SELECT 'grid' AS what, CAST(count(*) FILTER (6 % i = 0 AND i <= least(nx // 2 + 1, ny) AND 6 // i <= least(ny, nz)) AS BIGINT) AS trials FROM {_TUNED}, range(1, 7) t(i)
 UNION ALL SELECT 'backend', 2 UNION ALL SELECT 'mode', 2 UNION ALL SELECT 'reshape', 2""",
)
def _(spark, sf_dir):
    """What EXHAUSTIVE tries on six ranks: grids that leave no rank empty, lines
    and boxes, packing and unpacking, and for bricks both ways of reshaping."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    dims = tuple(t.agg(F.countDistinct(F.month("l_shipdate")), F.max("l_linenumber"), 2 * F.countDistinct("l_returnflag")).first())  # one row
    few = Config(enable_mpi_backends=True, enable_pipelined_backends=False, n_measure_warmup_iters=0, n_measure_iters=1)
    plan = PlanR2C(dims, 6, effort=Effort.EXHAUSTIVE, spark=spark, executor=NP, config=few)
    bricks = PlanR2C(boxes=dec.brick_boxes(dims, (2, 1, 2)), effort=Effort.EXHAUSTIVE, spark=spark, executor=NP, config=few)
    assert all(t.shortest <= t.mean <= t.longest for t in plan.timings) and "mean" in plan.report()
    count = lambda p, what: sum(t.name.startswith(what) for t in p.timings)
    return spark.createDataFrame([*((k, count(plan, k)) for k in ("grid", "backend", "mode")), ("reshape", count(bricks, "reshape"))], "what string, trials long")


_MOST = f"(SELECT max(n) FROM (SELECT {_VOLUME('a')} AS n FROM {sql_table_boxes(BIG_GRID, Layout.X_PENCILS)} a UNION ALL SELECT {_VOLUME('a')} FROM {sql_table_boxes(BIG_GRID, Layout.Y_PENCILS)} a UNION ALL SELECT {_VOLUME('a')} FROM {sql_table_boxes(BIG_GRID, Layout.Z_PENCILS)} a))"
#: Properties of plans of the table's grid, and how they follow from its sizes.
PROPERTIES = {
    "alloc": _MOST, "alloc bytes": f"16 * {_MOST}", "alloc bytes, single": f"8 * {_MOST}", "aux": f"2 * {_MOST}", "aux of lines": _MOST, "aux bytes": f"32 * {_MOST}", "z-slab": "CASE WHEN 4 <= nz THEN 1 ELSE 0 END",
    "z-slab of a given grid": "0", "last layout": "5", "last layout, y-slab": "4", "spectral x": "nx // 2 + 1", "points": "nx * ny * nz", "bricks x": "CASE WHEN nz // 2 > 8 THEN 1 ELSE 2 END", "bricks y": "CASE WHEN nz // 2 > 8 THEN 2 ELSE 1 END", "bricks z": "2", "tolerance, in 1e-18": "CAST(round(5 * log2(nx * ny * nz) * pow(2.0, -52) * 1e18) AS BIGINT)",
}


@add("plan_properties", " UNION ALL ".join(f"SELECT '{k}' AS name, CAST({v} AS BIGINT) AS value FROM {SIZES_SQL}" for k, v in PROPERTIES.items()))
def _(spark, sf_dir):
    dims = table_dims(spark, sf_dir)
    a, y = PlanC2C(dims, 6, grid=BIG_GRID, config=BLOCK), PlanC2C(dims, 4, grid=(1, 4, 1), config=BLOCK.with_(enable_y_slab=True, enable_z_slab=False))
    s = PlanR2R(boxes=dec.brick_boxes(dims, (2, 1, 2)), config=NO_SLAB)
    bricks = dec.fourier_grid(s.boxes(Layout.Z_PENCILS), 2)
    found = {
        "alloc": a.alloc_size, "alloc bytes": a.alloc_bytes, "alloc bytes, single": PlanC2C(dims, 6, grid=BIG_GRID, precision=Precision.SINGLE).alloc_bytes, "aux": a.aux_size, "aux of lines": PlanC2C(dims, 6, grid=BIG_GRID, config=Config()).aux_size,
        "aux bytes": a.aux_bytes, "z-slab": PlanC2C(dims, 4, config=BLOCK).z_slab_enabled, "z-slab of a given grid": a.z_slab_enabled, "last layout": a.last_layout, "last layout, y-slab": y.last_layout,
        "spectral x": PlanR2C(dims, 6, grid=BIG_GRID).spectral_dims[0], "points": prod(a.dims), "bricks x": bricks[0], "bricks y": bricks[1], "bricks z": bricks[2], "tolerance, in 1e-18": round(grids.tolerance(prod(dims)) * 1e18),
    }
    return spark.createDataFrame([(k, int(v)) for k, v in found.items()], "name string, value long")


CUBE = (128, 128, 128)
_CUBE_ROWS = "(SELECT CAST(l_orderkey % 128 AS INT) AS x, CAST(l_partkey % 128 AS INT) AS y, CAST(l_suppkey % 128 AS INT) AS z, l_quantity AS q FROM lineitem)"
_CUBE_SQL = f"(SELECT a.x, a.y, a.z, coalesce(sum(q), 0) AS v FROM (SELECT CAST(i % 128 AS INT) AS x, CAST(i // 128 % 128 AS INT) AS y, CAST(i // 16384 AS INT) AS z FROM range(2097152) t(i)) a LEFT JOIN {_CUBE_ROWS} l ON a.x = l.x AND a.y = l.y AND a.z = l.z GROUP BY a.x, a.y, a.z)"


def cube(spark, sf_dir) -> DataFrame:
    """Quantities on 128 x 128 x 128 points."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = t.select(*[(F.col(f"l_{c}key") % 128).cast("int").alias(a) for a, c in zip(AX, ("order", "part", "supp"), strict=True)], F.col("l_quantity").alias("v"))
    return grids.densify(p, CUBE)


for _name, _config in (("transpose_cube", BLOCK), ("transpose_cube_lines", Config())):

    @add(_name, f"SELECT rank, count(*) AS points, CAST(sum(v * (local_offset % 1009)) AS BIGINT) AS checksum FROM ({sql_placement(_CUBE_SQL, CUBE, (1, 2, 4), Layout.Y_PENCILS)}) GROUP BY rank")
    def _(spark, sf_dir, config=_config):
        """From x- to y-pencils."""
        plan = PlanR2R(CUBE, 8, grid=(1, 2, 4), config=config)
        out = plan.placement(plan.transpose(plan.scatter(cube(spark, sf_dir), Layout.X_PENCILS), Transpose.X_TO_Y), Layout.Y_PENCILS)
        return out.groupBy("rank").agg(F.count("*").alias("points"), F.sum(F.col("v") * (F.col("local_offset") % 1009)).cast("long").alias("checksum"))


_LINES_OF_CUBE = [(0, 0, 0), (5, 17, 100), (127, 0, 1), (64, 64, 64), (1, 2, 3), (90, 33, 0), (0, 111, 50), (31, 99, 127)]

for _name, _config in (("fft_cube", BLOCK), ("fft_cube_lines", Config())):

    @add(
        _name,
        f"""SELECT CAST(fx AS INT) AS x, CAST(fy AS INT) AS y, CAST(fz AS INT) AS z, round(sum(q / 1e6 * cos(2 * pi() * ((x * fx + y * fy + z * fz) % 128) / 128)), 6) + 0.0 AS re, round(-sum(q / 1e6 * sin(2 * pi() * ((x * fx + y * fy + z * fz) % 128) / 128)), 6) + 0.0 AS im
 FROM {_CUBE_ROWS}, (VALUES {', '.join(map(str, _LINES_OF_CUBE))}) f(fx, fy, fz) GROUP BY fx, fy, fz""",
    )
    def _(spark, sf_dir, config=_config):
        """Some lines of the spectrum of 128 x 128 x 128 points, against sums over the table."""
        points = grids.complex_of(cube(spark, sf_dir).withColumn("v", F.col("v") / 1e6))
        f = PlanC2C(CUBE, 8, executor=NP, config=config).execute(points, Execute.FORWARD)
        return rounded(f.where(F.struct(*AX).isin(*[F.struct(*[F.lit(k).alias(a) for k, a in zip(line, AX, strict=True)]) for line in _LINES_OF_CUBE])).select(*AX, "re", "im"))


#: Calls that must fail, and the code they fail with.
WRONG = {
    "one axis": (lambda: PlanC2C((4,), 1), 3), "empty axis": (lambda: PlanC2C((4, 0), 1), 4), "precision": (lambda: PlanC2C((4, 4), 1, precision=7), 6), "effort": (lambda: PlanC2C((4, 4), 1, effort=9), 7),
    "executor": (lambda: PlanC2C((4, 4), 1, executor=77), 8), "gpu executor": (lambda: PlanC2C((4, 4), 1, executor=Executor.CUFFT), 401), "gpu backend": (lambda: PlanC2C((4, 4), 1, config=Config(backend=Backend.NCCL)), 402),
    "long grid": (lambda: PlanC2C((4, 4), 1, grid=(1, 1, 1)), 9), "fast axis": (lambda: PlanC2C((4, 4), 2, grid=(2, 1)), 10), "kinds missing": (lambda: PlanR2R((4, 4), 1, executor=NP), 11),
    "kinds": (lambda: PlanR2R((4, 4), 1, kinds=[1, 2], executor=NP), 12), "transpose": (lambda: PlanC2C((4, 4), 1).transpose(None, 5), 2), "no slab": (lambda: PlanC2C((4, 4, 4), 4, grid=(1, 2, 2)).transpose(None, 3), 2),
    "execute": (lambda: PlanC2C((4, 4), 1).execute(None, 1), 43), "no executor": (lambda: PlanR2C((4, 4), 1).execute(None, Execute.FORWARD), 45), "reshape": (lambda: PlanC2C((4, 4), 1).reshape(None, 11), 44),
    "layout": (lambda: PlanC2C((4, 4), 1).boxes(Layout.Z_PENCILS), 16), "warm-up": (lambda: Config(n_measure_warmup_iters=-1).validate(), 33), "iterations": (lambda: Config(n_measure_iters=0).validate(), 34),
    "mode": (lambda: Config(transpose_mode=3).validate(), 47), "access": (lambda: Config(access_mode=3).validate(), 48), "backend": (lambda: Config(backend=3).validate(), 202), "not started": (lambda: PlanC2C((4, 4), 1).transpose_end(1), 37),
    "reshape not started": (lambda: brick_plan().reshape_end(1), 40), "reshape kind": (lambda: brick_plan().reshape(None, 9), 38), "ended": (lambda: _ended().execute(None, Execute.FORWARD), 1), "adaptive": (lambda: PlanC2C((4, 4), 1, config=Config(backend=Backend.ADAPTIVE)), 202),
    "rate": (lambda: CompressionConfig(mode=CompressionMode.FIXED_RATE, rate=0.5).validate(), 501), "bits": (lambda: CompressionConfig(mode=CompressionMode.FIXED_PRECISION, precision=1).validate(), 502),
    "tolerance": (lambda: CompressionConfig(mode=CompressionMode.FIXED_ACCURACY, tolerance=0).validate(), 503), "sizes": (lambda: dec.Box.of((0, 0), (1, 1, 1)), 25), "axes": (lambda: dec.Box.of((0,), (1,)), 26), "counts": (lambda: dec.Box.of((0, 0), (-1, 1)), 27),
}


def _ended():
    plan = PlanC2C((4, 4), 1)
    plan.destroy()
    return plan
