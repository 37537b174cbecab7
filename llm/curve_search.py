"""Approximate nearest neighbours on shifted space-filling curves.

1. Equal vectors become one class with its smallest ids (copies tie at every
   distance, and ties go to smaller ids, so ``k`` + 1 of them are enough).
2. Each of ``curves`` random orthogonal projections to ``dims`` coordinates,
   shifted at random, orders all classes along a Hilbert curve; one range
   exchange sorts every curve and gives each class its rank there. Only keys
   and prints travel there; vectors, in their own precision, are sent once
   for each curve, to the blocks below.
3. A query looks at its window of ranks on every curve. The window's half
   width is measured, not guessed: for a bounded sample of queries the true
   neighbours are found by brute force, and the width is that within which
   ``aim`` of them lie on some curve.
4. Ranks are cut into blocks of bounded length; a query visits the blocks its
   window touches, each block keeps the query's nearest, and a query's lists
   are merged. Distances are differences in double precision.

Vectors that are null, zero, of another length than most, or that hold null
or non-finite components take no part, nor do rows without an id. Rows that
repeat an id and its vector count once. Clashing columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, ordered_rows, ship, spread_join

CURVES, DIMS, BITS, AIM, K, SEED = 16, 6, 8, 0.96, 10, 4
#: Bounded samples: rows to scale the projections, queries to measure the window.
FIT_ROWS, PROBES, LEAST_WINDOW, MAX_BLOCK = 2000, 64, 32, 4096
#: Classes that a task holds at once before it sends them on.
HELD = 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n x d, each below
    2**bits): undo the curve's reflections and exchanges from the coarsest
    bit down, Gray-decode, then interleave."""
    x = cells.astype(np.uint64)
    n, d = x.shape
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip ^= np.where((x[:, -1] & q) != 0, q - one, np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key.view(np.int64)


def rotations(width: int, dims: int, curves: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.normal(size=(width, min(dims, width))))[0] for _ in range(curves)], rng.random((curves, min(dims, width)))


def stored(vectors: DataFrame, vector: str) -> str:
    """How vectors are kept: in their own precision, so that none is lost."""
    kind = getattr(vectors.select(vector).schema[0].dataType, "elementType", None)
    return "<f4" if isinstance(kind, T.FloatType) else "<f8"


def matrix(column, kind: str, width: int) -> np.ndarray:
    """Stored vectors as rows of doubles."""
    return np.frombuffer(b"".join(column), kind).reshape(-1, width).astype(np.float64)


def vector_classes(vectors: DataFrame, vec_id: str, vector: str, k: int, query_every: int) -> tuple[DataFrame, DataFrame, int]:
    """(classes: print, v (binary, as ``stored``), ids, asked), (valid rows:
    vec_id, print) and the vectors' length."""
    kind = stored(vectors, vector)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()  # one row
    width = lengths[0] if lengths else 1
    # -0.0 and 0.0 are the same component
    rows = rows.where(F.size("v") == width).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumn("print", F.xxhash64("v"))
    keep = k + 1

    def first_ids(batches):  # at most k + 1 rows a class and ``HELD`` classes
        import heapq

        import pyarrow as pa

        seen: dict[int, list] = {}

        def flush():
            out = [(p, -i, s[0], s[1]) for p, s in seen.items() for i in s[2]]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            for at in range(0, max(len(out), 1), 10000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10000], t) for c, t in zip(cols, types, strict=True)], names=["print", "vec_id", "v", "asked"])

        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, width)
            for i, p, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), flat, strict=True):
                s = seen.setdefault(p, [row.astype(kind).tobytes(), False, []])
                s[1] |= i % query_every == 0
                if -i not in s[2]:
                    (heapq.heappush if len(s[2]) < keep else heapq.heappushpop)(s[2], -i)
            if len(seen) >= HELD:  # classes that come again are sent again; ``merge`` joins them
                yield from flush()
                seen.clear()
        yield from flush()

    def merge(batches):  # sorted by class, id: streams, and keeps the first k + 1
        import pyarrow as pa

        key, row, out = None, None, []

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["print", "v", "ids", "asked"])

        for batch in batches:
            for p, i, v, a in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if p != key:
                    if row:
                        out.append(row)
                    if len(out) >= 5000:
                        yield flush()
                        out = []
                    key, row = p, (p, v, [], False)
                if len(row[2]) < keep and i not in row[2][-1:]:
                    row[2].append(i)
                row = (*row[:3], row[3] or a)
        if row:
            out.append(row)
        yield flush()

    some = rows.mapInArrow(first_ids, "print long, vec_id long, v binary, asked boolean")
    merged = some.repartition("print").sortWithinPartitions("print", "vec_id").mapInArrow(merge, "print long, v binary, ids array<long>, asked boolean")
    return materialize(merged, "ann-classes"), rows.select("vec_id", "print"), width


def search(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, query_every: int = 100, curves: int = CURVES, dims: int = DIMS, aim: float = AIM, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id divides by
    ``query_every``, its ``k`` nearest other rows found."""
    import pyarrow as pa

    spark = vectors.sparkSession
    ship(spark)
    classes, rows, width = vector_classes(vectors, vec_id, vector, k, query_every)
    kind, total = stored(vectors, vector), classes.count()
    turn, shift = rotations(width, dims, curves, seed)
    fit = classes.orderBy(F.xxhash64("print")).limit(FIT_ROWS).select("v").collect()
    sample = matrix([r.v for r in fit], kind, width)
    middle = [(sample @ t).mean(axis=0) if len(sample) else np.zeros(t.shape[1]) for t in turn]
    spread = [np.maximum((sample @ t).std(axis=0), 1e-12) if len(sample) else np.ones(t.shape[1]) for t in turn]

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = matrix(part.column(1).to_pylist(), kind, width)
                for c in range(curves):
                    y = (x @ turn[c] - middle[c]) / spread[c]
                    cells = np.clip((y + 4 + shift[c]) / 9 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(hilbert_keys(cells, BITS)), part.column(0), part.column(2)], names=["curve", "key", "print", "asked"])

    placed = classes.select("print", "v", "asked").mapInArrow(place, "curve int, key long, print long, asked boolean")
    ranked = ordered_rows(placed, ["curve", "key", "print"], "ann-ranks")
    ranked = ranked.withColumn("rank", F.col("row_rank") - F.col("curve") * F.lit(total).cast("long"))  # every curve holds every class
    half = window(spark, classes, ranked, width, k, aim, kind)
    length = int(min(max(half, 256), MAX_BLOCK))

    block = F.floor(F.col("rank") / length)
    data = ranked.select("print", "curve", block.alias("block"), F.lit(0).alias("asks"))
    first, last = F.floor(F.greatest(F.col("rank") - half, F.lit(0)) / length), F.floor(F.least(F.col("rank") + half, F.lit(total - 1)) / length)
    asked = ranked.where("asked").select("print", "curve", F.explode(F.sequence(first, last)).alias("block"), F.lit(1).alias("asks"))
    # a class has a few places on each curve, so no print is hot
    spots = data.unionByName(asked).join(classes.select("print", "v", "ids"), "print").select("curve", "block", "asks", "print", "v", "ids")
    dealt = spots.repartition("curve", "block").sortWithinPartitions("curve", "block", "asks")
    keep = k + 1

    def visit(batches):
        def nearest(data, asks):
            if not data or not asks:
                return
            x, ids = matrix([d[1] for d in data], kind, width), [d[2] for d in data]
            norm = (x * x).sum(axis=1)
            for at in range(0, len(asks), 256):
                part = asks[at : at + 256]
                q = matrix([a[1] for a in part], kind, width)
                near = norm[None] - 2 * (q @ x.T)
                m = min(keep + 5, len(x))  # a few more than kept: this sum rounds, the next doesn't
                best = np.argpartition(near, m - 1, axis=1)[:, :m]
                out = []
                for a, row, b in zip(part, q, best, strict=True):
                    d = x[b] - row
                    d = np.sqrt((d * d).sum(axis=1))
                    pairs = sorted((float(s), i) for s, c in zip(d, b, strict=True) for i in ids[c])[:keep]
                    out += [(a[0], i, s) for s, i in pairs]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["print", "vec_id", "score"])

        key, data, asks = None, [], []
        for batch in batches:
            for c, b, asking, p, v, i in zip(*(batch.column(n).to_pylist() for n in range(6)), strict=True):
                if (c, b) != key:
                    yield from nearest(data, asks)
                    key, data, asks = (c, b), [], []
                (asks if asking else data).append((p, v, i))
                if len(asks) >= 1024:
                    yield from nearest(data, asks)
                    asks = []
        yield from nearest(data, asks)

    found = dealt.mapInArrow(visit, "print long, vec_id long, score double").groupBy("print", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("print").orderBy("score", "vec_id")
    lists = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).groupBy("print").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k + 1 at most
    asked_ids = rows.where(F.col("vec_id") % query_every == 0).distinct()
    both = spread_join(asked_ids, lists, "print", "print", ["vec_id"])
    own = F.slice(F.filter("h.near", lambda x: x["vec_id"] != F.col("d.vec_id")), 1, k)
    out = both.select(F.col("d.vec_id").alias("query_id"), F.posexplode(own).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def window(spark, classes: DataFrame, ranked: DataFrame, width: int, k: int, aim: float, kind: str) -> int:
    """Half width of the rank windows, from ``PROBES`` sampled queries."""
    import pyarrow as pa

    probes = classes.orderBy(F.xxhash64("print", F.lit(1))).limit(PROBES).select("print", "v").collect()
    if len(probes) < 2:
        return LEAST_WINDOW
    prints, q = np.array([r.print for r in probes]), matrix([r.v for r in probes], kind, width)

    def truth(batches):  # each task returns k + 1 rows a probe
        best = [[] for _ in prints]
        for batch in batches:
            p = batch.column(0).to_numpy()
            x = matrix(batch.column(1).to_pylist(), kind, width)
            near = (x * x).sum(axis=1)[None] - 2 * (q @ x.T)
            m = min(k + 1, len(x))
            top = np.argpartition(near, m - 1, axis=1)[:, :m]
            for j, t in enumerate(top):
                best[j] = sorted(best[j] + list(zip(near[j, t].tolist(), p[t].tolist(), strict=True)))[: k + 1]
        rows = [(int(a), b, s) for a, best_j in zip(prints, best, strict=True) for s, b in best_j]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["probe", "print", "near"])

    order = Window.partitionBy("probe").orderBy("near", "print")
    pairs = classes.select("print", "v").mapInArrow(truth, "probe long, print long, near double").where("probe <> print")
    pairs = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("probe", "print").collect()  # PROBES x k rows
    wanted = sorted({x for p in pairs for x in p} | set(prints.tolist()))
    names = F.broadcast(spark.createDataFrame([(int(x),) for x in wanted], "print long"))
    at = {(r.print, r.curve): r.rank for r in ranked.join(names, "print", "left_semi").select("print", "curve", "rank").collect()}  # those rows, on each curve
    curves = sorted({c for _, c in at})
    gaps = np.array([min(abs(at[a, c] - at[b, c]) for c in curves) for a, b in pairs])
    return int(max(LEAST_WINDOW, 1.1 * np.quantile(gaps, aim)))
