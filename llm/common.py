"""What several operators share: scratch tables, row order, tidy columns."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: runs of anything but ASCII white space (Java regex).
SPACE = r"[\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []
#: Paths of the tables that ``materialize`` wrote, in order.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode and only where the setting
    is missing (tests); a cluster without it is an error, not a silent local
    folder that other machines can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="llm-scratch-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return "file://" + _OWN_DIR[0]


def ship(spark: SparkSession) -> None:
    """Workers find this package where the driver does: by path on one
    machine, elsewhere as a zip that travels with the job (once a context)."""
    sc, package = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    root, done = os.path.dirname(package), sc.__dict__.setdefault("_shipped_packages", set())
    if package in done:
        return
    done.add(package)
    if sc.master.startswith("local"):
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
        return
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "llm"), "zip", root, "llm"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs at most a re-read, and
    fixes row ids and sampled range bounds that a recomputation could change.
    The table stays until the session's shared folder is cleared, as results
    read it lazily.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    WRITTEN.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    _delete(df.sparkSession, df._scratch)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if name in WRITTEN:
        WRITTEN.remove(name)


def discard_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete what was written after the first ``mark`` tables, but ``keep``."""
    for name in [n for n in WRITTEN[mark:] if n != keep._scratch]:
        _delete(spark, name)


def carried(docs: DataFrame, result: tuple[str, ...], **needed: str) -> tuple[DataFrame, list[Column]]:
    """(``docs`` as one column ``in_row`` beside the ``needed`` inputs by
    their new names, the columns that bring the rest back).

    No name of a caller's column can meet one of an operator's own, in any
    case. Columns named like a ``result`` (in any case) are left out, as the
    result replaces them.
    """
    names = docs.columns
    lower, taken = [n.lower() for n in names], {r.lower() for r in result}
    where = lambda n: names.index(n) if n in names else lower.index(n.lower())
    keep = [i for i, n in enumerate(lower) if n not in taken]
    row = [F.col(f"c{i}") for i in keep] or [F.lit(0).alias("none")]
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(F.struct(*row).alias("in_row"), *[F.col(f"c{where(n)}").alias(a) for a, n in needed.items()]), [F.col(f"in_row.c{i}").alias(names[i]) for i in keep]


def hot_join(many: DataFrame, one: DataFrame, key: str, rows: str, total: int, share: int = 1024, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``many`` with ``one`` (a row a ``key``, whose ``rows``
    says how many rows of ``many`` have it). Keys with more than
    ``total / share`` rows, at most ``share`` of them, are broadcast, so no
    task of the shuffled rest gets more than that of one key. ``one`` should
    be written, as it is looked through first."""
    limit = max(total // share, 64)
    if one.where(F.col(rows) > limit).isEmpty():
        return many.join(one, key, how)
    hot, cold = F.broadcast(one.where(F.col(rows) > limit)), one.where(F.col(rows) <= limit)
    return many.join(hot, key).unionByName(many.join(hot.select(key), key, "left_anti").join(cold, key, how))


def spread_join(big: DataFrame, small: DataFrame, key: str, small_key: str, spread: list[str], salts: int = 16) -> DataFrame:
    """Left join on a null-safe key that may be hot. Spark broadcasts
    ``small`` where its measured size allows; beyond that the rows of a hot
    key meet ``salts`` copies of their partner in as many tasks. The sides
    are aliased ``d`` and ``h``."""
    right = small.withColumn("join_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("h")
    left = big.withColumn("join_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int")).alias("d")
    return left.join(right, F.col(f"d.{key}").eqNullSafe(F.col(f"h.{small_key}")) & (F.col("d.join_salt") == F.col("h.join_salt")), "left")


def ordered_rows(df: DataFrame, by: list[str | Column], name: str, weight: str | None = None) -> DataFrame:
    """``df`` plus ``row_rank`` (0, 1, … in the order of ``by``) and, with
    ``weight``, ``row_before`` (the sum of ``weight`` over all rows before).

    One range exchange, no global window: each range counts its own rows, and
    the small table of range totals (one row a partition) shifts them.
    """
    ship(df.sparkSession)
    cols = list(df.columns)
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = T.StructType([*df.schema.fields, T.StructField("range_id", T.IntegerType()), T.StructField("row_rank", T.LongType()), T.StructField("row_before", T.LongType())])

    def number(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if weight is None:
                before = pa.array([0]).take(pa.array([0] * n, pa.int32())) if n else pa.array([], pa.int64())
            else:
                w = batch.column(cols.index(weight)).cast(pa.int64())
                before = pc.add(pc.subtract(pc.cumulative_sum(w), w), total) if n else w
                total += pc.sum(w).as_py() or 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([pid] * n, pa.int32()), pa.array(range(rows, rows + n), pa.int64()), before.cast(pa.int64())],
                names=[*cols, "range_id", "row_rank", "row_before"],
            )
            rows += n

    local = materialize(ranged.mapInArrow(number, schema), name)
    size = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(0).cast("long")
    totals = sorted(local.groupBy("range_id").agg(F.count("*").alias("n"), F.sum(size).alias("w")).collect())  # one row a partition
    shift, r, b = [], 0, 0
    for pid, n, w in totals:
        shift.append((pid, r, b))
        r, b = r + n, b + w
    shifts = df.sparkSession.createDataFrame(shift, "range_id int, rank_shift long, before_shift long")
    out = local.join(F.broadcast(shifts), "range_id", "left")  # as many rows as partitions
    keep = [*cols, (F.col("row_rank") + F.col("rank_shift")).alias("row_rank")]
    if weight is not None:
        keep.append((F.col("row_before") + F.col("before_shift")).alias("row_before"))
    return out.select(*keep)


def text_of(col: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system, as Python workers live on after a
    step and would keep its peak. Does nothing where the C library can't."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
