"""Hard negatives by distributed radix selection.

Components become integers, so scores (inner products) are exact. Each anchor
gets its best rows of the same label as positives. An anchor and a positive
open a window of scores; wanted are the best k rows of other labels in it.

1. All rows are dealt to groups of bounded size, every anchor to every group
   (anchors are a stated, small part of the rows, so this is blocks against
   all rows). A task holds one group and lets the anchors stream past it.
2. Selection: a window is cut into ``RADIX`` buckets of scores. Groups return
   counts by bucket, from the top down to the bucket in which they alone
   have the rows still needed (the k-th row can't lie below it); their sums
   tell the bucket of the k-th row. That bucket is cut again, digit by digit,
   until it is one score or few rows are left in and above it.
3. Only then rows are gathered: those at or above the bucket found, of equal
   scores the smallest ids, at most k from a group.

No step's data grows with the rows of a window, label or group of copies, so
equal vectors and hot labels cost no more than others.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part; repeated rows are rows of their own (also
as anchors), equal scores and ids in the order read; missing components of a
shorter vector count as zero; components beyond 2^62 count as 2^62, and sums
beyond 64 bits wrap; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, materialize, ship

SCALE, EVERY, POSITIVES, K, LOW, HIGH = 256, 100, 5, 10, 30, 90
RADIX, FEW, ELEMENTS, LEAST_ROWS, GROUPS, CELLS = 256, 4, 1 << 24, 256, 32, 1 << 23
ROW = "uid long, vid long, lab string, n int, width int, vec binary"


def quantised(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """Rows that take part: uid, vid, lab, n components, bytes of one, vec."""
    ship(vectors.sparkSession)
    rows = carried(vectors, (), vid=vec_id, lab=label, vec=vector)[0]
    rows = rows.where("vid IS NOT NULL AND lab IS NOT NULL AND vec IS NOT NULL").select(
        F.monotonically_increasing_id().alias("uid"), F.col("vid").cast("long").alias("vid"), F.col("lab").cast("string").alias("lab"), F.col("vec").cast("array<double>").alias("vec"))

    def integers(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            stops = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            keep = np.flatnonzero(bad[stops] == bad[stops - sizes])
            with np.errstate(all="ignore"):
                whole = np.clip(np.floor(scale * np.where(np.isfinite(values), values, 0)), -(2.0**62), 2.0**62).astype(np.int64)
            n, width, vec = [], [], []
            for k in keep.tolist():
                v = whole[stops[k] - sizes[k] : stops[k]]
                most = max(int(v.max()), -int(v.min())) if len(v) else 0
                width.append(2 if most < 1 << 15 else 4 if most < 1 << 31 else 8)
                n.append(len(v))
                vec.append(v.astype(f"<i{width[-1]}").tobytes())
            kept = [batch.column(c).take(pa.array(keep)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int32()), pa.array(width, pa.int32()), pa.array(vec, pa.binary())], names=["uid", "vid", "lab", "n", "width", "vec"])

    return materialize(rows.mapInArrow(integers, ROW), "negatives-rows")


def vectors_of(n: list[int], width: list[int], vec: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by vector length: {length: (positions, integer matrix)}."""
    out, sizes, widths = {}, np.array(n), np.array(width)
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        rows = np.empty((len(at), length), np.int64)
        for w in np.unique(widths[at]).tolist():
            these = np.flatnonzero(widths[at] == w)
            rows[these] = np.frombuffer(b"".join(vec[at[k]] for k in these), f"<i{w}").reshape(len(these), length)
        out[length] = (at, rows)
    return out


class Group:
    """A group's rows in the order (label, id), ready to score anchors."""

    def __init__(self, rows: list[tuple]):
        uid, vid, lab, n, width, vec = zip(*rows, strict=True) if rows else ((),) * 6
        self.uid, self.vid, self.size = np.array(uid, np.int64), np.array(vid, np.int64), len(uid)
        self.own = {}
        for k, name in enumerate(lab):
            self.own[name] = (self.own.get(name, (k, k))[0], k + 1)
        self.parts = vectors_of(n, width, vec)
        self.norm = max((float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) for _, m in self.parts.values()), default=0.0)
        self.typed: dict = {}

    def part(self, length: int, dtype) -> np.ndarray:
        if (length, dtype) not in self.typed:
            self.typed[length, dtype] = self.parts[length][1].astype(dtype)
        return self.typed[length, dtype]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact products as integers; floating point only where it is exact."""
        norm = self.norm * float(np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        dtype = np.float32 if norm < 1 << 23 else np.float64 if norm < 1 << 52 else np.int64
        out, typed = np.empty((len(anchors), self.size), np.int64), anchors.astype(dtype)
        for length, (at, _) in self.parts.items():
            d = min(length, anchors.shape[1])
            out[:, at] = typed[:, :d] @ self.part(length, dtype)[:, :d].T
        return out

    def positives(self, uid: int, lab: str, scores: np.ndarray, count: int) -> list[tuple]:
        """(row uid, row id, score) of the best of the anchor's label."""
        a, b = self.own.get(lab, (0, 0))
        at = np.arange(a, b)
        at = at[self.uid[a:b] != uid]
        s = scores[at]
        if len(at) > 4 * count:
            best = s >= np.partition(s, len(s) - count)[len(s) - count]
            at, s = at[best], s[best]
        first = np.argsort(-s, kind="stable")[:count]  # -2^63 can't occur: |score| < 2^63 or wrapped
        return [(int(self.uid[k]), int(self.vid[k]), int(scores[k])) for k in at[first]]

    def others(self, lab: str, scores: np.ndarray, least: int) -> np.ndarray:
        """Positions of rows of other labels that score ``least`` or more."""
        a, b = self.own.get(lab, (0, 0))
        return np.concatenate([np.flatnonzero(scores[:a] >= least), b + np.flatnonzero(scores[b:] >= least)])


def passes(side: str, count: int):
    """The task of one pass: for each anchor of a group, its positives, its
    windows' counts by bucket, or its rows at and above the buckets found."""

    def answer(group: Group, anchor: tuple, scores: np.ndarray) -> list[tuple]:
        uid, lab, windows = anchor[0], anchor[2], anchor[6] or []
        if side == "positives":
            return [(uid, -1, *p) for p in group.positives(uid, lab, scores, count)]
        if not windows:
            return []
        at = group.others(lab, scores, min(w["top"] - w["base"] - w["span"] + 1 for w in windows))
        s, out = scores[at], []
        if side == "counts":
            s.sort()
            for w in windows:
                high = w["top"] - w["base"]
                stop, start = np.searchsorted(s, [high, high - w["span"]], "right")
                bucket, n = np.unique((high - s[max(start, stop - w["need"]) : stop]) // step_of(w["span"]), return_counts=True)
                out += [(uid, w["p"], b, c, 0) for b, c in zip(bucket.tolist(), n.tolist(), strict=True)]
            return out
        for w in windows:
            inside = np.flatnonzero((s <= w["top"]) & (s > w["top"] - w["base"] - w["span"]))
            rows = at[inside]
            first = np.lexsort((group.uid[rows], group.vid[rows], -s[inside]))[:count]
            out += [(uid, w["p"], int(group.uid[k]), int(group.vid[k]), int(scores[k])) for k in rows[first]]
        return out

    def answers(group: Group, anchors: list[tuple]) -> list[tuple]:
        out = []
        for at, matrix in vectors_of([a[3] for a in anchors], [a[4] for a in anchors], [a[5] for a in anchors]).values():
            many = max(CELLS // max(group.size, 1), 1)
            for k in range(0, len(at), many):
                for i, s in zip(at[k : k + many], group.scores(matrix[k : k + many]), strict=True):
                    out += answer(group, anchors[i], s)
        return out

    def run(batches):
        key, rows, group, anchors, out = None, [], None, [], []
        for batch in batches:
            c = [col.to_pylist() for col in batch.columns]
            for g, kind, *row in zip(*c, strict=True):
                if g != key:
                    out += answers(group, anchors) if anchors else []
                    key, rows, group, anchors = g, [], None, []
                if kind == 0:
                    rows.append(tuple(row[:6]))
                    continue
                if group is None:
                    group, rows = Group(rows), []
                anchors.append(tuple(row))
                if len(anchors) == 512:
                    out += answers(group, anchors)
                    anchors = []
            if len(out) > 50_000:
                yield packed(out)
                out = []
        out += answers(group, anchors) if anchors else []
        yield packed(out)

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 5)], names=["anchor", "p", "a", "b", "score"])

    return run


def step_of(span: int) -> int:
    """Scores in a bucket of an interval of ``span`` scores."""
    return -(-span // RADIX)


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, k: int = K, low: int = LOW, high: int = HIGH, group_elements: int = ELEMENTS, few: int = FEW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for each anchor (id divisible by ``every``) and each of its
    ``positives`` the first ``k`` rows of other labels whose score lies
    between ``low`` and ``high`` percent of the positive's."""
    rows = quantised(vectors, vec_id, vector, label, scale)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("e")).first()
    groups = max(min(GROUPS, -(-size["n"] // LEAST_ROWS)), -(-size["e"] // group_elements), 1)
    anchors = rows.where(F.col("vid") % every == 0)
    window = "array<struct<p: int, top: bigint, base: bigint, span: bigint, need: int>>"
    columns = ["uid", "vid", "lab", "n", "width", "vec"]
    filed = rows.select(F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), *columns, F.lit(None).cast(window).alias("windows"))

    def asked(windows: DataFrame | None, side: str, count: int) -> DataFrame:
        """One pass of the anchors that have ``windows`` over all groups."""
        if windows is None:
            who = anchors.withColumn("windows", F.lit(None).cast(window))
        else:
            own = windows.groupBy("anchor").agg(F.collect_list(F.struct("p", "top", "base", "span", "need")).alias("windows"))  # at most as many as positives
            who = anchors.join(own, anchors["uid"] == own["anchor"])
        who = who.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), *columns, "windows")
        dealt = filed.unionByName(who).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind", "lab", "vid", "uid")
        return dealt.mapInArrow(passes(side, count), "anchor long, p long, a long, b long, score long")

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "b", "a")
    chosen = asked(None, "positives", positives).withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
    percent = lambda q, up: F.expr(f"{q} * (score div 100) + ({q} * (score % 100) + {up}) div 100")
    chosen = chosen.select("anchor", F.col("r").alias("p"), F.col("b").alias("positive_id"), F.col("score").alias("positive_score"), percent(high, 0).alias("top"), percent(low, 99).alias("least"))
    chosen = materialize(chosen, "negatives-positives")

    open_ = chosen.where("positive_score >= 0 AND top >= least").select("anchor", "p", "top", F.lit(0).cast("long").alias("base"), (F.col("top") - F.col("least") + 1).alias("span"), F.lit(k).alias("need"))
    found, open_ = [], materialize(open_, "negatives-windows")
    while not open_.isEmpty():
        sums = asked(open_, "counts", k).groupBy("anchor", "p", F.col("a").alias("bucket")).agg(F.sum("b").alias("n"))
        down = Window.partitionBy("anchor", "p").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("n").over(down)).join(open_.select("anchor", "p", "need"), ["anchor", "p"])
        kth = sums.where("upto >= need AND upto - n < need").select("anchor", "p", "bucket", (F.col("upto") - F.col("n")).cast("int").alias("above"), F.col("upto").alias("upto"))
        step = F.expr(f"(span + {RADIX - 1}) div {RADIX}")
        next_ = open_.join(kth, ["anchor", "p"], "left").withColumn("step", step).select(
            "anchor", "p", "top",
            F.when(F.col("bucket").isNull(), F.col("base")).otherwise(F.col("base") + F.col("bucket") * F.col("step")).alias("base"),
            F.when(F.col("bucket").isNull(), F.col("span")).otherwise(F.least("step", F.col("span") - F.col("bucket") * F.col("step"))).alias("span"),
            (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"),
            (F.col("bucket").isNull() | (F.col("step") == 1) | (F.lit(k) - F.col("need") + F.col("upto") <= few * k)).alias("done"),
        )
        next_ = materialize(next_, "negatives-digit")
        found.append(next_.where("done").drop("done"))
        open_ = next_.where("NOT done").drop("done")
    if not found:
        found = [open_]
    windows = found[0]
    for more in found[1:]:
        windows = windows.unionByName(more)
    first = Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "b", "a")
    taken = asked(windows, "rows", k).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    named = taken.select("anchor", "p", "rank", F.col("b").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["anchor", "p"])
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("vid").alias("anchor_id"))
    return named.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
