"""Near-duplicates by SimHash fingerprints, found with BK-trees.

1. Every text becomes a 64-bit fingerprint: a bit is 1 if more than half of
   the text's word shingles have it set in their hash. Copies share one
   fingerprint and cost one row from here on.
2. Fingerprints at most r bits apart agree in one of r + 1 blocks of bits, so
   each goes to the shards of its r + 1 block values, and no link is lost.
   A shard's BK-tree is searched by the shard's own fingerprints, following
   only edges within the radius. A shard of more than ``slice_size`` prints
   is cut into slices: every slice's tree meets every slice of the shard as a
   pair of its own, so a task holds two slices at most.
3. Tasks return a spanning forest of the links found; its components, by
   alternating stars, are the groups.

No tree is sent to all executors, as trees together grow with the data: a
tree only goes to the tasks that hold fingerprints of its own shard.

Words are runs of anything but ASCII white space, A-Z lower-cased; repeated
shingles count each time. A text of fewer words than a shingle has is one
shingle; one without words (null, empty) has fingerprint zero and is linked
like any other. Repeated rows and equal ids are documents of their own; a
group of null ids only has a null component. Columns other than id and text
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bk_tree import Forest, join_roots
from .common import carried, hot_join, materialize, ship, text_of
from .components import components

N, RADIUS, SEED, SLICE, HELD = 3, 2, 42, 1 << 16, 1 << 19


def fingerprint(text: str, n: int = N, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text, in chunks of its shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), max(len(words) - n + 1, 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    stops = starts[min(n, len(words)) - 1 :] + sizes[min(n, len(words)) - 1 :] - 1
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, k, 1 << 16):
        part = [h(joined[a:b], seed) for a, b in zip(starts[at : min(at + (1 << 16), k)].tolist(), stops[at : at + (1 << 16)].tolist(), strict=True)]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > k).tolist())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, seed: int = SEED) -> DataFrame:
    """(doc_id, print): the fingerprint's bits as a long."""
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = carried(docs, (), doc_id=doc_id, text=text)[0].select("doc_id", text_of("text").alias("text"))

    def sketch(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = np.array([fingerprint(t, n, seed) for t in batch.column(1).slice(at, 500).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return rows.mapInArrow(sketch, T.StructType([rows.schema["doc_id"], T.StructField("print", T.LongType())]))


def shard_values(print_: Column, radius: int) -> Column:
    """The values of ``radius`` + 1 blocks of bits, each with its block's number on top."""
    cuts = [64 * b // (radius + 1) for b in range(radius + 2)]
    mask = lambda b: F.lit((1 << (cuts[b + 1] - cuts[b])) - 1)
    if radius == 0:
        return F.array(print_)
    return F.array(*[F.shiftrightunsigned(print_, cuts[b]).bitwiseAND(mask(b)) + F.lit(b << 58) for b in range(radius + 1)])


def links(prints: DataFrame, radius: int = RADIUS, slice_size: int = SLICE) -> DataFrame:
    """(u, v) for different fingerprints of ``prints`` (column print, each
    once): links that join the same groups as all pairs within ``radius``."""
    import pyarrow as pa

    ship(prints.sparkSession)
    shards = prints.select("print", F.explode(shard_values(F.col("print"), radius)).alias("shard"))
    large = materialize(shards.groupBy("shard").agg(F.count("*").alias("rows")).where(F.col("rows") > slice_size), "simhash-large")
    cells = shards.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0)).withColumn("own", F.lit(0))
    if not large.isEmpty():
        rest = shards.join(large, "shard", "left_anti").withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0)).withColumn("own", F.lit(0))
        slices = F.ceil(F.col("rows") / F.lit(slice_size)).cast("int")
        cut = hot_join(shards, large, "shard", "rows", 0).withColumn("own", F.pmod(F.xxhash64("print"), slices).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
        cells = rest.unionByName(cut.select("print", "shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own"))
    cells = cells.select("shard", "lo", "hi", "own", "print").repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")

    def match(columns):
        shard, lo, hi, own, print_ = columns
        fresh = np.ones(len(shard), dtype=bool)
        fresh[1:] = (shard[1:] != shard[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        cell, values = np.cumsum(fresh) - 1, print_.view(np.uint64)
        tree, asks = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        names, dense = np.unique(cell[tree], return_inverse=True)
        asks = asks[np.isin(cell[asks], names)]
        root, waiting = np.arange(len(shard)), []
        for q, t in Forest(values[tree], dense).within(values[asks], np.searchsorted(names, cell[asks]), radius):
            other = asks[q] != tree[t]
            if other.any():
                waiting.append((asks[q[other]], tree[t[other]]))
            if sum(len(a) for a, _ in waiting) > HELD:
                root, waiting = join_roots(root, *map(np.concatenate, zip(*waiting, strict=True))), []
        if waiting:
            root = join_roots(root, *map(np.concatenate, zip(*waiting, strict=True)))
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(print_[child]), pa.array(print_[root[child]])], names=["u", "v"])

    def search(batches):
        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) > HELD:  # whole cells only; the last one may go on
                key = np.stack(held[:3])
                last = np.flatnonzero((key != key[:, -1:]).any(axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield match([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield match(held)

    return cells.mapInArrow(search, "u long, v long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, radius: int = RADIUS, seed: int = SEED, slice_size: int = SLICE) -> DataFrame:
    """One row a document: doc_id, print (the fingerprint's bits as a long),
    component_id (smallest id of its group)."""
    found = materialize(fingerprints(docs, doc_id, text, n, seed), "simhash-prints")
    classes = materialize(found.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-classes")
    groups = components(materialize(links(classes.select("print"), radius, slice_size), "simhash-links"))
    named = classes.join(groups, classes["print"] == groups["node"], "left").select("print", "least", "copies", F.coalesce("component", "print").alias("component"))
    named = materialize(named, "simhash-named")
    lowest = materialize(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("rows")), "simhash-lowest")
    named = hot_join(named, lowest, "component", "rows", classes.count()).select("print", "copies", "component_id")
    return hot_join(found, materialize(named, "simhash-groups"), "print", "copies", found.count()).select("doc_id", "print", "component_id")
