"""Join of near-duplicate documents on word n-gram Jaccard similarity.

1. Every text becomes a set of hashed word 5-grams. Texts with equal sets are
   one class from here on; however many copies there are, they cost one row.
2. Min-hash bands propose candidates: classes that share a band value are
   linked to the smallest of them (never pair by pair), first within chunks
   where they lie, then between chunks by one shuffle of a row a value and
   chunk; connected components of these links are the candidate clusters.
3. Within a cluster, pairs are compared on min-hash values a few at a time;
   a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold (uniform prior, binomial matches) falls below a
   tolerance. What remains is verified exactly on the sets. Clusters larger
   than a block are compared block against block, so a task holds two blocks
   at most; a task returns sums and a spanning forest, never the pairs.
   Texts travel compressed and become sets again where they are compared.
4. Components of the verified links are the duplicate groups.

Words are runs of anything but ASCII white space, A-Z lower-cased. A text of
one to four words is a single gram. Texts without words (null, empty) link to
nothing. Repeated rows and equal or null ids are documents of their own.
All columns of a caller stay, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, hot_join, materialize, ship, text_of
from .components import components

N, THRESHOLD, BANDS, ROWS, TOLERANCE, STEP, BLOCK, CACHE = 5, 0.8, 30, 6, 1e-6, 32, 384, 400_000
COMPARED, CHUNK = 128, 1 << 20
_rng = np.random.default_rng(20)
A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
GRAM = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct gram hashes of texts; a bounded cache of word hashes."""

    def __init__(self, n: int = N):
        import xxhash

        self.n, self.hash, self.known = n, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = self.hash(w)
            out.append(h)
        h = np.array(out, dtype=np.uint64)
        n = min(self.n, len(h))
        if n == 0:
            return h
        k = len(h) - n + 1
        g = np.full(k, n, dtype=np.uint64)
        for i in range(n):
            g += h[i : i + k] * GRAM[i]
            g = g ^ (g >> np.uint64(29))
        return np.unique(mixed(g))


def min_hashes(grams: np.ndarray, count: int) -> np.ndarray:
    """``count`` min-hash values (upper halves) of a set of grams."""
    out = np.full(count, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(grams), 4096):  # bounded scratch for very long texts
        part = grams[at : at + 4096]
        out = np.minimum(out, ((A[:count, None] * part + B[:count, None]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32)


def class_of(grams: np.ndarray) -> int:
    """A 64-bit print of the whole set."""
    if not len(grams):
        return 0
    with np.errstate(over="ignore"):
        x = mixed(np.array([mixed(grams ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(grams))]))
    return int(x.view(np.int64)[0]) or 1


def least_matches(threshold: float, tolerance: float, step: int = STEP, total: int = COMPARED) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair) after each step."""
    s = np.linspace(0, 1, 20001)[1:-1]
    out = []
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            like = np.exp(log - log.max())
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                break
        out.append((n, m))
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, limits: list[tuple[int, int]]):
    """Index pairs of ``left`` x ``right`` (or within ``left``) whose exact
    Jaccard similarity reaches ``threshold``, a bounded number at a time."""
    count = limits[-1][0]
    a = np.array([min_hashes(g, count) for g in left])
    b = a if right is None else np.array([min_hashes(g, count) for g in right])
    other = left if right is None else right
    for at in range(0, len(left), 64):
        top = min(at + 64, len(left))
        i, j = np.meshgrid(np.arange(at, top), np.arange(len(other)), indexing="ij")
        i, j = i.ravel(), j.ravel()
        if right is None:
            i, j = i[i < j], j[i < j]
        met = np.zeros(len(i), dtype=np.int32)
        before = 0
        for n, least in limits:
            met = met + (a[i, before:n] == b[j, before:n]).sum(axis=1)
            keep = met >= least
            i, j, met, before = i[keep], j[keep], met[keep], n
        if len(i):
            ok = verified(left, other, i, j, threshold)
            if ok.any():
                yield i[ok], j[ok]


def verified(left, right, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Exact test of each pair; many pairs of few rows go through one product
    of incidence matrices, others gram by gram."""
    rows, cols = np.unique(i), np.unique(j)
    sizes_l, sizes_r = np.array([len(left[x]) for x in rows]), np.array([len(right[x]) for x in cols])
    ri, cj = np.searchsorted(rows, i), np.searchsorted(cols, j)
    if len(i) < 4 * len(cols):
        both = np.array([np.intersect1d(left[x], right[y], assume_unique=True).size for x, y in zip(i, j, strict=True)])
    else:
        grams = np.unique(np.concatenate([left[x] for x in rows]))
        both_all = np.zeros((len(rows), len(cols)), dtype=np.float64)
        for at in range(0, len(grams), 8192):
            part = grams[at : at + 8192]
            both_all += incidence(left, rows, part) @ incidence(right, cols, part).T
        both = both_all[ri, cj]
    return both >= threshold * (sizes_l[ri] + sizes_r[cj] - both) - 1e-9


def incidence(sets, which: np.ndarray, grams: np.ndarray) -> np.ndarray:
    out = np.zeros((len(which), len(grams)), dtype=np.float32)
    for r, x in enumerate(which):
        at = np.searchsorted(grams, sets[x])
        at[at == len(grams)] = 0
        out[r, at[grams[at] == sets[x]]] = 1
    return out


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``uid`` is in ``wanted``, found where they lie: a bit a
    uid, 64 to a number, is all that is broadcast, so only texts that will be
    compared are shuffled."""
    block, bit = F.shiftright("uid", 6).alias("block"), F.col("uid").bitwiseAND(F.lit(63)).cast("int")
    marks = wanted.select(block, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("block").agg(F.bit_or("bit").alias("bits"))
    met = rows.withColumn("block", block).join(F.broadcast(marks), "block")
    return met.where(F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def stars(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, smallest print of each, other prints with their key,
    that key's smallest); the last two without repeats."""
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    low = prints[new]
    root = low[np.cumsum(new) - 1]
    more = prints != root
    pairs = np.unique(np.stack([prints[more], root[more]]), axis=1)
    return keys[new], low, pairs[0], pairs[1]


def near_links(sketched: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links between prints that share a key in ``bands``, enough to
    connect all that do. A key comes at most once a chunk of about ``chunk``
    keys to the shuffle, however many rows have it."""
    import pyarrow as pa

    def combine(inside: bool):
        def run(batches):
            keys, prints, held = [], [], 0

            def flush():
                key, low, u, v = stars(np.concatenate(keys), np.concatenate(prints))
                out = pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)] if inside else [pa.array(key), pa.array(low)], names=names)
                for at in range(0, out.num_rows, 65536):
                    yield out.slice(at, 65536)

            for batch in batches:
                lists = batch.column(1)
                keys.append(lists.flatten().to_numpy())
                prints.append(np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy()))
                held += len(keys[-1])
                if held >= chunk:
                    yield from flush()
                    keys, prints, held = [], [], 0
            if held:
                yield from flush()

        names = ["u", "v"] if inside else ["key", "u"]
        return sketched.where("print <> 0").select("print", "bands").mapInArrow(run, f"{names[0]} long, {names[1]} long")

    across = combine(False).withColumn("v", F.min("u").over(Window.partitionBy("key"))).where("u <> v").select("u", "v")
    return combine(True).unionByName(across)


def jaccard_classes(docs: DataFrame, text: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """``docs`` (rows that must stay the same when read twice, with a unique
    long ``uid``) as uid, class print, group (smallest uid of the duplicate
    group) and n_links (other documents at ``threshold`` or nearer)."""
    import pyarrow as pa

    ship(docs.sparkSession)
    bands, rows = BANDS, ROWS

    def sketch(batches):
        shingle = Shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                prints, keys = [], []
                for t in batch.column(1).slice(at, 500).to_pylist():
                    g = shingle(t)
                    prints.append(class_of(g))
                    m = min_hashes(g, bands * rows).astype(np.uint64).reshape(bands, rows)
                    k = np.arange(1, bands + 1, dtype=np.uint64)
                    for r in range(rows):
                        k = mixed(k * np.uint64(31) + m[:, r])
                    keys.append(k.view(np.int64) if len(g) else k[:0].view(np.int64))
                sizes = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(prints, pa.int64()), lists], names=["uid", "print", "bands"])

    base = docs.select("uid", text_of(text).alias("text"))
    sketched = materialize(base.mapInArrow(sketch, "uid long, print long, bands array<long>"), "jaccard-sketch")
    classes = sketched.where("print <> 0").groupBy("print").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"))
    classes = materialize(classes, "jaccard-classes")
    clusters = materialize(components(near_links(sketched)), "jaccard-clusters")

    members = clusters.join(classes, clusters["node"] == classes["print"]).select("uid", "print", "copies", F.col("component").alias("cluster"))
    sizes = clusters.groupBy(F.col("component").alias("cluster")).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.count("*").alias("rows"))
    members = hot_join(members, materialize(sizes, "jaccard-sizes"), "cluster", "rows", clusters.count())
    members = materialize(members.select("uid", "print", "copies", "cluster", "blocks"), "jaccard-members")

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [zlib.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["uid", "packed"])

    texts = members.join(marked(base, members).mapInArrow(packed, "uid long, packed binary"), "uid")
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = texts.withColumn("own", own).withColumn("other", other).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    dealt = dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "print").select("cluster", "lo", "hi", "own", "print", "copies", "packed")
    limits = least_matches(threshold, tolerance)

    def compare(batches):
        def group(key, own, prints, copies, sets):
            left = [k for k, o in enumerate(own) if o == key[1]]
            right = [k for k, o in enumerate(own) if o == key[2]] if key[1] != key[2] else None
            # rows that a lost task made twice can't occur; equal prints can only meet once
            links, root = [0] * len(own), list(range(len(own)))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in linked([sets[k] for k in left], None if right is None else [sets[k] for k in right], threshold, limits) if left and (right is None or right) else ():
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = left[x], (left if right is None else right)[y]
                    links[p] += copies[q]
                    links[q] += copies[p]
                    p, q = find(p), find(q)
                    root[max(p, q)] = min(p, q)
            return [(prints[k], links[k], prints[find(k)]) for k in range(len(own)) if links[k]]

        def flush(rows):
            cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["print", "links", "root"])

        shingle, key, held, out = Shingler(n), None, ([], [], [], []), []
        for batch in batches:
            c = [batch.column(k).to_pylist() for k in range(6)]
            raw = batch.column(6)
            for k in range(batch.num_rows):
                now = (c[0][k], c[1][k], c[2][k])
                if now != key:
                    if len(held[0]) > 1:
                        out += group(key, *held)
                    key, held = now, ([], [], [], [])
                    if len(out) > 5000:
                        yield flush(out)
                        out = []
                for column, value in zip(held, (c[3][k], c[4][k], c[5][k], shingle(zlib.decompress(raw[k].as_py()).decode("utf-8", "surrogatepass"))), strict=True):
                    column.append(value)
        if len(held[0]) > 1:
            out += group(key, *held)
        yield flush(out)

    links = materialize(dealt.mapInArrow(compare, "print long, links long, root long"), "jaccard-links")
    groups = components(links.select(F.col("print").alias("u"), F.col("root").alias("v")))
    sums = links.groupBy("print").agg(F.sum("links").alias("links"))
    named = classes.join(groups, classes["print"] == groups["node"], "left").join(sums, "print", "left")
    named = named.where("copies > 1 OR component IS NOT NULL").select("print", "uid", "copies", F.coalesce("component", "print").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    named = materialize(named, "jaccard-linked")
    lowest = materialize(named.groupBy("component").agg(F.min("uid").alias("group"), F.count("*").alias("rows")), "jaccard-lowest")
    named = hot_join(named, lowest, "component", "rows", named.count()).select("print", "group", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    prints = sketched.select("uid", "print")
    found = hot_join(prints.where("print <> 0"), materialize(named, "jaccard-named"), "print", "copies", sketched.count(), how="left")
    return found.unionByName(prints.where("print = 0"), allowMissingColumns=True).select("uid", "print", F.coalesce("group", "uid").alias("group"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def with_uid(rows: DataFrame, name: str) -> DataFrame:
    """A written copy of ``rows`` with a unique long ``uid`` that stays."""
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), name)


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: its id, ``class_id`` (smallest id of its group of
    near-duplicates; its own if it has none) and ``n_links``."""
    rows = carried(docs, (), doc_id=doc_id, text=text)[0].select("doc_id", "text")
    rows = with_uid(rows, "jaccard-rows")
    found = materialize(jaccard_classes(rows, threshold=threshold).join(rows.select("uid", "doc_id"), "uid"), "jaccard-found")
    grouped = found.where("n_links > 0")
    lowest = materialize(grouped.groupBy("group").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")), "jaccard-least")
    both = hot_join(grouped, lowest, "group", "rows", found.count()).select("doc_id", "class_id", "n_links")
    return both.unionByName(found.where("n_links = 0").select("doc_id", F.col("doc_id").alias("class_id"), "n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id
    (ids before null ones; of equal ids the first row read)."""
    names, lower = docs.columns, [c.lower() for c in docs.columns]
    rows, back = carried(docs, (), j_id=doc_id)
    rows = with_uid(rows, "jaccard-rows")
    place = names.index(text) if text in names else lower.index(text.lower())
    found = jaccard_classes(rows.select("uid", F.col(f"in_row.c{place}").alias("text")), threshold=threshold).join(rows.select("uid", "j_id"), "uid")
    ranked = found.select("group", F.struct(F.col("j_id").isNull().alias("n"), F.col("j_id").alias("i"), "uid").alias("s"))
    kept = ranked.groupBy("group").agg(F.min("s").alias("s")).select(F.col("s.uid").alias("uid"))
    return marked(rows, materialize(kept, "jaccard-kept")).select(*back)
