"""Near-duplicate groups against all pairs in plain Python."""

import random
from collections import defaultdict

import numpy as np

from llm import jaccard_join as J
from llm.components import components

rng = random.Random(8)


def grams(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, threshold=0.8):
    sets = [grams(t) for t in texts]
    n = [0] * len(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(find(i), n[i]) for i in range(len(texts))]


def corpus():
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " \n", "Hi", "hi", "a b c d", "A B C D", "a b c d e", "x " * 30000]
    passage = [word() for _ in range(60)]
    for _ in range(60):
        t = [word() for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(t))
        for _ in range(rng.choice([0, 0, 1, 3])):
            u = list(t)
            for _ in range(rng.randrange(0, 4)):
                u[rng.randrange(len(u))] = word()
            texts.append(" ".join(u))
    for _ in range(40):  # a passage that many share
        texts.append(" ".join(passage + [word() for _ in range(150)]))
    t = [word() for _ in range(400)]
    for _ in range(90):  # a large group of near copies
        u = list(t)
        u[rng.randrange(400)] = word()
        texts.append(" ".join(u))
    return texts + [texts[10]] * 25


def test_groups(spark):
    texts = corpus()
    want = brute(texts)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(df).collect()}
    assert got == dict(enumerate(want))
    kept = {r.doc_id for r in J.keep_one(df).collect()}
    assert kept == {i for i, (c, _) in enumerate(want) if c == i}


def test_blocks_and_ids(spark):
    """Small blocks give the same; repeated and null ids stay apart."""
    base = [f"a{rng.randrange(9999)}" for _ in range(200)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(50)]
    rows = J.with_uid(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "t")
    a = {r.uid: (r.group, r.n_links) for r in J.jaccard_classes(rows, block=7).collect()}
    assert a == {r.uid: (r.group, r.n_links) for r in J.jaccard_classes(rows).collect()} and all(v[1] == 49 for v in a.values())
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "other text here")], "doc_id long, text string")
    got = sorted(map(str, J.jaccard_join(df).collect()))
    assert got == sorted(["Row(doc_id=None, class_id=3, n_links=2)"] * 2 + ["Row(doc_id=3, class_id=3, n_links=2)", "Row(doc_id=3, class_id=3, n_links=0)"])
    assert J.keep_one(df).count() == 2 and J.jaccard_join(df.limit(0)).count() == 0


def test_pruning_rule():
    limits = J.least_matches(0.8, 1e-4)
    assert [n for n, _ in limits] == [32, 64, 96, 128] and all(0 < m < 0.8 * n for n, m in limits)
    m = J.min_hashes(np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 128)
    k = J.min_hashes(np.arange(201, 2201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 128)
    assert abs((m == k).mean() - 1800 / 2200) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101)] + [(200, k) for k in range(201, 400)] + [(500, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = defaultdict(int, {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 400)})
    assert got == dict(want)


def test_only_texts_to_compare_are_kept(spark):
    from pyspark.sql import functions as F

    from llm.jaccard_join import marked

    ids = [*range(130), (3 << 33) + 63, (3 << 33) + 64, (1 << 40) + 5]
    wanted = {0, 5, 63, 64, 127, (3 << 33) + 63, (1 << 40) + 5}
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "uid long, text string")
    kept = marked(rows, rows.where(F.col("uid").isin(*wanted)).select("uid"))
    assert kept.columns == ["uid", "text"] and {tuple(r) for r in kept.collect()} == {(i, f"t{i}") for i in wanted}
    assert kept.count() == len(wanted)
    assert "Exchange hashpartitioning(uid" not in kept._jdf.queryExecution().executedPlan().toString()  # texts stay where they lie


def test_shuffle_a_document(spark):
    """With broadcasts off, as for large tables: band keys go through one
    shuffle, a row each, and no partner is copied sixteen times."""
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(20)) for _ in range(3000)]
    df = spark.createDataFrame([(i, texts[i % 2900]) for i in range(3000)], "doc_id long, text string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(df).collect()}
        each = (written() - before) / 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {i: (i % 2900, 1 if i < 100 or i >= 2900 else 0) for i in range(3000)}
    assert 100 < each < 1000, each


def test_stars_connect_as_keys_do(spark):
    """Chunks of any size connect the same prints; no key repeats in a chunk."""
    draw = np.random.default_rng(3)
    rows = [(p, [int(k) for k in draw.integers(0, 400, 3)] + [1000 + p % 7 if p < 40 else 10000 + p]) for p in range(1, 200)] + [(0, [])]
    sketched = spark.createDataFrame(rows, "print long, bands array<long>").repartition(3)
    by_key = defaultdict(set)
    for p, bands in rows:
        for k in bands:
            by_key[k].add(p)
    want = dict(map(tuple, components(spark.createDataFrame([(p, min(g)) for g in by_key.values() for p in g if p != min(g)], "u long, v long")).collect()))
    for chunk in (5, 1 << 20):
        assert dict(map(tuple, components(J.near_links(sketched, chunk)).collect())) == want
    key, low, u, v = J.stars(np.array([7, 3, 7, 7, 3]), np.array([5, 9, 2, 5, 9]))
    assert (key.tolist(), low.tolist(), u.tolist(), v.tolist()) == ([3, 7], [9, 2], [5], [2])
