"""The whole language model (all pairs and triples) against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import llm.queries as queries
from llm import lm_scoring as M


#: Half a step of the trie's 16 bits over at most seven decades, in up to three factors.
STEP = 3 * 7 / (1 << 16) / 2 + 1e-6


def toks(t):
    return [*(t or "").encode().lower().split(), M.END]


def corpus():
    rng = random.Random(4)
    nxt = {i: [rng.randrange(40) for _ in range(3)] for i in range(40)}
    out = [None, "", "one", "seen once only here", "ÉÉ é A a B\x0bc", "unseen " * 3, "a " * 3000, "the of " * 500]
    for k in range(300):
        w, t = rng.randrange(40), []
        for _ in range(rng.randrange(1, 60)):
            t.append(f"W{w}" if rng.random() < 0.2 else f"w{w}")
            w = rng.choice(nxt[w]) if rng.random() < 0.8 else rng.randrange(40)
        out.append(" ".join(t) + (" common passage that every third text holds" if k % 3 == 0 else ""))
    rows = list(enumerate(out))
    return [*rows, rows[20], rows[20], (None, "a null id"), (rows[21][0], "an id again")]


def trained(i):
    return zlib.crc32(str(i).encode()) % 5 != 1 if i is not None else True


def whole_model(texts):
    """p(w | u, v) from every n-gram of the training texts, seen once or more."""
    n1, n2, n3 = Counter(), Counter(), Counter()
    for t in texts:
        x = [M.BEGIN, M.BEGIN, *toks(t)]
        n1.update(x[1:])
        n2.update(zip(x[1:], x[2:], strict=False))
        n3.update(zip(x, x[1:], x[2:], strict=False))
    n, size = sum(n1.values()) - n1[M.BEGIN], len(n1) - (1 if n1[M.BEGIN] else 0)
    after1, after2, all2 = defaultdict(set), defaultdict(set), Counter()
    for v, w in n2:
        after1[v].add(w)
    for (u, v, w), c in n3.items():
        after2[u, v].add(w)
        all2[u, v] += c

    def p(u, v, w):
        out = (n1[w] + 0.5) / (n + 0.5 * (size + 1))
        if after1[v]:
            out = max(n2[v, w] - 0.75, 0) / n1[v] + 0.75 * len(after1[v]) / n1[v] * out
        if after2[u, v]:
            out = max(n3[u, v, w] - 0.75, 0) / all2[u, v] + 0.75 * len(after2[u, v]) / all2[u, v] * out
        return out

    return p, n1, n


def score(p, t):
    x = [M.BEGIN, M.BEGIN, *toks(t)]
    return sum(math.log10(p(*x[k : k + 3])) for k in range(len(x) - 2))


@pytest.mark.parametrize("sizes", [(M.BLOCK_TOKENS, M.SHARD_ENTRIES), (4000, 4000), (2000, 800)])
def test_scores_all_triples(spark, monkeypatch, sizes):
    """In one shard, in some, and in many with most words split."""
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, score string, block double").repartition(3)
    p, n1, n = whole_model([t for i, t in rows if trained(i)])
    assert abs(sum(p(b"w1", b"w2", w) for w in n1 if w != M.BEGIN) + p(b"w1", b"w2", b"never") - 1) < 1e-9
    if sizes[0] == M.BLOCK_TOKENS:
        monkeypatch.setattr(queries, "read_table", lambda *_: df)
        out = queries.QUERIES["op6_lm_scoring"](spark, "")
    else:
        out = M.score_documents(df, block_tokens=sizes[0], shard_entries=sizes[1])
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.held_out, r.base_score, r.score) for r in out.collect())
    floor = n + 0.5 * (len(n1) - 1 + 1)
    base = lambda t: sum(math.log10((n1[w] + 0.5) / floor) for w in toks(t))
    want = sorted((str(i), len(toks(t)), sum(n1[w] > 0 for w in toks(t)), n, not trained(i), base(t), score(p, t)) for i, t in rows)
    gain = 0.0
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-7 * w[1]
        assert abs(g[6] - w[6]) < STEP * w[1], w
        gain += (g[6] - g[5]) * g[4]
    assert gain > 0  # the model knows more of texts it hasn't seen than word counts do


def test_scores_do_not_depend_on_the_dealing(spark):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(corpus())], "doc_id long, text string")
    found = []
    for parts, block in ((1, M.BLOCK_TOKENS), (7, 3000), (40, 900)):
        out = M.score_documents(df.repartition(parts, F.rand(parts)), block_tokens=block, shard_entries=4000).collect()
        found.append({r.doc_id: (r.base_score, r.score) for r in out})
    for other in found[1:]:
        assert all(abs(a - b) < 1e-9 for i in found[0] for a, b in zip(found[0][i], other[i], strict=True))


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.score_documents(df).count() == 0
    held = next(i for i in range(100) if not trained(i))
    rows = M.score_documents(spark.createDataFrame([(held, "a b"), (held, None)], df.schema)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in rows) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_model_kept_for_other_texts(spark):
    rows = corpus()
    texts = [t for _, t in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    p, _, _ = whole_model(texts)
    tries, facts = M.train_model(df, block_tokens=4000, shard_entries=1500)
    assert facts["shards"] > 5 and len(facts["heavy"][0]) > 3
    other = ["w1 w2 w3 never", "", "a a a"]
    got = {r.doc_id: r.score for r in M.score_with(spark.createDataFrame(list(enumerate(other)), df.schema), tries, facts).collect()}
    for i, t in enumerate(other):
        assert abs(got[i] - score(p, t)) < STEP * len(toks(t))


def test_packing_of_numbers():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint32, np.int64, np.uint64, np.float64):
        for n in (0, 1, 1000):
            x = rng.integers(0, 200, n).astype(kind)
            assert (M.unsqueeze(M.squeeze(x)) == x).all()
    rows = np.array(sorted(map(tuple, rng.integers(0, 9, (500, 3)).tolist())))
    for n in (0, 1, 500):
        cols = rows[:n].T
        assert all((a == b).all() for a, b in zip(M.unsteps(*M.steps(*cols)), cols, strict=True))
    big = np.array([0, 2**40, 2**62])
    assert (M.order_of(big[::-1], big, big) == [2, 1, 0]).all()
